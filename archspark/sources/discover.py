"""Capsules, contracts and scopes of a tree of visible files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..languages import LANGUAGES, Language, manifest_table, scannable
from ..languages.registry import KOTLIN_MAIN
from ..operators.match import nearest_ancestor
from ..schema import CONTRACT_FILE


def _under(column: str, root: str) -> Column:
    return F.startswith(F.col(column), F.lit(root.rstrip("/") + "/"))


def kotlin_ids(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """(dir) -> (dir, capsule_id): what the first and the last package directory of the preferred source directory begin with.

    Common are whole segments of the first that the last begins with as text, so a last
    segment may be cut within a name.
    """
    sources = F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(s).alias("src")) for i, s in enumerate(KOTLIN_MAIN)]))
    places = dirs.select("dir", sources.alias("s")).select("dir", "s.rank", F.concat("dir", F.lit("/"), "s.src").alias("abs"))
    chosen = places.join(files.filter("is_dir").select("abs"), "abs", "left_semi").groupBy("dir").agg(F.min_by("abs", "rank").alias("src"))
    kt = files.filter(~F.col("is_dir") & F.endswith(F.col("abs"), F.lit(".kt"))).select("abs")
    below = kt.select("abs", F.explode(paths.ancestors("abs")).alias("src")).join(chosen, "src").select("dir", F.expr("substring(abs, length(src) + 2)").alias("rel")).filter(F.contains(F.col("rel"), F.lit("/")))
    ends = below.withColumn("package", paths.dirname("rel")).groupBy("dir").agg(F.min("package").alias("low"), F.max("package").alias("high"))
    parts = F.split("low", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    common = F.filter(heads, lambda h: F.startswith(F.col("high"), h))
    return ends.filter(F.size(common) > 0).select("dir", F.replace(F.element_at(common, -1), F.lit("/"), F.lit(".")).alias("capsule_id"))


def manifests(files: DataFrame) -> DataFrame:
    """dir, lang, rank, capsule_id of every manifest that names a capsule."""
    spark = files.sparkSession
    named = files.filter(~F.col("is_dir")).withColumn("manifest", paths.basename("abs")).join(F.broadcast(manifest_table(spark)), "manifest").withColumn("dir", paths.dirname("abs"))
    parsers = {x.name: x.capsule_id for x in LANGUAGES.values() if x.capsule_id}

    def name_of(lang: str, content: bytes | None) -> str | None:
        try:
            return parsers[lang]((content or b"").decode("utf-8", "replace"))
        except ValueError:
            return None

    ids = F.udf(name_of, "string", useArrow=True)  # a row for each manifest, not for each file
    plain = named.filter(F.col("lang") != "kotlin").select("dir", "lang", "rank", ids("lang", "content").alias("capsule_id"))
    kotlin = named.filter(F.col("lang") == "kotlin").select("dir", "lang", "rank")
    kotlin = kotlin.join(kotlin_ids(files, kotlin.select("dir").distinct()), "dir").select("dir", "lang", "rank", "capsule_id")
    return plain.unionByName(kotlin).filter("capsule_id is not null and capsule_id <> ''")


def capsules(files: DataFrame, root: str, languages: list[Language]) -> DataFrame:
    """capsule_dir, capsule_id, lang: the nearest at or above root and all below it, one a directory, the first by language."""
    found = manifests(files)
    first = found.groupBy("dir").agg(F.min_by(F.struct("capsule_id", "lang"), "rank").alias("c")).select(F.col("dir").alias("capsule_dir"), "c.capsule_id", "c.lang")
    above = (F.col("capsule_dir") == root) | F.startswith(F.lit(root), F.concat(F.col("capsule_dir"), F.lit("/")))
    nearest = first.filter(above).orderBy(F.length("capsule_dir").desc()).limit(1)
    own = nearest.unionByName(first.filter(_under("capsule_dir", root)))
    return own.filter(F.col("lang").isin(*[x.name for x in languages]))


def contract_dirs(files: DataFrame, name: str = CONTRACT_FILE) -> DataFrame:
    """contract (its path), dir, content."""
    return files.filter(~F.col("is_dir") & (paths.basename("abs") == name)).select(F.col("abs").alias("contract"), paths.dirname("abs").alias("dir"), "content")


def root_contract(caps: DataFrame, contracts: DataFrame, root: str, name: str = CONTRACT_FILE) -> DataFrame:
    """(capsule_dir) -> (capsule_dir, contract): the nearest at or above the requested root, within the capsule if it is above root; else the capsule's own, whether it exists or not.

    For capsules below root the search goes on above them all, so they may share one.
    """
    chain = caps.select("capsule_dir", F.explode(F.concat(F.array(F.lit(root)), paths.ancestors(F.lit(root)))).alias("dir"))
    holds = (F.col("capsule_dir") == root) | F.startswith(F.lit(root), F.concat(F.col("capsule_dir"), F.lit("/")))
    chain = chain.filter(~holds | (F.length("dir") >= F.length("capsule_dir")))
    best = chain.join(contracts.select("dir", "contract"), "dir").groupBy("capsule_dir").agg(F.max_by("contract", F.length("dir")).alias("found"))
    return caps.select("capsule_dir").join(best, "capsule_dir", "left").select("capsule_dir", F.coalesce("found", F.concat("capsule_dir", F.lit(f"/{name}"))).alias("contract"))


def scopes(dirs: DataFrame, contracts: DataFrame) -> DataFrame:
    """(capsule_dir, dir) -> (capsule_dir, dir, scope): the nearest directory with a contract within the capsule, else the capsule's."""
    found = nearest_ancestor(dirs.select("dir", "capsule_dir"), contracts.select("dir"), "capsule_dir")
    return found.select("capsule_dir", "dir", F.coalesce("owner", "capsule_dir").alias("scope"))


def tracked(files: DataFrame, caps: DataFrame, contracts: DataFrame, root: str) -> DataFrame:
    """capsule_dir, capsule_id, lang, abs, rel, scope, content: files below root that count for the capsule they are in.

    A file is the nearest capsule's, which leaves files of nested ones out.
    """
    own = files.filter(~F.col("is_dir") & _under("abs", root)).withColumn("dir", paths.dirname("abs"))
    dirs = own.select("dir").distinct()
    owner = nearest_ancestor(dirs, caps.select(F.col("capsule_dir").alias("dir"))).filter("owner is not null").withColumnRenamed("owner", "capsule_dir")
    placed = owner.join(scopes(owner, contracts), ["capsule_dir", "dir"]).join(caps, "capsule_dir")
    rows = own.join(placed, "dir").withColumn("rel", F.expr("substring(abs, length(capsule_dir) + 2)"))
    return rows.filter(scannable(F.col("rel"), F.col("lang"))).select("capsule_dir", "capsule_id", "lang", "abs", "rel", "scope", "content")


def in_walk_order(rows: DataFrame, by: str = "abs") -> DataFrame:
    """Adds walk: the position in a walk by name, directory by directory."""
    return rows.withColumn("walk", F.array_join(F.transform(F.split(by, "/"), lambda s: F.concat(s, F.lit("\x01"))), ""))
