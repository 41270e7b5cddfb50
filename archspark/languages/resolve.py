"""Where an import leads, relative to its capsule; null if outside it. Columns throughout.

TypeScript also asks which files exist: aliases of the configuration and endings are joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from .registry import KOTLIN_PREFIXES


def _none() -> Column:
    return F.lit(None).cast("string")


def _after(text: Column, prefix: Column) -> Column:
    return F.substring(text, F.length(prefix) + 1, F.length(text))


def go(spec: Column, capsule_id: Column) -> Column:
    prefix = F.concat(capsule_id, F.lit("/"))
    return F.when(F.startswith(spec, prefix), _after(spec, prefix))


def _inside(base: Column, spec: Column) -> Column:
    return paths.let(paths.join(base, spec), lambda full: F.when(~paths.escapes(full), full))


def dart(spec: Column, capsule_id: Column, rel: Column) -> Column:
    own = F.concat(F.lit("package:"), capsule_id, F.lit("/"))
    return F.when(F.startswith(spec, F.lit("dart:")), _none()).when(F.startswith(spec, own), paths.join(F.lit("lib"), _after(spec, own))).when(F.startswith(spec, F.lit("package:")), _none()).otherwise(_inside(paths.dirname(rel), spec))


def kotlin(spec: Column, capsule_id: Column, rel: Column) -> Column:
    """The class stays in the path."""
    prefix = F.regexp_extract(rel, "^(" + "|".join(KOTLIN_PREFIXES) + ")/", 1)
    base = F.concat(F.when(prefix == "", F.lit("src/main/kotlin")).otherwise(prefix), F.lit("/"), F.replace(spec, F.lit("."), F.lit("/")))
    own = (spec == capsule_id) | (F.startswith(spec, F.concat(capsule_id, F.lit("."))) & (F.length(spec) > F.length(capsule_id) + 1) & ~F.endswith(spec, F.lit(".")))
    return F.when((F.coalesce(capsule_id, F.lit("")) != "") & own, base)


def rust(spec: Column, capsule_id: Column, rel: Column) -> Column:
    """The last item of a path is a name, not a place; a bare name is a sibling."""
    at = F.length(spec) - F.instr(F.reverse(spec), " sa ") - 2  # of the last " as ", from 1
    whole = F.when(F.contains(spec, F.lit(" as ")), F.trim(F.substring(spec, F.lit(1), at - 1))).otherwise(spec)
    return paths.let(F.struct(whole.alias("bare"), paths.dirname(rel).alias("here"), capsule_id.alias("id")), _rust)


def _rust(x: Column) -> Column:
    bare, here, capsule_id = x["bare"], x["here"], x["id"]

    def place(base: Column, rest: Column) -> Column:
        parts = F.split(rest, "::")
        return F.concat_ws("/", base, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"))

    def under(base: Column, rest: Column) -> Column:
        return F.when(F.contains(rest, F.lit("::")), place(base, rest)).otherwise(base)

    supers = F.regexp_extract(bare, "^((super::)+)", 1)
    dirs = F.split(here, "/")
    # Each further super goes up one directory, but never above the first.
    up = F.array_join(F.slice(dirs, 1, F.greatest(F.lit(1), F.size(dirs) - (F.length(supers) / 7).cast("int") + 1)), "/")
    above = F.when(up == ".", F.lit("src")).otherwise(up)
    tail = lambda prefix: _after(bare, prefix)
    own = F.concat(capsule_id, F.lit("::"))
    return (
        F.when(F.startswith(bare, F.lit("crate::")), under(F.lit("src"), tail(F.lit("crate::"))))
        .when(supers != "", F.when(F.contains(tail(supers), F.lit("::")), paths.clean(place(above, tail(supers)))).otherwise(above))
        .when(F.startswith(bare, F.lit("self::")), F.when(F.contains(tail(F.lit("self::")), F.lit("::")), paths.clean(place(here, tail(F.lit("self::"))))).otherwise(here))
        .when(F.startswith(bare, own), under(F.lit("src"), tail(own)))
        .when(F.contains(bare, F.lit("::")), _none())
        .otherwise(paths.join(here, bare))
    )


def typescript_name(spec: Column, capsule_id: Column) -> Column:
    prefix = F.concat(capsule_id, F.lit("/"))
    rest = F.regexp_replace(_after(spec, prefix), "^/", "")
    return F.when((F.coalesce(capsule_id, F.lit("")) != "") & F.startswith(spec, prefix) & (rest != ""), paths.join(F.lit("src"), rest))


def typescript_aliases(specs: DataFrame, aliases: DataFrame, existing: DataFrame) -> DataFrame:
    """(capsule_dir, spec) with (capsule_dir, pattern, replacements, base_url) -> (capsule_dir, spec, target).

    Of the patterns that fit, the one with the longest text before its `*` counts, then by
    text; of its replacements the first that exists, else the first.
    """
    a = aliases.withColumns({"head": F.substring_index("pattern", "*", 1), "wild": F.contains(F.col("pattern"), F.lit("*")), "tail": F.expr("if(contains(pattern, '*'), substring(pattern, instr(pattern, '*') + 1), '')")})
    fits = F.when(F.col("wild"), F.startswith(F.col("spec"), F.col("head")) & F.endswith(F.col("spec"), F.col("tail")) & (F.length("spec") >= F.length("head") + F.length("tail"))).otherwise(F.col("spec") == F.col("pattern"))
    rows = specs.select("capsule_dir", "spec").distinct().join(a, "capsule_dir").filter(fits)
    best = rows.withColumn("r", F.row_number().over(Window.partitionBy("capsule_dir", "spec").orderBy(F.length("head").desc(), "pattern"))).filter("r = 1")
    taken = F.expr("substring(spec, length(head) + 1, length(spec) - length(head) - length(tail))")
    each = best.select("capsule_dir", "spec", "base_url", taken.alias("taken"), "wild", F.posexplode("replacements").alias("ord", "replacement"))
    filled = F.when(F.col("wild"), F.replace(F.col("replacement"), F.lit("*"), F.col("taken"))).otherwise(F.col("replacement"))
    based = F.when(F.coalesce(F.col("base_url"), F.lit("")) == "", filled).otherwise(paths.join(F.col("base_url"), filled))
    each = each.withColumn("target", F.replace(based, F.lit("${configDir}"), F.col("capsule_dir")))
    each = each.withColumn("abs", paths.join(F.col("capsule_dir"), F.col("target")))
    found = each.join(existing.select("abs", F.lit(True).alias("there")).distinct(), "abs", "left")
    return found.groupBy("capsule_dir", "spec").agg(F.min_by("target", F.struct(F.col("there").isNull(), "ord")).alias("target"))


def typescript_endings(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """(capsule_dir, target) -> (capsule_dir, target, file): the existing file a target without or with a JavaScript ending means, else itself."""
    t, base = F.col("target"), paths.basename("target")
    js = F.rlike(t, F.lit(r"\.([mc]?js|jsx)$"))
    twin = F.concat(F.regexp_replace(t, r"\.([mc]?)js(x?)$", ".$1ts$2"))
    tries = F.when(F.rlike(t, F.lit(r"\.tsx?$")), F.array(t)).when(js, F.array(t, twin)).when(F.contains(base, F.lit(".")), F.array(t))
    tries = tries.otherwise(F.array(*[F.concat(t, F.lit(x)) for x in (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")]))
    each = rows.select("capsule_dir", "target").distinct().select("capsule_dir", "target", F.posexplode(tries).alias("ord", "file"))
    each = each.withColumn("abs", paths.join(F.col("capsule_dir"), F.col("file"))).join(existing.select("abs", F.lit(True).alias("there")).distinct(), "abs", "left")
    best = each.groupBy("capsule_dir", "target").agg(F.min_by(F.struct("file"), F.when(F.col("there"), F.col("ord"))).alias("hit"))
    return best.select("capsule_dir", "target", F.coalesce("hit.file", "target").alias("file"))
