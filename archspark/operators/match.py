"""Owners of paths and nearest ancestors.

A path belongs to the node with the most specific glob that matches it, file globs before
directory globs, the smallest id among equals. Nodes without `*` other than a trailing
`/**` are found by hash joins on the path and its ancestors; only the others meet every
path, as patterns in a broadcast join. Contracts are small; what is broadcast is counted
first, and beyond the bound the pairs are made by a shuffled join on the first segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import globs, paths

#: Nodes that may be broadcast (some 200 bytes each).
BROADCAST_NODES = 50_000


def with_patterns(nodes: DataFrame) -> DataFrame:
    """Adds regex, is_file_glob and specificity to (contract, node_id, glob)."""
    return nodes.withColumns({"regex": globs.glob_regex("glob"), "is_file_glob": paths.is_file_glob("glob"), "specificity": globs.specificity("glob")})


def _best(candidates: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("is_file_glob").desc(), F.col("specificity").desc(), F.col("node_id").asc())
    return candidates.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def _candidates(at: DataFrame, nodes: DataFrame) -> DataFrame:
    """(contract, path) x nodes of that contract whose globs may match, file globs on the path, directory globs on its key."""
    wanted = at.withColumn("key", paths.node_key("path"))
    return wanted.join(nodes, "contract").filter(globs.owns(F.when(F.col("is_file_glob"), F.col("path")).otherwise(F.col("key")), "regex", "glob"))


def match_nodes_theta(at: DataFrame, nodes: DataFrame) -> DataFrame:
    """(contract, path) -> (contract, path, node_id), null where no node owns the path. Every path meets every node of its contract."""
    at = at.select("contract", "path").distinct()
    best = _best(_candidates(at, F.broadcast(with_patterns(nodes))), ["contract", "path"])
    return at.join(best.select("contract", "path", "node_id"), ["contract", "path"], "left")


def match_nodes(at: DataFrame, nodes: DataFrame) -> DataFrame:
    """The same by hash joins for literal and prefix globs."""
    at = at.select("contract", "path").distinct()
    kinds = with_patterns(nodes).withColumn("stem", F.regexp_replace("glob", r"/\*\*$", ""))
    literal = ~F.contains(F.col("stem"), F.lit("*")) & ~F.col("glob").isin("", ".")
    literals, patterns = kinds.filter(literal), kinds.filter(~literal)
    small = kinds.count() <= BROADCAST_NODES
    side = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    wanted = at.withColumn("key", paths.node_key("path"))
    # A file glob is a path; a directory glob is the key or, with /**, also one of the directories above.
    up = F.transform(F.sequence(F.lit(1), F.size(F.split("key", "/"))), lambda k: F.struct(F.array_join(F.slice(F.split("key", "/"), 1, k), "/").alias("stem"), (k == F.size(F.split("key", "/"))).alias("whole"), F.lit(False).alias("file")))
    probes = wanted.select("contract", "path", F.explode(F.concat(up, F.array(F.struct(F.col("path").alias("stem"), F.lit(True).alias("whole"), F.lit(True).alias("file"))))).alias("p")).select("contract", "path", "p.*")
    probes = probes.filter((F.col("path") != ".") & (F.col("file") | (F.col("stem") != ".")))
    hit = probes.join(side(literals), ["contract", "stem"]).filter((F.col("file") == F.col("is_file_glob")) & (F.col("whole") | F.endswith(F.col("glob"), F.lit("/**"))))
    columns = ["contract", "path", "node_id", "is_file_glob", "specificity"]
    every = hit.select(columns).unionByName(_candidates(at, side(patterns)).select(columns))
    best = every.groupBy("contract", "path").agg(F.max_by("node_id", F.struct("is_file_glob", "specificity", _descending("node_id"))).alias("node_id"))
    return at.join(best, ["contract", "path"], "left")


def _descending(column: str) -> Column:
    """Bytes in reverse order, so that the greatest is the smallest id; the end ranks above any byte."""
    return F.concat(F.translate(F.hex(F.encode(column, "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))


def nearest_ancestor(at: DataFrame, dirs: DataFrame, bound: str | None = None) -> DataFrame:
    """(dir) -> (dir, owner): the nearest directory of dirs at or above it, not above the column `bound` if given.

    Directories are few beside files: give distinct ones. An equi-join on exploded ancestors.
    """
    at = at.distinct()
    chain = at.withColumn("owner", F.explode(F.concat(F.array("dir"), paths.ancestors("dir"))))
    if bound:
        chain = chain.filter((F.col("owner") == F.col(bound)) | F.startswith(F.col("owner"), F.concat(F.when(F.col(bound) == "/", F.lit("")).otherwise(F.col(bound)), F.lit("/"))))
    found = chain.join(dirs.select(F.col("dir").alias("owner")).distinct(), "owner")
    best = found.groupBy(*at.columns).agg(F.max_by("owner", F.length("owner")).alias("owner"))
    return at.join(best, at.columns, "left")
