"""What is wrong with a contract, as rows: contract, rule, message, line."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import globs, paths
from ..functions.text import contract_message, quoted
from ..sources.shared import cut


def _rows(found: DataFrame, rule: str, message: Column, line: str = "line") -> DataFrame:
    return found.select("contract", F.lit(rule).alias("rule"), contract_message(message, F.col("contract"), F.col(line)).alias("message"), F.col(line).alias("line"))


def _placed(found: DataFrame, rule: str, message: Column) -> DataFrame:
    """Messages that name their place themselves."""
    return found.select("contract", F.lit(rule).alias("rule"), message.alias("message"), "line")


def _reference(text: Column) -> Column:
    return F.concat(F.col("node_id"), F.lit(" ("), F.col("contract"), F.lit(":"), F.col("line").cast("string"), F.lit(") references "), F.col("glob"), F.lit(" — "), text)


def empty_globs(nodes: DataFrame) -> DataFrame:
    return _rows(nodes.filter("glob = ''"), "empty-node-glob", F.concat(F.lit("node "), quoted("node_id"), F.lit(" has empty glob")))


def undefined_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each end of an edge that is no node."""
    ends = edges.select("contract", F.col("src").alias("node_id"), "line").unionByName(edges.select("contract", F.col("dst").alias("node_id"), "line"))
    return _rows(ends.join(nodes.select("contract", "node_id"), ["contract", "node_id"], "left_anti"), "undefined-edge-node", F.concat(F.lit("edge references undefined node "), quoted("node_id")))


def duplicate_globs(nodes: DataFrame) -> DataFrame:
    """Globs of several nodes; the line is the second's by id."""
    found = nodes.groupBy("contract", "glob").agg(F.array_sort(F.collect_list(F.struct("node_id", "line"))).alias("n")).filter(F.size("n") > 1).withColumn("line", F.col("n")[1]["line"])
    names = F.array_join(F.transform("n", lambda x: x["node_id"]), ", ")
    return _rows(found, "duplicate-node-glob", F.concat(F.lit("glob "), quoted("glob"), F.lit(" claimed by multiple nodes: "), names))


def invalid_globs(nodes: DataFrame) -> DataFrame:
    """One row for each segment that begins with `..`."""
    bad = nodes.select("*", F.explode(F.filter(F.split("glob", "/"), lambda s: F.startswith(s, F.lit("..")))).alias("segment"))
    return _placed(bad, "invalid-node-glob", _reference(F.lit('".." not allowed in node globs')))


def file_globs(nodes: DataFrame, contracts: DataFrame) -> DataFrame:
    """File globs in contracts (contract, file_globs) of languages without them."""
    found = nodes.join(contracts.filter(~F.col("file_globs")).select("contract").distinct(), "contract", "left_semi").filter(paths.is_file_glob("glob"))
    return _placed(found, "file-glob-unsupported", _reference(F.lit("file-shaped nodes require a language that supports file globs")))


def overlapping(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Pairs of directory globs that some file's directory matches both of; files: contract, rel, walk (their order).

    Pairs are made within a contract and kept where the globs may meet; the witness is the
    first file. Each contract's directories are distinct before they meet the pairs.
    """
    dirs = nodes.filter(~paths.is_file_glob("glob")).select("contract", "node_id", "glob", "line")
    a, b = (dirs.select("contract", *[F.col(c).alias(f"{c}_{x}") for c in ("node_id", "glob", "line")]) for x in "ab")
    pairs = a.join(b, "contract").filter((F.col("node_id_a") < F.col("node_id_b")) & (F.col("glob_a") != F.col("glob_b")) & globs.overlap("glob_a", "glob_b"))
    pairs = pairs.withColumns({f"regex_{x}": globs.glob_regex(f"glob_{x}") for x in "ab"})
    keys = files.withColumn("key", paths.node_key("rel")).groupBy("contract", "key").agg(F.min(F.struct("walk", "rel")).alias("first"))
    met = pairs.join(keys, "contract").filter(globs.owns("key", "regex_a", "glob_a") & globs.owns("key", "regex_b", "glob_b"))
    found = met.groupBy("contract", "node_id_a", "node_id_b", "line_a", "line_b").agg(F.min("first")["rel"].alias("witness"))
    one = lambda x: F.concat(F.lit("node "), quoted(f"node_id_{x}"), F.lit(" ("), F.col("contract"), F.lit(":"), F.col(f"line_{x}").cast("string"), F.lit(")"))
    return found.select("contract", F.lit("node-overlap").alias("rule"), F.concat(one("a"), F.lit(" and "), one("b"), F.lit(" overlap — file "), F.col("witness"), F.lit(" matches both globs")).alias("message"), F.col("line_a").alias("line"))


def _depth_first(part: pd.DataFrame) -> Iterator[tuple[str, int]]:
    """Every edge back into the current path closes a cycle; nodes and neighbours in order."""
    line_of = {(r.src, r.dst): int(r.line) for r in part.itertuples() if r.dst is not None}
    after: dict[str, list[str]] = {}
    nodes = sorted(set(part["src"]))
    known, seen = set(nodes), set()
    for src, dst in sorted(line_of):
        if dst in known:
            after.setdefault(src, []).append(dst)
    done: set[str] = set()
    for root in nodes:
        if root in done:
            continue
        path, place, todo = [root], {root: 0}, [iter(after.get(root, ()))]
        while todo:
            dst = next(todo[-1], None)
            if dst is None:
                todo.pop()
                done.add(last := path.pop())
                del place[last]
            elif dst in place:
                text = " → ".join([*path[place[dst] :], dst])
                if text not in seen:
                    seen.add(text)
                    yield text, line_of[path[-1], dst]
            elif dst not in done:
                place[dst] = len(path)
                path.append(dst)
                todo.append(iter(after.get(dst, ())))


def cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each closing edge. A contract is one small group; edges to no node don't count."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(part["contract"].iloc[0], f"circular dependency: {text}", line) for text, line in _depth_first(part)], columns=["contract", "text", "line"])

    rows = nodes.select("contract", F.col("node_id").alias("src")).join(edges.select("contract", "src", "dst", "line"), ["contract", "src"], "left")
    return _rows(rows.groupBy("contract").applyInPandas(run, "contract string, text string, line int"), "circular-dependency", F.col("text"))


def validate(nodes: DataFrame, edges: DataFrame, files: DataFrame, contracts: DataFrame) -> DataFrame:
    """All rules; contracts: contract, file_globs (whether its language has them)."""
    out = empty_globs(nodes)
    for more in (undefined_ends(nodes, edges), cycles(nodes, edges), duplicate_globs(nodes), invalid_globs(nodes), overlapping(nodes, files), file_globs(nodes, contracts)):
        out = out.unionByName(more)
    return out
