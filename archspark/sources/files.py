"""Source trees as rows: a data source that walks directories, overlays, ignore layers, visibility."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import paths
from ..languages import base_ignore_lines
from ..operators import ignore
from ..schema import FILES, IGNORE_FILES


class _Tree(DataSourceReader):
    """Directories are listed from the top down until there are PARTS of them, then dealt out."""

    PARTS, BATCH_BYTES = 256, 16 << 20

    def __init__(self, root: str) -> None:
        self.root = os.path.abspath(root)

    def partitions(self) -> list[InputPartition]:
        """Of (directory, whether what lies below its directories belongs to it, too)."""
        done, level = [], [self.root]
        while level and len(done) + len(level) < self.PARTS:
            done += [(d, False) for d in level]
            level = [e.path for d in level for e in _entries(d) if _descend(e)]
        every = done + [(d, True) for d in level]
        return [InputPartition(every[k :: self.PARTS]) for k in range(min(self.PARTS, len(every)))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        """Batches of files until their contents reach BATCH_BYTES."""
        schema = pa.schema([("abs", pa.string()), ("is_dir", pa.bool_()), ("content", pa.binary())])
        rows, size = [], 0
        for row in self._rows(partition.value):
            rows.append(row)
            size += len(row[0]) + len(row[2] or b"")
            if size >= self.BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)

    @staticmethod
    def _rows(at: list[tuple[str, bool]]) -> Iterator[tuple[str, bool, bytes | None]]:
        todo = list(at)
        while todo:
            top, whole = todo.pop()
            for e in _entries(top):
                if not e.is_dir():
                    yield e.path, False, _content(e.path)
                    continue
                yield e.path, True, None
                if whole and _descend(e):
                    todo.append((e.path, True))


def _entries(path: str) -> list[os.DirEntry]:
    """None where a directory is missing or can't be listed."""
    try:
        with os.scandir(path) as found:
            return sorted(found, key=lambda e: e.name)
    except OSError:
        return []


def _descend(e: os.DirEntry) -> bool:
    """Links to directories are entries, but what lies behind them isn't."""
    return e.is_dir() and not e.is_symlink()


def _content(path: str) -> bytes | None:
    """Null where a file can't be read."""
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        return None


class TreeSource(DataSource):
    """spark.read.format("archtree").load(root): abs, is_dir, content; names with a leading dot or underscore included."""

    @classmethod
    def name(cls) -> str:
        return "archtree"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return _Tree(self.options["path"])


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """The root must be a path that every executor sees."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("archtree").load(root)


def from_rows(spark: SparkSession, contents: dict[str, str | bytes | None]) -> DataFrame:
    """A tree from absolute paths and contents, none for files that can't be read; directories follow from the paths."""
    dirs = {p for path in contents for p in _above(path)}
    rows = [(d, True, None) for d in sorted(dirs)] + [(p, False, c.encode() if isinstance(c, str) else c) for p, c in sorted(contents.items())]
    return spark.createDataFrame(rows, FILES)


def _above(path: str) -> list[str]:
    parts = path.split("/")
    return ["/".join(parts[:k]) for k in range(2, len(parts))]


def overlay_rows(payload: DataFrame) -> DataFrame:
    """(json) {"files": [{"path", "content"}]} -> abs, content; of a repeated clean path the last counts."""
    rows = payload.select(F.posexplode(F.from_json("json", "files array<struct<path: string, content: string>>")["files"]).alias("ord", "f"))
    rows = rows.select("ord", paths.clean("f.path").alias("abs"), F.col("f.content").alias("content"))
    return rows.groupBy("abs").agg(F.max_by("content", "ord").alias("content"))


def overlay(files: DataFrame, over: DataFrame) -> DataFrame:
    """Contents of `over` (abs, content) take the place of the files', or are added with the directories they need."""
    o = over.select("abs", F.col("content").cast("binary").alias("new"))
    merged = files.join(o, "abs", "full_outer").select("abs", F.coalesce("is_dir", F.lit(False)).alias("is_dir"), F.coalesce("new", "content").alias("content"))
    dirs = over.select(F.explode(paths.ancestors("abs")).alias("abs")).filter("abs <> '/'").distinct().select("abs", F.lit(True).alias("is_dir"), F.lit(None).cast("binary").alias("content"))
    return merged.unionByName(dirs.join(merged.select("abs"), "abs", "left_anti"))


def ignore_rules(files: DataFrame, root: str, names: tuple[str, ...] = IGNORE_FILES) -> DataFrame:
    """layer, ordinal, domain, regex, inclusion, from the base names, the directories above root within its repository, and those at and below it.

    Domains are absolute directories. Without a repository (no .git at or above root) only the base layer applies.
    """
    spark = files.sparkSession
    up = [root, *reversed(_above(root + "/x"))]
    up = sorted({*up, root}, key=len, reverse=True)
    git = files.filter(F.col("abs").isin(*[f"{d}/.git" for d in up])).select(F.max(F.length(paths.dirname("abs"))).alias("n")).first()["n"]
    top = next((d for d in up if len(d) == git), None)
    base = spark.createDataFrame([(0, i, root, *_compiled(line)) for i, line in enumerate(base_ignore_lines())], "layer int, ordinal long, domain string, regex string, inclusion boolean")
    if top is None:
        return base
    rank = F.array_position(F.array(*map(F.lit, names)), paths.basename("abs")) - 1
    own = files.filter(~F.col("is_dir") & paths.basename("abs").isin(*names)).select(paths.dirname("abs").alias("dir"), rank.alias("rank"), "content")
    inside = (F.col("dir") == root) | F.startswith(F.col("dir"), F.lit(f"{root}/"))
    above = F.col("dir").isin(*[d for d in up if len(top) <= len(d) < len(root)] or [""])
    rows = ignore.lines(own.filter(inside | above)).withColumn("layer", F.when(inside, 2).otherwise(1))
    # From the top down, a directory's files in the order of names, lines in order; pre-order below the root.
    order = Window.partitionBy("layer").orderBy(F.split("dir", "/"), "rank", "line_no")
    compiled = F.udf(lambda line: _compiled(line), "regex string, inclusion boolean", useArrow=True)  # rules are few beside files
    return base.unionByName(rows.withColumn("c", compiled("line")).select("layer", F.row_number().over(order).cast("long").alias("ordinal"), F.col("dir").alias("domain"), "c.regex", "c.inclusion"))


def _compiled(line: str) -> tuple[str, bool]:
    regex, _, inclusion = ignore.rule_regex(line)
    return regex, inclusion


def visible(files: DataFrame, root: str, names: tuple[str, ...] = IGNORE_FILES) -> DataFrame:
    """What a walk from root sees: rules by layer, an ignored directory hiding all below it. What lies outside root stays as it is."""
    rules = ignore_rules(files, root, names)
    inside = files.filter(F.startswith(F.col("abs"), F.lit(f"{root}/")))
    at = inside.select(F.ltrim(F.col("abs"), F.lit("/")).alias("path"), "is_dir")
    found = ignore.verdicts(at, rules.withColumn("domain", F.when(F.col("domain") == "/", ".").otherwise(F.ltrim(F.col("domain"), F.lit("/")))))
    seen = ignore.prune(found).select(F.concat(F.lit("/"), "path").alias("abs"))
    return inside.join(seen, "abs", "left_semi").unionByName(files.filter(~F.startswith(F.col("abs"), F.lit(f"{root}/"))))


def empty_dirs(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Directories without a visible entry: targets there don't count; anything else does, missing files included."""
    dirs = seen.filter("is_dir").select("abs")
    parents = seen.select(paths.dirname("abs").alias("abs")).distinct()
    return dirs.join(parents, "abs", "left_anti")
