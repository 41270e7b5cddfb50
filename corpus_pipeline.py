"""A corpus pipeline of five operators: language ID, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next one's docs. Stages decide by row, told by its doc_id and text (language
ID: by all columns), so rows that share an id, or have none, stay or go each by itself;
equal rows go together. All stages but the last return the columns of documents; further
columns of docs, whatever their names, travel along.

Null and empty texts have no language and go first. Long texts are read whole. An empty
table of documents gives no rows at any stage; an empty benchmark takes nothing out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archspark.llm import decontaminate, langid, lines, mixing, neardup
from archspark.llm.common import settle, table

#: Rejected rows whose keys may be broadcast; more are taken out by a shuffled join.
BROADCAST_IDS = 500_000
#: A benchmark item of fewer tokens doesn't take out the documents that hold it.
LEAST_MATCHED = 5


def _without(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """The rows of docs whose key isn't among gone (one column of numbers)."""
    gone = settle(gone.toDF("gone").distinct(), "pipeline-gone")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"))
    return rows.join(side, rows["key"] == side["gone"], "left_anti").select("row.*")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with enough confidence stay."""
    key = F.xxhash64("doc_id", "text", "lang", "source")
    rows = docs.select(key.alias("doc_id"), "text", "lang", "source")
    return _without(docs, key, langid.identify(langid.documents_as_rows(rows)).filter(~F.col("kept")).select("id"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line repeats go, and documents that had no others."""
    gone = lines.surplus(docs.select("doc_id", "text"))
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("sid")).join(gone, "sid", "left")
    rows = rows.withColumn("rest", F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(lines.without("row.text", "gone")))
    rows = rows.filter("gone is null or trim(translate(rest, '\n', ' ')) <> ''")
    now = {"text": F.col("rest"), "n_chars": F.length("rest").cast("long")}
    return rows.select(*[now.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five-word shingles, similarity 0.8) the one with the smallest doc_id stays, of equal ids the smallest key."""
    key = F.xxhash64("doc_id", "text")
    found = neardup.near_components(docs.select(key.alias("doc_id"), "text")).filter("not kept")
    found = settle(found.select(F.col("doc_id").alias("key"), F.col("component_id").alias("class")).distinct(), "pipeline-copies")
    # The operator keeps the smallest key; it stands in its class too.
    members = found.union(found.select("class", "class").distinct())
    ids = docs.select(key.alias("key"), F.col("doc_id").alias("id")).distinct()
    heads = ids.join(members, "key").groupBy("class").agg(F.min(F.struct("id", "key")).alias("head")).select("head.key")
    return _without(docs, key, members.select("key").join(heads, "key", "left_anti"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap an item of the benchmark go."""
    hit = decontaminate.overlapping_rows(docs, table(spark, sf_dir, "benchmark")).filter(F.col("matched") >= LEAST_MATCHED)
    return _without(docs, decontaminate.row_key(), hit.select("sid"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: doc_id, source, copy, shard, words, order_key, one row for each copy taken."""
    return mixing.mix(docs)


STAGES = [
    ("language ID", keep_languages),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_documents),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
]

#: Language ID can't be expressed in SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
