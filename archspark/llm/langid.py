"""Language ID by Bayesian fusion of evidence.

For a text, the likelihood under each language comes from hashed byte trigrams counted
over the documents that declare the language (one pass; FOLDS x LANGUAGES x BUCKETS sums,
whatever the input's size). Texts fall into FOLDS by their hash and a text is scored by
what the other folds hold, so neither its own declaration nor that of its copies speaks
through its text as well. Its weight is held to EVIDENCE trigrams, as neighbouring
trigrams say the same. With it go P(declared language | language), from how texts and declarations
agree over the whole table, and a prior for the host, smoothed by the address suffix it
ends with, which is smoothed by all rows; both come from grouped sums. `und` competes as
the even distribution over buckets.

Null and empty texts, and texts without letters, are `und` and not kept. A null or unknown
declaration says nothing; a null host has the prior of all rows. Rows are independent but
for the sums; repeated rows count as often as they occur. Of equally likely languages the
first in the order of LANGUAGES is returned, `und` last. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import slices
from .common import broadcast_if_small, settle, small_batches, table

LANGUAGES, UNKNOWN = ("de", "en", "es", "fr"), "und"
BUCKETS, EVIDENCE, SMOOTH, FOLDS = 1 << 14, 40, 0.5, 4
SUFFIX_WEIGHT, HOST_WEIGHT, DECLARED_WEIGHT, UNKNOWN_PRIOR, MIN_CONFIDENCE = 20.0, 10.0, 10.0, 1e-3, 0.5
#: Hosts whose priors may be broadcast (some 100 bytes each); above, they are joined by shuffle.
BROADCAST_HOSTS = 100_000

#: Letters in lower case and all bytes of other scripts; the rest becomes a space.
_LETTERS = bytes((b + 32 if 65 <= b <= 90 else b) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram of all texts, -1 where it holds no letter or ends in the next text; each text's offset."""
    if not texts:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    raw = [b" " + (t or "").encode().translate(_LETTERS) + b"  " for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    b = np.frombuffer(b"".join(raw), np.uint8).astype(np.int32)
    code = ((b[:-2] * 131 + b[1:-1]) * 131 + b[2:]) % BUCKETS
    code[(b[:-2] == 32) & (b[1:-1] == 32) | (b[1:-1] == 32) & (b[2:] == 32)] = -1
    code = np.append(code, [-1, -1]).astype(np.int32)
    for back in (1, 2):
        code[offsets[1:] - back] = -1
    return code, offsets[:-1]


def declared_language(column: Column) -> Column:
    """The primary subtag, if it is one of LANGUAGES."""
    tag = F.regexp_extract(F.lower(F.trim(column)), r"^([a-z]+)", 1)
    return F.when(tag.isin(*LANGUAGES), tag)


def markup_language(html: Column) -> Column:
    """The lang attribute of the html element."""
    return F.nullif(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z0-9-]+)", 1), F.lit(""))


def url_host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1)), F.lit(""))


def pages_as_rows(pages: DataFrame) -> DataFrame:
    """page_id, url, html -> id, text, declared, host for identify()."""
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    return pages.select(F.col("page_id").alias("id"), text.alias("text"), markup_language(F.col("html")).alias("declared"), url_host(F.col("url")).alias("host"))


def documents_as_rows(docs: DataFrame) -> DataFrame:
    """A document's source stands for its host."""
    return docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"))


def fold_of(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int")


def train(rows: DataFrame) -> np.ndarray:
    """(FOLDS, languages + 1, BUCKETS) log probabilities from the texts of other folds, the last row of each the even distribution."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((FOLDS * len(LANGUAGES), BUCKETS), np.int64)
        for batch in batches:
            for part in slices(batch):
                texts, kind = part.column("text").to_pylist(), part.column("k").to_numpy()
                for k in np.unique(kind):
                    code, _ = trigrams([texts[i] for i in np.flatnonzero(kind == k)])
                    sums[k] += np.bincount(code[code >= 0], minlength=BUCKETS)
        k, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(sums[k, bucket])], names=["k", "bucket", "n"])

    language = F.array_position(F.array(*map(F.lit, LANGUAGES)), declared_language(F.col("declared"))).cast("int") - 1
    known = rows.select("text", (fold_of(F.col("text")) * len(LANGUAGES) + language).alias("k")).filter("k is not null and text is not null")
    own = np.zeros((FOLDS, len(LANGUAGES), BUCKETS))
    with small_batches(rows.sparkSession):
        counted = known.mapInArrow(count, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toPandas()  # FOLDS x LANGUAGES x BUCKETS rows at most
    own.reshape(-1, BUCKETS)[counted["k"], counted["bucket"]] = counted["n"]
    sums = own.sum(0) - own + SMOOTH
    model = np.log(sums / sums.sum(2, keepdims=True))
    return np.concatenate([model, np.full((FOLDS, 1, BUCKETS), -np.log(BUCKETS))], 1).astype(np.float32)


def likelihoods(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """id, declared, host, n (trigrams), score (for each language and und, null without a trigram)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folds, kinds, _ = model.shape
        table = np.zeros((folds, BUCKETS + 1, kinds), np.float32)  # the last of each for -1
        table[:, :BUCKETS] = model.transpose(0, 2, 1)
        table = table.reshape(-1, kinds)
        for batch in batches:
            for part in slices(batch):
                code, offsets = trigrams(part.column("text").to_pylist())
                n = np.add.reduceat((code >= 0).astype(np.int64), offsets)
                # Each text looks up its fold's rows.
                code[code < 0] = BUCKETS
                code += np.repeat(part.column("fold").to_numpy() * (BUCKETS + 1), np.diff(np.append(offsets, len(code)))).astype(np.int32)
                total = np.stack([np.add.reduceat(np.take(table[:, k], code).astype(np.float64), offsets) for k in range(kinds)], 1)
                score = total * (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None]
                lists = pa.array([s if m else None for s, m in zip(score.tolist(), n.tolist(), strict=True)], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("declared"), part.column("host"), pa.array(n), lists], names=["id", "declared", "host", "n", "score"])

    rows = rows.select(F.col("id").cast("long"), "text", fold_of(F.col("text")).alias("fold"), declared_language(F.col("declared")).alias("declared"), F.lower("host").alias("host"))
    return rows.mapInArrow(run, "id long, declared string, host string, n long, score array<double>")


def identify(rows: DataFrame) -> DataFrame:
    """id, text, declared, host -> id, declared, language, confidence, text_language, kept; one row for each row."""
    k = len(LANGUAGES)
    names = F.array(*map(F.lit, (*LANGUAGES, UNKNOWN)))
    scored = likelihoods(rows, train(rows)).withColumn("suffix", F.regexp_extract(F.coalesce("host", F.lit("")), r"\.([^.:]+)(:\d+)?$", 1))
    best = F.element_at(names, F.array_position("score", F.array_max("score")).cast("int"))
    scored = settle(scored.withColumn("text_language", F.coalesce(best, F.lit(UNKNOWN))), "langid-scores")
    sums = settle(scored.filter(F.col("text_language") != UNKNOWN).groupBy("host", "suffix", "declared", "text_language").agg(F.count(F.lit(1)).alias("n")), "langid-sums")
    by = lambda *keys: sums.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("text_language") == x, F.col("n"))), F.lit(0)).cast("double").alias(f"n_{x}") for x in LANGUAGES])
    share = lambda weight, prior: [((F.col(f"n_{x}") + weight * p) / (sum(F.col(f"n_{y}") for y in LANGUAGES) + weight)) for x, p in zip(LANGUAGES, prior, strict=True)]
    counts = lambda frame: F.array(*[F.col(f"n_{x}") for x in LANGUAGES])
    whole = by().select(F.array(*share(float(k), [F.lit(1 / k)] * k)).alias("p_all"))  # one row
    suffixes = by("suffix").crossJoin(F.broadcast(whole)).select("suffix", F.array(*share(SUFFIX_WEIGHT, [F.col("p_all")[i] for i in range(k)])).alias("p_suffix"))
    hosts = by("host", "suffix").filter("host is not null").join(suffixes, "suffix").select("host", F.array(*share(HOST_WEIGHT, [F.col("p_suffix")[i] for i in range(k)])).alias("p_host"))
    hosts = settle(hosts, "langid-hosts")
    # P(declared | language) for each declaration: LANGUAGES x LANGUAGES values.
    agree = by("declared").filter("declared is not null")
    sum_of = by().select(counts(None).alias("of"))
    agree = agree.crossJoin(F.broadcast(sum_of)).select("declared", F.array(*[(F.col(f"n_{x}") + F.when(F.col("declared") == x, DECLARED_WEIGHT).otherwise(1.0)) / (F.col("of")[i] + DECLARED_WEIGHT + k - 1) for i, x in enumerate(LANGUAGES)]).alias("p_declared"))
    out = scored.join(broadcast_if_small(hosts, hosts.count(), BROADCAST_HOSTS), "host", "left").join(F.broadcast(agree), "declared", "left").crossJoin(F.broadcast(whole))
    log_of = lambda i: F.col("score")[i] + F.log(F.coalesce(F.col("p_host")[i], F.col("p_all")[i])) + F.log(F.coalesce(F.col("p_declared")[i], F.lit(1 / k)))
    out = out.withColumn("log", F.array(*map(log_of, range(k)), F.col("score")[k] + float(np.log(UNKNOWN_PRIOR / k))))
    top = F.array_max("log")
    sure = 1 / F.aggregate("log", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    out = out.withColumn("language", F.when(F.col("score").isNull(), UNKNOWN).otherwise(F.element_at(names, F.array_position("log", top).cast("int"))))
    out = out.withColumn("confidence", F.round(F.when(F.col("score").isNull(), 1.0).otherwise(sure), 6))
    kept = (F.col("language") != UNKNOWN) & (F.col("confidence") >= MIN_CONFIDENCE)
    return out.select("id", "declared", "language", "confidence", "text_language", kept.alias("kept"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents_as_rows(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op10_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, by the declaration in their markup and the host and address suffix of their URL."""
    return identify(pages_as_rows(table(spark, sf_dir, "pages"))).withColumnRenamed("id", "page_id")
