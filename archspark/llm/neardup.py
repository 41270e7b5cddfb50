"""MinHash near-dedup from bottom-k sketches under one hash function.

A document's set is its distinct word shingles (64-bit hashes); its sketch, the SKETCH
smallest. Documents with equal sets form a class and go on as one. Inverted lists of the
retained values give overlaps:

1. Each list's members meet the list's first member (a star, not all pairs); those with
   several common lists are estimated, verified, and joined into components.
2. In lists of up to CAP members, members of different components meet; the number of
   lists in common is the overlap of their sketches. Below what a similarity of the
   threshold leaves (five standard deviations), a pair is dropped.
3. What meets in longer lists only has at least that overlap in long lists alone, so only
   documents with so many values in long lists are left. They go through an exact prefix
   filter: their shingles are ordered by rarity, and a pair of the threshold must share one
   among the rarest n - ceil(threshold * n) + 1. Prefix lists again make stars first (around
   the most central member) and then pairs across components, if at the shingle they share
   both have enough left to reach the threshold.

Pairs of each step pass the union-sketch estimate and are verified on full sets. Every pair
that reaches the threshold is a candidate of rounds 1 to 3 unless it is in one component by
then, so components are whole but for the estimate: of a pair at the very threshold it
loses 7 in a million (14 or fewer of 32 values in common where 25.6 are expected), of pairs
above it fewer, and a component only if no other link holds it.

Null and empty texts have no set: they stand alone and are kept. A text with fewer words
than a shingle has one shingle, all of it. Of a class the smallest doc_id stands for it;
rows with a repeated doc_id are one document, kept each. A null doc_id is linked with
nothing and kept, its component_id is null. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import map_rows
from .common import join_counted, settle, table
from .graph import components

SHINGLE, PERCENT = 5, 80
SKETCH, CAP, STAR_LISTS = 32, 64, 3
#: Least share of a sketch in common, five standard deviations below the threshold's.
LEAST_OVERLAP = 0.8 - 5 * (0.8 * 0.2 / SKETCH) ** 0.5
#: Counters of the order by rarity: any order is exact, a better one prunes more.
RARITY = 1 << 16
#: Document ids that may be broadcast to pick texts for verification; more are joined by shuffle.
BROADCAST_IDS = 200_000

_BASE = 0x9E3779B97F4A7C15
#: Bytes of a text that are hashed at once, up to the next white space; a word of that length stands by its digest.
CHUNK = 1 << 19
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    n = 1 << bits
    with np.errstate(over="ignore"):
        return tuple(np.concatenate(([np.uint64(1)], np.full(n, b, np.uint64))).cumprod(dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; words are cut at ASCII white space, A-Z lower-cased."""
    data = (text or "").encode().lower()
    out, before, at = [], [], 0
    while at < len(data):
        space = _SPACE.search(data, at + CHUNK)
        stop = space.start() if space else len(data)
        words = before + [w if len(w) < CHUNK else hashlib.blake2b(w).digest() for w in data[at:stop].split()]
        if len(words) >= size:
            out.append(_hashes(words, size))
            words = words[len(words) - size + 1 :]
        before, at = words, stop
    if not out and before:
        out = [_hashes(before, len(before))]
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def _hashes(words: list[bytes], k: int) -> np.ndarray:
    """The hash of every k words that stand together."""
    raw = np.frombuffer(b" ".join(words), np.uint8).astype(np.uint64) + np.uint64(1)
    up, down = _powers(max(12, len(raw).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(raw * up[: len(raw)], dtype=np.uint64)))
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        first, last = starts[: len(words) - k + 1], ends[k - 1 :]
        h = (sums[last] - sums[first]) * down[first]
        # An even spread of the polynomial's values (splitmix64).
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


def _sketcher(size: int) -> Callable[..., Iterator[tuple]]:
    def row(doc_id, text) -> Iterator[tuple]:
        own = shingles(text, size)
        yield doc_id, len(own), hashlib.blake2b(own.tobytes(), digest_size=16).hexdigest() if len(own) else None, own[:SKETCH].view(np.int64).tolist()

    return row


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n, set_hash (null without words), sketch: the smallest values in unsigned order."""
    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, n long, set_hash string, sketch array<long>", lambda: _sketcher(size))


def _verifier(size: int, percent: int) -> Callable[..., Iterator[tuple]]:
    last: list = [None, None]

    def row(a, b, text_a, text_b) -> Iterator[tuple]:
        if last[0] != b:
            last[:] = b, shingles(text_b, size)
        x, y = shingles(text_a, size), last[1]
        if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
            return
        common = len(np.intersect1d(x, y, assume_unique=True))
        if 100 * common >= percent * (len(x) + len(y) - common):
            yield a, b

    return row


def _estimated(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose union sketch and sizes leave room for the threshold."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    rows = pairs.join(side("a"), "a").filter("true").join(side("b"), "b")
    rows = rows.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    # The bottom of the union, in unsigned order.
    unsigned = lambda c: F.transform(c, lambda x: x.bitwiseXOR(F.lit(-(1 << 63))))
    bottom = F.slice(F.array_sort(F.array_union(unsigned("s_a"), unsigned("s_b"))), 1, SKETCH)
    common = F.size(F.array_intersect(F.array_intersect(bottom, unsigned("s_a")), unsigned("s_b")))
    return rows.filter(common >= LEAST_OVERLAP * F.size(bottom)).select("a", "b")


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) that reach the threshold on their full sets."""
    pairs = settle(_estimated(pairs, reps, percent), "near-pairs")
    ids = settle(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "near-ids")
    # Repeated rows of an id: any one of them, the same in all rounds.
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    texts = texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")
    texts = settle(texts.groupBy("id").agg(F.min("text").alias("text")), "near-texts")
    rows = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    rows = rows.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return settle(map_rows(rows.select("a", "b", "text_a", "text_b"), "a long, b long", lambda: _verifier(size, percent)), "near-edges")


def _stars(members: DataFrame, least: int) -> DataFrame:
    """key, rep, leader -> pairs (a, b) with `least` keys in common."""
    return members.filter("rep <> leader").groupBy(F.col("rep").alias("a"), F.col("leader").alias("b")).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= least).select("a", "b")


def _with_components(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))


def _rarity(texts: DataFrame, size: int) -> np.ndarray:
    """Counts of the texts' shingles by hash bucket: RARITY numbers, whatever the input."""

    def maker() -> Callable[..., Iterator[tuple]]:
        def row(text) -> Iterator[tuple]:
            bucket, n = np.unique((shingles(text, size) % np.uint64(RARITY)).astype(np.int64), return_counts=True)
            yield bucket.tolist(), n.tolist()

        return row

    rows = map_rows(texts.select("text"), "bucket array<long>, n array<long>", maker)
    counts = np.zeros(RARITY, np.int64)
    for bucket, n in rows.select(F.explode(F.arrays_zip("bucket", "n")).alias("x")).groupBy("x.bucket").agg(F.sum("x.n").alias("n")).collect():  # RARITY rows at most
        counts[bucket] = n
    return counts


def _prefixes(texts: DataFrame, counts: np.ndarray, size: int, percent: int) -> DataFrame:
    """rep, n, central (how common its shingles are), keys: the prefix of its shingles, rarest first."""

    def maker() -> Callable[..., Iterator[tuple]]:
        def row(rep, text) -> Iterator[tuple]:
            own = shingles(text, size)
            freq = counts[(own % np.uint64(RARITY)).astype(np.int64)]
            order = np.lexsort((own, freq))
            take = len(own) - -(-percent * len(own) // 100) + 1
            yield rep, len(own), float(np.log(np.maximum(freq, 1)).mean()) if len(own) else 0.0, own[order[:take]].view(np.int64).tolist()

        return row

    return map_rows(texts.select("rep", "text"), "rep long, n long, central double, keys array<long>", maker)


def near_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    known = settle(sketches(docs, size), "near-sketches")
    reps = settle(known.filter("set_hash is not null and doc_id is not null").groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("n", "sketch"), "doc_id").alias("own")).select("set_hash", "rep", "own.n", "own.sketch"), "near-reps")
    values = reps.select("rep", F.size("sketch").alias("width"), F.explode("sketch").alias("value"))
    lists = settle(values.groupBy("value").agg(F.count(F.lit(1)).alias("s"), F.min("rep").alias("leader")).filter("s > 1"), "near-values")
    members = settle(join_counted(values, lists, "value", "s"), "near-lists")
    # Round 1: stars of all lists.
    edges = _verified(_stars(members, STAR_LISTS), reps, docs, size, percent)
    comps = components(edges)
    # Round 2: across components in short lists. What a pair has in common in long lists can't be more than either has there.
    long_values = members.filter(F.col("s") > CAP).groupBy("rep").agg(F.count(F.lit(1)).alias("longs"))
    short = _with_components(members.filter(F.col("s") <= CAP).join(long_values, "rep", "left").withColumn("longs", F.coalesce("longs", F.lit(0))), comps)
    side = lambda x: short.select("value", F.col("rep").alias(x), F.col("comp").alias(f"comp_{x}"), F.col("longs").alias(f"longs_{x}"), F.col("width").alias(f"width_{x}"))
    met = side("a").join(side("b"), "value").filter("a > b and comp_a <> comp_b")
    met = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.first(F.least("longs_a", "longs_b")).alias("longs"), F.first(F.least("width_a", "width_b")).alias("width"))
    pairs = met.filter(F.col("c") + F.col("longs") >= LEAST_OVERLAP * F.col("width")).select("a", "b")
    # Round 3's stars go with it.
    dense = settle(long_values.join(reps.select("rep", F.size("sketch").alias("width")), "rep").filter(F.col("longs") >= LEAST_OVERLAP * F.col("width")).select("rep"), "near-dense")
    prefixes = None
    if not dense.isEmpty():
        texts = docs.join(dense.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi").groupBy(F.col("doc_id").alias("rep")).agg(F.min("text").alias("text"))
        texts = settle(texts, "near-dense-texts")
        keyed = settle(_prefixes(texts, _rarity(texts, size), size, percent), "near-prefixes")
        keys = keyed.select("rep", "n", "central", F.posexplode("keys").alias("pos", "value"))
        led = keys.groupBy("value").agg(F.count(F.lit(1)).alias("s"), F.max_by("rep", F.struct("central", "rep")).alias("leader")).filter("s > 1")
        prefixes = settle(join_counted(keys, settle(led, "near-prefix-values"), "value", "s"), "near-prefix-lists")
        pairs = pairs.union(_stars(prefixes, 1)).distinct()
    more = _verified(pairs, reps, docs, size, percent)
    edges = edges.union(more)
    comps = components(edges)
    if prefixes is not None:
        rest = _with_components(prefixes, comps)
        largest = rest.groupBy("value", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("value").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
        rest = rest.join(largest, "value")
        side = lambda x: rest.select("value", F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("pos").alias(f"pos_{x}"), F.col("comp").alias(f"comp_{x}"), (F.col("comp") == F.col("main")).alias(f"main_{x}"))
        # At a pair's first common shingle no more can be in common than what either has from there on.
        # Later ones may fail this; the first one never does for a pair that reaches the threshold.
        room = (100 + percent) * F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= percent * (F.col("n_a") + F.col("n_b"))
        room &= 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
        cross = side("a").filter("not main_a").join(side("b"), "value").filter(room & F.expr("comp_a <> comp_b and (main_b or a > b)")).select("a", "b").distinct()
        edges = edges.union(_verified(cross, reps, docs, size, percent))
        comps = components(edges)
    classes = reps.select("set_hash", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("set_hash", F.coalesce("comp", "rep").alias("comp"))
    out = known.join(classes, "set_hash", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), size=4)


def oracle(size: int = 4, percent: int = PERCENT) -> str:
    words = ", ' ', ".join(f"w[i + {j}]" for j in range(size))
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < {size} THEN array_to_string(w, ' ') ELSE concat({words}) END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {size - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= {percent} * (p.n + q.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT m.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""
