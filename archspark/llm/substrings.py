"""Removal of repeated byte strings by column-wise suffix sorting.

Every byte goes that a string of LENGTH bytes covers which also starts anywhere else.

Inserting one symbol per document each round into the Burrows-Wheeler transform of whole
documents takes as many rounds as the longest document has bytes, each over files of the
whole collection. Here the columns are bounded: each window of LENGTH bytes has an anchor,
its smallest hash of GRAM bytes (the first of equals), a function of the window's bytes
alone. Equal windows hence have equal anchors at the same place, and a document's windows
fall into runs with one anchor each. Runs that are equal as a whole are found by count.
The different runs of an anchor are laid over each other at the anchor and sorted column
by column from the right: a round inserts one symbol of each run, updates the order of
their suffixes (a stable sort by symbol, as in the positional transform) and the common
prefix of neighbours (the least one between them, plus one). Where a window's suffix has
LENGTH bytes in common with a neighbour, it is repeated.

Runs of one anchor are sorted in one task up to GROUP different ones; beyond that, their
windows are counted by hash, which spreads over all tasks and is as exact.

Null text is empty. Texts shorter than LENGTH lose nothing. Rows are told apart by doc_id
and text; a repeated row repeats its own strings, which then go in both. A null doc_id is
a value like others. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import map_rows, slices
from .common import join_counted, settle, table
from .neardup import _powers

LENGTH, GRAM = 200, 32
#: Different runs of one anchor that are sorted in one task (1 KB each), and runs in one sort.
GROUP, BATCH = 50_000, 8192
#: Documents whose ids may be broadcast to pick texts; more are joined by shuffle.
BROADCAST_IDS = 500_000
#: Bytes in one search for anchors; positions take 20 bits of a key.
CHUNK = 1 << 20


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def grams(raw: bytes) -> np.ndarray:
    """The hash of the GRAM bytes from each position on."""
    words = np.ndarray(len(raw) - 7, "<u8", raw, 0, (1,))
    n = len(raw) - GRAM + 1
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(0, GRAM, 8):
            h = (h ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
    return _mixed(h)


def runs(raw: bytes) -> tuple[np.ndarray, ...]:
    """lo, hi (first and last window start), at (the anchor's place), anchor, key (the run's bytes and shape)."""
    empty = np.empty(0, np.int64)
    if len(raw) < LENGTH:
        return empty, empty, empty, empty, empty
    out = []
    for start in range(0, len(raw) - LENGTH + 1, CHUNK - LENGTH + 1):
        part = raw[start : start + CHUNK]
        h = grams(part)
        low = np.uint64(CHUNK - 1)
        least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        width, want = 1, LENGTH - GRAM + 1
        while 2 * width <= want:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < want:
            least = np.minimum(least[: width - want], least[want - width :])
        at = (least & low).astype(np.int64)
        lo = np.flatnonzero(np.diff(at, prepend=-1))
        hi = np.append(lo[1:], len(at)) - 1
        at = at[lo]
        up, down = _powers(max(12, len(part).bit_length()))
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((np.frombuffer(part, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(part)], dtype=np.uint64)))
            key = (sums[hi + LENGTH] - sums[lo]) * down[lo]
            key = _mixed(_mixed(key) + ((hi - lo) * 512 + (at - lo)).astype(np.uint64) * np.uint64(0x94D049BB133111EB))
        out.append((lo + start, hi + start, at + start, h[at].view(np.int64), key.view(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _all_runs(docs: DataFrame) -> DataFrame:
    """sid, lo, hi, at, anchor, key of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["sid", "lo", "hi", "at", "anchor", "key"]
        for batch in batches:
            for part in slices(batch):
                found = [(sid, *runs((text or "").encode())) for sid, text in zip(part.column("sid").to_pylist(), part.column("text").to_pylist(), strict=True)]
                sid = np.repeat(np.array([x[0] for x in found], np.int64), [len(x[1]) for x in found])
                lo, hi, at, anchor, key = (np.concatenate([x[i] for x in found]) for i in range(1, 6))
                yield pa.RecordBatch.from_arrays([pa.array(sid), *(pa.array(c.astype(np.int32)) for c in (lo, hi, at)), pa.array(anchor), pa.array(key)], names=names)

    return docs.select("sid", "text").mapInArrow(run, "sid long, lo int, hi int, at int, anchor long, key long")


def column_sort(group: np.ndarray, symbols: np.ndarray, first: int) -> np.ndarray:
    """Which windows are repeated in their group, by row and start column (0 to first).

    symbols: (rows, columns), 256 where a row has none; group: each row's, ascending.
    """
    rows, columns = symbols.shape
    order, common = np.arange(rows), np.zeros(rows + 1, np.int16)
    repeated = np.zeros((rows, first + 1), bool)
    for column in range(columns - 1, -1, -1):
        code = group[order] * 512 + symbols[order, column]
        perm = np.argsort(code, kind="stable")
        code, order = code[perm], order[perm]
        same = np.flatnonzero((code[1:] == code[:-1]) & (code[1:] % 512 != 256)) + 1
        between = np.stack((perm[same - 1] + 1, perm[same] + 1), 1).reshape(-1)
        least = np.minimum.reduceat(common, between)[::2] if len(same) else common[:0]
        common = np.zeros(rows + 1, np.int16)
        common[same] = least + 1
        if column <= first:
            long = common >= LENGTH
            repeated[order[long[:-1] | long[1:]], column] = True
    return repeated


def _sorted_runs(rows: DataFrame) -> DataFrame:
    """anchor, sid, lo, at, bytes, all of an anchor together -> sid, start, stop of what is repeated."""

    def flush(part: list[tuple]) -> pa.RecordBatch:
        before = LENGTH - GRAM  # columns left of the anchor
        symbols = np.full((len(part), before + LENGTH), 256, np.int64)
        _, group = np.unique(np.array([x[0] for x in part]), return_inverse=True)
        for i, (_, _, lo, at, raw) in enumerate(part):
            symbols[i, before + lo - at : before + lo - at + len(raw)] = np.frombuffer(raw, np.uint8)
        hit = column_sort(group, symbols, before)
        edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, a = np.nonzero(edge == 1)
        _, b = np.nonzero(edge == -1)
        sid, at = np.array([x[1] for x in part], np.int64)[row], np.array([x[3] for x in part])[row]
        return pa.RecordBatch.from_arrays([pa.array(sid), pa.array((at - before + a).astype(np.int32)), pa.array((at - before + b - 1 + LENGTH).astype(np.int32))], names=["sid", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[tuple] = []
        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(part) >= BATCH and x[0] != part[-1][0]:
                    yield flush(part)
                    part = []
                part.append(x)
        if part:
            yield flush(sorted(part, key=lambda x: x[0]))

    return rows.select("anchor", "sid", "lo", "at", "bytes").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "sid long, start int, stop int")


def _hashed_windows(rows: DataFrame) -> DataFrame:
    """The same for rows of any number: windows by the hash of their bytes."""

    def maker():
        def row(sid, lo, raw) -> Iterator[tuple]:
            up, down = _powers(12)
            with np.errstate(over="ignore"):
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)))
                n = len(raw) - LENGTH + 1
                h = _mixed((sums[LENGTH:] - sums[:n]) * down[:n]).view(np.int64)
            yield from ((sid, lo + i, x) for i, x in enumerate(h.tolist()))

        return row

    windows = settle(map_rows(rows.select("sid", "lo", "bytes"), "sid long, start int, h long", maker), "sub-windows")
    often = windows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    return windows.join(often, "h", "left_semi").select("sid", "start", (F.col("start") + LENGTH).alias("stop"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """sid, text -> sid, start, stop: byte spans, overlapping as they come, whose union is what is repeated."""
    every = settle(_all_runs(docs), "sub-every")
    # Anchors that occur more than once; where all their runs are equal, that settles them.
    anchors = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least"), F.max("key").alias("most")).filter("n > 1").select("anchor", "n", (F.col("least") == F.col("most")).alias("equal"))
    found = settle(join_counted(every, settle(anchors, "sub-anchors"), "anchor", "n").drop("n"), "sub-runs")
    whole = lambda rows: rows.select("sid", F.col("lo").alias("start"), (F.col("hi") + LENGTH).alias("stop"))
    mixed = found.filter("not equal")
    kinds = settle(mixed.groupBy("anchor", "key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("sid", "lo", "hi", "at")).alias("one")), "sub-kinds")
    spans = whole(found.filter("equal")).union(whole(mixed.join(kinds.filter("n > 1").select("anchor", "key"), ["anchor", "key"], "left_semi")))
    # One run of each kind, with its bytes.
    own = kinds.select("anchor", "one.*").groupBy("sid").agg(F.collect_list(F.struct("anchor", "lo", "hi", "at")).alias("own"))
    ids = settle(own, "sub-own")
    texts = docs.join(F.broadcast(ids.select("sid")) if ids.count() <= BROADCAST_IDS else ids.select("sid"), "sid", "left_semi").dropDuplicates(["sid"])

    def maker():
        def row(sid, text, own) -> Iterator[tuple]:
            raw = text.encode()
            yield from ((x["anchor"], sid, x["lo"], x["at"], raw[x["lo"] : x["hi"] + LENGTH]) for x in own)

        return row

    pieces = settle(map_rows(texts.join(ids, "sid").select("sid", "text", "own"), "anchor long, sid long, lo int, at int, bytes binary", maker), "sub-pieces")
    crowded = settle(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > GROUP).select("anchor"), "sub-crowded")
    if crowded.isEmpty():
        return spans.union(_sorted_runs(pieces))
    return spans.union(_sorted_runs(pieces.join(crowded, "anchor", "left_anti"))).union(_hashed_windows(pieces.join(crowded, "anchor", "left_semi")))


def _cut():
    def row(doc_id, text, spans) -> Iterator[tuple]:
        raw = (text or "").encode()
        if not spans:
            yield doc_id, len(raw), [], raw
            return
        step = np.zeros(len(raw) + 1, np.int32)
        np.add.at(step, [x["start"] for x in spans], 1)
        np.add.at(step, [x["stop"] for x in spans], -1)
        gone = np.cumsum(step[:-1]) > 0
        edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist()
        yield doc_id, len(raw), [{"start": a, "stop": b} for a, b in zip(edge[::2], edge[1::2], strict=True)], np.frombuffer(raw, np.uint8)[~gone].tobytes()

    return row


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, n_bytes, removed (maximal byte spans), kept (the remaining bytes, which may cut characters); one row for each row."""
    docs = docs.select(F.col("doc_id").cast("long"), "text").withColumn("sid", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(docs.filter(F.octet_length("text") >= LENGTH))
    by_doc = spans.groupBy("sid").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    return map_rows(docs.join(by_doc, "sid", "left").select("doc_id", "text", "spans"), "doc_id long, n_bytes long, removed array<struct<start: long, stop: long>>, kept binary", _cut)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = remove_repeats(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
