"""Benchmark decontamination by spaced-seed hashing.

Fixed masks choose some of the tokens of a window and ignore the others, so a window with
a substitution at an ignored place keeps its hash. Hashes of all windows of the training
texts meet those of the benchmark items in a broadcast join (in blocks of a stated size,
so that what is broadcast is bounded whatever the benchmark's size). Only the first hit of
a run on a diagonal (training position minus item position) goes on. The tokens aligned
with the item are then compared one by one: a match counts 1, a substitution -PENALTY, and
the best stretch must reach MIN_SCORE. All of it stays in the JVM, and the training side is
never shuffled before it has been reduced to hits.

Tokens are runs of ASCII letters and digits and of other scripts' characters, in lower case. Null and empty texts have none and
are never hits. Items of fewer than MIN_SCORE tokens must occur as a whole; for those
shorter than the masks their whole length is the mask. Equal items are found each. A row is
told by its doc_id and text, an item by its item_id and text: rows that share an id, null or
not, are searched each, and the best overlap of an id's rows with an id's items is returned.
Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, settle, table

#: 1: compared, 0: ignored. Any stretch that reaches MIN_SCORE with PENALTY has one of them on
#: matches only, however long it is and wherever its substitutions stand (tests/llm walks all
#: such stretches): no overlap is lost to the seeds. Other scores need other masks.
MASKS = ("111111", "11010111", "101100111", "110110101")
MIN_SCORE, PENALTY = 10, 2
#: Most benchmark windows in one broadcast (some 50 bytes each), and most items.
BLOCK_ROWS, BROADCAST_ITEMS = 1_000_000, 20_000

TOKEN_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def tokens(text: str = "text") -> Column:
    """The 64-bit hash of each token: what is compared and carried from here on.

    The lambda functions also keep this projection out of the generated loop over
    positions, which would split the text again at each.
    """
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), TOKEN_GAP)
    return F.transform(F.filter(words, lambda x: x != ""), lambda x: F.xxhash64(x))


def _seed(words: str, at: str, mask: str) -> str:
    """SQL for the hash of the mask's tokens from position `at` on; null beyond the end or before the start."""
    chosen = ", ".join(f"get({words}, {at} + {i})" for i, c in enumerate(mask) if c == "1")
    return f"if({at} >= 0 and {at} + {len(mask)} <= size({words}), xxhash64('{mask}', {chosen}), null)"


def _all_masks(items: DataFrame, masks: tuple[str, ...]) -> list[tuple[str, str]]:
    """(mask, condition on the item): the masks, and for items too short for them a mask of their whole length."""
    span = min(map(len, masks))
    short = [r[0] for r in items.filter(f"size(item) < {span}").select(F.size("item")).distinct().collect()]  # fewer than span values
    return [(m, f"size(item) >= {len(m)}") for m in masks] + [("1" * n, f"size(item) = {n}") for n in sorted(short)]


def hits(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """sid, doc_id, iid, item_id, diagonal, stretch (the document's tokens beside the item), skipped (the item's tokens before it)."""
    return _hits(docs, items_of(benchmark), masks)


def items_of(benchmark: DataFrame) -> DataFrame:
    """iid, item_id, item (its tokens)."""
    items = benchmark.select("item_id", tokens().alias("item")).filter(F.size("item") > 0).distinct()
    return settle(items.select(F.xxhash64("item_id", "item").alias("iid"), "item_id", "item"), "bench-items")


def row_key() -> Column:
    """What tells a row of documents."""
    return F.xxhash64("doc_id", "text")


def _hits(docs: DataFrame, items: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    chosen = _all_masks(items, masks)
    least = min(len(m) for m, _ in chosen)
    rows = items.withColumn("item_at", F.explode(F.sequence(F.lit(0), F.size("item") - least)))
    seeds = F.expr("array(" + ", ".join(f"named_struct('mask', {i}, 'h', if({cond}, {_seed('item', 'item_at', m)}, null), 'before', {_seed('item', '(item_at - 1)', m)})" for i, (m, cond) in enumerate(chosen)) + ")")
    rows = settle(rows.select("iid", "item_id", "item_at", F.size("item").alias("item_len"), F.explode(seeds).alias("s")).select("iid", "item_id", "item_at", "item_len", "s.*").filter("h is not null"), "bench-seeds")
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    windows = docs.select("doc_id", row_key().alias("sid"), tokens().alias("words")).withColumn("at", F.explode(F.expr(f"if(size(words) >= {least}, sequence(0, size(words) - {least}), null)")))
    windows = windows.withColumn("h", F.explode(F.expr("array(" + ", ".join(_seed("words", "at", m) for m, _ in chosen) + ")")))
    before = "case mask " + " ".join(f"when {i} then {_seed('words', '(at - 1)', m)}" for i, (m, _) in enumerate(chosen)) + " end"
    out = None
    for k in range(blocks):
        part = windows.join(F.broadcast(rows.filter(F.pmod("h", F.lit(blocks)) == k)), "h").filter(f"before is null or not (before <=> {before})")
        out = part if out is None else out.unionByName(part)
    out = out.withColumn("diagonal", F.col("at") - F.col("item_at"))
    return out.select("sid", "doc_id", "iid", "item_id", "diagonal", F.expr("slice(words, greatest(diagonal, 0) + 1, item_len + least(diagonal, 0))").alias("stretch"), F.expr("greatest(-diagonal, 0)").alias("skipped"), "item_len")


def overlapping_rows(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, min_score: int = MIN_SCORE, penalty: int = PENALTY) -> DataFrame:
    """sid (row_key), doc_id, item_id, score, matched, first_token, last_token: the best stretch of each row, item and diagonal."""
    items = items_of(benchmark)
    # A row's hits on a diagonal all hold the same stretch.
    found = _hits(docs, items, masks).groupBy("sid", "doc_id", "iid", "item_id", "diagonal").agg(F.first("stretch").alias("stretch"), F.first("skipped").alias("skipped"))
    found = found.join(broadcast_if_small(items.select("iid", "item"), items.count(), BROADCAST_ITEMS), "iid")
    best = f"""aggregate(sequence(0, size(stretch) - 1),
        named_struct('run', 0, 'ok', 0, 'from', 0, 'score', 0, 'matched', 0, 'first', -1, 'last', -1),
        (a, i) -> with_step(a, i), a -> a)"""
    hit = "(get(stretch, i) <=> get(item, i + skipped))"
    run = f"if({hit}, greatest(a.run, 0) + 1, greatest(a.run, 0) - {penalty})"
    ok = f"if(a.run <= 0, 0, a.ok) + if({hit}, 1, 0)"
    start = "if(a.run <= 0, i, a.from)"
    step = f"named_struct('run', {run}, 'ok', {ok}, 'from', {start}, 'score', greatest(a.score, {run}), 'matched', if({run} > a.score, {ok}, a.matched), 'first', if({run} > a.score, {start}, a.first), 'last', if({run} > a.score, i, a.last))"
    scored = found.filter("size(stretch) > 0").withColumn("best", F.expr(best.replace("with_step(a, i)", step)))
    # A short item must occur as a whole.
    enough = F.col("best.score") >= F.least(F.lit(min_score), F.size("item"))
    offset = F.greatest("diagonal", F.lit(0))
    return scored.filter(enough).select("sid", "doc_id", "item_id", "best.score", "best.matched", (F.col("best.first") + offset).alias("first_token"), (F.col("best.last") + offset).alias("last_token"))


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, min_score: int = MIN_SCORE, penalty: int = PENALTY) -> DataFrame:
    """One row for each document and item that overlap: doc_id, item_id, score, matched, first_token, last_token (in the document).

    Of equal scores on one diagonal the first end counts, of diagonals the smallest start.
    """
    rows = overlapping_rows(docs, benchmark, masks, min_score, penalty)
    top = F.max(F.struct("score", (-F.col("first_token")).alias("early"), "matched", "last_token")).alias("top")
    return rows.groupBy("doc_id", "item_id").agg(top).select("doc_id", "item_id", "top.score", "top.matched", (-F.col("top.early")).alias("first_token"), "top.last_token")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# Masks of whole items, by which those shorter than the others are found, are numbered from 100.
_WHOLE = range(1, min(map(len, MASKS)))
_WINDOW_SQL = " UNION ALL ".join(
    f"SELECT {{id}}, pos, {k} AS mask, concat_ws(' ', {', '.join(f't[pos + {i + 1}]' for i, c in enumerate(m) if c == '1')}) AS h FROM (SELECT {{id}}, t, unnest(range(0, len(t) - {len(m) - 1})) AS pos FROM {{rel}} WHERE len(t) >= {len(m)} {only})"
    for k, m, only in [(k, m, "") for k, m in enumerate(MASKS)] + [(100 + n, "1" * n, f"AND {n} IN (SELECT len(t) FROM b) {{whole}}") for n in _WHOLE]
)

ORACLE = rf"""
WITH d AS (
  SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS t FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS t FROM benchmark),
dw AS ({_WINDOW_SQL.format(id="doc_id", rel="d", whole="")}),
bw AS (SELECT * FROM ({_WINDOW_SQL.format(id="item_id", rel="b", whole="")}) w WHERE mask < 100 OR mask - 100 = (SELECT len(t) FROM b WHERE b.item_id = w.item_id)),
g AS (
  SELECT DISTINCT dw.doc_id, bw.item_id, dw.pos - bw.pos AS diagonal FROM dw JOIN bw ON dw.h = bw.h AND dw.mask = bw.mask),
al AS (
  SELECT g.doc_id, g.item_id, g.diagonal, p.i AS pos, CASE WHEN d.t[p.i + 1] = b.t[p.i - g.diagonal + 1] THEN 1 ELSE 0 END AS ok
  FROM g JOIN d USING (doc_id) JOIN b USING (item_id), LATERAL (SELECT unnest(range(greatest(g.diagonal, 0), least(len(d.t), len(b.t) + g.diagonal))) AS i) p),
cs AS (
  SELECT *, sum(CASE WHEN ok = 1 THEN 1 ELSE -{PENALTY} END) OVER w AS c, sum(ok) OVER w AS oks FROM al
  WINDOW w AS (PARTITION BY doc_id, item_id, diagonal ORDER BY pos ROWS UNBOUNDED PRECEDING)),
lo AS (
  SELECT *, least(0, coalesce(min(c) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM cs),
en AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY c - low DESC, pos) AS n FROM lo),
st AS (
  SELECT en.doc_id, en.item_id, en.diagonal, en.c - en.low AS score, en.pos AS last_token, en.oks,
         coalesce(max(cs.pos), any_value(greatest(en.diagonal, 0) - 1)) AS before_first
  FROM en LEFT JOIN cs ON cs.doc_id = en.doc_id AND cs.item_id = en.item_id AND cs.diagonal = en.diagonal AND cs.pos < en.pos AND cs.c = en.low
  WHERE en.n = 1 GROUP BY en.doc_id, en.item_id, en.diagonal, en.c, en.low, en.pos, en.oks),
z AS (
  SELECT st.*, st.oks - coalesce(cs.oks, 0) AS matched FROM st LEFT JOIN cs ON cs.doc_id = st.doc_id AND cs.item_id = st.item_id AND cs.diagonal = st.diagonal AND cs.pos = st.before_first
  WHERE score >= least({MIN_SCORE}, (SELECT len(t) FROM b WHERE b.item_id = st.item_id)))
SELECT doc_id, item_id, CAST(score AS INTEGER) AS score, CAST(matched AS INTEGER) AS matched, CAST(before_first + 1 AS INTEGER) AS first_token, CAST(last_token AS INTEGER) AS last_token
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY score DESC, before_first, matched DESC, last_token DESC) AS k FROM z) WHERE k = 1
"""
