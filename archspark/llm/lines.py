"""Line dedup by a segment-partition edit join.

Lines of FUZZY or more characters that are within MAX_EDITS edits of each other, and equal
lines of LEAST or more, form classes (connected components); each class keeps its first
line in the order of doc_id and line number. A line of length l is split into
MAX_EDITS + 1 segments, one of which any line within the edits must hold unchanged. The
hashes of (l, segment number, segment) are the index; a line of length n probes it for
l = n to n - MAX_EDITS, with substrings only at those places where a match can begin that
leaves enough edits on either side. Candidates must keep enough of twice as many blocks
unchanged and are verified with banded bit-parallel edit distance (a band of
2 * MAX_EDITS + 1 bits along the diagonal, one step a character).

With one edit, a key whose lines could make more than FEW pairs (a template's, say) is
split again: what stands beside the segment is cut into PARTS windows, one of which holds
the edit, and the key of a window is that of all else. Windows go on as long as they have
that many lines, up to LAST characters; there candidates are taken in proportion to lines:
all forms of the window with one character left out. Lines that agree in the form and the
place of the gap differ by a substitution, and a line equal to another's form by an
insertion: each group is joined as a star. All ways are exact, and their candidates are
verified alike. With more edits all pairs of a key are candidates.

A line's id is a 64-bit hash of it. Blank lines and lines shorter than LEAST (without outer
spaces) always stay. Null text has no lines and stays null; empty text has one, blank.
Repeated rows count as one document. A null doc_id comes first. Empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, settle, table
from .graph import components

MAX_EDITS, FUZZY, LEAST, FEW = 1, 24, 16, 16
#: Windows that a crowded key's is cut into, and the longest that isn't cut further (PARTS - 1 at least: none is empty).
PARTS, LAST = 4, 8
#: Documents whose ids may be broadcast to pick candidate lines; more are joined by shuffle.
BROADCAST_IDS = 500_000


def segments(length: str, k: int) -> list[tuple[str, str]]:
    """SQL for (offset, size) of the k + 1 segments of a line of that length."""
    cut = lambda i: f"({length} * {i} div {k + 1})"
    return [(cut(i), f"({cut(i + 1)} - {cut(i)})") for i in range(k + 1)]


def _key(length: str, i: int, part: str) -> str:
    return f"xxhash64({length}, {i}, {part})"


def index_keys(k: int) -> Column:
    """Of `line` with length n: (key, at, size) for each segment."""
    return F.expr("array(" + ", ".join(f"named_struct('key', {_key('n', i, f'substring(line, cast({at} + 1 as int), cast({size} as int))')}, 'at', cast({at} as int), 'size', cast({size} as int))" for i, (at, size) in enumerate(segments("n", k))) + ")")


def probe_keys(k: int) -> Column:
    """Of `line` with length n: (key, at, size) that match index keys of lines up to k shorter, the index's own places for equal length left out."""
    out = []
    for less in range(k + 1):
        length = f"(n - {less})"
        for i, (at, size) in enumerate(segments(length, k)):
            for shift in range(max(-i, less - (k - i)), min(i, less + (k - i)) + 1):
                if less or shift:
                    place = f"cast({at} + {shift} as int)"
                    out.append(f"if({place} >= 0 and {place} + {size} <= n, named_struct('key', {_key(length, i, f'substring(line, {place} + 1, cast({size} as int))')}, 'at', {place}, 'size', cast({size} as int)), null)")
    return F.filter(F.expr("array(" + ", ".join(out) + ")"), lambda x: x.isNotNull())


def within(k: int, one: str = "line_a", other: str = "line_b") -> Column:
    """Whether two lines are within k edits: the vertical differences of a band of the table, as bits, along the diagonal."""
    width = 2 * k + 1
    full, top = (1 << width) - 1, 2 * k
    match = " | ".join(f"if(get(p, j - {k} + {b}) <=> c, {1 << b}L, 0L)" for b in range(width))
    # p: the longer line's characters, t: the other's; the highest bit stands for p[j + k].
    d0 = "(((((x & a.vp) + a.vp) ^ a.vp) | x | a.vn) & {full})"
    hp = "(a.vn | ({full} & ~(d0 | a.vp)))"
    hn = "(d0 & a.vp)"
    step = f"""aggregate(sequence(0, size(t) - 1), named_struct('vp', {full & ~((1 << k) - 1)}L, 'vn', 0L, 'd', {k}),
        (a, j) -> transform(array({match.replace('c,', 't[j],')}), x -> transform(array({d0}), d0 -> transform(array(named_struct('hp', {hp}, 'hn', {hn})), h ->
            named_struct('vp', h.hn | ({full} & ~(shiftright(d0, 1) | h.hp)), 'vn', shiftright(d0, 1) & h.hp,
                'd', a.d + if(j < size(p) - {k}, if((d0 & {1 << top}L) = 0, 1, 0),
                    if((h.hp & shiftleft(1L, greatest(0, {top - 1} - (j - size(p) + {k})))) <> 0, 1, 0) - if((h.hn & shiftleft(1L, greatest(0, {top - 1} - (j - size(p) + {k})))) <> 0, 1, 0))))[0])[0])[0],
        a -> a.d <= {k})""".replace("{full}", f"{full}L")
    chars = lambda x: f"filter(split({x}, ''), y -> y <> '')"
    longer, shorter = f"if(length({one}) >= length({other}), {one}, {other})", f"if(length({one}) >= length({other}), {other}, {one})"
    whole = f"transform(array(named_struct('p', {chars(longer)}, 't', {chars(shorter)})), s -> if(size(s.t) = 0, size(s.p) <= {k}, {step.replace('size(t)', 'size(s.t)').replace('t[j]', 's.t[j]').replace('size(p)', 'size(s.p)').replace('get(p', 'get(s.p')}))[0]"
    return F.expr(f"abs(length({one}) - length({other})) <= {k} and {whole}")


def enough_blocks(k: int, one: str = "line_a", other: str = "line_b") -> Column:
    """All but k of 2 * (k + 1) blocks of one line stand in the other at most k places off."""
    n, blocks = f"length({one})", 2 * (k + 1)
    cut = lambda i: f"cast({n} * {i} div {blocks} as int)"
    found = " + ".join("if(" + " or ".join(f"({cut(i)} + {s} >= 0 and substring({one}, {cut(i)} + 1, {cut(i + 1)} - {cut(i)}) = substring({other}, {cut(i)} + 1 + {s}, {cut(i + 1)} - {cut(i)}))" for s in range(-k, k + 1)) + ", 1, 0)" for i in range(blocks))
    return F.expr(f"{found} >= {blocks - k}")


def occurrences(docs: DataFrame) -> DataFrame:
    """id, doc_id, sid, no, line of all lines that may go."""
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("sid"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return rows.filter(F.length(F.trim("line")) >= LEAST).select(F.xxhash64("line").alias("id"), "doc_id", "sid", "no", "line")


def _lines_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, line of the lines at (sid, no)."""
    ids = settle(ids, "line-ids")
    sids = settle(ids.select("sid").distinct(), "line-sids")
    own = docs.select(F.xxhash64("doc_id", "text").alias("sid"), "text").join(F.broadcast(sids) if sids.count() <= BROADCAST_IDS else sids, "sid", "left_semi")
    own = own.select("sid", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return settle(own.join(ids, ["sid", "no"]).groupBy("id").agg(F.min("line").alias("line")), "line-texts")


def shared(entries: DataFrame, tag: str) -> DataFrame:
    """The rows of entries (key, id, probe, ...) whose key has an index entry and another, with the key's counts `all` and `indexed`."""
    keys = entries.groupBy("key").agg(F.count(F.lit(1)).alias("all"), F.sum(1 - F.col("probe")).alias("indexed"))
    keys = settle(keys.filter("indexed > 0 and all > 1"), f"{tag}-keys")
    return settle(join_counted(entries, keys, "key", "all"), f"{tag}-members")


def crowded() -> Column:
    """Whether the lines of a key of shared() could make more than FEW pairs."""
    return F.col("all") * F.col("indexed") > FEW


def all_pairs(members: DataFrame) -> DataFrame:
    """key, id, probe -> pairs (a, b), a < b, of an index entry and any other of its key."""
    met = members.filter("probe = 0").select("key", F.col("id").alias("a")).join(members.select("key", F.col("id").alias("b"), "probe"), "key").filter("a <> b and (probe = 1 or a < b)")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_pairs(known: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Edges (a, b) between ids of different lines within k edits; for k = 1 enough of them for the same components."""
    longer = known.filter(F.col("n") >= FUZZY)
    entries = longer.select("id", F.explode("index").alias("x")).select("id", "x.*", F.lit(0).alias("probe"))
    entries = entries.union(longer.select("id", F.explode("probes").alias("x")).select("id", "x.*", F.lit(1)))
    members = shared(entries, "line")
    met = all_pairs(members.filter(~crowded()) if k == 1 else members)
    texts = _lines_of(docs, members.select("id").distinct().join(known, "id").select("id", "first.sid", "first.no"))
    if k == 1:
        met = met.union(gap_pairs(members.filter(crowded()).select("key", "id", "at", "size").join(texts, "id")))
    pairs = settle(met.distinct(), "line-pairs")
    rows = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("line_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("line_b")), "b")
    return settle(rows.filter(enough_blocks(k)).filter(within(k)).select("a", "b"), "line-edges")


def gap_forms(rest: str = "rest") -> Column:
    """Of `rest`, UTF-32, array<(place, form)>: the hash of rest without the character at each place.

    A form is cut into blocks of about the square root of its length, whose hashes are
    combined; a gap changes one of them, so a line of n characters takes n ** 1.5 steps.
    """
    block = lambda c, at, n="4 * s.size": f"xxhash64({c}, substring(s.rest, cast({at} as int), cast({n} as int)))"
    xor = lambda part: f"aggregate({part}, 0L, (x, y) -> x ^ y)"
    shape = f"named_struct('rest', {rest}, 'n', length({rest}) div 4, 'size', cast(ceil(sqrt(greatest(length({rest}) div 4 - 1, 1))) as int))"
    blocks = f"""transform(array({shape}), s -> named_struct('rest', s.rest, 'n', s.n, 'size', s.size, 'blocks', cast(ceil((s.n - 1) / s.size) as int),
        'same', transform(sequence(0, cast(ceil((s.n - 1) / s.size) as int)), c -> {block("c", "4 * c * s.size + 1")}),
        'moved', transform(sequence(0, cast(ceil((s.n - 1) / s.size) as int)), c -> {block("c", "4 * c * s.size + 5")})))"""
    sums = f"""transform({blocks}, s -> named_struct('rest', s.rest, 'n', s.n, 'size', s.size, 'blocks', s.blocks,
        'ahead', transform(sequence(0, s.blocks), c -> {xor("slice(s.same, 1, c)")}),
        'behind', transform(sequence(0, s.blocks), c -> {xor("slice(s.moved, c + 2, greatest(s.blocks - c - 1, 0))")})))"""
    gap = "cast(i div s.size as int)"
    own = f"xxhash64({gap}, concat(substring(s.rest, cast(4 * {gap} * s.size + 1 as int), cast(4 * (i - {gap} * s.size) as int)), substring(s.rest, cast(4 * i + 5 as int), cast(4 * (s.size - (i - {gap} * s.size)) as int))))"
    return F.expr(f"transform({sums}, s -> transform(sequence(0, s.n - 1), i -> named_struct('place', i, 'form', if({gap} < s.blocks, s.ahead[{gap}] ^ s.behind[{gap}] ^ {own}, s.ahead[s.blocks]))))[0]")


def whole_form(rest: str = "rest") -> Column:
    """The hash of `rest` itself, made as those of forms of its length."""
    size = f"cast(ceil(sqrt(greatest(length({rest}) div 4, 1))) as int)"
    return F.expr(f"transform(array({size}), s -> aggregate(sequence(0, cast(greatest(ceil(length({rest}) / 4 / s) - 1, 0) as int)), 0L, (x, c) -> x ^ xxhash64(c, substring({rest}, cast(4 * c * s + 1 as int), cast(4 * s as int)))))[0]")


def windows() -> Column:
    """Of `rest`, a window of w characters or, for a probe, one more: array<(key, w, rest)> of its PARTS windows, all else of it hashed into their keys.

    A substitution lies in one of them. So does the probe's further character, as each
    window of a probe ends one place behind the index entries'.
    """
    out = []
    for j in range(PARTS):
        at, size = f"cast(w * {j} div {PARTS} as int)", f"cast((w * {j + 1} div {PARTS}) - (w * {j} div {PARTS}) as int)"
        own = f"({size} + length(rest) - w)"
        out.append(f"named_struct('key', xxhash64(key, {j}, substring(rest, 1, {at}), substring(rest, {at} + {own} + 1)), 'w', {size}, 'rest', substring(rest, {at} + 1, {own}))")
    return F.expr("array(" + ", ".join(out) + ")")


def gap_pairs(members: DataFrame) -> DataFrame:
    """For one edit: key, id, at, size, line -> pairs (a, b), enough to join all lines of a key whose rests are one edit apart.

    The segment is a line's beginning or end, so the rest is one window. A line has a row for
    each window on the way, and goes on with those in which it still meets more than few.
    """
    rest = F.expr("concat(substring(line, 1, at), substring(line, at + size + 1))")
    rows = settle(members.select("key", "id", rest.alias("rest")), "line-rests")
    keys = settle(rows.groupBy("key").agg(F.min(F.length("rest")).alias("w"), F.count(F.lit(1)).alias("all")), "line-rest-keys")
    rows = join_counted(rows, keys, "key", "all")
    few, last, going = [], [], True
    while going:
        last.append(rows.filter(F.col("w") <= LAST).select("key", "id", "rest"))
        parts = settle(rows.filter(F.col("w") > LAST).select("id", F.explode(windows()).alias("x")).select("id", "x.*").withColumn("probe", F.length("rest") - F.col("w")), "line-windows")
        parts = shared(parts, "line-window")
        few.append(parts.filter(~crowded()).select("key", "id", "probe"))
        rows = parts.filter(crowded()).select("key", "id", "w", "rest")
        going = not rows.isEmpty()
    return all_pairs(reduce(DataFrame.union, few)).union(form_pairs(reduce(DataFrame.union, last)))


def form_pairs(members: DataFrame) -> DataFrame:
    """key, id, rest -> pairs (a, b) that join all lines of a key whose rests are one edit apart.

    A substitution leaves the same form with the gap at the same place: such lines are all
    one substitution apart, and each meets the smallest id. An insertion leaves a form that
    is the whole of the shorter line's rest. No pair is emitted that isn't one or the other.
    """
    rests = members.select("key", "id", F.encode("rest", "UTF-32").alias("rest"))
    gaps = settle(rests.select("key", "id", F.explode(gap_forms()).alias("g")).select("key", "id", "g.*"), "line-forms")
    hubs = gaps.groupBy("key", "form", "place").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    same = gaps.join(hubs, ["key", "form", "place"]).select(F.col("hub").alias("a"), F.col("id").alias("b"))
    whole = rests.select("key", whole_form().alias("form"), F.col("id").alias("a"))
    shorter = gaps.select("key", "form", F.col("id").alias("b")).join(whole, ["key", "form"]).select("a", "b")
    return same.union(shorter).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def surplus(docs: DataFrame, k: int = MAX_EDITS) -> DataFrame:
    """sid, gone: the numbers of the lines that go, for documents with any."""
    found = occurrences(docs)
    long = F.length("line") >= FUZZY
    found = found.withColumn("n", F.length("line")).withColumn("index", F.when(long, index_keys(k))).withColumn("probes", F.when(long, probe_keys(k)))
    known = found.groupBy("id").agg(F.min(F.struct("doc_id", "no", "sid")).alias("first"), F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), F.first("index").alias("index"), F.first("probes").alias("probes"))
    known = settle(known, "line-known")
    comps = components(near_pairs(known, docs, k)).withColumnRenamed("node", "id")
    classes = known.select("id", "first", "c").join(comps, "id", "left").filter("c > 1 or comp is not null").withColumn("comp", F.coalesce("comp", "id"))
    heads = classes.groupBy("comp").agg(F.min("first").alias("head"))
    heads = classes.join(heads, "comp").select("id", "head")
    gone = occurrences(docs).select("id", "doc_id", "sid", "no").join(heads, "id").filter("not (doc_id <=> head.doc_id and no = head.no)")
    return gone.groupBy("sid").agg(F.collect_set("no").alias("gone"))


def without(text: str, gone: str) -> Column:
    """The text's lines but for those whose numbers are in gone."""
    return F.expr(f"transform(array(split({text}, '\n')), all -> array_join(transform(array_except(sequence(0, size(all) - 1), {gone}), i -> all[i]), '\n'))[0]")


def dedup(docs: DataFrame, k: int = MAX_EDITS) -> DataFrame:
    """doc_id, text -> doc_id, sid, n_lines, n_removed, text (what remains); one row for each row."""
    docs = docs.select("doc_id", "text")
    out = docs.withColumn("sid", F.xxhash64("doc_id", "text")).join(surplus(docs, k), "sid", "left")
    return out.select("doc_id", "sid", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(without("text", "gone")).alias("text"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = dedup(table(spark, sf_dir, "documents"))
    return made.select("doc_id", F.greatest("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.greatest("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
o AS (SELECT doc_id, i - 1 AS no, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d) WHERE length(trim(lines[i])) >= {LEAST}),
u AS (SELECT line, row_number() OVER (ORDER BY line) AS id FROM (SELECT DISTINCT line FROM o)),
v AS (
  SELECT id, p, md5(substr(line, 1, p - 1) || substr(line, p + 1)) AS form FROM (SELECT id, line, unnest(range(1, length(line) + 1)) AS p FROM u WHERE length(line) >= {FUZZY})),
f AS (SELECT id, md5(line) AS form FROM u WHERE length(line) >= {FUZZY}),
g AS (SELECT p, form, min(id) AS hub FROM v GROUP BY ALL HAVING count(*) > 1),
e0 AS (
  SELECT v.id AS a, g.hub AS b FROM v JOIN g ON v.p = g.p AND v.form = g.form
  UNION SELECT v.id, f.id FROM v JOIN f ON v.form = f.form),
e AS (SELECT a, b FROM e0 WHERE a <> b UNION SELECT b, a FROM e0 WHERE a <> b),
r AS (SELECT id AS a, id AS b FROM u UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a AS id, min(b) AS comp FROM r GROUP BY a),
k AS (
  SELECT o.*, row_number() OVER (PARTITION BY comp ORDER BY doc_id, no) > 1 AS gone FROM o JOIN u ON o.line = u.line JOIN m ON m.id = u.id),
x AS (
  SELECT d.doc_id, i - 1 AS no, lines[i] AS line, len(lines) AS n FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d) d),
y AS (SELECT x.*, coalesce(k.gone, false) AS gone FROM x LEFT JOIN k ON k.doc_id = x.doc_id AND k.no = x.no),
z AS (SELECT doc_id, any_value(n) AS n_lines, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS kept_sha256 FROM y GROUP BY doc_id)
SELECT documents.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents LEFT JOIN z ON z.doc_id = documents.doc_id
"""
