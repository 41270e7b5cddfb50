"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents fall into at most 4096 hash blocks. A source that takes `want`
words takes all of its blocks want div size times and then, in a random order of blocks,
the first ones up to the rest; the block at the edge gives documents in a random order,
the last of them in part, so that each source's words are exact. The numbers of drawn
blocks by source are the quotas at the root of a binary tree over the output shards. A
node splits its quotas between its halves by drawing blocks without replacement, which
is the multivariate hypergeometric law. A shard takes the next run of each source's
permuted blocks, so shards are disjoint, and `order_key` shuffles its documents.

Tables by source or by block have a bound of their own (sources, 4096 blocks each);
what grows with the documents is only dealt out by (source, block).

Null text has size 0. A null source is a source of its own, last in the order. Documents
of size 0 are never taken and appear with taken 0. An empty table gives no rows. Equal
doc_ids are dealt with row by row: the random order depends on doc_id and text, so rows
without a doc_id spread like others and only equal rows tie, whose places are one as good
as the other. Results don't depend on how the input is partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, table

#: Words are runs of anything but these.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, CAP, SHARDS, SEED = (5, 2, 1), 3, 16, "mix-1"


def sizes(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, perm (random order), block (the first digits of perm)."""
    own = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    perm = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"/{seed}/"), own).cast("binary"))
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), perm.alias("perm")).withColumn("block", F.substring("perm", 1, 3))


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size -> source_no, target: shares by weight; where a share is above cap times the size, the excess goes to the others.

    In the order of cap * size / weight a source is capped as long as what the capped ones
    before it leave, shared by weight, still reaches its cap.
    """
    every = Window.partitionBy()
    rows = by_source.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int")).cast("long"))
    rows = rows.withColumn("most", cap * F.col("source_size")).withColumn("total", F.sum("source_size").over(every))
    order = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source_no").asc())
    rows = rows.withColumn("before", F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("most"))
    rows = rows.withColumn("from_here", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("capped", F.col("most") * F.col("from_here") <= F.col("weight") * (F.col("total") - F.col("before")))
    left = F.col("total") - F.sum(F.when(F.col("capped"), F.col("most")).otherwise(0)).over(every)
    shared = F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0)).over(every)
    return rows.withColumn("target", F.when(F.col("capped"), F.col("most").cast("double")).otherwise((F.col("weight") * left).cast("double") / shared)).select("source", "source_no", "source_size", "target")


def _uniform(*parts: str) -> str:
    return f"(pmod(xxhash64({', '.join(parts)}), 9007199254740992L) / 9007199254740992D)"


def splitting_tree(quotas: DataFrame, shards: int, seed: str = SEED) -> DataFrame:
    """(source_no, quota) -> (shard, source_no, quota): every shard gets total * (shard + 1) div shards - total * shard div shards blocks."""
    nodes = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct("source_no", "quota"))).alias("own")).select(F.lit(0).alias("first"), F.lit(shards).alias("n"), F.lit(0).cast("long").alias("done"), "own")
    total = quotas.groupBy().agg(F.coalesce(F.sum("quota"), F.lit(0)).cast("long").alias("total"))
    nodes = nodes.crossJoin(F.broadcast(total))  # one row each
    while_wide = max(0, (shards - 1).bit_length())
    for _ in range(while_wide):
        drawn = f"""aggregate(own,
            named_struct('all', aggregate(own, 0L, (a, e) -> a + e.quota), 'need', total * (first + n div 2) div {shards} - done, 'got', cast(array() as array<bigint>)),
            (a, e) -> named_struct('all', a.all - e.quota, 'need', a.need - aggregate(if(e.quota > 0, sequence(1L, e.quota), cast(array() as array<bigint>)), named_struct('all', a.all, 'need', a.need, 'x', 0L),
                (b, j) -> if({_uniform("e.source_no", "first", "n", "j", f"'{seed}'")} * b.all < b.need, named_struct('all', b.all - 1, 'need', b.need - 1, 'x', b.x + 1), named_struct('all', b.all - 1, 'need', b.need, 'x', b.x)), b -> b.x),
                'got', concat(a.got, array(a.need))))"""
        # got holds what was needed before each source; its differences are the draws.
        nodes = nodes.withColumn("need", F.when(F.col("n") > 1, F.expr(f"total * (first + n div 2) div {shards} - done")))
        nodes = nodes.withColumn("drawn", F.when(F.col("n") > 1, F.expr(drawn)))
        left = "transform(own, (e, i) -> named_struct('source_no', e.source_no, 'quota', drawn.got[i] - if(i + 1 < size(own), drawn.got[i + 1], drawn.need)))"
        nodes = nodes.withColumn("left", F.when(F.col("n") > 1, F.expr(left)).otherwise(F.col("own")))
        right = "transform(own, (e, i) -> named_struct('source_no', e.source_no, 'quota', e.quota - left[i].quota))"
        nodes = nodes.withColumn("half", F.explode(F.expr(f"""if(n = 1, array(named_struct('first', first, 'n', n, 'done', done, 'own', own)),
            array(named_struct('first', first, 'n', cast(n div 2 as int), 'done', done, 'own', left),
                  named_struct('first', cast(first + n div 2 as int), 'n', cast(n - n div 2 as int), 'done', done + need, 'own', {right})))"""))).select("half.*", "total")
    return nodes.select(F.col("first").alias("shard"), F.explode("own").alias("e")).select("shard", "e.source_no", "e.quota")


def plan(docs: DataFrame, shards: int = SHARDS, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, order_key, draws array<(copy, shard, words)>."""
    known = settle(sizes(docs, seed), "mix-sizes")
    blocks = known.groupBy("source", "block").agg(F.sum("size").alias("words"))
    by_source = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    want = F.floor(F.col("target") + 0.5).cast("long")
    by_source = by_source.withColumn("full", F.when(F.col("source_size") > 0, F.floor(want / F.col("source_size"))).otherwise(0).cast("long"))
    by_source = by_source.withColumn("rest", want - F.col("full") * F.col("source_size"))
    order = Window.partitionBy("source_no").orderBy("at", "block")
    blocks = blocks.join(by_source, blocks["source"].eqNullSafe(by_source["source"])).drop(blocks["source"])
    blocks = blocks.withColumn("at", F.md5(F.concat_ws("/", "source_no", "block", F.lit(seed)).cast("binary")))
    blocks = blocks.withColumn("before", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")).withColumn("rank", F.row_number().over(order) - 1).withColumn("n_blocks", F.count(F.lit(1)).over(Window.partitionBy("source_no")))
    blocks = blocks.withColumn("copies", F.when(F.col("words") > 0, F.col("full") + (F.col("before") < F.col("rest")).cast("long")).otherwise(0))
    # Copies are numbered as 0..copies-1; the copy `full`, where there is one, is the rest's and may end in this block.
    blocks = settle(blocks.withColumn("room", F.least("words", F.col("rest") - F.col("before"))), "mix-blocks")
    quotas = blocks.groupBy("source_no").agg(F.sum("copies").alias("quota"))
    leaves = splitting_tree(quotas, shards, seed).groupBy("source_no").agg(F.array_sort(F.collect_list(F.struct("shard", "quota"))).alias("leaf"))
    # A source's drawn blocks are numbered copy by copy; a shard takes as many of the next ones as its leaf says.
    number = Window.partitionBy("source_no").orderBy("copy", "rank")
    dealt = blocks.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).select("source_no", "block", "copy", "rank").withColumn("k", F.row_number().over(number) - 1)
    dealt = dealt.join(leaves, "source_no").withColumn("shard", F.expr("aggregate(leaf, named_struct('upto', 0L, 'shard', -1), (a, e) -> if(k >= a.upto, named_struct('upto', a.upto + e.quota, 'shard', e.shard), a), a -> a.shard)"))
    dealt = dealt.groupBy("source_no", "block").agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("dealt"))
    blocks = blocks.select("source", "source_no", "source_size", "target", "full", "block", "room").join(dealt, ["source_no", "block"], "left")
    rows = known.join(blocks.withColumnRenamed("block", "of_block").withColumnRenamed("source", "of_source"), known["source"].eqNullSafe(F.col("of_source")) & (known["block"] == F.col("of_block")))
    within = Window.partitionBy("source_no", "block").orderBy("perm", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("ahead", F.sum("size").over(within) - F.col("size"))
    part = "greatest(0L, least(size, room - ahead))"
    rows = rows.withColumn("draws", F.expr(f"filter(transform(coalesce(dealt, array()), d -> named_struct('copy', d.copy, 'shard', d.shard, 'words', if(d.copy < full, size, {part}))), d -> d.words > 0)"))
    return rows.select("doc_id", "source", "size", "source_size", "target", F.col("perm").alias("order_key"), "draws")


def mix(docs: DataFrame, shards: int = SHARDS, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """One row for each copy taken: doc_id, source, copy, shard, words, order_key (the order in the shard: by order_key, copy)."""
    rows = plan(docs, shards, weights, cap, seed).select("doc_id", "source", "order_key", F.explode("draws").alias("d"))
    return rows.select("doc_id", "source", "d.copy", "d.shard", "d.words", F.md5(F.concat_ws("/", "order_key", "d.copy").cast("binary")).alias("order_key"))


def taken() -> Column:
    return F.expr("aggregate(draws, 0L, (a, d) -> a + d.words)")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", taken().alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/mix-1/' || md5(coalesce(text, ''))) AS perm
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS source_no FROM d GROUP BY source),
w AS (
  SELECT *, CAST([5, 2, 1][source_no % 3 + 1] AS BIGINT) AS weight, 3 * source_size AS most, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s),
c AS (
  SELECT *, CAST(sum(most) OVER (ORDER BY most / weight, source_no ROWS UNBOUNDED PRECEDING) AS BIGINT) - most AS ahead,
         CAST(sum(weight) OVER (ORDER BY most / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS from_here FROM w),
k AS (SELECT *, most * from_here <= weight * (total - ahead) AS capped FROM c),
t AS (
  SELECT source, source_no, source_size,
         CASE WHEN capped THEN CAST(most AS DOUBLE)
              ELSE CAST(weight * (total - sum(CASE WHEN capped THEN most ELSE 0 END) OVER ()) AS DOUBLE) / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () END AS target FROM k),
q AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS full_copies FROM t),
r AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) - full_copies * source_size AS rest FROM q),
o AS (
  SELECT d.*, r.source_no, r.source_size, r.target, r.full_copies, r.rest, substr(perm, 1, 3) AS block,
         md5(concat_ws('/', CAST(source_no AS VARCHAR), substr(perm, 1, 3), 'mix-1')) AS block_at
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
a AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source_no ORDER BY block_at, block, perm, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS ahead FROM o)
SELECT doc_id, size, source_size, target, CAST(full_copies * size + greatest(0, least(size, rest - ahead)) AS BIGINT) AS taken FROM a
"""
