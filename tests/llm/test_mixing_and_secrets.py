import re

from pyspark.sql import functions as F

from archspark.llm import mixing, secrets


def fair(sizes):
    """Shares by weight, the excess over three times a size given out again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, out, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        left, w = total - sum(out.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 3 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / w for s in open_}
        for s in over:
            out[s] = 3 * sizes[s]
        open_ -= over
    return out


def test_targets_and_words(docs, texts):
    rows = mixing.plan(docs, shards=5).withColumn("taken", mixing.taken()).collect()
    assert len(rows) == len(texts) + 1
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by_source = {}
    for r in rows:
        assert r.size == size(texts[r.doc_id]) and 0 <= r.taken <= 3 * r.size
        by_source[r.source] = by_source.get(r.source, 0) + r.size
    want = fair(by_source)
    for s, n in by_source.items():
        own = [r for r in rows if r.source == s]
        assert all(r.source_size == n and abs(r.target - want[s]) < 1e-6 * max(1, want[s]) for r in own)
        # Equal rows are dealt with together, so a source may be off by one document of them.
        assert abs(sum(r.taken for r in own) - want[s]) <= 1
    again = {(r.doc_id, r.taken) for r in mixing.plan(docs.repartition(7), shards=5).withColumn("taken", mixing.taken()).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}
    mixed = mixing.mix(docs, shards=5).collect()
    assert sum(r.words for r in mixed) == sum(r.taken for r in rows) and {r.shard for r in mixed} <= set(range(5))


def test_excess_is_shared_again(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(10, "a"), (900, "b"), (20, "c"), (5, "d"), (3000, None), (0, "e")])]
    got = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    want = fair({"a": 10, "b": 900, "c": 20, "d": 5, "e": 0, None: 3000})
    assert all(abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) for r in got)


def test_reruns_agree(spark):
    """Equal and null ids with different texts, in any partitioning."""
    rows = [(i % 9 if i % 4 else None, "w " * (10 + 7 * i % 190) + str(i), "ab"[i % 2]) for i in range(49)] + [(3, "same text", "a")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = lambda n: sorted(map(str, mixing.plan(df.repartition(n)).select("doc_id", "size", "source", mixing.taken()).collect()))
    one = taken(1)
    assert all(taken(n) == one for n in (2, 3, 5))


def test_splitting_tree(spark):
    quotas = {0: 40, 1: 7, 2: 0, 3: 153}
    df = spark.createDataFrame(list(quotas.items()), "source_no int, quota long")
    leaves = [tuple(r) for r in mixing.splitting_tree(df, 6).collect()]
    for s, q in quotas.items():
        assert sum(n for _, t, n in leaves if t == s) == q
    total = sum(quotas.values())
    for shard in range(6):
        assert sum(n for k, _, n in leaves if k == shard) == total * (shard + 1) // 6 - total * shard // 6
    assert all(n >= 0 for *_, n in leaves)
    # The mean of a source's share in a shard over many seeds is its share of all.
    mean = sum(n for seed in range(12) for k, s, n in (tuple(r) for r in mixing.splitting_tree(df, 2, f"s{seed}").collect()) if k == 0 and s == 0) / 12
    assert abs(mean - 20) < 4


def test_mix_of_nothing(no_docs):
    assert mixing.plan(no_docs).collect() == [] and mixing.mix(no_docs).collect() == []


def test_secret_forest_held_out(spark):
    held = secrets.labelled(spark, 1400, "held")
    model = secrets.fit(secrets.labelled(spark))
    right = model.transform(secrets.features(held)).select((F.col("prediction") == F.col("label")).alias("ok")).filter("ok").count()
    assert right >= 0.95 * 1400


def test_secret_positions(spark):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    rows = [(1, f'say token = "{key}" and', "src1"), (2, "thhahathernthertionedesst and 4785380592391139", "src2"), (3, None, None), (4, "", "s"), (5, f"é\n{key} sha1 checksum", "s"), (6, "x" * 40 + " secret=" + key + "\n" + key, "s")]
    df = spark.createDataFrame([(*r, 0, "b") for r in rows] + [(*rows[0], 0, "b")], "doc_id long, text string, source string, start int, before string")
    every = secrets.candidates(df).collect()
    for r in every:
        text = dict((i, t) for i, t, _ in rows)[r.doc_id]
        assert text[r.start : r.start + len(r.candidate)] == r.candidate and text[: r.start].endswith(r.before)
    found = sorted((r.doc_id, r.start) for r in secrets.scan(df).collect())
    assert found[:2] == [(1, 13), (1, 13)] and (6, 48) in found and not any(i in (2, 3, 4) for i, _ in found)
    assert secrets.scan(df.limit(0)).collect() == []
