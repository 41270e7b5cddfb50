"""Crowded keys of the edit join: candidates in proportion to the lines, no link lost."""

import random

from pyspark.sql import functions as F

from archspark.llm import lines

from .test_lines import expected


def members_of(spark, texts):
    """The index and probe entries of all texts, as gap_pairs() takes them, of keys with more than one."""
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, line string").withColumn("n", F.length("line"))
    rows = rows.select("id", "line", F.explode(F.concat(lines.index_keys(1), lines.probe_keys(1))).alias("x")).select("id", "line", "x.*")
    return rows


def test_half_in_common_but_no_edge(spark):
    r = random.Random(5)
    half = "".join(r.choice("abcdefgh") for _ in range(30))
    other = lambda n: "".join(r.choice("ijklmnop") for _ in range(n))
    texts = sorted({half + other(30) for _ in range(200)} | {half + other(31) for _ in range(5000)})
    assert lines.gap_pairs(members_of(spark, texts)).count() < len(texts) / 10


def test_big_template(spark):
    texts = [f"page number {i:04d} of the very same long document" for i in range(1200)]
    n = lines.gap_pairs(members_of(spark, texts)).distinct().count()
    assert 1199 <= n < 20 * 1200
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.n_removed for r in lines.dedup(df).collect()) == [0] + [1] * 1199


def test_gap_forms_against_plain(spark):
    r = random.Random(6)
    texts = sorted({"".join(r.choice("abé𝄞") for _ in range(r.choice((1, 2, 3, 4, 5, 9, 10, 16, 17, 50)))) for _ in range(60)})
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("rest", F.encode("t", "UTF-32"))
    whole = {x.t: x.w for x in df.select("t", lines.whole_form().alias("w")).collect()}
    assert len(set(whole.values())) == len(whole)
    seen = {}
    for x in df.select("t", lines.gap_forms().alias("g")).collect():
        assert [g.place for g in x.g] == list(range(len(x.t)))
        for g in x.g:
            form = x.t[: g.place] + x.t[g.place + 1 :]
            assert seen.setdefault(g.form, form) == form
            assert form not in whole or whole[form] == g.form
    assert len(set(seen.values())) == len(seen)


def test_every_key_crowded(spark, monkeypatch):
    monkeypatch.setattr(lines, "FEW", 0)
    r = random.Random(7)
    base = ["".join(r.choice("ab ") for _ in range(r.randint(24, 40))) for _ in range(6)]
    rows = []
    for i in range(120):
        line = r.choice(base)
        for _ in range(r.choice((0, 1, 1, 2))):
            at = r.randrange(len(line))
            line = r.choice((line[:at] + "z" + line[at:], line[:at] + line[at + 1 :], line[:at] + "y" + line[at + 1 :]))
        rows.append((i, line))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((x.doc_id, x.n_lines, x.n_removed, x.text) for x in lines.dedup(df, 1).collect()), key=str)
    assert got == expected(rows, 1)
