import random

import pytest
from pyspark.sql import functions as F

from archspark.llm import lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def expected(rows, k):
    """(doc_id, n_lines, n_removed, text) of rows that are documents of their own."""
    own = sorted((i, no, line) for i, t in rows if t is not None for no, line in enumerate(t.split("\n")) if len(line.strip(" ")) >= lines.LEAST)
    kinds = sorted({x[2] for x in own})
    parent = {x: x for x in kinds}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            if min(len(a), len(b)) >= lines.FUZZY and abs(len(a) - len(b)) <= k and distance(a, b) <= k:
                parent[find(b)] = find(a)
    first, gone = {}, set()
    for i, no, line in own:
        if first.setdefault(find(line), (i, no)) != (i, no):
            gone.add((i, no))
    out = []
    for i, t in rows:
        parts = [] if t is None else t.split("\n")
        kept = [x for no, x in enumerate(parts) if (i, no) not in gone]
        out.append((i, len(parts), len(parts) - len(kept), None if t is None else "\n".join(kept)))
    return sorted(out, key=str)


def edited(r, line, n):
    for _ in range(n):
        at = r.randrange(len(line)) if line else 0
        line = r.choice((line[:at] + "z" + line[at:], line[:at] + line[at + 1 :], line[:at] + "y" + line[at + 1 :]))
    return line


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    base = ["".join(r.choice("abcdé ") for _ in range(r.randint(10, 70))) for _ in range(12)]
    out = [(i, "\n".join(edited(r, r.choice(base), r.choice((0, 0, 1, 1, 2, 3))) for _ in range(r.randint(1, 6)))) for i in range(60)]
    return [*out, (60, ""), (61, None), (62, "\n\n"), (63, "short\nshort"), (64, out[3][1]), (65, "q" * 5000 + "\n" + "q" * 4999)]


@pytest.mark.parametrize(("k", "few"), [(1, 16), (1, 2), (2, 16)])
def test_against_all_pairs(spark, rows, k, few, monkeypatch):
    monkeypatch.setattr(lines, "FEW", few)
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, line string, key int")
    got = sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in lines.dedup(df, k).collect()), key=str)
    assert got == expected(rows, k)


def test_banded_distance(spark):
    r = random.Random(3)
    pairs = [(a, edited(r, a, r.randint(0, 4)) if a else "x") for a in ("".join(r.choice("abé") for _ in range(r.randint(0, 14))) for _ in range(400))]
    df = spark.createDataFrame(pairs, "line_a string, line_b string").cache()
    for k in (1, 2, 3):
        assert df.filter(lines.within(k) != (F.levenshtein("line_a", "line_b") <= k)).count() == 0
        assert df.filter((F.levenshtein("line_a", "line_b") <= k) & ~lines.enough_blocks(k)).count() == 0


def test_repeated_rows_and_empty_table(spark, no_docs):
    df = spark.createDataFrame([(1, "this line occurs in one document")] * 2, "doc_id long, text string")
    assert [r.n_removed for r in lines.dedup(df).collect()] == [0, 0]
    assert lines.dedup(no_docs).collect() == []
