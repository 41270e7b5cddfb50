import random

import pytest
from pyspark.sql import functions as F

from archspark.llm import neardup

from .conftest import sentence


def word_sets(texts, size):
    out = {}
    for i, t in texts.items():
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        out[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    return out


def expected(texts, size, percent=80):
    sets, parent = word_sets(texts, size), {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: (len(sets[i]), find(i), find(i) == i) for i in texts}


@pytest.mark.parametrize("size", [4, 5])
def test_against_all_pairs(docs, texts, size):
    got = neardup.near_components(docs, size).collect()
    assert len(got) == len(texts) + 1  # a row for each row
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == expected(texts, size)


def test_crowded_lists_take_the_exact_way(spark, monkeypatch):
    """A large group of near copies, chains within it and copies that just miss."""
    monkeypatch.setattr(neardup, "CAP", 6)
    r = random.Random(5)
    base = sentence(r, 90).split()
    texts = {}
    for i in range(150):
        w = list(base)
        for _ in range(r.choice((0, 1, 2, 3, 4, 5))):
            at = r.randrange(len(w))
            w[at : at + r.choice((0, 1, 2))] = [f"n{r.randrange(40)}"] * r.choice((0, 1, 2))
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in neardup.near_components(df, 4).collect()}
    assert got == expected(texts, 4)


def test_null_id_and_empty_table(spark, no_docs):
    df = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in neardup.near_components(df, 4).collect())
    assert got == [(0, None, True), (1, 1, True), (2, 1, False)]
    assert neardup.near_components(no_docs).collect() == []


def test_one_hash_for_one_shingle():
    a, b = neardup.shingles("A b\tc  d e", 4), neardup.shingles("x a B c d e y", 4)
    assert len(a) == 2 and set(a) <= set(b)
    assert F is not None
