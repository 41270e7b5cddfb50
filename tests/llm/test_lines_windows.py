"""Crowded keys of the edit join go on by windows: rows in proportion to lines, not to their characters."""

import random

import pytest

from archspark.llm import lines

from .test_lines_crowded import members_of


def generated(spark, since=-1):
    """(last execution, rows made by all Generate nodes of the executions after `since`)."""
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    store, total, last = spark._jsparkSession.sharedState().statusStore(), 0, since
    runs = store.executionsList()
    for i in range(runs.size()):
        at = runs.apply(i).executionId()
        if at <= since:
            continue
        last = max(last, at)
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            for m in (node.metrics().apply(j) for j in range(node.metrics().size())):
                if node.name().startswith("Generate") and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    total += int(values.apply(m.accumulatorId()).replace(",", ""))
    return last, total


def test_no_row_for_each_character(spark):
    r = random.Random(8)
    some = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    texts = [half + some(200) for half in (some(200) for _ in range(40)) for _ in range(8)]
    members = members_of(spark, texts).localCheckpoint()
    since, _ = generated(spark)
    assert lines.gap_pairs(members).count() == 0
    _, made = generated(spark, since)
    assert len(texts) <= made < 40 * len(texts)


@pytest.mark.parametrize(("few", "last"), [(0, 8), (0, 3), (16, 8)])
def test_edits_at_all_places(spark, few, last, monkeypatch):
    monkeypatch.setattr(lines, "FEW", few)
    monkeypatch.setattr(lines, "LAST", last)
    r = random.Random(9)
    some = lambda n: "".join(r.choice("abcdefghijklmnopé𝄞") for _ in range(n))
    rows, want = [], []
    for n in (24, 25, 79, 200):
        for p in range(0, n + 1, 1 if n < 50 else 3):
            line = some(n)
            own = [line, line[:p] + "z" + line[p:], line[:p] + "y" + line[p + 1 :]]
            # Others that have half of it make the keys crowded.
            own += [line[: n // 2 + 1] + some(n - n // 2 - 1) for _ in range(5)] + [some(n // 2) + line[n // 2 :] for _ in range(5)]
            rows += [(len(rows) + i, x) for i, x in enumerate(own)]
            want += [0, 1, 1] + [0] * 10
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [x.n_removed for x in sorted(lines.dedup(df).collect(), key=lambda x: x.doc_id)] == want
