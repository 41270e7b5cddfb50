import random
import re

from archspark.llm import decontaminate as d

from .conftest import sentence


def tokens(t):
    return [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if x]


def best(doc, item):
    """Best ungapped stretch over all diagonals, whatever the seeds."""
    top = 0
    for diagonal in range(-len(item) + 1, len(doc)):
        run = 0
        for i in range(max(0, diagonal), min(len(doc), len(item) + diagonal)):
            run = max(0, run + (1 if doc[i] == item[i - diagonal] else -d.PENALTY))
            top = max(top, run)
    return top


def test_planted_passages(spark):
    r = random.Random(4)
    items = {0: sentence(r, 30), 1: sentence(r, 14), 2: sentence(r, 50), 3: "seven words only in this short item", 4: "too short", 5: None, 6: ""}
    texts = {i: sentence(r, 80) for i in range(30)}
    texts[30] = sentence(r, 10) + " " + items[0].upper() + ", " + sentence(r, 5)
    words = items[2].split()
    words[9] = words[22] = words[35] = "other"  # substitutions
    texts[31] = " ".join(words)
    texts[32] = "x Seven words: only in this short item! y"
    texts[33] = " ".join(items[0].split()[:9])  # not enough
    texts[34], texts[35], texts[36] = None, "", items[1]
    texts[37] = "seven words only in that short item"
    texts[38] = "one is Too  short; the other one isn't"
    docs = spark.createDataFrame([(i, t, "z", 0) for i, t in texts.items()] + [(36, items[1], "z", 0)], "doc_id long, text string, words string, h int")
    bench = spark.createDataFrame([(i, t, "q") for i, t in items.items()], "item_id long, text string, item string")
    got = {(x.doc_id, x.item_id): (x.score, x.matched, x.first_token, x.last_token) for x in d.overlaps(docs, bench).collect()}
    assert got == {(30, 0): (30, 30, 10, 39), (31, 2): (50 - 3 * 3, 47, 0, 49), (32, 3): (7, 7, 1, 7), (36, 1): (14, 14, 0, 13), (38, 4): (2, 2, 2, 3)}
    for (i, j), (score, *_) in got.items():
        assert score == best(tokens(texts[i]), tokens(items[j]))
    for i, t in texts.items():
        for j, x in items.items():
            if len(tokens(x)) >= len(d.MASKS[0]) and best(tokens(t), tokens(x)) >= d.MIN_SCORE:
                assert (i, j) in got


def test_blocks_change_nothing(spark, docs, monkeypatch):
    bench = docs.selectExpr("doc_id as item_id", "text").filter("doc_id < 12")
    one = {tuple(r) for r in d.overlaps(docs, bench).collect()}
    monkeypatch.setattr(d, "BLOCK_ROWS", 300)
    assert one and {tuple(r) for r in d.overlaps(docs, bench).collect()} == one


def test_empty_tables(docs, no_docs):
    bench = no_docs.selectExpr("doc_id as item_id", "text")
    assert d.overlaps(docs, bench).collect() == []
    assert d.overlaps(no_docs, docs.selectExpr("doc_id as item_id", "text")).collect() == []


def unseen(masks):
    """A stretch (1: match) that reaches MIN_SCORE without a mask on its matches, if there is any."""
    wide = (1 << max(map(len, masks))) - 1
    seen, todo = {(0, 0)}, [(0, 0, "")]
    while todo:
        past, run, path = todo.pop()
        for bit in (0, 1):
            now, score = (past << 1 | bit) & wide, run + 1 if bit else run - d.PENALTY
            if score <= 0 or (now, score) in seen or any(now & int(m, 2) == int(m, 2) for m in masks):
                continue
            if score >= d.MIN_SCORE:
                return path + str(bit)
            seen.add((now, score))
            todo.append((now, score, path + str(bit)))
    return None


def test_masks_miss_no_stretch():
    assert unseen(("1101100111", "1110011011")) and unseen(d.MASKS) is None
    assert all(unseen([m for m in d.MASKS if m != x]) for x in d.MASKS)


def test_dense_and_periodic_substitutions(spark):
    r = random.Random(6)
    items = {j: [f"w{j}x{i}" for i in range(n)] for j, n in enumerate((16, 25, 60, 60, 90))}
    texts = {}
    for j, words in items.items():
        for period in (4, 5, 6, 7):
            for offset in range(period):
                texts[len(texts)] = ["s" if i % period == offset else w for i, w in enumerate(words)]
        for share in (0.1, 0.15, 0.2, 0.25):
            for _ in range(15):
                texts[len(texts)] = ["p", "q"] + ["s" if r.random() < share else w for w in words] + ["p"]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(j, " ".join(t)) for j, t in items.items()], "item_id long, text string")
    want = {(i, j): s for i, t in texts.items() for j, x in items.items() if (s := best(t, x)) >= d.MIN_SCORE}
    assert {(x.doc_id, x.item_id): x.score for x in d.overlaps(docs, bench).collect()} == want


def test_rows_and_items_that_share_an_id(spark):
    r = random.Random(14)
    item, other = sentence(r, 30), sentence(r, 20)
    weak = " ".join(item.split()[:12]) + " " + sentence(r, 18)
    for docs in ([(1, item), (1, weak), (None, weak), (None, item), (2, sentence(r, 40))], [(1, weak), (None, item), (1, item), (None, weak)]):
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        bench = spark.createDataFrame([(5, item), (5, other), (None, item)], "item_id long, text string")
        got = {(x.doc_id, x.item_id): x.score for x in d.overlaps(df, bench).collect()}
        assert got == {(1, 5): 30, (1, None): 30, (None, 5): 30, (None, None): 30}
        rows = {(x.sid, x.score) for x in d.overlapping_rows(df, bench).collect()}
        assert len({s for s, _ in rows}) == 4
