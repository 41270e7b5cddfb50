import hashlib

import numpy as np
import pytest

from archspark.llm import substrings


def expected(rows, length=200):
    count = {}
    raws = [(i, (t or "").encode()) for i, t in rows]
    for _, r in raws:
        for s in range(len(r) - length + 1):
            count[r[s : s + length]] = count.get(r[s : s + length], 0) + 1
    out = []
    for i, r in raws:
        gone = np.zeros(len(r), bool)
        for s in range(len(r) - length + 1):
            if count[r[s : s + length]] > 1:
                gone[s : s + length] = True
        edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
        out.append((i, len(r), int(gone.sum()), len(edges) // 2, hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("group", [substrings.GROUP, 0])
def test_against_all_strings(docs, group, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP", group)
    got = [(r.doc_id, r.n_bytes, sum(x.stop - x.start for x in r.removed), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in substrings.remove_repeats(docs).collect()]
    assert sorted(got) == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_column_sort_finds_windows_common_to_two_rows():
    r = np.random.default_rng(3)
    shared = r.integers(0, 4, 230)
    rows = [r.integers(0, 4, 368) for _ in range(6)]
    rows[1][100:330] = shared
    rows[4][100:330] = shared
    hit = substrings.column_sort(np.array([0, 0, 0, 0, 0, 1]), np.array(rows), 168)
    assert {(int(i), int(c)) for i, c in zip(*np.nonzero(hit), strict=True)} >= {(i, c) for i in (1, 4) for c in range(100, 131)}
    assert not hit[[0, 2, 3, 5]].any()


def test_empty_table(no_docs):
    assert substrings.remove_repeats(no_docs).collect() == []
