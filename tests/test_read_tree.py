"""Trees read from a disk, however their directories are dealt out."""

import os

import pyarrow as pa
import pytest

from archspark.plans import check as plan
from archspark.plans import dump
from archspark.sources import files as trees


@pytest.fixture
def tree(tmp_path):
    for i in range(6):
        for j in range(5):
            at = tmp_path / f"d{i}" / f".e{j}" / "deep"
            at.mkdir(parents=True)
            (at / "x.go").write_bytes(f"{i}{j}é".encode())
    (tmp_path / ".gitignore").write_text("x\n")
    (tmp_path / "_empty").mkdir()
    (tmp_path / "d1" / "link").symlink_to(tmp_path / "d2")
    (tmp_path / "d1" / "gone").symlink_to(tmp_path / "nowhere")
    return tmp_path


def walked(root):
    out = set()
    for at, dirs, names in os.walk(root):
        out |= {(f"{at}/{d}", True, None) for d in dirs}
        out |= {(f"{at}/{n}", False, trees._content(f"{at}/{n}")) for n in names}
    return out


@pytest.mark.parametrize(("parts", "size"), [(1, 1), (3, 1 << 20), (10, 7), (1000, 1 << 20)])
def test_partitions_hold_every_entry_once(tree, monkeypatch, parts, size):
    monkeypatch.setattr(trees._Tree, "PARTS", parts)
    monkeypatch.setattr(trees._Tree, "BATCH_BYTES", size)
    reader = trees._Tree(str(tree))
    dealt = reader.partitions()
    assert 1 <= len(dealt) <= parts
    rows = [tuple(r.values()) for p in dealt for b in reader.read(p) for r in pa.RecordBatch.to_pylist(b)]
    assert len(rows) == len(set(rows)) and set(rows) == walked(tree)


def test_source(spark, tree):
    rows = trees.read_tree(spark, str(tree)).collect()
    assert {(r.abs, r.is_dir, r.content and bytes(r.content)) for r in rows} == walked(tree)
    assert trees.read_tree(spark, str(tree / "none")).count() == 0


def test_capsules_of_one_depth_share_a_check(spark, monkeypatch):
    code = lambda m: {"go.mod": f"module ex.org/{m}\n", "p/p.go": f'package p\nimport "ex.org/{m}/q"\n', "q/q.go": "package q\n"}
    tree = {"/w/.git": ""} | {f"/w/{m}/{path}": text for m in ("a", "b", "c") for path, text in code(m).items()}
    asked, real = [], plan.check
    monkeypatch.setattr(plan, "check", lambda *a, **k: asked.append(k["within"]) or real(*a, **k))
    found = dump.dump(trees.from_rows(spark, tree), "/w", colours_name="none")
    assert [(c.path, c.is_new, c.nodes, c.edges) for c in found.contracts] == [(f"/w/{m}/CONTRACT.md", True, 2, 1) for m in "abc"]
    assert found.errors == [] and asked == [["/w/a", "/w/b", "/w/c"]]
