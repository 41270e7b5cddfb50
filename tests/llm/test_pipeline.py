"""run() against a brute-force version of its stages on a small table."""

import re

import corpus_pipeline
from archspark.llm import langid

from .test_decontaminate import best, tokens
from .test_lines import expected as expected_lines
from .test_mixing_and_secrets import fair
from .test_neardup import expected as expected_components


def test_pipeline(spark, texts, tmp_path):
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench = [(1, texts[7]), (2, "a benchmark item that occurs nowhere in any of the texts here at all")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        got[name] = docs.collect()
        if name != "mixing sources to target weights":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {r.id for r in langid.identify(langid.documents_as_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))).filter("kept").collect()}
    assert {72, 73, 74}.isdisjoint(kept) and len(kept) > 70
    now = {i: texts[i] for i in kept}
    assert {r.doc_id for r in got["language ID"]} == kept
    now = {i: t for i, _, n, t in expected_lines(sorted(now.items()), 1) if not n or t.strip(" \n")}
    assert {r.doc_id: r.text for r in got["line dedup"]} == now
    assert all(r.n_chars == len(r.text) for r in got["line dedup"])
    now = {i: t for i, t in now.items() if expected_components(now, 5)[i][2]}
    assert {r.doc_id for r in got["MinHash near-dedup"]} == set(now)
    now = {i: t for i, t in now.items() if all(best(tokens(t), tokens(x)) < 10 for _, x in bench)}
    assert {r.doc_id for r in got["benchmark decontamination"]} == set(now) and 7 not in now
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in now.items()}
    by = {}
    for i, n in size.items():
        by[f"src{i % 3}"] = by.get(f"src{i % 3}", 0) + n
    taken = {}
    for r in got["mixing sources to target weights"]:
        taken[r.source] = taken.get(r.source, 0) + r.words
    assert all(abs(taken[s] - t) <= 1 for s, t in fair(by).items())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(got["mixing sources to target weights"])
