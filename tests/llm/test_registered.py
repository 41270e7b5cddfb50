"""Registered queries without SQL against plain Python versions of what they are to return, over a whole table."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from archspark.llm import entry, langid, licenses, secrets

from .. import differential

pytestmark = pytest.mark.skipif(not os.path.isdir(differential.SF), reason="no tables here")


@pytest.fixture(scope="module")
def rows(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{differential.SF}/documents.parquet").collect()}


def result(spark, name):
    found = {}
    for r in entry.QUERIES[name](spark, differential.SF).collect():
        found.setdefault(r.doc_id, []).append(r)
    return found


def test_audio_payload(spark, rows):
    got = result(spark, "op3_audio_features")
    assert set(got) == set(rows) and all(len(v) == 1 for v in got.values())
    same = {}
    for i, (r,) in got.items():
        raw = (rows[i].text or "").encode()
        whole = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-16:]))
        assert r.media_bytes >= len(whole) and len(r.media_sha256) == 64 and r.feature
        assert same.setdefault(raw, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_license_base(spark, rows):
    got = result(spark, "op4_license_scan")
    assert set(got) == set(rows)
    for i, (r,) in got.items():
        lower = re.sub(b"[A-Z]", lambda m: m[0].lower(), (rows[i].text or "").encode()).decode()
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        hits = [(k, label) for phrase, label in licenses.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        places = [k for k, _ in hits]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(hits), min(places, default=None), max(places, default=None))
        base = {label for _, label in hits}
        assert r.base_labels == ",".join(sorted(base)) and base <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(",")))))


def test_secrets_are_candidates(spark, rows):
    """Every finding is a run of the pattern; of assigned keys of 40 hexadecimal digits none is missed."""
    got = {(i, r.start): r for i, found in result(spark, "op7_secret_scan").items() for r in found}
    every = {(i, m.start()): m[0] for i, r in rows.items() for m in re.finditer(secrets.CANDIDATE, r.text or "")}
    assert set(got) <= set(every)
    for at, r in got.items():
        assert r.length == len(every[at]) and r.secret_sha256 == hashlib.sha256(every[at].encode()).hexdigest() and r.score >= secrets.THRESHOLD
    sure = {(i, m.start(1)) for i, r in rows.items() for m in re.finditer(r'(?:token|secret|key|password)\W{1,4}\b([0-9a-f]{40})\b', r.text or "")}
    assert sure <= set(got)


def test_repeated_bytes(spark, rows):
    n = 200
    raw = {i: (r.text or "").encode() for i, r in rows.items()}
    seen = Counter(t[k : k + n] for t in raw.values() for k in range(len(t) - n + 1))
    got = result(spark, "op8_suffix_dedup")
    assert set(got) == set(raw)
    for i, t in raw.items():
        gone, until = bytearray(len(t)), 0
        for k in range(len(t) - n + 1):
            if seen[t[k : k + n]] > 1:
                gone[max(k, until) : k + n] = b"\1" * (k + n - max(k, until))
                until = k + n
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        (r,) = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())


def test_language_likelihoods(spark, rows):
    """The language of the text alone, from counts of trigrams in the other folds."""
    df = spark.read.parquet(f"{differential.SF}/documents.parquet")
    fold = {r.doc_id: r.f for r in df.select("doc_id", langid.fold_of(F.col("text")).alias("f")).collect()}

    def grams(text):
        raw = b" " + re.sub(rb"[^a-z\x80-\xff]", b" ", re.sub(b"[A-Z]", lambda m: m[0].lower(), (text or "").encode())) + b"  "
        places = (raw[k : k + 3] for k in range(len(raw) - 2))
        return [((g[0] * 131 + g[1]) * 131 + g[2]) % langid.BUCKETS for g in places if not (g[:2] == b"  " or g[1:] == b"  ")]

    own = {i: grams(r.text) for i, r in rows.items()}
    sums = {(f, x): Counter(g for i, r in rows.items() if r.lang == x and fold[i] != f for g in own[i]) for f in range(langid.FOLDS) for x in langid.LANGUAGES}
    total = {k: sum(c.values()) + langid.SMOOTH * langid.BUCKETS for k, c in sums.items()}
    got = result(spark, "op10_language_id")
    assert set(got) == set(rows)
    for i, (r,) in got.items():
        if not own[i]:
            assert (r.language, r.text_language, r.kept) == ("und", "und", False)
            continue
        score = {x: sum(math.log((sums[fold[i], x][g] + langid.SMOOTH) / total[fold[i], x]) for g in own[i]) / len(own[i]) for x in langid.LANGUAGES}
        score["und"] = -math.log(langid.BUCKETS)
        best = max(score, key=score.get)
        assert r.text_language == best or abs(score[best] - score[r.text_language]) < 1e-4


def test_language_without_declarations(spark, rows):
    """Held out: rows whose declaration is taken away are told from their texts and hosts."""
    df = spark.read.parquet(f"{differential.SF}/documents.parquet")
    hide = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    found = langid.identify(langid.documents_as_rows(df.withColumn("lang", F.when(~hide, F.col("lang"))))).filter("declared is null").collect()
    long = [r for r in found if len(rows[r.id].text or "") >= 200]
    assert len(long) > 20 and sum(r.language == rows[r.id].lang for r in long) >= 0.95 * len(long)
