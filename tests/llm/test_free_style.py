"""Audio, licenses, language ID, URL filter."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from archspark.llm import audio, langid, licenses, urls


def test_audio_round_trip(docs, texts):
    got = audio.audio_features(docs).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        want = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r.n_bytes, bytes(r.payload)) == (len(raw), want) and audio.from_wave(bytes(r.media))[0] == want
        t = audio.read_tensors(bytes(r.tensors))
        assert t["log_mel"].type.shape == [audio.FRAMES, audio.MELS] and len(t) == -(-r.frames // audio.FRAMES)
        assert t["start_s"][0].as_py() == 0 and all(a.as_py() < b.as_py() for a, b in zip(t["start_s"], t["end_s"], strict=True))
    same = {bytes(r.payload): (r.mean_mel, r.segments) for r in got}
    assert all(same[bytes(r.payload)] == (r.mean_mel, r.segments) for r in got)
    assert zlib.crc32(b"") == 0 and hashlib.sha256(b"").hexdigest()


def test_resampling_is_the_direct_sum():
    x = np.random.default_rng(1).integers(0, 256, 4000).astype(np.uint8)
    got = audio.resample(x, audio.polyphase())
    n = audio.TAPS * audio.UP
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / audio.DOWN) * np.hamming(n)
    h *= audio.UP / h.sum()
    up = np.zeros(len(x) * audio.UP)
    up[:: audio.UP] = (x.astype(float) - 128) / 128
    want = np.convolve(up, h)[:: audio.DOWN][: len(got)]
    assert np.allclose(got, want, atol=1e-4)


def test_hysteresis_holds_between_thresholds():
    e = np.array([0, 0, 2, 0.5, -0.5, 0.5, -2, 0, 3, 0, 0, 0, 0, 0], float)
    assert audio.hysteresis(e - 0) == [(2, 5), (8, 13)]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_licenses_weaker_matches_before_a_better_one():
    notices = (("general public license", "gpl", 2),)
    row = licenses.scanner(base=(), notices=notices)
    spans = lambda text: [(f["start_word"], f["end_word"], f["edits"]) for f in next(row(1, text))[2]]
    assert spans("generel public licence general public license x generel public licence") == [(0, 2, 2), (3, 5, 0), (7, 9, 2)]
    assert spans("the general publc license general public license xx") == [(1, 3, 1), (4, 6, 0)]
    assert spans("general public license general public license") == [(0, 2, 0), (3, 5, 0)]


def test_licenses_base_and_fuzzy(spark):
    r = random.Random(9)
    parts = ["CC BY", "cc-by", "ccby", "General Public\nLicense", "all rights  reserved", "generel public license", "foo", "été", "x9", "mozila public licence", "general public licensed", "cc cc by by"]
    rows = [(i, " ".join(r.choice(parts) for _ in range(r.randint(0, 12)))) for i in range(80)] + [(80, None), (81, ""), (82, "cc by cc by")]
    got = {x.doc_id: x for x in licenses.scan(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, label int")).collect()}
    for i, t in rows:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        want = sorted((k, label) for p, label in licenses.BASE for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        assert got[i].n_words == len(words) and sorted((f.start_word, f.label) for f in got[i].findings if f.base) == want
    fuzzy = next(licenses.scanner()(1, "see the generel public license and the mozila public licence"))[2]
    assert [(f["label"], f["base"], f["edits"]) for f in fuzzy] == [("gpl", False, 1), ("mpl", False, 2)]


def test_pieces_cover_a_phrase():
    assert "".join(p for _, p in licenses.pieces("all rights reserved", 2)) == "all rights reserved"


SAMPLES = {"en": "the weather and the water were thought about with others there", "de": "der schnee und das wasser nicht ungewöhnlich schön geworden", "fr": "les oiseaux et la rivière étaient toujours près du château", "es": "los pájaros y la canción también están en el corazón"}


def language_rows(r, n, start=0):
    out = []
    for i in range(n):
        k = r.choice(list(SAMPLES))
        words = SAMPLES[k].split()
        out.append((start + i, " ".join(r.choice(words) for _ in range(r.randint(4, 40))), k, f"{k}.example.{'com' if i % 2 else k}"))
    return out


def test_language_held_out(spark):
    r = random.Random(8)
    train, held = language_rows(r, 300), language_rows(r, 120, 1000)
    odd = [(5000, None, "en", "a.b"), (5001, "", "fr", None), (5002, "12 34 !!", None, "x"), (5003, "zqxj kvwp qqzz xkcd jjqv wxyz " * 5, None, None)]
    rows = train + [(i, t, None, h) for i, t, _, h in held] + odd
    df = spark.createDataFrame([(*x, "e") for x in rows], "id long, text string, declared string, host string, score string")
    got = {x.id: x for x in langid.identify(df).collect()}
    assert len(got) == len(rows)
    assert sum(got[i].language == k for i, _, k, _ in held) >= 0.97 * len(held)
    assert [(got[i].language, got[i].kept) for i in (5000, 5001, 5002)] == [("und", False)] * 3
    assert all(got[i].kept for i, *_ in train)


def test_pages_give_markup_and_host(spark):
    df = spark.createDataFrame([(1, "https://WWW.Ex.org/a?b", "<html class=x lang='fr-CA'><script>no</script><p>les <b>mots</b></p>"), (2, None, None)], "page_id long, url string, html string")
    a, b = langid.pages_as_rows(df).collect()
    assert (a.declared, a.host, a.text.split()) == ("fr-CA", "www.ex.org", ["les", "mots"]) and (b.declared, b.host, b.text) == (None, None, None)


def test_pages_are_identified_by_markup_and_suffix(spark, tmp_path):
    from archspark.llm.entry import QUERIES

    r = random.Random(12)
    page = lambda i, t, k, h: (i, f"https://{h}/p", f"<html{f' lang={k}' if k else ''}><p>{t}</p>")
    rows = [page(*x) for x in language_rows(r, 300)]
    rows += [page(1000, "la", None, "new.es"), page(1001, "la", None, "new.fr"), page(1002, "la", "es", "x.org"), page(1003, "la", "fr", "x.org"), (1004, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {x.page_id: x for x in QUERIES["op10_language_id_pages"](spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted(x[0] for x in rows)
    assert [got[i].declared for i in (1000, 1002, 1003, 1004)] == [None, "es", "fr", None] and not got[1004].kept
    assert [got[i].language for i in (1002, 1003)] == ["es", "fr"]


def test_language_empty_table(no_docs):
    assert langid.identify(langid.documents_as_rows(no_docs)).collect() == []


def judged(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    listed = [v for h, p, v in urls.LISTED if (host == h or host.endswith("." + h)) and path.startswith(p)]
    top = max(fits, default=(0, None, None))
    return host, path, top[1], top[2] or (listed[0] if listed else urls.DEFAULT)


URLS = ["http://Example.com/en/x", "https://www.example.com/en/", "https://a.www.example.com/en/q#z", "http://notexample.com/en/", "http://x.net/es/1", "http://net/fr/?a", "http://x.net/de/", "http://example.com", "no scheme", None, "", "ftp://com/", "http://m.ads-track.example.org/p", "a://b://c/d", "http://x.example.com?x/en/", "http://" + "a." * 300 + "com/" + "y" * 5000]


@pytest.mark.parametrize("blocks", [1 << 17, 1])
def test_url_rules(spark, blocks, monkeypatch):
    monkeypatch.setattr(urls, "MAX_BLOCKS", blocks)
    rows = [(i, u, "k") for i, u in enumerate(URLS)] + [(0, URLS[0], "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = urls.judge(df, urls.listing(spark)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judged(r.url)


def test_url_filter_is_exact_on_a_long_list(spark):
    """A crowded filter passes more, and the join takes it out again."""
    entries = spark.range(3000).selectExpr("concat('h', id, '.org') as host", "concat('/', id % 5, '/') as path", "'block' as verdict", "true as is_rule")
    df = spark.range(4000).selectExpr("id as page_id", "concat('http://www.h', id, '.org/', id % 7, '/x') as url")
    got = urls.judge(df, entries)
    assert got.filter("verdict = 'block'").count() == sum(i < 3000 and i % 5 == i % 7 for i in range(4000))
    assert urls.judge(df.limit(0), entries).collect() == [] and urls.judge(df.limit(3), entries.limit(0)).filter("verdict = 'allow'").count() == 3
