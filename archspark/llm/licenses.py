"""Fuzzy search of short license notices.

Texts become lower-case words joined by single spaces. A notice that may have k edits is
split into k + 1 pieces, one of which any match must hold unchanged (pigeonhole); one
automaton finds all pieces of all notices, the windows around the hits are candidates, and
the regex library's bounded-error matching verifies them and gives span and edits: from
left to right, each match tightened to the best one that begins where it stands, and the
search goes on behind that. Base notices count where their words stand unchanged as whole
words.

Null and empty texts have no words and no findings. Rows are independent: repeated rows
and doc_ids give repeated results. Of findings at one place the order is by end, label,
base before others and edits. Very long texts are searched whole, each window by itself.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import map_rows
from .common import table

# Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Phrase, label and the edits allowed; the base phrases that are long enough may also have edits.
NOTICES = (
    ("general public license", "gpl", 2),
    ("all rights reserved", "reserved", 2),
    ("licensed under the apache license", "apache", 3),
    ("permission is hereby granted free of charge", "mit", 4),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("mozilla public license", "mpl", 2),
    ("released into the public domain", "public-domain", 3),
    ("creative commons attribution", "cc-attribution", 2),
    ("proprietary and confidential", "proprietary", 2),
)

SCHEMA = "doc_id long, n_words long, findings array<struct<label: string, base: boolean, start_word: long, end_word: long, edits: int, similarity: double, matched: string>>"

#: Bytes that separate words become spaces; A-Z become a-z; all others are parts of words.
_WORD_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD_BYTES).split()


def pieces(phrase: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece): edits + 1 pieces that cover the phrase."""
    cuts = [len(phrase) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def scanner(base: tuple = BASE, notices: tuple = NOTICES) -> Callable[..., Iterator[tuple]]:
    # With a space at either end a phrase matches whole words only.
    forms = [(f" {p} ", label, 0, True) for p, label in base] + [(f" {p} ", label, k, False) for p, label, k in notices]
    found_by: dict[str, list[tuple[int, int]]] = {}
    for i, (form, _, k, _) in enumerate(forms):
        for at, piece in pieces(form, k):
            found_by.setdefault(piece, []).append((i, at))
    seeds = ahocorasick.Automaton()
    for piece, of in found_by.items():
        seeds.add_word(piece, (len(piece), of))
    seeds.make_automaton()
    # Leftmost matching loses none; the best match within reach of it gives span and edits.
    within = [f"(?:{regex.escape(form, literal_spaces=True)}){{e<={k}}}" for form, _, k, _ in forms]
    first, best = [regex.compile(p) for p in within], [regex.compile(f"(?b){p}") for p in within]

    def fuzzy(i: int, text: str, lo: int, hi: int) -> Iterator[regex.Match]:
        form, _, k, _ = forms[i]
        while (m := first[i].search(text, lo, hi)) is not None:
            m = best[i].search(text, m.start(), min(hi, max(m.end(), m.start() + len(form) + 2 * k))) or m
            yield m
            # The space behind a notice may be the one before the next.
            lo = max(m.end() - 1, m.start() + 1)

    def windows(text: str) -> dict[int, list[list[int]]]:
        """For each form, disjoint stretches of text that hold all its matches."""
        out: dict[int, list[list[int]]] = {}
        for end, (n, of) in seeds.iter(text):
            for i, at in of:
                form, _, k, _ = forms[i]
                lo = max(0, end + 1 - n - at - k)
                hi = min(len(text), lo + len(form) + 2 * k)
                mine = out.setdefault(i, [])
                if mine and lo <= mine[-1][1]:
                    mine[-1][0], mine[-1][1] = min(lo, mine[-1][0]), max(hi, mine[-1][1])
                else:
                    mine.append([lo, hi])
        return out

    def row(doc_id, text) -> Iterator[tuple]:
        words = words_of(text)
        joined = f" {b' '.join(words).decode()} " if words else ""
        spans = []
        for i, stretches in windows(joined).items():
            form, label, k, is_base = forms[i]
            for lo, hi in stretches:
                if is_base:
                    at = joined.find(form, lo, hi)
                    while at >= 0:
                        spans.append((at, at + len(form), label, True, 0, form))
                        at = joined.find(form, at + 1, hi)
                    continue
                for m in fuzzy(i, joined, lo, hi):
                    spans.append((m.start(), m.end(), label, False, sum(m.fuzzy_counts), m.group()))
        exact = {(label, at) for at, _, label, is_base, _, _ in spans if is_base}
        findings, at, n = [], 0, 0
        for start, end, label, is_base, edits, matched in sorted(spans):
            if not is_base and not edits and (label, start) in exact:
                continue
            n, at = n + joined.count(" ", at, start), start
            # A match may begin within a word or at the space before it.
            first = n if joined[start] == " " else n - 1
            last = first + joined.count(" ", start + 1, end - 1)
            findings.append({"label": label, "base": is_base, "start_word": first, "end_word": last, "edits": edits, "similarity": 1 - edits / max(1, len(matched)), "matched": matched.strip()})
        yield doc_id, len(words), findings

    return row


def scan(docs: DataFrame, base: tuple = BASE, notices: tuple = NOTICES) -> DataFrame:
    """doc_id, text -> SCHEMA, one row for each row; findings in the order of the text."""
    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), SCHEMA, lambda: scanner(base, notices))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = scan(table(spark, sf_dir, "documents")).withColumn("own", F.filter("findings", lambda f: f["base"]))
    joined = lambda column: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(column, lambda f: f["label"]))))
    return made.select(
        "doc_id", "n_words", F.size("own").cast("long").alias("n_base"), F.array_min(F.transform("own", lambda f: f["start_word"])).alias("first_word"), F.array_max(F.transform("own", lambda f: f["start_word"])).alias("last_word"),
        joined("own").alias("base_labels"), joined("findings").alias("labels"), F.coalesce(F.array_max(F.transform("findings", lambda f: f["similarity"])), F.lit(0.0)).alias("score"),
    )
