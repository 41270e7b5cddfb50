"""Globs of contracts as columns, by way of regular expressions that Java and RE2 read alike.

A literal segment stands for itself; one `*` for any characters of a segment; of several,
the first takes at least one character. A trailing `**` takes the directory and all below,
or only what is below if the segment before it has a `*`. `.` and the empty glob are the root.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import _sql, is_file_glob, segments

_SPECIAL = r"([\\.\[\]{}()+?^$|])"


def _segment_py(seg: str) -> str:
    head, *rest = (re.sub(_SPECIAL, r"\\\1", part) for part in seg.split("*"))
    if not rest:
        return head
    return head + ("[^/]" if len(rest) > 1 else "") + "".join("[^/]*" + part for part in rest)


def regex_of(glob: str) -> str:
    """The regular expression of a literal glob, for tables that both engines read."""
    if glob in ("", "."):
        return r"^\.$"
    parts = glob.split("/")
    if parts == ["**"]:
        return "^.*$"
    if parts[-1] == "**":
        below = "(/.*)" if "*" in parts[-2] else "(/.*)?"
        return "^" + "/".join(map(_segment_py, parts[:-1])) + below + "$"
    return "^" + "/".join(map(_segment_py, parts)) + "$"


def segment_regex(seg: Column | str) -> Column:
    parts = F.split(F.regexp_replace(_sql(seg), _SPECIAL, r"\\$1"), r"\*")
    rest = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "[^/]*")
    return F.when(F.size(parts) == 1, F.get(parts, F.lit(0))).otherwise(F.concat(F.get(parts, F.lit(0)), F.when(F.size(parts) > 2, F.lit("[^/]")).otherwise(F.lit("")), F.lit("[^/]*"), rest))


def glob_regex(glob: Column | str) -> Column:
    """regex_of() for a column."""
    g = _sql(glob)
    parts = F.split(g, "/")
    deep = F.element_at(parts, -1) == "**"
    named = F.slice(parts, 1, F.size(parts) - F.when(deep, 1).otherwise(0))
    below = F.when(~deep, F.lit("")).when(F.contains(F.element_at(named, -1), F.lit("*")), F.lit("(/.*)")).otherwise(F.lit("(/.*)?"))
    return F.when(g.isin("", "."), F.lit(r"^\.$")).when(g == "**", F.lit("^.*$")).otherwise(F.concat(F.lit("^"), F.array_join(F.transform(named, segment_regex), "/"), below, F.lit("$")))


def owns(path: Column | str, regex: Column | str, glob: Column | str) -> Column:
    """Whether a glob with that regex matches a path; the root is for `.`, the empty glob and `**` alone."""
    p, g = _sql(path), _sql(glob)
    return F.rlike(p, _sql(regex)) & ((p != ".") | g.isin("", ".", "**"))


def specificity(glob: Column | str) -> Column:
    """10 for a literal segment, 3 for one with `*`, 1 for `**`; the root counts 0 beside other nodes."""
    return F.aggregate(segments(glob), F.lit(0), lambda a, s: a + F.when(s == "**", 1).when(F.contains(s, F.lit("*")), 3).otherwise(10))


def public_specificity(glob: Column | str) -> Column:
    """The same, but for the root, which counts as one literal segment."""
    g = _sql(glob)
    return F.when(g.isin("", "."), F.lit(10)).otherwise(specificity(g))


def _one_overlap(x: Column, y: Column) -> Column:
    """Whether two segments may match one text; two different ones with `*` may."""
    wild_x, wild_y = F.contains(x, F.lit("*")), F.contains(y, F.lit("*"))
    whole = lambda s: F.concat(F.lit("^"), segment_regex(s), F.lit("$"))
    return (x == y) | (wild_x & wild_y) | F.when(wild_x, F.rlike(y, whole(x))).when(wild_y, F.rlike(x, whole(y))).otherwise(F.lit(False))


def overlap(a: Column | str, b: Column | str) -> Column:
    """Whether two directory globs may own one path."""
    x, y = segments(a), segments(b)
    deep = lambda s: F.coalesce(F.get(s, F.size(s) - 1) == "**", F.lit(False))
    named = lambda s: F.when(deep(s), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(s)
    n, m = F.size(named(x)), F.size(named(y))
    # Beyond the shorter one only a trailing ** may go on.
    lengths = F.when(deep(x) & deep(y), F.lit(True)).when(deep(x), n <= m).when(deep(y), m <= n).otherwise(n == m)
    k = F.least(n, m)
    pairs = F.zip_with(F.slice(named(x), 1, k), F.slice(named(y), 1, k), _one_overlap)
    return lengths & F.forall(pairs, lambda ok: ok)


__all__ = ["glob_regex", "is_file_glob", "overlap", "owns", "public_specificity", "regex_of", "segment_regex", "specificity"]
