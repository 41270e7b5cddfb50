"""Ignore rules: parsed, layered, the last one that matches decides.

Rules are rows: layer, ordinal, domain (segments of the directory they stand in), pattern.
A rule becomes one regular expression over the path below its domain, so evaluation is a
join on the domain with a match per rule, and the last by (layer, ordinal) wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths

_POSIX = {"alnum": "a-zA-Z0-9", "alpha": "a-zA-Z", "blank": " \\t", "cntrl": "\\x00-\\x1f\\x7f", "digit": "0-9", "graph": "\\x21-\\x7e", "lower": "a-z", "print": "\\x20-\\x7e", "punct": "!-/:-@\\[-`{-~", "space": " \\t\\n\\x0b\\f\\r", "upper": "A-Z", "xdigit": "0-9a-fA-F"}


def lines(files: DataFrame) -> DataFrame:
    """(dir, rank, content) -> (dir, rank, line_no, line): trimmed, without blanks and comments."""
    rows = files.select("dir", "rank", F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("line_no", "raw"))
    return rows.withColumn("line", F.regexp_replace("raw", r"^[\t\n\f\r ]+|[\t\n\f\r ]+$", "")).filter((F.col("line") != "") & ~F.startswith(F.col("line"), F.lit("#"))).drop("raw")


def parse(rules: DataFrame) -> DataFrame:
    """Adds inclusion, dir_only, anchored (a slash within) and segs to rows with `line`."""
    body = F.regexp_replace("line", "^!", "")
    body = F.when(F.rlike(body, F.lit(r"\\ +$")), body).otherwise(F.rtrim(body))
    bare = F.regexp_replace(body, "/$", "")
    return rules.withColumns({"inclusion": F.startswith(F.col("line"), F.lit("!")), "dir_only": F.endswith(body, F.lit("/")), "anchored": F.contains(bare, F.lit("/")), "segs": F.split(bare, "/")})


def segment_regex(pattern: str) -> str:
    """One segment of a rule: `*`, `?`, `\\x`, `[...]` with `!` or `^`, ranges and POSIX classes. An unknown class matches nothing."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += _literal(pattern[i])
        elif c == "[" and (end := _bracket_end(pattern, i)) > 0:
            out += _bracket(pattern[i + 1 : end])
            i = end
        else:
            out += _literal(c)
        i += 1
    return out


def _literal(c: str) -> str:
    return "\\" + c if c in r"\.[]{}()+?^$|*-" else c


def _bracket_end(p: str, start: int) -> int:
    i = start + 1
    if p[i : i + 1] in ("!", "^"):
        i += 1
    if p[i : i + 1] == "]":
        i += 1
    while i < len(p):
        if p[i] == "\\":
            i += 1
        elif p.startswith("[:", i) and (close := p.find(":]", i + 2)) > 0:
            i = close + 1
        elif p[i] == "]":
            return i
        i += 1
    return -1


def _bracket(body: str) -> str:
    negated, out, i = body[:1] in ("!", "^"), "", 0
    body = body[1:] if negated else body
    while i < len(body):
        if body.startswith("[:", i) and (close := body.find(":]", i + 2)) > 0:
            name = body[i + 2 : close]
            if name not in _POSIX:
                return "[^\\x00-\\x{10FFFF}]"
            out += _POSIX[name]
            i = close + 2
            continue
        if body[i] == "\\" and i + 1 < len(body):
            i += 1
        c = body[i]
        is_range = c == "-" and 0 < i < len(body) - 1
        out += "-" if is_range else "\\" + c if c in "\\[]^-&" else c
        i += 1
    return f"[{'^/' if negated else ''}{out}]"


def rule_regex(line: str) -> tuple[str, bool, bool]:
    """(regex, only directories, inclusion) of a rule's line, over the path below its domain with `/` after directories.

    An anchored rule also matches what lies below the path it names; a simple name matches
    any component. A rule for directories needs the slash after what it names.
    """
    inclusion = line.startswith("!")
    body = line[1:] if inclusion else line
    body = body if body.endswith("\\ ") else body.rstrip(" ")
    dir_only = body.endswith("/")
    body = body[:-1] if dir_only else body
    tail = "/.*$" if dir_only else "(/.*)?$"
    if "/" not in body:
        return f"^(.*/)?{segment_regex(body)}{tail}", dir_only, inclusion
    parts = body.removeprefix("/").split("/")
    out = "^"
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out += ".+" if last else "(.*/)?"
        else:
            out += segment_regex(part) + ("" if last else "/")
    return out + tail, dir_only, inclusion


def verdicts(at: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, is_dir) with rules (layer, ordinal, domain, regex, inclusion) -> (path, is_dir, ignored).

    domain is a directory, `.` for the top; paths are relative to the top. Rules of a
    domain only see paths below it. Rules are joined by the directories above each path.
    """
    above = F.concat(F.array(F.lit(".")), F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k), "/")))
    rows = at.select("path", "is_dir", F.explode(F.slice(above, 1, F.size(above) - 1)).alias("domain")).join(rules, "domain")
    below = F.when(F.col("domain") == ".", F.col("path")).otherwise(F.substring(F.col("path"), F.length("domain") + 2, F.length("path")))
    seen = F.concat(below, F.when(F.col("is_dir"), F.lit("/")).otherwise(F.lit("")))
    hit = rows.filter(F.rlike(seen, F.col("regex")))
    last = hit.groupBy("path", "is_dir").agg(F.max_by("inclusion", F.struct("layer", "ordinal")).alias("inclusion"))
    return at.join(last, ["path", "is_dir"], "left").select("path", "is_dir", F.coalesce(~F.col("inclusion"), F.lit(False)).alias("ignored"))


def prune(found: DataFrame) -> DataFrame:
    """(path, is_dir, ignored) -> the rows a walk reaches: an ignored directory hides all below it, whatever rules say there."""
    hidden = found.filter("ignored and is_dir").select(F.col("path").alias("above"))
    parents = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k), "/"))
    below = found.filter(F.contains(F.col("path"), F.lit("/"))).select("path", F.explode(parents).alias("above")).join(hidden, "above", "left_semi").select("path").distinct()
    return found.filter(~F.col("ignored")).join(below, "path", "left_anti")


def simple_name_matches(path: Column | str, regex: Column | str) -> Column:
    """Whether any component matches."""
    return F.exists(paths.segments(path), lambda s: F.rlike(s, F.col(regex) if isinstance(regex, str) else regex))
