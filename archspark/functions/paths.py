"""Paths as columns: slash-separated, `.` for the root, byte order throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_STRINGS = "cast(array() as array<string>)"


def _sql(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it: expressions in expressions stay as long as they read."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def segments(path: Column | str) -> Column:
    """[] for the root, else the parts between slashes, empty ones included."""
    p = _sql(path)
    return F.when(p.isin("", "."), F.expr(NO_STRINGS)).otherwise(F.split(p, "/"))


def dirname(path: Column | str) -> Column:
    """What stands before the last slash, `.` without one."""
    return let(_sql(path), lambda p: F.when(F.instr(p, "/") == 0, F.lit(".")).otherwise(F.regexp_replace(p, "/[^/]*$", "")))


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(_sql(path), "/"), -1)


def node_key(path: Column | str, file_level: bool = False) -> Column:
    """The path itself for file nodes; for directory nodes the directory, wherever a dot makes it look like a file."""
    return _sql(path) if file_level else let(_sql(path), lambda p: F.when(F.instr(p, ".") == 0, p).otherwise(dirname(p)))


def is_file_glob(glob: Column | str) -> Column:
    """Whether the last segment has a dot, `.` and `..` apart."""
    last = basename(glob)
    return F.contains(last, F.lit(".")) & ~last.isin(".", "..")


def clean(path: Column | str) -> Column:
    """Lexically shortest form: no empty parts, no `.`, `..` taken back where something precedes it."""
    return let(_sql(path), _clean)


def _clean(p: Column) -> Column:
    fold = F.aggregate(
        F.split(p, "/"),
        F.expr(NO_STRINGS),
        lambda acc, s: F.when(s.isin("", "."), acc)
        .when((s == "..") & (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when((s == "..") & F.startswith(p, F.lit("/")), acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    return let(F.array_join(fold, "/"), lambda joined: F.when(F.startswith(p, F.lit("/")), F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined))


def join(base: Column | str, rest: Column | str) -> Column:
    return clean(F.concat(_sql(base), F.lit("/"), _sql(rest)))


def relative(base: Column | str, target: Column | str) -> Column:
    """The way from one clean path to another."""
    parts = lambda c: segments(F.ltrim(_sql(c), F.lit("/")))
    return let(F.struct(parts(base).alias("a"), parts(target).alias("b")), _way)


def _way(ends: Column) -> Column:
    a, b = ends["a"], ends["b"]
    # How many segments agree before the first that doesn't.
    common = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, same: F.struct((s["n"] + (s["on"] & same).cast("int")).alias("n"), (s["on"] & same).alias("on")), lambda s: s["n"])

    def joined(n: Column) -> Column:
        return F.concat_ws("/", F.array_repeat(F.lit(".."), F.size(a) - n), F.slice(b, n + 1, F.greatest(F.size(b) - n, F.lit(0))))

    return let(let(common, joined), lambda out: F.when(out == "", F.lit(".")).otherwise(out))


def escapes(rel: Column | str) -> Column:
    r = _sql(rel)
    return (r == "..") | F.startswith(r, F.lit("../"))


def ancestors(path: Column | str) -> Column:
    """The directories above an absolute path, nearest first, `/` last."""

    def up(parts: Column) -> Column:
        n = F.size(parts)
        every = F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.when(n - k == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, 1, n - k), "/")))
        return F.when(n > 1, every).otherwise(F.expr(NO_STRINGS))

    return let(F.split(_sql(path), "/"), up)
