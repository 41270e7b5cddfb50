"""Text columns: positions, codecs of contract files, messages, versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import _sql

# What stands for each character in a node id.
ID_TOKENS = (
    ("/", "_slash_"), (".", "_dot_"), ("-", "_dash_"), ("*", "_asterisk_"), ("@", "_atsign_"), ("[", "_lsqb_"), ("]", "_rsqb_"), ("{", "_lbrace_"), ("}", "_rbrace_"),
    ("+", "_plus_"), ("?", "_qmark_"), (",", "_comma_"), (" ", "_space_"), ("\t", "_tab_"), ("\n", "_newline_"), ("\r", "_carriage_return_"), ("\x0b", "_vertical_tab_"), ("\x0c", "_form_feed_"),
)


def line_number(text: Column | str, offset: Column | str) -> Column:
    """1-based line of a byte offset."""
    before = F.substring(_sql(text).cast("binary"), F.lit(1), _sql(offset)).cast("string")
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def byte_column(text: Column | str, offset: Column | str) -> Column:
    """1-based column of a byte offset, in bytes."""
    before = F.substring(_sql(text).cast("binary"), F.lit(1), _sql(offset)).cast("string")
    return F.octet_length(F.substring_index(before, "\n", -1)) + 1


def encode_id(node_id: Column | str) -> Column:
    raw = _sql(node_id)
    out = raw
    # A character's token has none of the other characters, so one after the other will do.
    for char, token in ID_TOKENS:
        out = F.replace(out, F.lit(char), F.lit(token))
    return F.when(raw.isin("", "."), F.lit("root")).when(F.rlike(out, F.lit("^[0-9]")), F.concat(F.lit("n"), out)).otherwise(out)


def decode_id(text: Column | str) -> Column:
    raw = _sql(text)
    out = F.regexp_replace(raw, "^n(?=[0-9])", "")
    for char, token in ID_TOKENS:
        out = F.replace(out, F.lit(token), F.lit(char))
    return F.when(raw == "root", F.lit(".")).otherwise(out)


def encode_glob(glob: Column | str) -> Column:
    return F.replace(_sql(glob), F.lit("*"), F.lit("&ast;"))


def decode_glob(text: Column | str) -> Column:
    return F.replace(F.replace(_sql(text), F.lit("&ast;"), F.lit("*")), F.lit("&#42;"), F.lit("*"))


def quoted(text: Column | str) -> Column:
    """A double-quoted literal with backslash escapes."""
    out = F.replace(F.replace(_sql(text), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for char, escape in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        out = F.replace(out, F.lit(char), F.lit(escape))
    return F.concat(F.lit('"'), out, F.lit('"'))


def relation_message(file: Column, line: Column, col: Column, src: Column, target: Column, dst: Column, contract: Column) -> Column:
    return F.concat(_edge(file, line, col, src, target, dst), F.lit(" — relation not allowed (add edge in "), contract, F.lit(" or move the file)"))


def endophobic_message(file: Column, line: Column, col: Column, src: Column, target: Column, contract: Column) -> Column:
    return F.concat(_edge(file, line, col, src, target, src), F.lit(" — "), src, F.lit(" is endophobic ("), contract, F.lit(")"))


def _edge(file: Column, line: Column, col: Column, src: Column, target: Column, dst: Column) -> Column:
    return F.concat(file, F.lit(":"), line.cast("string"), F.lit(":"), col.cast("string"), F.lit(" ("), src, F.lit(") → "), target, F.lit(" ("), dst, F.lit(")"))


def no_node_message(file: Column, contract: Column) -> Column:
    return F.concat(file, F.lit(" is tracked by "), contract, F.lit(" but matches no node"))


def import_no_node_message(file: Column, line: Column, col: Column, path: Column, contract: Column) -> Column:
    return F.concat(file, F.lit(":"), line.cast("string"), F.lit(":"), col.cast("string"), F.lit(": import "), quoted(path), F.lit(" matches no node in "), contract)


def contract_message(message: Column, contract: Column, line: Column) -> Column:
    """With the place appended: (path:line), or (path) without a line."""
    return F.concat(message, F.lit(" ("), contract, F.when(F.coalesce(line, F.lit(0)) > 0, F.concat(F.lit(":"), line.cast("string"))).otherwise(F.lit("")), F.lit(")"))


def without_place(message: Column | str) -> Column:
    return F.regexp_replace(_sql(message), r" \([^()]*\)$", "")


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, F.lit(one)).otherwise(F.lit(many)))


def version(text: Column | str) -> Column:
    """struct(major, minor, patch) of v1.2.3-suffix, null if it isn't one; compares as structs do."""
    t = _sql(text)
    bare = F.regexp_replace(F.regexp_replace(t, "^v", ""), "[-+].*$", "")
    part = lambda i: F.regexp_extract(bare, r"^([0-9]+)\.([0-9]+)\.([0-9]+)$", i)
    return F.when(F.rlike(bare, F.lit(r"^[0-9]+\.[0-9]+\.[0-9]+$")), F.struct(part(1).cast("int").alias("major"), part(2).cast("int").alias("minor"), part(3).cast("int").alias("patch")))
