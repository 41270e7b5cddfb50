"""URL filter: a blocked Bloom filter in front of an exact hash join.

The list has canonical entries (host, path): an entry fits its host and all subdomains
where the URL's path starts with the entry's. A URL's candidates are the suffixes of its
host with the prefixes of its path that have the length of some entry's. Each block of the
filter is eight words of 32 bits; a key sets one bit in each word of one block. The filter
is an aggregate over the list (bit_or by block), broadcast up to MAX_BLOCKS rows and dealt
out by block with the candidates beyond; its hits alone go on to the exact join, which
removes false positives. The longest fitting entry wins, by host and path together, then
by host, then by text.

A URL without `://`, or null, has an empty host and path. Host and path are functions of
the URL, so what is joined back are distinct URLs: repeated rows and one very frequent URL
or host meet no large group. Very long URLs have as many candidates as labels and lengths
of listed paths. An empty list leaves the method's verdict everywhere; an empty table of
pages gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, settle, table

# The rules of the query.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: What else the list holds, for URLs that no rule fits: these hosts, and as many made-up ones
#: as a blocklist in use has (`t<number>.adhost.example`); and the verdict without any entry.
LISTED, FILLER, DEFAULT = (("ads-track.example.org", "/", "block"), ("spam-farm.example.org", "/", "block")), 200_000, "allow"

KEYS_PER_BLOCK, MAX_BLOCKS, WORDS = 16, 1 << 17, 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SHAPE = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _SHAPE, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SHAPE, 2), F.lit(""))


def listing(spark: SparkSession, rules: tuple = RULES, listed: tuple = LISTED, filler: int = FILLER) -> DataFrame:
    """host, path, verdict, is_rule."""
    rows = [(h, p, v, True) for h, p, v in rules] + [(h, p, v, False) for h, p, v in listed]
    named = spark.createDataFrame(rows, "host string, path string, verdict string, is_rule boolean")
    made = spark.range(filler).select(F.format_string("t%d.adhost.example", "id").alias("host"), F.lit("/").alias("path"), F.lit("block").alias("verdict"), F.lit(False).alias("is_rule"))
    return named.union(made)


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("host", "path"), F.lit(blocks))


def _bits() -> list[Column]:
    """A bit for each word, from a second hash."""
    return [F.expr(f"shiftleft(1, cast(pmod(shiftright(xxhash64('bits', host, path), {5 * i}), 32) as int))") for i in range(WORDS)]


def bloom(entries: DataFrame, blocks: int) -> DataFrame:
    """block, w0 to w7."""
    rows = entries.select(_block(blocks).alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(_bits())])
    return rows.groupBy("block").agg(*[F.bit_or(f"b{i}").alias(f"w{i}") for i in range(WORDS)])


def matches(urls: DataFrame, entries: DataFrame) -> DataFrame:
    """Distinct url -> url, top_rule and top_listed: the longest entries that fit, as struct(size, host_size, entry, verdict)."""
    entries = settle(entries.select("host", "path", "verdict", "is_rule").filter("host is not null and path is not null").distinct(), "url-list")
    n = entries.count()
    blocks = 1 << max(0, (-(-n // KEYS_PER_BLOCK) - 1).bit_length())
    lengths = sorted(r[0] for r in entries.select(F.length("path")).distinct().collect())  # lengths of paths, not paths
    most = entries.agg(F.max(F.length("host"))).first()[0] or 0
    own = urls.select("url", host_of(F.col("url")).alias("full"), path_of(F.col("url")).alias("whole"))
    # Every place where a label begins, if what follows isn't longer than any listed host.
    own = own.withColumn("labels", F.split("full", r"\."))
    own = own.withColumn("hosts", F.expr(f"filter(transform(sequence(greatest(1, size(labels) - {most + 1}), size(labels)), i -> concat_ws('.', slice(labels, i, size(labels)))), h -> length(h) <= {most})"))
    paths = F.expr(f"transform(filter(cast(array({', '.join(map(str, lengths))}) as array<int>), k -> k <= length(whole)), k -> substring(whole, 1, k))")
    own = own.select("url", F.explode("hosts").alias("host"), paths.alias("paths")).select("url", "host", F.explode("paths").alias("path"))
    keyed = own.withColumn("block", _block(blocks))
    passes = " and ".join(f"(w{i} & b{i}) = b{i}" for i in range(WORDS))
    for i, bit in enumerate(_bits()):
        keyed = keyed.withColumn(f"b{i}", bit)
    possible = keyed.join(broadcast_if_small(bloom(entries, blocks), blocks, MAX_BLOCKS), "block").filter(passes).select("url", "host", "path")
    hit = possible.join(entries, ["host", "path"])
    top = lambda cond: F.max(F.when(cond, F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("entry"), "verdict")))
    return hit.groupBy("url").agg(top(F.col("is_rule")).alias("top_rule"), top(~F.col("is_rule")).alias("top_listed"))


def judge(pages: DataFrame, entries: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, url -> page_id, url, host, path, rule, verdict; one row for each row."""
    pages = pages.select("page_id", "url")
    found = matches(pages.select("url").filter("url is not null").distinct(), entries)
    out = pages.join(found, "url", "left")
    verdict = F.coalesce("top_rule.verdict", "top_listed.verdict", F.lit(default))
    return out.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("top_rule.entry").alias("rule"), verdict.alias("verdict"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), listing(spark)).drop("url")


_ROWS = lambda rows: ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rows)
ORACLE = rf"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '{_SHAPE}', 1), ''), '{_UPPER}', '{_LOWER}') AS host, coalesce(regexp_extract(url, '{_SHAPE}', 2), '') AS path,
         row_number() OVER () AS k FROM pages),
r(rh, rp, rv) AS (VALUES {_ROWS(RULES)}),
l(rh, rp, rv) AS (VALUES {_ROWS(LISTED)}),
m AS (SELECT 't' || range || '.adhost.example' AS mh FROM range({FILLER})),
fr AS (SELECT k, arg_max(rh || rp, length(rh) + length(rp)) AS rule, arg_max(rv, length(rh) + length(rp)) AS v FROM u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY k),
fl AS (SELECT k, arg_max(rv, length(rh) + length(rp)) AS v FROM u JOIN l ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY k),
fm AS (SELECT DISTINCT k, 'block' AS v FROM u JOIN m ON regexp_extract(host, '(?:^|\.)([^.]*\.adhost\.example)$', 1) = mh AND starts_with(path, '/'))
SELECT page_id, host, path, fr.rule, coalesce(fr.v, fl.v, fm.v, '{DEFAULT}') AS verdict FROM u LEFT JOIN fr USING (k) LEFT JOIN fl USING (k) LEFT JOIN fm USING (k)
"""
