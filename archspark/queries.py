"""Queries over the analytic tables, one for each operator, with their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import globs, paths, text
from .languages import LANGUAGES, resolve_languages, scannable
from .languages import resolve as targets
from .languages.registry import KOTLIN_PREFIXES
from .operators import ignore, match, validate
from .plans import casts
from .plans.check import Check, distinct_errors, summarise, verdicts
from .plans.casts import EDGES_SQL, KEY_SQL, LINKS, NODES_SQL, PAGES, literal, owners_sql, pages, values
from .schema import PALETTES
from .sources import contracts, discover, files as trees
from .sources.shared import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


# ---- paths -----------------------------------------------------------------


@query(f"SELECT page_id, rel, CASE WHEN rel IN ('', '.') THEN CAST([] AS VARCHAR[]) ELSE string_split(rel, '/') END AS segments FROM ({PAGES})")
def path_segments(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", "rel", paths.segments("rel").alias("segments"))


@query(f"SELECT page_id, CASE WHEN instr(rel, '/') = 0 THEN '.' ELSE regexp_replace(rel, '/[^/]*$', '') END AS dir, regexp_extract(rel, '([^/]*)$', 1) AS base FROM ({PAGES})")
def path_dirname(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", paths.dirname("rel").alias("dir"), paths.basename("rel").alias("base"))


@query(f"SELECT page_id, {KEY_SQL.format('rel')} AS dir_key, rel AS file_key FROM ({PAGES})")
def path_node_key(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", paths.node_key("rel").alias("dir_key"), paths.node_key("rel", True).alias("file_key"))


PART_GLOB = "lower(replace(p_brand || '/' || p_type, ' ', '/'))"


@query(f"SELECT p_partkey, g AS pattern, contains(regexp_extract(g, '([^/]*)$', 1), '.') AS is_file FROM (SELECT p_partkey, {PART_GLOB} || CASE p_partkey % 4 WHEN 0 THEN '.x' WHEN 1 THEN '/**' WHEN 2 THEN '/a.b/c*' ELSE '' END AS g FROM part)")
def path_is_file_glob(spark, sf_dir):
    g = F.concat(F.lower(F.replace(F.concat_ws("/", "p_brand", "p_type"), F.lit(" "), F.lit("/"))), F.element_at(F.array(*map(F.lit, (".x", "/**", "/a.b/c*", ""))), (F.col("p_partkey") % 4 + 1).cast("int")))
    return casts.read(spark, sf_dir, "part").select("p_partkey", g.alias("pattern")).withColumn("is_file", paths.is_file_glob("pattern"))


_TYPE = "replace(p_brand || '/' || p_type, ' ', '/')"
_TARGET = f"CASE p_partkey % 4 WHEN 0 THEN {_TYPE} || '/' || p_size WHEN 1 THEN regexp_replace({_TYPE}, '/[^/]*$', '/' || p_size) WHEN 2 THEN split_part({_TYPE}, '/', 1) ELSE p_size || '/' || {_TYPE} END"
_SHARED = "len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i]))"
_TO = f"array_to_string(list_concat(list_transform(range(len(a) - {_SHARED}), lambda i: '..'), b[{_SHARED} + 1:]), '/')"


@query(f"SELECT p_partkey, base, target, rel, rel = '..' OR starts_with(rel, '../') AS escapes FROM (SELECT *, CASE WHEN {_TO} = '' THEN '.' ELSE {_TO} END AS rel FROM (SELECT *, string_split(base, '/') AS a, string_split(target, '/') AS b FROM (SELECT p_partkey, {_TYPE} AS base, {_TARGET} AS target FROM part)))")
def path_relative(spark, sf_dir):
    size, base = F.col("p_size").cast("string"), F.replace(F.concat_ws("/", "p_brand", "p_type"), F.lit(" "), F.lit("/"))
    target = F.element_at(F.array(F.concat_ws("/", base, size), F.concat_ws("/", F.regexp_replace(base, "/[^/]*$", ""), size), F.split(base, "/")[0], F.concat_ws("/", size, base)), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = casts.read(spark, sf_dir, "part").select("p_partkey", base.alias("base"), target.alias("target"))
    return rows.withColumn("rel", paths.relative("base", "target")).withColumn("escapes", paths.escapes("rel"))


CLEAN = [("a//b/./c", "a/b/c"), ("a/../b", "b"), ("../x", "../x"), ("/../x", "/x"), ("", "."), ("./", "."), ("a/b/../..", "."), ("a/../../b", "../b"), ("/a/b/", "/a/b")]


@query(f"SELECT path, want AS clean FROM {values('path, want', CLEAN)}")
def path_clean(spark, sf_dir):
    return literal(spark, "path string, want string", CLEAN).select("path", paths.clean("path").alias("clean"))


# ---- globs -----------------------------------------------------------------

SEGMENTS = ["en", "e*", "*n", "1*9", "*.html", "*1*2*", "*", "f?", "a.b"]
# The same for SQL; between two asterisks and before the next text stands one more character at least.
SEGMENTS_MEANT = ["^en$", "^e", "n$", "^1.*9$", r"[.]html$", "^..*1.*2", "", "^f[?]$", "^a[.]b$"]


@query(f"SELECT page_id, pattern, count(*) AS n FROM (SELECT page_id, unnest(string_split(rel, '/')) AS seg FROM ({PAGES})) s, {values('pattern, rx', list(zip(SEGMENTS, SEGMENTS_MEANT)))} WHERE regexp_matches(seg, rx) GROUP BY ALL")
def glob_segment_match(spark, sf_dir):
    rows = pages(spark, sf_dir).select("page_id", F.explode(F.split("rel", "/")).alias("seg"))
    rows = rows.crossJoin(F.broadcast(literal(spark, "pattern string", SEGMENTS)))  # the patterns are a fixed few
    return rows.filter(F.rlike("seg", F.concat(F.lit("^"), globs.segment_regex("pattern"), F.lit("$")))).groupBy("page_id", "pattern").agg(F.count(F.lit(1)).alias("n"))


GLOBS = [".", "", "**", "en/**", "en/1*/**", "fr", "fr/*", "*/1*", "de/*.html", "*/*/*", "en/*1*2", "es/**/x"]
GLOBS_MEANT = ["^[.]$", "^[.]$", "", "^en($|/)", "^en/1[^/]*/", "^fr$", "^fr/[^/]*$", "^[^/]*/1[^/]*$", "^de/[^/]*[.]html$", "^[^/]*/[^/]*/[^/]*$", "^en/[^/]+1[^/]*2$", "^es/[^/][^/]+/x$"]
_GLOB_SQL = values("pat, rx", list(zip(GLOBS, GLOBS_MEANT)))


@query(f"SELECT pat AS pattern, p AS path FROM (SELECT DISTINCT {KEY_SQL.format('rel')} AS p FROM ({PAGES})) k, {_GLOB_SQL} WHERE regexp_matches(p, rx) AND (p <> '.' OR pat IN ('', '.', '**'))")
def glob_dir_match(spark, sf_dir):
    keys = pages(spark, sf_dir).select(paths.node_key("rel").alias("path")).distinct()
    return keys.crossJoin(F.broadcast(literal(spark, "glob string", GLOBS).withColumn("regex", globs.glob_regex("glob")))).filter(globs.owns("path", "regex", "glob")).select(F.col("glob").alias("pattern"), "path")


@query(f"SELECT pat AS pattern, rel AS path FROM (SELECT DISTINCT rel FROM ({PAGES})) k, {_GLOB_SQL} WHERE contains(regexp_extract(pat, '([^/]*)$', 1), '.') AND pat <> '.' AND regexp_matches(rel, rx)")
def glob_file_match(spark, sf_dir):
    own = literal(spark, "glob string", GLOBS).filter(paths.is_file_glob("glob")).withColumn("regex", globs.glob_regex("glob"))
    return pages(spark, sf_dir).select(F.col("rel").alias("path")).distinct().crossJoin(F.broadcast(own)).filter(globs.owns("path", "regex", "glob")).select(F.col("glob").alias("pattern"), "path")


_SPEC = "list_sum(list_transform(string_split(g, '/'), lambda s: CASE WHEN s = '**' THEN 1 WHEN contains(s, '*') THEN 3 ELSE 10 END))"


@query(f"SELECT p_partkey, CAST({_SPEC} AS INTEGER) AS specificity FROM (SELECT p_partkey, {PART_GLOB} || CASE p_partkey % 3 WHEN 0 THEN '/**' WHEN 1 THEN '/a*' ELSE '' END AS g FROM part)")
def glob_specificity(spark, sf_dir):
    g = F.concat(F.lower(F.replace(F.concat_ws("/", "p_brand", "p_type"), F.lit(" "), F.lit("/"))), F.element_at(F.array(*map(F.lit, ("/**", "/a*", ""))), (F.col("p_partkey") % 3 + 1).cast("int")))
    return casts.read(spark, sf_dir, "part").select("p_partkey", globs.specificity(g).alias("specificity"))


OVERLAPS = [("a/**", "a/b", True), ("a/**", "b/**", False), ("a/*", "a/b", True), ("a/*", "a/b/c", False), ("a*/**", "b*/**", True), ("x/a*", "x/*b", True), ("x/abc", "x/a*", True), ("x/bcd", "x/a*", False), ("**", "q", True), ("a/b/**", "a", False), ("a/*/c", "a/b/c", True), (".", "**", True)]


@query(f"SELECT a, b, want AS overlap FROM {values('a, b, want', OVERLAPS)}")
def glob_overlap_pairs(spark, sf_dir):
    return literal(spark, "a string, b string, want boolean", OVERLAPS).select("a", "b", globs.overlap("a", "b").alias("overlap"))


# ---- text ------------------------------------------------------------------


@query("SELECT doc_id, strlen(text) AS n, CAST(len(string_split(text, chr(10))) AS INTEGER) AS line, CAST(strlen(string_split(text, chr(10))[-1]) + 1 AS INTEGER) AS col FROM documents")
def text_line_col(spark, sf_dir):
    """The place of the end of every text, in bytes."""
    rows = casts.read(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length("text").alias("n"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n"), text.line_number("text", "n").cast("int").alias("line"), text.byte_column("text", "n").cast("int").alias("col"))


@query(f"""SELECT page_id, rel || ' is tracked by C.md but matches no node' AS no_node, rel || ':' || page_id || ':7: import "' || replace(replace(url, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '" matches no node in C.md' AS import_no_node,
rel || ':' || page_id || ':7 (a) → ' || capsule || ' (b) — relation not allowed (add edge in C.md or move the file)' AS relation FROM ({PAGES}) JOIN (SELECT page_id, url FROM pages) USING (page_id)""")
def message_format(spark, sf_dir):
    rows = pages(spark, sf_dir).join(casts.read(spark, sf_dir, "pages").select("page_id", "url"), "page_id")
    file, line, col, c = F.col("rel"), F.col("page_id"), F.lit(7), F.lit("C.md")
    return rows.select("page_id", text.no_node_message(file, c).alias("no_node"), text.import_no_node_message(file, line, col, F.col("url"), c).alias("import_no_node"), text.relation_message(file, line, col, F.lit("a"), F.col("capsule"), F.lit("b"), c).alias("relation"))


IDS = ["a/b.c", "x-y z", ".", "", "9lives", "v1.2/*", "a_b", "@scope/{x}", "tab\there", "n1"]
_ENCODE = "id"
for _char, _token in text.ID_TOKENS:
    _ENCODE = f"replace({_ENCODE}, {'chr(' + str(ord(_char)) + ')'}, '{_token}')"
_DECODE = "CASE WHEN regexp_matches(e, '^n[0-9]') THEN substr(e, 2) ELSE e END"
for _char, _token in text.ID_TOKENS:
    _DECODE = f"replace({_DECODE}, '{_token}', {'chr(' + str(ord(_char)) + ')'})"


@query(f"SELECT id, e AS encoded, CASE WHEN e = 'root' THEN '.' ELSE {_DECODE} END AS decoded FROM (SELECT id, CASE WHEN id IN ('', '.') THEN 'root' WHEN regexp_matches(x, '^[0-9]') THEN 'n' || x ELSE x END AS e FROM (SELECT id, {_ENCODE} AS x FROM {values('id', IDS)}))")
def node_id_codec(spark, sf_dir):
    rows = literal(spark, "id string", IDS).select("id", text.encode_id("id").alias("encoded"))
    return rows.withColumn("decoded", text.decode_id("encoded"))


@query(f"SELECT pat AS pattern, replace(pat, '*', '&ast;') AS encoded, pat AS decoded FROM {values('pat', GLOBS)}")
def glob_codec(spark, sf_dir):
    rows = literal(spark, "pattern string", GLOBS).select("pattern", text.encode_glob("pattern").alias("encoded"))
    return rows.withColumn("decoded", text.decode_glob("encoded"))


VERSIONS = [("v1.2.3", "1.2.4"), ("1.10.0", "1.9.9"), ("2.0.0-beta", "2.0.0"), ("dev", "1.0.0")]


@query(f"SELECT a, b, coalesce(CASE WHEN regexp_matches(x, '^[0-9.]+$') THEN sign(p1 - q1) * 100 + sign(p2 - q2) * 10 + sign(p3 - q3) > 0 END, false) AS newer FROM (SELECT a, b, x, try_cast(split_part(x, '.', 1) AS INT) p1, try_cast(split_part(x, '.', 2) AS INT) p2, try_cast(split_part(x, '.', 3) AS INT) p3, try_cast(split_part(y, '.', 1) AS INT) q1, try_cast(split_part(y, '.', 2) AS INT) q2, try_cast(split_part(y, '.', 3) AS INT) q3 FROM (SELECT a, b, regexp_replace(regexp_replace(a, '^v', ''), '-.*$', '') AS x, regexp_replace(regexp_replace(b, '^v', ''), '-.*$', '') AS y FROM {values('a, b', VERSIONS)}))")
def semver_compare(spark, sf_dir):
    return literal(spark, "a string, b string", VERSIONS).select("a", "b", F.coalesce(text.version("a") > text.version("b"), F.lit(False)).alias("newer"))


# ---- owners, scopes, relations ---------------------------------------------


def _page_owners(spark, sf_dir, theta=False):
    at = pages(spark, sf_dir).select(F.lit("pages").alias("contract"), F.col("rel").alias("path"))
    return (match.match_nodes_theta if theta else match.match_nodes)(at, casts.nodes(spark)).select("path", "node_id")


@query(owners_sql(f"SELECT rel AS path FROM ({PAGES})"))
def node_for_path(spark, sf_dir):
    return _page_owners(spark, sf_dir)


@query(owners_sql(f"SELECT rel AS path FROM ({PAGES})"))
def node_for_path_theta(spark, sf_dir):
    return _page_owners(spark, sf_dir, True)


@query(f"SELECT node_id, count(*) AS files, count(DISTINCT d.path) AS dirs FROM ({PAGES}) f JOIN ({owners_sql('SELECT ' + KEY_SQL.format('rel') + f' AS path FROM ({PAGES})')}) d ON d.path = {KEY_SQL.format('rel')} GROUP BY node_id")
def node_for_dir(spark, sf_dir):
    files = pages(spark, sf_dir).withColumn("path", paths.node_key("rel"))
    owners = match.match_nodes(files.select(F.lit("pages").alias("contract"), "path"), casts.nodes(spark)).select("path", "node_id")
    return files.join(owners, "path").groupBy("node_id").agg(F.count(F.lit(1)).alias("files"), F.count_distinct("path").alias("dirs"))


_ABS = f"SELECT page_id, '/' || capsule || '/' || rel AS abs, '/' || capsule AS capsule_dir FROM ({PAGES}) WHERE rel <> '.'"
_CONTRACT_DIRS = "SELECT DISTINCT regexp_extract(abs, '^(/[^/]+/[^/]+)/', 1) AS dir FROM ({0}) WHERE page_id % 3 = 0 AND regexp_matches(abs, '^/[^/]+/[^/]+/') UNION SELECT DISTINCT capsule_dir FROM ({0}) WHERE page_id % 5 = 0".format(_ABS)


def _tree(spark, sf_dir):
    """Pages as files of capsules named by host; some directories and capsules own a contract."""
    rows = pages(spark, sf_dir).filter("rel <> '.'").select("page_id", F.concat(F.lit("/"), "capsule", F.lit("/"), "rel").alias("abs"), F.concat(F.lit("/"), "capsule").alias("capsule_dir"))
    inner = rows.filter((F.col("page_id") % 3 == 0) & F.rlike("abs", F.lit("^/[^/]+/[^/]+/"))).select(F.regexp_extract("abs", "^(/[^/]+/[^/]+)/", 1).alias("dir"))
    return rows, inner.union(rows.filter("page_id % 5 = 0").select("capsule_dir")).distinct()


@query(f"SELECT page_id, coalesce((SELECT max(dir) FROM ({_CONTRACT_DIRS}) c WHERE starts_with(a.abs, dir || '/')), capsule_dir) AS scope FROM ({_ABS}) a")
def scope_for_file(spark, sf_dir):
    rows, dirs = _tree(spark, sf_dir)
    rows = rows.withColumn("dir", paths.dirname("abs"))
    return rows.join(discover.scopes(rows.select("capsule_dir", "dir").distinct(), dirs), ["capsule_dir", "dir"]).select("page_id", "scope")


@query(f"SELECT DISTINCT s.dir AS scope, c.dir AS above FROM ({_CONTRACT_DIRS}) s JOIN ({_CONTRACT_DIRS}) c ON starts_with(s.dir, c.dir || '/')")
def ancestor_contracts(spark, sf_dir):
    _, dirs = _tree(spark, sf_dir)
    chain = dirs.select(F.col("dir").alias("scope"), F.explode(paths.ancestors("dir")).alias("above"))
    return chain.join(dirs.select(F.col("dir").alias("above")), "above").select("scope", "above")


@query(f"SELECT DISTINCT CASE WHEN starts_with(capsule, 'm.') AND starts_with(rel, 'en/') THEN '/r/' || capsule || '/en' ELSE '/r/' || capsule END AS capsule_dir, '/r/' || capsule || '/' || rel || '.go' AS abs FROM ({PAGES}) WHERE rel <> '.'")
def scan_nested_exclusion(spark, sf_dir):
    """Files of a capsule within another one aren't the outer one's."""
    rows = pages(spark, sf_dir).filter("rel <> '.'").select("capsule", "rel").distinct()
    top = F.concat(F.lit("/r/"), "capsule")
    nested = rows.filter("startswith(capsule, 'm.') and startswith(rel, 'en/')").select(F.concat(top, F.lit("/en")))
    caps = rows.select(top).union(nested).distinct().toDF("capsule_dir").select("capsule_dir", F.lit("m").alias("capsule_id"), F.lit("go").alias("lang"))
    files = rows.select(F.concat(top, F.lit("/"), "rel", F.lit(".go")).alias("abs"), F.lit(False).alias("is_dir"), F.lit(None).cast("binary").alias("content"))
    return discover.tracked(files, caps, literal(spark, "dir string", []), "/r").select("capsule_dir", "abs")


@query(f"SELECT abs, max(dir) AS nearest FROM (SELECT DISTINCT abs FROM ({_ABS})) a LEFT JOIN ({_CONTRACT_DIRS}) c ON starts_with(abs, dir || '/') GROUP BY abs")
def scan_nearest_manifest(spark, sf_dir):
    rows, dirs = _tree(spark, sf_dir)
    found = match.nearest_ancestor(rows.select(paths.dirname("abs").alias("dir")), dirs)
    return rows.select("abs", paths.dirname("abs").alias("dir")).distinct().join(found, "dir").select("abs", F.col("owner").alias("nearest"))


@query("SELECT DISTINCT '/' || conv_id || '/assistant' AS contract, '/' || conv_id AS dir FROM conversations WHERE role = 'assistant'")
def scan_contract_files(spark, sf_dir):
    at = F.concat(F.lit("/"), "conv_id", F.lit("/"), "role")
    rows = casts.read(spark, sf_dir, "conversations").select(at.alias("abs"), F.lit(False).alias("is_dir"), F.lit(None).cast("binary").alias("content")).distinct()
    return discover.contract_dirs(rows, "assistant").select("contract", "dir")


RELS = ["a.go", "lib/b.dart", "src/c.ts", "src/d.tsx", "src/main/kotlin/E.kt", "src/main/kotlin/ETest.kt", "x/F.kt", "src/g.rs", "README", "src/main/kotlin/ksp/../generated/H.kt", "i.js"]


@query(
    f"SELECT rel, lang, CASE lang WHEN 'go' THEN ends_with(rel, '.go') WHEN 'dart' THEN ends_with(rel, '.dart') WHEN 'rust' THEN ends_with(rel, '.rs') WHEN 'typescript' THEN ends_with(rel, '.ts') OR ends_with(rel, '.tsx') ELSE ends_with(rel, '.kt') AND NOT ends_with(rel, 'Test.kt') AND NOT ends_with(rel, '_test.kt') AND NOT regexp_matches(rel, '/(generated|kapt|ksp|buildSrc)/') AND regexp_matches(rel, '^({'|'.join(KOTLIN_PREFIXES)})/') END AS counts FROM {values('rel', RELS)}, (VALUES ('dart'), ('go'), ('kotlin'), ('rust'), ('typescript')) AS l(lang)"
)
def scan_scannable_by_suffix(spark, sf_dir):
    langs = literal(spark, "lang string", ["dart", "go", "kotlin", "rust", "typescript"])
    return literal(spark, "rel string", RELS).crossJoin(langs).select("rel", "lang", scannable(F.col("rel"), F.col("lang")).alias("counts"))


_REL = f"SELECT l.*, s.node_id AS src, d.node_id AS dst FROM ({LINKS}) l JOIN ({owners_sql(f'SELECT rel AS path FROM ({LINKS})')}) s ON s.path = l.rel JOIN ({owners_sql(f'SELECT target AS path FROM ({LINKS})')}) d ON d.path = l.target"


def _relations(spark, sf_dir):
    """Links with the owners of both ends."""
    rows = casts.links(spark, sf_dir)
    at = rows.select(F.col("rel").alias("path")).union(rows.select("target")).select(F.lit("pages").alias("contract"), "path")
    own = match.match_nodes(at, casts.nodes(spark)).select("path", "node_id")
    return rows.join(own.select(F.col("path").alias("rel"), F.col("node_id").alias("src")), "rel").join(own.select(F.col("path").alias("target"), F.col("node_id").alias("dst")), "target")


def _judged(spark, sf_dir):
    """Links of pages as imports of capsules that share a contract, judged."""
    top = F.concat(F.lit("/"), "capsule")
    under = lambda c: F.when(F.col(c) == ".", top).otherwise(F.concat(top, F.lit("/"), c))
    rows = _relations(spark, sf_dir).filter("src is not null").select(
        top.alias("capsule_dir"), under("rel").alias("abs"), "rel", top.alias("scope"), F.lit("pages").alias("contract"), "src", F.col("target").alias("path"),
        F.col("page_id").alias("line"), F.col("ord").alias("col"), F.lit(0).alias("col_end"), "target", under("target").alias("target_abs"), top.alias("target_scope"),
    )
    rows = cut(rows)
    dirs = rows.select("capsule_dir").distinct()
    contracts = dirs.select(F.lit("pages").alias("contract"), F.col("capsule_dir").alias("dir"), F.lit(True).alias("readable"))
    return verdicts(rows, casts.nodes(spark), casts.edges(spark), contracts, dirs.select("capsule_dir", F.lit("pages").alias("contract"), F.lit(True).alias("readable")))


@query(f"SELECT src, dst, count(*) AS n FROM ({_REL}) r WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM ({EDGES_SQL}) e WHERE e.src = r.src AND e.dst = r.dst) GROUP BY ALL")
def check_in_scope(spark, sf_dir):
    return _judged(spark, sf_dir).filter("rule = 'import-not-allowed'").groupBy("d.src", "d.dst").agg(F.count(F.lit(1)).alias("n"))


_NEXT = "SELECT event_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events"


@query(f"SELECT event_id, src || ':' || event_id || ':1 (' || src || ') → ' || src || ' (' || src || ') — ' || src || ' is endophobic (events)' AS message FROM ({_NEXT}) WHERE src = dst AND src IN ('view', 'click')")
def check_endophobic(spark, sf_dir):
    """Steps between events of one type, which two types forbid."""
    events = casts.read(spark, sf_dir, "events")
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = events.select("event_id", F.col("event_type").alias("rel"), after.alias("target")).filter("target is not null")
    top = F.lit("/events")
    rows = rows.select(top.alias("capsule_dir"), F.concat(top, F.lit("/"), "rel").alias("abs"), "rel", top.alias("scope"), F.lit("events").alias("contract"), F.col("rel").alias("src"), F.col("target").alias("path"), F.col("event_id").alias("line"), F.lit(1).alias("col"), F.lit(1).alias("col_end"), "target", F.concat(top, F.lit("/"), "target").alias("target_abs"), top.alias("target_scope"))
    shy = F.when(F.col("event_type").isin("view", "click"), F.array(F.lit("endophobic"))).otherwise(F.array().cast("array<string>"))
    nodes = events.select(F.lit("events").alias("contract"), F.col("event_type").alias("node_id"), F.col("event_type").alias("glob"), shy.alias("classes")).distinct()
    contracts = literal(spark, "contract string, dir string, readable boolean", [("events", "/events", True)])
    judged = verdicts(cut(rows), nodes, casts.edges(spark, (), "events"), contracts, contracts.withColumnRenamed("dir", "capsule_dir"))
    return judged.filter("rule = 'endophobic'").select(F.col("line").alias("event_id"), "message")


@query(f"SELECT path FROM ({owners_sql(f'SELECT rel AS path FROM ({PAGES})')}) WHERE node_id IS NULL")
def check_no_node(spark, sf_dir):
    return _page_owners(spark, sf_dir).filter("node_id is null").select("path")


@query(f"SELECT page_id, ord, target FROM ({_REL}) WHERE src IS NOT NULL AND dst IS NULL")
def check_import_no_node(spark, sf_dir):
    return _judged(spark, sf_dir).filter("rule = 'import-no-node'").select(F.col("line").alias("page_id"), F.col("col").alias("ord"), "target")


@query(f"SELECT l.capsule, count(DISTINCT l.page_id) AS files, count(*) AS relations, count(*) FILTER (src IS NULL OR dst IS NULL) AS unowned FROM ({_REL}) l GROUP BY l.capsule")
def check_summary(spark, sf_dir):
    rows = _relations(spark, sf_dir)
    return rows.groupBy("capsule").agg(F.count_distinct("page_id").alias("files"), F.count(F.lit(1)).alias("relations"), F.count(F.when(F.col("src").isNull() | F.col("dst").isNull(), 1)).alias("unowned"))


_STEPS = "SELECT user_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events"


@query(f"SELECT src, dst, count(*) AS n FROM ({_STEPS}) s WHERE dst IS NOT NULL AND src <> dst AND NOT EXISTS (SELECT 1 FROM {values('src, dst', casts.EVENT_EDGES)} WHERE v.src = s.src AND v.dst = s.dst) GROUP BY ALL")
def edge_allowlist_events(spark, sf_dir):
    return _steps(spark, sf_dir).filter("src <> dst").join(F.broadcast(casts.edges(spark, casts.EVENT_EDGES).select("src", "dst")), ["src", "dst"], "left_anti").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def _steps(spark, sf_dir):
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return casts.read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("src"), after.alias("dst")).filter("dst is not null")


_TURNS = "SELECT conv_id, turn, role AS src, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM conversations"


@query(f"SELECT src, dst, src = dst AS same, count(*) AS n FROM ({_TURNS}) s WHERE dst IS NOT NULL AND (src = dst OR NOT EXISTS (SELECT 1 FROM {values('src, dst', casts.ROLE_EDGES)} WHERE v.src = s.src AND v.dst = s.dst)) GROUP BY ALL")
def edge_allowlist_roles(spark, sf_dir):
    after = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = casts.read(spark, sf_dir, "conversations").select(F.col("role").alias("src"), after.alias("dst")).filter("dst is not null")
    return rows.join(F.broadcast(casts.edges(spark, casts.ROLE_EDGES).select("src", "dst")), ["src", "dst"], "left_anti").groupBy("src", "dst", (F.col("src") == F.col("dst")).alias("same")).agg(F.count(F.lit(1)).alias("n"))


_FLOWS = "SELECT DISTINCT cn.n_name AS src, sn.n_name AS dst, cn.n_regionkey AS src_region, sn.n_regionkey AS dst_region FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN nation sn ON sn.n_nationkey = s_nationkey"


def _flows(spark, sf_dir):
    """Distinct (customer's, supplier's) nations, by way of numbers: names come last."""
    t = lambda n: casts.read(spark, sf_dir, n)
    rows = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = rows.select("c_nationkey", "s_nationkey").distinct()
    side = lambda x, key: t("nation").select(F.col("n_nationkey").alias(key), F.col("n_name").alias(x), F.col("n_regionkey").alias(f"{x}_region"))
    return pairs.join(side("src", "c_nationkey"), "c_nationkey").join(side("dst", "s_nationkey"), "s_nationkey").select("src", "dst", "src_region", "dst_region")


@query(f"SELECT src, dst FROM ({_FLOWS}) WHERE src <> dst AND src_region <> dst_region")
def edge_allowlist_nations(spark, sf_dir):
    return _flows(spark, sf_dir).filter("src <> dst and src_region <> dst_region").select("src", "dst")


REGION_EDGES = (("ASIA", "EUROPE"), ("EUROPE", "ASIA"), ("AMERICA", "AFRICA"), ("AFRICA", "MIDDLE EAST"))


@query(f"SELECT a.r_name || '/' || src AS rel, b.r_name || '/' || dst AS target FROM ({_FLOWS}) JOIN region a ON a.r_regionkey = src_region JOIN region b ON b.r_regionkey = dst_region WHERE src_region <> dst_region AND NOT EXISTS (SELECT 1 FROM {values('x, y', REGION_EDGES)} WHERE x = a.r_name AND y = b.r_name)")
def check_cross_scope(spark, sf_dir):
    """Nations are files, regions scopes with contracts of their own, which can't decide on others; the world's does."""
    region = casts.read(spark, sf_dir, "region")
    side = lambda x: region.select(F.col("r_regionkey").alias(f"{x}_region"), F.col("r_name").alias(f"{x}_scope"))
    rows = _flows(spark, sf_dir).join(side("src"), "src_region").join(side("dst"), "dst_region")
    at = lambda *c: F.concat_ws("/", F.lit("/world"), *c)
    rows = rows.select(
        F.lit("/world").alias("capsule_dir"), at("src_scope", "src").alias("abs"), F.concat_ws("/", "src_scope", "src").alias("rel"), at("src_scope").alias("scope"), at("src_scope").alias("contract"), F.lit("all").alias("src"), F.col("dst").alias("path"),
        F.lit(1).alias("line"), F.lit(1).alias("col"), F.lit(1).alias("col_end"), F.concat_ws("/", "dst_scope", "dst").alias("target"), at("dst_scope", "dst").alias("target_abs"), at("dst_scope").alias("target_scope"),
    )
    names = region.select(F.col("r_name"))
    none = F.array().cast("array<string>").alias("classes")
    nodes = names.select(F.lit("world").alias("contract"), F.col("r_name").alias("node_id"), F.concat("r_name", F.lit("/**")).alias("glob"), none)
    nodes = nodes.union(names.select(at("r_name"), F.lit("all"), F.lit("**"), none))
    contracts = names.select(at("r_name").alias("contract"), at("r_name").alias("dir"), F.lit(True).alias("readable")).union(literal(spark, "contract string, dir string, readable boolean", [("world", "/world", True)]))
    roots = literal(spark, "capsule_dir string, contract string, readable boolean", [("/world", "world", True)])
    return verdicts(cut(rows), nodes, casts.edges(spark, REGION_EDGES, "world"), contracts, roots).filter("rule = 'import-not-allowed'").select("rel", "target")


_SUPPRESSED = "SELECT '/' || r_name AS capsule_dir, count(*) AS n, r_regionkey AS k FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL"


@query(f"SELECT capsule_dir, k % 3 = 0 AS void_all, k % 3 = 1 AS void_violations, CAST(CASE WHEN k % 3 = 0 THEN 0 ELSE n END AS INTEGER) AS files_encountered, CAST(CASE WHEN k % 3 = 0 THEN 0 ELSE n END AS INTEGER) AS files_scanned, CAST(CASE WHEN k % 3 = 0 THEN 0 ELSE n * n END AS INTEGER) AS relations, CAST(n AS INTEGER) AS nodes, CAST(n * (n - 1) / 2 AS INTEGER) AS edges FROM ({_SUPPRESSED})")
def check_suppressed(spark, sf_dir):
    """Regions are capsules, every third with overlapping nodes, every third with an invalid glob: the first have no counts."""
    t = lambda n: casts.read(spark, sf_dir, n)
    regions = t("region").select(F.concat(F.lit("/"), "r_name").alias("capsule_dir"), "r_regionkey")
    files = regions.join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey")).select("capsule_dir", "r_regionkey", F.col("n_name").alias("src"), F.array(F.lit("x")).alias("imports"))
    pairs = files.select("capsule_dir", "src").join(files.select("capsule_dir", F.col("src").alias("dst")), "capsule_dir")
    roots = regions.select("capsule_dir", F.col("capsule_dir").alias("contract"))
    nodes, edges = files.select(F.col("capsule_dir").alias("contract"), F.col("src").alias("node_id")), pairs.filter("src < dst").select(F.col("capsule_dir").alias("contract"), "src", "dst")
    errors = regions.select("capsule_dir", F.expr("element_at(array('node-overlap', 'invalid-node-glob', 'empty-node-glob'), cast(r_regionkey % 3 + 1 as int))").alias("rule"))
    caps = regions.select("capsule_dir", F.lit("go").alias("lang"))
    out = summarise(roots, caps, files, pairs, nodes, edges, errors, roots, literal(spark, "capsule_dir string, source_error string", []))
    return out.select("capsule_dir", "void_all", "void_violations", "files_encountered", "files_scanned", "relations", "nodes", "edges")


# ---- contracts: validation -------------------------------------------------

BAD_NODES = [("a", "x", 3), ("b", "x", 4), ("c", "", 5), ("d", "../z", 6), ("e", "k/..w/v", 7), ("f", "q.go", 8), ("g", "x", 2)]
BAD_EDGES = [("a", "b", 9), ("b", "zz", 10), ("yy", "zz", 11), ("b", "a", 12), ("c", "d", 13), ("d", "e", 14), ("e", "c", 15), ("e", "f", 16)]
_BN, _BE = values("node_id, pat, line", BAD_NODES), values("src, dst, line", BAD_EDGES)


def _bad(spark):
    nodes = literal(spark, "node_id string, glob string, line int", BAD_NODES).withColumn("contract", F.lit("C.md"))
    return nodes, literal(spark, "src string, dst string, line int", BAD_EDGES).withColumn("contract", F.lit("C.md"))


def _messages(df):
    return df.select("message", "line")


@query(f"SELECT 'node \"' || node_id || '\" has empty glob (C.md:' || line || ')' AS message, line FROM {_BN} WHERE pat = ''")
def validate_empty(spark, sf_dir):
    return _messages(validate.empty_globs(_bad(spark)[0]))


@query(f"SELECT 'edge references undefined node \"' || n || '\" (C.md:' || line || ')' AS message, line FROM (SELECT src AS n, line FROM {_BE} UNION ALL SELECT dst, line FROM {_BE}) WHERE n NOT IN (SELECT node_id FROM {_BN})")
def validate_undefined(spark, sf_dir):
    return _messages(validate.undefined_ends(*_bad(spark)))


@query(f"SELECT 'glob \"' || pat || '\" claimed by multiple nodes: ' || string_agg(node_id, ', ' ORDER BY node_id) || ' (C.md:' || list(line ORDER BY node_id)[2] || ')' AS message, list(line ORDER BY node_id)[2] AS line FROM {_BN} GROUP BY pat HAVING count(*) > 1")
def validate_duplicate(spark, sf_dir):
    return _messages(validate.duplicate_globs(_bad(spark)[0]))


@query(f"SELECT node_id || ' (C.md:' || line || ') references ' || pat || ' — \"..\" not allowed in node globs' AS message, line FROM (SELECT *, unnest(string_split(pat, '/')) AS s FROM {_BN}) WHERE starts_with(s, '..')")
def validate_invalid(spark, sf_dir):
    return _messages(validate.invalid_globs(_bad(spark)[0]))


@query(f"SELECT node_id || ' (C.md:' || line || ') references ' || pat || ' — file-shaped nodes require a language that supports file globs' AS message, line FROM {_BN} WHERE contains(regexp_extract(pat, '([^/]*)$', 1), '.') AND pat NOT IN ('.', '..')")
def validate_file_glob_unsupported(spark, sf_dir):
    return _messages(validate.file_globs(_bad(spark)[0], literal(spark, "contract string, file_globs boolean", [("C.md", False)])))


_CYCLE_SQL = f"""WITH RECURSIVE e AS (SELECT src, dst, line FROM {_BE} WHERE src IN (SELECT node_id FROM {_BN}) AND dst IN (SELECT node_id FROM {_BN})),
w AS (SELECT src AS start, [src, dst] AS path, line FROM e WHERE dst >= src UNION ALL SELECT start, list_append(path, dst), e.line FROM w JOIN e ON e.src = path[-1] AND path[-1] <> start AND dst >= start AND (dst = start OR NOT list_contains(path, dst)))
SELECT path, line FROM w WHERE path[-1] = start"""


@query(f"SELECT DISTINCT unnest(path) AS node_id FROM ({_CYCLE_SQL})")
def validate_cycle_members(spark, sf_dir):
    found = validate.cycles(*_bad(spark))
    return found.select(F.explode(F.split(F.regexp_replace("message", "^circular dependency: | \\([^()]*\\)$", ""), " → ")).alias("node_id")).distinct()


@query(f"SELECT 'circular dependency: ' || array_to_string(path, ' → ') || ' (C.md:' || line || ')' AS message, line FROM ({_CYCLE_SQL})")
def validate_cycle_messages(spark, sf_dir):
    return _messages(validate.cycles(*_bad(spark)))


# Node, its glob and what that means, twice.
_PAIRS = [("en", "en/**", "ones", "en/1*", "^en($|/)", "^en/1[^/]*$"), ("en", "en/**", "all", "**", "^en($|/)", ""), ("ones", "en/1*", "all", "**", "^en/1[^/]*$", ""), ("french", "fr/*", "all", "**", "^fr/[^/]*$", "")]


@query(
    f"SELECT a, b, min(rel) AS witness FROM {values('a, ga, b, gb, ra, rb', _PAIRS)}, (SELECT rel, {KEY_SQL.format('rel')} AS k FROM ({PAGES})) f WHERE regexp_matches(k, ra) AND regexp_matches(k, rb) AND (k <> '.' OR ga = '**') AND (k <> '.' OR gb = '**') GROUP BY ALL"
)
def validate_overlap_witness(spark, sf_dir):
    nodes = literal(spark, "node_id string, glob string, line int", [("all", "**", 1), ("en", "en/**", 2), ("french", "fr/*", 3), ("ones", "en/1*", 4)]).withColumn("contract", F.lit("C.md"))
    files = pages(spark, sf_dir).select(F.lit("C.md").alias("contract"), "rel", F.col("rel").alias("walk"))
    found = validate.overlapping(nodes, files)
    one = lambda i: F.regexp_extract_all("message", F.lit('node "([^"]+)"'), F.lit(1))[i]
    # Pairs come with the smaller id first; the table above has them in its own order.
    rows = found.select(one(0).alias("x"), one(1).alias("y"), F.regexp_extract("message", "file (\\S+) matches", 1).alias("witness"))
    flip = F.col("x") == "all"
    return rows.select(F.when(flip, F.col("y")).otherwise(F.col("x")).alias("a"), F.when(flip, F.col("x")).otherwise(F.col("y")).alias("b"), "witness")


# ---- ignore rules, overlays, visibility ------------------------------------

RULES = [(0, ".", "es/"), (0, ".", "*.html"), (1, ".", "!7*.html"), (1, ".", "/en/1*"), (2, "fr", "2*"), (2, "fr", "!25*"), (2, ".", "**/3*/")]


@query(f"SELECT line, starts_with(line, '!') AS inclusion, ends_with(line, '/') AS dir_only, contains(regexp_replace(regexp_replace(line, '^!', ''), '/$', ''), '/') AS anchored, string_split(regexp_replace(regexp_replace(line, '^!', ''), '/$', ''), '/') AS segs FROM {values('layer, domain, line', RULES)}")
def ignore_parse_rules(spark, sf_dir):
    rows = literal(spark, "layer int, domain string, line string", RULES)
    return ignore.parse(rows).select("line", "inclusion", "dir_only", "anchored", "segs")


# The same for SQL: a name at any depth, or a path from the domain's top; what ends in a slash holds for what lies below.
RULES_MEANT = ["(^|/)es/", "(^|/)[^/]*[.]html($|/)", "(^|/)7[^/]*[.]html($|/)", "^en/1", "(^|/)2", "(^|/)25", "(^|/)3[^/]*/"]
_RULE_SQL = values("layer, ordinal, domain, rx, inclusion", [(layer, i, d, rx, line.startswith("!")) for i, ((layer, d, line), rx) in enumerate(zip(RULES, RULES_MEANT))])
_BELOW = "CASE WHEN domain = '.' THEN rel WHEN starts_with(rel, domain || '/') THEN substr(rel, length(domain) + 2) END"
_IGNORED = f"SELECT p.rel, coalesce(NOT arg_max(inclusion, layer * 100 + ordinal) FILTER (regexp_matches({_BELOW}, rx)), false) AS ignored FROM (SELECT DISTINCT rel FROM ({PAGES}) WHERE rel <> '.') p, {_RULE_SQL} GROUP BY p.rel"


def _ignored(spark, sf_dir):
    rules = spark.createDataFrame([(layer, i, d, ignore.rule_regex(line)[0], ignore.rule_regex(line)[2]) for i, (layer, d, line) in enumerate(RULES)], "layer int, ordinal int, domain string, regex string, inclusion boolean")
    at = pages(spark, sf_dir).filter("rel <> '.'").select(F.col("rel").alias("path"), F.lit(False).alias("is_dir")).distinct()
    return ignore.verdicts(at, rules)


@query(_IGNORED)
def ignore_layers(spark, sf_dir):
    return _ignored(spark, sf_dir).select(F.col("path").alias("rel"), "ignored")


@query(f"SELECT split_part(rel, '/', 1) AS top, count(*) AS seen, count(*) FILTER (ignored) AS hidden FROM ({_IGNORED}) GROUP BY ALL")
def ignore_last_match(spark, sf_dir):
    return _ignored(spark, sf_dir).groupBy(F.split("path", "/")[0].alias("top")).agg(F.count(F.lit(1)).alias("seen"), F.count(F.when(F.col("ignored"), 1)).alias("hidden"))


@query("SELECT '/' || source || '/' || doc_id AS path FROM documents WHERE source NOT IN ('src1', 'src2') AND NOT (source = 'src3' AND lang = 'en')")
def ignore_pruned_ancestors(spark, sf_dir):
    docs = casts.read(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "doc_id").alias("path"), F.lit(False).alias("is_dir"), ((F.col("source") == "src3") & (F.col("lang") == "en")).alias("ignored"))
    dirs = literal(spark, "path string, is_dir boolean, ignored boolean", [("src1", True, True), ("src2", True, True), ("src3", True, False)])
    return ignore.prune(docs.unionByName(dirs)).filter(~F.col("is_dir")).select(F.concat(F.lit("/"), "path").alias("path"))


# Rules that hold everywhere, by name.
BASE_RULES = ["*.d.ts", "*.d.tsx", "*.freezed.dart", "*.g.dart", "*.spec.ts", "*.spec.tsx", "*.test.ts", "*.test.tsx", "*_test.dart", "*_test.go", ".dart_tool/", ".git/", ".hg/", ".idea/", ".kotlin/", ".pub/", ".svn/", ".vs/", ".vscode/", "build/", "coverage/", "node_modules/", "target/", "vendor/", "coverage.lcov"]


@query(f"SELECT rule, CASE WHEN ends_with(rule, '/') THEN '/r/' || rtrim(rule, '/') || '/x' ELSE '/r/' || replace(rule, '*', 'a') END AS abs FROM {values('rule', BASE_RULES)}")
def ignore_base_layer(spark, sf_dir):
    """For each rule a file that it hides; files that no rule hides stay."""
    rows = literal(spark, "rule string", BASE_RULES).withColumn("abs", F.concat(F.lit("/r/"), F.when(F.endswith(F.col("rule"), F.lit("/")), F.concat(F.rtrim("rule", F.lit("/")), F.lit("/x"))).otherwise(F.replace("rule", F.lit("*"), F.lit("a")))))
    names = [r.abs for r in rows.collect()]  # a fixed few
    seen = trees.visible(trees.from_rows(spark, {n: "" for n in [*names, "/r/a.ts", "/r/b/c.go"]}), "/r")
    return rows.join(seen.select("abs"), "abs", "left_anti").select("rule", "abs")


DOMAINS = [(0, "en", "/1*"), (0, "fr", "2*"), (1, "fr", "!*5"), (1, "de/7", "x"), (2, ".", "en/12*/")]
_DOMAIN_HIT = "CASE WHEN starts_with(rel, 'fr/') AND regexp_matches(rel, '^fr/(.*/)?[^/]*5($|/)') THEN false WHEN starts_with(rel, 'en/1') THEN true WHEN regexp_matches(rel, '^fr/(.*/)?2') THEN true WHEN regexp_matches(rel, '^de/7/(.*/)?x($|/)') THEN true ELSE false END"


@query(f"SELECT DISTINCT rel, regexp_matches(rel, '^en/12[^/]*/') OR {_DOMAIN_HIT} AS ignored FROM ({PAGES}) WHERE rel <> '.'")
def ignore_domain_scope(spark, sf_dir):
    """Rules hold below the directory of their file only."""
    compiled = [(layer, i, d, *(lambda c: (c[0], c[2]))(ignore.rule_regex(line))) for i, (layer, d, line) in enumerate(DOMAINS)]
    table = literal(spark, "layer int, ordinal int, domain string, regex string, inclusion boolean", compiled)
    at = pages(spark, sf_dir).filter("rel <> '.'").select(F.col("rel").alias("path"), F.lit(False).alias("is_dir")).distinct()
    return ignore.verdicts(at, table).select(F.col("path").alias("rel"), "ignored")


@query("SELECT doc_id, CAST(i AS INTEGER) - 1 AS line_no, trim(l[i]) AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE trim(l[i]) <> '' AND NOT starts_with(trim(l[i]), '#')")
def ignore_read_lines(spark, sf_dir):
    docs = casts.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("dir"), F.lit(0).alias("rank"), F.col("text").alias("content"))
    return ignore.lines(docs).select(F.col("dir").alias("doc_id"), "line_no", F.trim("line").alias("line"))


@query("SELECT '/' || source || '/' || d.doc_id AS abs, sha256(CASE WHEN d.doc_id % 7 = 0 THEN 'new' ELSE text END) AS content_sha256 FROM documents d UNION ALL SELECT '/extra/file', sha256('new')")
def overlay_merge(spark, sf_dir):
    docs = casts.read(spark, sf_dir, "documents").withColumn("abs", F.concat(F.lit("/"), "source", F.lit("/"), "doc_id"))
    over = docs.filter("doc_id % 7 = 0").select("abs", F.lit("new").alias("content")).union(literal(docs.sparkSession, "abs string, content string", [("/extra/file", "new")]))
    merged = trees.overlay(docs.select("abs", F.lit(False).alias("is_dir"), F.encode("text", "UTF-8").alias("content")), over)
    return merged.filter(~F.col("is_dir")).select("abs", F.sha2("content", 256).alias("content_sha256"))


@query("SELECT '/' || conv_id || '/' || role AS abs, arg_max(text, turn) AS content FROM conversations GROUP BY conv_id, role")
def overlay_last_wins(spark, sf_dir):
    """A payload for each conversation, its turns as files by role."""
    turns = casts.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("/./"), "conv_id", F.lit("//"), "role").alias("path"), F.col("text").alias("content")))).alias("t"))
    payload = turns.select(F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["path"].alias("path"), x["content"].alias("content"))).alias("files"))).alias("json"))
    return trees.overlay_rows(payload)


@query("SELECT '/' || source || '/' || lang AS abs FROM documents GROUP BY source, lang HAVING count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) = 0")
def visible_targets(spark, sf_dir):
    """Directories without a visible file aren't targets: of sources by language, those without a document labelled toxic."""
    docs = casts.read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/"), "source", F.lit("/"), "lang").alias("dir"))
    shown = casts.read(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    dirs = docs.select(F.col("dir").alias("abs"), F.lit(True).alias("is_dir")).distinct()
    seen = dirs.unionByName(docs.join(shown, "doc_id", "left_semi").select(F.concat("dir", F.lit("/"), "doc_id").alias("abs"), F.lit(False).alias("is_dir")))
    return trees.empty_dirs(seen, seen)


# ---- extraction and resolution ---------------------------------------------


@query(f"SELECT page_id, ord, target FROM ({LINKS})")
def extract_links(spark, sf_dir):
    return casts.links(spark, sf_dir).select("page_id", "ord", "target")


@query(f"SELECT page_id, target, min(ord) AS ord FROM ({LINKS}) GROUP BY ALL")
def extract_distinct_per_file(spark, sf_dir):
    return casts.links(spark, sf_dir).groupBy("page_id", "target").agg(F.min("ord").alias("ord"))


# Sources made of documents: a text as comment lines, then this with {s} for the source, {l} for the language, {d} for doc_id.
SOURCES = {
    "dart": "import 'package:a/{s}.dart';\nexport \"{l}.dart\" show Y;\n  part 'p{d}.dart';\n// import 'no.dart';\n",
    "typescript": "import a from 'm/{s}';\nimport '{l}/{d}';\nconst y = require(\"y{d}\");\nexport * from './{l}';\n  import b from 'm/{s}';\nimport {\n  q\n} from 'unseen';\n",
    "kotlin": "package p\nimport m.{s}.C{d}\nimport {l}.*\n  import static e.F{d}\n",
    "rust": "use crate::{s}::d{d};\npub use super::{l};\nmod m{d};\n  extern crate {l} as f;\nuse crate::{s}::d{d};\n",
    "go": 'package p\n\nimport (\n\t"m/{s}/{l}"\n\td{d} "m/{d}" // import "no"\n)\n/* {l} */ import . "é/{s}"\n\nfunc f() {}\nimport "late"\n',
}
# For SQL: what is imported, in which line behind the comment, in which column.
IMPORTED = {
    "dart": [("'package:a/' || source || '.dart'", 1, "9"), ("lang || '.dart'", 2, "9"), ("'p' || doc_id || '.dart'", 3, "9")],
    "typescript": [("'m/' || source", 1, "16"), ("lang || '/' || doc_id", 2, "9"), ("'y' || doc_id", 3, "20"), ("'./' || lang", 4, "16")],
    "kotlin": [("'m.' || source || '.C' || doc_id", 2, "8"), ("lang", 3, "8"), ("'e.F' || doc_id", 4, "17")],
    "rust": [("'crate::' || source || '::d' || doc_id", 1, "1"), ("'super::' || lang", 2, "1"), ("'m' || doc_id", 3, "1"), ("lang", 4, "1")],
    "go": [("'m/' || source || '/' || lang", 4, "2"), ("'m/' || doc_id", 5, "length('d' || doc_id) + 3"), ("'é/' || source", 7, "length(lang) + 17")],
}


def _filled(text: str):
    out = F.lit(text)
    for mark, column in (("{s}", "source"), ("{l}", "lang"), ("{d}", "doc_id")):
        out = F.replace(out, F.lit(mark), F.col(column).cast("string"))
    return out


def _commented(mark: str):
    return F.concat(F.lit(f"{mark} "), F.replace("text", F.lit("\n"), F.lit(f"\n{mark} ")), F.lit("\n"))


def _extract(lang):
    lines = "length(text) - length(replace(text, chr(10), '')) + 1"

    @query(" UNION ALL ".join(f"SELECT doc_id, {path} AS path, CAST({lines} + {line} AS INTEGER) AS line, CAST({col} AS INTEGER) AS col FROM documents" for path, line, col in IMPORTED[lang]), f"extract_{'ts' if lang == 'typescript' else lang}_imports")
    def run(spark, sf_dir):
        from .plans.check import parse_imports

        content = F.encode(F.concat(_commented("//"), _filled(SOURCES[lang])), "UTF-8")
        rows = casts.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("abs"), F.lit(lang).alias("lang"), content.alias("content"))
        return parse_imports(rows).select(F.col("abs").cast("long").alias("doc_id"), F.explode("imports").alias("i")).select("doc_id", "i.path", "i.line", "i.col")

    return run


for _lang in SOURCES:
    _extract(_lang)


def _by(column: str, *cases):
    """The case whose number is the column modulo their count."""
    rest = F.col(column) % len(cases)
    out = F.when(rest == 0, cases[0])
    for i, c in enumerate(cases[1:], 1):
        out = out.when(rest == i, c)
    return out


def _by_sql(column: str, *cases: str) -> str:
    return f"CASE {column} % {len(cases)} " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases)) + " END"


_MODULE = _by_sql("page_id", "rel || '/' || target", "regexp_replace(rel || '/' || target, '^[^/]*/', '')", "NULL")


@query(f"SELECT page_id, ord, {_MODULE} AS target FROM ({LINKS})")
def resolve_prefix_module(spark, sf_dir):
    """Modules are hosts, first directories of hosts, and what a host's name begins with."""
    rows = casts.links(spark, sf_dir)
    module = _by("page_id", F.col("capsule"), F.concat_ws("/", "capsule", F.split("rel", "/")[0]), F.expr("left(capsule, length(capsule) - 1)"))
    return rows.select("page_id", "ord", targets.go(F.concat_ws("/", "capsule", "rel", "target"), module).alias("target"))


_ABOVE = "regexp_replace('lib/' || rel, '(^|/)[^/]+/[^/]+$', '')"
_URI = _by_sql("ord", "'lib/' || target", f"CASE WHEN {_ABOVE} = '' THEN target ELSE {_ABOVE} || '/' || target END", "regexp_replace('lib/' || rel, '[^/]*$', '') || target", "NULL", "NULL", "NULL")


@query(f"SELECT page_id, ord, {_URI} AS target FROM ({LINKS})")
def resolve_package_uri(spark, sf_dir):
    """Links as own packages, from the directory above, from the file's, from other packages, the library and beyond the top."""
    head = _by("ord", *map(F.lit, ("package:shop/", "../", "", "package:other/", "dart:", "../" * 9)))
    rows = casts.links(spark, sf_dir)
    return rows.select("page_id", "ord", targets.dart(F.concat(head, "target"), F.lit("shop"), F.concat(F.lit("lib/"), "rel")).alias("target"))


_DOTTED = _by_sql("doc_id", "'/com/' || source || '/' || lang || '/D' || doc_id", "'/com/' || source", "NULL", "NULL")


@query(f"SELECT doc_id, CASE lang WHEN 'en' THEN 'src/jvmMain/kotlin' WHEN 'fr' THEN 'src/jsTest/kotlin' ELSE 'src/main/kotlin' END || {_DOTTED} AS target FROM documents")
def resolve_dotted_package(spark, sf_dir):
    own = F.concat(F.lit("com."), "source")
    spec = _by("doc_id", F.concat(own, F.lit("."), "lang", F.lit(".D"), F.col("doc_id").cast("string")), own, F.concat(own, F.lit("x.C")), F.concat(own, F.lit(".")))
    rel = F.when(F.col("lang") == "en", "src/jvmMain/kotlin/A.kt").when(F.col("lang") == "fr", "src/jsTest/kotlin/a/B.kt").otherwise("A.kt")
    return casts.read(spark, sf_dir, "documents").select("doc_id", targets.kotlin(spec, own, rel).alias("target"))


CRATES = ["crate::{l}::{s}::D{d}", "crate::{l}", "super::a{d}::b", "super::super::{l}", "self::{s}", "{s}::{l}::b::C", "serde::{l}", "util{d}", "crate::{l}::D as e{d}"]
_CRATE = _by_sql("doc_id", "'src/' || lang || '/' || source", "'src'", "'src/' || lang || '/a' || doc_id", "'src'", "'src/' || lang", "'src/' || lang || '/b'", "NULL", "'src/' || lang || '/util' || doc_id", "'src/' || lang")


@query(f"SELECT doc_id, {_CRATE} AS target FROM documents")
def resolve_crate_path(spark, sf_dir):
    """Documents are files of crates named by source, in directories by language."""
    rows = casts.read(spark, sf_dir, "documents")
    return rows.select("doc_id", targets.rust(_by("doc_id", *map(_filled, CRATES)), F.col("source"), _filled("src/{l}/x.rs")).alias("target"))


ALIASES = [("@/*", ["src/*", "alt/*"], ""), ("@/en/*", ["widgets/*"], ""), ("cfg", ["conf/main"], "base")]
_ALIAS = "CASE WHEN doc_id % 3 = 2 THEN 'base/conf/main' WHEN lang = 'en' THEN 'widgets/d' || doc_id WHEN doc_id % 2 = 0 THEN 'alt/' || lang || '/d' || doc_id ELSE 'src/' || lang || '/d' || doc_id END"


@query(f"SELECT DISTINCT '/' || source AS capsule_dir, CASE WHEN doc_id % 3 = 2 THEN 'cfg' ELSE '@/' || lang || '/d' || doc_id END AS spec, {_ALIAS} AS target FROM documents")
def resolve_alias_map(spark, sf_dir):
    """Sources are capsules; documents with an even id exist at the second place only."""
    docs = casts.read(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.concat(F.lit("/"), "source").alias("capsule_dir"))
    aliases = docs.select("capsule_dir").distinct().crossJoin(F.broadcast(literal(spark, "pattern string, replacements array<string>, base_url string", ALIASES)))  # a fixed few
    specs = docs.select("capsule_dir", F.when(F.col("doc_id") % 3 == 2, "cfg").otherwise(_filled("@/{l}/d{d}")).alias("spec"))
    return targets.typescript_aliases(specs, aliases, docs.filter("doc_id % 2 = 0").select(_filled("/{s}/alt/{l}/d{d}").alias("abs"))).select("capsule_dir", "spec", "target")


# Ending of a target, endings of the files that exist, the one that is meant.
ENDINGS = [("", [".js", ".ts"], ".ts"), ("", ["/index.tsx", ""], "/index.tsx"), (".js", [".ts", ".tsx"], ".ts"), (".css", [], ".css"), ("", [".vue"], ""), (".jsx", [".tsx", ".jsx"], ".jsx")]


@query(f"SELECT '/' || source AS capsule_dir, 'src/d' || doc_id || ending AS target, 'src/d' || doc_id || meant AS file FROM documents JOIN {values('k, ending, meant', [(i, e, m) for i, (e, _, m) in enumerate(ENDINGS)])} ON k = doc_id % {len(ENDINGS)}")
def resolve_extension_candidates(spark, sf_dir):
    docs = casts.read(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    there = _by("doc_id", *[F.array(*map(F.lit, have)).cast("array<string>") for _, have, _ in ENDINGS])
    existing = docs.select("*", F.explode(there).alias("ending")).select(F.concat(_filled("/{s}/src/d{d}"), "ending").alias("abs"))
    rows = docs.select(_filled("/{s}").alias("capsule_dir"), F.concat(_filled("src/d{d}"), _by("doc_id", *[F.lit(e) for e, _, _ in ENDINGS])).alias("target"))
    return targets.typescript_endings(rows, existing)


@query("SELECT '/k/' || source AS dir, 'com.' || source || CASE WHEN starts_with(max(lang), min(lang)) THEN '.' || min(lang) ELSE '' END AS capsule_id FROM documents GROUP BY source")
def common_package_prefix(spark, sf_dir):
    """Sources are capsules, languages packages."""
    docs = casts.read(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    files = docs.select(_filled("/k/{s}/src/main/kotlin/com/{s}/{l}/D{d}.kt").alias("abs"), F.lit(False).alias("is_dir"))
    tops = docs.select(_filled("/k/{s}/src/main/kotlin").alias("abs"), F.lit(True).alias("is_dir")).distinct()
    return discover.kotlin_ids(files.unionByName(tops), docs.select(_filled("/k/{s}").alias("dir")).distinct())


def _manifest_tree(spark, sf_dir, *cases):
    """For each document a directory with the files (name, content column) of the case for its id."""
    entry = lambda c: F.array(*[F.struct(F.lit(name).alias("name"), content.alias("content")) for name, content in c])
    rows = casts.read(spark, sf_dir, "documents").select(_filled("/r/{d}/").alias("dir"), F.explode(_by("doc_id", *map(entry, cases))).alias("f"))
    return rows.select(F.concat("dir", "f.name").alias("abs"), F.lit(False).alias("is_dir"), F.encode("f.content", "UTF-8").alias("content"))


# Case by case: language and name.
_NAMED = [("'go'", "'m.org/' || source || '/' || doc_id"), ("'dart'", "'shop_' || doc_id"), ("'typescript'", "'@' || source || '/p' || doc_id"), ("'rust'", "source || '-' || doc_id"), ("NULL", "NULL")]


@query(f"SELECT '/r/' || doc_id AS dir, {_by_sql('doc_id', *[x for x, _ in _NAMED])} AS lang, {_by_sql('doc_id', *[x for _, x in _NAMED])} AS capsule_id FROM documents WHERE doc_id % 5 <> 4")
def manifest_ids(spark, sf_dir):
    """Manifests with whole texts as comments or descriptions; a fifth is malformed and names nothing."""
    body = lambda mark, rest: F.concat(_commented(mark), _filled(rest))
    package = F.to_json(F.struct(F.col("text").alias("description"), _filled("@{s}/p{d}").alias("name")))
    files = _manifest_tree(
        spark, sf_dir,
        [("go.mod", body("//", '\nmodule "m.org/{s}/{d}"\nmodule no\n'))], [("pubspec.yaml", body("#", " name: no\nname: shop_{d}\n"))], [("package.json", package)],
        [("Cargo.toml", body("#", '[deps]\nname = "no"\n[package]\nname = "{s}-{d}"\n'))], [("package.json", F.concat(F.lit("{"), "text"))],
    )
    return discover.manifests(files).select("dir", "lang", "capsule_id")


_FIRST = [("'go'", "'m' || doc_id"), ("'typescript'", "'y' || doc_id"), ("'dart'", "'z' || doc_id")]


@query(f"SELECT '/r/' || doc_id AS capsule_dir, {_by_sql('doc_id', *[x for x, _ in _FIRST])} AS lang, {_by_sql('doc_id', *[x for _, x in _FIRST])} AS capsule_id FROM documents")
def scan_manifest_first(spark, sf_dir):
    """Of two manifests in a directory the first by language counts, if it names something."""
    files = _manifest_tree(
        spark, sf_dir,
        [("package.json", _filled('{"name": "x"}')), ("go.mod", _filled("module m{d}\n"))], [("Cargo.toml", _filled("[package]\n")), ("package.json", _filled('{"name": "y{d}"}'))],
        [("Cargo.toml", _filled('[package]\nname = "zz"\n')), ("pubspec.yaml", _filled("name: z{d}\n"))],
    )
    return discover.capsules(files, "/r", resolve_languages()).select("capsule_dir", "lang", "capsule_id")


# ---- inference, styles, reports --------------------------------------------


_DIR = "CASE WHEN instr({0}, '/') = 0 THEN '.' ELSE regexp_replace({0}, '/[^/]*$', '') END"


def _draft_sql(but: str = "''") -> str:
    """SQL for the ends of links (src, dst with their globs) and files, directories with several files merged but for one."""
    merged = f"SELECT d FROM (SELECT DISTINCT rel, {_DIR.format('rel')} AS d FROM ({PAGES}) WHERE rel <> '.') WHERE d <> '.' AND d <> {but} GROUP BY d HAVING count(*) > 1"
    name = lambda x: f"CASE WHEN {_DIR.format(x)} IN (SELECT d FROM m) THEN {KEY_SQL.format('(' + _DIR.format(x) + ')')} ELSE {x} END"
    glob = lambda x: f"CASE WHEN {_DIR.format(x)} IN (SELECT d FROM m) THEN {_DIR.format(x)} || '/*.*' ELSE {x} END"
    return f"m AS ({merged}), f AS (SELECT DISTINCT rel FROM ({PAGES}) WHERE rel <> '.'), l AS (SELECT DISTINCT rel, target FROM ({LINKS}) WHERE rel <> '.'), e AS (SELECT {name('rel')} AS src, {name('target')} AS dst, {glob('target')} AS dst_glob FROM l), n AS (SELECT {name('rel')} AS node_id, {glob('rel')} AS pattern FROM f)"


def _drafted(spark, sf_dir, **how):
    """All pages as the files of one capsule, and what they link to."""
    from .plans.dump import draft

    files = pages(spark, sf_dir).filter("rel <> '.'").select("rel").distinct()
    links = casts.links(spark, sf_dir).filter("rel <> '.'").select("rel", F.col("target").alias("target_rel")).distinct()
    return draft(files, links, True, True, **how)


@query(f"WITH {_draft_sql()} SELECT node_id, max(pattern) AS pattern FROM (SELECT * FROM n UNION ALL SELECT dst, dst_glob FROM e) GROUP BY node_id")
def dump_nodes(spark, sf_dir):
    return _drafted(spark, sf_dir)[0].select("node_id", F.col("glob").alias("pattern"))


@query(f"WITH {_draft_sql()} SELECT DISTINCT src, dst FROM e WHERE src <> dst")
def dump_edges(spark, sf_dir):
    return _drafted(spark, sf_dir)[1]


@query(f"WITH {_draft_sql(chr(39) + 'en' + chr(39))} SELECT DISTINCT src, dst FROM e WHERE src <> dst")
def dump_expansion(spark, sf_dir):
    """The same with one merged directory taken apart."""
    return _drafted(spark, sf_dir, expanded=["en"])[1]


@query(f"SELECT capsule, dir, dir || '/*.*' AS pattern, count(*) AS files FROM (SELECT capsule, CASE WHEN instr(rel, '/') = 0 THEN '.' ELSE regexp_replace(rel, '/[^/]*$', '') END AS dir FROM ({PAGES})) WHERE dir <> '.' GROUP BY ALL HAVING count(*) > 1")
def dump_merged_dirs(spark, sf_dir):
    from .plans.dump import merged_dirs

    return merged_dirs(pages(spark, sf_dir).select(F.col("capsule").alias("contract"), "rel")).select(F.col("contract").alias("capsule"), "dir", F.col("glob").alias("pattern"), "files")


@query(f"SELECT DISTINCT a.r_name AS src, b.r_name AS dst FROM ({_FLOWS}) JOIN region a ON a.r_regionkey = src_region JOIN region b ON b.r_regionkey = dst_region WHERE src_region <> dst_region")
def dump_boundary_edges(spark, sf_dir):
    """What lies in regions, which have contracts of their own, is one node for each."""
    from .plans.dump import _draft

    region = casts.read(spark, sf_dir, "region")
    at = lambda key, name: F.concat_ws("/", F.lit("/world"), key, name)
    side = lambda x: region.select(F.col("r_regionkey").alias(f"{x}_region"), F.col("r_name").alias(f"{x}_scope"))
    refs = _flows(spark, sf_dir).join(side("src"), "src_region").join(side("dst"), "dst_region").select(at("src_scope", "src").alias("abs"), at("dst_scope", "dst").alias("target_abs"))
    inside = refs.select("abs").distinct().withColumn("rel", F.expr("substring(abs, 8)"))
    drafted = _draft(inside, refs, "/world", [f"/world/{r.r_name}" for r in region.collect()], LANGUAGES["go"], False, ())
    return literal(spark, "src string, dst string", sorted(drafted.edges))


@query(f"WITH o AS (SELECT DISTINCT src, dst FROM ({_STEPS}) WHERE dst IS NOT NULL AND src <> dst), e AS (SELECT * FROM {values('src, dst', casts.EVENT_EDGES)}) SELECT (SELECT count(*) FROM (SELECT src AS n FROM o UNION SELECT dst FROM o EXCEPT (SELECT src FROM e UNION SELECT dst FROM e))) AS added_nodes, (SELECT count(*) FROM (SELECT * FROM o EXCEPT SELECT * FROM e)) AS added_edges")
def dump_amend_diff(spark, sf_dir):
    """Observed steps added to a contract's nodes and edges, as an amendment does."""
    from .plans.dump import added

    before, after = contracts.Contract(), contracts.Contract()
    for a, b in casts.EVENT_EDGES:
        for c in (before, after):
            c.edges[c.add(a, a), c.add(b, b)] = 0
    for r in sorted(_steps(spark, sf_dir).filter("src <> dst").select("src", "dst").distinct().collect()):  # a contract's edges
        after.edges[after.add(r.src, r.src), after.add(r.dst, r.dst)] = 0
    return literal(spark, "added_nodes long, added_edges long", [added(before, after)])


@query(f"SELECT dir, CAST(row_number() OVER (ORDER BY len(string_split(dir, '/')) DESC, dir) AS INTEGER) AS position FROM (SELECT DISTINCT regexp_replace(abs, '/[^/]*$', '') AS dir FROM ({_ABS}))")
def dump_order(spark, sf_dir):
    """Directories of all pages as capsules."""
    from .plans import dump

    rows, _ = _tree(spark, sf_dir)
    dirs = rows.select(paths.dirname("abs").alias("dir")).distinct()
    return dirs.select("dir", F.row_number().over(Window.orderBy(*dump.dump_order("dir"))).alias("position"))


_COLOURS = "[" + ", ".join(f"'{c}'" for c in PALETTES["vibrant"]) + "]"


_NAME_ID = _ENCODE.replace("(id,", "(n_name,")


@query(f"SELECT 'style ' || {_NAME_ID} || ' stroke:' || {_COLOURS}[(row_number() OVER (ORDER BY n_name) - 1) % 16 + 1] || ',stroke-width:2px' || CASE WHEN n_regionkey = 0 THEN ',stroke-dasharray:5 5' ELSE '' END AS line FROM nation")
def style_colors(spark, sf_dir):
    nations = sorted(casts.read(spark, sf_dir, "nation").select("n_name", "n_regionkey").collect())  # a contract's nodes
    made = contracts.style_lines([r.n_name for r in nations], [], {r.n_name for r in nations if r.n_regionkey == 0}, "vibrant")
    return literal(spark, "line string", list(made))


@query(f"WITH o AS (SELECT DISTINCT src, dst FROM ({_FLOWS}) WHERE src <> dst), n AS (SELECT n_name, {_COLOURS}[(row_number() OVER (ORDER BY n_name) - 1) % 16 + 1] AS c FROM nation), e AS (SELECT src, row_number() OVER (ORDER BY src, dst) - 1 AS i FROM o) SELECT 'linkStyle ' || string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) || ' stroke:' || c || ',stroke-width:2px' AS line FROM e JOIN n ON n_name = src GROUP BY c")
def style_link_groups(spark, sf_dir):
    names = sorted(r.n_name for r in casts.read(spark, sf_dir, "nation").select("n_name").collect())
    edges = sorted(tuple(r) for r in _flows(spark, sf_dir).filter("src <> dst").select("src", "dst").distinct().collect())  # a contract's edges
    return literal(spark, "line string", [x for x in contracts.style_lines(names, edges, set(), "vibrant") if x.startswith("linkStyle")])


def _documents(spark, sf_dir):
    """For each region a contract of its nations by key, each with an edge to the next: contract, content."""
    rows = casts.read(spark, sf_dir, "nation").join(casts.read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    node = F.transform("n", lambda x: F.concat(F.lit("n"), x["n_nationkey"].cast("string"), F.lit('["'), F.replace(x["n_name"], F.lit(" "), F.lit("/")), F.lit('/&ast;"]  %% a note')))
    pair = F.transform(F.sequence(F.lit(1), F.size("n") - 1), lambda i: F.concat(F.lit("  n"), F.element_at("n", i)["n_nationkey"].cast("string"), F.lit(" --> n"), F.element_at("n", i + 1)["n_nationkey"].cast("string")))
    lines = F.concat(F.array(F.lit("# title"), F.lit("```mermaid"), F.lit("flowchart TD")), node, F.array(F.lit(""), F.lit("%% edges")), pair, F.array(F.lit("```"), F.lit("text")))
    return rows.select(F.col("r_name").alias("contract"), F.array_join(lines, "\n").alias("content"))


_PLACED = "SELECT r_name, n_nationkey, n_name, row_number() OVER w AS i, count(*) OVER (PARTITION BY r_name) AS n, lead(n_nationkey) OVER w AS after FROM nation JOIN region ON r_regionkey = n_regionkey WINDOW w AS (PARTITION BY r_name ORDER BY n_nationkey)"


@query(f"SELECT r_name AS contract, 'node' AS kind, CAST(n_nationkey AS VARCHAR) AS a, replace(n_name, ' ', '/') || '/*' AS b, CAST(3 + i AS INTEGER) AS line FROM ({_PLACED}) UNION ALL SELECT r_name, 'edge', CAST(n_nationkey AS VARCHAR), CAST(after AS VARCHAR), CAST(5 + n + i AS INTEGER) FROM ({_PLACED}) WHERE after IS NOT NULL")
def contract_parse_lines(spark, sf_dir):
    read = contracts.read(_documents(spark, sf_dir))
    nodes = contracts.nodes_of(read).select("contract", F.lit("node").alias("kind"), F.col("node_id").alias("a"), F.col("glob").alias("b"), "line")
    return nodes.union(contracts.edges_of(read).select("contract", F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "line"))


@query(f"SELECT r_name AS contract, '  n' || n_nationkey || '[\"' || replace(n_name, ' ', '/') || '/&ast;\"]' AS line FROM ({_PLACED}) UNION ALL SELECT r_name, '  n' || n_nationkey || ' --> n' || after FROM ({_PLACED}) WHERE after IS NOT NULL")
def contract_render(spark, sf_dir):
    """Documents read and written again, without styles: nodes and edges."""
    made = [(r.contract, line) for r in _documents(spark, sf_dir).collect() for line in contracts.render(contracts.parse(r.content), "none").split("\n") if line.startswith("  ")]  # five documents
    return literal(spark, "contract string, line string", made)


@query("SELECT r_name || x.kind AS path, x.kind = '/plain' AS changed, x.kind = '/broken' AS failed FROM region, (VALUES ('/plain'), ('/done'), ('/broken')) AS x(kind)")
def restyle_changed(spark, sf_dir):
    """Documents without styles change, restyled ones don't, and those that can't be read are errors."""
    from .plans.dump import restyle

    plain = {r.contract: r.content for r in _documents(spark, sf_dir).collect()}
    given = [(f"{p}/plain", c) for p, c in plain.items()] + [(f"{p}/done", contracts.render(contracts.parse(c), "muted")) for p, c in plain.items()] + [(f"{p}/broken", c.replace("-->", "->")) for p, c in plain.items()]
    return literal(spark, "path string, changed boolean, failed boolean", [(p, new is not None, error is not None) for p, new, error in restyle(given, "muted")])


_REPORTED = "SELECT '/' || r_name AS label, count(DISTINCT n_nationkey) AS files, count(DISTINCT CASE WHEN s_suppkey IS NOT NULL THEN n_nationkey END) AS scanned, count(s_suppkey) AS relations, CAST(any_value(r_regionkey) AS BIGINT) AS k FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_name"


def _reported(spark, sf_dir):
    """Regions as capsules, nations as files, suppliers as imports, those with a debt as violations: what reports are made from."""
    from .plans import report

    t = lambda n: casts.read(spark, sf_dir, n)
    rows = t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey")).join(t("supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    rows = rows.withColumn("capsule_dir", F.concat(F.lit("/"), "r_name"))
    number = lambda c: c.cast("int")
    caps = rows.groupBy("capsule_dir").agg(number(F.count_distinct("n_nationkey")).alias("files_encountered"), number(F.count_distinct(F.when(F.col("s_suppkey").isNotNull(), F.col("n_nationkey")))).alias("files_scanned"), number(F.count("s_suppkey")).alias("relations"), number(F.max("r_regionkey")).alias("nodes"))
    caps = caps.select("*", F.col("capsule_dir").alias("label"), F.lit(1).alias("edges"), F.lit(None).cast("string").alias("source_error"))
    owing = rows.filter("s_acctbal < 0").select("capsule_dir", F.lit("no-node").alias("rule"), F.col("s_name").alias("message"), F.lit("error").alias("severity"), F.lit("s").alias("source"), F.col("n_name").alias("file"), *[F.lit(1).alias(c) for c in ("line", "col", "col_end")])
    errors = rows.filter("r_regionkey = 1").select("capsule_dir", F.lit("empty-node-glob").alias("rule"), F.lit("bad").alias("message"), F.col("capsule_dir").alias("contract"), F.lit(3).alias("line")).distinct()
    return report, report.collect(Check(caps, owing, errors, caps, caps, caps))


@query(f"SELECT label || ' (' || CASE WHEN files = scanned THEN files || CASE WHEN files = 1 THEN ' file' ELSE ' files' END ELSE scanned || ' of ' || files || CASE WHEN files = 1 THEN ' file' ELSE ' files' END END || ' scanned' || CASE WHEN relations > 0 THEN ', ' || relations || ' internal ' || CASE WHEN relations = 1 THEN 'import' ELSE 'imports' END || ' checked' ELSE '' END || ', graph: ' || k || CASE WHEN k = 1 THEN ' node' ELSE ' nodes' END || ', 1 edge)' AS line FROM ({_REPORTED})")
def report_text_lines(spark, sf_dir):
    """The line of each capsule."""
    report, found = _reported(spark, sf_dir)
    marks = {report.RED, report.GREEN, report.PLAIN, "✓ ", "✗ "}
    rows = [x for x in report.text(found).split("\n") if x and not x.startswith("    ")]
    for mark in marks:
        rows = [x.replace(mark, "") for x in rows]
    return literal(spark, "line string", [x for x in rows if "(" in x])


@query(f"SELECT label, files, relations, coalesce(v, 0) AS violations, CASE WHEN k = 1 THEN 1 ELSE 0 END AS errors, (SELECT count(*) + 1 FROM supplier WHERE s_acctbal < 0) AS for_editors FROM ({_REPORTED}) LEFT JOIN (SELECT '/' || r_name AS label, count(*) AS v FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE s_acctbal < 0 GROUP BY ALL) USING (label)")
def report_json_counts(spark, sf_dir):
    """What the JSON of both kinds holds."""
    import json

    report, found = _reported(spark, sf_dir)
    whole, editor = json.loads(report.full_json(found)), json.loads(report.editor_json(found))
    rows = [(c["Label"], c["FilesEncountered"], c["Relations"], len(c["Violations"]), len(c["Errors"]), len(editor)) for c in whole["Capsules"]]
    return literal(spark, "label string, files long, relations long, violations long, errors int, for_editors long", rows)


@query(f"SELECT src AS contract, dst AS message, min('/u' || user_id) AS capsule_dir FROM ({_STEPS}) WHERE dst IS NOT NULL GROUP BY ALL")
def dedupe_errors(spark, sf_dir):
    """Steps as errors of contracts that many capsules share: each once, for the first capsule by label."""
    rows = _steps(spark, sf_dir).select(F.concat(F.lit("/u"), "user_id").alias("capsule_dir"), F.col("src").alias("contract"), F.lit("r").alias("rule"), F.col("dst").alias("message"), F.lit(1).alias("line"))
    return distinct_errors(rows, rows.select("capsule_dir", F.col("capsule_dir").alias("label")).distinct()).select("contract", "message", "capsule_dir")


@query(f"SELECT 'no-node' AS rule, count(*) AS n FROM ({owners_sql(f'SELECT rel AS path FROM ({PAGES})')}) WHERE node_id IS NULL UNION ALL SELECT 'import-no-node', count(*) FROM ({_REL}) WHERE src IS NOT NULL AND dst IS NULL")
def union_diagnostics(spark, sf_dir):
    a = check_no_node(spark, sf_dir).groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit("no-node").alias("rule"), "n")
    return a.unionByName(check_import_no_node(spark, sf_dir).groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit("import-no-node").alias("rule"), "n"))


@query(f"SELECT rel, list(target ORDER BY page_id, ord) AS targets FROM ({_REL}) WHERE src IS NOT NULL AND dst IS NULL GROUP BY rel")
def group_by_file(spark, sf_dir):
    rows = _relations(spark, sf_dir).filter("src is not null and dst is null")
    return rows.groupBy("rel").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "ord", "target"))), lambda x: x["target"]).alias("targets"))


@query("SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR > ts THEN 0 ELSE 1 END AS g FROM events)) GROUP BY user_id, s) GROUP BY user_id")
def stream_sessions(spark, sf_dir):
    from .streaming.editor import sessions

    found = sessions(casts.read(spark, sf_dir, "events"), "user_id", "ts", "6 hours")
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


@query("SELECT CAST(user_id AS VARCHAR) AS path, arg_max(event_type, event_id) AS content, max(event_id) AS run FROM events GROUP BY user_id")
def stream_latest_overlay(spark, sf_dir):
    from .streaming.editor import latest

    return latest(casts.read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("run"), F.col("event_type").alias("content")))
