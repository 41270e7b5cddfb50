"""The analytic tables seen as source trees, references and contracts, for queries with a SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Nodes over the paths of pages, and the edges allowed between them.
NODES = (("root", "."), ("en", "en/**"), ("french", "fr/**"), ("german", "de/**"), ("german_pages", "de/*.html"), ("spanish", "es"), ("ones", "en/1*"), ("capital", "T*"), ("deep", "a*/b*c/**"), ("short", "an"))
EDGES = (("en", "capital"), ("french", "capital"), ("german", "capital"), ("en", "short"), ("german", "short"), ("capital", "en"), ("ones", "capital"))
ENDOPHOBIC = ("capital",)
EVENT_EDGES = (("view", "click"), ("click", "purchase"), ("signup", "view"), ("view", "error"))
ROLE_EDGES = (("user", "assistant"), ("assistant", "user"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(spark: SparkSession, columns: str, rows: tuple | list) -> DataFrame:
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], columns)


def values(columns: str, rows: tuple | list) -> str:
    """The same rows for SQL: `columns` are names."""

    def one(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, (list, tuple)):
            return "[" + ", ".join(map(one, x)) + "]"
        return str(x).lower() if isinstance(x, (bool, int, float)) else "'" + str(x).replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(one, r if isinstance(r, tuple) else (r,))) + ')' for r in rows)}) AS v({columns})"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, capsule (host), rel (path without query, fragment and outer slashes; `.` for none), html."""
    rel = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]+/?", ""), "[?#].*$", ""), "/$", "")
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("capsule"), F.when(rel == "", ".").otherwise(rel).alias("rel"), "html")


PAGES = "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS capsule, CASE WHEN r = '' THEN '.' ELSE r END AS rel, html FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+/?', ''), '[?#].*$', ''), '/$', '') AS r FROM pages)"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, capsule, rel, ord, target: what pages refer to within their capsule."""
    rows = pages(spark, sf_dir).select("page_id", "capsule", "rel", F.posexplode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("ord", "target"))
    return rows


LINKS = f"""SELECT page_id, capsule, rel, i - 1 AS ord, t[i] AS target FROM (SELECT page_id, capsule, rel, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT page_id, capsule, rel, regexp_extract_all(html, 'href="/([^"]*)"', 1) AS t FROM ({PAGES})))"""


def nodes(spark: SparkSession) -> DataFrame:
    rows = [("pages", i, g, k + 1, ["endophobic"] if i in ENDOPHOBIC else []) for k, (i, g) in enumerate(NODES)]
    return spark.createDataFrame(rows, "contract string, node_id string, glob string, line int, classes array<string>")


def edges(spark: SparkSession, rows: tuple = EDGES, contract: str = "pages") -> DataFrame:
    return spark.createDataFrame([(contract, a, b, i + 1) for i, (a, b) in enumerate(rows)], "contract string, src string, dst string, line int")


#: What the globs of NODES mean, stated for SQL: pattern, whether it is a file's, specificity.
MEANT = {
    "root": (r"^\.$", False, 0), "en": (r"^en($|/)", False, 11), "french": (r"^fr($|/)", False, 11), "german": (r"^de($|/)", False, 11), "german_pages": (r"^de/[^/]*\.html$", True, 13),
    "spanish": ("^es$", False, 10), "ones": ("^en/1[^/]*$", False, 13), "capital": ("^T[^/]*$", False, 3), "deep": ("^a[^/]*/b[^/]*c/", False, 7), "short": ("^an$", False, 10),
}
NODES_SQL = "SELECT * FROM " + values("node_id, pat, rx, is_file, weight, endophobic", [(i, g, *MEANT[i], i in ENDOPHOBIC) for i, g in NODES])
EDGES_SQL = "SELECT * FROM " + values("src, dst", EDGES)
KEY_SQL = "CASE WHEN instr({0}, '.') = 0 THEN {0} WHEN instr({0}, '/') = 0 THEN '.' ELSE regexp_replace({0}, '/[^/]*$', '') END"


def owners_sql(relation: str, path: str = "path") -> str:
    """SQL for (path, node_id, null without an owner) of the relation's distinct paths."""
    key = KEY_SQL.format(path)
    return f"""SELECT p.{path}, n.node_id FROM (SELECT DISTINCT {path} FROM ({relation})) p LEFT JOIN (
  SELECT {path}, node_id FROM (
    SELECT q.{path}, node_id, row_number() OVER (PARTITION BY q.{path} ORDER BY is_file DESC, weight DESC, node_id) AS k
    FROM (SELECT DISTINCT {path} FROM ({relation})) q JOIN ({NODES_SQL}) m
      ON CASE WHEN is_file THEN regexp_matches(q.{path}, rx) AND q.{path} <> '.' ELSE regexp_matches({key.replace(path, "q." + path)}, rx) AND ({key.replace(path, "q." + path)} <> '.' OR pat IN ('', '.', '**')) END)
  WHERE k = 1) n ON n.{path} = p.{path}"""
