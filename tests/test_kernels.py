import random

import pytest
from pyspark.sql import functions as F

from archspark.functions import globs, paths, text
from archspark.operators import ignore, match
from archspark.sources import contracts
from archspark.sources import files as trees

from . import treeview


def column(spark, expr, rows, names):
    return [r[0] for r in spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split())).select(expr).collect()]


@pytest.mark.parametrize(
    ("glob", "path", "want"),
    [
        (".", ".", True), ("", ".", True), ("**", ".", True), ("**", "a/b", True), ("*", ".", False), ("a/**", "a", True), ("a/**", "a/b/c", True), ("a/**", "ab", False),
        ("a*/**", "ab", False), ("a*/**", "ab/c", True), ("a/*", "a/b", True), ("a/*", "a/b/c", False), ("*.*", "x.y", True), ("*.*", ".y", False), ("*a*", "aa", True), ("*a*", "a", False), ("a.b", "axb", False),
    ],
)
def test_directory_globs(spark, glob, path, want):
    assert column(spark, globs.owns("p", globs.glob_regex("g"), "g"), [(path, glob)], "p g") == [want]


def test_regex_columns_equal_literals(spark):
    some = [".", "", "**", "a", "a/**", "a*/**", "*.ts", "x/*y*z/**", "a(b)/[c]", "p/**/q", "*"]
    assert column(spark, globs.glob_regex("g"), [(g,) for g in some], "g") == [globs.regex_of(g) for g in some]


def test_specificity(spark):
    some = [".", "a", "a/b", "a/*", "a/**", "**", "a/b*c/d.ts"]
    assert column(spark, globs.specificity("g"), [(g,) for g in some], "g") == [0, 10, 20, 13, 11, 1, 23]
    assert column(spark, globs.public_specificity("g"), [(".",)], "g") == [10]


def test_owners_by_hash_joins_equal_all_pairs(spark):
    r = random.Random(7)
    words = ["a", "b", "ab", "c.ts", "d.go", "e"]
    made = [("c%d" % r.randint(0, 1), "/".join(r.choice(words) for _ in range(r.randint(1, 4)))) for _ in range(300)] + [("c0", "."), ("c1", ".")]
    parts = [*words, "*", "a*", "*.ts", "*b*"]
    nodes = [(f"c{i % 2}", f"n{i}", "/".join(r.choice(parts) for _ in range(r.randint(1, 3))) + r.choice(("", "/**"))) for i in range(40)] + [("c0", "top", "."), ("c1", "all", "**"), ("c0", "dup", "a/b"), ("c0", "dup2", "a/b")]
    at = spark.createDataFrame(made, "contract string, path string")
    own = spark.createDataFrame(nodes, "contract string, node_id string, glob string")
    fast = {tuple(x) for x in match.match_nodes(at, own).collect()}
    assert fast == {tuple(x) for x in match.match_nodes_theta(at, own).collect()} and any(n for *_, n in fast)


def test_paths(spark):
    assert column(spark, paths.node_key("p"), [("a/b.c",), ("b.c",), ("a/b",), ("a.b/c",)], "p") == ["a", ".", "a/b", "a.b"]
    assert column(spark, paths.relative("a", "b"), [("/w/x", "/w/y/z"), ("/w", "/w"), ("/w/a", "/w"), ("/", "/q")], "a b") == ["../y/z", ".", "..", "q"]
    assert column(spark, paths.ancestors("p"), [("/a/b/c",), ("/a",)], "p") == [["/a/b", "/a", "/"], ["/"]]


def test_codecs(spark):
    ids = ["a/b.c", "@x/y z", "9a", "plain", "t\tb", "v*"]
    encoded = column(spark, text.encode_id("i"), [(i,) for i in ids], "i")
    assert encoded == [contracts.encode_id(i) for i in ids] and encoded[2] == "n9a"
    assert column(spark, text.decode_id("i"), [(e,) for e in encoded], "i") == ids == [contracts.decode_id(e) for e in encoded]


DOC = """# notes

```mermaid
flowchart TD
  %% comment
  a["src/a/&ast;&ast;"]:::endophobic,x
  b[src/b] %% note
  a --> b --> c_dash_d["src/c-d"]
  classDef x fill:#fff
```
"""


def test_contract_round_trip():
    c = contracts.parse(DOC)
    assert c.nodes == {"a": "src/a/**", "b": "src/b", "c-d": "src/c-d"} and set(c.edges) == {("a", "b"), ("b", "c-d")}
    assert c.lines == {"a": 6, "b": 7, "c-d": 8} and c.classes == {"a": {"endophobic", "x"}}
    for colours in ("vibrant", "none", "mono"):
        again = contracts.parse(contracts.render(c, colours))
        assert (again.nodes, set(again.edges), again.classes) == (c.nodes, set(c.edges), c.classes)
        assert contracts.render(again, colours) == contracts.render(c, colours)
    lines = contracts.render(c, "vibrant").split("\n")
    assert "  style a stroke:#0f4cde,stroke-width:2px,stroke-dasharray:5 5" in lines and "  linkStyle 0 stroke:#0f4cde,stroke-width:2px" in lines


@pytest.mark.parametrize(
    ("body", "message", "line"),
    [
        ("a[x]\na --> a", "edge references same node on both sides: a → a", 5),
        ("a[x*]", 'node "a" uses raw "*" in glob "x*"; write &ast; instead', 4),
        ("a[x]\na[y]", 'node "a" redefined with a different glob ("x" vs "y")', 5),
        ("a[x]\na -->", 'edge has fewer than two nodes: "a -->"', 5),
        ("a[x]\na --> 1b", 'invalid edge token "1b" in line "a --> 1b"', 5),
        ("%% none", "mermaid block declared no nodes", 0),
    ],
)
def test_contract_errors(body, message, line):
    with pytest.raises(contracts.ContractError) as e:
        contracts.parse(f"x\n```mermaid\nflowchart TD\n{body}\n```\n")
    assert (e.value.message, e.value.line) == (message, line)


def test_block_errors():
    for doc, message in (("x", "no ```mermaid block found"), ("```mermaid\na", "unclosed ```mermaid block"), (DOC + DOC, "multiple ```mermaid blocks found")):
        with pytest.raises(contracts.ContractError, match=message):
            contracts.parse(doc)


@pytest.mark.parametrize(
    ("rule", "path", "want"),
    [
        ("build/", "x/build/", True), ("build/", "x/build", False), ("build", "build/y/z", True), ("*.log", "a/b.log", True), ("/a/*.c", "a/b.c", True), ("/a/*.c", "x/a/b.c", False), ("a/**", "a/b/c", True),
        ("**/q", "q", True), ("**/q", "x/y/q", True), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True), ("[a-c]x", "bx", True), ("[!a-c]x", "bx", False), ("[[:digit:]]", "7", True), ("[[:nope:]]", "7", False), (r"\*x", "*x", True), ("f?o", "fxo", True), ("doc/x", "y/doc/x", False),
    ],
)
def test_ignore_rules(spark, rule, path, want):
    regex, _, _ = ignore.rule_regex(rule)
    assert column(spark, F.rlike("p", F.lit(regex)), [(path,)], "p") == [want]


DRAWING = """
w
├── .git
├── .gitignore
├── a/
│   ├── keep.x
│   ├── gone.log
│   └── deep/
│       └── .gitignore
└── build/
    └── out.x
"""


def test_layers_and_pruning(spark):
    files = dict.fromkeys(treeview.parse(DRAWING, "/w"), "")
    assert set(files) == {"/w/.git", "/w/.gitignore", "/w/a/keep.x", "/w/a/gone.log", "/w/a/deep/.gitignore", "/w/build/out.x"}
    files |= {"/w/.gitignore": "*.log\n# note\n!kept.log\n", "/w/a/deep/.gitignore": "*\n!*.log\n", "/w/a/deep/z.log": "", "/w/a/kept.log": "", "/w/a/deep/y": ""}
    seen = {r.abs for r in trees.visible(trees.from_rows(spark, files), "/w").filter("not is_dir").collect()}
    assert seen == {"/w/.git", "/w/.gitignore", "/w/a/keep.x", "/w/a/kept.log", "/w/a/deep/z.log"}


def test_overlay(spark):
    base = trees.from_rows(spark, {"/w/a": "1", "/w/b": "2"})
    payload = spark.createDataFrame([('{"files": [{"path": "/w/./a", "content": "x"}, {"path": "/w/a", "content": "y"}, {"path": "/w/d/e", "content": "z"}]}',)], "json string")
    got = {r.abs: r.content for r in trees.overlay(base, trees.overlay_rows(payload)).collect()}
    assert {k: v and bytes(v) for k, v in got.items()} == {"/w": None, "/w/a": b"y", "/w/b": b"2", "/w/d": None, "/w/d/e": b"z"}


def test_tree_source(spark, tmp_path):
    (tmp_path / ".hid" / "in").mkdir(parents=True)
    (tmp_path / ".hid" / "in" / "_x").write_text("1")
    (tmp_path / ".gitignore").write_text("q")
    got = {r.abs.removeprefix(str(tmp_path)): r.is_dir for r in trees.read_tree(spark, str(tmp_path)).collect()}
    assert got == {"/.gitignore": False, "/.hid": True, "/.hid/in": True, "/.hid/in/_x": False}
