"""Drafts that cycle are taken apart; existing contracts are amended."""

import pytest

from archspark.languages import LANGUAGES
from archspark.plans import dump
from archspark.sources import contracts
from archspark.sources import files as trees

from .test_check import contract

X, Y, P, Q, R = "api/x.ts", "api/y.ts", "jobs/p.ts", "jobs/q.ts", "jobs/r.ts"
#: References between api (two files) and jobs (three); then the nodes and edges of the draft.
CYCLES = {
    # x needs p and q needs y: either side alone breaks it, the smaller one is tried first.
    "smaller": ([(X, P), (Q, Y)], {X, Y, "jobs"}, {(X, "jobs"), ("jobs", Y)}),
    # Both relations are x's: only the other side can break it.
    "larger": ([(X, P), (Q, X)], {"api", P, Q, R}, {("api", P), (Q, "api")}),
    "both": ([(X, P), (Q, X), (Y, R), (R, X)], {X, Y, P, Q, R}, {(X, P), (Q, X), (Y, R), (R, X)}),
    "real": ([(X, P), (P, X)], {X, Y, P, Q, R}, {(X, P), (P, X)}),
}


@pytest.mark.parametrize("name", CYCLES)
def test_cycles_take_merged_directories_apart(spark, name):
    relations, nodes, edges = CYCLES[name]
    inside = spark.createDataFrame([(f"/w/{p}", p) for p in (X, Y, P, Q, R)], "abs string, rel string")
    references = spark.createDataFrame([(f"/w/{a}", f"/w/{b}") for a, b in relations], "abs string, target_abs string")
    how = (inside, references, "/w", [], LANGUAGES["typescript"])
    first = dump._draft(*how, True, ())
    assert set(first.nodes) == {"api", "jobs"} and set(first.edges) == {("api", "jobs"), ("jobs", "api")}
    best = dump._expanded(*how, first, dump._cycles(first))
    assert set(best.nodes) == nodes and set(best.edges) == edges


CAPSULES = {
    "gaps": {
        "go.mod": "module ex.org/gaps\n",
        "CONTRACT.md": contract('cases["in/cases"]:::endophobic', 'old["in/old"]'),
        "in/cases/c.go": 'package cases\nimport "ex.org/gaps/in/model"\n',
        "in/model/m.go": "package model\n",
        "in/old/o.go": 'package old\nimport "ex.org/gaps/in/cases"\n',
    },
    "loop": {
        "go.mod": "module ex.org/loop\n",
        "CONTRACT.md": contract('a["a"]', 'b["b"]', "a --> b", "b --> a"),
        "a/a.go": "package a\n",
        "c/c.go": "package c\n",
    },
    "locked": {"go.mod": "module ex.org/locked\n", "CONTRACT.md": None, "a/a.go": "package a\n"},
    "unclosed": {"go.mod": "module ex.org/unclosed\n", "CONTRACT.md": "```mermaid\nflowchart TD\na[a]\n", "a/a.go": "package a\n"},
}


def test_amendment(spark):
    tree = {"/w/.git": ""} | {f"/w/{name}/{path}": text for name, files in CAPSULES.items() for path, text in files.items()}
    found = dump.dump(trees.from_rows(spark, tree), "/w", colours_name="none")
    # Contracts with errors stay as they are.
    assert sorted(found.errors) == [("/w/locked/CONTRACT.md", "read /w/locked/CONTRACT.md: permission denied"), ("/w/loop/CONTRACT.md", "circular dependency"), ("/w/unclosed/CONTRACT.md", "unclosed ```mermaid block")]
    (got,) = found.contracts
    assert (got.path, got.is_new, got.added_nodes, got.added_edges) == ("/w/gaps/CONTRACT.md", False, 1, 2)
    read = contracts.parse(got.text)
    assert read.nodes == {"cases": "in/cases", "old": "in/old", "in/model": "in/model"}
    assert set(read.edges) == {("cases", "in/model"), ("old", "cases")}
    assert 'cases["in/cases"]:::endophobic' in got.text
