import io
import sys

from archspark import cli
from archspark.plans import dump
from archspark.sources import contracts
from archspark.sources import files as trees


def test_restyle_is_stable_and_isolates_errors():
    doc = "```mermaid\ngraph TD\nb[y]\na[x]\na --> b\n```\n"
    first = dump.restyle([("z", doc), ("q", "nothing")])
    assert [(p, new is not None, error) for p, new, error in first] == [("q", False, "no ```mermaid block found"), ("z", True, None)]
    assert dump.restyle([("z", first[1][1])]) == [("z", None, None)]


def test_cycles_are_found_in_order():
    c = contracts.Contract(nodes={"a": "a", "b": "b", "c": "c"}, edges={("a", "b"): 1, ("b", "a"): 2, ("b", "c"): 3, ("c", "a"): 4, ("c", "x"): 5})
    assert dump._cycles(c) == [["a", "b", "a"], ["a", "b", "c", "a"]]


def test_dump_drafts_merged_directories(spark):
    tree = {
        "/w/.git": "",
        "/w/pubspec.yaml": "name: shop\n",
        "/w/lib/ui/a.dart": "import '../core/c.dart';\n",
        "/w/lib/ui/b.dart": "import 'a.dart';\n",
        "/w/lib/core/c.dart": "",
        "/w/lib/core/d.dart": "import 'c.dart';\n",
        "/w/main.dart": "import 'lib/ui/a.dart';\n",
    }
    result = dump.dump(trees.from_rows(spark, tree), "/w", colours_name="none")
    assert result.errors == [] and [c.path for c in result.contracts] == ["/w/CONTRACT.md"]
    got = contracts.parse(result.contracts[0].text)
    assert got.nodes == {"lib/core": "lib/core/*.*", "lib/ui": "lib/ui/*.*", "main.dart": "main.dart"}
    assert set(got.edges) == {("lib/ui", "lib/core"), ("main.dart", "lib/ui")}


def test_commands(monkeypatch, capsys):
    assert cli.main(["manual"]) == 0 and "contract" in capsys.readouterr().out
    monkeypatch.setattr(sys, "stdin", io.StringIO("```mermaid\na[x]\n```\n"))
    assert cli.main(["restyle", "--stdin", "--palette", "none"]) == 0 and "  a[\"x\"]" in capsys.readouterr().out
    monkeypatch.setattr(sys, "stdin", io.StringIO("none"))
    assert cli.main(["restyle", "--stdin"]) == 1
