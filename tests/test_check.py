import pytest

from archspark.plans import report
from archspark.plans.check import check
from archspark.sources import files as trees


def contract(*lines):
    return "# notes\n\n```mermaid\nflowchart TD\n" + "\n".join(lines) + "\n```\n"


GO = {
    "go.mod": "module ex.org/shop\n",
    "CONTRACT.md": contract('api["api/&ast;&ast;"]', "store[store]", "model[model]:::endophobic", "api --> model", "model --> store"),
    "api/a.go": 'package api\n\nimport (\n\t"fmt"\n\t"ex.org/shop/store"\n\tm "ex.org/shop/model"\n)\n',
    "model/m.go": 'package model\nimport "ex.org/shop/model"\n',
    "store/s.go": "package store\n",
    "other/o.go": 'package other\nimport "ex.org/shop/store"\n',
    "api/a_test.go": 'package api\nimport "ex.org/shop/other"\n',
}

#: Capsules of one tree: one check looks at all of them.
CAPSULES = {
    "rules": GO,
    "syntax": GO | {"api/b.go": "package api\nimport 5\n"},
    "unreadable": GO | {"CONTRACT.md": contract("what is this")},
    "locked": GO | {"CONTRACT.md": None},
    "shut": GO | {"store/s.go": None},
    "cross": {
        "pubspec.yaml": "name: shop\n",
        "CONTRACT.md": contract('ui["lib/ui/&ast;&ast;"]', 'core["lib/core/&ast;&ast;"]', "ui --> core"),
        "lib/ui/CONTRACT.md": contract('all["&ast;&ast;"]'),
        "lib/ui/page.dart": "import 'package:shop/core/core.dart';\nimport 'dart:io';\n",
        "lib/core/core.dart": "import '../ui/page.dart';\n",
    },
    "errors": {
        "go.mod": "module m\n",
        "CONTRACT.md": contract("a[x]", "b[x]", 'c["x/y.go"]', 'd["../z"]', "a --> b --> a", "a --> nope"),
        "x/x.go": "package x\n",
    },
    "overlap": {
        "Cargo.toml": '[package]\nname = "shop"\n',
        "CONTRACT.md": contract('a["src/&ast;&ast;"]', 'b["src/api"]', 'c["lib/&ast;"]', 'd["lib/x"]'),
        "src/api/mod.rs": "use crate::core::x;\n",
    },
    "aliases": {
        ".gitignore": "gen/\n!gen/keep\n",
        "package.json": '{"name": "@x/app"}',
        "tsconfig.json": '{"compilerOptions": {"baseUrl": "./", "paths": {"@/*": ["src/*"]}}}',
        "CONTRACT.md": contract('ui["src/ui/&ast;&ast;"]', 'io["src/io/&ast;&ast;"]'),
        "src/ui/a.ts": "import { b } from '@/io/b';\nimport x from '../io/b.js';\nimport g from './gen/g';\nimport r from 'react';\n",
        "src/io/b.ts": "export const b = 1;\n",
        "src/ui/gen/g.ts": "import '../../io/b';\n",
    },
    "bare": {"go.mod": "module none\n", "x/x.go": "package x\n"},
}

RELATION = " — relation not allowed (add edge in CONTRACT.md or move the file)"
VIOLATIONS = {
    "rules": [
        ("endophobic", "model/m.go:2:8 (model) → model (model) — model is endophobic (CONTRACT.md)"),
        ("import-no-node", 'other/o.go:2:8: import "ex.org/shop/store" matches no node in CONTRACT.md'),
        ("import-not-allowed", "api/a.go:5:2 (api) → store (store)" + RELATION),
        ("no-node", "other/o.go is tracked by CONTRACT.md but matches no node"),
    ],
    "cross": [("import-not-allowed", "lib/core/core.dart:1:9 (core) → lib/ui/page.dart (ui)" + RELATION)],
    "aliases": [("import-not-allowed", f"src/ui/a.ts:{at} (ui) → src/io/b.ts (io)" + RELATION) for at in ("1:20", "2:16")],
}
VIOLATIONS["shut"] = VIOLATIONS["rules"]
ERRORS = {
    "locked": ["read CONTRACT.md: permission denied"],
    "unreadable": ["unrecognized mermaid line: what is this (CONTRACT.md:5)"],
    "errors": [
        "c (CONTRACT.md:7) references x/y.go — file-shaped nodes require a language that supports file globs",
        "circular dependency: a → b → a (CONTRACT.md:9)",
        'd (CONTRACT.md:8) references ../z — ".." not allowed in node globs',
        'edge references undefined node "nope" (CONTRACT.md:10)',
        'glob "x" claimed by multiple nodes: a, b (CONTRACT.md:6)',
    ],
    "overlap": ['node "a" (CONTRACT.md:5) and node "b" (CONTRACT.md:6) overlap — file src/api/mod.rs matches both globs'],
}


TREE = {"/w/.git": ""} | {f"/w/{name}/{path}": text for name, files in CAPSULES.items() for path, text in files.items()}


@pytest.fixture(scope="module")
def found(spark):
    return report.collect(check(trees.from_rows(spark, TREE), "/w"))


@pytest.fixture(scope="module")
def by_name(found):
    return {c.label.removeprefix("/w/"): (c, violations, errors) for c, violations, errors in found["capsules"]}


@pytest.mark.parametrize("name", list(CAPSULES))
def test_capsule(by_name, name):
    if name == "bare":
        assert name not in by_name
        return
    _, violations, errors = by_name[name]
    short = lambda m: m.replace(f"/w/{name}/", "")
    assert sorted((v.rule, short(v.message)) for v in violations) == VIOLATIONS.get(name, [])
    assert sorted(short(e.message) for e in errors) == sorted(ERRORS.get(name, []))


def test_counts(by_name):
    numbers = lambda n: tuple(by_name[n][0][k] for k in ("files_encountered", "files_scanned", "relations", "nodes", "edges"))
    assert numbers("rules") == (4, 3, 3, 3, 2)
    assert numbers("shut") == (4, 2, 3, 3, 2)
    assert numbers("errors") == (0, 0, 0, 4, 3)
    assert "import path must be a string" in by_name["syntax"][0].source_error
    assert report.stats(by_name["rules"][0]) == " (3 of 4 files scanned, 3 internal imports checked, graph: 3 nodes, 2 edges)"


def test_renderers(found):
    text = report.text(found)
    assert "✗ /w/rules (3 of 4 files scanned" in text and "    violation [no-node]: other/o.go is tracked by" in text and "✗ /w/syntax: " in text
    assert '"FilesScanned": 3' in report.full_json(found) and report.editor_json(found).startswith('[{"rule":')


def test_within_looks_into_one_capsule(spark, by_name):
    some = check(trees.from_rows(spark, TREE), "/w", within=["/w/rules"])
    assert {r.capsule_dir for r in some.tracked.select("capsule_dir").distinct().collect()} == {"/w/rules"}
    own = {c.label: (c, violations) for c, violations, _ in report.collect(some)["capsules"]}["/w/rules"]
    assert own == by_name["rules"][:2]
