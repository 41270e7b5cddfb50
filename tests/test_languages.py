"""Recognisers, resolvers and manifests on cases written by hand."""

import pytest
from pyspark.sql import functions as F

from archspark.functions import paths
from archspark.languages import LANGUAGES, resolve_languages
from archspark.languages import resolve as targets
from archspark.sources import discover
from archspark.sources import files as trees

SOURCES = [
    ("dart", "import 'package:a/b.dart';\nexport \"x.dart\" show Y;\npart 'p.dart';\n// import 'no.dart';\n"),
    ("typescript", "import a from 'x';\nimport 'x';\nconst y = require(\"y\");\nimport('z');\nexport * from './e';\nimport {\n  q\n} from 'unseen';\n"),
    ("kotlin", "package p\nimport a.b.C\nimport a.d.*\nimport static e.F\n  import g\n"),
    ("rust", "use crate::a::b;\npub use super::c;\nmod d;\nextern crate e as f;\nuse crate::a::b;\n"),
    ("go", 'package m\n\nimport (\n\t"fmt"\n\tx "a/b" // note\n\t. "c"\n)\nimport "d"\n\nfunc f() {}\n'),
]
FOUND = [
    ("dart", "package:a/b.dart", 1, 9), ("dart", "x.dart", 2, 9), ("dart", "p.dart", 3, 7),
    ("typescript", "x", 1, 16), ("typescript", "y", 3, 20), ("typescript", "z", 4, 9), ("typescript", "./e", 5, 16),
    ("kotlin", "a.b.C", 2, 8), ("kotlin", "a.d", 3, 8), ("kotlin", "e.F", 4, 15), ("kotlin", "g", 5, 10),
    ("rust", "crate::a::b", 1, 1), ("rust", "super::c", 2, 1), ("rust", "d", 3, 1), ("rust", "e", 4, 1),
    ("go", "fmt", 4, 2), ("go", "a/b", 5, 4), ("go", "c", 6, 4), ("go", "d", 8, 8),
]


@pytest.mark.parametrize(("lang", "content"), SOURCES)
def test_imports(lang, content):
    found = [i[:3] for i in LANGUAGES[lang].parse(content.encode())]
    assert found == [w[1:] for w in FOUND if w[0] == lang]


MODULES = [("m.org/a/x/y", "m.org/a"), ("m.org/ab", "m.org/a"), ("fmt", "m.org/a"), ("m.org/a", "m.org/a")]
PACKAGES = [("dart:io", "lib/a.dart", None), ("package:shop/x/y.dart", "lib/a.dart", "lib/x/y.dart"), ("package:other/x.dart", "lib/a.dart", None), ("../b.dart", "lib/ui/a.dart", "lib/b.dart"), ("../../../b.dart", "lib/a.dart", None), ("c.dart", "lib/ui/a.dart", "lib/ui/c.dart")]
DOTTED = [("com.x.a.B", "src/jvmMain/kotlin/A.kt", "src/jvmMain/kotlin/com/x/a/B"), ("com.x", "A.kt", "src/main/kotlin/com/x"), ("com.xy.C", "A.kt", None), ("org.z", "A.kt", None)]
CRATES = [
    ("crate::a::b", "src/x.rs", "src/a"), ("crate::a", "src/x.rs", "src"), ("super::a::b", "src/m/x.rs", "src/m/a"), ("super::super::c", "src/m/n/x.rs", "src/m"), ("self::q", "src/m/x.rs", "src/m"),
    ("shop::a::b::C", "src/x.rs", "src/a/b"), ("serde::de", "src/x.rs", None), ("util", "src/m/x.rs", "src/m/util"), ("crate::a::b as c", "src/x.rs", "src/a"), ("super::z", "x.rs", "src"),
]
RESOLVED = [
    *[("go", spec, "", own, spec[len(own) + 1 :] if spec.startswith(own + "/") else None) for spec, own in MODULES],
    *[("dart", spec, rel, "shop", want) for spec, rel, want in PACKAGES],
    *[("kotlin", spec, rel, "com.x", want) for spec, rel, want in DOTTED],
    *[("rust", spec, rel, "shop", want) for spec, rel, want in CRATES],
]


def test_targets(spark):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(RESOLVED)], "i int, lang string, spec string, rel string, id string, want string")
    spec, rel, own = F.col("spec"), F.col("rel"), F.col("id")
    to = F.when(F.col("lang") == "go", targets.go(spec, own)).when(F.col("lang") == "dart", targets.dart(spec, own, rel)).when(F.col("lang") == "kotlin", targets.kotlin(spec, own, rel)).otherwise(targets.rust(spec, own, rel))
    found = {r.i: r.got for r in rows.select("i", to.alias("got")).collect()}
    assert [found[i] for i in range(len(RESOLVED))] == [r[-1] for r in RESOLVED]


ALIASES = [("/c", "@/*", ["src/*", "alt/*"], ""), ("/c", "@/ui/*", ["src/widgets/*"], ""), ("/c", "cfg", ["conf/main"], "base")]
SPECS = [("/c", "@/ui/b", "src/widgets/b"), ("/c", "@/q", "alt/q"), ("/c", "@/none", "src/none"), ("/c", "cfg", "base/conf/main")]
ENDINGS = [("src/a", "src/a.ts"), ("src/b.js", "src/b.ts"), ("src/c", "src/c/index.tsx"), ("src/d.css", "src/d.css"), ("src/e.jsx", "src/e.jsx"), ("src/f", "src/f")]


def test_aliases(spark):
    aliases = spark.createDataFrame(ALIASES, "capsule_dir string, pattern string, replacements array<string>, base_url string")
    specs = spark.createDataFrame(SPECS, "capsule_dir string, spec string, want string")
    found = targets.typescript_aliases(specs, aliases, spark.createDataFrame([("/c/alt/q",), ("/c/src/ui/b",)], "abs string"))
    assert {(r.spec, r.target) for r in found.collect()} == {s[1:] for s in SPECS}


def test_endings(spark):
    have = spark.createDataFrame([(x,) for x in ("/c/src/a.ts", "/c/src/a.js", "/c/src/b.ts", "/c/src/c", "/c/src/c/index.tsx", "/c/src/e.jsx", "/c/src/e.tsx")], "abs string")
    rows = spark.createDataFrame([("/c", t) for t, _ in ENDINGS], "capsule_dir string, target string")
    assert {(r.target, r.file) for r in targets.typescript_endings(rows, have).collect()} == set(ENDINGS)


KOTLIN_TREE = ["/k/src/main/kotlin/com/a/x/A.kt", "/k/src/main/kotlin/com/ab/B.kt", "/j/src/main/kotlin/org/q/r/C.kt", "/j/src/main/kotlin/org/q/r/s/D.kt"]
MANIFEST_TEXTS = [("/a/go.mod", "// x\nmodule \"m.org/a\"\n", "m.org/a"), ("/b/pubspec.yaml", "name: shop\n", "shop"), ("/c/package.json", '{"name": "@s/p"}', "@s/p"), ("/d/Cargo.toml", "[deps]\nname = \"no\"\n[package]\nname = \"yes\"\n", "yes"), ("/e/package.json", "{", None)]
MANIFESTS = {"/r/a/package.json": '{"name": "x"}', "/r/a/go.mod": "module m\n", "/r/c/Cargo.toml": "[package]\n", "/r/c/package.json": '{"name": "y"}', "/r/d/pubspec.yaml": "name: z\n", "/r/d/Cargo.toml": '[package]\nname = "zz"\n', "/q/go.mod": "module out\n"}
RELATIVE = [("a/b", "a/b/c", "c"), ("a/b", "a/c", "../c"), ("a", "a", "."), ("", "x/y", "x/y"), ("a/b/c", "d", "../../../d"), ("a/b", "a", "..")]


def test_package_prefixes(spark):
    found = discover.kotlin_ids(trees.from_rows(spark, dict.fromkeys(KOTLIN_TREE, "")), spark.createDataFrame([("/k",), ("/j",)], "dir string"))
    assert {tuple(r) for r in found.collect()} == {("/k", "com.a"), ("/j", "org.q.r")}


def test_manifest_names(spark):
    found = discover.manifests(trees.from_rows(spark, {p: c for p, c, _ in MANIFEST_TEXTS}))
    assert {r.dir: r.capsule_id for r in found.collect()} == {p.rsplit("/", 1)[0]: want for p, _, want in MANIFEST_TEXTS if want}


def test_first_manifests(spark):
    found = discover.capsules(trees.from_rows(spark, MANIFESTS), "/r", resolve_languages())
    assert {(r.capsule_dir, r.lang, r.capsule_id) for r in found.collect()} == {("/r/a", "go", "m"), ("/r/c", "typescript", "y"), ("/r/d", "dart", "z")}


def test_relative_paths(spark):
    rows = spark.createDataFrame(RELATIVE, "base string, target string, want string").select("want", paths.relative("base", "target").alias("rel"))
    assert all(r.rel == r.want for r in rows.collect())
