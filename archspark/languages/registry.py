"""The registry as data: file tests as columns, manifests and ignored names as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import recognise

# Where Kotlin sources live, in the order of preference, and where generated ones do.
KOTLIN_MAIN = (
    "src/main/kotlin", "src/main/java", "src/jvmMain/kotlin", "src/jvmMain/java", "src/commonMain/kotlin", "src/androidMain/kotlin",
    "src/androidUnitTest/kotlin", "src/iosMain/kotlin", "src/iosArm64Main/kotlin", "src/iosSimulatorArm64Main/kotlin", "src/macosMain/kotlin", "src/macosX64Main/kotlin",
    "src/macosArm64Main/kotlin", "src/linuxMain/kotlin", "src/linuxX64Main/kotlin", "src/darwinMain/kotlin", "src/nativeMain/kotlin", "src/jsMain/kotlin",
    "src/mingwMain/kotlin", "src/mingwX64Main/kotlin",
)
KOTLIN_PREFIXES = (
    "src/main/kotlin", "src/main/java", "src/jvmMain/kotlin", "src/jvmMain/java", "src/jvmTest/kotlin", "src/commonMain/kotlin",
    "src/commonTest/kotlin", "src/androidMain/kotlin", "src/androidUnitTest/kotlin", "src/androidAndroidTest/kotlin", "src/androidInstrumentedTest/kotlin", "src/iosMain/kotlin",
    "src/iosTest/kotlin", "src/iosArm64Main/kotlin", "src/iosArm64Test/kotlin", "src/iosSimulatorArm64Main/kotlin", "src/iosSimulatorArm64Test/kotlin", "src/macosMain/kotlin",
    "src/macosTest/kotlin", "src/macosX64Main/kotlin", "src/macosX64Test/kotlin", "src/macosArm64Main/kotlin", "src/macosArm64Test/kotlin", "src/linuxMain/kotlin",
    "src/linuxTest/kotlin", "src/linuxX64Main/kotlin", "src/linuxX64Test/kotlin", "src/darwinMain/kotlin", "src/darwinTest/kotlin", "src/nativeMain/kotlin",
    "src/nativeTest/kotlin", "src/jsMain/kotlin", "src/jsTest/kotlin", "src/mingwMain/kotlin", "src/mingwTest/kotlin", "src/mingwX64Main/kotlin",
    "src/mingwX64Test/kotlin",
)
KOTLIN_GENERATED = ("/generated/", "/kapt/", "/ksp/", "/buildSrc/")
#: Ignored at any depth in every repository.
ALWAYS_IGNORED = (".git", ".hg", ".svn", ".idea", ".vscode", ".vs", "coverage")


@dataclass(frozen=True)
class Language:
    name: str
    manifests: tuple[str, ...]
    parse: Callable[[bytes], Iterable[recognise.Import]] = field(repr=False)
    capsule_id: Callable[[str], str | None] | None = field(repr=False)  # None: from the source tree
    file_globs: bool
    ignored: tuple[str, ...]
    suffixes: tuple[str, ...]


# Manifests, ignored names and suffixes of each language.
LANGUAGES = {
    x.name: x
    for x in (
        Language("dart", ("pubspec.yaml",), recognise.dart, recognise.pubspec_name, True, (".dart_tool", ".pub", "*.g.dart", "*.freezed.dart", "*_test.dart"), (".dart",)),
        Language("go", ("go.mod",), recognise.go, recognise.module_line, False, ("vendor", "*_test.go"), (".go",)),
        Language("kotlin", ("build.gradle.kts", "build.gradle"), recognise.kotlin, None, False, ("build", ".kotlin"), (".kt",)),
        Language("rust", ("Cargo.toml",), recognise.rust, recognise.crate_name, False, ("target",), (".rs",)),
        Language("typescript", ("package.json",), recognise.typescript, recognise.package_name, True, ("node_modules", "*.d.ts", "*.d.tsx", "*.test.ts", "*.test.tsx", "*.spec.ts", "*.spec.tsx"), (".ts", ".tsx")),
    )
}


def resolve_languages(names: str = "") -> list[Language]:
    """A comma-separated list, all for an empty one; an unknown name is a ValueError."""
    wanted = [n.strip() for n in names.split(",") if n.strip()] or list(LANGUAGES)
    if unknown := [n for n in wanted if n not in LANGUAGES]:
        raise ValueError(f"unknown language: {', '.join(unknown)}")
    return [LANGUAGES[n] for n in wanted]


def manifest_table(spark: SparkSession) -> DataFrame:
    """lang, manifest, rank: languages by name, then manifests in their order."""
    rows = [(x.name, m, 10 * i + j) for i, x in enumerate(sorted(LANGUAGES.values(), key=lambda x: x.name)) for j, m in enumerate(x.manifests)]
    return spark.createDataFrame(rows, "lang string, manifest string, rank int")


def base_ignore_lines() -> list[str]:
    """Rules of the lowest layer: of all languages, whichever are looked at; a name without `*` means directories."""
    names = sorted({*ALWAYS_IGNORED, *(n for x in LANGUAGES.values() for n in x.ignored)})
    return [n if "*" in n else f"{n}/" for n in names] + ["coverage.lcov"]


def scannable(rel: Column, lang: Column) -> Column:
    """Whether a file relative to its capsule counts for a language."""
    ends = lambda *s: F.rlike(rel, F.lit("(" + "|".join(x.replace(".", r"\.") for x in s) + ")$"))
    base = F.element_at(F.split(rel, "/"), -1)
    kotlin = (
        ends(".kt")
        & ~F.rlike(base, F.lit(r"(Test\.kt|_test\.kt|\.kt\.kt)$"))
        & ~F.rlike(rel, F.lit("(" + "|".join(KOTLIN_GENERATED) + ")"))
        & F.rlike(rel, F.lit("^(" + "|".join(KOTLIN_PREFIXES) + ")/"))
    )
    out = F.when(lang == "kotlin", kotlin)
    for x in LANGUAGES.values():
        if x.name != "kotlin":
            out = out.when(lang == x.name, ends(*x.suffixes) & (F.length(rel) > min(map(len, x.suffixes)) - (x.name == "typescript")))
    return out.otherwise(False)
