"""Contracts inferred from what is observed, amended by what a check finds, and restyled."""

from __future__ import annotations

import posixpath
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import groupby
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..languages import Language, resolve_languages, scannable
from ..operators import validate
from ..operators.match import nearest_ancestor
from ..schema import CONTRACT_FILE
from ..sources import contracts as contract_files
from ..sources import discover, files as trees
from ..sources.contracts import Contract
from ..sources.shared import cut

if TYPE_CHECKING:
    from .check import Check


def merged_dirs(files: DataFrame) -> DataFrame:
    """(contract, rel) -> contract, dir, glob, files: directories but the top one with several files."""
    own = files.select("contract", paths.dirname("rel").alias("dir")).filter("dir <> '.'")
    return own.groupBy("contract", "dir").agg(F.count(F.lit(1)).alias("files")).filter("files > 1").withColumn("glob", F.concat("dir", F.lit("/*.*")))


def draft(files: DataFrame, relations: DataFrame, file_globs: bool, merge: bool, expanded: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rel) and (rel, target_rel) of one contract -> its nodes (node_id, glob) and edges (src, dst).

    A node for each file, or each directory in languages without file globs; with `merge`, one
    for each directory of several files that isn't expanded.
    """
    merged = merged_dirs(files.select(F.lit("").alias("contract"), "rel")).select("dir", "glob")
    merged = merged.filter(~F.col("dir").isin(*expanded)) if merge and (expanded := list(expanded)) else merged if merge else merged.limit(0)

    def named(rows: DataFrame, column: str, name: str) -> DataFrame:
        own = rows.withColumn("dir", paths.dirname(column)).join(merged, "dir", "left")
        plain = paths.node_key(column, file_globs)
        return own.withColumn(name, F.when(F.col("glob").isNotNull(), paths.node_key("dir")).otherwise(plain)).withColumn(f"{name}_glob", F.coalesce("glob", plain)).drop("dir", "glob")

    ends = named(named(relations.select("rel", "target_rel").distinct(), "rel", "src"), "target_rel", "dst")
    nodes = named(files.select("rel"), "rel", "src").select(F.col("src").alias("node_id"), F.col("src_glob").alias("glob"))
    nodes = nodes.union(ends.select("dst", "dst_glob")).groupBy("node_id").agg(F.max("glob").alias("glob"))
    return nodes, ends.filter("src <> dst").select("src", "dst").distinct()


def added(before: Contract, after: Contract) -> tuple[int, int]:
    """Nodes and edges that only the later one has."""
    return len(after.nodes.keys() - before.nodes.keys()), len(after.edges.keys() - before.edges.keys())


@dataclass
class Dumped:
    path: str
    is_new: bool
    nodes: int = 0
    edges: int = 0
    added_nodes: int = 0
    added_edges: int = 0
    text: str = ""


@dataclass
class DumpResult:
    contracts: list[Dumped] = field(default_factory=list)
    errors: list[tuple[str, str]] = field(default_factory=list)


def restyle(documents: Iterable[tuple[str, str]], colours_name: str = "vibrant") -> list[tuple[str, str | None, str | None]]:
    """(path, text) -> (path, new text or None if nothing changes, error): contracts read and written again, by path."""
    out = []
    for path, text in sorted(documents):
        try:
            new = contract_files.render(contract_files.parse(text), colours_name)
            out.append((path, new if new != text else None, None))
        except contract_files.ContractError as e:
            out.append((path, None, str(e)))
    return out


def _relations(files: DataFrame, caps: DataFrame, dirs: list[str]) -> tuple[DataFrame, DataFrame]:
    """Scannable files (capsule_dir, abs, rel) of capsules that don't hold each other and their visible internal references (capsule_dir, abs, target_abs), whatever contracts say."""
    from .check import parse_imports, resolved

    own = caps.join(_column(files, "capsule_dir", dirs), "capsule_dir", "left_semi")
    plain = files.filter(~F.col("is_dir")).withColumn("dir", paths.dirname("abs"))
    owner = nearest_ancestor(plain.select("dir"), own.select(F.col("capsule_dir").alias("dir"))).filter("owner is not null").withColumnRenamed("owner", "capsule_dir")
    inside = plain.join(owner, "dir").drop("dir").join(own, "capsule_dir").withColumn("rel", F.expr("substring(abs, length(capsule_dir) + 2)"))
    inside = inside.filter(scannable(F.col("rel"), F.col("lang")))
    imports = parse_imports(inside).select("abs", F.explode("imports").alias("i")).select("abs", "i.path").distinct()
    rows = inside.drop("content").join(imports, "abs")
    references = resolved(rows, own, files, trees.empty_dirs(files, files)).select("capsule_dir", "abs", "target_abs").distinct()
    return cut(inside.select("capsule_dir", "abs", "rel")), cut(references)


def _column(like: DataFrame, name: str, values: Iterable[str]) -> DataFrame:
    return like.sparkSession.createDataFrame([(v,) for v in values], f"{name} string")


@dataclass
class _Capsule:
    """What is to be done for one capsule: contracts to amend in turn, and whether one is to be drafted."""

    dir: str
    language: Language
    start: str
    scoped: list[str]
    turns: list[str]
    drafted: bool
    result: DumpResult = field(default_factory=DumpResult)
    new: dict[str, Dumped] = field(default_factory=dict)


def dump(files: DataFrame, root: str, languages: list[Language] | None = None, colours_name: str = "vibrant", contract_name: str = CONTRACT_FILE) -> DumpResult:
    """Contracts for every capsule: existing ones are amended, missing ones drafted; deepest capsules first.

    A contract written for one capsule is seen by those around it. Capsules of one depth
    don't hold each other, so they go together: a check for each language and each turn,
    in which every capsule has one contract amended, and one plan for all references that
    new contracts are drafted from. Contracts themselves, of the size a person reads, are
    put together on the driver.
    """
    from .check import check

    languages = languages or resolve_languages()
    caps = cut(discover.capsules(cut(trees.visible(files, root)), root, languages))
    todo = [(r.capsule_dir, r.lang) for r in caps.orderBy(*dump_order("capsule_dir")).collect()]
    if not todo:
        raise ValueError(f"no capsules found at {root}")
    result, written = DumpResult(), {}
    by_name = {x.name: x for x in languages}

    def current() -> DataFrame:
        return trees.overlay(files, files.sparkSession.createDataFrame([(p, t) for p, t in written.items()], "abs string, content string")) if written else files

    def amend(turn: list[tuple[_Capsule, str]], texts: dict[str, str | None]) -> None:
        for language in dict.fromkeys(c.language for c, _ in turn):
            own = []
            for c, path in turn:
                if c.language != language:
                    continue
                if (text := texts[path]) is None:
                    c.result.errors.append((path, contract_files.unreadable(path)))
                    continue
                try:
                    own.append((c, path, contract_files.parse(text)))
                except contract_files.ContractError as e:
                    c.result.errors.append((path, str(e)))
            if own:
                _amend(check(current(), root, [language], contract_name, within=[c.dir for c, _, _ in own]), own, written, colours_name)

    for _, level in groupby(todo, lambda c: c[0].count("/") if c[0] != "/" else 0):
        seen = cut(trees.visible(current(), root))
        found = {r.dir: r for r in discover.contract_dirs(seen, contract_name).select("dir", "contract", "content").collect()}
        texts = {r.contract: None if r.content is None else r.content.decode("utf-8", "replace") for r in found.values()}
        capsules = []
        for capsule_dir, lang in level:
            start = root if root == capsule_dir or root.startswith(capsule_dir + "/") else capsule_dir
            at = next((d for d in _upward(start, capsule_dir) if d in found), None)
            below = sorted(d for d in found if (d + "/").startswith(capsule_dir + "/") and d != at)
            scoped = [d for d in found if d.startswith(start + "/")]
            capsules.append(_Capsule(capsule_dir, by_name[lang], start, scoped, [found[d].contract for d in [*below, *([at] if at is not None else [])]], at is None))
        for turn in range(max(len(c.turns) for c in capsules)):
            amend([(c, c.turns[turn]) for c in capsules if turn < len(c.turns)], texts)
        if fresh := [c for c in capsules if c.drafted]:
            inside, references = _relations(cut(trees.visible(current(), root)), caps, [c.dir for c in fresh])
            ready = []
            for c in fresh:
                of = lambda rows: rows.filter(F.col("capsule_dir") == c.dir)  # noqa: B023, E731
                best = _drafted(of(inside), of(references), c)
                if not best.nodes:
                    c.result.errors.append((c.dir, f"capsule at {c.start} has no scannable files to dump"))
                    continue
                path = posixpath.join(c.start, contract_name)
                written[path] = texts[path] = contract_files.render(best, colours_name)
                c.new[path] = Dumped(path, True, len(best.nodes), len(best.edges), text=written[path])
                c.result.contracts.append(c.new[path])
                if not _cycles(best):
                    ready.append((c, path))
            amend(ready, texts)
        for c in capsules:
            result.contracts += c.result.contracts
            result.errors += c.result.errors
    return result


def _drafted(inside: DataFrame, references: DataFrame, c: _Capsule) -> Contract:
    """A capsule's new contract; one that cycles is drafted again with merged directories taken apart."""
    merge = c.start == c.dir and c.language.file_globs
    first = _draft(inside, references, c.start, c.scoped, c.language, merge, ())
    groups = _cycles(first) if first.nodes and merge else []
    return _expanded(inside, references, c.start, c.scoped, c.language, first, groups) if groups else first


def dump_order(column: str) -> list[Column]:
    """Deepest first, then by name."""
    return [F.size(F.split(column, "/")).desc(), F.col(column).asc()]


def _upward(start: str, top: str) -> list[str]:
    out = [start]
    while out[-1] not in (top, "/"):
        out.append(posixpath.dirname(out[-1]))
    return out


def _draft(inside: DataFrame, references: DataFrame, at: str, scoped: list[str], language: Language, merge: bool, expanded: Iterable[str]) -> Contract:
    """What lies in directories with contracts of their own is one node for each of those."""
    spot = lambda c: F.col(c)
    scope = lambda c: F.coalesce(*[F.when(F.startswith(spot(c), F.lit(d + "/")) | (spot(c) == d), F.lit(d)) for d in sorted(scoped, key=len, reverse=True)], F.lit(at)) if scoped else F.lit(at)
    below = lambda c: F.startswith(spot(c), F.lit(at + "/"))
    rel = lambda c: F.expr(f"substring({c}, {len(at) + 2})")
    own = inside.filter(below("abs")).withColumn("scope", scope("abs"))
    rows = references.filter(below("abs") & below("target_abs")).withColumns({"scope": scope("abs"), "target_scope": scope("target_abs")})
    files = own.filter(F.col("scope") == at).select(rel("abs").alias("rel"))
    same = rows.filter((F.col("scope") == at) & (F.col("target_scope") == at)).select(rel("abs").alias("rel"), rel("target_abs").alias("target_rel"))
    nodes, edges = draft(files, same, language.file_globs, merge, expanded)
    out = Contract()
    for r in sorted(nodes.collect()):
        out.nodes[r.node_id] = r.glob
    for r in edges.collect():
        out.edges[r.src, r.dst] = 0
    merged = {g[: -len("/*.*")]: i for i, g in out.nodes.items() if g.endswith("/*.*")}

    def node(path: str, home: str) -> str:
        place = posixpath.relpath(home if home != at else path, at)
        if home == at and language.file_globs:
            return merged.get(posixpath.dirname(place)) or out.add(place, place)
        key = place if "." not in place else posixpath.dirname(place) or "."
        return out.add(key, key)

    crossing = rows.filter(F.col("scope") != F.col("target_scope")).select(F.when(F.col("scope") == at, F.col("abs")).otherwise(F.col("scope")).alias("a"), F.when(F.col("target_scope") == at, F.col("target_abs")).otherwise(F.col("target_scope")).alias("b"), "scope", "target_scope").distinct()
    for r in sorted(crossing.collect()):  # as many as the contract gets edges
        src, dst = node(r.a, r.scope), node(r.b, r.target_scope)
        if src != dst:
            out.edges[src, dst] = 0
    if not language.file_globs:
        out.displays = dict(out.nodes)
    return out


def _cycles(contract: Contract) -> list[list[str]]:
    import pandas as pd

    rows = [("", a, b, 0) for a, b in sorted(contract.edges) if a in contract.nodes and b in contract.nodes]
    rows += [("", n, None, 0) for n in contract.nodes if not any(a == n for a, _ in contract.edges)]
    frame = pd.DataFrame(rows, columns=["contract", "src", "dst", "line"]).astype(object).where(lambda x: x.notna(), None)
    return [text.split(" → ") for text, _ in validate._depth_first(frame)] if rows else []


def _expanded(inside: DataFrame, references: DataFrame, at: str, scoped: list[str], language: Language, first: Contract, groups: list[list[str]]) -> Contract:
    """Merged directories of the first cycle that has any are taken apart: the smallest, the largest, all; the first draft without a cycle counts, else the last."""
    sizes = {r.dir: r.files for r in merged_dirs(inside.select(F.lit("").alias("contract"), F.expr(f"substring(abs, {len(at) + 2})").alias("rel"))).collect() if first.nodes.get(r.dir, "").endswith("/*.*")}
    on = next((sorted({n for n in g if n in sizes}, key=lambda n: (sizes[n], n)) for g in groups if any(n in sizes for n in g)), [])
    best = first
    for plan in ([[on[0]], [on[-1]], on] if len(on) > 1 else [on] if on else []):
        best = _draft(inside, references, at, scoped, language, True, plan)
        if not _cycles(best):
            break
    return best


def _amend(found: Check, turn: list[tuple[_Capsule, str, Contract]], written: dict[str, str], colours_name: str) -> None:
    """Nodes and edges for what a check finds in the scopes of a turn's contracts; nothing is taken away, and a contract with errors is left as it is."""
    errors, rows, alone = defaultdict(list), defaultdict(set), defaultdict(set)
    for r in found.errors.join(_column(found.errors, "contract", [path for _, path, _ in turn]), "contract", "left_semi").collect():
        errors[r.contract].append(r)
    dirs = _column(found.errors, "capsule_dir", [c.dir for c, _, _ in turn])
    own = found.violations.filter(F.col("rule").isin("no-node", "import-no-node", "import-not-allowed")).join(dirs, "capsule_dir", "left_semi")
    wanted = found.relations.select(F.col("abs").alias("file"), "line", "col", "target_abs", "scope", "target_scope")
    for r in own.join(wanted, ["file", "line", "col"], "left").select("capsule_dir", "file", "rule", "target_abs", "scope", "target_scope").distinct().collect():  # as many as broken relations
        rows[r.capsule_dir].add(r)
    for r in found.tracked.filter("src is null").join(dirs, "capsule_dir", "left_semi").select("capsule_dir", "abs", "scope").collect():  # files without a node
        alone[r.capsule_dir].add((r.abs, r.scope))
    for c, path, now in turn:
        if errors[path]:
            kinds = {r.rule for r in errors[path]}
            c.result.errors.append((path, "circular dependency" if "circular-dependency" in kinds else "; ".join(dict.fromkeys(r.message.rsplit(" (", 1)[0] for r in sorted(errors[path], key=lambda r: r.message)))))
            continue
        before = Contract(nodes=dict(now.nodes), edges=dict(now.edges))
        _extend(now, posixpath.dirname(path), c.language, rows[c.dir], alone[c.dir])
        if added(before, now) == (0, 0):
            continue
        if not c.language.file_globs:
            now.displays = dict(now.nodes) | now.displays
        written[path] = contract_files.render(now, colours_name)
        entry = c.new.get(path) or Dumped(path, False, len(now.nodes), len(now.edges))
        (entry.added_nodes, entry.added_edges), entry.text = added(before, now), written[path]
        if entry not in c.result.contracts:
            c.result.contracts.append(entry)


def _extend(now: Contract, at: str, language: Language, rows: Iterable, alone: set[tuple[str, str]]) -> None:
    """Adds to the contract of the directory `at` what broken relations and files without a node ask for."""

    def node(place: str, home: str) -> str | None:
        if home != at:
            if not (home + "/").startswith(at + "/"):
                return None
            rel = posixpath.relpath(home, at)
            return now.add(rel, rel)
        rel = posixpath.relpath(place, at)
        owner = _owner(now.nodes, rel)
        key = rel if language.file_globs or "." not in rel else posixpath.dirname(rel) or "."
        return owner or now.add(key, key)

    for r in sorted(rows, key=str):
        if r.rule == "no-node":
            if (r.file, at) in alone:
                node(r.file, at)
        elif r.target_abs and r.scope is not None:
            src, dst = node(r.file, r.scope), node(r.target_abs, r.target_scope)
            if src and dst and src != dst:
                now.edges.setdefault((src, dst), 0)


def _owner(nodes: dict[str, str], rel: str) -> str | None:
    import re

    from ..functions.globs import regex_of

    key = rel if "." not in rel else posixpath.dirname(rel) or "."
    hit = []
    for i, g in nodes.items():
        is_file = contract_files.is_file_glob(g)
        path = rel if is_file else key
        if re.search(regex_of(g), path) and (path != "." or g in ("", ".", "**")):
            weight = 0 if g in ("", ".") else sum(1 if s == "**" else 3 if "*" in s else 10 for s in g.split("/"))
            hit.append((not is_file, -weight, i))
    return min(hit)[2] if hit else None

