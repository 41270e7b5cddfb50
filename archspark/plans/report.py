"""Results as text and JSON. What is rendered is what a person or an editor reads, so it is collected."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .check import Check

RED, GREEN, YELLOW, PLAIN = "\x1b[31m", "\x1b[32m", "\x1b[33m", "\x1b[0m"


def count(n: int, one: str, many: str) -> str:
    return f"{n} {one if n == 1 else many}"


def stats(row) -> str:
    """Only the parts that say something."""
    parts = []
    if row.files_scanned or row.files_encountered:
        parts.append(f"{count(row.files_scanned, 'file', 'files')} scanned" if row.files_scanned == row.files_encountered else f"{row.files_scanned} of {count(row.files_encountered, 'file', 'files')} scanned")
    if row.relations:
        parts.append(f"{row.relations} internal {'import' if row.relations == 1 else 'imports'} checked")
    if row.nodes or row.edges:
        parts.append(f"graph: {count(row.nodes, 'node', 'nodes')}, {count(row.edges, 'edge', 'edges')}")
    return f" ({', '.join(parts)})" if parts else ""


def collect(result: Check, warnings: list[str] | None = None) -> dict:
    """The whole result: capsules by label, their violations and errors by message."""
    capsules = result.capsules.orderBy("label").collect()
    by: dict[str, dict[str, list]] = {}
    for kind, frame in (("violations", result.violations.select("capsule_dir", "rule", "message", "severity", "source", "file", "line", "col", "col_end")), ("errors", result.errors.select("capsule_dir", "rule", "message", F.lit("error").alias("severity"), F.lit("archspark").alias("source"), F.col("contract").alias("file"), "line", F.lit(None).cast("int").alias("col"), F.lit(None).cast("int").alias("col_end")))):
        for r in frame.orderBy("capsule_dir", "message").collect():
            by.setdefault(r.capsule_dir, {}).setdefault(kind, []).append(r)
    out = {"capsules": [], "violations": [], "warnings": list(warnings or ()), "errors": []}
    for c in capsules:
        own = by.get(c.capsule_dir, {})
        out["capsules"].append((c, own.get("violations", []), own.get("errors", [])))
        if c.source_error:
            out["errors"].append(f"{c.label}: {c.source_error}")
        out["violations"] += [f"{c.label}: {v.message}" for v in own.get("violations", [])]
        out["errors"] += [f"{c.label}: {e.message}" for e in own.get("errors", [])]
    return out


def text(found: dict) -> str:
    """Errors of no capsule first, then warnings, then each capsule with its details."""
    owned = {f"{c.label}: {e.message}" for c, _, errors in found["capsules"] for e in errors}
    rows = [f"{RED}✗ {e}{PLAIN}" for e in found["errors"] if e not in owned] + [f"{YELLOW}⚠ {w}{PLAIN}" for w in found["warnings"]]
    for c, violations, errors in found["capsules"]:
        bad = violations or errors
        rows.append(f"{RED if bad else GREEN}{'✗' if bad else '✓'} {c.label}{stats(c)}{PLAIN}")
        rows += [f"    {kind} [{x.rule}]: {x.message}" for kind, xs in (("violation", violations), ("error", errors)) for x in xs]
    return "".join(f"{r}\n" for r in rows)


def _item(x) -> dict:
    out = {"rule": x.rule, "severity": x.severity, "source": x.source, "message": x.message, "file": x.file, "line": x.line or 0, "column": x.col or 0}
    return out | ({"columnEnd": x.col_end} if x.col_end else {})


def full_json(found: dict) -> str:
    names = {"Label": "label", "FilesEncountered": "files_encountered", "FilesScanned": "files_scanned", "Nodes": "nodes", "Edges": "edges", "Relations": "relations"}
    capsules = [{k: c[v] for k, v in names.items()} | {"Violations": [_item(x) for x in vs], "Errors": [_item(x) for x in es]} for c, vs, es in found["capsules"]]
    return json.dumps({"Capsules": capsules, "Violations": found["violations"], "Warnings": found["warnings"], "Errors": found["errors"]}, indent=2, ensure_ascii=False)


def editor_json(found: dict) -> str:
    """All violations and errors of all capsules in one array."""
    return json.dumps([_item(x) for _, vs, es in found["capsules"] for x in (*vs, *es)], ensure_ascii=False, separators=(",", ":"))
