"""Commands: check, dump, restyle, manual.

check ends with 1 on violations or errors, restyle on errors, dump only where nothing could
be looked at. A value follows its flag as a word of its own.
"""

from __future__ import annotations

import argparse
import os
import sys

from .languages import resolve_languages
from .schema import CONTRACT_FILE, PALETTES

MANUAL = """A contract is a fenced flowchart in a document: nodes claim globs of files, arrows
allow imports between them. `check` reports imports that no arrow allows, `dump` writes
contracts from what is there and adds what is missing, `restyle` renews their colours.
"""


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="archspark", allow_abbrev=False)
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("check", "dump", "restyle"):
        c = commands.add_parser(name, allow_abbrev=False)
        c.add_argument("root", nargs="?", default=".")
        c.add_argument("--contract", default=CONTRACT_FILE, help="name of contract files")
        if name != "restyle":
            c.add_argument("--lang", default="", help="languages, separated by commas")
        if name != "check":
            c.add_argument("--palette", default="vibrant", choices=list(PALETTES))
        if name == "check":
            c.add_argument("--format", default="text", choices=["text", "json", "editor"])
            c.add_argument("--overlay-stdin", action="store_true", help="unsaved files as JSON on standard input")
        if name == "restyle":
            c.add_argument("--stdin", action="store_true", help="one document from standard input to standard output")
    commands.add_parser("manual")
    return top


def main(argv: list[str] | None = None, spark=None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "manual":
        print(MANUAL, end="")
        return 0
    if args.command == "restyle" and args.stdin:
        from .plans.dump import restyle

        source = sys.stdin.read()
        _, new, error = restyle([("-", source)], args.palette)[0]
        if error:
            print(error, file=sys.stderr)
            return 1
        print(source if new is None else new, end="")
        return 0
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("archspark").getOrCreate()
    from .plans import dump as inference
    from .plans import report
    from .plans.check import check
    from .sources import discover
    from .sources import files as trees

    root = os.path.abspath(args.root)
    files = _above(spark, root, trees)
    if args.command == "check":
        if args.overlay_stdin:
            payload = spark.createDataFrame([(sys.stdin.read(),)], "json string")
            files = trees.overlay(files, trees.overlay_rows(payload))
        found = report.collect(check(files, root, resolve_languages(args.lang), args.contract))
        print({"text": report.text, "json": report.full_json, "editor": report.editor_json}[args.format](found), end="" if args.format == "text" else "\n")
        return int(bool(found["violations"] or found["errors"]))
    if args.command == "dump":
        try:
            result = inference.dump(files, root, resolve_languages(args.lang), args.palette, args.contract)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 1
        for c in result.contracts:
            _write(c.path, c.text)
            print(f"{'new' if c.is_new else 'amended'} {c.path}: {c.nodes} nodes, {c.edges} edges, added {c.added_nodes} and {c.added_edges}")
        for label, message in result.errors:
            print(f"dump: {label}: {message}", file=sys.stderr)
        return 0
    rows = discover.contract_dirs(files, args.contract).select("contract", "content").collect()
    failed = 0
    for path, new, error in inference.restyle([(r.contract, (r.content or b"").decode("utf-8", "replace")) for r in rows], args.palette):
        if error:
            failed = 1
            print(f"{path}: {error}", file=sys.stderr)
        elif new is not None:
            _write(path, new)
            print(path)
    return failed


def _above(spark, root: str, trees):
    """The tree below root, and from the directories above it what names capsules, contracts and ignore rules.

    Files of environment variables (.env and .env.*) there are none of these and aren't read.
    """
    files = trees.read_tree(spark, root)
    extra = {}
    up = os.path.dirname(root)
    while True:
        for e in os.scandir(up):
            if e.is_file() and not e.name.startswith(".env") or e.name == ".git":
                extra[e.path] = b"" if e.name == ".git" else trees._content(e.path) or b""
        if up == os.path.dirname(up):
            break
        up = os.path.dirname(up)
    if os.path.exists(f"{root}/.git"):
        extra[f"{root}/.git"] = b""
    rows = [(p, False, c) for p, c in sorted(extra.items())]
    return files.unionByName(spark.createDataFrame(rows, trees.FILES)) if rows else files


def _write(path: str, content: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(content)


if __name__ == "__main__":
    sys.exit(main())
