"""Trees drawn with lines, as fixtures: a directory ends with a slash or has entries."""

from __future__ import annotations

import re



def parse(drawing: str, root: str) -> list[str]:
    """The absolute paths of the files."""
    rows = []
    for line in drawing.strip("\n").split("\n"):
        mark = re.search(r"(├|└)── ", line)
        if mark:
            rows.append((mark.start() // 4, line[mark.end() :].strip()))
    out, at = [], []
    for i, (depth, name) in enumerate(rows):
        at = [*at[:depth], name.rstrip("/")]
        if not name.endswith("/") and not (i + 1 < len(rows) and rows[i + 1][0] > depth):
            out.append("/".join([root, *at]))
    return out
