"""Canonical columns, fixed vocabulary and names."""

from __future__ import annotations

#: The file that holds a directory's contract and the ignore files, by default; all entry points take others.
CONTRACT_FILE = "CONTRACT.md"
IGNORE_FILES = (".gitignore", ".archignore")
SOURCE = "archspark"

FILES = "abs string, is_dir boolean, content binary"
NODES = "contract string, node_id string, glob string, display string, line int, classes array<string>"
EDGES = "contract string, src string, dst string, line int"
IMPORT = "path: string, line: int, col: int, col_end: int"

# Rules of violations and of contract errors.
RELATION_RULES = ("import-not-allowed", "no-node", "import-no-node", "endophobic")
CONTRACT_RULES = ("file-glob-unsupported", "invalid-node-glob", "duplicate-node-glob", "node-overlap", "empty-node-glob", "undefined-edge-node", "circular-dependency", "contract-load-error")

# 16 colours of each palette.
PALETTES = {
    "vibrant": (
        "#0f4cde", "#c43d18", "#007e5f", "#8f2bd1", "#8b5e00", "#005bb5", "#9e1f63", "#2e6f00",
        "#6f3fd6", "#8a2d00", "#008299", "#b11f2f", "#5e6f00", "#6a2fb3", "#006e38", "#7d3b00",
    ),
    "muted": (
        "#5a6f8f", "#9a6b5c", "#62816e", "#7a6e93", "#8f7a5b", "#5f7895", "#94687c", "#6e7f5f",
        "#697aa2", "#8c6651", "#5f847f", "#94645f", "#77745b", "#6d6790", "#5d7b69", "#8a7058",
    ),
    "mono": (
        "#1f1f1f", "#2a2a2a", "#353535", "#404040", "#4b4b4b", "#565656", "#616161", "#6c6c6c",
        "#777777", "#828282", "#8d8d8d", "#989898", "#a3a3a3", "#aeaeae", "#b9b9b9", "#c4c4c4",
    ),
    "none": (),
}


def palette(name: str) -> tuple[str, ...]:
    """An empty or unknown name means vibrant."""
    return PALETTES.get(name, PALETTES["vibrant"])
