"""The languages: which files count, what they import, how a manifest names a capsule."""

from .registry import LANGUAGES, Language, base_ignore_lines, manifest_table, resolve_languages, scannable

__all__ = ["LANGUAGES", "Language", "base_ignore_lines", "manifest_table", "resolve_languages", "scannable"]
