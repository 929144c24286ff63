"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat_format, decontamination, importance, mixing, near_dedup, ppm, prefix_trie, quality_rules, sharding, simhash_dedup, substring_dedup, token_counts, token_files

_MODULES = (quality_rules, ppm, sharding, near_dedup, chat_format, mixing, token_files, token_counts, substring_dedup, decontamination, prefix_trie, simhash_dedup, importance)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in vars(m).items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLE_SQL", {}).items()}
