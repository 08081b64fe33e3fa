"""Operators of a training-data pipeline, and their queries.

Nothing else in the library imports this subpackage."""

from importlib import import_module

MODULES = ["token_counts", "substring_dedup", "exact_dedup", "chat_format", "decontaminate", "ngram_join", "language_id", "license_scan", "sharding", "packing", "turn_repair", "simhash", "fill_middle"]


def queries() -> dict:
    out = {}
    for name in MODULES:
        out |= import_module(f"{__name__}.{name}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for name in MODULES:
        out |= import_module(f"{__name__}.{name}").ORACLES
    return out
