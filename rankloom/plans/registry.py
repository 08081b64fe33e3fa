"""Where queries and their SQL are kept."""

from __future__ import annotations

import functools

from ..sources.files import sized_in_memory

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers (spark, sf_dir) -> DataFrame under a name, with the SQL of the same rows. What a
    registered query stores is broadcast by its size in memory, not by that of a file."""

    def keep(f):
        @functools.wraps(f)
        def run(spark, sf_dir):
            with sized_in_memory(spark):
                return f(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep
