"""The registered queries and their SQL."""

from . import browsing, measures, models, preparing
from .registry import ORACLES, QUERIES

__all__ = ["browsing", "measures", "models", "oracle_sql", "preparing", "queries"]


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
