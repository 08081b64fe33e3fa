"""Popularity scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import POSITIVE, item_stats

VARIANTS = ("most_rated", "most_liked", "damped_mean")


def popularity(ratings: DataFrame, candidates: DataFrame | None = None, variant: str = "most_liked", damping: float = 10.0, threshold: float = POSITIVE) -> DataFrame:
    """(item_id, score). Candidates without ratings have 0 ratings and the global mean."""
    if variant not in VARIANTS:
        raise ValueError(f"variant is one of {', '.join(VARIANTS)}")
    stats = item_stats(ratings, threshold)
    if candidates is not None:
        stats = candidates.select("item_id").distinct().join(stats, "item_id", "left").fillna(0, ["rating_count", "positive_count"])
    if variant == "most_rated":
        return stats.select("item_id", F.col("rating_count").cast("double").alias("score"))
    if variant == "most_liked":
        return stats.select("item_id", F.col("positive_count").cast("double").alias("score"))
    mean = ratings.agg(F.avg("rating").alias("c"))
    rows, v = stats.join(F.broadcast(mean), F.lit(True)), F.col("rating_count")  # the mean is one row
    score = F.when(v + damping > 0, (v * F.coalesce("mean_rating", "c") + damping * F.col("c")) / F.nullif(v + damping, F.lit(0.0))).otherwise(0.0)
    return rows.select("item_id", score.alias("score"))
