"""Schemas of the source tables, and the configuration of a data set."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# the CSV files, in their column order
RATINGS_CSV = _struct(userId=T.IntegerType(), movieId=T.IntegerType(), rating=T.FloatType(), timestamp=T.LongType())
ITEMS_CSV = _struct(movieId=T.IntegerType(), title=T.StringType(), genres=T.StringType())
TAGS_CSV = _struct(userId=T.IntegerType(), movieId=T.IntegerType(), tag=T.StringType(), timestamp=T.LongType())
LINKS_CSV = _struct(movieId=T.IntegerType(), imdbId=T.StringType(), tmdbId=T.DoubleType())
SCORES_CSV = _struct(movieId=T.IntegerType(), tagId=T.IntegerType(), relevance=T.FloatType())
SCORE_TAGS_CSV = _struct(tagId=T.IntegerType(), tag=T.StringType())


@dataclass(frozen=True)
class DatasetConfig:
    """Files and thresholds of one data set."""

    name: str
    path: str
    has_tags: bool = True
    has_links: bool = True
    has_genome: bool = True
    min_user_ratings: int = 20
    min_item_ratings: int = 20
    test_share: float = 0.1
    cold_user_share: float = 0.05
    positive_threshold: float = 4.0
    seed: int = 42


@dataclass(frozen=True)
class Dataset:
    """Two required and four optional tables."""

    ratings: DataFrame
    items: DataFrame
    tags: DataFrame | None = None
    links: DataFrame | None = None
    scores: DataFrame | None = None
    score_tags: DataFrame | None = None
    notes: dict = field(default_factory=dict)


def config(configs: dict[str, DatasetConfig], name: str) -> DatasetConfig:
    if name not in configs:
        raise ValueError(f"unknown data set {name}; known: {', '.join(sorted(configs))}")
    return configs[name]
