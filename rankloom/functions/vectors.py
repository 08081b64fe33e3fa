"""Dense vectors as arrays, sparse vectors as long rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def normalized(df: DataFrame, key: str | list[str], feature: str = "feature", value: str = "value") -> DataFrame:
    """Long rows divided by the length of their vector; zero vectors stay zero."""
    keys = [key] if isinstance(key, str) else list(key)
    length = df.groupBy(*keys).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("__length"))
    out = df.join(length, keys)
    return out.select(*keys, feature, F.when(F.col("__length") > 0, F.col(value) / F.col("__length")).otherwise(F.lit(0.0)).alias(value))


def every_pair(left: DataFrame, right: DataFrame, left_key: str, right_key: str, by: tuple[str, ...] = (), blocks: int = 16) -> DataFrame:
    """All rows of one side with all of the other, block by block: each row is dealt to
    one block of its own side and copied to all blocks of the other, and blocks meet by a join
    whose tasks hold one block of each."""
    p, q = (F.pmod(F.xxhash64(x), F.lit(blocks)).cast("int") for x in (left_key, right_key))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    return left.withColumn("__p", p).withColumn("__q", every).join(right.withColumn("__q", q).withColumn("__p", every), [*by, "__p", "__q"]).drop("__p", "__q")
