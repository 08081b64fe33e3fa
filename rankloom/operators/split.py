"""Temporal splits per user, their audits, and the cold-start partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranking import numbered, tie_hash, with_pair_hash


def sequenced(ratings: DataFrame) -> DataFrame:
    """Adds seq (from 0, by time and tie hash), n (ratings of the user) and tie."""
    own = with_pair_hash(ratings, "user_id", "item_id")
    by = Window.partitionBy("user_id")
    return own.withColumn("seq", F.row_number().over(by.orderBy("ts", "tie", "item_id")).cast("long") - 1).withColumn("n", F.count("*").over(by))


def temporal_split(ratings: DataFrame, share: float = 0.1) -> DataFrame:
    """Adds split: the last share of a user's ratings is test, the share before it is
    validation; both have one rating at least."""
    held = F.greatest(F.lit(1.0), F.rint(F.lit(share) * F.col("n"))).cast("long")
    part = F.when(F.col("seq") >= F.col("n") - held, "test").when(F.col("seq") >= F.col("n") - 2 * held, "val").otherwise("train")
    return sequenced(ratings).withColumn("split", part)


def cold_users(ratings: DataFrame, one_in: int = 20) -> DataFrame:
    """A fixed share of users, chosen by hash, whose ratings no model sees."""
    return ratings.select("user_id").distinct().where(tie_hash(F.col("user_id")) % one_in == 0)


def cold_partition(users: DataFrame) -> DataFrame:
    """Adds part: the first half by hash is dev, the rest final; dev has floor(n / 2)."""
    half = users.agg(F.floor(F.count("*") / 2).alias("half"))
    ranked = numbered(users.withColumn("tie", tie_hash(F.col("user_id"))), [F.col("tie").asc(), F.col("user_id").asc()], "r")
    return ranked.join(F.broadcast(half), F.lit(True)).select("user_id", F.when(F.col("r") < F.col("half"), "dev").otherwise("final").alias("part"))


def boundary(split: DataFrame, before: str, after: str) -> DataFrame:
    """Per user: the last rating before a cut and the first one behind it."""
    key = F.struct("ts", "tie", "item_id")
    last = split.where(F.col("split") == before).groupBy("user_id").agg(F.max(key).alias("l"))
    first = split.where(F.col("split") == after).groupBy("user_id").agg(F.min(key).alias("f"))
    return last.join(first, "user_id").select("user_id", F.col("l.ts").alias("last_ts"), F.col("l.item_id").alias("last_item"), F.col("f.ts").alias("first_ts"), F.col("f.item_id").alias("first_item"))


def tie_audit(split: DataFrame, before: str = "train", after: str = "val") -> DataFrame:
    """How often a cut falls within one moment, and if item ids differ on its sides."""
    cut = boundary(split, before, after)
    tied = cut.where("last_ts = first_ts").select("user_id", F.col("last_ts").alias("ts"))
    rows = split.where(F.col("split").isin(before, after)).join(tied, ["user_id", "ts"])
    by = Window.partitionBy("user_id", "ts")
    n, r = F.count("*").over(by), F.row_number().over(by.orderBy("item_id"))
    ranked = rows.withColumn("rank", F.when(n == 1, F.lit(0.5)).otherwise((r - 1) / F.nullif(n - 1, F.lit(0))))
    sides = ranked.agg(*(F.avg(F.when(F.col("split") == s, F.col(c))).alias(f"{c}_{s}") for s in (before, after) for c in ("item_id", "rank")))
    shares = cut.agg(F.count("*").alias("users"), F.count_if(F.col("last_ts") == F.col("first_ts")).alias("tied_users"))
    return shares.join(F.broadcast(sides), F.lit(True))  # one row on each side


def unreachable(split: DataFrame, threshold: float = 4.0) -> DataFrame:
    """Per held-out split: positives, and those on items that train never saw."""
    seen = split.where("split = 'train'").select("item_id").distinct().withColumn("seen", F.lit(True))
    rows = split.where(F.col("split").isin("val", "test") & (F.col("rating") >= threshold)).join(seen, "item_id", "left")
    return rows.groupBy("split").agg(F.count("*").alias("positives"), F.count_if(F.col("seen").isNull()).alias("unreachable"), (F.count_if(F.col("seen").isNull()) * 100.0 / F.count("*")).alias("percent"))
