"""Item-item collaborative filtering on positives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import top_k
from .stats import POSITIVE, positives


SHARE_ITEMS = 256


def cooccurrence(ratings: DataFrame, threshold: float = POSITIVE) -> DataFrame:
    """(i, j, n_ij) for i < j: users who like both. The pairs of a user are counted before
    they shuffle. The items of a user of many are cut into shares of about SHARE_ITEMS, and
    each pair of shares is joined on its own, so that no task meets all pairs of one user."""
    liked = positives(ratings, threshold).select("user_id", "item_id").distinct()
    sizes = liked.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") > SHARE_ITEMS).select("user_id", F.ceil(F.col("n") / SHARE_ITEMS).cast("int").alias("shares"))
    own = liked.join(sizes, "user_id", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    own = own.withColumn("share", F.pmod(F.xxhash64("item_id"), F.col("shares")).cast("int"))
    others = F.sequence(F.lit(0), F.col("shares") - 1)
    left = own.select("user_id", F.col("item_id").alias("i"), F.col("share").alias("p"), F.explode(others).alias("q"))
    right = own.select("user_id", F.col("item_id").alias("j"), F.col("share").alias("q"), F.explode(others).alias("p"))
    return left.join(right, ["user_id", "p", "q"]).where("i < j").groupBy("i", "j").agg(F.count("*").alias("n_ij"))


def item_counts(ratings: DataFrame, threshold: float = POSITIVE) -> DataFrame:
    return positives(ratings, threshold).select("user_id", "item_id").distinct().groupBy("item_id").agg(F.count("*").alias("n_i"))


def counted_pairs(ratings: DataFrame, threshold: float = POSITIVE) -> DataFrame:
    """(i, j, n_ij, n_i, n_j) in both directions."""
    pairs, counts = cooccurrence(ratings, threshold), item_counts(ratings, threshold)
    both = pairs.select(F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("p"), "n_ij").select("p.i", "p.j", "n_ij")
    return both.join(counts.toDF("i", "n_i"), "i").join(counts.toDF("j", "n_j"), "j")


def weighed(counted: DataFrame, a: float = 0.5, shrink: float = 0.0) -> DataFrame:
    """(i, j, sim, n_ij): n_ij / (n_i ** a * n_j ** (1 - a)), shrunk by n_ij / (n_ij + shrink)."""
    sim = F.col("n_ij") / (F.pow("n_i", F.lit(a)) * F.pow("n_j", F.lit(1 - a))) * (F.col("n_ij") / (F.col("n_ij") + shrink))
    return counted.select("i", "j", sim.alias("sim"), "n_ij")


def similarities(ratings: DataFrame, a: float = 0.5, shrink: float = 0.0, threshold: float = POSITIVE) -> DataFrame:
    return weighed(counted_pairs(ratings, threshold), a, shrink)


def nearest(similar: DataFrame, k: int) -> DataFrame:
    """The k most similar items of each item, ties by item."""
    return top_k(similar, ["i"], [F.desc(F.round("sim", 9)), F.col("j").asc()], k)


def neighbors(ratings: DataFrame, a: float = 0.5, shrink: float = 0.0, k: int = 200, threshold: float = POSITIVE) -> DataFrame:
    return nearest(similarities(ratings, a, shrink, threshold), k)


def remapped(found: DataFrame, serving: DataFrame) -> DataFrame:
    """Neighbours among the items that are served, ranked anew."""
    ids = serving.select("item_id")
    own = found.drop("rank").join(ids.toDF("i"), "i", "left_semi").join(ids.toDF("j"), "j", "left_semi")
    return top_k(own, ["i"], [F.desc(F.round("sim", 9)), F.col("j").asc()], 1 << 30)


def warm_scores(ratings: DataFrame, found: DataFrame, threshold: float = POSITIVE) -> DataFrame:
    """(user_id, item_id, score): the sum of similarities from the user's positives."""
    liked = positives(ratings, threshold).select("user_id", F.col("item_id").alias("i")).distinct()
    return liked.join(found, "i").groupBy("user_id", F.col("j").alias("item_id")).agg(F.sum("sim").alias("score"))


def cold_scores(picks: DataFrame, found: DataFrame, count_unknown: bool = True) -> DataFrame:
    """The mean similarity from a user's picks; picks without neighbours count too unless
    count_unknown is off."""
    known = picks if count_unknown else picks.join(found.select(F.col("i").alias("item_id")).distinct(), "item_id", "left_semi")
    sizes = known.groupBy("user_id").agg(F.count("*").alias("k"))
    summed = picks.join(found, picks["item_id"] == found["i"]).groupBy("user_id", F.col("j").alias("item_id")).agg(F.sum("sim").alias("s"))
    return summed.join(sizes, "user_id").select("user_id", "item_id", (F.col("s") / F.col("k")).alias("score"))


def best_pick(picks: DataFrame, found: DataFrame) -> DataFrame:
    """For each candidate, the pick that says most for it, ties by the smaller pick."""
    rows = picks.join(found, picks["item_id"] == found["i"]).where("sim > 0")
    best = F.max(F.struct(F.round("sim", 9).alias("sim"), (-F.col("i")).alias("neg"), "n_ij"))
    return rows.groupBy("user_id", F.col("j").alias("item_id")).agg(best.alias("b")).select("user_id", "item_id", (-F.col("b.neg")).alias("pick"), F.col("b.sim").alias("sim"), F.col("b.n_ij").alias("n_ij"))
