"""Ranking metrics, bootstrap intervals, comparisons and the cold-start protocol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranking import KNUTH, numbered, tie_hash, top_k
from .stats import POSITIVE

METRICS = ("precision", "recall", "ndcg", "hit_rate", "mrr")
Z = (0.025, 0.975)


def relevant(train: DataFrame, held: DataFrame, threshold: float = POSITIVE) -> DataFrame:
    """(user_id, item_id): held-out positives on items that train has."""
    return held.where(F.col("rating") >= threshold).select("user_id", "item_id").distinct().join(train.select("item_id").distinct(), "item_id", "left_semi")


def recommended(scores: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """The first k unseen items of each user, ties by the item hash. Fewer candidates give
    shorter lists."""
    unseen = scores.join(seen.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    return top_k(unseen, ["user_id"], [F.desc(F.round("score", 9)), tie_hash(F.col("item_id")).asc(), F.col("item_id").asc()], k).select("user_id", "item_id", "rank")


def user_metrics(lists: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Per user with something relevant: the five metrics at k; k is fixed even for shorter
    lists."""
    sizes = wanted.groupBy("user_id").agg(F.count("*").alias("n_rel"))
    hits = lists.join(wanted, ["user_id", "item_id"], "left_semi")
    own = hits.groupBy("user_id").agg(F.count("*").alias("hits"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"), F.min("rank").alias("first"))
    rows = sizes.join(own, "user_id", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    n = F.coalesce("hits", F.lit(0))
    return rows.select("user_id", (n / F.lit(k)).alias("precision"), (n / F.col("n_rel")).alias("recall"), F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"), (n > 0).cast("double").alias("hit_rate"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"))


def means(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.count("*").alias("n_users"), *(F.avg(m).alias(m) for m in METRICS))


def coverage(lists: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: the share of candidates that anybody is recommended."""
    n = candidates.select("item_id").distinct().agg(F.count("*").alias("n"))
    return lists.agg(F.countDistinct("item_id").alias("r")).join(F.broadcast(n), F.lit(True)).select((F.col("r") / F.col("n")).alias("coverage"))  # one row each


def mean_popularity(lists: DataFrame, train: DataFrame) -> DataFrame:
    counts = train.groupBy("item_id").agg(F.count("*").alias("n"))
    return lists.join(counts, "item_id", "left").agg(F.avg(F.coalesce("n", F.lit(0))).alias("mean_popularity"))


def bootstrap(metrics: DataFrame, metric: str, resamples: int = 1000, seed: int = 42, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each value of `by`: the mean of a metric and the 2.5 and 97.5 percentiles of
    its mean over resamples of users. How often a user is drawn into a resample is a fixed
    function of seed, resample and user (a Poisson bootstrap), so that no resample has to see
    all users at one place and the weights sum up before they shuffle."""
    rows = metrics.select(*by, "user_id", F.col(metric).alias("v"), F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("b"))
    rows = rows.select(*by, "v", "b", draws(F.col("user_id"), F.col("b"), seed).alias("w"))
    per = rows.groupBy(*by, "b").agg((F.sum(F.col("w") * F.col("v")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    interval = per.groupBy(*by).agg(F.percentile("m", Z[0]).alias("low"), F.percentile("m", Z[1]).alias("high"))
    one = metrics.groupBy(*by).agg(F.count("*").alias("n_users"), F.coalesce(F.avg(metric), F.lit(0.0)).alias("mean"))
    both = one.join(interval, list(by)) if by else one.join(F.broadcast(interval), F.lit(True))  # one row each
    return both.select(*by, "n_users", "mean", F.coalesce("low", "mean").alias("low"), F.coalesce("high", "mean").alias("high"))


def draws(user: Column, resample: Column, seed: int) -> Column:
    """A Poisson number of mean 1 from a hash."""
    u = ((user.cast("long") * F.lit(KNUTH) + resample * F.lit(40503) + F.lit(seed)) % F.lit(4294967291) * F.lit(48271) % F.lit(2147483647)) / F.lit(2147483647.0)
    # fixed values: the cumulative Poisson probabilities of mean 1
    table = [0.367879441171, 0.735758882343, 0.919698602929, 0.981011843124, 0.996340153173, 0.999405815182]
    return sum((u > p).cast("int") for p in table)


def compared(a: DataFrame, b: DataFrame, metric: str, tolerance: float = 1e-9, resamples: int = 1000, seed: int = 42, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each value of `by`: the mean difference of two models over the same users
    with its bootstrap interval, the lift, how many users win, tie or lose, and whether the
    interval is on one side of zero."""
    rows = a.select(*by, "user_id", F.col(metric).alias("x")).join(b.select(*by, "user_id", F.col(metric).alias("y")), [*by, "user_id"]).withColumn("d", F.col("x") - F.col("y"))
    d, zero = F.col("d"), F.lit(0.0)
    one = rows.groupBy(*by).agg(F.coalesce(F.avg("x"), zero).alias("a"), F.coalesce(F.avg("y"), zero).alias("b"), F.count_if(d >= tolerance).alias("wins"), F.count_if(F.abs(d) < tolerance).alias("ties"), F.count_if(d <= -tolerance).alias("losses"))
    interval = bootstrap(rows, "d", resamples, seed, by).withColumnRenamed("mean", "difference")
    both = one.join(interval, list(by)) if by else one.join(F.broadcast(interval), F.lit(True))  # one row each
    lift = F.when(F.abs("b") > 1e-12, F.col("difference") / F.nullif(F.col("b"), zero)).otherwise(0.0)
    return both.select("*", lift.alias("lift"), ((F.col("low") > 0) | (F.col("high") < 0)).alias("distinguishable"))


def first_unseen(users: DataFrame, seen: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """The first k unseen items of each user where a score does not depend on the user:
    scores is (config, item_id, score). A user's list lies within the first k + n items of
    the order, n being what the user has seen, so only these are joined."""
    order = [F.col("config").asc(), F.desc(F.round("score", 9)), tie_hash(F.col("item_id")).asc(), F.col("item_id").asc()]
    placed = numbered(scores, order, "i")
    first = placed.groupBy("config").agg(F.min("i").alias("first"), F.count("*").alias("n_items"))
    placed = placed.join(F.broadcast(first), "config").select("config", "item_id", "n_items", (F.col("i") - F.col("first") + 1).alias("pos"))  # one row a configuration
    counts = seen.groupBy("user_id").agg(F.countDistinct("item_id").alias("n"))
    asked = users.select("user_id").distinct().join(counts, "user_id", "left").select("user_id", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("n", F.lit(0)).cast("long") + k)).alias("pos"))
    unseen = asked.join(placed, "pos").join(seen.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_anti")
    return top_k(unseen, ["config", "user_id"], [F.col("pos").asc()], k).select("config", "user_id", "item_id", "rank")


def strata(metrics: DataFrame, spans: DataFrame) -> DataFrame:
    """Mean metrics by how long a user's history is."""
    bucket = F.when(F.col("span_days") < 1, "<1").when(F.col("span_days") < 30, "1-30").otherwise(">=30")
    return metrics.join(spans, "user_id").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n_users"), *(F.avg(m).alias(m) for m in METRICS), F.min("span_days").alias("min_span"), F.max("span_days").alias("max_span"))


def activity(metrics: DataFrame, counts: DataFrame) -> DataFrame:
    """Mean metrics by quartile of activity, cut at the exact percentiles."""
    cuts = counts.agg(*(F.percentile("n", p).alias(c) for p, c in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))))
    rows = metrics.join(counts, "user_id").join(F.broadcast(cuts), F.lit(True))  # the cuts are one row
    quartile = F.when(F.col("n") <= F.col("q1"), 1).when(F.col("n") <= F.col("q2"), 2).when(F.col("n") <= F.col("q3"), 3).otherwise(4)
    return rows.groupBy(quartile.alias("quartile")).agg(F.count("*").alias("n_users"), *(F.avg(m).alias(m) for m in METRICS), F.min("n").alias("min_n"), F.max("n").alias("max_n"))


def most_rated(train: DataFrame, n: int = 200) -> DataFrame:
    """The head of the catalogue: count desc, item asc."""
    return train.groupBy("item_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item_id").limit(n)


def onboarding(ratings: DataFrame, k: int, window: int = 20, threshold: float = POSITIVE) -> DataFrame:
    """(user_id, item_id, role): the first k positives are picks, the next `window` are
    relevant; users with fewer are left out. window 0 asks for five more and takes all."""
    own = ratings.where(F.col("rating") >= threshold)
    by = Window.partitionBy("user_id")
    own = own.withColumn("seq", F.row_number().over(by.orderBy("ts", tie_hash(F.col("item_id")), "item_id"))).withColumn("n", F.count("*").over(by))
    kept = own.where((F.col("n") >= k + (window or 5)) & ((F.col("seq") <= k + window) if window else F.lit(True)))
    return kept.select("user_id", "item_id", F.when(F.col("seq") <= k, "pick").otherwise("relevant").alias("role"))


def long_tail(rows: DataFrame, head: DataFrame) -> DataFrame:
    """Without the head of the catalogue; users with nothing left are gone by that."""
    return rows.join(head.select("item_id"), "item_id", "left_anti")
