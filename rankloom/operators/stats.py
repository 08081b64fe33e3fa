"""Counts, means, distributions and audits of ratings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import global_average_rank
from ..sources.files import stored

POSITIVE = 4.0


def positives(ratings: DataFrame, threshold: float = POSITIVE) -> DataFrame:
    return ratings.where(F.col("rating") >= threshold)


def item_stats(ratings: DataFrame, threshold: float = POSITIVE, key: str = "item_id") -> DataFrame:
    """Per item: ratings, positive ones, their share and the mean."""
    n, pos = F.count("*"), F.count_if(F.col("rating") >= threshold)
    return ratings.groupBy(key).agg(n.alias("rating_count"), pos.alias("positive_count"), F.avg("rating").alias("mean_rating"), (pos / n).alias("positive_ratio"))


def user_stats(ratings: DataFrame, threshold: float = POSITIVE) -> DataFrame:
    return item_stats(ratings, threshold, "user_id").drop("positive_ratio")


def density(ratings: DataFrame) -> DataFrame:
    """One row: users, items, ratings, density and sparsity; 0 where nothing is rated."""
    one = ratings.agg(F.countDistinct("user_id").alias("n_users"), F.countDistinct("item_id").alias("n_items"), F.count("*").alias("n_ratings"))
    d = F.coalesce(F.try_divide(F.col("n_ratings").cast("double"), F.col("n_users") * F.col("n_items")), F.lit(0.0))
    return one.select("*", d.alias("density"), (1 - d).alias("sparsity"))


def histogram(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("rating").agg(F.count("*").alias("n"))


def summary(ratings: DataFrame, column: str = "rating") -> DataFrame:
    c = F.col(column)
    return ratings.agg(F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.percentile(c, 0.5).alias("median"), F.stddev_samp(c).alias("std"))


def activity_quantiles(ratings: DataFrame, key: str, points: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)) -> DataFrame:
    """The distribution of how many ratings a user or an item has."""
    counts = ratings.groupBy(key).agg(F.count("*").alias("n"))
    return counts.agg(*(F.percentile("n", p).alias(f"p{round(p * 100)}") for p in points))


def below(ratings: DataFrame, key: str, limits: tuple[int, ...]) -> DataFrame:
    counts = ratings.groupBy(key).agg(F.count("*").alias("n"))
    return counts.agg(*(F.count_if(F.col("n") < x).alias(f"below_{x}") for x in limits))


def spans(ratings: DataFrame, unit: float = 86400.0) -> DataFrame:
    """Per user, the days from the first to the last rating."""
    return ratings.groupBy("user_id").agg(((F.max("ts") - F.min("ts")) / F.lit(unit)).alias("span_days"), F.count("*").alias("n"))


def duplicates(ratings: DataFrame) -> DataFrame:
    """One row: surplus rows of a (user, item), rows that share a (user, time)."""
    pairs = ratings.groupBy("user_id", "item_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_pairs"))
    times = ratings.groupBy("user_id", "ts").agg(F.count("*").alias("n")).where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tied_rows"))
    return pairs.join(F.broadcast(times), F.lit(True))  # one row on each side


def checks(ratings: DataFrame, items: DataFrame, tags: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """One row per check of the validation: name, and how many rows fail it."""
    out = ratings.agg(F.count_if((F.col("rating") < 0.5) | (F.col("rating") > 5)).alias("bad")).select(F.lit("rating_range").alias("check"), "bad")
    out = out.unionByName(ratings.agg(F.count_if(F.col("ts") <= 0).alias("bad")).select(F.lit("time_positive").alias("check"), "bad"))
    for name, table in (("ratings_item", ratings), ("tags_item", tags), ("links_item", links)):
        if table is not None:
            lost = table.join(items.select("item_id").distinct(), "item_id", "left_anti").agg(F.count("*").alias("bad"))
            out = out.unionByName(lost.select(F.lit(name).alias("check"), "bad"))
    surplus = ratings.groupBy("user_id", "item_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("bad"))
    return out.unionByName(surplus.select(F.lit("unique_pairs").alias("check"), "bad"))


def validation(ratings: DataFrame, items: DataFrame, tags: DataFrame | None = None, links: DataFrame | None = None, scores: DataFrame | None = None, score_tags: DataFrame | None = None, since: float = 780_000_000, until: float = 4_102_444_800, low: float = 0.5, high: float = 5.0) -> DataFrame:
    """One row for each check of a data set: value, percent (of the items, or links) and valid, null
    where there is nothing to judge. Each table is scanned once, while it is grouped by its
    keys; the grouped keys of all tables, with what was counted on the way, meet in one table of
    items, which tells what is missing where."""
    pairs = stored(ratings.groupBy("user_id", "item_id").agg(F.count("*").alias("n"), F.min("rating").alias("low"), F.max("rating").alias("high"), F.min("ts").alias("first"), F.max("ts").alias("last")), "pairs")
    one, none_ = F.lit(1).cast("long"), F.lit(0).cast("long")
    flag = lambda test: F.coalesce(test, F.lit(False)).cast("long")
    sources = {"ratings": (pairs, F.col("n"), none_, none_), "items": (items, one, flag(F.col("year").isNull()), flag(F.coalesce(F.size("genres"), F.lit(0)) <= 0))}
    if tags is not None:
        sources["tags"] = (stored(tags.groupBy("item_id", "tag").agg(F.count("*").alias("n")), "labels"), F.col("n"), none_, none_)
    if links is not None:
        sources["links"] = (links, one, flag(F.col("tmdb_id").isNull()), none_)
    if scores is not None:
        sources["scores"] = (stored(scores.groupBy("item_id", "tag_id").agg(F.count("*").alias("n")), "marks"), F.col("n"), none_, none_)
    keys = reduce(DataFrame.unionByName, (df.select("item_id", F.lit(name).alias("source"), *(x.alias(c) for c, x in zip("nab", more, strict=True))) for name, (df, *more) in sources.items()))
    of = lambda name, column="n": F.sum(F.when(F.col("source") == name, F.col(column)).otherwise(none_))
    keys = stored(keys.groupBy("item_id").agg(*(of(name).alias(name) for name in sources), of("items", "a").alias("no_year"), of("items", "b").alias("no_genres"), of("links", "a").alias("missing")), "keys")
    total = lambda x: F.coalesce(F.sum(x), none_)
    orphans = [F.count_if((F.col(name) > 0) & (F.col("items") == 0)).alias(f"orphan_{name}") for name in sources]
    present = [F.count_if(F.col(name) > 0).alias(f"with_{name}") for name in sources]
    found = keys.agg(total(F.greatest(F.col("items") - 1, F.lit(0))).alias("twice"), *(total(name).alias(name) for name in (*sources, "no_year", "no_genres", "missing")), *orphans, *present).first()
    r = pairs.agg(F.countDistinct("user_id").alias("users"), total(F.col("n") - 1).alias("surplus"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("first"), F.max("last").alias("last")).first()
    share = lambda x, of: round(100 * x / of, 2) if of else 0.0
    none, n_items = (lambda x: bool(x == 0)), found["items"]
    rows = [("users", r["users"], None, None), ("rated_items", found["with_ratings"], None, None), *((f"n_{name}", found[name], None, None) for name in sources)]
    if found["ratings"]:
        rows += [("rating_low", r["low"], None, r["low"] >= low), ("rating_high", r["high"], None, r["high"] <= high), ("time_first", r["first"], None, r["first"] >= since), ("time_last", r["last"], None, r["last"] <= until)]
    rows += [("duplicate_ratings", r["surplus"], None, none(r["surplus"])), ("duplicate_items", found["twice"], None, none(found["twice"])), ("orphan_rated_items", found["orphan_ratings"], None, none(found["orphan_ratings"]))]
    rows += [("year_failures", found["no_year"], share(found["no_year"], n_items), None), ("no_genres", found["no_genres"], share(found["no_genres"], n_items), None)]
    if links is not None:
        rows += [("orphan_links", found["orphan_links"], None, none(found["orphan_links"])), ("missing_external", found["missing"], share(found["missing"], found["links"]), None)]
    if tags is not None:
        rows += [("orphan_tags", found["orphan_tags"], None, none(found["orphan_tags"])), ("unique_tags", sources["tags"][0].agg(F.countDistinct("tag")).first()[0], None, None)]
    if scores is not None:
        rows += [("items_with_scores", found["with_scores"], share(found["with_scores"], n_items), None), ("orphan_score_items", found["orphan_scores"], None, none(found["orphan_scores"]))]
        if score_tags is not None:
            lost = sources["scores"][0].select("tag_id").distinct().join(score_tags.select("tag_id"), "tag_id", "left_anti").count()
            rows.append(("orphan_score_tags", lost, None, none(lost)))
    return ratings.sparkSession.createDataFrame([(name, float(value), percent, valid) for name, value, percent, valid in rows], "check string, value double, percent double, valid boolean")


def span_summary(ratings: DataFrame, unit: float = 86400.0) -> DataFrame:
    """One row: users, the share whose history lasts less than a day, and the median of days."""
    return spans(ratings, unit).agg(F.count("*").alias("n_users"), F.coalesce(F.avg((F.col("span_days") < 1).cast("double")), F.lit(0.0)).alias("under_a_day"), F.median("span_days").alias("median_days"))


def content_hash(df: DataFrame) -> DataFrame:
    """One row: the row count and an order-free hash of the contents, by sorted columns."""
    names = sorted(df.columns)
    row = F.conv(F.substring(F.sha2(F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names)), 256), 1, 12), 16, 10).cast("long")
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(row.cast("decimal(38,0)")) % 1_000_000_007, F.lit(0)).cast("long").alias("content_hash"))


def errors(rated: DataFrame, predicted: Column, actual: str = "rating") -> list[Column]:
    """Root mean squared and mean absolute error, as aggregates."""
    d = predicted - F.col(actual)
    return [F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae")]


def rating_errors(train: DataFrame, test: DataFrame, damping: float = 10.0) -> DataFrame:
    """Errors of the global mean, the item mean and the damped item mean."""
    mean = train.agg(F.avg("rating").alias("c"))
    own = train.groupBy("item_id").agg(F.sum("rating").alias("s"), F.count("*").alias("v"))
    rows = test.join(own, "item_id", "left").join(F.broadcast(mean), F.lit(True))  # the mean is one row
    damped = (F.col("s") + damping * F.col("c")) / (F.col("v") + damping)
    parts = [("global_mean", F.col("c")), ("item_mean", F.coalesce(F.col("s") / F.col("v"), "c")), ("damped_mean", F.coalesce(damped, "c"))]
    models = F.explode(F.array(*(F.struct(F.lit(n).alias("model"), p.alias("p")) for n, p in parts))).alias("m")
    return rows.select("rating", models).groupBy("m.model").agg(*errors(rows, F.col("m.p")))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """The correlation of average ranks."""
    ranked = global_average_rank(global_average_rank(df.select(x, y), x, "__x"), y, "__y")
    return ranked.agg(F.corr("__x", "__y").alias("rho"))


def jaccard(a: Column, b: Column) -> Column:
    return F.when(F.size(F.array_union(a, b)) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)))
