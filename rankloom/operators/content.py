"""Content features, profiles and scores, all as long rows (key, feature, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import exact_percentile, numbered, top_k
from ..functions.text import tokens
from ..functions.tiles import dense_products, sparse_products
from ..functions.vectors import normalized
from ..sources.files import bucketed, stored
from .stats import POSITIVE

PROFILES = ("pos_mean", "rating_weighted", "centered", "pos_rating_weighted")


def year_features(items: DataFrame) -> DataFrame:
    """The year scaled to 0..1 (0 where it is missing) and a flag for missing ones."""
    ends = items.agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    rows = items.join(F.broadcast(ends), F.lit(True))  # the ends are one row
    span = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.col("hi") - F.col("lo"))
    return rows.select("item_id", F.coalesce((F.col("year") - F.col("lo")) / span, F.lit(0.0)).alias("year_norm"), F.col("year").isNull().cast("int").alias("year_missing"))


def genre_features(items: DataFrame) -> DataFrame:
    """A one for each genre of an item."""
    named = F.transform(F.array_distinct("genres"), lambda g: F.concat(F.lit("genre:"), g))
    return items.select("item_id", F.explode(named).alias("feature"), F.lit(1.0).alias("value"))


def tier_1(items: DataFrame) -> DataFrame:
    years = year_features(items).select("item_id", F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in ("year_norm", "year_missing")))).alias("f"))
    return genre_features(items).unionByName(years.select("item_id", "f.feature", "f.value").where("value <> 0"))


def genre_idf(items: DataFrame) -> DataFrame:
    """ln(n / (df + 1)) + 1 for each genre."""
    n = items.agg(F.count("*").alias("n"))
    df = genre_features(items).groupBy("feature").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n), F.lit(True)).select("feature", (F.ln(F.col("n") / (F.col("df") + 1)) + 1).alias("idf"))  # n is one row


def tf_idf(docs: DataFrame, items: DataFrame, min_df: int = 2, max_df: float = 0.7) -> DataFrame:
    """Sublinear term counts times smooth idf, normalised. Items without a text count as
    documents too."""
    terms = docs.select("item_id", F.explode(tokens(F.col("text"))).alias("feature")).groupBy("item_id", "feature").agg(F.count("*").alias("tf"))
    n = items.agg(F.count("*").alias("n"))
    df = terms.groupBy("feature").agg(F.count("*").alias("df")).join(F.broadcast(n), F.lit(True))  # n is one row
    kept = df.where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n"))).select("feature", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    rows = terms.join(kept, "feature").select("item_id", "feature", ((1 + F.ln("tf")) * F.col("idf")).alias("value"))
    return normalized(rows, "item_id")


def blocks(*weighted: tuple[DataFrame, float, str]) -> DataFrame:
    """Normalised blocks times their weights, joined and normalised again. Each block is
    (rows, weight, prefix of its features)."""
    out = None
    for rows, weight, prefix in weighted:
        part = normalized(rows, "item_id").select("item_id", F.concat(F.lit(prefix), "feature").alias("feature"), (F.col("value") * weight).alias("value"))
        out = part if out is None else out.unionByName(part)
    return normalized(out, "item_id")


def profiles(ratings: DataFrame, vectors: DataFrame, variant: str = "pos_mean", threshold: float = POSITIVE, by: tuple[str, ...] = ()) -> DataFrame:
    """(user_id, feature, value): weighted sums of item vectors, normalised, for each value of
    the columns `by` of the vectors."""
    if variant not in PROFILES:
        raise ValueError(f"variant is one of {', '.join(PROFILES)}")
    rows = ratings.where(F.col("rating") >= threshold) if variant.startswith("pos") else ratings
    weight = F.lit(1.0) if variant == "pos_mean" else F.col("rating").cast("double")
    if variant == "centered":
        means = rows.groupBy("user_id").agg(F.avg("rating").alias("__mean"))
        rows, weight = rows.join(means, "user_id"), F.col("rating") - F.col("__mean")
    weighted = rows.select("user_id", "item_id", weight.alias("w")).join(vectors, "item_id")
    return normalized(weighted.groupBy(*by, "user_id", "feature").agg(F.sum(F.col("w") * F.col("value")).alias("value")), [*by, "user_id"])


def scores(users: DataFrame, vectors: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(user_id, item_id, score): dot products where a user and an item share a feature, for
    each value of the columns `by`, which both have. Tiles of users meet tiles of items, so that
    neither a feature that a large share of the items have, such as a year, nor the products
    of single features are rows that shuffle."""
    return sparse_products(users.select(*by, "user_id", "feature", "value"), vectors.select(*by, "item_id", "feature", "value"), by)


def all_pairs(profiles_: DataFrame, vectors: DataFrame) -> DataFrame:
    """(user_id, item_id, score): the dot product of each dense profile with each dense
    vector, (user_id, profile) and (item_id, embedding)."""
    return dense_products(profiles_.select("user_id", F.col("profile").alias("f")), vectors.select("item_id", F.col("embedding").alias("f")))


def explained(users: DataFrame, vectors: DataFrame, n: int = 3, shown: DataFrame | None = None) -> DataFrame:
    """The n features that add most to each score, with their share of it in percent; of
    the (user_id, item_id) that are shown only, if given."""
    if shown is None:
        both = users.join(vectors.withColumnRenamed("value", "x"), "feature")
    else:
        both = shown.select("user_id", "item_id").join(vectors.withColumnRenamed("value", "x"), "item_id").join(users, ["user_id", "feature"])
    both = both.select("user_id", "item_id", "feature", (F.col("value") * F.col("x")).alias("contribution"))
    total = both.groupBy("user_id", "item_id").agg(F.sum("contribution").alias("total"))
    rows = both.where("contribution > 1e-7").join(total, ["user_id", "item_id"])
    rows = top_k(rows, ["user_id", "item_id"], [F.desc(F.round("contribution", 9)), F.col("feature").asc()], n)
    return rows.select("user_id", "item_id", "rank", "feature", "contribution", (F.try_divide("contribution", "total") * 100).alias("percent"))


def nearest_pick(shown: DataFrame, picks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(user_id, item_id, pick, similarity): the pick whose vector is closest to an item that
    is shown, ties by the smaller pick."""
    chosen = picks.select("user_id", F.col("item_id").alias("pick"))
    pairs = shown.select("user_id", "item_id").join(chosen, "user_id").join(vectors, "item_id").join(vectors.toDF("pick", "feature", "x"), ["pick", "feature"])
    cosines = pairs.groupBy("user_id", "item_id", "pick").agg(F.sum(F.col("value") * F.col("x")).alias("s"))
    best = cosines.groupBy("user_id", "item_id").agg(F.max(F.struct(F.round("s", 9).alias("r"), (-F.col("pick")).alias("neg"), "s")).alias("b"))
    return best.select("user_id", "item_id", (-F.col("b.neg")).alias("pick"), F.col("b.s").alias("similarity"))


def similar_items(vectors: DataFrame, item_id: int, n: int = 20) -> DataFrame:
    """The items closest to one item, itself left out."""
    one = vectors.where(F.col("item_id") == item_id).select("feature", F.col("value").alias("x"))
    rows = vectors.where(F.col("item_id") != item_id).join(F.broadcast(one), "feature")  # the features of one item
    return rows.groupBy("item_id").agg(F.sum(F.col("value") * F.col("x")).alias("similarity")).orderBy(F.desc(F.round("similarity", 9)), "item_id").limit(max(0, n))


def serving_tables(served: DataFrame, vectors: DataFrame, popularity: DataFrame, buckets: int = 8) -> tuple[DataFrame, DataFrame]:
    """The features of served items, and each served item with its name, popularity (0 where it
    has none) and the norm of its features (1 where it has none). Both are tables of the same
    buckets of item_id, so that later joins on items need no shuffle."""
    kept = bucketed(vectors.join(served.select("item_id"), "item_id", "left_semi"), "item-features", "item_id", buckets)
    norms = kept.groupBy("item_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    rows = served.join(norms, "item_id", "left").join(popularity.select("item_id", "popularity"), "item_id", "left")
    whole = rows.withColumns({"norm": F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0), "popularity": F.coalesce("popularity", F.lit(0))})
    return kept, bucketed(whole, "item-names", "item_id", buckets)


def similarity_threshold(vectors: DataFrame, share: float = 0.95) -> DataFrame:
    """One row, threshold: the percentile of the cosine of unit vectors, each paired with a
    pseudo-random other one (at times itself); pairs without a shared feature count as zero."""
    own = stored(numbered(vectors.select("item_id").distinct(), [F.col("item_id").asc()], "i"), "numbered")
    size = own.agg(F.count("*").alias("n"))
    left = own.join(F.broadcast(size), F.lit(True)).select(F.col("item_id").alias("x"), ((F.col("i") * 48271 + 11) % F.col("n")).alias("i"))  # the size is one row
    pairs = left.join(own.select("i", F.col("item_id").alias("y")), "i").select("x", "y")
    first = pairs.join(vectors.select(F.col("item_id").alias("x"), "feature", F.col("value").alias("v")), "x")
    both = first.join(vectors.select(F.col("item_id").alias("y"), "feature", "value"), ["y", "feature"])
    sums = both.groupBy("x").agg(F.sum(F.col("v") * F.col("value")).alias("s"))
    cosines = pairs.join(sums, "x", "left").select(F.round(F.coalesce("s", F.lit(0.0)), 9).alias("cosine"))
    return exact_percentile(cosines, "cosine", share)
