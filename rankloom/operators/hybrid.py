"""Blends of percentile ranks, and their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranking import global_average_rank, numbered, percentile_rank, tie_hash, top_k
from ..functions.vectors import every_pair
from ..sources.files import stored

# fixed values: weights (content, collaborative, popularity) by how many picks there are
WEIGHTS = [(4, (0.0, 1.0, 0.0)), (7, (0.0, 1.0, 0.0)), (14, (0.0, 1.0, 0.0)), (None, (0.1, 0.9, 0.0))]
ALPHAS = [(4, 0.3), (7, 0.6), (14, 0.7), (None, 0.8)]


def by_picks(k: Column, table: list[tuple[int | None, float]]) -> Column:
    """The value of the first bucket that holds k."""
    out = F.lit(float(table[-1][1]))
    for most, value in reversed(table[:-1]):
        out = F.when(k <= most, F.lit(float(value))).otherwise(out)
    return out


def weights(k: Column, schedule=WEIGHTS) -> list[Column]:
    return [by_picks(k, [(most, w[n]) for most, w in schedule]) for n in range(3)]


def pool(users: DataFrame, items: DataFrame, excluded: DataFrame) -> DataFrame:
    """Every user with every candidate that is not excluded for them. The candidates are
    one catalogue; scoring them all for a batch of users is what the operation is."""
    every = every_pair(users.select("user_id"), items.select("item_id"), "user_id", "item_id")
    return every.join(excluded.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def sparse_percentiles(scores: DataFrame, sizes: DataFrame) -> DataFrame:
    """Percentiles of positive scores in pools whose other members score 0, without those
    members: sizes is (user_id, n). A zero's own percentile is (zeros - 1) / (2 (n - 1))."""
    rows = scores.where("score > 0").join(sizes, "user_id")
    own = Window.partitionBy("user_id")
    ties = Window.partitionBy("user_id", "score")
    rank = F.rank().over(own.orderBy("score")) + (F.count("*").over(ties) - 1) / F.lit(2.0)
    zeros = F.col("n") - F.count("*").over(own)
    return rows.select("user_id", "item_id", F.when(F.col("n") == 1, 1.0).otherwise((zeros + rank - 1) / F.nullif(F.col("n") - 1, F.lit(0))).alias("pct"))


def blended(rows: DataFrame, w: list[Column | float], parts: tuple[str, ...] = ("content", "cf", "popularity"), round_to: int = 9) -> DataFrame:
    """Adds pct_<part> for each score column, their weighted sum as score, and its own
    percentile as pct."""
    for part in parts:
        rows = rows.withColumn(f"pct_{part}", percentile_rank(F.round(F.coalesce(part, F.lit(0.0)), round_to), ["user_id"]))
    total = sum((F.lit(x) if isinstance(x, float) else x) * F.col(f"pct_{part}") for x, part in zip(w, parts, strict=True))
    rows = rows.withColumn("score", F.round(total, round_to))
    return rows.withColumn("pct", percentile_rank(F.col("score"), ["user_id"]))


def ranked(rows: DataFrame, k: int) -> DataFrame:
    return top_k(rows, ["user_id"], [F.desc("score"), tie_hash(F.col("item_id")).asc(), F.col("item_id").asc()], k)


def best_blends(scores: dict[str, DataFrame], popularity: DataFrame, excluded: DataFrame, w: dict[str, float], k: int, round_to: int = 9) -> DataFrame:
    """(user_id, item_id, rank, score, pct_<part>): the first k of what `ranked(blended(pool))` gives,
    without the pool. scores has rows (user_id, item_id, score), none below zero, of each part but
    popularity, which is (item_id, popularity) of every candidate; excluded (user_id, item_id)
    names all users. Items that a part scores zero share one percentile, which their number
    tells. The percentile of popularity in a user's pool is the rank among all candidates less the
    excluded ones below. So only items with a positive part are scored, and, where fewer than k of
    them beat whatever has none, the most popular others."""
    catalogue = stored(global_average_rank(popularity.select("item_id", F.round(F.coalesce("popularity", F.lit(0.0)), round_to).alias("pop")), "pop", "r"), "catalogue")
    n_all = catalogue.count()
    known = excluded.select("user_id", "item_id").distinct().join(catalogue, "item_id", "left")
    users = stored(known.groupBy("user_id").agg((n_all - F.count("pop")).alias("n"), F.collect_list("pop").alias("gone")), "users")
    wide, zero = None, users
    for part, rows in scores.items():
        own = rows.select("user_id", "item_id", F.round("score", round_to).alias("score")).where("score > 0").join(catalogue.select("item_id"), "item_id", "left_semi").join(excluded.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
        own = stored(sparse_percentiles(own, users.select("user_id", "n")).withColumnRenamed("pct", f"pct_{part}"), f"pct-{part}")
        zeros = F.col("n") - F.coalesce("__n", F.lit(0))
        zero = zero.join(own.groupBy("user_id").agg(F.count("*").alias("__n")), "user_id", "left").withColumn(f"zero_{part}", F.when(F.col("n") == 1, 1.0).otherwise((zeros - 1) / F.nullif(2 * (F.col("n") - 1), F.lit(0)))).drop("__n")
        wide = own if wide is None else wide.join(own, ["user_id", "item_id"], "full")
    zero = stored(zero, "zeros", instead_of=users)
    placed = numbered(catalogue, [F.desc("pop"), tie_hash(F.col("item_id")).asc(), F.col("item_id").asc()], "i")

    def scored(rows: DataFrame) -> DataFrame:
        """Of (user_id, item_id, n, gone, pop, r and the percentiles that are known)."""
        below = F.aggregate("gone", F.lit(0.0), lambda s, x: s + F.when(x < F.col("pop"), 1.0).when(x == F.col("pop"), 0.5).otherwise(0.0))
        rows = rows.withColumn("pct_popularity", F.when(F.col("n") == 1, 1.0).otherwise((F.col("r") - below - 1) / F.nullif(F.col("n") - 1, F.lit(0))))
        rows = rows.withColumns({f"pct_{part}": F.coalesce(f"pct_{part}", f"zero_{part}") for part in scores})
        total = sum(F.lit(float(x)) * F.col(f"pct_{part}") for part, x in w.items())
        return rows.select("user_id", "item_id", *(f"pct_{part}" for part in (*scores, "popularity")), F.round(total, round_to).alias("score"))

    rows = stored(scored(wide.join(zero, "user_id").join(catalogue, "item_id")), "scored")
    ceiling = F.round(sum(F.lit(float(w[part])) * F.col(f"zero_{part}") for part in scores) + float(w["popularity"]), round_to)
    held = rows.join(zero.select("user_id", ceiling.alias("ceiling")), "user_id").groupBy("user_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("score") > F.col("ceiling")).alias("above"))
    few = zero.join(held, "user_id", "left").where(F.coalesce("above", F.lit(0)) < k)
    reach = F.least(F.lit(n_all).cast("long"), F.size("gone") + F.coalesce("n_rows", F.lit(0)) + k)
    rest = few.where(F.lit(n_all > 0)).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), reach - 1))).join(placed, "i")
    rest = rest.join(excluded.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti").join(rows.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    rest = scored(rest.withColumns({f"pct_{part}": F.lit(None).cast("double") for part in scores}))
    return ranked(rows.unionByName(rest), k)


def match_percent(pct: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), F.rint(pct * 100))).cast("long")


def component_shares(rows: DataFrame, parts: tuple[str, ...] = ("content", "cf", "popularity")) -> DataFrame:
    """Adds share_<part>: each part of the blend over their sum."""
    total = sum(F.col(p) for p in parts)
    return rows.select("*", *(F.coalesce(F.try_divide(F.col(p), total), F.lit(0.0)).alias(f"share_{p}") for p in parts))


def reasons(rows: DataFrame, similarity: float | Column, support: float | Column) -> DataFrame:
    """Adds codes and labels. A pick is similar from a cosine on, liked together from a count on. rows has w_content, w_cf, w_popularity, the components content,
    cf and popularity, pick_cos, pick_title, shared_genres, shared_tags, cf_title and n_ij."""
    content, cf, pop = F.col("w_content") > 0, F.col("w_cf") > 0, F.col("w_popularity") > 0
    rules = [
        ("SIMILAR_TO_PICK", content & (F.col("pick_cos") >= similarity), F.concat(F.lit("Similar to "), "pick_title")),
        ("SHARED_GENRES", content & (F.size("shared_genres") > 0), F.concat(F.lit("Shared genres: "), F.array_join("shared_genres", ", "))),
        ("SHARED_TAGS", content & (F.size("shared_tags") > 0), F.concat(F.lit("Shared tags: "), F.array_join("shared_tags", ", "))),
        ("POPULAR_WITH_VIEWERS", pop & (F.col("popularity") >= F.greatest("content", "cf")), F.lit("Popular with viewers")),
        ("CO_LIKED_BY_USERS", cf & (F.coalesce("n_ij", F.lit(0)) >= support), F.concat(F.format_number(F.coalesce("n_ij", F.lit(0)), 0), F.lit(" viewers who liked "), "cf_title", F.lit(" also liked this"))),
    ]
    found = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(code).alias("code"), label.alias("label"))) for code, test, label in rules)))
    return rows.withColumn("__r", found).withColumn("codes", F.transform("__r", lambda r: r["code"])).withColumn("labels", F.map_from_entries("__r")).drop("__r")


def simplex(steps: int = 10) -> list[tuple[float, float, float]]:
    """Weights that sum to one, in steps of 1 / steps."""
    return [(i / steps, j / steps, (steps - i - j) / steps) for i in range(steps + 1) for j in range(steps + 1 - i)]


def monotone(schedule: DataFrame, k: str = "k", value: str = "alpha") -> DataFrame:
    """The running maximum of a value over k; a schedule has a few rows."""
    return schedule.withColumn(value, F.max(value).over(Window.orderBy(k)))


def dominant_genres(picks: DataFrame, items: DataFrame) -> DataFrame:
    """(user_id, genre): the genre that most picks of a user have; of several, the first by name."""
    counts = picks.join(items.select("item_id", F.explode("genres").alias("genre")), "item_id").groupBy("user_id", "genre").agg(F.count("*").alias("n"))
    return counts.groupBy("user_id").agg(F.min_by("genre", F.struct(-F.col("n"), "genre")).alias("genre"))


def genre_report(shown: DataFrame, picks: DataFrame, items: DataFrame, row: DataFrame) -> DataFrame:
    """Per user: the dominant genre of the picks, the share of shown items that have it, the share
    of a row that all see, such as the most popular items, and what the first exceeds the second
    by. The row's genres, a count each, are joined by genre; nothing grows with users times items."""
    genres = items.select("item_id", F.array_distinct(F.coalesce("genres", F.array().cast("array<string>"))).alias("genres"))
    own = dominant_genres(picks, items)
    listed = shown.join(genres, "item_id").join(own, "user_id")
    shares = listed.groupBy("user_id", "genre").agg(F.avg(F.array_contains("genres", F.col("genre")).cast("double")).alias("shown_share"))
    of_row = row.select("item_id").join(genres, "item_id")
    size = of_row.agg(F.count("*").alias("size"))
    counts = of_row.select(F.explode("genres").alias("genre")).groupBy("genre").agg(F.count("*").alias("__n"))
    common = counts.join(F.broadcast(size), F.lit(True)).select("genre", (F.col("__n") / F.col("size")).alias("row_share"))  # the size is one row
    out = shares.join(common, "genre", "left").withColumn("row_share", F.coalesce("row_share", F.lit(0.0)))
    return out.select("user_id", "genre", "shown_share", "row_share", (F.col("shown_share") - F.col("row_share")).alias("lift"))
