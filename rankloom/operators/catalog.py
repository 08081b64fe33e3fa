"""Browse, search, facets and lookups over the catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranking import tie_hash
from ..functions.text import display_title, folded

HIDDEN_GENRES = ("IMAX", "(no genres listed)")  # fixed values: genres that are no facet
SORTS = ("popular", "newest", "oldest")
FIRST_YEAR, LAST_YEAR, MOST_IDS, GENRE_CHARS = 1870, 2030, 100, 200


def build(items: DataFrame, links: DataFrame, stats: DataFrame) -> DataFrame:
    """All items, with their external id and train statistics where they have some."""
    return items.join(links.select("item_id", "external_id"), "item_id", "left").join(stats, "item_id", "left")


def exported(catalog: DataFrame) -> DataFrame:
    """The eleven columns of the served catalogue. title is the raw title; the shown title and the
    folded one that searches look into are stored beside it, genres as a JSON array."""
    shown = display_title(F.col("title"))
    return catalog.select(
        "item_id",
        "external_id",
        F.col("title").alias("title_raw"),
        shown.alias("title_display"),
        folded(shown).alias("title_search"),
        "year",
        F.to_json(F.coalesce("genres", F.array().cast("array<string>"))).alias("genres"),
        F.col("rating_count").alias("train_rating_count"),
        F.col("positive_count").alias("train_positive_count"),
        F.col("positive_ratio").alias("train_positive_ratio"),
        F.col("mean_rating").alias("train_mean_rating"),
    )


def validated(genres: Sequence[str] = (), decade: int | None = None, year: int | None = None, sort: str = "popular", limit: int = 20, most: int = 100) -> None:
    if sort not in SORTS:
        raise ValueError(f"sort is one of {', '.join(SORTS)}")
    if decade is not None and (decade % 10 or not FIRST_YEAR <= decade <= LAST_YEAR):
        raise ValueError(f"decade is a multiple of 10 from {FIRST_YEAR} to {LAST_YEAR}")
    if year is not None and not FIRST_YEAR <= year <= LAST_YEAR:
        raise ValueError(f"year lies from {FIRST_YEAR} to {LAST_YEAR}")
    if any(len(g) > GENRE_CHARS for g in genres):
        raise ValueError(f"a genre has at most {GENRE_CHARS} characters")
    if not 1 <= limit <= most:
        raise ValueError(f"limit lies from 1 to {most}")


def order(sort: str = "popular") -> list[Column]:
    popular, tie = F.desc(F.coalesce("positive_count", F.lit(0))), tie_hash(F.col("item_id"))
    if sort == "newest":
        return [F.desc(F.coalesce("year", F.lit(0))), popular, tie]
    if sort == "oldest":
        return [F.coalesce("year", F.lit(9999)).asc(), popular, tie]
    return [popular, tie.asc()]


def listed(catalog: DataFrame, genres: Sequence[str] = (), decade: int | None = None, year: int | None = None) -> DataFrame:
    """Items with an external id that meet the filters; a year wins over a decade."""
    out = catalog.where(F.col("external_id").isNotNull())
    if genres:
        out = out.where(F.arrays_overlap("genres", F.array(*map(F.lit, genres))))
    if year is not None:
        out = out.where(F.col("year") == year)
    elif decade is not None:
        out = out.where((F.col("year") >= decade) & (F.col("year") < decade + 10))
    return out


def popular(catalog: DataFrame, limit: int = 20, offset: int = 0, genres: Sequence[str] = (), decade: int | None = None, year: int | None = None, sort: str = "popular") -> DataFrame:
    validated(genres, decade, year, sort, limit)
    return listed(catalog, genres, decade, year).orderBy(*order(sort)).offset(offset).limit(limit)


def search(catalog: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Titles that hold the text, those that begin with it first; accents and case do not
    matter, and % and _ stand for any text."""
    asked = query.strip().lower()
    own = listed(catalog)
    if len(asked) < 2:
        return own.limit(0)
    found = own.where(F.lower("title").like(f"%{asked}%"))
    return found.orderBy(F.when(F.lower("title").like(f"{asked}%"), 0).otherwise(1), F.desc(F.coalesce("positive_count", F.lit(0))), "item_id").limit(limit)


def folded_search(catalog: DataFrame, query: str) -> DataFrame:
    """The same without wildcards, by a collation that ignores accents."""
    title = F.collate(F.col("title"), "UNICODE_CI_AI")
    return listed(catalog).where(F.contains(title, F.collate(F.lit(query.strip()), "UNICODE_CI_AI")))


def genre_facets(catalog: DataFrame) -> DataFrame:
    own = listed(catalog).select(F.explode("genres").alias("genre")).where(~F.col("genre").isin(*HIDDEN_GENRES))
    return own.groupBy("genre").agg(F.count("*").alias("n"))


def decade_facets(catalog: DataFrame, first: int = 1920) -> DataFrame:
    own = listed(catalog).where(F.col("year") >= first)
    return own.groupBy(F.expr("year div 10 * 10").alias("decade")).agg(F.count("*").alias("n"))


def id_list(ids: Column) -> Column:
    """The positive numbers of a comma-separated text, each once, in their order."""
    numbers = F.transform(F.split(ids, ","), lambda x: F.expr("try_cast(1 AS BIGINT)") * 0 + x.try_cast("bigint"))
    return F.array_distinct(F.filter(numbers, lambda x: x.isNotNull() & (x > 0)))


def lookup(catalog: DataFrame, ids: Sequence[int]) -> DataFrame:
    """The rows of ids in the order asked; unknown ids are left out."""
    if len(ids) > MOST_IDS:
        raise ValueError(f"at most {MOST_IDS} ids")
    spark = catalog.sparkSession
    asked = spark.createDataFrame([(n, int(x)) for n, x in enumerate(dict.fromkeys(ids))], "pos long, item_id long")
    return catalog.join(F.broadcast(asked), "item_id").orderBy("pos")


def liked_ids(catalog: DataFrame, ids: Sequence[int]) -> DataFrame:
    """The asked ids once each, with their order and if the catalogue has them."""
    spark = catalog.sparkSession
    asked = spark.createDataFrame([(n, int(x)) for n, x in enumerate(dict.fromkeys(ids))], "pos long, item_id long")
    known = catalog.select("item_id", F.lit(True).alias("known"))
    return asked.join(known, "item_id", "left").select("pos", "item_id", F.coalesce("known", F.lit(False)).alias("valid"))


def with_poster(rows: DataFrame, n: int, *by: Column) -> DataFrame:
    """The first n rows that have a poster."""
    return rows.where(F.col("poster").isNotNull()).orderBy(*by).limit(n)


def not_avoided(items: DataFrame, avoided: Sequence[str], selected: Sequence[str] = ()) -> DataFrame:
    """Items of no avoided genre, whatever its case; a selected genre is not avoided."""
    chosen = {g.lower() for g in selected}
    rest = sorted({g.lower() for g in avoided} - chosen)
    if not rest:
        return items
    return items.where(~F.arrays_overlap(F.transform(F.coalesce("genres", F.array()), F.lower), F.array(*map(F.lit, rest))))


def ordered_union(rows: DataFrame, key: str = "item_id", source: str = "source", pos: str = "pos") -> DataFrame:
    """Each id once, where it comes first by source and position."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(source, pos))).where("__n = 1").drop("__n")


def backfilled(row: DataFrame, pool: DataFrame, excluded: DataFrame, n: int = 20) -> DataFrame:
    """A row without its excluded items, refilled from the pool in the pool's order."""
    both = row.select("item_id", "pos", F.lit(0).alias("source")).unionByName(pool.select("item_id", "pos", F.lit(1).alias("source")))
    return ordered_union(both.join(excluded.select("item_id"), "item_id", "left_anti")).orderBy("source", "pos").limit(n)


def cache_state(cache: DataFrame, now: int, ok_ttl: int = 30 * 86400, other_ttl: int = 86400) -> DataFrame:
    """Adds state: hit, or miss where the entry is too old, or hidden for adult content."""
    age = F.lit(now) - F.col("fetched_at")
    fresh = age <= F.when(F.col("status") == "ok", ok_ttl).otherwise(other_ttl)
    return cache.withColumn("state", F.when(~fresh, "miss").when(F.col("adult"), "hidden").otherwise("hit"))


def genre_shares(liked: DataFrame, n: int = 6) -> DataFrame:
    """The most frequent genres of liked items and their rounded percentage."""
    counts = liked.select(F.explode("genres").alias("genre")).groupBy("genre").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(total), F.lit(True))  # the total is one row
    return shares.select("genre", "n", F.round(F.col("n") * 100 / F.col("total")).cast("long").alias("percent")).orderBy(F.desc("n"), "genre").limit(n)
