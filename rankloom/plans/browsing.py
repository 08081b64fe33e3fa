"""Catalogue queries: filters, facets, orders, lookups, rows of the home page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import tie_hash
from ..operators import catalog as C
from ..operators import stats as A
from ..sources import files
from ..sources import fixtures as X
from .registry import query

NOW = 1_700_000_000
HASH = "(item_id * 2654435761) & 4294967295"
STATS = "stats AS (SELECT item_id, count(*) AS rating_count, count(*) FILTER (rating >= 4) AS positive_count, avg(rating) AS mean_rating FROM ra GROUP BY 1)"
CATALOG = "catalog AS (SELECT items.item_id, title, genres, year, price, CASE WHEN items.item_id % 10 <> 0 THEN items.item_id + 100000 END AS external_id, rating_count, positive_count, mean_rating FROM items LEFT JOIN stats USING (item_id))"
ALL = X.with_("ra", "items", more=f"{STATS}, {CATALOG}")
SERVED = "FROM catalog WHERE external_id IS NOT NULL"
POPULAR = f"coalesce(positive_count, 0) DESC, {HASH}"
# the state that clients keep, from events: what a user liked, watched or dropped
LIKED = "liked AS (SELECT user_id, item_id, ts FROM rb WHERE rating >= 4)"
CACHE = f"cache AS (SELECT page_id AS item_id, {NOW} - page_id * 20000 AS fetched_at, CASE page_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'not_found' ELSE 'error' END AS status, page_id % 7 = 0 AS adult FROM pages)"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.items(spark, sf_dir).select("item_id", F.when(F.col("item_id") % 10 != 0, F.col("item_id") + 100000).alias("external_id"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = A.item_stats(X.ratings_a(spark, sf_dir)).drop("positive_ratio")
    return C.build(X.items(spark, sf_dir).drop("kind"), links(spark, sf_dir), stats)


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = X.table(spark, sf_dir, "pages").select(F.col("page_id").alias("item_id"))
    status = F.when(F.col("item_id") % 3 == 0, "ok").when(F.col("item_id") % 3 == 1, "not_found").otherwise("error")
    return pages.select("item_id", (F.lit(NOW) - F.col("item_id") * 20000).alias("fetched_at"), status.alias("status"), (F.col("item_id") % 7 == 0).alias("adult"))


def _page(df: DataFrame) -> DataFrame:
    return df.select("item_id", "title", "year", F.coalesce("positive_count", F.lit(0)).alias("positive_count"))


PAGE = "SELECT item_id, title, year, coalesce(positive_count, 0) AS positive_count"


@query("f4_external_id", f"{ALL} SELECT item_id, external_id {SERVED}")
def f4(spark, sf_dir):
    return C.listed(catalog(spark, sf_dir)).select("item_id", "external_id")


@query("f5_genre_any_of", f"{ALL} {PAGE} {SERVED} AND list_has_any(genres, ['azure', 'small', 'red', 'ivory'])")
def f5(spark, sf_dir):
    return _page(C.listed(catalog(spark, sf_dir), ["azure", "small", "red", "ivory"]))


@query("f6_year_over_decade", f"{ALL} SELECT 'year' AS filter, item_id {SERVED} AND year = 1965 UNION ALL SELECT 'decade', item_id {SERVED} AND year >= 1970 AND year < 1980")
def f6(spark, sf_dir):
    own = catalog(spark, sf_dir)
    both = C.listed(own, decade=1970, year=1965).select(F.lit("year").alias("filter"), "item_id")
    return both.unionByName(C.listed(own, decade=1970).select(F.lit("decade").alias("filter"), "item_id"))


@query("f7_like_search", f"{ALL} SELECT item_id, title, lower(title) LIKE 's%l%' AS is_prefix {SERVED} AND lower(title) LIKE '%s%l%'")
def f7(spark, sf_dir):
    own = C.listed(catalog(spark, sf_dir))
    return own.where(F.lower("title").like("%s%l%")).select("item_id", "title", F.lower("title").like("s%l%").alias("is_prefix"))


@query("f7_folded_search", f"{ALL} SELECT item_id, title {SERVED} AND contains(strip_accents(lower(title)), strip_accents(lower('SMÂLL')))")
def f7_folded(spark, sf_dir):
    return C.folded_search(catalog(spark, sf_dir), "SMÂLL").select("item_id", "title")


@query("f8_short_query", f"{ALL} SELECT item_id {SERVED} AND length(trim(' s ')) >= 2")
def f8(spark, sf_dir):
    return C.search(catalog(spark, sf_dir), " s ").select("item_id")


@query("f9_avoided_genres", "WITH items AS (SELECT p_partkey AS item_id, string_split(p_name, ' ') AS genres FROM part) SELECT item_id FROM items WHERE NOT list_has_any(list_transform(genres, lambda x: lower(x)), ['red', 'small'])")
def f9(spark, sf_dir):
    return C.not_avoided(X.items(spark, sf_dir), ["Red", "SMALL", "blue"], ["Blue"]).select("item_id")


@query("f10_status_exclusion", X.with_("rb", more="gone AS (SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id FROM events WHERE event_type IN ('purchase', 'error'))") + "SELECT user_id, item_id FROM rb ANTI JOIN gone USING (user_id, item_id)")
def f10(spark, sf_dir):
    events = X.table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error"))
    gone = events.select("user_id", F.get_json_object("props", "$.k").cast("long").alias("item_id"))
    return X.ratings_b(spark, sf_dir).join(gone, ["user_id", "item_id"], "left_anti").select("user_id", "item_id")


@query("f11_poster_required", X.with_("items", "enrichment") + f"SELECT item_id, poster FROM enrichment WHERE poster IS NOT NULL ORDER BY {HASH}, item_id LIMIT 20")
def f11(spark, sf_dir):
    return C.with_poster(X.enrichment(spark, sf_dir), 20, tie_hash(F.col("item_id")), F.col("item_id")).select("item_id", "poster")


@query("f12_cache_ttl", f"WITH {CACHE} SELECT item_id, status, CASE WHEN {NOW} - fetched_at > CASE WHEN status = 'ok' THEN 2592000 ELSE 86400 END THEN 'miss' WHEN adult THEN 'hidden' ELSE 'hit' END AS state FROM cache")
def f12(spark, sf_dir):
    return C.cache_state(cache(spark, sf_dir), NOW).select("item_id", "status", "state")


@query("f14_id_list", "SELECT i AS pos, v AS item_id FROM (SELECT unnest([1, 2, 3, 4]) AS i, unnest([7, 3, 12, 5]) AS v)")
def f14(spark, sf_dir):
    one = spark.createDataFrame([("7,3,x,7,-2,12,,3,0,5",)], "ids string")
    return one.select(F.posexplode(C.id_list(F.col("ids"))).alias("pos", "item_id")).select((F.col("pos") + 1).alias("pos"), "item_id")


ASKED = "CASE WHEN l_linenumber % 4 = 0 THEN 'x' || l_partkey WHEN l_linenumber % 3 = 0 THEN '-' || l_partkey ELSE CAST(l_partkey % 20 AS VARCHAR) END"


@query("f14_asked_ids", "WITH t AS (SELECT l_orderkey AS request, l_linenumber AS n, l_partkey % 20 AS id FROM lineitem WHERE l_linenumber % 4 <> 0 AND l_linenumber % 3 <> 0), f AS (SELECT request, id, min(n) AS n FROM t WHERE id > 0 GROUP BY 1, 2) SELECT request, row_number() OVER (PARTITION BY request ORDER BY n, CAST(id AS VARCHAR)) AS pos, id AS item_id FROM f")
def f14_asked(spark, sf_dir):
    """The id lists of many requests, an order each: its lines are the list, some of them no ids."""
    own = X.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("request")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.expr(ASKED.replace("VARCHAR", "STRING")).alias("id")))).alias("ids"))
    text = F.array_join(F.transform("ids", lambda x: x["id"]), ",")
    return own.select("request", F.posexplode(C.id_list(text)).alias("pos", "item_id")).select("request", (F.col("pos") + 1).cast("long").alias("pos"), "item_id")


@query("f15_liked_ids", X.with_("items") + "SELECT pos, a.item_id, items.item_id IS NOT NULL AS valid FROM (SELECT unnest([0, 1, 2, 3]) AS pos, unnest([5, 999999999, 12, 7]) AS item_id) a LEFT JOIN items USING (item_id)")
def f15(spark, sf_dir):
    return C.liked_ids(X.items(spark, sf_dir), [5, 999999999, 12, 5, 7]).select(F.col("pos").cast("int").alias("pos"), F.col("item_id"), "valid")


@query("j1_catalog_joins", f"{ALL} SELECT item_id, external_id, rating_count, positive_count, round(mean_rating, 6) AS mean_rating FROM catalog")
def j1(spark, sf_dir):
    return catalog(spark, sf_dir).select("item_id", "external_id", "rating_count", "positive_count", F.round("mean_rating", 6).alias("mean_rating"))


@query("j12_ordered_lookup", f"{ALL} SELECT pos, item_id, title FROM catalog JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS pos, unnest([42, 7, 99999999, 3, 150]) AS item_id) USING (item_id)")
def j12(spark, sf_dir):
    return C.lookup(catalog(spark, sf_dir), [42, 7, 99999999, 3, 150]).select(F.col("pos").cast("int").alias("pos"), "item_id", "title")


@query("j13_genre_exists", X.with_("items") + "SELECT item_id FROM items WHERE EXISTS (SELECT 1 FROM (SELECT unnest(genres) AS g) WHERE g IN ('red', 'blue', 'azure'))")
def j13(spark, sf_dir):
    return X.items(spark, sf_dir).where(F.exists("genres", lambda g: g.isin("red", "blue", "azure"))).select("item_id")


@query("a14_genre_facets", f"{ALL} SELECT genre, count(*) AS n FROM (SELECT unnest(genres) AS genre {SERVED}) WHERE genre NOT IN ('IMAX', '(no genres listed)') GROUP BY 1")
def a14(spark, sf_dir):
    return C.genre_facets(catalog(spark, sf_dir))


@query("a15_decade_facets", f"{ALL} SELECT CAST(year // 10 * 10 AS BIGINT) AS decade, count(*) AS n {SERVED} AND year >= 1920 GROUP BY 1")
def a15(spark, sf_dir):
    return C.decade_facets(catalog(spark, sf_dir))


@query("a21_cache_counts", f"WITH {CACHE} SELECT status, count(*) AS n FROM cache GROUP BY 1")
def a21(spark, sf_dir):
    return cache(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query("a23_genre_share_of_liked", X.with_("rb", "items", more=f"{LIKED}, g AS (SELECT unnest(genres) AS genre FROM liked JOIN items USING (item_id)), c AS (SELECT genre, count(*) AS n FROM g GROUP BY 1)") + "SELECT genre, n, CAST(round(n * 100 / (SELECT sum(n) FROM c)) AS BIGINT) AS percent FROM c ORDER BY n DESC, genre LIMIT 6")
def a23(spark, sf_dir):
    liked = A.positives(X.ratings_b(spark, sf_dir)).select("item_id").join(X.items(spark, sf_dir), "item_id")
    return C.genre_shares(liked)


@query("a24_jaccard_overlap", X.with_("rb", more=f"{LIKED}, s AS (SELECT user_id, list(item_id) AS a FROM liked GROUP BY 1)") + "SELECT s.user_id, round(len(list_intersect(s.a, t.a)) / len(list_distinct(list_concat(s.a, t.a))), 6) AS jaccard FROM s JOIN s t ON t.user_id = s.user_id + 1")
def a24(spark, sf_dir):
    own = A.positives(X.ratings_b(spark, sf_dir)).groupBy("user_id").agg(F.collect_set("item_id").alias("a"))
    other = own.select((F.col("user_id") - 1).alias("user_id"), F.col("a").alias("b"))
    return own.join(other, "user_id").select("user_id", F.round(A.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query("k4_popular", f"{ALL} {PAGE} {SERVED} ORDER BY {POPULAR} LIMIT 20")
def k4(spark, sf_dir):
    return _page(C.popular(catalog(spark, sf_dir), 20))


@query("k5_newest", f"{ALL} {PAGE} {SERVED} ORDER BY coalesce(year, 0) DESC, {POPULAR} LIMIT 20")
def k5(spark, sf_dir):
    return _page(C.popular(catalog(spark, sf_dir), 20, sort="newest"))


@query("k5_oldest", f"{ALL} {PAGE} {SERVED} ORDER BY coalesce(year, 9999), {POPULAR} LIMIT 20")
def k5_oldest(spark, sf_dir):
    return _page(C.popular(catalog(spark, sf_dir), 20, sort="oldest"))


@query("k6_page", f"{ALL} {PAGE} {SERVED} ORDER BY {POPULAR} LIMIT 20 OFFSET 40")
def k6(spark, sf_dir):
    return _page(C.popular(catalog(spark, sf_dir), 20, 40))


@query("k7_search_order", f"{ALL} {PAGE} {SERVED} AND lower(title) LIKE '%re%' ORDER BY CASE WHEN lower(title) LIKE 're%' THEN 0 ELSE 1 END, coalesce(positive_count, 0) DESC, item_id LIMIT 20")
def k7(spark, sf_dir):
    return _page(C.search(catalog(spark, sf_dir), "re"))


POSTERS = f"{ALL}, posters AS (SELECT catalog.*, url AS poster FROM catalog LEFT JOIN pages ON page_id = item_id)"


def with_posters(spark, sf_dir):
    pages = X.table(spark, sf_dir, "pages").select(F.col("page_id").alias("item_id"), F.col("url").alias("poster"))
    return C.listed(catalog(spark, sf_dir)).join(pages, "item_id", "left")


@query("k8_hero", f"{POSTERS} SELECT item_id, poster FROM posters WHERE external_id IS NOT NULL AND poster IS NOT NULL ORDER BY {POPULAR} LIMIT 1")
def k8(spark, sf_dir):
    return C.with_poster(with_posters(spark, sf_dir), 1, *C.order()).select("item_id", "poster")


@query("k9_top_external_ids", f"{ALL} SELECT external_id {SERVED} ORDER BY {POPULAR} LIMIT 100")
def k9(spark, sf_dir):
    return C.listed(catalog(spark, sf_dir)).orderBy(*C.order()).limit(100).select("external_id")


@query("k10_backfill", f"{POSTERS} SELECT item_id, poster FROM posters WHERE external_id IS NOT NULL AND year >= 1960 AND year < 1970 AND poster IS NOT NULL ORDER BY {POPULAR} LIMIT 20")
def k10(spark, sf_dir):
    rows = with_posters(spark, sf_dir).where("year >= 1960 AND year < 1970")
    return C.with_poster(rows, 20, *C.order()).select("item_id", "poster")


ROWS = [("popular", {}), ("azure", {"genres": ["azure"]}), ("small", {"genres": ["small"]}), ("1960s", {"decade": 1960}), ("1990s", {"decade": 1990})]


def _row_sql(name, asked):
    test = f"list_has_any(genres, {asked['genres']})" if "genres" in asked else f"year >= {asked['decade']} AND year < {asked['decade'] + 10}" if asked else "true"
    return f"SELECT '{name}' AS row_name, item_id FROM (SELECT item_id {SERVED} AND {test} ORDER BY {POPULAR} LIMIT 20)"


@query("q1_home", f"{ALL} SELECT 'hero' AS row_name, item_id FROM (SELECT item_id {SERVED} ORDER BY {POPULAR} LIMIT 1) UNION ALL " + " UNION ALL ".join(_row_sql(n, a) for n, a in ROWS))
def q1(spark, sf_dir):
    own = catalog(spark, sf_dir)
    out = C.popular(own, 1).select(F.lit("hero").alias("row_name"), "item_id")
    for name, asked in ROWS:
        out = out.unionByName(C.popular(own, 20, **asked).select(F.lit(name).alias("row_name"), "item_id"))
    return out


@query("q2_popular_filtered", f"{ALL} {PAGE} {SERVED} AND list_has_any(genres, ['azure', 'red']) AND year >= 1970 AND year < 1980 ORDER BY coalesce(year, 0) DESC, {POPULAR} LIMIT 50")
def q2(spark, sf_dir):
    return _page(C.popular(catalog(spark, sf_dir), 50, genres=["azure", "red"], decade=1970, sort="newest"))


@query("q3_batch", f"{ALL} {PAGE} FROM catalog WHERE item_id IN (12, 5, 7, 100)")
def q3(spark, sf_dir):
    return _page(C.lookup(catalog(spark, sf_dir), [12, 5, 5, 7, 100]))


@query("q4_detail", f"{ALL} SELECT item_id, title, genres, year, external_id, positive_count FROM catalog WHERE item_id = 42")
def q4(spark, sf_dir):
    return catalog(spark, sf_dir).where("item_id = 42").select("item_id", "title", "genres", "year", "external_id", "positive_count")


@query("q5_search", f"{ALL} {PAGE} {SERVED} AND lower(title) LIKE '%small%' ORDER BY CASE WHEN lower(title) LIKE 'small%' THEN 0 ELSE 1 END, coalesce(positive_count, 0) DESC, item_id LIMIT 10")
def q5(spark, sf_dir):
    return _page(C.search(catalog(spark, sf_dir), " Small ", 10))


@query("q7_facets", f"{ALL} SELECT 'genre' AS facet, genre AS value, count(*) AS n FROM (SELECT unnest(genres) AS genre {SERVED}) GROUP BY 2 UNION ALL SELECT 'decade', CAST(year // 10 * 10 AS VARCHAR), count(*) {SERVED} AND year >= 1920 GROUP BY 2")
def q7(spark, sf_dir):
    own = catalog(spark, sf_dir)
    genres = C.genre_facets(own).select(F.lit("genre").alias("facet"), F.col("genre").alias("value"), "n")
    return genres.unionByName(C.decade_facets(own).select(F.lit("decade").alias("facet"), F.col("decade").cast("string").alias("value"), "n"))


@query("q9_taste_state", "WITH e AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, event_type, ts FROM events WHERE event_type IN ('purchase', 'click', 'error')), l AS (SELECT user_id, item_id, max_by(CASE WHEN event_type = 'error' THEN 'dislike' ELSE 'like' END, ts) AS taste, max(ts) AS last FROM e GROUP BY 1, 2) SELECT user_id, item_id, taste, row_number() OVER (PARTITION BY user_id, taste ORDER BY last DESC, item_id) AS place FROM l")
def q9(spark, sf_dir):
    """Tastes exclude one another: the last one holds; newest first."""
    from pyspark.sql.window import Window

    events = X.table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "click", "error"))
    own = events.select("user_id", F.get_json_object("props", "$.k").cast("long").alias("item_id"), F.when(F.col("event_type") == "error", "dislike").otherwise("like").alias("taste"), "ts")
    last = own.groupBy("user_id", "item_id").agg(F.max_by("taste", "ts").alias("taste"), F.max("ts").alias("at"))
    place = F.row_number().over(Window.partitionBy("user_id", "taste").orderBy(F.desc("at"), "item_id")).cast("long")
    return last.select("user_id", "item_id", "taste", place.alias("place"))


@query("set5_ordered_dedupe", f"{ALL}, rows AS (SELECT 0 AS source, item_id, row_number() OVER (ORDER BY {POPULAR}) AS pos {SERVED} UNION ALL SELECT 1, item_id, row_number() OVER (ORDER BY year DESC, {HASH}) {SERVED} AND year >= 1990) SELECT item_id, source, pos FROM rows QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY source, pos) = 1")
def set5(spark, sf_dir):
    from ..functions.ranking import numbered

    own = C.listed(catalog(spark, sf_dir))
    first = numbered(own, C.order(), "pos").select(F.lit(0).alias("source"), "item_id", (F.col("pos") + 1).alias("pos"))
    second = numbered(own.where("year >= 1990"), [F.desc("year"), tie_hash(F.col("item_id")).asc()], "pos").select(F.lit(1).alias("source"), "item_id", (F.col("pos") + 1).alias("pos"))
    return C.ordered_union(first.unionByName(second)).select("item_id", "source", "pos")


@query("set6_backfilled_row", f"{ALL}, pop AS (SELECT item_id, row_number() OVER (ORDER BY {POPULAR}) AS pos {SERVED} QUALIFY pos <= 60), gone AS (SELECT item_id FROM pop WHERE pos % 3 = 0) SELECT item_id, pos FROM pop WHERE item_id NOT IN (SELECT item_id FROM gone) ORDER BY CASE WHEN pos <= 20 THEN 0 ELSE 1 END, pos LIMIT 20")
def set6(spark, sf_dir):
    from ..functions.ranking import numbered

    pool = numbered(C.popular(catalog(spark, sf_dir), 60), C.order(), "pos").select("item_id", (F.col("pos") + 1).alias("pos"))
    return C.backfilled(pool.where("pos <= 20"), pool, pool.where("pos % 3 = 0")).select("item_id", "pos")


MADE_TITLE = "replace(CASE WHEN p_size % 4 = 0 THEN p_name || ', The' ELSE p_name END, 'a', 'Á') || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' (' || (p_size + 1950) || ')' END"
SHOWN = "CASE WHEN contains(raw, ', The') THEN 'The ' ELSE '' END || regexp_replace(replace(raw, ', The', ''), ' \\(\\d{4}\\)$', '')"


@query("snk2_catalog_table", f"{ALL}, named AS (SELECT *, {SHOWN} AS shown FROM (SELECT p_partkey AS item_id, {MADE_TITLE} AS raw FROM part)) SELECT item_id, external_id, raw AS title_raw, shown AS title_display, strip_accents(lower(shown)) AS title_search, year, '[\"' || array_to_string(genres, '\",\"') || '\"]' AS genres, rating_count AS train_rating_count, positive_count AS train_positive_count, round(positive_count / rating_count, 6) AS train_positive_ratio, round(mean_rating, 6) AS train_mean_rating FROM catalog JOIN named USING (item_id)")
def snk2(spark, sf_dir):
    """All columns of the served catalogue, here with titles that hold a year, an article or
    accents."""
    titles = X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.expr(MADE_TITLE).alias("title"))
    items = X.items(spark, sf_dir).drop("kind", "title").join(titles, "item_id")
    own = C.exported(C.build(items, links(spark, sf_dir), A.item_stats(X.ratings_a(spark, sf_dir))))
    return files.stored(own.withColumns({c: F.round(c, 6) for c in ("train_positive_ratio", "train_mean_rating")}), "catalog")


@query("snk6_cache_upsert", f"WITH {CACHE}, news AS (SELECT item_id, {NOW} AS fetched_at, 'ok' AS status, adult FROM cache WHERE item_id % 5 = 0 UNION ALL SELECT item_id + 1000000, {NOW}, 'ok', false FROM cache WHERE item_id % 50 = 0) SELECT item_id, fetched_at, status FROM cache WHERE item_id NOT IN (SELECT item_id FROM news) UNION ALL SELECT item_id, fetched_at, status FROM news")
def snk6(spark, sf_dir):
    own = cache(spark, sf_dir)
    news = own.where("item_id % 5 = 0").select("item_id", F.lit(NOW).cast("long").alias("fetched_at"), F.lit("ok").alias("status"), "adult")
    fresh = own.where("item_id % 50 = 0").select(F.col("item_id") + 1000000, F.lit(NOW).cast("long"), F.lit("ok"), F.lit(False))
    kept = files.KeyedTable(files.scratch(spark, "cache"), own.schema, "item_id", "fetched_at", 16).create(own)
    kept.upsert(news.union(fresh))
    return kept.read(spark).select("item_id", "fetched_at", "status")


@query("src8_temp_view", "SELECT item_id, title FROM (SELECT p_partkey AS item_id, p_name AS title, p_size FROM part) WHERE p_size > 40")
def src8(spark, sf_dir):
    X.table(spark, sf_dir, "part").createOrReplaceTempView("rankloom_catalog")
    return spark.sql("SELECT p_partkey AS item_id, p_name AS title FROM rankloom_catalog WHERE p_size > 40")
