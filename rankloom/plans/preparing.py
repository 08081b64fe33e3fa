"""Ingestion, checks, statistics, activity filter, split and scalar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ranking import ITEM_FACTOR, ROUNDS, SEED_FACTOR, USER_FACTOR, dense_index, tie_hash, with_pair_hash
from ..operators import kcore, split, stats
from ..sources import files
from ..sources import fixtures as X
from .registry import query

RA, RB = X.with_("ra"), X.with_("rb")
HASHED = "(user_id * 2654435761 & 4294967295)"
WORD = "18446744073709551616::UHUGEINT"  # 2^64


def tied(source: str, seed: int = 42) -> str:
    """The rows of a table with the tie hash of user and item, in 128-bit arithmetic modulo 2^64."""
    rows = f"SELECT *, (user_id::UHUGEINT * {USER_FACTOR}::UHUGEINT + item_id::UHUGEINT * {ITEM_FACTOR}::UHUGEINT + {seed * SEED_FACTOR}::UHUGEINT) % {WORD} AS h FROM {source}"
    for shift, factor in ROUNDS:
        rows = f"SELECT * REPLACE ((xor(h, h >> {shift}) * {factor}::UHUGEINT) % {WORD} AS h) FROM ({rows})"
    return f"(SELECT * EXCLUDE (h), CAST(CASE WHEN h >= 9223372036854775808::UHUGEINT THEN h::HUGEINT - 18446744073709551616::HUGEINT ELSE h::HUGEINT END AS BIGINT) AS tie FROM ({rows}))"


SEQ = f"seq AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, tie, item_id) - 1 AS seq, count(*) OVER (PARTITION BY user_id) AS n FROM {tied('ra')})"
SPLIT = f"{SEQ}, split AS (SELECT *, CASE WHEN seq >= n - h THEN 'test' WHEN seq >= n - 2 * h THEN 'val' ELSE 'train' END AS split FROM (SELECT *, CAST(greatest(1, round_even(CAST(0.1 AS DOUBLE) * n, 0)) AS BIGINT) AS h FROM seq))"
PASSES = 6  # as many as the fixture needs, and some more that change nothing


def core_sql(least: int, passes: int = PASSES, source: str = "ra") -> str:
    """The activity filter unrolled."""
    out, last = [], source
    for n in range(passes):
        out.append(f"u{n} AS (SELECT * FROM {last} WHERE user_id IN (SELECT user_id FROM {last} GROUP BY 1 HAVING count(*) >= {least}))")
        out.append(f"c{n} AS (SELECT * FROM u{n} WHERE item_id IN (SELECT item_id FROM u{n} GROUP BY 1 HAVING count(*) >= {least}))")
        last = f"c{n}"
    return ", ".join(out)


CORE = f"c{PASSES - 1}"
TAGS = "tags AS (SELECT user_id, item_id, event_type || ' ' || item_id AS tag, ts FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events))"


def tags(spark, sf_dir):
    events = X.table(spark, sf_dir, "events")
    item = F.get_json_object("props", "$.k").cast("long")
    return events.select("user_id", item.alias("item_id"), F.concat("event_type", F.lit(" "), item.cast("string")).alias("tag"), F.expr(f"timestampdiff(SECOND, {X.EPOCH}, ts)").alias("ts"))


def links(spark, sf_dir):
    return X.items(spark, sf_dir).select("item_id", F.lpad(F.col("item_id").cast("string"), 7, "0").alias("imdb_id"), F.when(F.col("item_id") % 10 != 0, (F.col("item_id") + 100000).cast("double")).alias("tmdb_id"))


@query("src1_csv_ratings", f"{RA} SELECT CAST(user_id AS INT) AS user_id, CAST(item_id AS INT) AS item_id, CAST(rating AS FLOAT) AS rating, ts FROM ra")
def src1(spark, sf_dir):
    return files.read_ratings(spark, files.through_csv(X.ratings_a(spark, sf_dir), "ratings"))


@query("src2_csv_items", "SELECT CAST(p_partkey AS INT) AS item_id, p_name AS title, string_split(p_name, ' ') AS genres, CAST(CASE WHEN p_size % 17 <> 0 THEN 1950 + p_size END AS INT) AS year, p_size % 17 = 0 AS no_year FROM part")
def src2(spark, sf_dir):
    own = X.items(spark, sf_dir)
    raw = own.select("item_id", F.concat("title", F.when(F.col("year").isNull(), F.lit(" ")).otherwise(F.concat(F.lit(" ("), F.col("year").cast("string"), F.lit(") ")))).alias("title"), F.array_join("genres", " | ").alias("genres"))
    read = files.read_items(spark, files.through_csv(raw, "movies"))
    return read.select("item_id", "title", "genres", "year", F.col("year").isNull().alias("no_year"))


@query("src3_csv_tags", f"WITH {TAGS} SELECT CAST(user_id AS INT) AS user_id, CAST(item_id AS INT) AS item_id, tag, ts FROM tags WHERE ts % 5 <> 0")
def src3(spark, sf_dir):
    own = tags(spark, sf_dir).withColumn("tag", F.when(F.col("ts") % 5 == 0, F.when(F.col("ts") % 2 == 0, "   ")).otherwise(F.concat(F.lit("  "), "tag", F.lit(" "))))
    return files.read_tags(spark, files.through_csv(own, "tags"))


@query("src4_csv_links", "SELECT CAST(p_partkey AS INT) AS item_id, lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(7, length(CAST(p_partkey AS VARCHAR))) AS INT), '0') AS imdb_id, CAST(CASE WHEN p_partkey % 10 <> 0 THEN p_partkey + 100000 END AS INT) AS tmdb_id, p_partkey % 10 = 0 AS tmdb_missing FROM part")
def src4(spark, sf_dir):
    return files.read_links(spark, files.through_csv(links(spark, sf_dir), "links"))


SCORES = "scores AS (SELECT item_id, CAST(unnest(range(8)) AS INT) AS tag_id, CAST(unnest(embedding[1:8]) AS FLOAT) AS relevance FROM vectors)"


@query("src5_csv_scores", X.with_("vectors", more=SCORES) + "SELECT CAST(item_id AS INT) AS item_id, tag_id, 'tag ' || tag_id AS tag, round(relevance, 4) AS relevance FROM scores")
def src5(spark, sf_dir):
    own = X.item_vectors(spark, sf_dir).select("item_id", F.posexplode(F.slice("embedding", 1, 8)).alias("tag_id", "relevance"))
    names = own.select("tag_id").distinct().select("tag_id", F.concat(F.lit("tag "), F.col("tag_id").cast("string")).alias("tag"))
    return files.read_scores(spark, files.through_csv(own, "scores"), files.through_csv(names, "score-tags")).select("item_id", "tag_id", "tag", F.round("relevance", 4).alias("relevance"))


@query("src6_pruned_scan", "SELECT l_partkey AS item_id, l_quantity AS quantity FROM lineitem WHERE l_quantity > 45")
def src6(spark, sf_dir):
    return X.table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("item_id"), F.col("l_quantity").alias("quantity"))


@query("src7_long_vectors", X.with_("vectors") + "SELECT item_id, CAST(unnest(range(len(embedding))) AS INT) AS feature, round(CAST(unnest(embedding) AS DOUBLE), 5) AS value FROM vectors")
def src7(spark, sf_dir):
    return X.item_vectors(spark, sf_dir).select("item_id", F.posexplode("embedding").alias("feature", "value")).select("item_id", "feature", F.round(F.col("value").cast("double"), 5).alias("value"))


@query("snk1_parquet_round_trip", f"{RA} SELECT * FROM ra")
def snk1(spark, sf_dir):
    return files.stored(X.ratings_a(spark, sf_dir), "ratings")


@query("snk3_json_report", f"{RA} SELECT 'ratings' AS report, '{{\"n_ratings\":' || count(*) || ',\"n_users\":' || count(DISTINCT user_id) || '}}' AS body FROM ra")
def snk3(spark, sf_dir):
    one = stats.density(X.ratings_a(spark, sf_dir))
    return one.select(F.lit("ratings").alias("report"), F.to_json(F.struct("n_ratings", "n_users")).alias("body"))


@query("f1_positive_filter", f"{RA} SELECT user_id, item_id FROM ra WHERE rating >= 4")
def f1(spark, sf_dir):
    return stats.positives(X.ratings_a(spark, sf_dir)).select("user_id", "item_id")


@query("f2_membership", f"{RA} SELECT user_id, item_id FROM ra WHERE item_id IN (SELECT vec_id FROM embeddings)")
def f2(spark, sf_dir):
    known = X.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"))
    return X.ratings_a(spark, sf_dir).join(known, "item_id", "left_semi").select("user_id", "item_id")


@query("f3_negated_membership", f"{RA} SELECT user_id, item_id FROM ra WHERE item_id NOT IN (SELECT vec_id FROM embeddings)")
def f3(spark, sf_dir):
    known = X.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"))
    return X.ratings_a(spark, sf_dir).join(known, "item_id", "left_anti").select("user_id", "item_id")


@query("f13_valid_ranges", f"{RA} SELECT count(*) FILTER (rating BETWEEN 0.5 AND 5) AS valid, count(*) FILTER (rating < 0.5 OR rating > 5) AS invalid FROM ra")
def f13(spark, sf_dir):
    return X.ratings_a(spark, sf_dir).agg(F.count_if(F.col("rating").between(0.5, 5)).alias("valid"), F.count_if(~F.col("rating").between(0.5, 5)).alias("invalid"))


@query("f16_guarded_split", X.with_("ra", more=SPLIT) + "SELECT user_id, item_id FROM split WHERE split = 'test'")
def f16(spark, sf_dir):
    wanted = files.allowed("test", final=True, frozen="config-1")
    return split.temporal_split(X.ratings_a(spark, sf_dir)).where(F.col("split") == wanted).select("user_id", "item_id")


@query("j2_aligned_fill", X.with_("rb", "items") + "SELECT item_id, coalesce(v, 0) AS v, round(coalesce(r, (SELECT avg(rating) FROM rb)), 6) AS r FROM items LEFT JOIN (SELECT item_id, count(*) AS v, avg(rating) AS r FROM rb GROUP BY 1) USING (item_id)")
def j2(spark, sf_dir):
    rated = X.ratings_b(spark, sf_dir)
    own = X.items(spark, sf_dir).select("item_id").join(stats.item_stats(rated), "item_id", "left")
    mean = rated.agg(F.avg("rating").alias("c"))
    return own.join(F.broadcast(mean), F.lit(True)).select("item_id", F.coalesce("rating_count", F.lit(0)).alias("v"), F.round(F.coalesce("mean_rating", "c"), 6).alias("r"))


@query("j3_boundary_rows", X.with_("ra", more=SPLIT) + "SELECT user_id, last_ts, last_item, first_ts, first_item FROM (SELECT user_id, ts AS last_ts, item_id AS last_item FROM split WHERE split = 'train' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1) JOIN (SELECT user_id, ts AS first_ts, item_id AS first_item FROM split WHERE split = 'val' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq) = 1) USING (user_id)")
def j3(spark, sf_dir):
    return split.boundary(split.temporal_split(X.ratings_a(spark, sf_dir)), "train", "val")


@query("j4_id_map_join", f"{RA}, ids AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM (SELECT DISTINCT item_id FROM ra)) SELECT user_id, idx FROM ra JOIN ids USING (item_id)")
def j4(spark, sf_dir):
    rated = X.ratings_a(spark, sf_dir)
    return rated.join(dense_index(rated, "item_id"), "item_id").select("user_id", "idx")


@query("a1_item_stats", f"{RA} SELECT item_id, count(*) AS rating_count, count(*) FILTER (rating >= 4) AS positive_count, round(avg(rating), 6) AS mean_rating, round(count(*) FILTER (rating >= 4) / count(*), 6) AS positive_ratio FROM ra GROUP BY 1")
def a1(spark, sf_dir):
    return stats.item_stats(X.ratings_a(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("mean_rating", "positive_ratio")})


@query("a2_user_stats", f"{RA} SELECT user_id, count(*) AS rating_count, count(*) FILTER (rating >= 4) AS positive_count, round(avg(rating), 6) AS mean_rating FROM ra GROUP BY 1")
def a2(spark, sf_dir):
    return stats.user_stats(X.ratings_a(spark, sf_dir)).withColumn("mean_rating", F.round("mean_rating", 6))


@query("a3_candidate_stats", X.with_("ra", more=SPLIT) + "SELECT item_id, count(*) AS n, count(*) FILTER (rating >= 4) AS pos, round(avg(rating), 6) AS mean, round((SELECT avg(rating) FROM split WHERE split = 'train'), 6) AS global_mean FROM split WHERE split = 'train' GROUP BY 1")
def a3(spark, sf_dir):
    train = split.temporal_split(X.ratings_a(spark, sf_dir)).where("split = 'train'")
    mean = train.agg(F.round(F.avg("rating"), 6).alias("global_mean"))
    return stats.item_stats(train).join(F.broadcast(mean), F.lit(True)).select("item_id", F.col("rating_count").alias("n"), F.col("positive_count").alias("pos"), F.round("mean_rating", 6).alias("mean"), "global_mean")


@query("a4_distinct_counts", f"{RA} SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items FROM ra")
def a4(spark, sf_dir):
    return stats.density(X.ratings_a(spark, sf_dir)).select("n_users", "n_items")


@query("a5_density", f"{RA} SELECT n_ratings, round(n_ratings / (u * i), 9) AS density, round(1 - n_ratings / (u * i), 9) AS sparsity FROM (SELECT count(*) AS n_ratings, count(DISTINCT user_id) AS u, count(DISTINCT item_id) AS i FROM ra)")
def a5(spark, sf_dir):
    return stats.density(X.ratings_a(spark, sf_dir)).select("n_ratings", F.round("density", 9).alias("density"), F.round("sparsity", 9).alias("sparsity"))


@query("a6_histogram", f"{RA} SELECT rating, count(*) AS n FROM ra GROUP BY 1")
def a6(spark, sf_dir):
    return stats.histogram(X.ratings_a(spark, sf_dir))


@query("a7_summary", f"{RA} SELECT min(rating) AS min, max(rating) AS max, round(avg(rating), 4) AS mean, quantile_cont(rating, 0.5) AS median, round(stddev_samp(rating), 4) AS std FROM ra")
def a7(spark, sf_dir):
    return stats.summary(X.ratings_a(spark, sf_dir)).withColumns({c: F.round(c, 4) for c in ("mean", "std")})


@query("a8_activity_quantiles", f"{RA} SELECT k AS key, " + ", ".join(f"quantile_cont(n, {p}) AS p{round(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)) + " FROM (SELECT 'user' AS k, count(*) AS n FROM ra GROUP BY user_id UNION ALL SELECT 'item', count(*) FROM ra GROUP BY item_id) GROUP BY k")
def a8(spark, sf_dir):
    rated = X.ratings_a(spark, sf_dir)
    return stats.activity_quantiles(rated, "user_id").select(F.lit("user").alias("key"), "*").unionByName(stats.activity_quantiles(rated, "item_id").select(F.lit("item").alias("key"), "*"))


@query("a9_low_activity", f"{RA} SELECT count(*) FILTER (n < 10) AS below_10, count(*) FILTER (n < 20) AS below_20, count(*) FILTER (n < 30) AS below_30 FROM (SELECT count(*) AS n FROM ra GROUP BY user_id)")
def a9(spark, sf_dir):
    return stats.below(X.ratings_a(spark, sf_dir), "user_id", (10, 20, 30))


@query("a10_spans", f"{RA} SELECT user_id, round((max(ts) - min(ts)) / 86400.0, 6) AS span_days, count(*) AS n FROM ra GROUP BY 1")
def a10(spark, sf_dir):
    return stats.spans(X.ratings_a(spark, sf_dir)).withColumn("span_days", F.round("span_days", 6))


@query("a11_duplicates", f"{RA} SELECT (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM ra GROUP BY user_id, item_id)) AS duplicate_pairs, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM ra GROUP BY user_id, ts) WHERE n > 1) AS tied_rows")
def a11(spark, sf_dir):
    return stats.duplicates(X.ratings_a(spark, sf_dir))


@query("a12_checks", X.with_("rb", more="items AS (SELECT p_partkey AS item_id FROM part WHERE p_partkey % 7 <> 0)") + "SELECT 'rating_range' AS \"check\", count(*) FILTER (rating < 0.5 OR rating > 5) AS bad FROM rb UNION ALL SELECT 'time_positive', count(*) FILTER (ts <= 0) FROM rb UNION ALL SELECT 'ratings_item', count(*) FROM rb ANTI JOIN items USING (item_id) UNION ALL SELECT 'links_item', count(*) FROM (SELECT p_partkey AS item_id FROM part) ANTI JOIN items USING (item_id) UNION ALL SELECT 'unique_pairs', count(*) FROM (SELECT 1 FROM rb GROUP BY user_id, item_id HAVING count(*) > 1)")
def a12(spark, sf_dir):
    known = X.items(spark, sf_dir).where("item_id % 7 <> 0")
    return stats.checks(X.ratings_b(spark, sf_dir), known, links=X.items(spark, sf_dir))


VALID = X.with_("rb", "items", more=f"{TAGS}, links AS (SELECT page_id AS item_id, CASE WHEN length(url) % 4 <> 0 THEN page_id END AS tmdb_id FROM pages), scores AS (SELECT vec_id AS item_id, unnest(range(8)) AS tag_id FROM embeddings), v AS (SELECT 'users' AS \"check\", count(DISTINCT user_id) AS value, NULL AS part, NULL AS lo, NULL AS hi FROM rb")
VALID = VALID.rstrip() + "".join(
    f" UNION ALL SELECT {row}"
    for row in (
        "'rated_items', count(DISTINCT item_id), NULL, NULL, NULL FROM rb",
        *(f"'n_{t}', count(*), NULL, NULL, NULL FROM {name}" for t, name in (("ratings", "rb"), ("items", "items"), ("tags", "tags"), ("links", "links"), ("scores", "scores"))),
        "'rating_low', min(rating), NULL, 0.5, 1e18 FROM rb",
        "'rating_high', max(rating), NULL, -1e18, 5 FROM rb",
        "'time_first', min(ts), NULL, 780000000000000, 1e18 FROM rb",
        "'time_last', max(ts), NULL, -1e18, 4102444800000000 FROM rb",
        "'duplicate_ratings', count(*) - count(DISTINCT (user_id, item_id)), NULL, 0, 0 FROM rb",
        "'duplicate_items', count(*) - count(DISTINCT item_id), NULL, 0, 0 FROM items",
        "'year_failures', count(*) FILTER (year IS NULL), 100 * count(*) FILTER (year IS NULL) / count(*), NULL, NULL FROM items",
        "'no_genres', count(*) FILTER (len(genres) = 0), 100 * count(*) FILTER (len(genres) = 0) / count(*), NULL, NULL FROM items",
        *(f"'{c}', count(DISTINCT item_id), NULL, 0, 0 FROM {t} ANTI JOIN items USING (item_id)" for c, t in (("orphan_rated_items", "rb"), ("orphan_links", "links"), ("orphan_tags", "tags"), ("orphan_score_items", "scores"))),
        "'missing_external', count(*) FILTER (tmdb_id IS NULL), 100 * count(*) FILTER (tmdb_id IS NULL) / count(*), NULL, NULL FROM links",
        "'unique_tags', count(DISTINCT tag), NULL, NULL, NULL FROM tags",
        "'items_with_scores', count(DISTINCT item_id), 100 * count(DISTINCT item_id) / (SELECT count(*) FROM items), NULL, NULL FROM scores",
        "'orphan_score_tags', count(DISTINCT tag_id), NULL, 0, 0 FROM scores WHERE tag_id NOT IN (SELECT r_regionkey FROM region)",
    )
)


@query("a12_validation", VALID + ') SELECT "check", CAST(value AS DOUBLE) AS value, round(part, 2) AS percent, value BETWEEN lo AND hi AS valid FROM v')
def a12_validation(spark, sf_dir):
    """Every check of a data set of six tables, each table scanned once."""
    pages = X.table(spark, sf_dir, "pages")
    own = pages.select(F.col("page_id").alias("item_id"), F.when(F.length("url") % 4 != 0, F.col("page_id")).alias("tmdb_id"))
    scores = X.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("tag_id"))
    known = X.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("tag_id"))
    return stats.validation(X.ratings_b(spark, sf_dir), X.items(spark, sf_dir), tags(spark, sf_dir), own, scores, known, since=780_000_000 * 10**6, until=4_102_444_800 * 10**6)


@query("a10_span_summary", f"{RA}, s AS (SELECT (max(ts) - min(ts)) / 86400.0 AS d FROM ra GROUP BY user_id) SELECT count(*) AS n_users, round(avg(CASE WHEN d < 1 THEN 1.0 ELSE 0.0 END), 6) AS under_a_day, round(median(d), 6) AS median_days FROM s".replace("WITH ra", "WITH ra").replace(") , s AS", "), s AS"))
def a10_summary(spark, sf_dir):
    return stats.span_summary(X.ratings_a(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("under_a_day", "median_days")})


GRID_USERS, GRID_ITEMS, UNROLLED = (20, 50, 100), (5, 20, 50), 24


def _grid_sql() -> str:
    """All settings in one table, pass by pass; a pass that changes nothing is the last."""
    pairs = ", ".join(f"({n}, {u}, {i})" for n, (u, i) in enumerate((u, i) for u in GRID_USERS for i in GRID_ITEMS))
    steps = ["c0 AS MATERIALIZED (SELECT s, mu, mi, user_id, item_id FROM ra, st)"]
    for n in range(1, UNROLLED + 1):
        steps += [f"u{n} AS (SELECT * FROM c{n - 1} QUALIFY count(*) OVER (PARTITION BY s, user_id) >= mu)", f"c{n} AS MATERIALIZED (SELECT * FROM u{n} QUALIFY count(*) OVER (PARTITION BY s, item_id) >= mi)"]
    sizes = " UNION ALL ".join(f"SELECT s, {n} AS p, count(*) AS n FROM c{n} GROUP BY s" for n in range(UNROLLED + 1))
    last = f"c{UNROLLED}"
    return X.with_("ra", more=f"st(s, mu, mi) AS (VALUES {pairs}), {', '.join(steps)}, sizes AS (SELECT st.s, p, coalesce(n, 0) AS n FROM st CROSS JOIN (SELECT unnest(range({UNROLLED + 1})) AS p) LEFT JOIN ({sizes}) USING (s, p)), done AS (SELECT s, min(p) AS passes FROM (SELECT s, p, n = lag(n) OVER (PARTITION BY s ORDER BY p) AS same FROM sizes) WHERE same GROUP BY 1), k AS (SELECT s, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, count(*) AS n_ratings FROM {last} GROUP BY 1)") + "SELECT mu AS min_user, mi AS min_item, coalesce(n_users, 0) AS n_users, coalesce(n_items, 0) AS n_items, coalesce(n_ratings, 0) AS n_ratings, round(coalesce(n_ratings / (CAST(n_users AS DOUBLE) * n_items), 0), 6) AS density, round(1 - coalesce(n_ratings / (CAST(n_users AS DOUBLE) * n_items), 0), 6) AS sparsity, CAST(passes AS INT) AS passes FROM st LEFT JOIN k USING (s) LEFT JOIN done USING (s)"


@query("a13_threshold_grid", _grid_sql())
def a13(spark, sf_dir):
    """Nine pairs of thresholds at once."""
    out = kcore.threshold_grid(X.ratings_a(spark, sf_dir), GRID_USERS, GRID_ITEMS)
    return out.withColumns({"density": F.round("density", 6), "sparsity": F.round("sparsity", 6)})


@query("a22_content_hash", X.with_("items") + "SELECT count(*) AS n_rows, CAST(coalesce(sum(CAST('0x' || substr(sha256(concat_ws(',', CAST(item_id AS VARCHAR), coalesce(kind, ''), coalesce(CAST(price AS VARCHAR), ''), coalesce(title, ''), coalesce(CAST(year AS VARCHAR), ''))), 1, 12) AS BIGINT)) % 1000000007, 0) AS BIGINT) AS content_hash FROM items")
def a22(spark, sf_dir):
    return stats.content_hash(X.items(spark, sf_dir).drop("genres"))


@query("a26_tie_audit", X.with_("ra", more=SPLIT) + """, l AS (SELECT user_id, max(ts) AS lt FROM split WHERE split = 'train' GROUP BY 1), f AS (SELECT user_id, min(ts) AS ft FROM split WHERE split = 'val' GROUP BY 1), t AS (SELECT user_id, lt AS ts FROM l JOIN f USING (user_id) WHERE lt = ft),
r AS (SELECT split, item_id, CASE WHEN count(*) OVER w = 1 THEN 0.5 ELSE (row_number() OVER (PARTITION BY user_id, ts ORDER BY item_id) - 1) / (count(*) OVER w - 1) END AS rank FROM split JOIN t USING (user_id, ts) WHERE split IN ('train', 'val') WINDOW w AS (PARTITION BY user_id, ts))
SELECT (SELECT count(*) FROM l JOIN f USING (user_id)) AS users, (SELECT count(*) FROM t) AS tied_users, round(avg(item_id) FILTER (split = 'train'), 6) AS item_id_train, round(avg(rank) FILTER (split = 'train'), 6) AS rank_train, round(avg(item_id) FILTER (split = 'val'), 6) AS item_id_val, round(avg(rank) FILTER (split = 'val'), 6) AS rank_val FROM r""")
def a26(spark, sf_dir):
    return split.tie_audit(split.temporal_split(X.ratings_a(spark, sf_dir))).withColumns({c: F.round(c, 6) for c in ("item_id_train", "rank_train", "item_id_val", "rank_val")})


@query("a27_unreachable", X.with_("ra", more=SPLIT) + "SELECT split, count(*) AS positives, count(*) FILTER (item_id NOT IN (SELECT item_id FROM split WHERE split = 'train')) AS unreachable, round(count(*) FILTER (item_id NOT IN (SELECT item_id FROM split WHERE split = 'train')) * 100.0 / count(*), 6) AS percent FROM split WHERE split IN ('val', 'test') AND rating >= 4 GROUP BY 1")
def a27(spark, sf_dir):
    return split.unreachable(split.temporal_split(X.ratings_a(spark, sf_dir))).withColumn("percent", F.round("percent", 6))


@query("it1_k_core", X.with_("ra", more=core_sql(20)) + f"SELECT user_id, item_id, rating, ts FROM {CORE}")
def it1(spark, sf_dir):
    return kcore.k_core(X.ratings_a(spark, sf_dir), 20, 20)[0].select("user_id", "item_id", "rating", "ts")


@query("it2_sampled_core", X.with_("ra", more=f"s AS (SELECT * FROM ra WHERE {HASHED} % 4 < 2), {core_sql(12, 8, 's')}") + "SELECT user_id, item_id FROM c7")
def it2(spark, sf_dir):
    return kcore.k_core(kcore.hash_sample(X.ratings_a(spark, sf_dir), 2, 4), 12, 12)[0].select("user_id", "item_id")


@query("it3_companions", X.with_("ra", "items", more=f"{core_sql(20)}, {TAGS}") + f"SELECT 'items' AS part, count(*) AS n FROM items WHERE item_id IN (SELECT item_id FROM {CORE}) UNION ALL SELECT 'tags', count(*) FROM tags WHERE item_id IN (SELECT item_id FROM {CORE}) AND user_id IN (SELECT user_id FROM {CORE}) UNION ALL SELECT 'links', count(*) FROM items WHERE item_id IN (SELECT item_id FROM {CORE})")
def it3(spark, sf_dir):
    core = kcore.k_core(X.ratings_a(spark, sf_dir), 20, 20)[0]
    out = None
    for name, df in zip(("items", "tags", "links"), kcore.companions(core, X.items(spark, sf_dir), tags(spark, sf_dir), links(spark, sf_dir)), strict=True):
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("w1_sequence", X.with_("ra", more=SEQ) + "SELECT user_id, item_id, seq, n FROM seq")
def w1(spark, sf_dir):
    return split.sequenced(X.ratings_a(spark, sf_dir)).select("user_id", "item_id", "seq", "n")


@query("w3_temporal_split", X.with_("ra", more=SPLIT) + "SELECT user_id, item_id, split FROM split")
def w3(spark, sf_dir):
    return split.temporal_split(X.ratings_a(spark, sf_dir)).select("user_id", "item_id", "split")


@query("w4_first_last", f"{RB} SELECT user_id, min_by(item_id, ts) AS first_item, max_by(item_id, ts) AS last_item FROM rb GROUP BY 1")
def w4(spark, sf_dir):
    return X.ratings_b(spark, sf_dir).groupBy("user_id").agg(F.min_by("item_id", "ts").alias("first_item"), F.max_by("item_id", "ts").alias("last_item"))


@query("w5_normalized_rank", f"{RB} SELECT user_id, item_id, round(CASE WHEN count(*) OVER (PARTITION BY user_id) = 1 THEN 0.5 ELSE (row_number() OVER (PARTITION BY user_id ORDER BY item_id) - 1) / (count(*) OVER (PARTITION BY user_id) - 1) END, 6) AS rank FROM rb")
def w5(spark, sf_dir):
    from pyspark.sql.window import Window

    by = Window.partitionBy("user_id")
    n = F.count("*").over(by)
    rank = F.when(n == 1, F.lit(0.5)).otherwise((F.row_number().over(by.orderBy("item_id")) - 1) / F.nullif(n - 1, F.lit(0)))
    return X.ratings_b(spark, sf_dir).select("user_id", "item_id", F.round(rank, 6).alias("rank"))


@query("w9_dense_index", "SELECT p_partkey AS item_id, row_number() OVER (ORDER BY p_partkey) - 1 AS idx FROM part")
def w9(spark, sf_dir):
    return dense_index(X.items(spark, sf_dir), "item_id")


@query("w10_centered_rating", f"{RB} SELECT user_id, item_id, round(rating - avg(rating) OVER (PARTITION BY user_id), 6) AS centered FROM rb")
def w10(spark, sf_dir):
    from pyspark.sql.window import Window

    return X.ratings_b(spark, sf_dir).select("user_id", "item_id", F.round(F.col("rating") - F.avg("rating").over(Window.partitionBy("user_id")), 6).alias("centered"))


@query("set1_cold_users", f"{RA} SELECT DISTINCT user_id, {HASHED} % 20 = 0 AS cold FROM ra")
def set1(spark, sf_dir):
    rated = X.ratings_a(spark, sf_dir)
    cold = split.cold_users(rated)
    main = rated.select("user_id").subtract(cold)
    return cold.select("user_id", F.lit(True).alias("cold")).unionByName(main.select("user_id", F.lit(False).alias("cold")))


@query("set2_intersection", f"{RA}, rb AS ({X.CTE['rb'][7:-1]}) SELECT item_id FROM ra INTERSECT SELECT item_id FROM rb")
def set2(spark, sf_dir):
    return X.ratings_a(spark, sf_dir).select("item_id").intersect(X.ratings_b(spark, sf_dir).select("item_id"))


@query("set3_union", f"{RA}, rb AS ({X.CTE['rb'][7:-1]}) SELECT item_id FROM ra UNION SELECT item_id FROM rb")
def set3(spark, sf_dir):
    return X.ratings_a(spark, sf_dir).select("item_id").union(X.ratings_b(spark, sf_dir).select("item_id")).distinct()


@query("set4_concat", X.with_("ra", more=SPLIT) + "SELECT user_id, item_id, 'train' AS source FROM split WHERE split = 'train' UNION ALL SELECT user_id, item_id, 'val' FROM split WHERE split = 'val'")
def set4(spark, sf_dir):
    own = split.temporal_split(X.ratings_a(spark, sf_dir))
    parts = [own.where(F.col("split") == s).select("user_id", "item_id", F.lit(s).alias("source")) for s in ("train", "val")]
    return parts[0].unionByName(parts[1])


TITLES = ["Harbour Lights (1983)", "Two Quiet Rivers (1995) ", "Colony (2140) (2011)", "Untitled", "Lost Reel (Undated)", "1812: The Long March (1974)", "Lantern, The (1991)", "Étoiles, Les (2003)", "Salt Road (a.k.a. The White Path) (1968)", "Zoé (2001)", "Winter Garden, A", "  spaced  "]


def titles(spark):
    return spark.createDataFrame([(n, t) for n, t in enumerate(TITLES)], "n int, raw string")


TITLE_ROWS = "titles AS (SELECT unnest(range(%d)) AS n, unnest([%s]) AS raw)" % (len(TITLES), ", ".join(f"'{t}'" for t in TITLES))


@query("sc1_title_year", f"WITH {TITLE_ROWS} SELECT CAST(n AS INT) AS n, CASE WHEN regexp_matches(raw, '^(.*?)\\s*\\(\\d{{4}}\\)\\s*$') THEN trim(regexp_extract(raw, '^(.*?)\\s*\\((\\d{{4}})\\)\\s*$', 1)) ELSE trim(raw) END AS title, TRY_CAST(regexp_extract(raw, '\\((\\d{{4}})\\)\\s*$', 1) AS INT) AS year FROM titles")
def sc1(spark, sf_dir):
    return titles(spark).select("n", T.clean_title(F.col("raw")).alias("title"), T.title_year(F.col("raw")).alias("year"))


@query("sc2_genre_split", "WITH g AS (SELECT p_partkey AS item_id, CASE WHEN p_size % 5 = 0 THEN '(no genres listed)' ELSE ' ' || replace(p_name, ' ', ' | ') || '|' END AS raw FROM part) SELECT item_id, CASE WHEN raw = '(no genres listed)' THEN [] ELSE list_filter(list_transform(string_split(raw, '|'), lambda x: trim(x)), lambda x: x <> '') END AS genres FROM g")
def sc2(spark, sf_dir):
    part = X.table(spark, sf_dir, "part")
    raw = F.when(F.col("p_size") % 5 == 0, T.NO_GENRES).otherwise(F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit(" | ")), F.lit("|")))
    return part.select(F.col("p_partkey").alias("item_id"), T.genre_list(raw).alias("genres"))


@query("sc3_parse_failures", f"WITH {TITLE_ROWS} SELECT count(*) FILTER (NOT regexp_matches(raw, '\\(\\d{{4}}\\)\\s*$')) AS failures, count(*) AS n FROM titles")
def sc3(spark, sf_dir):
    return titles(spark).agg(F.count_if(T.title_year(F.col("raw")).isNull()).alias("failures"), F.count("*").alias("n"))


@query("sc4_display_title", f"WITH {TITLE_ROWS} SELECT CAST(n AS INT) AS n, trim(regexp_replace(regexp_replace(trim(regexp_replace(trim(raw), '\\s*\\(a\\.k\\.a\\..+?\\)', '', 'i')), '^(.+),\\s+({'|'.join(a.replace(chr(39), chr(39) * 2) for a in T.ARTICLES)})\\s*(\\(\\d{{4}}\\))?\\s*$', '\\2 \\1', 'i'), '\\s*\\(\\d{{4}}\\)\\s*$', '')) AS title FROM titles")
def sc4(spark, sf_dir):
    return titles(spark).select("n", T.display_title(F.col("raw")).alias("title"))


MADE = "CASE WHEN p_size % 4 = 0 THEN p_name || ', The' ELSE p_name END || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' (' || (p_size + 1950) || ')' END"


@query("sc4_item_titles", f"WITH t AS (SELECT p_partkey AS item_id, {MADE} AS raw FROM part) SELECT item_id, TRY_CAST(nullif(regexp_extract(raw, '\\((\\d{{4}})\\)$', 1), '') AS INT) AS year, CASE WHEN contains(raw, ', The') THEN 'The ' ELSE '' END || regexp_replace(replace(raw, ', The', ''), ' \\(\\d{{4}}\\)$', '') AS title FROM t")
def sc4_items(spark, sf_dir):
    """The title functions over the names of all parts, some with a year or an article."""
    raw = F.expr(MADE)
    return X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), T.title_year(raw).alias("year"), T.display_title(raw).alias("title"))


@query("sc5_search_fold", f"WITH {TITLE_ROWS} SELECT CAST(n AS INT) AS n, contains(strip_accents(lower(raw)), 'zoe') AS zoe, contains(strip_accents(lower(raw)), 'etoiles') AS etoiles FROM titles")
def sc5(spark, sf_dir):
    folded = T.fold(F.col("raw"))
    return titles(spark).select("n", *(F.contains(folded, F.collate(F.lit(w), "UNICODE_CI_AI")).alias(w) for w in ("zoe", "etoiles")))


@query("sc3_title_failures", f"WITH t AS (SELECT p_partkey AS item_id, {MADE} AS raw FROM part), bad AS (SELECT *, row_number() OVER (ORDER BY item_id) AS nth FROM t WHERE NOT regexp_matches(raw, '\\(\\d{{4}}\\)\\s*$')) SELECT (SELECT count(*) FROM t) AS n, (SELECT count(*) FROM bad) AS failures, string_agg(raw, '; ' ORDER BY nth) AS first FROM bad WHERE nth <= 15")
def sc3_titles(spark, sf_dir):
    """How many titles of the catalogue have no year, and the first fifteen of them."""
    rows = X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.expr(MADE).alias("raw"))
    bad = rows.where(T.title_year(F.col("raw")).isNull())
    first = bad.orderBy("item_id").limit(15).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "raw"))), lambda x: x["raw"]), "; ").alias("first"))
    counts = rows.agg(F.count("*").alias("n"), F.count_if(T.title_year(F.col("raw")).isNull()).alias("failures"))
    return counts.join(F.broadcast(first), F.lit(True))  # one row each


@query("sc5_folded_titles", "SELECT p_partkey AS item_id, strip_accents(lower('Été ' || replace(replace(p_name, 'a', 'Á'), 'o', 'ö'))) AS folded FROM part")
def sc5_titles(spark, sf_dir):
    """The stored search text of every title, here with accents put in."""
    return X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), T.folded(F.concat(F.lit("Été "), F.replace(F.replace("p_name", F.lit("a"), F.lit("Á")), F.lit("o"), F.lit("ö")))).alias("folded"))


@query("sc6_clean_tag", "SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^\\pL\\pM\\p{Nd}\\p{Pc}\\s-]', '', 'g'))) AS cleaned FROM documents")
def sc6(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_tag(F.col("text")).cast("binary")).alias("cleaned"))


@query("sc7_tokens", "SELECT doc_id, len(t) AS n, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\pL\\pM\\p{Nd}\\p{Pc}][\\pL\\pM\\p{Nd}\\p{Pc}-]*[\\pL\\pM\\p{Nd}\\p{Pc}]') AS t FROM documents)")
def sc7(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").withColumn("t", T.tokens(F.col("text"))).select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query("sc8_pair_hash", f"{RA} SELECT user_id, item_id, tie FROM {tied('ra')}")
def sc8(spark, sf_dir):
    return with_pair_hash(X.ratings_a(spark, sf_dir).select("user_id", "item_id"), "user_id", "item_id")


@query("sc9_tie_hash", "SELECT p_partkey AS item_id, (p_partkey * 2654435761) & 4294967295 AS tie FROM part")
def sc9(spark, sf_dir):
    return X.items(spark, sf_dir).select("item_id", tie_hash(F.col("item_id")).alias("tie"))


@query("sc16_json_arrays", "SELECT p_partkey AS item_id, '[\"' || replace(p_name, ' ', '\",\"') || '\"]' AS body, string_split(p_name, ' ')[1] AS first FROM part")
def sc16(spark, sf_dir):
    own = X.items(spark, sf_dir).select("item_id", F.to_json("genres").alias("body"))
    return own.select("item_id", "body", F.from_json("body", "array<string>")[0].alias("first"))


@query("sc17_image_url", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN NULL ELSE 'https://image.tmdb.org/t/p/w500/p' || page_id || '.jpg' END AS url FROM pages")
def sc17(spark, sf_dir):
    number = F.col("page_id").cast("string")
    path = F.when(F.col("page_id") % 8 == 0, "  ").when(F.col("page_id") % 4 == 0, F.lit(None)).when(F.col("page_id") % 2 == 0, F.concat(F.lit("//p"), number, F.lit(".jpg "))).otherwise(F.concat(F.lit("p"), number, F.lit(".jpg")))
    return X.table(spark, sf_dir, "pages").select("page_id", T.image_url(path, F.lit("/w500/")).alias("url"))


@query("sc18_payload", "SELECT o_custkey AS id, array_to_string(list(CAST(o_orderkey AS VARCHAR) ORDER BY o_totalprice, o_orderkey)[1:8], ' ') AS \"cast\", coalesce(array_to_string(list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderkey) FILTER (o_orderpriority = '1-URGENT'), ' '), '') AS directors FROM orders GROUP BY 1")
def sc18(spark, sf_dir):
    """Orders stand in for cast and crew: billing by price, directors by priority."""
    person = F.struct(F.col("o_orderkey").cast("string").alias("name"), F.col("o_totalprice").alias("order"), F.when(F.col("o_orderpriority") == "1-URGENT", "Director").otherwise("Crew").alias("job"), F.col("o_orderkey").alias("id"))
    own = X.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(person), lambda a, b: F.when(a["id"] < b["id"], -1).otherwise(1)).alias("people"))
    return own.select("id", F.array_join(F.transform(T.top_cast(F.col("people")), lambda c: c["name"]), " ").alias("cast"), F.array_join(T.directors(F.col("people")), " ").alias("directors"))


@query("sc19_feature_names", "SELECT unnest(['genre', 'genome_tag', 'release_era', 'tag']) AS kind, unnest(['Drama', 'dark', 'year_norm', 'slow']) AS name")
def sc19(spark, sf_dir):
    raw = spark.createDataFrame([("genre:Drama",), ("genome:dark",), ("year_norm",), ("tag:slow",)], "raw string")
    return raw.select(T.feature_type(F.col("raw")).alias("kind"), T.feature_name(F.col("raw")).alias("name"))


FEATURES = "f AS (SELECT 'genre:' || unnest(string_split(p_name, ' ')) AS raw FROM part UNION ALL SELECT 'tag:' || p_type FROM part UNION ALL SELECT 'genome:' || event_type FROM events UNION ALL SELECT CASE WHEN p_size % 17 <> 0 THEN 'year_norm' ELSE 'year_missing' END FROM part)"


@query("sc19_feature_labels", f"WITH {FEATURES} SELECT CASE WHEN raw LIKE 'genre:%' THEN 'genre' WHEN raw LIKE 'year%' THEN 'release_era' WHEN raw LIKE 'genome:%' THEN 'genome_tag' ELSE 'tag' END AS kind, regexp_replace(raw, '^(genre|genome|tag):', '') AS name, count(*) AS n FROM f GROUP BY 1, 2")
def sc19_labels(spark, sf_dir):
    """Kind and shown name of every feature of the catalogue, and how often it occurs."""
    part, events = X.table(spark, sf_dir, "part"), X.table(spark, sf_dir, "events")
    raw = part.select(F.explode(F.transform(F.split("p_name", " "), lambda g: F.concat(F.lit("genre:"), g))).alias("raw"))
    raw = raw.union(part.select(F.concat(F.lit("tag:"), "p_type"))).union(events.select(F.concat(F.lit("genome:"), "event_type"))).union(part.select(F.when(F.col("p_size") % 17 != 0, "year_norm").otherwise("year_missing")))
    return raw.groupBy(T.feature_type(F.col("raw")).alias("kind"), T.feature_name(F.col("raw")).alias("name")).agg(F.count("*").alias("n"))


@query("sc26_iso_times", f"{RA} SELECT strftime(to_timestamp(min(ts)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S+00:00') AS first, strftime(to_timestamp(max(ts)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S+00:00') AS last FROM ra")
def sc26(spark, sf_dir):
    return X.ratings_a(spark, sf_dir).agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(T.iso_seconds(F.col("a")).alias("first"), T.iso_seconds(F.col("b")).alias("last"))
