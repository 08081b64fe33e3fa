"""Popularity, collaborative, content and hybrid queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.ranking import exact_percentile, numbered, tie_hash, top_k
from ..functions.vectors import cosine, dot
from ..operators import content, hybrid, itemcf, popularity, similar, stats
from ..sources import files
from ..sources import fixtures as X
from .registry import query

HASH = "((item_id * 2654435761) & 4294967295)"
LIKED = "liked AS (SELECT DISTINCT user_id, item_id FROM rb WHERE rating >= 4)"
PAIRS = "pairs AS (SELECT a.item_id AS i, b.item_id AS j, count(*) AS n_ij FROM liked a JOIN liked b ON a.user_id = b.user_id AND a.item_id < b.item_id GROUP BY 1, 2)"
COUNTS = "counts AS (SELECT item_id, count(*) AS n_i FROM liked GROUP BY 1)"


def sims(a: float = 0.5, shrink: float = 0.0, k: int = 20) -> str:
    return (
        f"both_ AS (SELECT i, j, n_ij FROM pairs UNION ALL SELECT j, i, n_ij FROM pairs), "
        f"sims AS (SELECT i, j, n_ij / (pow(p.n_i, CAST({a} AS DOUBLE)) * pow(q.n_i, CAST({1 - a} AS DOUBLE))) * (n_ij / (n_ij + CAST({shrink} AS DOUBLE))) AS sim, n_ij FROM both_ JOIN counts p ON p.item_id = i JOIN counts q ON q.item_id = j), "
        f"near AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(sim, 9) DESC, j) AS rank FROM sims QUALIFY rank <= {k})"
    )


CF = X.with_("rb", more=f"{LIKED}, {PAIRS}, {COUNTS}, {sims()}")
PICKS = "picks AS (SELECT user_id, item_id FROM rb WHERE rating >= 4 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) <= 5)"


def picks(spark, sf_dir, n: int = 5):
    own = stats.positives(X.ratings_b(spark, sf_dir))
    return top_k(own, ["user_id"], [F.col("ts").asc(), F.col("item_id").asc()], n).select("user_id", "item_id")


def near(spark, sf_dir, k: int = 20):
    return itemcf.neighbors(X.ratings_b(spark, sf_dir), k=k)


@query("m1_most_liked", X.with_("ra") + f"SELECT item_id, score, row_number() OVER (ORDER BY score DESC, {HASH}) AS rank FROM (SELECT item_id, CAST(count(*) FILTER (rating >= 4) AS DOUBLE) AS score FROM ra GROUP BY 1) ORDER BY rank LIMIT 10")
def m1(spark, sf_dir):
    best = popularity.popularity(X.ratings_a(spark, sf_dir)).orderBy(F.desc("score"), tie_hash(F.col("item_id"))).limit(10)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), tie_hash(F.col("item_id")))).cast("long"))


@query("m1_most_rated", X.with_("ra", "items") + "SELECT item_id, CAST(coalesce(n, 0) AS DOUBLE) AS score FROM items LEFT JOIN (SELECT item_id, count(*) AS n FROM ra GROUP BY 1) USING (item_id)")
def m1_rated(spark, sf_dir):
    return popularity.popularity(X.ratings_a(spark, sf_dir), X.items(spark, sf_dir), "most_rated")


@query("sc24_damped_mean", X.with_("rb", "items") + "SELECT item_id, round((coalesce(v, 0) * coalesce(r, c) + 10 * c) / (coalesce(v, 0) + 10), 6) AS score FROM items LEFT JOIN (SELECT item_id, count(*) AS v, avg(rating) AS r FROM rb GROUP BY 1) USING (item_id), (SELECT avg(rating) AS c FROM rb)")
def sc24(spark, sf_dir):
    return popularity.popularity(X.ratings_b(spark, sf_dir), X.items(spark, sf_dir), "damped_mean", 10.0).withColumn("score", F.round("score", 6))


@query("j5_cooccurrence", X.with_("rb", more=f"{LIKED}, {PAIRS}") + "SELECT i, j, n_ij FROM pairs")
def j5(spark, sf_dir):
    return itemcf.cooccurrence(X.ratings_b(spark, sf_dir))


@query("j5_cooccurrence_sparse", X.with_("ra", more=f"{LIKED.replace('rb', 'ra')}, {PAIRS}") + "SELECT i, j, n_ij FROM pairs")
def j5_sparse(spark, sf_dir):
    return itemcf.cooccurrence(X.ratings_a(spark, sf_dir))


@query("m2_item_counts", X.with_("rb", more=f"{LIKED}, {COUNTS}") + "SELECT item_id, n_i FROM counts")
def m2(spark, sf_dir):
    return itemcf.item_counts(X.ratings_b(spark, sf_dir))


@query("m3_shrunk_similarity", X.with_("rb", more=f"{LIKED}, {PAIRS}, {COUNTS}, {sims(0.3, 10.0)}") + "SELECT i, j, round(sim, 6) AS sim, n_ij FROM sims")
def m3(spark, sf_dir):
    return itemcf.similarities(X.ratings_b(spark, sf_dir), 0.3, 10.0).withColumn("sim", F.round("sim", 6))


@query("k3_neighbors", f"{CF} SELECT i, j, round(sim, 6) AS sim, n_ij, rank FROM near")
def k3(spark, sf_dir):
    return near(spark, sf_dir).withColumn("sim", F.round("sim", 6))


@query("k3_neighbors_wide", X.with_("ra", more=f"{LIKED.replace('rb', 'ra')}, {PAIRS}, {COUNTS}, {sims(k=200)}") + "SELECT i, j, round(sim, 6) AS sim, n_ij, rank FROM near")
def k3_wide(spark, sf_dir):
    """The two hundred most similar items of each, of the wide and sparse ratings."""
    return itemcf.neighbors(X.ratings_a(spark, sf_dir)).withColumn("sim", F.round("sim", 6))


@query("j11_remapped_neighbors", f"{CF} SELECT i, j, round(sim, 6) AS sim, row_number() OVER (PARTITION BY i ORDER BY round(sim, 9) DESC, j) AS rank FROM near WHERE i % 3 <> 0 AND j % 3 <> 0")
def j11(spark, sf_dir):
    served = X.items(spark, sf_dir).select("item_id").unionByName(spark.range(1).select(F.lit(0).cast("long").alias("item_id"))).where("item_id % 3 <> 0")
    return itemcf.remapped(near(spark, sf_dir), served).select("i", "j", F.round("sim", 6).alias("sim"), "rank")


@query("snk5_serving_neighbors", f"{CF} SELECT i, string_agg(CAST(j AS VARCHAR), ' ' ORDER BY rank) AS js FROM near WHERE i % 3 <> 0 AND j % 3 <> 0 GROUP BY 1")
def snk5(spark, sf_dir):
    served = X.items(spark, sf_dir).select("item_id").where("item_id % 3 <> 0")
    rows = itemcf.remapped(near(spark, sf_dir), served).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("rank", "j"))).alias("n"))
    return files.bucketed(rows.select("i", F.array_join(F.transform("n", lambda x: x["j"].cast("string")), " ").alias("js")), "neighbors", "i")


@query("m4_warm_scores", f"{CF} SELECT user_id, j AS item_id, round(sum(sim), 6) AS score FROM liked JOIN near ON i = item_id GROUP BY 1, 2")
def m4(spark, sf_dir):
    return itemcf.warm_scores(X.ratings_b(spark, sf_dir), near(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("m5_cold_scores", f"{CF}, {PICKS} SELECT user_id, j AS item_id, round(sum(sim) / any_value(k), 6) AS score FROM picks JOIN near ON i = item_id JOIN (SELECT user_id, count(*) AS k FROM picks GROUP BY 1) USING (user_id) GROUP BY 1, 2")
def m5(spark, sf_dir):
    return itemcf.cold_scores(picks(spark, sf_dir), near(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("m6_best_pick", f"{CF}, {PICKS} SELECT user_id, j AS item_id, i AS pick, round(sim, 6) AS sim, n_ij FROM picks JOIN near ON i = item_id WHERE sim > 0 QUALIFY row_number() OVER (PARTITION BY user_id, j ORDER BY round(sim, 9) DESC, i) = 1")
def m6(spark, sf_dir):
    return itemcf.best_pick(picks(spark, sf_dir), near(spark, sf_dir)).withColumn("sim", F.round("sim", 6))


@query("m17_support_threshold", f"{CF} SELECT quantile_cont(n_ij, 0.9) AS threshold FROM near")
def m17(spark, sf_dir):
    return near(spark, sf_dir).agg(F.percentile("n_ij", 0.9).alias("threshold"))


YEAR = "ends AS (SELECT min(year) AS lo, max(year) AS hi FROM items), years AS (SELECT item_id, coalesce((year - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 0) AS year_norm, CASE WHEN year IS NULL THEN 1 ELSE 0 END AS year_missing FROM items, ends)"
TIER1 = f"{YEAR}, genre AS (SELECT DISTINCT item_id, 'genre:' || unnest(genres) AS feature FROM items), t1 AS (SELECT item_id, feature, CAST(1 AS DOUBLE) AS value FROM genre UNION ALL SELECT item_id, 'year_norm', year_norm FROM years WHERE year_norm <> 0 UNION ALL SELECT item_id, 'year_missing', 1 FROM years WHERE year_missing = 1)"
UNIT = "unit AS (SELECT item_id, feature, value / sqrt(sum(value * value) OVER (PARTITION BY item_id)) AS value FROM t1)"
WORD = r"[\pL\pM\p{Nd}\p{Pc}][\pL\pM\p{Nd}\p{Pc}-]*[\pL\pM\p{Nd}\p{Pc}]"
TFIDF = f"words AS (SELECT p_partkey AS item_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS feature FROM part JOIN documents ON doc_id = p_partkey), tf AS (SELECT item_id, feature, count(*) AS tf FROM words GROUP BY 1, 2), df AS (SELECT feature, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM part), raw AS (SELECT item_id, feature, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS value FROM tf JOIN df USING (feature), n WHERE df >= 2 AND df <= 0.7 * n), tfidf AS (SELECT item_id, feature, value / sqrt(sum(value * value) OVER (PARTITION BY item_id)) AS value FROM raw)"


@query("sc10_year_features", X.with_("items", more=YEAR) + "SELECT item_id, round(year_norm, 6) AS year_norm, CAST(year_missing AS INT) AS year_missing FROM years")
def sc10(spark, sf_dir):
    return content.year_features(X.items(spark, sf_dir)).withColumn("year_norm", F.round("year_norm", 6))


@query("sc11_multi_hot", X.with_("items", more=TIER1) + "SELECT item_id, feature FROM genre")
def sc11(spark, sf_dir):
    return content.genre_features(X.items(spark, sf_dir)).select("item_id", "feature")


@query("sc12_genre_idf", X.with_("items", more=TIER1) + "SELECT feature, round(ln((SELECT count(*) FROM items) / (count(*) + 1)) + 1, 6) AS idf FROM genre GROUP BY 1")
def sc12(spark, sf_dir):
    return content.genre_idf(X.items(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


@query("sc13_tf_idf", f"WITH {TFIDF} SELECT item_id, count(*) AS n, round(sum(value), 5) AS total, round(max(value), 6) AS most FROM tfidf GROUP BY 1")
def sc13(spark, sf_dir):
    own = content.tf_idf(X.item_docs(spark, sf_dir), X.items(spark, sf_dir))
    return own.groupBy("item_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 5).alias("total"), F.round(F.max("value"), 6).alias("most"))


@query("sc14_l2_normalize", X.with_("items", more=f"{TIER1}, {UNIT}") + "SELECT item_id, feature, round(value, 6) AS value FROM unit")
def sc14(spark, sf_dir):
    from ..functions.vectors import normalized

    return normalized(content.tier_1(X.items(spark, sf_dir)), "item_id").withColumn("value", F.round("value", 6))


BLOCKS = f"{TIER1}, {UNIT}, dense AS (SELECT item_id, CAST(unnest(range(len(embedding))) AS VARCHAR) AS feature, CAST(unnest(embedding) AS DOUBLE) AS value FROM vectors), dunit AS (SELECT item_id, feature, value / sqrt(sum(value * value) OVER (PARTITION BY item_id)) AS value FROM dense), allb AS (SELECT item_id, 't1:' || feature AS feature, value * 0.5 AS value FROM unit UNION ALL SELECT item_id, 'd:' || feature, value * 1.5 FROM dunit), vec AS (SELECT item_id, feature, value / sqrt(sum(value * value) OVER (PARTITION BY item_id)) AS value FROM allb)"


def item_blocks(spark, sf_dir):
    dense = X.item_vectors(spark, sf_dir).select("item_id", F.posexplode("embedding").alias("pos", "v")).select("item_id", F.col("pos").cast("string").alias("feature"), F.col("v").cast("double").alias("value"))
    return content.blocks((content.tier_1(X.items(spark, sf_dir)), 0.5, "t1:"), (dense, 1.5, "d:"))


@query("sc15_weighted_blocks", X.with_("items", "vectors", more=BLOCKS) + "SELECT item_id, feature, round(value, 6) AS value FROM vec")
def sc15(spark, sf_dir):
    return item_blocks(spark, sf_dir).withColumn("value", F.round("value", 6))


@query("m7_item_vectors", X.with_("items", more=f"{TIER1}, {UNIT}") + "SELECT item_id, count(*) AS n_features, round(sum(value), 6) AS total FROM unit GROUP BY 1")
def m7(spark, sf_dir):
    from ..functions.vectors import normalized

    return normalized(content.tier_1(X.items(spark, sf_dir)), "item_id").groupBy("item_id").agg(F.count("*").alias("n_features"), F.round(F.sum("value"), 6).alias("total"))


def _profile_sql(variant: str) -> str:
    rows = "SELECT * FROM rb WHERE rating >= 4" if variant.startswith("pos") else "SELECT * FROM rb"
    weight = {"pos_mean": "1", "centered": "rating - avg(rating) OVER (PARTITION BY user_id)"}.get(variant, "rating")
    return f"w AS (SELECT user_id, item_id, {weight} AS w FROM ({rows})), p AS (SELECT user_id, feature, sum(w * value) AS value FROM w JOIN unit USING (item_id) GROUP BY 1, 2), prof AS (SELECT user_id, feature, CASE WHEN sqrt(sum(value * value) OVER (PARTITION BY user_id)) > 0 THEN value / sqrt(sum(value * value) OVER (PARTITION BY user_id)) ELSE 0 END AS value FROM p)"


def _unit(spark, sf_dir):
    from ..functions.vectors import normalized

    return normalized(content.tier_1(X.items(spark, sf_dir)), "item_id")


for _variant in content.PROFILES:

    def _profile(spark, sf_dir, variant=_variant):
        return content.profiles(X.ratings_b(spark, sf_dir), _unit(spark, sf_dir), variant).withColumn("value", F.round("value", 6))

    query(f"m8_profile_{_variant}", X.with_("rb", "items", more=f"{TIER1}, {UNIT}, {_profile_sql(_variant)}") + "SELECT user_id, feature, round(value, 6) AS value FROM prof")(_profile)

PROFILE = X.with_("rb", "items", more=f"{TIER1}, {UNIT}, {_profile_sql('pos_mean')}")


def profile(spark, sf_dir):
    return content.profiles(X.ratings_b(spark, sf_dir), _unit(spark, sf_dir))


@query("j7_profile_product", X.with_("rb", "items", more=f"{TIER1}, {UNIT}") + "SELECT user_id, feature, round(sum(rating * value), 6) AS value FROM rb JOIN unit USING (item_id) GROUP BY 1, 2")
def j7(spark, sf_dir):
    rows = X.ratings_b(spark, sf_dir).join(_unit(spark, sf_dir), "item_id")
    return rows.groupBy("user_id", "feature").agg(F.round(F.sum(F.col("rating") * F.col("value")), 6).alias("value"))


@query("m9_content_scores", f"{PROFILE} SELECT user_id, item_id, round(sum(prof.value * unit.value), 6) AS score FROM prof JOIN unit USING (feature) GROUP BY 1, 2")
def m9(spark, sf_dir):
    return content.scores(profile(spark, sf_dir), _unit(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("k13_top_features", f"{PROFILE}, few AS (SELECT * FROM unit WHERE item_id = 42) SELECT user_id, feature, row_number() OVER (PARTITION BY user_id ORDER BY round(prof.value * few.value, 9) DESC, feature) AS rank FROM prof JOIN few USING (feature) WHERE prof.value * few.value > 1e-7 QUALIFY rank <= 3")
def k13(spark, sf_dir):
    return content.explained(profile(spark, sf_dir), _unit(spark, sf_dir).where("item_id = 42")).select("user_id", "feature", "rank")


@query("m14_similar_items", X.with_("vectors") + "SELECT b.item_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) / sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS similarity FROM vectors a, vectors b WHERE a.item_id = 42 AND b.item_id <> 42")
def m14(spark, sf_dir):
    own = X.item_vectors(spark, sf_dir)
    one = own.where("item_id = 42").select(F.col("embedding").alias("x"))
    rows = own.where("item_id <> 42").join(F.broadcast(one), F.lit(True))  # one vector
    return rows.select("item_id", F.round(cosine(F.col("x"), F.col("embedding")), 6).alias("similarity"))


@query("m14_similar_all", X.with_("items", more=f"{TIER1}, {UNIT}, sums AS (SELECT a.item_id AS q, b.item_id, sum(a.value * b.value) AS s FROM unit a JOIN unit b USING (feature) WHERE a.item_id <> b.item_id GROUP BY 1, 2), known AS (SELECT DISTINCT item_id FROM unit)") + f"SELECT q, item_id, row_number() OVER (PARTITION BY q ORDER BY round(coalesce(s, 0), 9) DESC, {HASH}, item_id) AS rank, round(coalesce(s, 0), 6) AS similarity FROM (SELECT p.item_id AS q, r.item_id FROM known p, known r WHERE p.item_id <> r.item_id) LEFT JOIN sums USING (q, item_id) QUALIFY rank <= 80")
def m14_all(spark, sf_dir):
    """The eighty closest items of every item, by an inverted index with bounds."""
    unit = _unit(spark, sf_dir)
    out = similar.similar_items(unit.select(F.col("item_id").alias("q")).distinct(), unit, 80)
    return out.withColumn("similarity", F.round("similarity", 6))


@query("q6_similar_top", X.with_("items", more=f"{TIER1}, {UNIT}") + "SELECT b.item_id, round(sum(a.value * b.value), 6) AS similarity FROM unit a JOIN unit b USING (feature) WHERE a.item_id = 42 AND b.item_id <> 42 GROUP BY 1 ORDER BY round(sum(a.value * b.value), 9) DESC, b.item_id LIMIT 20")
def q6(spark, sf_dir):
    return content.similar_items(_unit(spark, sf_dir), 42, 20).withColumn("similarity", F.round("similarity", 6))


@query("m16_similarity_threshold", X.with_("vectors", more="v AS (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n FROM vectors)") + "SELECT round(quantile_cont(round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9), 0.95), 5) AS threshold FROM v a JOIN v b ON b.i = (a.i * 48271 + 11) % a.n")
def m16(spark, sf_dir):
    """Each vector is paired with a pseudo-random other one."""
    own = numbered(X.item_vectors(spark, sf_dir), [F.col("item_id").asc()], "i")
    size = own.agg(F.count("*").alias("n"))
    left = own.join(F.broadcast(size), F.lit(True)).select(F.col("embedding").alias("x"), ((F.col("i") * 48271 + 11) % F.col("n")).alias("i"))  # the size is one row
    pairs = left.join(own.select("i", "embedding"), "i").select(F.round(dot(F.col("x"), F.col("embedding")), 9).alias("dot"))
    return exact_percentile(pairs, "dot", 0.95).withColumn("threshold", F.round("threshold", 5))


# every user of a batch with every candidate: what a request is answered from
POOL_ROWS = "users AS (SELECT DISTINCT user_id FROM picks), cand AS (SELECT DISTINCT item_id FROM rb), pool AS (SELECT user_id, item_id FROM (SELECT * FROM users, cand) ANTI JOIN picks USING (user_id, item_id))"
POOL_PARTS = "cf AS (SELECT user_id, j AS item_id, sum(sim) / any_value(k) AS cf FROM picks JOIN near ON i = item_id JOIN (SELECT user_id, count(*) AS k FROM picks GROUP BY 1) USING (user_id) GROUP BY 1, 2), pop AS (SELECT item_id, n_i AS popularity FROM counts), con AS (SELECT user_id, item_id, sum(q.value * unit.value) AS content FROM (SELECT user_id, feature, sum(value) AS value FROM picks JOIN unit USING (item_id) GROUP BY 1, 2) q JOIN unit USING (feature) GROUP BY 1, 2), parts AS (SELECT user_id, item_id, round(coalesce(content, 0), 9) AS content, round(coalesce(cf, 0), 9) AS cf, round(coalesce(popularity, 0), 9) AS popularity FROM pool LEFT JOIN con USING (user_id, item_id) LEFT JOIN cf USING (user_id, item_id) LEFT JOIN pop USING (item_id))"
POOL = f"{POOL_ROWS}, {POOL_PARTS}"


def _pct(column: str) -> str:
    return f"(rank() OVER (PARTITION BY user_id ORDER BY {column}) + (count(*) OVER (PARTITION BY user_id, {column}) - 1) / 2.0 - 1) / (count(*) OVER (PARTITION BY user_id) - 1)"


PCT = f"pcts AS (SELECT *, {_pct('content')} AS pct_content, {_pct('cf')} AS pct_cf, {_pct('popularity')} AS pct_popularity FROM parts)"
BATCH = X.with_("rb", "items", more=f"{LIKED}, {PAIRS}, {COUNTS}, {sims()}, {PICKS}, {TIER1}, {UNIT}, {POOL}, {PCT}")
BLEND = "blend AS (SELECT *, round(0.2 * pct_content + 0.7 * pct_cf + 0.1 * pct_popularity, 9) AS score FROM pcts), top AS (SELECT * FROM blend QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, " + HASH + ", item_id) <= 10)"
RANKED = f"{BATCH}, {BLEND}"


def stored_near(spark, sf_dir, k: int = 20):
    """Neighbours that a plan reads several times."""
    return files.stored(near(spark, sf_dir, k), "near")


def content_scores(chosen, vectors, by=()):
    """Scores of the summed vectors of picks against the same vectors."""
    summed = chosen.join(vectors, "item_id").groupBy(*by, "user_id", "feature").agg(F.sum("value").alias("value"))
    return content.scores(summed, vectors, by).withColumnRenamed("score", "content")


def components(rows, chosen, rated, vectors, found):
    """The rows of a pool with their three scores, 0 where there is none."""
    cf = itemcf.cold_scores(chosen, found).withColumnRenamed("score", "cf")
    pop = itemcf.item_counts(rated).select("item_id", F.col("n_i").cast("double").alias("popularity"))
    con = content_scores(chosen, vectors)
    return rows.join(con, ["user_id", "item_id"], "left").join(cf, ["user_id", "item_id"], "left").join(pop, "item_id", "left").fillna(0.0, ["content", "cf", "popularity"])


def served_unit(spark, sf_dir):
    """The vectors of the candidates, that is of items that have been rated."""
    return _unit(spark, sf_dir).join(X.ratings_b(spark, sf_dir).select("item_id").distinct(), "item_id", "left_semi")


def parts(spark, sf_dir, found=None):
    rated, chosen = X.ratings_b(spark, sf_dir), picks(spark, sf_dir)
    rows = hybrid.pool(chosen.select("user_id").distinct(), rated.select("item_id").distinct(), chosen)
    return components(rows, chosen, rated, served_unit(spark, sf_dir), near(spark, sf_dir) if found is None else found)


def blended(spark, sf_dir, found=None):
    return hybrid.blended(parts(spark, sf_dir, found), [0.2, 0.7, 0.1])


def listed(spark, sf_dir, k: int, found=None):
    """The first k of the blend for each user, without a pool."""
    rated, chosen = X.ratings_b(spark, sf_dir), files.stored(picks(spark, sf_dir), "picks")
    scores = {"content": content_scores(chosen, served_unit(spark, sf_dir)).withColumnRenamed("content", "score"), "cf": itemcf.cold_scores(chosen, near(spark, sf_dir) if found is None else found)}
    pop = rated.groupBy("item_id").agg(F.count_if(F.col("rating") >= stats.POSITIVE).cast("double").alias("popularity"))
    return hybrid.best_blends(scores, pop, chosen, {"content": 0.2, "cf": 0.7, "popularity": 0.1}, k)


@query("j9_user_item_pool", X.with_("rb", more=f"{PICKS}") + "SELECT user_id, item_id FROM (SELECT * FROM (SELECT DISTINCT user_id FROM picks), (SELECT DISTINCT item_id FROM rb)) ANTI JOIN picks USING (user_id, item_id)")
def j9(spark, sf_dir):
    chosen = picks(spark, sf_dir)
    return hybrid.pool(chosen.select("user_id").distinct(), X.ratings_b(spark, sf_dir).select("item_id").distinct(), chosen)


@query("w6_percentile_rank", f"{BATCH} SELECT user_id, item_id, round(pct_content, 6) AS pct_content, round(pct_cf, 6) AS pct_cf, round(pct_popularity, 6) AS pct_popularity FROM pcts")
def w6(spark, sf_dir):
    return blended(spark, sf_dir).select("user_id", "item_id", *(F.round(c, 6).alias(c) for c in ("pct_content", "pct_cf", "pct_popularity")))


@query("w6_sparse_percentile", f"{BATCH} SELECT user_id, item_id, round(pct_cf, 6) AS pct FROM pcts WHERE cf > 0")
def w6_sparse(spark, sf_dir):
    """The same percentiles without the items of score 0."""
    rated, chosen = X.ratings_b(spark, sf_dir), picks(spark, sf_dir)
    n = rated.agg(F.countDistinct("item_id").alias("items"))
    known = chosen.join(rated.select("item_id").distinct(), "item_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("k"))
    sizes = known.join(F.broadcast(n), F.lit(True)).select("user_id", (F.col("items") - F.col("k")).alias("n"))
    scores = itemcf.cold_scores(chosen, near(spark, sf_dir)).withColumn("score", F.round("score", 9)).join(chosen, ["user_id", "item_id"], "left_anti")
    return hybrid.sparse_percentiles(scores, sizes).withColumn("pct", F.round("pct", 6))


@query("m11_hybrid_v1", f"{BATCH} SELECT user_id, item_id, round(0.3 * pct_content + 0.7 * pct_popularity, 6) AS score FROM pcts")
def m11(spark, sf_dir):
    return hybrid.blended(parts(spark, sf_dir), [0.3, 0.7], ("content", "popularity")).select("user_id", "item_id", F.round("score", 6).alias("score"))


@query("m12_hybrid_v2", f"{RANKED} SELECT user_id, item_id, round(score, 6) AS score FROM blend")
def m12(spark, sf_dir):
    return blended(spark, sf_dir).select("user_id", "item_id", F.round("score", 6).alias("score"))


@query("m13_serving_top", f"{RANKED} SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, {HASH}, item_id) AS rank, round(score, 6) AS score FROM blend QUALIFY rank <= 10")
def m13(spark, sf_dir):
    return listed(spark, sf_dir, 10).select("user_id", "item_id", "rank", F.round("score", 6).alias("score"))


@query("sc21_match_percent", f"{RANKED}, f AS (SELECT *, {_pct('score')} AS pct FROM blend) SELECT user_id, item_id, CAST(greatest(0, least(100, round_even(round(pct * 100, 6), 0))) AS BIGINT) AS match_percent FROM f")
def sc21(spark, sf_dir):
    return blended(spark, sf_dir).select("user_id", "item_id", hybrid.match_percent(F.round(F.col("pct") * 100, 6) / 100).alias("match_percent"))


@query("sc22_component_shares", f"{RANKED} SELECT user_id, item_id, round(0.2 * pct_content / (0.2 * pct_content + 0.7 * pct_cf + 0.1 * pct_popularity), 6) AS share_content, round(0.7 * pct_cf / (0.2 * pct_content + 0.7 * pct_cf + 0.1 * pct_popularity), 6) AS share_cf FROM top WHERE score > 0")
def sc22(spark, sf_dir):
    top = listed(spark, sf_dir, 10).where("score > 0")
    own = top.select("user_id", "item_id", (0.2 * F.col("pct_content")).alias("content"), (0.7 * F.col("pct_cf")).alias("cf"), (0.1 * F.col("pct_popularity")).alias("popularity"))
    return hybrid.component_shares(own).select("user_id", "item_id", F.round("share_content", 6).alias("share_content"), F.round("share_cf", 6).alias("share_cf"))


@query("w13_nearest_pick", f"{RANKED} SELECT user_id, item_id, arg_max(pick, (round(s, 9), -pick)) AS pick, round(arg_max(s, (round(s, 9), -pick)), 6) AS similarity FROM (SELECT top.user_id, top.item_id, picks.item_id AS pick, sum(a.value * b.value) AS s FROM top JOIN picks USING (user_id) JOIN unit a ON a.item_id = picks.item_id JOIN unit b ON b.item_id = top.item_id AND a.feature = b.feature GROUP BY 1, 2, 3) GROUP BY 1, 2")
def w13(spark, sf_dir):
    out = content.nearest_pick(listed(spark, sf_dir, 10), picks(spark, sf_dir), _unit(spark, sf_dir))
    return out.withColumn("similarity", F.round("similarity", 6))


@query("m10_content_explanation", f"{RANKED}, {_profile_sql('pos_mean')}, c AS (SELECT top.user_id, top.item_id, unit.feature, prof.value * unit.value AS contribution FROM top JOIN unit USING (item_id) JOIN prof ON prof.user_id = top.user_id AND prof.feature = unit.feature), t AS (SELECT *, sum(contribution) OVER (PARTITION BY user_id, item_id) AS total FROM c) SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id, item_id ORDER BY round(contribution, 9) DESC, feature) AS rank, feature, round(contribution, 6) AS contribution, round(contribution / total * 100, 4) AS percent FROM t WHERE contribution > 1e-7 QUALIFY rank <= 3")
def m10(spark, sf_dir):
    """Why each user is shown each of their ten items."""
    out = content.explained(profile(spark, sf_dir), _unit(spark, sf_dir), shown=listed(spark, sf_dir, 10))
    return out.withColumns({"contribution": F.round("contribution", 6), "percent": F.round("percent", 4)})


WEIGHTED = "SELECT user_id, count(*) AS k FROM picks GROUP BY 1"


@query("sc20_bucket_weights", X.with_("rb", more="k AS (SELECT user_id, count(*) AS k FROM rb WHERE rating >= 4 GROUP BY 1)") + "SELECT user_id, k, CAST(CASE WHEN k <= 14 THEN 0.0 ELSE 0.1 END AS DOUBLE) AS w_content, CAST(CASE WHEN k <= 14 THEN 1.0 ELSE 0.9 END AS DOUBLE) AS w_cf, CAST(0 AS DOUBLE) AS w_popularity, CAST(CASE WHEN k <= 4 THEN 0.3 WHEN k <= 7 THEN 0.6 WHEN k <= 14 THEN 0.7 ELSE 0.8 END AS DOUBLE) AS alpha FROM k")
def sc20(spark, sf_dir):
    own = stats.positives(X.ratings_b(spark, sf_dir)).groupBy("user_id").agg(F.count("*").alias("k"))
    w = hybrid.weights(F.col("k"))
    return own.select("user_id", "k", w[0].alias("w_content"), w[1].alias("w_cf"), w[2].alias("w_popularity"), hybrid.by_picks(F.col("k"), hybrid.ALPHAS).alias("alpha"))


# what is close and what is well supported, measured on the items and their neighbours
LIMITS = "nums AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT item_id FROM ev)), prs AS (SELECT a.item_id AS x, b.item_id AS y FROM nums a JOIN nums b ON b.i = (a.i * 48271 + 11) % a.n), cosines AS (SELECT round(coalesce(s, 0), 9) AS c FROM prs LEFT JOIN (SELECT x, sum(p.value * q.value) AS s FROM prs JOIN ev p ON p.item_id = x JOIN ev q ON q.item_id = y AND q.feature = p.feature GROUP BY x) USING (x)), limits AS (SELECT round((SELECT quantile_cont(c, 0.95) FROM cosines), 6) AS close_from, (SELECT quantile_cont(n_ij, 0.9) FROM near) AS support)"
TAGGED = f"{TFIDF}, evb AS (SELECT item_id, feature, value FROM unit UNION ALL SELECT item_id, 'tag:' || feature, value FROM tfidf), ev AS (SELECT item_id, feature, value / sqrt(sum(value * value) OVER (PARTITION BY item_id)) AS value FROM evb)"
REASONS = f"{RANKED}, {TAGGED}, {LIMITS}, best AS (SELECT user_id, j AS item_id, i AS pick, n_ij FROM picks JOIN near ON i = item_id WHERE sim > 0 QUALIFY row_number() OVER (PARTITION BY user_id, j ORDER BY round(sim, 9) DESC, i) = 1), close AS (SELECT user_id, item_id, arg_max(pick, (round(s, 9), -pick)) AS near_pick, arg_max(s, (round(s, 9), -pick)) AS cos FROM (SELECT top.user_id, top.item_id, picks.item_id AS pick, sum(a.value * b.value) AS s FROM top JOIN picks USING (user_id) JOIN ev a ON a.item_id = picks.item_id JOIN ev b ON b.item_id = top.item_id AND a.feature = b.feature GROUP BY 1, 2, 3) GROUP BY 1, 2), sums AS (SELECT user_id, feature, sum(value) AS value FROM picks JOIN ev USING (item_id) GROUP BY 1, 2), why AS (SELECT top.user_id, top.item_id, ev.feature, row_number() OVER (PARTITION BY top.user_id, top.item_id ORDER BY round(sums.value * ev.value, 9) DESC, ev.feature) AS rank FROM top JOIN ev USING (item_id) JOIN sums ON sums.user_id = top.user_id AND sums.feature = ev.feature WHERE sums.value * ev.value > 1e-7 QUALIFY rank <= 3), shared AS (SELECT user_id, item_id, string_agg(substr(feature, 7), ', ' ORDER BY rank) FILTER (feature LIKE 'genre:%') AS genres, string_agg(substr(feature, 5), ', ' ORDER BY rank) FILTER (feature LIKE 'tag:%') AS tags FROM why GROUP BY 1, 2), e AS (SELECT top.*, pick, n_ij, near_pick, cos, shared.genres, shared.tags, 0.2 * pct_content AS c, 0.7 * pct_cf AS f, 0.1 * pct_popularity AS p, close_from, support FROM top CROSS JOIN limits LEFT JOIN best USING (user_id, item_id) LEFT JOIN close USING (user_id, item_id) LEFT JOIN shared USING (user_id, item_id))"


def evidence(spark, sf_dir):
    """What speaks for each of the ten items of a user, with the limits that tell what counts: the closest pick, the shared genres and
    tags among the three features that add most, and the pick whose viewers liked it too."""
    found, chosen = stored_near(spark, sf_dir), picks(spark, sf_dir)
    top = files.stored(listed(spark, sf_dir, 10, found), "top")
    shown = top.select("user_id", "item_id")
    wanted = shown.select("item_id").union(chosen.select("item_id")).distinct()
    tags = content.tf_idf(X.item_docs(spark, sf_dir), X.items(spark, sf_dir))
    every = files.stored(content.blocks((content.tier_1(X.items(spark, sf_dir)), 1.0, ""), (tags, 1.0, "tag:")), "content-vectors")
    vectors = files.stored(every.join(wanted, "item_id", "left_semi"), "evidence-vectors")
    close_from = content.similarity_threshold(every).select(F.round("threshold", 6).alias("close_from"))
    limits = close_from.join(F.broadcast(found.agg(F.percentile("n_ij", 0.9).alias("support"))), F.lit(True))  # one row each
    summed = chosen.join(vectors, "item_id").groupBy("user_id", "feature").agg(F.sum("value").alias("value"))
    why = content.explained(summed, vectors, 3, shown)
    named = lambda kind: F.transform(F.filter(F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda x: x["feature"].startswith(kind)), lambda x: T.feature_name(x["feature"]))
    shared = why.groupBy("user_id", "item_id").agg(named("genre:").alias("shared_genres"), named("tag:").alias("shared_tags"))
    close = content.nearest_pick(shown, chosen, vectors).select("user_id", "item_id", F.col("similarity").alias("pick_cos"), F.concat(F.lit("item "), "pick").alias("pick_title"))
    best = itemcf.best_pick(chosen, found).select("user_id", "item_id", F.concat(F.lit("item "), "pick").alias("cf_title"), "n_ij")
    rows = top.join(best, ["user_id", "item_id"], "left").join(close, ["user_id", "item_id"], "left").join(shared, ["user_id", "item_id"], "left").join(F.broadcast(limits), F.lit(True))
    weights = dict(zip(("content", "cf", "popularity"), (0.2, 0.7, 0.1), strict=True))
    return rows.withColumns({f"w_{p}": F.lit(w) for p, w in weights.items()} | {p: w * F.col(f"pct_{p}") for p, w in weights.items()})


@query("m15_reason_codes", f"{REASONS} SELECT user_id, item_id, concat_ws(' ', CASE WHEN cos >= close_from THEN 'SIMILAR_TO_PICK' END, CASE WHEN genres IS NOT NULL THEN 'SHARED_GENRES' END, CASE WHEN tags IS NOT NULL THEN 'SHARED_TAGS' END, CASE WHEN p >= greatest(c, f) THEN 'POPULAR_WITH_VIEWERS' END, CASE WHEN coalesce(n_ij, 0) >= support THEN 'CO_LIKED_BY_USERS' END) AS codes FROM e")
def m15(spark, sf_dir):
    return hybrid.reasons(evidence(spark, sf_dir), F.col("close_from"), F.col("support")).select("user_id", "item_id", F.array_join("codes", " ").alias("codes"))


@query("sc27_label_map", f"{REASONS} SELECT user_id, item_id, concat_ws('; ', CASE WHEN cos >= close_from THEN 'Similar to item ' || near_pick END, 'Shared genres: ' || genres, 'Shared tags: ' || tags, CASE WHEN p >= greatest(c, f) THEN 'Popular with viewers' END, CASE WHEN coalesce(n_ij, 0) >= support THEN format('{{:,}}', n_ij) || ' viewers who liked item ' || pick || ' also liked this' END) AS labels FROM e")
def sc27(spark, sf_dir):
    """The texts of all reasons, in the order of their codes."""
    return hybrid.reasons(evidence(spark, sf_dir), F.col("close_from"), F.col("support")).select("user_id", "item_id", F.array_join(F.map_values("labels"), "; ").alias("labels"))


@query("a28_personalization_report", f"{RANKED} SELECT round(avg(0.2 * pct_content / score), 5) AS content, round(avg(0.7 * pct_cf / score), 5) AS cf, round(avg(0.1 * pct_popularity / score), 5) AS popularity, count(DISTINCT item_id) AS n_items FROM top WHERE score > 0")
def a28(spark, sf_dir):
    top = listed(spark, sf_dir, 10).where("score > 0")
    return top.agg(*(F.round(F.avg(w * F.col(f"pct_{p}") / F.col("score")), 5).alias(p) for w, p in ((0.2, "content"), (0.7, "cf"), (0.1, "popularity"))), F.countDistinct("item_id").alias("n_items"))


DOMINANT = f"favourite AS (SELECT user_id, genre FROM (SELECT user_id, genre, count(*) AS n FROM picks JOIN (SELECT item_id, unnest(genres) AS genre FROM items) USING (item_id) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, genre) = 1), best20 AS (SELECT user_id, item_id FROM blend QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, {HASH}, item_id) <= 20), popular20 AS (SELECT item_id, genres FROM counts JOIN items USING (item_id) ORDER BY n_i DESC, {HASH}, item_id LIMIT 20)"


@query("a28_dominant_genre", f"{RANKED}, {DOMINANT}, shares AS (SELECT user_id, genre, avg(CASE WHEN list_contains(genres, genre) THEN 1.0 ELSE 0.0 END) AS shown_share FROM best20 JOIN items USING (item_id) JOIN favourite USING (user_id) GROUP BY 1, 2), both_shares AS (SELECT *, (SELECT avg(CASE WHEN list_contains(genres, s.genre) THEN 1.0 ELSE 0.0 END) FROM popular20) AS row_share FROM shares s) SELECT user_id, genre, round(shown_share, 6) AS shown_share, round(row_share, 6) AS row_share, round(shown_share - row_share, 6) AS lift FROM both_shares")
def a28_genre(spark, sf_dir):
    """How much more of each user's favourite genre the twenty shown items hold than the twenty
    most popular ones."""
    own, chosen = X.items(spark, sf_dir), picks(spark, sf_dir)
    liked = stats.positives(X.ratings_b(spark, sf_dir)).groupBy("item_id").agg(F.count("*").alias("n_i")).join(own.select("item_id"), "item_id")
    row = liked.orderBy(F.desc("n_i"), tie_hash(F.col("item_id")), "item_id").limit(20)
    out = hybrid.genre_report(listed(spark, sf_dir, 20), chosen, own, row)
    return out.withColumns({c: F.round(c, 6) for c in ("shown_share", "row_share", "lift")})


TARGET, POOL, CLOSE = 20, 100, 80  # places of a row, and how far its candidates go
BECAUSE = f"shown AS (SELECT page_id AS item_id FROM pages WHERE url IS NOT NULL), sv AS (SELECT * FROM unit WHERE item_id IN (SELECT item_id FROM rb)), recent AS (SELECT user_id, item_id AS q, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id) AS nth FROM rb JOIN picks USING (user_id, item_id) SEMI JOIN sv USING (item_id) QUALIFY nth <= 2), sums AS (SELECT a.item_id AS q, b.item_id, sum(a.value * b.value) AS s FROM sv a JOIN sv b USING (feature) WHERE a.item_id <> b.item_id GROUP BY 1, 2), known AS (SELECT DISTINCT item_id FROM sv), sim AS (SELECT q, item_id, row_number() OVER (PARTITION BY q ORDER BY round(coalesce(s, 0), 9) DESC, {HASH}, item_id) AS close FROM (SELECT p.item_id AS q, r.item_id FROM known p, known r WHERE p.item_id <> r.item_id) LEFT JOIN sums USING (q, item_id) QUALIFY close <= {CLOSE}), because AS (SELECT user_id, nth, item_id, row_number() OVER (PARTITION BY user_id, nth ORDER BY close) AS place FROM recent JOIN sim USING (q) SEMI JOIN shown USING (item_id) ANTI JOIN picks USING (user_id, item_id) QUALIFY place <= {TARGET})"
Q8 = f"{RANKED}, {BECAUSE}, wide AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, {HASH}, item_id) AS r FROM blend QUALIFY r <= {POOL}), pos AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY r) AS place FROM wide SEMI JOIN shown USING (item_id) QUALIFY place <= {TARGET}), enough AS (SELECT user_id FROM picks GROUP BY 1 HAVING count(*) >= 3)"


@query("q8_personalized_home", f"{Q8} SELECT user_id, 'picked' AS row_name, place, item_id FROM pos WHERE user_id IN (SELECT user_id FROM enough) UNION ALL SELECT user_id, 'because_' || nth, place, item_id FROM because WHERE user_id IN (SELECT user_id FROM enough)")
def q8(spark, sf_dir):
    """Users with three picks or more get a picked row, from the hundred best, and a row because
    of each of their two most recent picks, from the eighty items closest to it by content. Only
    items with a picture are shown, nothing that was picked."""
    chosen, found = files.stored(picks(spark, sf_dir), "picks"), stored_near(spark, sf_dir)
    pages = X.table(spark, sf_dir, "pages").where("url IS NOT NULL").select(F.col("page_id").alias("item_id")).distinct()
    enough = chosen.groupBy("user_id").agg(F.count("*").alias("k")).where("k >= 3").select("user_id")
    wide = listed(spark, sf_dir, POOL, found).join(pages, "item_id", "left_semi").withColumnRenamed("rank", "r")
    picked = top_k(wide, ["user_id"], [F.col("r").asc()], TARGET, "place").select("user_id", F.lit("picked").alias("row_name"), "place", "item_id")
    served = files.stored(served_unit(spark, sf_dir), "served")
    dated = chosen.join(X.ratings_b(spark, sf_dir).select("user_id", "item_id", "ts"), ["user_id", "item_id"]).join(served.select("item_id").distinct(), "item_id", "left_semi")
    recent = top_k(dated, ["user_id"], [F.desc("ts"), F.col("item_id").asc()], 2, "nth").select("user_id", F.col("item_id").alias("q"), "nth")
    close = similar.similar_items(recent.select("q").distinct(), served, CLOSE)
    rows = similar.because(recent, close, chosen, pages, TARGET)
    rows = rows.select("user_id", F.concat(F.lit("because_"), F.col("nth").cast("string")).alias("row_name"), "place", "item_id")
    return picked.unionByName(rows).join(enough, "user_id", "left_semi")


@query("snk4_serving_vectors", X.with_("rb", "items", more=f"{TIER1}, {UNIT}, pop AS (SELECT item_id, count(*) FILTER (rating >= 4) AS popularity FROM rb GROUP BY 1)") + "SELECT item_id, title, coalesce(any_value(popularity), 0) AS popularity, count(feature) AS n, round(coalesce(sqrt(sum(value * value)), 1.0), 6) AS norm, string_agg(feature, ' ' ORDER BY feature) AS features FROM items LEFT JOIN unit USING (item_id) LEFT JOIN pop USING (item_id) WHERE item_id % 10 <> 0 GROUP BY 1, 2")
def snk4(spark, sf_dir):
    """The served items' features, norms, popularity and names, written as tables of the same
    buckets; what is read back joins without a shuffle."""
    served = X.items(spark, sf_dir).where("item_id % 10 <> 0").select("item_id", "title")
    liked = stats.positives(X.ratings_b(spark, sf_dir)).groupBy("item_id").agg(F.count("*").alias("popularity"))
    vectors, names = content.serving_tables(served, _unit(spark, sf_dir), liked)
    own = vectors.groupBy("item_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("feature")), " ").alias("features"))
    both = names.join(own, "item_id", "left")
    return both.select("item_id", "title", "popularity", F.coalesce("n", F.lit(0)).alias("n"), F.round("norm", 6).alias("norm"), "features")


@query("j8_all_pairs_dot", X.with_("rb", "vectors", more="dims AS (SELECT item_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS d FROM vectors), means AS (SELECT user_id, d, avg(v) AS v FROM rb JOIN dims USING (item_id) WHERE rating >= 4 GROUP BY 1, 2), prof AS (SELECT user_id, list(v ORDER BY d) AS profile FROM means GROUP BY 1)") + "SELECT user_id, item_id, round(list_dot_product(profile, CAST(embedding AS DOUBLE[])), 5) AS score FROM prof, vectors")
def j8(spark, sf_dir):
    """The profile of each user, the mean of the dense vectors of what they like, against
    the vectors of all candidates."""
    vectors = X.item_vectors(spark, sf_dir)
    liked = stats.positives(X.ratings_b(spark, sf_dir)).join(vectors, "item_id").select("user_id", F.posexplode("embedding").alias("d", "v"))
    means = liked.groupBy("user_id", "d").agg(F.avg(F.col("v").cast("double")).alias("v"))
    profiles = means.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda x: x["v"]).alias("profile"))
    return content.all_pairs(profiles, vectors).withColumn("score", F.round("score", 5))
