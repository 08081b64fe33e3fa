"""Evaluation, cold-start and tuning queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranking import percentile_rank, tie_hash, top_k
from ..functions.vectors import normalized
from ..operators import content, hybrid, itemcf, popularity, split, stats, tuning
from ..operators import evaluation as E
from ..operators import protocol as P
from ..sources import files
from ..sources import fixtures as X
from . import models
from .preparing import tied
from .registry import query

K = 10
HASH = "((item_id * 2654435761) & 4294967295)"
SPLIT = f"seq AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, tie, item_id) - 1 AS seq, count(*) OVER (PARTITION BY user_id) AS n FROM {tied('rb')}), split AS (SELECT *, CASE WHEN seq >= n - h THEN 'test' WHEN seq >= n - 2 * h THEN 'val' ELSE 'train' END AS split FROM (SELECT *, CAST(greatest(1, round_even(CAST(0.1 AS DOUBLE) * n, 0)) AS BIGINT) AS h FROM seq)), train AS (SELECT * FROM split WHERE split = 'train'), val AS (SELECT * FROM split WHERE split = 'val')"
RELEVANT = "rel AS (SELECT DISTINCT user_id, item_id FROM val WHERE rating >= 4 AND item_id IN (SELECT item_id FROM train))"
POP = "pop AS (SELECT item_id, count(*) FILTER (rating >= 4) AS score FROM train GROUP BY 1)"
CF = "liked AS (SELECT DISTINCT user_id, item_id FROM train WHERE rating >= 4), " + f"{models.PAIRS}, {models.COUNTS}, {models.sims()}"


def lists_sql(name: str, scores: str) -> str:
    return f"{name} AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, {HASH}, item_id) AS rank FROM ({scores}) ANTI JOIN train USING (user_id, item_id) QUALIFY rank <= {K})"


def metrics_sql(name: str, lists: str, rel: str = "rel") -> str:
    ideal = "list_sum(list_transform(range(1, least(nr, %d) + 1), lambda r: 1 / log2(r + 1)))" % K
    return f"{name} AS (SELECT user_id, coalesce(h, 0) / {K} AS precision, coalesce(h, 0) / nr AS recall, coalesce(dcg, 0) / {ideal} AS ndcg, CAST(CASE WHEN h > 0 THEN 1 ELSE 0 END AS DOUBLE) AS hit_rate, coalesce(1 / f, 0) AS mrr FROM (SELECT user_id, count(*) AS nr FROM {rel} GROUP BY 1) LEFT JOIN (SELECT user_id, count(*) AS h, sum(1 / log2(rank + 1)) AS dcg, min(rank) AS f FROM {lists} SEMI JOIN {rel} USING (user_id, item_id) GROUP BY 1) USING (user_id))"


POP_LISTS = lists_sql("lists", "SELECT user_id, item_id, score FROM (SELECT DISTINCT user_id FROM rel), pop")
CF_LISTS = lists_sql("cf_lists", "SELECT user_id, j AS item_id, sum(sim) AS score FROM liked JOIN near ON i = item_id GROUP BY 1, 2")
BASE = X.with_("rb", more=f"{SPLIT}, {RELEVANT}, {POP}, {POP_LISTS}, {metrics_sql('m', 'lists')}")
BOTH = f"{BASE}, {CF}, {CF_LISTS}, {metrics_sql('mc', 'cf_lists')}"
ROUNDED = ", ".join(f"round({x}, 6) AS {x}" for x in E.METRICS)
MEANS = ", ".join(f"round(avg({x}), 6) AS {x}" for x in E.METRICS)


def parts(spark, sf_dir):
    own = split.temporal_split(X.ratings_b(spark, sf_dir))
    return own.where("split = 'train'"), own.where("split = 'val'")


def relevant(spark, sf_dir):
    return E.relevant(*parts(spark, sf_dir))


def pop_lists(spark, sf_dir, k: int = K):
    train, val = parts(spark, sf_dir)
    users = E.relevant(train, val).select("user_id").distinct()
    return E.first_unseen(users, train, popularity.popularity(train).withColumn("config", F.lit(0)), k).drop("config")


def cf_lists(spark, sf_dir):
    train, _ = parts(spark, sf_dir)
    return E.recommended(itemcf.warm_scores(train, itemcf.neighbors(train, k=20)), train, K)


def pop_metrics(spark, sf_dir):
    return E.user_metrics(pop_lists(spark, sf_dir), relevant(spark, sf_dir), K)


def cf_metrics(spark, sf_dir):
    return E.user_metrics(cf_lists(spark, sf_dir), relevant(spark, sf_dir), K)


def rounded(df, names=E.METRICS, digits: int = 6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("j6_user_item_scores", f"{BOTH} SELECT user_id, j AS item_id, round(sum(sim), 6) AS score FROM liked JOIN near ON i = item_id GROUP BY 1, 2")
def j6(spark, sf_dir):
    train, _ = parts(spark, sf_dir)
    return rounded(itemcf.warm_scores(train, itemcf.neighbors(train, k=20)), ("score",))


@query("j10_seen_anti_join", f"{BOTH} SELECT user_id, item_id, rank FROM cf_lists")
def j10(spark, sf_dir):
    return cf_lists(spark, sf_dir)


@query("k1_exact_top_k", f"{BASE} SELECT user_id, item_id, rank FROM lists")
def k1(spark, sf_dir):
    return pop_lists(spark, sf_dir)


@query("k2_clamped_top_k", f"{BASE}, p AS (SELECT item_id, row_number() OVER (ORDER BY score DESC, {HASH}, item_id) AS rank FROM pop) SELECT item_id, rank FROM p")
def k2(spark, sf_dir):
    train, _ = parts(spark, sf_dir)
    from ..functions.ranking import numbered

    own = numbered(popularity.popularity(train), [F.desc("score"), tie_hash(F.col("item_id")).asc(), F.col("item_id").asc()], "rank")
    return own.select("item_id", (F.col("rank") + 1).alias("rank"))


@query("k11_head_items", X.with_("rb", more=SPLIT) + "SELECT item_id, count(*) AS n FROM train GROUP BY 1 ORDER BY n DESC, item_id LIMIT 20")
def k11(spark, sf_dir):
    return E.most_rated(parts(spark, sf_dir)[0], 20)


@query("k12_tie_ranks", f"SELECT p_partkey AS item_id, row_number() OVER (ORDER BY (p_partkey * 2654435761) & 4294967295, p_partkey) - 1 AS tie_rank FROM part")
def k12(spark, sf_dir):
    from ..functions.ranking import numbered

    own = X.items(spark, sf_dir).select("item_id")
    return numbered(own, [tie_hash(F.col("item_id")).asc(), F.col("item_id").asc()], "tie_rank")


@query("e1_hits", f"{BASE} SELECT user_id, item_id, rank, rel.item_id IS NOT NULL AS hit FROM lists LEFT JOIN rel USING (user_id, item_id)")
def e1(spark, sf_dir):
    wanted = relevant(spark, sf_dir).withColumn("hit", F.lit(True))
    return pop_lists(spark, sf_dir).join(wanted, ["user_id", "item_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


@query("e2_user_metrics", f"{BASE} SELECT user_id, {ROUNDED} FROM m")
def e2(spark, sf_dir):
    """Precision, recall, NDCG, hit rate and reciprocal rank of each user (E2 to E6)."""
    return rounded(pop_metrics(spark, sf_dir))


@query("e7_mean_popularity", f"{BASE} SELECT round(avg(n), 6) AS mean_popularity FROM lists JOIN (SELECT item_id, count(*) AS n FROM train GROUP BY 1) USING (item_id)")
def e7(spark, sf_dir):
    return rounded(E.mean_popularity(pop_lists(spark, sf_dir), parts(spark, sf_dir)[0]), ("mean_popularity",))


@query("e8_context", f"{BASE} SELECT (SELECT count(DISTINCT item_id) FROM train) AS candidates, (SELECT count(*) FROM rel) AS positives, (SELECT count(DISTINCT user_id) FROM rel) AS users")
def e8(spark, sf_dir):
    candidates = parts(spark, sf_dir)[0].agg(F.countDistinct("item_id").alias("candidates"))
    one = relevant(spark, sf_dir).agg(F.count("*").alias("positives"), F.countDistinct("user_id").alias("users"))
    return candidates.join(F.broadcast(one), F.lit(True))


@query("e9_evaluate", f"{BASE} SELECT count(*) AS n_users, {MEANS} FROM m")
def e9(spark, sf_dir):
    return rounded(E.means(pop_metrics(spark, sf_dir)))


@query("e9_evaluate_cf", f"{BOTH} SELECT count(*) AS n_users, {MEANS} FROM mc")
def e9_cf(spark, sf_dir):
    return rounded(E.means(cf_metrics(spark, sf_dir)))


_U = "((user_id * 2654435761 + b * 40503 + 42) % 4294967291 * 48271 % 2147483647) / 2147483647.0"
_TABLE = [0.367879441171, 0.735758882343, 0.919698602929, 0.981011843124, 0.996340153173, 0.999405815182]
_DRAW = " + ".join(f"CAST(({_U}) > {p} AS INT)" for p in _TABLE)


@query("e10_bootstrap", f"{BASE}, d AS (SELECT b, {_DRAW} AS w, ndcg AS v FROM m, (SELECT unnest(range(1, 1001)) AS b)), per AS (SELECT b, sum(w * v) / sum(w) AS x FROM d GROUP BY 1) SELECT (SELECT count(*) FROM m) AS n_users, round((SELECT avg(ndcg) FROM m), 6) AS mean, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high FROM per")
def e10(spark, sf_dir):
    return rounded(E.bootstrap(pop_metrics(spark, sf_dir), "ndcg"), ("mean", "low", "high"))


@query("e11_compare", f"{BOTH}, diffs AS (SELECT user_id, mc.ndcg AS x, m.ndcg AS y, mc.ndcg - m.ndcg AS d FROM m JOIN mc USING (user_id)), per AS (SELECT b, sum(w * d) / sum(w) AS x FROM (SELECT b, d, {_DRAW} AS w FROM diffs, (SELECT unnest(range(1, 1001)) AS b)) GROUP BY 1), ends AS (SELECT quantile_cont(x, 0.025) AS low, quantile_cont(x, 0.975) AS high FROM per) SELECT count(*) AS n_users, round(avg(x), 6) AS a, round(avg(y), 6) AS b, round(avg(d), 6) AS difference, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high, count(*) FILTER (d >= 1e-9) AS wins, count(*) FILTER (abs(d) < 1e-9) AS ties, count(*) FILTER (d <= -1e-9) AS losses, round(avg(d) / avg(y), 5) AS lift, any_value(low) > 0 OR any_value(high) < 0 AS distinguishable FROM diffs, ends")
def e11(spark, sf_dir):
    out = rounded(E.compared(cf_metrics(spark, sf_dir), pop_metrics(spark, sf_dir), "ndcg"), ("a", "b", "difference", "low", "high"))
    return out.withColumn("lift", F.round("lift", 5))


@query("e12_cold_partition", X.with_("ra", more="u AS (SELECT DISTINCT user_id FROM ra)") + "SELECT user_id, CASE WHEN row_number() OVER (ORDER BY (user_id * 2654435761) & 4294967295, user_id) <= count(*) OVER () // 2 THEN 'dev' ELSE 'final' END AS part FROM u")
def e12(spark, sf_dir):
    return split.cold_partition(X.ratings_a(spark, sf_dir).select("user_id").distinct())


ONBOARD = f"pos AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, {HASH}, item_id) AS s, count(*) OVER (PARTITION BY user_id) AS c FROM rb WHERE rating >= 4)"


@query("w7_onboarding_window", X.with_("rb", more=ONBOARD) + "SELECT user_id, item_id, CASE WHEN s <= 3 THEN 'pick' ELSE 'relevant' END AS role FROM pos WHERE c >= 23 AND s <= 23")
def w7(spark, sf_dir):
    return E.onboarding(X.ratings_b(spark, sf_dir), 3, 20)


@query("w8_onboarding_all", X.with_("rb", more=ONBOARD) + "SELECT user_id, item_id, CASE WHEN s <= 5 THEN 'pick' ELSE 'relevant' END AS role FROM pos WHERE c >= 10")
def w8(spark, sf_dir):
    return E.onboarding(X.ratings_b(spark, sf_dir), 5, 0)


COLD = X.with_("rb", more=f"{ONBOARD}, roles AS (SELECT user_id, item_id, CASE WHEN s <= 3 THEN 'pick' ELSE 'relevant' END AS role FROM pos WHERE c >= 23 AND s <= 23), train AS (SELECT user_id, item_id FROM roles WHERE role = 'pick'), rel AS (SELECT user_id, item_id FROM roles WHERE role = 'relevant'), pop AS (SELECT item_id, count(*) AS score FROM rb GROUP BY 1)")


def cold(spark, sf_dir, tail: bool = False):
    """Lists and relevant items of new users with three picks, by popularity."""
    rated = X.ratings_b(spark, sf_dir)
    roles = E.onboarding(rated, 3, 20)
    items = rated.select("item_id").distinct()
    if tail:
        head = E.most_rated(rated, 20)
        roles = roles.where("role = 'pick'").unionByName(E.long_tail(roles.where("role = 'relevant'"), head))
        items = E.long_tail(items, head)
    picks, wanted = (roles.where(F.col("role") == r).select("user_id", "item_id") for r in ("pick", "relevant"))
    scores = popularity.popularity(rated, variant="most_rated").join(items, "item_id", "left_semi").withColumn("config", F.lit(0))
    return E.first_unseen(wanted.select("user_id").distinct(), picks, scores, K).drop("config"), wanted


@query("e13_cold_popularity", f"{COLD}, {lists_sql('lists', 'SELECT user_id, item_id, score FROM (SELECT DISTINCT user_id FROM rel), pop')}, {metrics_sql('m', 'lists')} SELECT count(*) AS n_users, {MEANS} FROM m")
def e13(spark, sf_dir):
    lists, wanted = cold(spark, sf_dir)
    return rounded(E.means(E.user_metrics(lists, wanted, K)))


COLD_KS, COLD_HEAD = (3, 5, 10), 20
_BUCKET = "CASE WHEN d < 1 THEN '<1' WHEN d < 30 THEN '1-30' ELSE '>=30' END"


def cold_sql(model: str, scores: str, more: str = "", *tables: str) -> str:
    """The whole protocol over (k, user_id, item_id, score): every candidate of every cohort in one pool."""
    ideal = f"list_sum(list_transform(range(1, least(nr, {K}) + 1), lambda r: 1 / log2(r + 1)))"
    per = ", ".join(f"sum(w * {m}) / sum(w) AS {m}" for m in E.METRICS)
    rows = " UNION ALL ".join(f"SELECT k, variant, stratum, '{m}' AS metric, {m} AS v FROM st" for m in E.METRICS)
    ends = " UNION ALL ".join(f"SELECT k, variant, stratum, '{m}' AS metric, {m} AS x FROM per" for m in E.METRICS)
    return X.with_("rb", *tables, more=f"""{ONBOARD}, ks AS (SELECT unnest([{", ".join(map(str, COLD_KS))}]) AS k), head AS (SELECT item_id FROM rb GROUP BY 1 ORDER BY count(*) DESC, item_id LIMIT {COLD_HEAD}),
vs AS (SELECT unnest(['all', 'tail']) AS variant), asked AS (SELECT k, user_id, item_id FROM pos, ks WHERE c >= k + 20 AND s <= k),
rel AS (SELECT k, variant, user_id, item_id FROM pos, ks, vs WHERE c >= k + 20 AND s > k AND s <= k + 20 AND (variant = 'all' OR item_id NOT IN (SELECT item_id FROM head))),
cand AS (SELECT DISTINCT item_id FROM rb), {more + ", " if more else ""}own AS ({scores}),
pool AS (SELECT k, variant, user_id, item_id FROM (SELECT * FROM (SELECT DISTINCT k, variant, user_id FROM rel), cand) ANTI JOIN asked USING (k, user_id, item_id) WHERE variant = 'all' OR item_id NOT IN (SELECT item_id FROM head)),
lists AS (SELECT k, variant, user_id, item_id, row_number() OVER (PARTITION BY k, variant, user_id ORDER BY round(coalesce(score, 0), 9) DESC, {HASH}, item_id) AS rank FROM pool LEFT JOIN own USING (k, user_id, item_id) QUALIFY rank <= {K}),
m AS (SELECT k, variant, user_id, coalesce(h, 0) / {K} AS precision, coalesce(h, 0) / nr AS recall, coalesce(dcg, 0) / {ideal} AS ndcg, CAST(CASE WHEN h > 0 THEN 1 ELSE 0 END AS DOUBLE) AS hit_rate, coalesce(1 / f, 0) AS mrr FROM (SELECT k, variant, user_id, count(*) AS nr FROM rel GROUP BY ALL) LEFT JOIN (SELECT k, variant, user_id, count(*) AS h, sum(1 / log2(rank + 1)) AS dcg, min(rank) AS f FROM lists SEMI JOIN rel USING (k, variant, user_id, item_id) GROUP BY ALL) USING (k, variant, user_id)),
spans AS (SELECT user_id, (max(ts) - min(ts)) / 86400000000.0 AS d FROM rb GROUP BY 1), st AS (SELECT *, 'everyone' AS stratum FROM m UNION ALL SELECT m.*, {_BUCKET} FROM m JOIN spans USING (user_id)),
per AS (SELECT k, variant, stratum, b, {per} FROM (SELECT *, {_DRAW} AS w FROM st, (SELECT unnest(range(1, 1001)) AS b)) GROUP BY ALL),
cis AS (SELECT k, variant, stratum, metric, quantile_cont(x, 0.025) AS low, quantile_cont(x, 0.975) AS high FROM ({ends}) GROUP BY ALL),
means AS (SELECT k, variant, stratum, metric, count(*) AS n_users, avg(v) AS mean FROM ({rows}) GROUP BY ALL)""") + f"SELECT '{model}' AS model, k, variant, stratum, metric, n_users, CASE WHEN stratum = 'everyone' THEN (SELECT count(DISTINCT user_id) FROM rb) - n_users END AS n_excluded, round(mean, 6) AS mean, round(coalesce(low, mean), 6) AS low, round(coalesce(high, mean), 6) AS high FROM means JOIN cis USING (k, variant, stratum, metric)"


def cold_report(spark, sf_dir, model):
    rated = X.ratings_b(spark, sf_dir)
    spans = stats.spans(rated, 86400000000.0)
    strata = spans.select("user_id", F.when(F.col("span_days") < 1, "<1").when(F.col("span_days") < 30, "1-30").otherwise(">=30").alias("stratum"))
    return rounded(P.cold_evaluation(model, rated, P.cohorts(rated, COLD_KS, head=COLD_HEAD), strata, K), ("mean", "low", "high"))


@query("e13_cold_report_popularity", cold_sql("popularity_most_liked", "SELECT k, user_id, item_id, score FROM (SELECT DISTINCT k, user_id FROM asked), (SELECT item_id, count(*) AS score FROM rb WHERE rating >= 4 GROUP BY 1)"))
def e13_popularity(spark, sf_dir):
    return cold_report(spark, sf_dir, P.Popular())


@query("e13_cold_content", cold_sql("content", "SELECT k, user_id, unit.item_id, sum(p.value * unit.value) AS score FROM p JOIN unit USING (feature) GROUP BY ALL", f"{models.TIER1}, {models.UNIT}, p0 AS (SELECT k, user_id, feature, sum(value) AS value FROM asked JOIN unit USING (item_id) GROUP BY ALL), p AS (SELECT k, user_id, feature, value / sqrt(sum(value * value) OVER (PARTITION BY k, user_id)) AS value FROM p0)", "items"))
def e13_content(spark, sf_dir):
    """New users scored by the mean vector of their picks: three numbers of picks, all
    candidates and the tail, strata of history, all metrics with their intervals."""
    return cold_report(spark, sf_dir, P.ByContent(normalized(content.tier_1(X.items(spark, sf_dir)), "item_id")))


@query("e13_cold_item_cf", cold_sql("item_cf", "SELECT k, user_id, j AS item_id, sum(sim / k) AS score FROM asked JOIN near ON i = item_id WHERE sim > 0 GROUP BY ALL", f"liked AS (SELECT DISTINCT user_id, item_id FROM rb WHERE rating >= 4), {models.PAIRS}, {models.COUNTS}, {models.sims()}"))
def e13_item_cf(spark, sf_dir):
    return cold_report(spark, sf_dir, P.ByItems(20))


@query("e13_cold_scores", cold_sql("mean_price", "SELECT DISTINCT k, user_id, item_id, score FROM (SELECT DISTINCT k, user_id FROM asked) JOIN (SELECT user_id, item_id, rating * ln(1 + price) AS score FROM rb JOIN items USING (item_id)) USING (user_id)", "", "items"))
def e13_scores(spark, sf_dir):
    """Scores that another system has computed: here each user's ratings, weighted by price."""
    rows = X.ratings_b(spark, sf_dir).join(X.items(spark, sf_dir), "item_id").select("user_id", "item_id", (F.col("rating") * F.ln(1 + F.col("price"))).alias("score"))
    return cold_report(spark, sf_dir, P.Given(rows, "mean_price"))


@query("e15_cold_long_tail", f"{COLD}, head AS (SELECT item_id FROM rb GROUP BY 1 ORDER BY count(*) DESC, item_id LIMIT 20), tail AS (SELECT * FROM rel WHERE item_id NOT IN (SELECT item_id FROM head)), {lists_sql('lists', 'SELECT user_id, item_id, score FROM (SELECT DISTINCT user_id FROM tail), pop WHERE item_id NOT IN (SELECT item_id FROM head)')}, {metrics_sql('m', 'lists', 'tail')} SELECT count(*) AS n_users, {MEANS} FROM m")
def e15(spark, sf_dir):
    lists, wanted = cold(spark, sf_dir, tail=True)
    return rounded(E.means(E.user_metrics(lists, wanted, K)))


@query("e16_covered_by_vectors", f"{BASE} SELECT round(avg(CASE WHEN item_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0) THEN 1 ELSE 0 END), 6) AS covered FROM lists")
def e16(spark, sf_dir):
    mask = X.table(spark, sf_dir, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("item_id"), F.lit(1.0).alias("has"))
    return pop_lists(spark, sf_dir).join(mask, "item_id", "left").agg(F.round(F.avg(F.coalesce("has", F.lit(0.0))), 6).alias("covered"))


@query("a18_session_strata", f"{BASE}, s AS (SELECT user_id, (max(ts) - min(ts)) / 86400000000.0 AS d FROM train GROUP BY 1) SELECT CASE WHEN d < 1 THEN '<1' WHEN d < 30 THEN '1-30' ELSE '>=30' END AS bucket, count(*) AS n_users, {MEANS}, round(min(d), 6) AS min_span, round(max(d), 6) AS max_span FROM m JOIN s USING (user_id) GROUP BY 1")
def a18(spark, sf_dir):
    spans = stats.spans(parts(spark, sf_dir)[0], 86400000000.0).drop("n")
    return rounded(E.strata(pop_metrics(spark, sf_dir), spans), (*E.METRICS, "min_span", "max_span"))


@query("w11_history_buckets", X.with_("rb") + "SELECT user_id, CASE WHEN (max(ts) - min(ts)) / 86400000000.0 < 1 THEN '<1' WHEN (max(ts) - min(ts)) / 86400000000.0 < 30 THEN '1-30' ELSE '>=30' END AS bucket FROM rb GROUP BY 1")
def w11(spark, sf_dir):
    spans = stats.spans(X.ratings_b(spark, sf_dir), 86400000000.0)
    return spans.select("user_id", F.when(F.col("span_days") < 1, "<1").when(F.col("span_days") < 30, "1-30").otherwise(">=30").alias("bucket"))


@query("w12_activity_quartiles", f"{BASE}, c AS (SELECT user_id, count(*) AS n FROM train GROUP BY 1), q AS (SELECT quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS q2, quantile_cont(n, 0.75) AS q3 FROM c) SELECT CAST(CASE WHEN n <= q1 THEN 1 WHEN n <= q2 THEN 2 WHEN n <= q3 THEN 3 ELSE 4 END AS INT) AS quartile, count(*) AS n_users, {MEANS}, min(n) AS min_n, max(n) AS max_n FROM m JOIN c USING (user_id), q GROUP BY 1")
def w12(spark, sf_dir):
    counts = parts(spark, sf_dir)[0].groupBy("user_id").agg(F.count("*").alias("n"))
    return rounded(E.activity(pop_metrics(spark, sf_dir), counts))


@query("w2_user_sizes", X.with_("rb") + "SELECT user_id, item_id, count(*) OVER (PARTITION BY user_id) AS n FROM rb")
def w2(spark, sf_dir):
    return X.ratings_b(spark, sf_dir).select("user_id", "item_id", F.count("*").over(Window.partitionBy("user_id")).alias("n"))


@query("w14_monotone_schedule", "SELECT unnest([3, 5, 10, 20]) AS k, unnest([CAST(0.3 AS DOUBLE), 0.6, 0.6, 0.8]) AS alpha")
def w14(spark, sf_dir):
    return hybrid.monotone(spark.createDataFrame([(3, 0.3), (5, 0.6), (10, 0.5), (20, 0.8)], "k int, alpha double"))


@query("a17_weighted_sum", X.with_("rb") + "SELECT item_id, round(sum(rating * (user_id % 7)), 6) AS s FROM rb GROUP BY 1")
def a17(spark, sf_dir):
    return X.ratings_b(spark, sf_dir).groupBy("item_id").agg(F.round(F.sum(F.col("rating") * (F.col("user_id") % 7)), 6).alias("s"))


@query("a16_tag_terms", "WITH t AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, event_type AS term FROM events) SELECT item_id, term, count(*) AS n FROM t GROUP BY 1, 2")
def a16(spark, sf_dir):
    events = X.table(spark, sf_dir, "events")
    return events.groupBy(F.get_json_object("props", "$.k").cast("long").alias("item_id"), F.col("event_type").alias("term")).agg(F.count("*").alias("n"))


@query("a19_coverage", f"{BASE} SELECT round((SELECT count(DISTINCT item_id) FROM lists) / (SELECT count(DISTINCT item_id) FROM train), 6) AS coverage")
def a19(spark, sf_dir):
    return rounded(E.coverage(pop_lists(spark, sf_dir), parts(spark, sf_dir)[0]), ("coverage",))


@query("a20_rating_errors", X.with_("rb", more=f"{SPLIT}, c AS (SELECT avg(rating) AS c FROM train), i AS (SELECT item_id, sum(rating) AS s, count(*) AS v FROM train GROUP BY 1), p AS (SELECT rating, c, coalesce(s / v, c) AS im, coalesce((s + 10 * c) / (v + 10), c) AS dm FROM split LEFT JOIN i USING (item_id), c WHERE split = 'test')") + "SELECT 'global_mean' AS model, round(sqrt(avg((c - rating) * (c - rating))), 6) AS rmse, round(avg(abs(c - rating)), 6) AS mae FROM p UNION ALL SELECT 'item_mean', round(sqrt(avg((im - rating) * (im - rating))), 6), round(avg(abs(im - rating)), 6) FROM p UNION ALL SELECT 'damped_mean', round(sqrt(avg((dm - rating) * (dm - rating))), 6), round(avg(abs(dm - rating)), 6) FROM p")
def a20(spark, sf_dir):
    own = split.temporal_split(X.ratings_b(spark, sf_dir))
    return rounded(stats.rating_errors(own.where("split = 'train'"), own.where("split = 'test'")), ("rmse", "mae"))


@query("a25_rank_correlation", X.with_("rb", more=f"s AS (SELECT item_id, {HASH} AS x, count(*) AS y FROM rb GROUP BY 1), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM s)") + "SELECT round(corr(rx, ry), 6) AS rho FROM r")
def a25(spark, sf_dir):
    own = X.ratings_b(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("y")).withColumn("x", tie_hash(F.col("item_id")))
    return rounded(stats.spearman(own, "x", "y"), ("rho",))


DAMPINGS = (0, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000)
IDEAL = "list_sum(list_transform(range(1, least(count(*), %d) + 1), lambda r: 1 / log2(r + 1)))" % K
NR = f"nr AS (SELECT user_id, {IDEAL} AS ideal FROM rel GROUP BY 1)"


def grid_sql(lists: str, by: str = "config") -> str:
    """The mean NDCG of lists by configuration, over the users of rel."""
    return f"{NR}, d AS (SELECT {by}, user_id, sum(1 / log2(rank + 1)) AS dcg FROM {lists} SEMI JOIN rel USING (user_id, item_id) GROUP BY ALL) SELECT {by}, round(sum(coalesce(dcg, 0) / ideal) / (SELECT count(*) FROM nr), 6) AS ndcg FROM (SELECT * FROM (SELECT DISTINCT {by} FROM {lists}), nr) LEFT JOIN d USING ({by}, user_id) GROUP BY ALL"


DAMPED = " ".join(f"UNION ALL SELECT {n + 2}, item_id, (s + {m} * c) / (v + {m}) FROM st, c" for n, m in enumerate(DAMPINGS))


@query("g1_popularity_grid", X.with_("rb", more=f"{SPLIT}, {RELEVANT}, c AS (SELECT avg(rating) AS c FROM train), st AS (SELECT item_id, count(*) AS v, sum(rating) AS s, count(*) FILTER (rating >= 4) AS p FROM train GROUP BY 1), g AS (SELECT CAST(0 AS INT) AS config, item_id, CAST(v AS DOUBLE) AS score FROM st UNION ALL SELECT 1, item_id, p FROM st {DAMPED}), l AS (SELECT config, user_id, item_id, row_number() OVER (PARTITION BY config, user_id ORDER BY round(score, 9) DESC, {HASH}, item_id) AS rank FROM (SELECT config, user_id, item_id, score FROM (SELECT DISTINCT user_id FROM rel), g) ANTI JOIN train USING (user_id, item_id) QUALIFY rank <= {K})") [:-1] + f", {grid_sql('l')}")
def g1(spark, sf_dir):
    """Most rated, most liked, and the damped mean by twelve dampings."""
    train, val = parts(spark, sf_dir)
    wanted, scores = E.relevant(train, val), None
    for n, (variant, damping) in enumerate([("most_rated", 0.0), ("most_liked", 0.0), *(("damped_mean", float(m)) for m in DAMPINGS)]):
        own = popularity.popularity(train, None, variant, damping).withColumn("config", F.lit(n))
        scores = own if scores is None else scores.unionByName(own)
    lists = E.first_unseen(wanted.select("user_id").distinct(), train, scores, K)
    return tuning.grid_metrics(lists, wanted, K).select("config", F.round("ndcg", 6).alias("ndcg"))


CF_A, CF_SHRINK, CF_K = (0.5, 0.7), (0.0, 20.0, 100.0), (50, 100, 200)
CF_GRID = [(a, shrink, k) for a in CF_A for shrink in CF_SHRINK for k in CF_K]
CF_ROWS = ", ".join(f"({n}, CAST({a} AS DOUBLE), CAST({1 - a} AS DOUBLE), CAST({shrink} AS DOUBLE), {k})" for n, (a, shrink, k) in enumerate(CF_GRID))


@query("g4_cf_grid", X.with_("rb", more=f"{SPLIT}, {RELEVANT}, liked AS (SELECT DISTINCT user_id, item_id FROM train WHERE rating >= 4), {models.PAIRS}, {models.COUNTS}, grid(config, a, a1, shrink, k) AS (VALUES {CF_ROWS}), both_ AS (SELECT i, j, n_ij FROM pairs UNION ALL SELECT j, i, n_ij FROM pairs), sims AS (SELECT config, k, i, j, n_ij / (pow(p.n_i, a) * pow(q.n_i, a1)) * (n_ij / (n_ij + shrink)) AS sim FROM both_ JOIN counts p ON p.item_id = i JOIN counts q ON q.item_id = j, grid), near AS (SELECT *, row_number() OVER (PARTITION BY config, i ORDER BY round(sim, 9) DESC, j) AS rank FROM sims QUALIFY rank <= k), sc AS (SELECT config, user_id, j AS item_id, sum(sim) AS score FROM liked JOIN near ON i = item_id GROUP BY 1, 2, 3), l AS (SELECT config, user_id, item_id, row_number() OVER (PARTITION BY config, user_id ORDER BY round(score, 9) DESC, {HASH}, item_id) AS rank FROM sc ANTI JOIN train USING (user_id, item_id) QUALIFY rank <= {K})")[:-1] + f", {grid_sql('l')}")
def g4(spark, sf_dir):
    """Exponent, shrinkage and number of neighbours, over pairs that are counted once."""
    train, val = parts(spark, sf_dir)
    wanted, near, out = E.relevant(train, val), None, None
    counted = files.stored(itemcf.counted_pairs(train), "pairs")
    for n, (a, shrink, k) in enumerate(CF_GRID):
        own = itemcf.nearest(itemcf.weighed(counted, a, shrink), k).select(F.lit(n).alias("config"), "i", "j", "sim")
        near = own if near is None else near.unionByName(own)
    near = files.stored(near, "near")
    liked = stats.positives(train).select("user_id", F.col("item_id").alias("i")).distinct()
    scores = liked.join(near, "i").groupBy("config", "user_id", F.col("j").alias("item_id")).agg(F.sum("sim").alias("score"))
    unseen = scores.join(train.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    lists = top_k(unseen, ["config", "user_id"], [F.desc(F.round("score", 9)), tie_hash(F.col("item_id")).asc(), F.col("item_id").asc()], K)
    return tuning.grid_metrics(lists.select("config", "user_id", "item_id", "rank"), wanted, K).select("config", F.round("ndcg", 6).alias("ndcg"))


# new users of four sizes of history, with and without the head of the catalogue: user_id * 8 + 2 * place of k + tail
COHORT_KS, WINDOW, HEAD = (3, 5, 10, 20), 20, 20
COHORTS = f"{ONBOARD}, ks AS (SELECT unnest({list(COHORT_KS)}) AS k, unnest([0, 1, 2, 3]) AS nth), tails AS (SELECT unnest([0, 1]) AS tail), head AS (SELECT item_id FROM rb GROUP BY 1 ORDER BY count(*) DESC, item_id LIMIT {HEAD}), roles AS (SELECT user_id * 8 + nth * 2 + tail AS user_id, k, tail, item_id, s <= k AS pick FROM pos, ks, tails WHERE c >= k + {WINDOW} AND s <= k + {WINDOW} AND (s <= k OR tail = 0 OR item_id NOT IN (SELECT item_id FROM head))), rel AS (SELECT user_id, k, tail, item_id FROM roles WHERE NOT pick), users AS (SELECT DISTINCT user_id, k, tail FROM rel), picks AS (SELECT user_id, item_id FROM roles WHERE pick AND user_id IN (SELECT user_id FROM users)), cand AS (SELECT DISTINCT item_id FROM rb), pool AS (SELECT user_id, item_id FROM (SELECT * FROM users, cand WHERE tail = 0 OR item_id NOT IN (SELECT item_id FROM head)) ANTI JOIN picks USING (user_id, item_id))"
COHORT_BASE = X.with_("rb", "items", more=f"{models.LIKED}, {models.PAIRS}, {models.COUNTS}, {models.sims()}, {COHORTS}, {models.TIER1}, {models.UNIT}")[:-1]
TUNED = f"{COHORT_BASE}, {models.POOL_PARTS}, {models.PCT}"
SIMPLEX = "grid AS (SELECT CAST(row_number() OVER (ORDER BY i, j) - 1 AS INT) AS config, i / 10 AS wc, j / 10 AS wf, (10 - i - j) / 10 AS wp FROM (SELECT unnest(range(11)) AS i), (SELECT unnest(range(11)) AS j) WHERE i + j <= 10)"
ALPHA_GRID = "grid AS (SELECT CAST(i AS INT) AS config, i / 10 AS wc, CAST(0 AS DOUBLE) AS wf, (10 - i) / 10 AS wp FROM (SELECT unnest(range(11)) AS i))"
LISTED = f"tl AS (SELECT config, user_id, item_id, row_number() OVER (PARTITION BY config, user_id ORDER BY round(wc * pct_content + wf * pct_cf + wp * pct_popularity, 9) DESC, {HASH}, item_id) AS rank FROM pcts, grid QUALIFY rank <= {K})"
NDCGS = f"nr AS (SELECT user_id, k, tail, {IDEAL} AS ideal FROM rel GROUP BY ALL), d AS (SELECT config, user_id, sum(1 / log2(rank + 1)) AS dcg FROM tl SEMI JOIN rel USING (user_id, item_id) GROUP BY 1, 2), un AS (SELECT config, user_id, k, tail, coalesce(dcg, 0) / ideal AS ndcg FROM (SELECT * FROM grid, nr) LEFT JOIN d USING (config, user_id))"
LIFTS = "res AS (SELECT config, k, avg(ndcg) FILTER (tail = 0) AS ndcg_all, avg(ndcg) FILTER (tail = 1) AS ndcg_tail FROM un GROUP BY 1, 2), lifted AS (SELECT config, k, ndcg_all, ndcg_tail, ((ndcg_all / (first_value(ndcg_all) OVER w) - 1) + (ndcg_tail / (first_value(ndcg_tail) OVER w) - 1)) / 2 AS objective, round(ndcg_all, 9) >= round(first_value(ndcg_all) OVER w, 9) AS meets FROM res WINDOW w AS (PARTITION BY k ORDER BY config))"
CHOSEN = "chosen AS (SELECT k, config, objective FROM lifted QUALIFY row_number() OVER (PARTITION BY k ORDER BY CAST(meets AS INT) DESC, round(objective, 9) DESC, config) = 1)"


def cohorts(spark, sf_dir):
    """Picks, relevant items with their cohort, and the pool of every cohort's users."""
    rated = files.stored(X.ratings_b(spark, sf_dir), "rated")
    head, roles = E.most_rated(rated, HEAD), None
    for nth, k in enumerate(COHORT_KS):
        for tail in (0, 1):
            own = E.onboarding(rated, k, WINDOW)
            if tail:
                own = own.where("role = 'pick'").unionByName(E.long_tail(own.where("role = 'relevant'"), head))
            own = own.select((F.col("user_id") * 8 + nth * 2 + tail).alias("user_id"), "item_id", "role", F.lit(nth * 2 + tail).alias("cohort"))
            roles = own if roles is None else roles.unionByName(own)
    roles = files.stored(roles, "roles")
    wanted = roles.where("role = 'relevant'").select("user_id", "item_id", "cohort")
    users = wanted.select("user_id").distinct()
    chosen = roles.where("role = 'pick'").select("user_id", "item_id").join(users, "user_id", "left_semi")
    items = rated.select("item_id").distinct()
    pool = hybrid.pool(users.where("user_id % 2 = 0"), items, chosen).unionByName(hybrid.pool(users.where("user_id % 2 = 1"), E.long_tail(items, head), chosen))
    return rated, chosen, wanted, pool


def cohort_percentiles(spark, sf_dir):
    """The percentiles of the three scores in each cohort's pools, and what is relevant."""
    rated, chosen, wanted, pool = cohorts(spark, sf_dir)
    rows = models.components(pool, chosen, rated, models.served_unit(spark, sf_dir), models.stored_near(spark, sf_dir))
    rows = hybrid.blended(rows, [1.0, 0.0, 0.0]).select("user_id", "item_id", *(f"pct_{p}" for p in tuning.PARTS))
    return files.stored(rows, "percentiles"), files.stored(wanted, "wanted")


def by_cohort(metrics):
    """With the k and the variant that a cohort's number stands for."""
    ks = F.array(*map(F.lit, COHORT_KS))
    return metrics.withColumn("k", F.element_at(ks, F.floor(F.col("cohort") / 2).cast("int") + 1)).withColumn("tail", (F.col("cohort") % 2).cast("int"))


def tuned(spark, sf_dir, grid):
    rows, wanted = cohort_percentiles(spark, sf_dir)
    lists = tuning.weighted_lists(rows, grid, K, wanted=wanted)
    return tuning.lifts(by_cohort(files.stored(tuning.grid_metrics(lists, wanted, K), "grid")))


ALPHAS = [(i / 10, 0.0, (10 - i) / 10) for i in range(11)]
LIFTED = ("ndcg_all", "ndcg_tail", "objective")


@query("g7_simplex_grid", f"{TUNED}, {SIMPLEX}, {LISTED}, {NDCGS}, {LIFTS} SELECT config, k, round(ndcg_all, 6) AS ndcg_all, round(ndcg_tail, 6) AS ndcg_tail, round(objective, 5) AS objective, meets FROM lifted")
def g7(spark, sf_dir):
    """66 blends for each of four sizes of history and two variants of the catalogue."""
    return rounded(rounded(tuned(spark, sf_dir, tuning.simplex_grid()), LIFTED[:2]), LIFTED[2:], 5)


@query("k14_best_config", f"{TUNED}, {SIMPLEX}, {LISTED}, {NDCGS}, {LIFTS}, {CHOSEN} SELECT k, config, round(objective, 5) AS objective FROM chosen")
def k14(spark, sf_dir):
    return rounded(tuning.chosen(tuned(spark, sf_dir, tuning.simplex_grid())), ("objective",), 5)


OLD = "old_grid AS (SELECT k, alpha FROM (SELECT unnest([3, 5, 10, 20]) AS k, unnest([CAST(0.3 AS DOUBLE), 0.6, 0.7, 0.8]) AS alpha))"


@query("g7_adoption", f"{TUNED}, {SIMPLEX}, {LISTED}, {NDCGS}, {LIFTS}, {CHOSEN}, {OLD}, ol AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY round(alpha * pct_content + 0 * pct_cf + (1 - alpha) * pct_popularity, 9) DESC, {HASH}, item_id) AS rank FROM pcts JOIN users USING (user_id) JOIN old_grid USING (k) QUALIFY rank <= {K}), od AS (SELECT user_id, sum(1 / log2(rank + 1)) AS dcg FROM ol SEMI JOIN rel USING (user_id, item_id) GROUP BY 1), diffs AS (SELECT nr.k, nr.tail, nr.user_id, un.ndcg - coalesce(od.dcg, 0) / nr.ideal AS d FROM nr JOIN chosen USING (k) JOIN un ON un.config = chosen.config AND un.user_id = nr.user_id LEFT JOIN od ON od.user_id = nr.user_id), per AS (SELECT k, tail, b, sum(w * d) / sum(w) AS x FROM (SELECT k, tail, d, b, {_DRAW} AS w FROM diffs, (SELECT unnest(range(1, 1001)) AS b)) GROUP BY 1, 2, 3), spread AS (SELECT k, tail, quantile_cont(x, 0.025) AS low, quantile_cont(x, 0.975) AS high FROM per GROUP BY 1, 2), both2 AS (SELECT k, tail, avg(d) AS difference, any_value(low) AS low, any_value(high) AS high FROM diffs JOIN spread USING (k, tail) GROUP BY 1, 2) SELECT coalesce(bool_and(difference > 0 AND low > 0) FILTER (tail = 1 AND k IN (5, 10)), false) AS better_in_tail, coalesce(bool_or(difference < 0 AND high < 0) FILTER (tail = 0), false) AS worse_somewhere, coalesce(bool_and(difference > 0 AND low > 0) FILTER (tail = 1 AND k IN (5, 10)), false) AND NOT coalesce(bool_or(difference < 0 AND high < 0) FILTER (tail = 0), false) AS adopted, round(avg(difference), 6) AS mean_difference, round(min(low), 6) AS low, round(max(high), 6) AS high FROM both2")
def g7_adoption(spark, sf_dir):
    """Whether the best blends replace the alpha schedule: paired intervals of each cohort."""
    rows, wanted = cohort_percentiles(spark, sf_dir)
    lists = files.stored(tuning.weighted_lists(rows, tuning.simplex_grid(), K, wanted=wanted), "lists")
    best = tuning.chosen(tuning.lifts(by_cohort(tuning.grid_metrics(lists, wanted, K)))).select("k", "config")
    new = by_cohort(tuning.user_ndcg(lists, wanted, K)).join(F.broadcast(best), ["k", "config"])  # one row a cohort
    old = by_cohort(tuning.user_ndcg(tuning.weighted_lists(rows, ALPHAS, K, wanted=wanted), wanted, K))
    old = old.where(F.col("config") == F.round(hybrid.by_picks(F.col("k"), hybrid.ALPHAS) * 10).cast("int"))
    differences = E.compared(new.select("k", "tail", "user_id", "ndcg"), old.select("k", "tail", "user_id", "ndcg"), "ndcg", by=("k", "tail"))
    differences = files.stored(differences, "differences")
    span = differences.agg(F.round(F.avg("difference"), 6).alias("mean_difference"), F.round(F.min("low"), 6).alias("low"), F.round(F.max("high"), 6).alias("high"))
    return tuning.adopted(differences).join(F.broadcast(span), F.lit(True))  # one row each


@query("g8_tie_bias", f"{BASE}, by_id AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (SELECT user_id, item_id, score FROM (SELECT DISTINCT user_id FROM rel), pop) ANTI JOIN train USING (user_id, item_id) QUALIFY rank <= {K}), {metrics_sql('mi', 'by_id')} SELECT round(avg(mi.ndcg - m.ndcg), 6) AS difference, count(*) FILTER (abs(mi.ndcg - m.ndcg) > 1e-9) AS changed FROM m JOIN mi USING (user_id)")
def g8(spark, sf_dir):
    """What the order of ties does to the metric: by hash, and by item id."""
    train, val = parts(spark, sf_dir)
    wanted = E.relevant(train, val)
    scores = hybrid.pool(wanted.select("user_id").distinct(), train.select("item_id").distinct(), train).join(popularity.popularity(train), "item_id")  # both orders, so whole pools
    plain = top_k(scores, ["user_id"], [F.desc("score"), F.col("item_id").asc()], K).select("user_id", "item_id", "rank")
    by_id = E.user_metrics(plain, wanted, K).select("user_id", F.col("ndcg").alias("x"))
    both = E.user_metrics(E.recommended(scores, train, K), wanted, K).join(by_id, "user_id")
    return both.agg(F.round(F.avg(F.col("x") - F.col("ndcg")), 6).alias("difference"), F.count_if(F.abs(F.col("x") - F.col("ndcg")) > 1e-9).alias("changed"))


for _metric, _id in (("recall", "e3"), ("ndcg", "e4"), ("hit_rate", "e5"), ("mrr", "e6")):

    def _one(spark, sf_dir, metric=_metric):
        return pop_metrics(spark, sf_dir).select("user_id", F.round(metric, 6).alias(metric))

    query(f"{_id}_{_metric}", f"{BASE} SELECT user_id, round({_metric}, 6) AS {_metric} FROM m")(_one)


@query("e14_rating_prediction", X.with_("ra", more=SPLIT.replace("FROM rb", "FROM ra") + ", c AS (SELECT avg(rating) AS c FROM train), i AS (SELECT item_id, avg(rating) AS im FROM train GROUP BY 1)") + "SELECT count(*) AS n, count(*) FILTER (im IS NULL) AS unseen, round(sqrt(avg(pow(coalesce(im, c) - rating, 2))), 6) AS rmse FROM split LEFT JOIN i USING (item_id), c WHERE split = 'test'")
def e14(spark, sf_dir):
    """Item means, with the global mean for items that train never saw."""
    own = split.temporal_split(X.ratings_a(spark, sf_dir))
    train, test = own.where("split = 'train'"), own.where("split = 'test'")
    means = train.groupBy("item_id").agg(F.avg("rating").alias("im"))
    mean = train.agg(F.avg("rating").alias("c"))
    rows = test.join(means, "item_id", "left").join(F.broadcast(mean), F.lit(True))
    d = F.coalesce("im", "c") - F.col("rating")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("im").isNull()).alias("unseen"), F.round(F.sqrt(F.avg(d * d)), 6).alias("rmse"))


YEAR_WEIGHTS, TAG_WEIGHTS, DENSE_WEIGHTS = (0.0, 0.25, 0.5, 1.0), (1.0, 2.0, 4.0, 8.0), (0.5, 1.0, 2.0, 4.0)
V1_TAGS, V1_DENSE = (2.0, 4.0, 8.0, 16.0), (0.25, 0.5, 1.0)
G2_GRID = "y AS (SELECT CAST(i * 4 + j AS INT) AS vec, i = 1 AS idf, j FROM (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1, 2, 3]) AS j)), yw AS (SELECT vec, idf, CAST([0.0, 0.25, 0.5, 1.0] AS DOUBLE[])[j + 1] AS wy FROM y)"
G2_UNIT = f"idfs AS (SELECT feature, ln((SELECT count(*) FROM items) / (count(*) + 1)) + 1 AS idf_value FROM genre GROUP BY 1), raw2 AS (SELECT vec, item_id, feature, CASE WHEN idf THEN idf_value ELSE 1 END AS value FROM genre JOIN idfs USING (feature), yw UNION ALL SELECT vec, item_id, 'year_norm', year_norm * wy FROM years, yw WHERE year_norm * wy <> 0), unit2 AS (SELECT vec, item_id, feature, value / sqrt(sum(value * value) OVER (PARTITION BY vec, item_id)) AS value FROM raw2)"
G2_WEIGHTS = "ww AS (SELECT 0 AS v, user_id, item_id, CAST(1 AS DOUBLE) AS w FROM train WHERE rating >= 4 UNION ALL SELECT 1, user_id, item_id, rating FROM train UNION ALL SELECT 2, user_id, item_id, rating - avg(rating) OVER (PARTITION BY user_id) FROM train UNION ALL SELECT 3, user_id, item_id, rating FROM train WHERE rating >= 4)"


def unit_sql(source: str, name: str, keys: str) -> str:
    return f"{name} AS (SELECT * REPLACE (CASE WHEN sqrt(sum(value * value) OVER (PARTITION BY {keys})) > 0 THEN value / sqrt(sum(value * value) OVER (PARTITION BY {keys})) ELSE 0 END AS value) FROM ({source}))"


G2_PROFILES = unit_sql("SELECT v, vec, user_id, feature, sum(w * value) AS value FROM ww JOIN unit2 USING (item_id) GROUP BY ALL", "prof2", "v, vec, user_id")
G2_LISTS = f"sc2 AS (SELECT CAST(v * 8 + vec AS INT) AS config, user_id, item_id, sum(prof2.value * unit2.value) AS score FROM prof2 JOIN unit2 USING (vec, feature) SEMI JOIN (SELECT DISTINCT item_id FROM train) USING (item_id) GROUP BY ALL), l AS (SELECT config, user_id, item_id, row_number() OVER (PARTITION BY config, user_id ORDER BY round(score, 9) DESC, {HASH}, item_id) AS rank FROM sc2 ANTI JOIN train USING (user_id, item_id) QUALIFY rank <= {K})"


def content_lists(scores, train):
    """The first items of each user under each configuration."""
    unseen = scores.join(train.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    return top_k(unseen, ["config", "user_id"], [F.desc(F.round("score", 9)), tie_hash(F.col("item_id")).asc(), F.col("item_id").asc()], K).select("config", "user_id", "item_id", "rank")


@query("g2_content_grid", X.with_("rb", "items", more=f"{SPLIT}, {RELEVANT}, {models.TIER1}, {G2_GRID}, {G2_UNIT}, {G2_WEIGHTS}, {G2_PROFILES}, {G2_LISTS}")[:-1] + f", {grid_sql('l')}")
def g2(spark, sf_dir):
    """Four profiles, genres with or without idf, and four weights of the year, by NDCG on the
    validation split."""
    train, val = parts(spark, sf_dir)
    items, wanted = X.items(spark, sf_dir), E.relevant(train, val)
    grid = spark.createDataFrame([(i * 4 + j, bool(i), w) for i in (0, 1) for j, w in enumerate(YEAR_WEIGHTS)], "vec int, use_idf boolean, wy double")
    years = content.year_features(items).select("item_id", F.lit("year_norm").alias("feature"), F.col("year_norm").alias("value"), F.lit(1.0).alias("idf"))
    rows = content.genre_features(items).join(content.genre_idf(items), "feature").select("item_id", "feature", "value", "idf").unionByName(years)
    rows = rows.join(F.broadcast(grid), F.lit(True))  # eight rows of parameters
    value = F.when(F.col("feature") == "year_norm", F.col("value") * F.col("wy")).when(F.col("use_idf"), F.col("idf")).otherwise(F.col("value"))
    rows = rows.select("vec", "item_id", "feature", value.alias("value")).where("value <> 0")
    served = rows.join(train.select("item_id").distinct(), "item_id", "left_semi")
    unit, scores = files.stored(normalized(served, ["vec", "item_id"]), "unit"), None
    for n, variant in enumerate(content.PROFILES):
        own = content.scores(content.profiles(train, unit, variant, by=("vec",)), unit, by=("vec",)).select((F.col("vec") + n * 8).alias("config"), "user_id", "item_id", "score")
        scores = own if scores is None else scores.unionByName(own)
    return tuning.grid_metrics(content_lists(scores, train), wanted, K).select("config", F.round("ndcg", 6).alias("ndcg"))


def blocks_sql(tags: tuple, dense: tuple) -> str:
    """Item vectors of three blocks under each pair of weights: raw3, and unit3 normalised."""
    pairs = ", ".join(f"({n}, CAST({t} AS DOUBLE), CAST({d} AS DOUBLE))" for n, (t, d) in enumerate((t, d) for t in tags for d in dense))
    dense_ = "dense AS (SELECT item_id, CAST(unnest(range(len(embedding))) AS VARCHAR) AS feature, CAST(unnest(embedding) AS DOUBLE) AS value FROM vectors), dunit AS (SELECT item_id, feature, value / sqrt(sum(value * value) OVER (PARTITION BY item_id)) AS value FROM dense)"
    raw = "bw(vec, wt, wd) AS (VALUES " + pairs + "), raw3 AS (SELECT vec, item_id, feature, value FROM (SELECT vec, item_id, feature, value FROM unit, bw UNION ALL SELECT vec, item_id, 'tag:' || feature, value * wt FROM tfidf, bw UNION ALL SELECT vec, item_id, 'd:' || feature, value * wd FROM dunit, bw) WHERE item_id IN (SELECT item_id FROM rb))"
    return f"{models.TFIDF}, {dense_}, {raw}, {unit_sql('SELECT * FROM raw3', 'unit3', 'vec, item_id')}"


def weighted_blocks(spark, sf_dir, tags: tuple, dense: tuple, served):
    """(vec, item_id, feature, value): three normalised blocks of the items that are served,
    times each pair of weights."""
    items = X.items(spark, sf_dir)
    wide = X.item_vectors(spark, sf_dir).select("item_id", F.posexplode("embedding").alias("pos", "v")).select("item_id", F.col("pos").cast("string").alias("feature"), F.col("v").cast("double").alias("value"))
    one, grid = F.lit(1.0), spark.createDataFrame([(n, *w) for n, w in enumerate((t, d) for t in tags for d in dense)], "vec int, wt double, wd double")
    out = None
    for rows, prefix, weight in ((content.tier_1(items), "", one), (content.tf_idf(X.item_docs(spark, sf_dir), items), "tag:", F.col("wt")), (wide, "d:", F.col("wd"))):
        own = normalized(rows, "item_id").join(served, "item_id", "left_semi").join(F.broadcast(grid), F.lit(True))  # a few rows of parameters
        own = own.select("vec", "item_id", F.concat(F.lit(prefix), "feature").alias("feature"), (F.col("value") * weight).alias("value"))
        out = own if out is None else out.unionByName(own)
    return files.stored(out, "blocks")


G3_PROFILES = unit_sql("SELECT vec, user_id, feature, sum(value) AS value FROM train JOIN raw3 USING (item_id) WHERE rating >= 4 GROUP BY ALL", "prof3", "vec, user_id")
G3_LISTS = f"sc3 AS (SELECT CAST(vec AS INT) AS config, user_id, item_id, sum(prof3.value * unit3.value) AS score FROM prof3 JOIN unit3 USING (vec, feature) SEMI JOIN (SELECT DISTINCT item_id FROM train) USING (item_id) GROUP BY ALL), l AS (SELECT config, user_id, item_id, row_number() OVER (PARTITION BY config, user_id ORDER BY round(score, 9) DESC, {HASH}, item_id) AS rank FROM sc3 ANTI JOIN train USING (user_id, item_id) QUALIFY rank <= {K})"


@query("g3_block_weight_grid", X.with_("rb", "items", "vectors", more=f"{SPLIT}, {RELEVANT}, {models.TIER1}, {models.UNIT}, {blocks_sql(TAG_WEIGHTS, DENSE_WEIGHTS)}, {G3_PROFILES}, {G3_LISTS}")[:-1] + f", {grid_sql('l')}")
def g3(spark, sf_dir):
    """Four weights of the tags times four of the dense block, by NDCG on the validation split."""
    train, val = parts(spark, sf_dir)
    rows = weighted_blocks(spark, sf_dir, TAG_WEIGHTS, DENSE_WEIGHTS, train.select("item_id").distinct())
    scores = content.scores(content.profiles(train, rows, by=("vec",)), normalized(rows, ["vec", "item_id"]), by=("vec",)).withColumnRenamed("vec", "config")
    return tuning.grid_metrics(content_lists(scores, train), E.relevant(train, val), K).select("config", F.round("ndcg", 6).alias("ndcg"))


V1_SQL = f"con3 AS (SELECT vec, user_id, item_id, sum(q.value * unit3.value) AS content FROM (SELECT vec, user_id, feature, sum(value) AS value FROM picks JOIN raw3 USING (item_id) GROUP BY ALL) q JOIN unit3 USING (vec, feature) GROUP BY ALL), parts3 AS (SELECT pool.user_id, pool.item_id, bw.vec, round(coalesce(content, 0), 9) AS content, round(coalesce(n_i, 0), 9) AS popularity FROM pool JOIN bw ON true LEFT JOIN con3 ON con3.vec = bw.vec AND con3.user_id = pool.user_id AND con3.item_id = pool.item_id LEFT JOIN counts ON counts.item_id = pool.item_id), pcts3 AS (SELECT vec, user_id, item_id, {models._pct('content').replace('PARTITION BY user_id', 'PARTITION BY vec, user_id')} AS pct_content, {models._pct('popularity').replace('PARTITION BY user_id', 'PARTITION BY vec, user_id')} AS pct_popularity FROM parts3), tl3 AS (SELECT vec, config, user_id, item_id, row_number() OVER (PARTITION BY vec, config, user_id ORDER BY round(wc * pct_content + wp * pct_popularity, 9) DESC, {HASH}, item_id) AS rank FROM pcts3, grid QUALIFY rank <= {K}), nr AS (SELECT user_id, k, tail, {IDEAL} AS ideal FROM rel WHERE k <= 10 GROUP BY ALL), d AS (SELECT vec, config, user_id, sum(1 / log2(rank + 1)) AS dcg FROM tl3 SEMI JOIN rel USING (user_id, item_id) GROUP BY ALL), un AS (SELECT bw.vec, grid.config, nr.k, nr.tail, avg(coalesce(dcg, 0) / ideal) AS ndcg FROM nr JOIN grid ON true JOIN bw ON true LEFT JOIN d ON d.vec = bw.vec AND d.config = grid.config AND d.user_id = nr.user_id GROUP BY ALL)"


@query("g5_alpha_grid", f"{COHORT_BASE.replace('WITH ', 'WITH ' + X.CTE['vectors'] + ', ', 1)}, {blocks_sql(V1_TAGS, V1_DENSE)}, {ALPHA_GRID}, {V1_SQL}, base AS (SELECT vec, k, ndcg AS b FROM un WHERE config = 0 AND tail = 1) SELECT CAST(vec AS INT) AS vec, config, round(avg(ndcg) FILTER (tail = 0), 6) AS objective, bool_or(tail = 1 AND ndcg < b - 1e-6) AS rejected FROM un JOIN base USING (vec, k) GROUP BY ALL")
def g5(spark, sf_dir):
    """Eleven alphas times four weights of tags times three of the dense block: the mean NDCG
    for 3, 5 and 10 picks, rejected where the tail is worse than popularity for any of them."""
    rated, chosen, wanted, pool = cohorts(spark, sf_dir)
    few = F.col("user_id") % 8 < 6
    chosen, wanted, pool = chosen.where(few), wanted.where(few), pool.where(few)
    rows = weighted_blocks(spark, sf_dir, V1_TAGS, V1_DENSE, rated.select("item_id").distinct())
    summed = chosen.join(rows, "item_id").groupBy("vec", "user_id", "feature").agg(F.sum("value").alias("value"))
    con = content.scores(summed, normalized(rows, ["vec", "item_id"]), by=("vec",)).withColumnRenamed("score", "content")
    pop = itemcf.item_counts(rated).select("item_id", F.col("n_i").cast("double").alias("popularity"))
    shared = pool.join(pop, "item_id", "left").fillna(0.0, ["popularity"])
    shared = shared.select("user_id", "item_id", percentile_rank(F.round("popularity", 9), ["user_id"]).alias("pct_popularity"))
    combos = shared.withColumn("vec", F.explode(F.sequence(F.lit(0), F.lit(len(V1_TAGS) * len(V1_DENSE) - 1))))
    parts_ = combos.join(con, ["vec", "user_id", "item_id"], "left").fillna(0.0, ["content"])
    pcts = parts_.select("vec", "user_id", "item_id", percentile_rank(F.round("content", 9), ["vec", "user_id"]).alias("pct_content"), "pct_popularity")
    lists = tuning.weighted_lists(pcts, [(a, p) for a, _, p in ALPHAS], K, ("content", "popularity"), by=("vec",), wanted=wanted)
    own = files.stored(by_cohort(tuning.grid_metrics(lists, wanted, K, by=("vec", "config"))), "grid")
    base = own.where("config = 0 AND tail = 1").select("vec", "k", F.col("ndcg").alias("b"))
    out = own.join(base, ["vec", "k"]).groupBy("vec", "config").agg(F.avg(F.when(F.col("tail") == 0, F.col("ndcg"))).alias("objective"), F.bool_or((F.col("tail") == 1) & (F.col("ndcg") < F.col("b") - 1e-6)).alias("rejected"))
    return rounded(out, ("objective",))


@query("g6_monotone_alphas", f"{TUNED}, {ALPHA_GRID}, {LISTED}, {NDCGS}, {LIFTS}, best AS (SELECT k, config FROM lifted WHERE config BETWEEN 1 AND 8 QUALIFY row_number() OVER (PARTITION BY k ORDER BY CAST(meets AS INT) DESC, round(objective, 9) DESC, config) = 1) SELECT k, config / 10 AS best, max(config / 10) OVER (ORDER BY k) AS alpha FROM best")
def g6(spark, sf_dir):
    """The best of the alphas 0.1 to 0.8 for each size of history, made monotone."""
    best = tuning.chosen(tuned(spark, sf_dir, ALPHAS).where("config BETWEEN 1 AND 8"))
    return hybrid.monotone(best.select("k", (F.col("config") / 10).alias("best"), (F.col("config") / 10).alias("alpha")))


@query("sc23_discounts", f"{BASE} SELECT user_id, rank, round(1 / log2(rank + 1), 6) AS discount, round(ln(rank), 6) AS l, round(sqrt(rank), 6) AS s FROM lists")
def sc23(spark, sf_dir):
    return pop_lists(spark, sf_dir).select("user_id", "rank", F.round(1 / F.log2(F.col("rank") + 1), 6).alias("discount"), F.round(F.ln("rank"), 6).alias("l"), F.round(F.sqrt("rank"), 6).alias("s"))
