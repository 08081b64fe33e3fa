import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions import ranking as R
from rankloom.functions import vectors as V
from rankloom.operators import evaluation as E
from rankloom.operators import content, hybrid, itemcf, tuning


def average_ranks(values):
    order = np.argsort(values, kind="stable")
    ranks = np.empty(len(values))
    ranks[order] = np.arange(1, len(values) + 1)
    return [ranks[[i for i, x in enumerate(values) if x == v]].mean() for v in values]


def test_percentiles_share_ties(spark):
    values = [0.0, 0.0, 0.0, 3.0, 1.0, 3.0, 9.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)] + [(2, 0, 5.0)], "user_id int, item_id int, v double")
    rows = df.select("user_id", "item_id", R.percentile_rank(F.col("v"), ["user_id"]).alias("p")).orderBy("user_id", "item_id").collect()
    assert np.allclose([r["p"] for r in rows[:-1]], [(x - 1) / 6 for x in average_ranks(values)])
    assert rows[-1]["p"] == 1.0


def test_sparse_percentiles_equal_dense_ones(spark):
    values = [0.0, 0.0, 2.0, 5.0, 2.0, 0.0, 7.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "user_id int, item_id int, score double")
    sizes = spark.createDataFrame([(1, len(values))], "user_id int, n int")
    dense = {r["item_id"]: r["p"] for r in df.select("item_id", R.percentile_rank(F.col("score"), ["user_id"]).alias("p")).collect()}
    for r in hybrid.sparse_percentiles(df, sizes).collect():
        assert abs(r["pct"] - dense[r["item_id"]]) < 1e-12


def test_numbering_over_ranges(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x")).repartition(7)
    rows = R.numbered(df, [F.col("x").asc()], "i").collect()
    assert sorted((r["x"], r["i"]) for r in rows) == [(i, i) for i in range(1000)]


def test_global_average_rank(spark):
    values = [3, 1, 2, 2, 5, 5, 5]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    got = sorted((r["v"], r["r"]) for r in R.global_average_rank(df, "v", "r").collect())
    assert got == sorted(zip(values, average_ranks(values), strict=True))


def test_top_k_is_exact_and_pruned_early(spark):
    df = spark.createDataFrame([(u, i, float(i % 3)) for u in (1, 2) for i in range(9)], "u int, i int, s double")
    top = R.top_k(df, ["u"], [F.desc("s"), F.col("i").asc()], 4)
    assert {(r["u"], r["i"], r["rank"]) for r in top.collect()} == {(u, i, n) for u in (1, 2) for i, n in ((2, 1), (5, 2), (8, 3), (1, 4))}
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_normalized_zero_vector_stays_zero(spark):
    df = spark.createDataFrame([(1, "a", 3.0), (1, "b", 4.0), (2, "a", 0.0)], "k int, feature string, value double")
    assert sorted((r["k"], r["feature"], r["value"]) for r in V.normalized(df, "k").collect()) == [(1, "a", 0.6), (1, "b", 0.8), (2, "a", 0.0)]


def test_hand_computed_metrics(spark):
    hits = {1: ([1, 0, 0, 0], 2), 2: ([0, 0, 0, 0], 3), 3: ([0, 0, 0, 1], 1), 4: ([1, 0, 1, 0], 5)}
    lists, wanted = [], []
    for user, (row, n) in hits.items():
        lists += [(user, 100 * user + r, r + 1) for r in range(4)]
        own = [100 * user + r for r in range(4) if row[r]]
        wanted += [(user, i) for i in own + [100 * user + 50 + x for x in range(n - len(own))]]
    got = {r["user_id"]: r for r in E.user_metrics(spark.createDataFrame(lists, "user_id int, item_id int, rank long"), spark.createDataFrame(wanted, "user_id int, item_id int"), 4).collect()}
    assert [got[u]["precision"] for u in (1, 2, 3, 4)] == [0.25, 0, 0.25, 0.5]
    assert [got[u]["recall"] for u in (1, 2, 3, 4)] == [0.5, 0, 1, 0.4]
    assert [got[u]["mrr"] for u in (1, 2, 3, 4)] == [1, 0, 0.25, 1]
    ideal = sum(1 / np.log2(r + 1) for r in range(1, 5))
    assert np.allclose([got[u]["ndcg"] for u in (1, 2, 3, 4)], [1 / (1 + 1 / np.log2(3)), 0, 1 / np.log2(5), 1.5 / ideal])


def test_comparison_of_equal_and_shifted(spark):
    a = spark.createDataFrame([(u, 0.1 * u) for u in range(5)], "user_id int, ndcg double")
    same = E.compared(a, a, "ndcg").first()
    assert (same["difference"], same["wins"], same["ties"], same["losses"]) == (0.0, 0, 5, 0)
    assert (same["low"], same["high"], same["distinguishable"]) == (0.0, 0.0, False)
    more = E.compared(a.withColumn("ndcg", F.col("ndcg") + 0.05), a, "ndcg").first()
    assert abs(more["difference"] - 0.05) < 1e-12 and more["wins"] == 5
    assert abs(more["lift"] - 0.25) < 1e-9
    assert np.allclose([more["low"], more["high"]], 0.05) and more["distinguishable"]
    none = E.compared(a.limit(0), a, "ndcg").first()
    assert (none["n_users"], none["difference"], none["distinguishable"]) == (0, 0.0, False)


def test_bootstrap_of_constant_and_empty(spark):
    flat = spark.createDataFrame([(u, 0.3) for u in range(40)], "user_id int, ndcg double")
    one = E.bootstrap(flat, "ndcg", 50).first()
    assert np.allclose([one["mean"], one["low"], one["high"]], 0.3)
    assert E.bootstrap(flat.limit(0), "ndcg", 50).first()["mean"] == 0.0


def test_numbers_of_many_rows_with_other_columns(spark):
    rows = spark.range(400_000).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("x"), F.expr("repeat('p', 20)").alias("payload"), "id")
    got = R.numbered(rows, [F.col("x").asc(), F.col("id").asc()], "n")
    one = got.agg(F.count("*"), F.countDistinct("n"), F.min("n"), F.max("n")).first()
    assert tuple(one) == (400_000, 400_000, 0, 399_999)
    from pyspark.sql.window import Window

    wrong = got.where("n < 1000").withColumn("m", F.row_number().over(Window.orderBy("x", "id")) - 1).where("m <> n")
    assert wrong.count() == 0


def test_exact_percentile(spark):
    values = [3.0, 1.0, 4.0, 1.5, 9.0, None]
    got = R.exact_percentile(spark.createDataFrame([(v,) for v in values], "v double"), "v", 0.95).first()[0]
    assert abs(got - np.percentile([v for v in values if v is not None], 95)) < 1e-12


def test_first_unseen_equals_whole_pools(spark):
    draw = np.random.default_rng(4)
    scores = spark.createDataFrame([(c, i, float(draw.integers(0, 6))) for c in (0, 1) for i in range(40)], "config int, item_id long, score double")
    seen = spark.createDataFrame([(u, int(i)) for u in range(8) for i in draw.choice(40, 5 * u, replace=False)], "user_id long, item_id long")
    users = spark.createDataFrame([(u,) for u in range(9)], "user_id long")
    got = {(r["config"], r["user_id"], r["rank"], r["item_id"]) for r in E.first_unseen(users, seen, scores, 6).collect()}
    want = set()
    for c in (0, 1):
        pool = hybrid.pool(users, scores.select("item_id").distinct(), seen).join(scores.where(F.col("config") == c), "item_id")
        want |= {(c, r["user_id"], r["rank"], r["item_id"]) for r in E.recommended(pool, seen, 6).collect()}
    assert got == want


def test_pairs_of_heavy_users(spark):
    rows = [(u, i, 5.0) for u in range(4) for i in range(600 if u == 0 else 5 * u)]
    got = {(r["i"], r["j"]): r["n_ij"] for r in itemcf.cooccurrence(spark.createDataFrame(rows, "user_id long, item_id long, rating double")).collect()}
    assert len(got) == 600 * 599 // 2 and got[(0, 1)] == 4 and got[(5, 6)] == 3 and got[(20, 599)] == 1


def test_scores_with_dense_and_rare_features(spark):
    draw = np.random.default_rng(8)
    users, items = ({(k, f): float(draw.normal()) for k in range(12) for f in range(30) if f < 2 or draw.random() < 0.1} for _ in range(2))
    frames = [spark.createDataFrame([(k, f"f{f}", v) for (k, f), v in own.items()], f"{name} long, feature string, value double") for own, name in ((users, "user_id"), (items, "item_id"))]
    got = {(r["user_id"], r["item_id"]): r["score"] for r in content.scores(*frames).collect()}
    for u in range(12):
        for i in range(12):
            assert abs(got[(u, i)] - sum(v * items.get((i, f), 0.0) for (k, f), v in users.items() if k == u)) < 1e-9


def test_adoption_rule(spark):
    kind = "k int, tail int, difference double, low double, high double"
    good = [(k, tail, 0.1, 0.05, 0.2) for k in (3, 5, 10, 20) for tail in (0, 1)]
    rule = lambda rows: tuple(tuning.adopted(spark.createDataFrame(rows, kind)).first())
    assert rule(good) == (True, False, True)
    assert rule([*good[:2], (5, 0, -0.1, -0.2, -0.05), *good[3:]]) == (True, True, False)
    assert rule([(k, t, 0.01, -0.01, 0.03) for k, t, *_ in good]) == (False, False, False)


@pytest.mark.parametrize("share", [0.05, 0.9])
def test_best_blends_equal_the_pool(spark, share):
    draw = random.Random(share)
    users, items, k = range(12), range(60), 9
    popularity = spark.createDataFrame([(i, float(draw.choice([0, 0, 1, 2, 5, 9]))) for i in items], "item_id long, popularity double")
    excluded = spark.createDataFrame([(u, i) for u in users for i in draw.sample(items, 58 if u == 3 else 59 if u == 4 else 5)] + [(0, 900)], "user_id long, item_id long")
    rows = lambda: spark.createDataFrame([(u, i, float(draw.choice([0.0, 0.25, 0.5, 0.75]))) for u in users for i in items if draw.random() < share], "user_id long, item_id long, score double")
    scores, w = {"content": rows(), "cf": rows()}, {"content": 0.2, "cf": 0.7, "popularity": 0.1}
    pool = hybrid.pool(excluded.select("user_id").distinct(), popularity, excluded)
    for part, own in scores.items():
        pool = pool.join(own.withColumnRenamed("score", part), ["user_id", "item_id"], "left")
    pool = pool.join(popularity, "item_id").fillna(0.0, list(scores))
    want = {(r["user_id"], r["rank"]): r for r in hybrid.ranked(hybrid.blended(pool, list(w.values())), k).collect()}
    got = {(r["user_id"], r["rank"]): r for r in hybrid.best_blends(scores, popularity, excluded, w, k).collect()}
    assert set(got) == set(want)
    for x, r in want.items():
        assert got[x]["item_id"] == r["item_id"] and got[x]["score"] == pytest.approx(r["score"])
        assert all(got[x][f"pct_{p}"] == pytest.approx(r[f"pct_{p}"]) for p in w)


def test_pair_hash_is_wrapping_64_bit_arithmetic(spark):
    ids = [0, 1, 2, 31, 65535, 65536, 2**31 - 1, 2**32, 2**62 + 12345, 2**63 - 1, -1, -(2**40)]
    rows = [(u, i) for u in ids for i in ids]
    mask = 2**64 - 1

    def expected(u, i, seed):
        h = (u * R.USER_FACTOR + i * R.ITEM_FACTOR + seed * R.SEED_FACTOR) & mask
        for shift, factor in R.ROUNDS:
            h = ((h ^ (h >> shift)) * factor) & mask
        return h - 2**64 if h >= 2**63 else h

    frame = spark.createDataFrame(rows, "u long, i long")
    for seed in (0, 42, 2**40):
        got = {(r["u"], r["i"]): r["tie"] for r in R.with_pair_hash(frame, "u", "i", seed=seed).collect()}
        assert got == {(u, i): expected(u, i, seed) for u, i in rows}
    assert R.with_pair_hash(spark.createDataFrame([(None, 1)], "u long, i long"), "u", "i").first()["tie"] is None


def test_lists_of_a_grid_do_not_depend_on_batches(spark):
    grid, k = [(0.0, 0.0, 1.0), (0.5, 0.5, 0.0), (0.2, 0.3, 0.5)], 5
    rows = [(u, i, (i * 7 % 4) / 4, (i * u % 3) / 3, (i % 2) * 1.0) for u in (1, 2, 3) for i in range(1, 3 + u * 20)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, pct_content double, pct_cf double, pct_popularity double")
    want = set()
    for u in (1, 2, 3):
        for n, w in enumerate(grid):
            order = sorted((-round(sum(a * b for a, b in zip(w, r[2:])), 9), r[1] * R.KNUTH & 4294967295, r[1]) for r in rows if r[0] == u)
            want |= {(n, u, item, place + 1) for place, (_, _, item) in enumerate(order[:k])}
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        for most in ("3", "10000"):
            spark.conf.set(size, most)
            assert {tuple(r) for r in tuning.weighted_lists(df, grid, k).select("config", "user_id", "item_id", "rank").collect()} == want
    finally:
        spark.conf.set(size, before)
    assert tuning.weighted_lists(df.where("user_id < 0"), grid, k).count() == 0


def test_marked_lists_tell_the_metrics_of_whole_lists(spark):
    draw = np.random.default_rng(11)
    rows = spark.createDataFrame([(u, i, float(draw.integers(0, 5)), float(draw.integers(0, 5))) for u in range(6) for i in range(25)], "user_id long, item_id long, pct_a double, pct_b double")
    wanted = spark.createDataFrame([(u, int(i), u % 2) for u in range(5) for i in draw.choice(25, 4, replace=False)], "user_id long, item_id long, cohort int")
    grid = [(1.0, 0.0), (0.5, 0.5), (0.0, 1.0)]
    whole = tuning.weighted_lists(rows, grid, 3, ("a", "b"))
    marked = tuning.weighted_lists(rows, grid, 3, ("a", "b"), wanted=wanted)
    assert marked.count() == 6 * 3  # a row a list, with or without a hit
    told = [{(r["config"], r["user_id"]): (r["cohort"], round(r["ndcg"], 12), r["hit"]) for r in tuning.user_ndcg(x, wanted, 3).collect()} for x in (whole, marked)]
    assert len(told[0]) == 15 and told[0] == told[1]
