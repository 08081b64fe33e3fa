import random
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rankloom.functions import text
from rankloom.operators import content, itemcf, kcore, popularity, split, stats
from rankloom.schema import DatasetConfig, config
from rankloom.sources import files

RATINGS = "user_id int, item_id int, rating double, ts long"


def test_adapter_reads_typed_tables(spark, tmp_path):
    (tmp_path / "movies.csv").write_text('movieId,title,genres\n1,Toy Story (1995),Adventure|Animation\n2,"Matrix, The (1999)",Action\n3,No Year,(no genres listed)\n')
    (tmp_path / "ratings.csv").write_text("userId,movieId,rating,timestamp\n1,1,4.0,10\n1,2,3.5,11\n")
    (tmp_path / "links.csv").write_text("movieId,imdbId,tmdbId\n1,0114709,862\n2,0133093,\n")
    (tmp_path / "tags.csv").write_text("userId,movieId,tag,timestamp\n1,1, fun ,10\n1,2,,11\n")
    own = files.load(spark, DatasetConfig("tiny", str(tmp_path), has_genome=False))
    assert dict(own.ratings.dtypes) == {"user_id": "int", "item_id": "int", "rating": "float", "ts": "bigint"}
    items = {r["item_id"]: r for r in own.items.collect()}
    assert items[1]["year"] == 1995 and items[1]["genres"] == ["Adventure", "Animation"]
    assert items[2]["title"] == "Matrix, The" and items[3]["year"] is None and items[3]["no_genres_flag"]
    assert [(r["tmdb_id"], r["tmdb_missing"]) for r in own.links.orderBy("item_id").collect()] == [(862, False), (None, True)]
    assert [r["tag"] for r in own.tags.collect()] == ["fun"] and own.scores is None


def test_unknown_config():
    with pytest.raises(ValueError):
        config({}, "none")


def test_held_out_rows_are_guarded():
    with pytest.raises(PermissionError):
        files.allowed("test")
    with pytest.raises(PermissionError):
        files.allowed("test", final=True)
    with pytest.raises(PermissionError):
        files.assert_not_held_out(["/data/test.parquet"])
    assert files.allowed("val") == "val" and files.allowed("test", True, "v1") == "test"


def test_k_core_converges(spark):
    rows = [(u, i, 4.0, 1) for u in range(1, 5) for i in range(1, 5)] + [(9, 1, 4.0, 1), (1, 9, 4.0, 1)]
    core, passes = kcore.k_core(spark.createDataFrame(rows, RATINGS), 3, 3)
    assert core.count() == 16 and passes == 2
    empty, _ = kcore.k_core(spark.createDataFrame(rows, RATINGS), 30, 3)
    assert empty.count() == 0


def test_split_is_disjoint_ordered_and_sized(spark):
    rows = [(u, i, 4.0, i // 3) for u in (1, 2, 3) for i in range(25 * u)]
    got = split.temporal_split(spark.createDataFrame(rows, RATINGS))
    sizes = {(r["user_id"], r["split"]): r["count"] for r in got.groupBy("user_id", "split").count().collect()}
    assert [sizes[(u, "test")] for u in (1, 2, 3)] == [2, 5, 8] and [sizes[(u, "val")] for u in (1, 2, 3)] == [2, 5, 8]
    assert got.count() == len(rows)
    cut = split.boundary(got, "train", "val").collect()
    assert all(r["last_ts"] <= r["first_ts"] for r in cut)


def test_split_does_not_depend_on_partitions(spark):
    rows = [(u, i, 4.0, 0) for u in range(5) for i in range(20)]
    df = spark.createDataFrame(rows, RATINGS)
    seen = [sorted((r["user_id"], r["item_id"], r["split"]) for r in split.temporal_split(df.repartition(n)).collect()) for n in (1, 7)]
    assert seen[0] == seen[1]


def test_similarity_direction_and_neighbors(spark):
    rows = [(u, i, 5.0, 1) for u, items in {1: (1, 2), 2: (1, 2), 3: (1, 3), 4: (1,)}.items() for i in items]
    sims = {(r["i"], r["j"]): (r["sim"], r["n_ij"]) for r in itemcf.similarities(spark.createDataFrame(rows, RATINGS), 0.25, 1.0).collect()}
    assert sims[(1, 2)][1] == 2
    assert abs(sims[(1, 2)][0] - 2 / (4**0.25 * 2**0.75) * (2 / 3)) < 1e-12
    assert abs(sims[(2, 1)][0] - 2 / (2**0.25 * 4**0.75) * (2 / 3)) < 1e-12
    near = itemcf.neighbors(spark.createDataFrame(rows, RATINGS), k=1).collect()
    assert {(r["i"], r["j"]) for r in near} == {(1, 2), (2, 1), (3, 1)}


def test_profiles_of_the_three_item_catalogue(spark):
    vectors = spark.createDataFrame([(101, "Sci-Fi", 1.0), (102, "Drama", 1.0), (103, "Sci-Fi", 0.6), (103, "Drama", 0.8)], "item_id int, feature string, value double")
    ratings = spark.createDataFrame([(1, 101, 5.0, 1), (1, 102, 4.0, 2), (2, 101, 2.0, 1)], RATINGS)
    want = {"pos_mean": (0.7071, 0.7071), "rating_weighted": (0.78087, 0.6247), "centered": (0.7071, -0.7071)}
    for variant, (sci, drama) in want.items():
        got = {r["feature"]: r["value"] for r in content.profiles(ratings, vectors, variant).where("user_id = 1").collect()}
        assert abs(got["Sci-Fi"] - sci) < 1e-4 and abs(got["Drama"] - drama) < 1e-4
    profile = spark.createDataFrame([(7, "Sci-Fi", 0.6), (7, "Drama", 0.8)], "user_id int, feature string, value double")
    why = content.explained(profile, vectors.where("item_id = 103")).orderBy("rank").collect()
    assert [r["feature"] for r in why] == ["Drama", "Sci-Fi"]
    assert abs(why[0]["percent"] - 64) < 1e-9 and abs(sum(r["contribution"] for r in why) - 1) < 1e-9


def test_popularity_variants(spark):
    ratings = spark.createDataFrame([(1, 1, 5.0, 1), (2, 1, 2.0, 1), (1, 2, 4.0, 1)], RATINGS)
    items = spark.createDataFrame([(1,), (2,), (3,)], "item_id int")
    got = {r["item_id"]: r["score"] for r in popularity.popularity(ratings, items, "damped_mean", 1.0).collect()}
    mean = 11 / 3
    assert abs(got[1] - (7 + mean) / 3) < 1e-9 and abs(got[3] - mean) < 1e-9
    with pytest.raises(ValueError):
        popularity.popularity(ratings, items, "none")


def test_cf_plan_has_no_cross_product(spark):
    ratings = spark.createDataFrame([(1, 1, 5.0, 1), (1, 2, 5.0, 1)], RATINGS)
    plan = itemcf.cooccurrence(ratings)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_upsert_keeps_the_latest(spark):
    kind = "k int, at int, v string"
    got = files.upsert(spark.createDataFrame([(1, 5, "old"), (2, 5, "stay")], kind), spark.createDataFrame([(1, 5, "new"), (3, 1, "add")], kind), "k", "at")
    assert {(r["k"], r["v"]) for r in got.collect()} == {(1, "new"), (2, "stay"), (3, "add")}


def test_sampling_is_fixed(spark):
    users = spark.range(1000).select(F.col("id").alias("user_id"))
    parts = {r["part"]: r["count"] for r in split.cold_partition(users.limit(501)).groupBy("part").count().collect()}
    assert parts == {"dev": 250, "final": 251}


def test_cores_of_many_settings(spark):
    """Users, items, ratings and passes under each pair of thresholds, by hand; rows may repeat."""
    draw = random.Random(19)
    rows = [(int(draw.paretovariate(0.7)) % 40, int(draw.paretovariate(0.6)) % 50, 4.0, n) for n in range(700)]
    got = {(r["min_user"], r["min_item"]): r for r in kcore.threshold_grid(spark.createDataFrame(rows, RATINGS), (1, 4, 9, 500), (1, 5, 11)).collect()}
    assert len(got) == 12
    for (u, i), r in got.items():
        own, passes = rows, 0
        while True:
            before, passes = len(own), passes + 1
            for place, least in ((0, u), (1, i)):
                counts = Counter(x[place] for x in own)
                own = [x for x in own if counts[x[place]] >= least]
            if len(own) == before:
                break
        n_users, n_items = len({x[0] for x in own}), len({x[1] for x in own})
        assert (r["n_users"], r["n_items"], r["n_ratings"], r["passes"]) == (n_users, n_items, len(own), passes)
        assert r["density"] == pytest.approx(len(own) / (n_users * n_items) if own else 0) and r["sparsity"] == pytest.approx(1 - r["density"])


def test_validation_of_bad_tables(spark):
    ratings = spark.createDataFrame([(1, 10, 4.0, 800000000), (1, 10, 9.0, 800000001), (2, 99, 0.0, 5)], RATINGS)
    items = spark.createDataFrame([(10, 1990, ["a"]), (10, None, []), (11, 2000, None)], "item_id long, year int, genres array<string>")
    tags = spark.createDataFrame([(1, 10, "x"), (1, 98, "y"), (2, 98, "y")], "user_id long, item_id long, tag string")
    links = spark.createDataFrame([(10, 5), (97, None)], "item_id long, tmdb_id long")
    scores = spark.createDataFrame([(10, 1), (96, 2), (95, 2)], "item_id long, tag_id long")
    got = {r["check"]: (r["value"], r["percent"], r["valid"]) for r in stats.validation(ratings, items, tags, links, scores, spark.createDataFrame([(1,)], "tag_id long")).collect()}
    assert got["rating_low"] == (0.0, None, False) and got["rating_high"] == (9.0, None, False) and got["time_first"] == (5.0, None, False) and got["time_last"][2]
    assert got["duplicate_ratings"] == (1.0, None, False) and got["duplicate_items"] == (1.0, None, False) and got["orphan_rated_items"] == (1.0, None, False)
    assert got["year_failures"] == (1.0, 33.33, None) and got["no_genres"] == (2.0, 66.67, None)
    assert got["orphan_tags"] == (1.0, None, False) and got["unique_tags"][0] == 2 and got["orphan_links"][0] == 1 and got["missing_external"] == (1.0, 50.0, None)
    assert got["items_with_scores"][0] == 3 and got["orphan_score_items"][0] == 2 and got["orphan_score_tags"] == (1.0, None, False)
    few = {r["check"]: r["valid"] for r in stats.validation(ratings.limit(0), items.limit(0)).collect()}
    assert few["duplicate_ratings"] and few["orphan_rated_items"] and "rating_low" not in few


def test_folded_text(spark):
    rows = [("Été à la Plage",), ("ﬁn ½ Ⅳ ÅNGSTRÖM",), ("plain",), (None,), ("",), ("한글 ́",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(text.folded(F.col("t"))).collect()]
    assert got == ["ete a la plage", "fin 1⁄2 iv angstrom", "plain", None, "", unicodedata.normalize("NFKD", "한글 ")]


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_serving_tables_join_without_a_shuffle(spark):
    served = spark.createDataFrame([(i, f"item {i}") for i in range(40)], "item_id long, title string")
    vectors = spark.createDataFrame([(i, f, 1.0 + f) for i in range(30) for f in range(i % 4)] + [(99, 0, 1.0)], "item_id long, feature int, value double")
    popularity = spark.createDataFrame([(i, 10 * i) for i in range(20)], "item_id long, popularity long")
    features, names = content.serving_tables(served, vectors.withColumn("feature", F.col("feature").cast("string")), popularity, 4)
    near = files.bucketed(spark.createDataFrame([(i, "1 2") for i in range(10)], "i long, js string"), "neighbors", "i", 4)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        own = features.groupBy("item_id").agg(F.count("*").alias("n"))
        joined = names.join(own, "item_id", "left").join(near, F.col("item_id") == F.col("i"), "left")
        assert _exchanges(joined) == 0
        rows = {r["item_id"]: r for r in joined.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert set(rows) == set(range(40))
    assert rows[3]["n"] == 3 and abs(rows[3]["norm"] - (1 + 4 + 9) ** 0.5) < 1e-9 and rows[3]["popularity"] == 30 and rows[3]["js"] == "1 2"
    assert rows[4]["n"] is None and rows[4]["norm"] == 1.0 and rows[35]["popularity"] == 0 and rows[35]["title"] == "item 35"
    files.discard(features, names, near)
    assert not spark.catalog.tableExists(features.stored_table)


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    kind = "item_id long, fetched_at long, status string"
    old = spark.createDataFrame([(i, 100, "old") for i in range(200)], kind)
    cache = files.KeyedTable(str(tmp_path / "cache"), old.schema, "item_id", "fetched_at", 8).create(old)
    parts = lambda: {p.parent.name: {f.name for f in p.parent.glob("*.parquet")} for p in (tmp_path / "cache").glob("*/*.parquet")}
    before = parts()
    news = spark.createDataFrame([(5, 200, "new"), (5, 150, "older news"), (7, 50, "too late"), (900, 10, "fresh")], kind)
    touched = cache.upsert(news)
    after = parts()
    assert 0 < len(touched) <= 3
    assert {b for b in after if after[b] != before.get(b)} == {f"__bucket={b}" for b in touched}
    rows = {r["item_id"]: (r["fetched_at"], r["status"]) for r in cache.read(spark).collect()}
    assert rows == {i: (100, "old") for i in range(200)} | {5: (200, "new"), 900: (10, "fresh")}
    assert cache.upsert(news.limit(0)) == [] and parts() == after
    again = cache.upsert(news)
    assert again == touched and {r["item_id"]: r["status"] for r in cache.read(spark).collect()}[5] == "new"
    assert cache.read(spark).count() == 201


def test_upsert_into_an_empty_table_and_null_keys(spark, tmp_path):
    kind = "item_id long, fetched_at long, status string"
    none = spark.createDataFrame([], kind)
    cache = files.KeyedTable(str(tmp_path / "cache"), none.schema, "item_id", "fetched_at", 4).create(none)
    assert cache.read(spark).count() == 0
    cache.upsert(spark.createDataFrame([(1, 1, "a")], kind))
    cache.upsert(spark.createDataFrame([(None, 1, "none"), (None, 2, "none too")], kind))
    assert sorted((str(r[0]), r[1], r[2]) for r in cache.read(spark).collect()) == [("1", 1, "a"), ("None", 2, "none too")]


def test_tables_of_a_scope_go_at_its_end(spark):
    import os

    with files.temporary() as keep:
        kept, gone = keep(files.stored(spark.range(3).toDF("x"), "kept")), files.stored(spark.range(4).toDF("x"), "gone")
        with files.temporary() as inner:
            passed_on, lost = inner(files.stored(spark.range(5).toDF("x"), "passed-on")), files.stored(spark.range(6).toDF("x"), "lost")
        assert os.path.exists(gone.stored_at) and os.path.exists(passed_on.stored_at) and not os.path.exists(lost.stored_at)
    assert kept.count() == 3 and not os.path.exists(gone.stored_at) and not os.path.exists(passed_on.stored_at)
    with pytest.raises(RuntimeError), files.temporary():
        failed = files.stored(spark.range(7).toDF("x"), "failed")
        raise RuntimeError
    assert not os.path.exists(failed.stored_at)
