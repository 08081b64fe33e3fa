import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["m1_most_liked", "a1_item_stats", "it1_k_core", "w3_temporal_split", "k3_neighbors", "e2_user_metrics", "q1_home", "m15_reason_codes", "a22_content_hash", "sc4_display_title", "sc4_item_titles", "e10_bootstrap", "e11_compare", "g1_popularity_grid", "g4_cf_grid", "g7_simplex_grid", "m16_similarity_threshold", "k12_tie_ranks"]


def plain(value):
    return round(value, 6) if isinstance(value, float) else tuple(value) if isinstance(value, list) else value


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["item_id", "score", "rank"] and df.count() == 10


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    rows = sorted(tuple(map(plain, r)) for r in want.fetchall())
    got = entry.queries()[name](spark, sf_dir).select(*columns)
    assert sorted(tuple(map(plain, r)) for r in got.collect()) == rows


def test_streaming_counts(spark, sf_dir, tmp_path):
    from pyspark.sql import functions as F

    from rankloom.streaming.counts import item_counts

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kept = events.select(F.col("ts").cast("timestamp").alias("ts"), F.get_json_object("props", "$.k").alias("item_id"))
    kept.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kept.schema).parquet(str(tmp_path / "in"))
    run = item_counts(stream).writeStream.outputMode("complete").format("memory").queryName("item_counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("item_counts").agg(F.sum("n")).first()[0] == events.count()
