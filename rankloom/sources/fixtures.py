"""The tables of the star schema as ratings, items, vectors and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
# fixed values: what an event says about an item
EVENT_RATING = {"purchase": 5.0, "signup": 4.5, "click": 4.0, "view": 3.0, "error": 1.0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide and sparse: customers rate parts, with many tied times."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.expr(f"timestampdiff(SECOND, {EPOCH}, o_orderdate)").alias("ts"))
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rating = F.ceil(F.col("l_quantity") / 5) / F.lit(2.0)
    return both.groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id")).agg(F.max(rating).alias("rating"), F.max("ts").alias("ts"))


def ratings_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small and dense: users and the items of their events, with unique times."""
    events = table(spark, sf_dir, "events")
    rating = F.lit(None).cast("double")
    for kind, value in EVENT_RATING.items():
        rating = F.when(F.col("event_type") == kind, F.lit(value)).otherwise(rating)
    rows = events.select("user_id", F.get_json_object("props", "$.k").cast("long").alias("item_id"), rating.alias("rating"), F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, ts)").alias("ts"))
    return rows.groupBy("user_id", "item_id").agg(F.max("rating").alias("rating"), F.max("ts").alias("ts"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    year = F.when(F.col("p_size") % 17 != 0, F.col("p_size") + 1950)
    return part.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.split("p_name", " ").alias("genres"), year.alias("year"), F.col("p_type").alias("kind"), F.col("p_retailprice").alias("price"))


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense vectors of some items."""
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return items(spark, sf_dir).select("item_id").join(own, "item_id")


def item_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return items(spark, sf_dir).select("item_id").join(docs, "item_id")


def enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with the page that may hold their poster."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("item_id"), F.col("url").alias("poster"))
    return items(spark, sf_dir).join(pages, "item_id", "left")


# the same tables in SQL, as common table expressions
CTE = {
    "ra": "ra AS (SELECT o_custkey AS user_id, l_partkey AS item_id, max(ceil(l_quantity / 5) / 2) AS rating, max(CAST(epoch(o_orderdate) AS BIGINT)) AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)",
    "rb": "rb AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, max(CAST(CASE event_type WHEN 'purchase' THEN 5.0 WHEN 'signup' THEN 4.5 WHEN 'click' THEN 4.0 WHEN 'view' THEN 3.0 WHEN 'error' THEN 1.0 END AS DOUBLE)) AS rating, max(epoch_us(ts)) AS ts FROM events GROUP BY 1, 2)",
    "items": "items AS (SELECT p_partkey AS item_id, p_name AS title, string_split(p_name, ' ') AS genres, CASE WHEN p_size % 17 <> 0 THEN p_size + 1950 END AS year, p_type AS kind, p_retailprice AS price FROM part)",
    "vectors": "vectors AS (SELECT p_partkey AS item_id, embedding FROM part JOIN embeddings ON vec_id = p_partkey)",
    "enrichment": "enrichment AS (SELECT items.*, url AS poster FROM items LEFT JOIN pages ON page_id = item_id)",
}


def with_(*names: str, more: str = "") -> str:
    return "WITH " + ", ".join([*(CTE[n] for n in names), *([more] if more else [])]) + " "
