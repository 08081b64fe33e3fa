"""What is broadcast while a registered query is planned."""

from pyspark.sql import functions as F
from rankloom.plans import registry
from rankloom.sources import files


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_ids_in_a_small_file_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setitem(registry.QUERIES, "unused", None)
    seen, before = {}, spark.conf.get(files.BROADCAST)

    def job(spark, sf_dir):
        few = files.stored(spark.range(3_000_000).select((F.col("id") % 100).alias("item_id"), F.lit(1).alias("x")), "few-bytes")
        large = spark.range(100_000_000).select(F.col("id").alias("item_id"))
        seen["plan"] = _plan(large.join(few, "item_id"))
        seen["on purpose"] = _plan(large.join(F.broadcast(few.limit(3)), "item_id"))
        return few

    registry.query("unused")(job)
    registry.QUERIES["unused"](spark, "")
    assert "BroadcastHashJoin" not in seen["plan"] and "BroadcastHashJoin" in seen["on purpose"]
    assert spark.conf.get(files.BROADCAST) == before and spark.conf.get(files.ADAPTIVE_BROADCAST, None) is None
