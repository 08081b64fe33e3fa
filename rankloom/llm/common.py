"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Hashable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import discard, stored

__all__ = ["ascii_lower", "bitmaps", "bound", "discard", "hold", "probed", "slices", "stored", "table"]

SLICE_BYTES = 1 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else, so that lengths and other letters stay."""
    return F.translate(text, UPPER, UPPER.lower())


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once a row: inside a lambda, an outer expression is
    computed anew for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


BITMAP_BITS = 32_768  # of bitmap_construct_agg


def bitmaps(cells: DataFrame) -> DataFrame:
    """(bucket, bitmap): the column `cell` of numbers from 0 as packed bits, 4 KB a bucket."""
    return cells.groupBy(F.floor(F.col("cell") / BITMAP_BITS).cast("long").alias("bucket")).agg(F.bitmap_construct_agg(F.col("cell") % BITMAP_BITS).alias("bitmap"))


def bit(bitmap: Column, cell: Column) -> Column:
    """Whether a cell is set in the bitmap of its bucket; false without a bitmap."""
    byte = F.ascii(F.decode(F.substring(bitmap, (F.shiftright(cell.bitwiseAND(F.lit(BITMAP_BITS - 1)), 3) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
    mask = F.element_at(F.array(*(F.lit(1 << n) for n in range(8))), (cell.bitwiseAND(F.lit(7)) + 1).cast("int"))
    return F.coalesce(byte.bitwiseAND(mask) != 0, F.lit(False))


def probed(df: DataFrame, filter_: DataFrame, cell: Column, hit: str, broadcast: bool) -> DataFrame:
    """Adds the column `hit`: whether a cell is set in (bucket, bitmap). Only the bit leaves
    the join."""
    own = filter_.select(F.col("bucket").alias("__bucket"), F.col("bitmap").alias("__bitmap"))
    df = df.withColumn("__cell", cell).withColumn("__bucket", F.floor(F.col("__cell") / BITMAP_BITS).cast("long"))
    df = df.join(F.broadcast(own) if broadcast else own, "__bucket", "left")
    return df.withColumn(hit, bit(F.col("__bitmap"), F.col("__cell"))).drop("__bucket", "__bitmap", "__cell")


_KEPT: dict[str, tuple] = {}


def hold(operator: str, key: Hashable, make: Callable):
    """What an operator keeps in a Python worker from one task to the next. A worker holds
    the state of one operator at a time: that of others goes."""
    found = _KEPT.get(operator)
    if found is None or found[0] != key:
        _KEPT.clear()
        found = _KEPT[operator] = (key, make())
    return found[1]


def slices(batches, rows: int = 200, size: int = SLICE_BYTES):
    """The rows of Arrow batches, so few at a time that they have at most `size` bytes, or
    one alone. What Arrow has freed goes back to the system after each batch."""
    for batch in batches:
        todo = [batch]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and (part.num_rows > rows or part.nbytes > size):
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            elif part.num_rows:
                yield part
        pa.default_memory_pool().release_unused()
