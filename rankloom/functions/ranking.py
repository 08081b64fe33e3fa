"""Tie hashes, exact top-k and rank percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.files import stored

KNUTH = 2654435761  # fixed value: the multiplier of the tie hash


def tie_hash(key: Column) -> Column:
    """A fixed scrambling of an id that orders ties."""
    return (key.cast("long") * F.lit(KNUTH)).bitwiseAND(F.lit(4294967295))


LOW = 4294967295  # the low half of 64 bits
# fixed values: factors of user, item and seed in the pair hash, then its rounds as (shift, factor)
USER_FACTOR, ITEM_FACTOR, SEED_FACTOR = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x517CC1B727220A95
ROUNDS = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1))


def _times(high: Column, low: Column, factor: int) -> tuple[Column, Column]:
    """The halves of a 64-bit word times a constant, modulo 2^64. Factors are taken in pieces
    of 16 bits, so that no product or sum leaves a signed long: the ANSI mode would raise."""
    b3, b2, b1, b0 = (F.lit(factor >> shift & 0xFFFF).cast("long") for shift in (48, 32, 16, 0))
    first, second = low * b0, low * b1
    under = first.bitwiseAND(F.lit(LOW)) + F.shiftleft(second.bitwiseAND(F.lit(0xFFFF)), 16)
    over = F.shiftright(first, 32) + F.shiftright(second, 16) + F.shiftright(under, 32)
    for word, small, large in ((low, b2, b3), (high, b0, b1)):
        over = over + word * small + F.shiftleft((word * large).bitwiseAND(F.lit(0xFFFF)), 16)
    return over.bitwiseAND(F.lit(LOW)), under.bitwiseAND(F.lit(LOW))


def _halves(key: Column) -> tuple[Column, Column]:
    whole = key.cast("long")
    return F.shiftrightunsigned(whole, 32), whole.bitwiseAND(F.lit(LOW))


def with_pair_hash(df: DataFrame, user: str, item: str, out: str = "tie", seed: int = 42) -> DataFrame:
    """Adds the 64-bit tie hash of a user's item as a signed long: a sum of multiples, mixed by
    exclusive-or with its own shifts, in wrapping arithmetic. Each round is a column of its own,
    so that no expression grows with the rounds before. Null if an id is null."""
    (uh, ul), (ih, il) = _times(*_halves(F.col(user)), USER_FACTOR), _times(*_halves(F.col(item)), ITEM_FACTOR)
    start = seed * SEED_FACTOR % 2**64
    df = df.withColumns({"__uh": uh, "__ul": ul, "__ih": ih, "__il": il})
    low = F.col("__ul") + F.col("__il") + F.lit(start & LOW)
    high = F.col("__uh") + F.col("__ih") + F.lit(start >> 32) + F.shiftright(low, 32)
    df = df.withColumns({"__h": high.bitwiseAND(F.lit(LOW)), "__l": low.bitwiseAND(F.lit(LOW))})
    high, low = F.col("__h"), F.col("__l")
    for shift, factor in ROUNDS:
        beside = F.shiftright(low, shift).bitwiseOR(F.shiftleft(high, 32 - shift).bitwiseAND(F.lit(LOW)))
        df = df.withColumns({"__h": high.bitwiseXOR(F.shiftright(high, shift)), "__l": low.bitwiseXOR(beside)})
        if factor != 1:
            after = _times(high, low, factor)
            df = df.withColumns({"__h": after[0], "__l": after[1]})
    return df.withColumn(out, F.shiftleft(high, 32).bitwiseOR(low)).drop("__uh", "__ul", "__ih", "__il", "__h", "__l")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group in a total order, with their ranks from 1."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window).cast("long")).where(F.col(rank) <= k)


def average_rank(value: Column, by: list[str]) -> Column:
    """The rank of a value in its group; ties share the mean of their ranks."""
    ties = Window.partitionBy(*by, value)
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(ties) - 1) / F.lit(2.0)


def percentile_rank(value: Column, by: list[str]) -> Column:
    """(average rank - 1) / (n - 1); 1 in a group of one."""
    n = F.count("*").over(Window.partitionBy(*by))
    return F.when(n == 1, F.lit(1.0)).otherwise((average_rank(value, by) - 1) / F.nullif(n - 1, F.lit(0)))


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows in ranges of an order, with the number of their range as __part. They are
    stored: range borders come from a sample, and a second run may cut elsewhere."""
    return stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")


def numbered(df: DataFrame, order: list[Column], out: str = "idx") -> DataFrame:
    """All rows numbered from 0 in an order. Ranges of the order are numbered on their own
    and shifted by the sizes of those before, so that no task sees all rows; only
    the sizes, one a range, meet in one."""
    own = _ranged(df, order)
    sizes = own.groupBy("__part").agg(F.count("*").alias("__n"))
    shift = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__shift"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return own.join(F.broadcast(shift), "__part").withColumn(out, (within + F.col("__shift")).cast("long")).drop("__part", "__shift")


def exact_percentile(df: DataFrame, column: str, p: float, out: str = "threshold") -> DataFrame:
    """One row: the interpolated percentile of a column, from the one or two rows at its
    place in the order; null without a row."""
    own = stored(numbered(df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v")), [F.col("v").asc()], "i"), "ordered")
    at = (own.agg(F.count("*").alias("n")).first()["n"] - 1) * p
    beside = own.where(F.col("i").between(int(at), int(at) + (at > int(at))))
    low, high = F.min_by("v", "i"), F.max_by("v", "i")
    return beside.agg((low + (high - low) * (at - int(at))).alias(out))


def dense_index(df: DataFrame, key: str, out: str = "idx") -> DataFrame:
    """Ids numbered 0 to n - 1 in their order."""
    return numbered(df.select(key).distinct(), [F.col(key).asc()], out)


def global_average_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the rank of a column over all rows, from 1; ties share the mean of their ranks."""
    counts = df.groupBy(column).agg(F.count("*").alias("__ties"), F.min(F.lit(0)).alias("__zero"))
    ranged = _ranged(counts, [F.col(column).asc()])
    sizes = ranged.groupBy("__part").agg(F.sum("__ties").alias("__n"))
    shift = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__shift"))
    upto = F.sum("__ties").over(Window.partitionBy("__part").orderBy(column))
    ranks = ranged.join(F.broadcast(shift), "__part").select(column, (F.col("__shift") + upto - (F.col("__ties") - 1) / F.lit(2.0)).alias(out))
    return df.join(ranks, column)
