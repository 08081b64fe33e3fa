"""Operator 9: shards of near-equal bytes by best-fit-decreasing bin packing.

Equal texts form groups that no shard border may part. Groups are packed by size: sorted by
size, each enters the bin with the tightest remaining capacity that holds it, found in a
balanced tree, and the smallest capacity that needs no more than the wanted number of bins
is searched by bisection. Groups of one size are alike, so the driver needs only how many
there are of each; sizes beyond FINE bytes are rounded up by less than a thousandth, so
there are at most some tens of thousands of sizes, whatever the input. Each size then has
a list of bins with numbers of groups, and groups are numbered within their size.

No size, group or shard meets in one task: what is numbered is cut into cells by a hash, whose
counts give each cell its first number, and rows are numbered within their cell only. Groups
of many rows, a thousand at most, are told to their rows by a broadcast, and the others by
a join.

Cases: a null text has no bytes and joins the group of empty texts; repeated rows
get slots of their own; of groups of one size the order is that of their hash; an empty
table gives an empty table; with fewer groups than shards some shards stay empty; a group
larger than a shard fills one alone and the others share the rest evenly.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table

FINE = 2048
HEAVY = 1000
CELL_ROWS = 500
CELLS = 20_000  # cells at most, beside one for each size or shard


class CapacityTree:
    """A balanced search tree (treap) of the remaining capacities of bins."""

    def __init__(self, seed: int = 7):
        self.root, self.draw = None, random.Random(seed)

    @staticmethod
    def _rotated(node, side):
        child, other = node[side], 5 - side
        node[side], child[other] = child[other], node
        return child

    def add(self, key: tuple[int, int]) -> None:
        def put(node):
            if node is None:
                return [key, self.draw.random(), None, None]
            side = 2 if key < node[0] else 3
            node[side] = put(node[side])
            return self._rotated(node, side) if node[side][1] < node[1] else node

        self.root = put(self.root)

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns the smallest (remaining, bin) of at least `least`."""
        found, node = None, self.root
        while node is not None:
            if node[0][0] >= least:
                found, node = node[0], node[2]
            else:
                node = node[3]
        if found is not None:
            self.root = self._without(self.root, found)
        return found

    def _without(self, node, key):
        if key < node[0]:
            node[2] = self._without(node[2], key)
        elif key > node[0]:
            node[3] = self._without(node[3], key)
        elif node[2] is None or node[3] is None:
            return node[2] or node[3]
        else:
            side = 2 if node[2][1] < node[3][1] else 3
            node = self._rotated(node, side)
            node[5 - side] = self._without(node[5 - side], key)
        return node


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int]]:
    """(size, bin, how many), in the order of packing, for (size, how many) groups and bins of a
    fixed capacity; a larger group gets a bin of its own. A bin that is the tightest for one
    group of a size stays so for the next, as long as it holds it."""
    tree, bins, out = CapacityTree(), 0, []
    for size, left in sorted(sizes, reverse=True):
        while left:
            found = tree.take(size)
            if found is None:
                found, bins = (max(capacity, size), bins), bins + 1
            n = min(left, found[0] // size)
            left -= n
            out.append((size, found[1], n))
            tree.add((found[0] - n * size, found[1]))
    return out


def fewest(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """Bins of the smallest capacity, to a ten-thousandth, by which best-fit-decreasing needs
    no more than `shards` bins."""
    total = sum(size * n for size, n in sizes)
    low, step = max(1, total // shards), max(1, total // shards // 10_000)
    high, best = low, None
    while best is None:  # from an even share upwards
        found = best_fit_decreasing(sizes, high)
        if max(b for _, b, _ in found) < shards:
            best = found
        else:
            low, high = high + 1, high + max(step, (high - total // shards) * 2)
    while high - low > step:
        middle = (low + high) // 2
        found = best_fit_decreasing(sizes, middle)
        if max(b for _, b, _ in found) < shards:
            best, high = found, middle
        else:
            low = middle + 1
    return best


def _numbered(df: DataFrame, by: str, order: list[str], hashed: Column, out: str) -> DataFrame:
    """Rows numbered from 0 within each value of `by`, cell by cell."""
    cells = F.greatest(F.lit(1), F.ceil(F.col("__rows") / F.greatest(F.lit(CELL_ROWS), F.ceil(F.col("__all") / CELLS))).cast("int"))
    sizes = df.groupBy(by).agg(F.count("*").alias("__rows"))
    sizes = sizes.join(F.broadcast(sizes.agg(F.sum("__rows").alias("__all"))), F.lit(True))  # one row
    df = df.join(F.broadcast(sizes), by).withColumn("__cell", F.pmod(hashed, cells)).drop("__rows", "__all")  # one row a size or shard
    counts = df.groupBy(by, "__cell").agg(F.count("*").alias("__n"))  # at most CELLS beside those
    first = counts.select(by, "__cell", (F.sum("__n").over(Window.partitionBy(by).orderBy("__cell")) - F.col("__n")).alias("__first"))
    within = F.row_number().over(Window.partitionBy(by, "__cell").orderBy(*order)) - 1
    return df.join(F.broadcast(first), [by, "__cell"]).withColumn(out, (F.col("__first") + within).cast("long")).drop("__cell", "__first")


def _rounded(size: Column) -> Column:
    """Sizes up to FINE as they are, larger ones up to eleven binary digits."""
    grain = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.floor(F.log2(size.cast("double") / FINE)) + 1)).cast("long")
    return (F.ceil(size / grain) * grain).cast("long")


def shard(df: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: key, size, text_crc32, shard and slot."""
    spark = df.sparkSession
    own = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("key"), (F.octet_length(own) + 1).cast("long").alias("size"), F.crc32(own).alias("text_crc32"), F.unhex(F.sha2(own, 256)).alias("group"), F.monotonically_increasing_id().alias("row"))
    rows = stored(rows, "shard-rows")
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    groups = stored(_numbered(groups.withColumn("class", _rounded(F.col("bytes"))), "class", ["group"], F.xxhash64("group"), "nth"), "groups")
    sizes = [(r["class"], r["n"]) for r in groups.groupBy("class").agg(F.count("*").alias("n")).collect()]  # some tens of thousands at most
    plan: dict[int, list] = {}
    for size, bin_, n in fewest(sizes, shards) if sizes else []:
        own_ = plan.setdefault(size, [])
        own_.append(((own_[-1][0] if own_ else 0) + n, bin_))
    plan = spark.createDataFrame(list(plan.items()), "class long, bins array<struct<upto: long, shard: int>>")
    placed = groups.join(F.broadcast(plan), "class").select("group", "rows", F.get(F.filter("bins", lambda b: F.col("nth") < b["upto"]), 0)["shard"].alias("shard"))
    placed = stored(placed, "placed")
    heavy = placed.where(F.col("rows") >= F.lit(max(2, -(-rows.count() // HEAVY)))).select(F.col("group"), F.col("shard").alias("heavy"))
    told = rows.join(F.broadcast(heavy), "group", "left")
    light = told.where("heavy IS NULL").join(placed.select("group", "shard"), "group")
    told = told.where("heavy IS NOT NULL").withColumn("shard", F.col("heavy")).unionByName(light)
    told = stored(told.select("key", "size", "text_crc32", "row", "shard"), "told")
    return _numbered(told, "shard", ["row"], F.xxhash64("row"), "slot").select(F.col("key").alias(key), "size", "text_crc32", "shard", "slot")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op9_sharding": op9_sharding}
ORACLES: dict[str, str] = {}
