"""Operator 3: exact deduplication by two-pass Bloom filtering (native).

Pass one hashes every text into two cells of a Bloom filter and keeps, as packed
bitmaps, the cells that at least two rows set; for this two numbers a row are counted,
summed in each task before they shuffle. Pass two probes the filter with
each row's fingerprint: a row with a cell that nobody else set is certainly
unique and passes straight through. Only the rest, the true repeats and a few
false hits, shuffle and are grouped by SHA-256.

The text itself is read once; what is written, probed and shuffled are rows of
an id and a fingerprint. The filter has eight bits a row, so its size is known
before it is built: up to BROADCAST_BYTES it is broadcast, beyond that its bitmaps
are joined by their number, and of each only one bit goes on. Copies of one text may be
a third of all rows: they are counted by partial aggregation, and groups of over a
thousandth of the rows, a thousand at most, are told to their rows by a broadcast.
`deduplicate` then drops the rows of repeated texts that don't stay; whole rows shuffle
only where there are too many repeated texts to be broadcast.

Cases: a null text equals an empty one; rows that repeat an id and its text count
in group_size, and one of them is kept; an empty table gives an empty table;
other columns are passed through by `deduplicate` and do not matter to it.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, bitmaps, probed, stored, table

BITS_A_ROW = 8
BROADCAST_BYTES = 64 << 20
BROADCAST_ROWS = 500_000
HEAVY = 1000


def _cells(fingerprint: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(fingerprint, F.lit(seed)), F.lit(bits)) for seed in (1, 2)]


def repeated_cells(fingerprints: DataFrame, bits: int) -> DataFrame:
    """Pass one: the bitmaps (bucket, bitmap) of the cells that two rows or more set."""
    cells = fingerprints.select(F.explode(F.array_distinct(F.array(*_cells(F.col("fingerprint"), bits)))).alias("cell"))
    return bitmaps(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell"))


def maybe_repeated(df: DataFrame, filter_: DataFrame, bits: int, fingerprint: str = "fingerprint", maybe: str = "maybe") -> DataFrame:
    """Pass two: adds `maybe`, false only for rows whose fingerprint is certainly unique."""
    small = bits / 8 <= BROADCAST_BYTES
    for n, cell in enumerate(_cells(F.col(fingerprint), bits)):
        df = probed(df, filter_, cell, f"__hit{n}", small)
    return df.withColumn(maybe, F.col("__hit0") & F.col("__hit1")).drop("__hit0", "__hit1")


def _fingerprint(text: str) -> Column:
    return F.sha2(ascii_lower(F.coalesce(F.col(text), F.lit(""))), 256)


def _passes(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, int, int]:
    """The stored (key, row, fingerprint), the Bloom filter over it, its bits, the rows."""
    rows = stored(df.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), _fingerprint(text).alias("fingerprint")), "fingerprints")
    count = rows.count()
    bits = 2 ** max(15, ceil(log2(max(1, count) * BITS_A_ROW)))
    return rows, repeated_cells(rows, bits), bits, count


def _told(again: DataFrame, rows: int) -> DataFrame:
    """Of the rows that shuffle: what stays of each group. The groups of at least
    rows / HEAVY copies, which are HEAVY at most, are told by a broadcast, so that no
    task meets one of them whole; the others join by their fingerprint."""
    groups = again.groupBy("fingerprint").agg(F.max(F.struct("key", "row")).alias("keep"), F.count("*").alias("group_size"))
    heavy = groups.where(F.col("group_size") >= max(2, -(-rows // HEAVY)))
    told = again.join(F.broadcast(heavy), "fingerprint", "left")
    light = told.where("group_size IS NULL").drop("keep", "group_size").join(groups, "fingerprint")
    told = told.where("group_size IS NOT NULL").unionByName(light)
    return told.select("key", "row", F.col("keep.key").alias("keep_id"), "group_size", (F.struct("key", "row") == F.col("keep")).alias("kept"), "fingerprint")


def classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: the key, keep_id, group_size, kept and text_sha256. Of
    equal texts the largest key stays."""
    rows, filter_, bits, count = _passes(df, key, text)
    probed = maybe_repeated(rows, filter_, bits)
    straight = probed.where("not maybe").select("key", "row", F.col("key").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "fingerprint")
    told = _told(probed.where("maybe").drop("maybe"), count)
    return straight.unionByName(told).select(F.col("key").alias(key), "keep_id", "group_size", "kept", F.col("fingerprint").alias("text_sha256"))


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that stay, with all their columns. Of rows that repeat a key and its
    text, one stays."""
    rows, filter_, bits, count = _passes(df, key, text)
    told = _told(maybe_repeated(rows, filter_, bits).where("maybe").drop("maybe"), count)
    repeated = told.where("kept AND group_size > 1").select(F.col("fingerprint").alias("__fingerprint"), F.col("keep_id").alias("__keep"), F.col("group_size").alias("__size"))
    repeated = stored(repeated, "repeated")
    n = repeated.count()
    # the groups of many copies are few, so their rows never meet in one task
    heavy = repeated.where(F.col("__size") >= max(2, -(-count // HEAVY)) if n > BROADCAST_ROWS else F.lit(True)).drop("__size")
    own = df.withColumn("__own", _fingerprint(text)).join(F.broadcast(heavy), F.col("__own") == F.col("__fingerprint"), "left")
    if n > BROADCAST_ROWS:
        light = repeated.join(heavy.select("__fingerprint"), "__fingerprint", "left_anti").select(F.col("__fingerprint").alias("__other"), F.col("__keep").alias("__kept"))
        own = own.join(light, (F.col("__own") == F.col("__other")) & F.col("__fingerprint").isNull(), "left")
        own = own.withColumn("__keep", F.coalesce("__keep", "__kept")).withColumn("__fingerprint", F.coalesce("__fingerprint", "__other")).drop("__other", "__kept")
    stays = own.where(F.col("__fingerprint").isNotNull() & F.col(key).eqNullSafe(F.col("__keep"))).dropDuplicates([key, "__own"])
    return own.where("__fingerprint IS NULL").unionByName(stays).drop("__own", "__fingerprint", "__keep")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {"op3_exact_dedup": op3_exact_dedup}
ORACLES = {
    "op3_exact_dedup": """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)"""
}
