"""Operator 5: benchmark decontamination by a prefix-filtered set join (native).

An item is cut into windows of ten consecutive words; a shorter item is one window.
A window is the set of its shingles of three words (of fewer if the shortest window
is shorter). Shingles are ordered by rarity, that is by how often they occur in the
corpus. Exact containment asks for all shingles of a window, so a prefix of
one, the rarest, must occur in any document that holds the window: corpus
shingles are joined with these prefix shingles only. The position of the shingle
fixes where the window would begin; candidates that would begin before the first or
end after the last word of the document are dropped (the length and positional
bounds), and the words in place are compared with the window word by word.

The corpus is read twice as a stream of word positions: once to count how
often the benchmark's shingles occur, once to join. Both times it first meets a bitmap of
FILTER_BITS cells into which the benchmark's shingles fall;
what passes is a small part, and goes on as a hash, or as a hash, a place and
the few words around it. No document's words leave their task. A third scan counts
the words of each row, of which one number a row goes on.

Cases: null and empty texts have no words and are not hit; an item without words
matches nothing; items with equal windows are all reported; rows with one key and
different texts are told apart, rows that repeat both get a result each; an
empty benchmark hits nothing; other columns do not matter and pass through `decontaminate`.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, stored, table

NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NO_WORD_CASED = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # of a text that is not lower-cased
WINDOW = 10
SHINGLE = 3
FILTER_BITS = 1 << 27  # 16 MB
LONGS = 512  # in a row of the bitmap
BROADCAST_ROWS = 1_000_000  # of the rows that `decontaminate` drops


def words(text: Column) -> Column:
    """The words of a text: runs of digits, letters a to z and characters beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NO_WORD), "")


def item_windows(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(window, items, w): the distinct windows and the items that have them."""
    own = items.select(F.col(key).cast("string").alias("item"), words(F.col(text)).alias("words")).where(F.size("words") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (WINDOW - 1))))
    cut = own.select("item", "words", starts.alias("start")).select("item", F.slice("words", F.col("start"), F.lit(WINDOW)).alias("window"))
    return cut.groupBy("window").agg(F.collect_set("item").alias("items"))


def _shingle(words_: str, at: Column, size: int) -> Column:
    """The hash of the shingle that starts at the 0-based position `at`."""
    return F.xxhash64(*(F.get(words_, at + n) for n in range(size)))


def _bits(cells: DataFrame) -> DataFrame:
    """(__bucket, __longs): the column `cell` of numbers from 0 as bits of LONGS longs a row. A
    join hands on an array where it lies, while a binary value is copied for each row that meets it."""
    own = cells.select(F.shiftright("cell", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("cell").bitwiseAND(F.lit(63)).cast("int")).alias("bits"))
    own = own.select(F.floor(F.col("word") / LONGS).cast("long").alias("__bucket"), F.pmod("word", F.lit(LONGS)).cast("int").alias("word"), "bits")
    zeros = own.select("__bucket").distinct().select("__bucket", F.explode(F.sequence(F.lit(0), F.lit(LONGS - 1))).alias("word"), F.lit(0).cast("long").alias("bits"))
    words_ = own.unionByName(zeros).groupBy("__bucket", "word").agg(F.bit_or("bits").alias("bits"))
    ordered = F.array_sort(F.collect_list(F.struct("word", "bits")))
    return words_.groupBy("__bucket").agg(F.transform(ordered, lambda x: x["bits"]).alias("__longs"))


def _passing(stream: DataFrame, shingles: DataFrame) -> DataFrame:
    """Adds `hit`: whether the shingle of a position may be one of these."""
    bits = min(FILTER_BITS, 2 ** max(15, ceil(log2(64 * max(1, shingles.count())))))
    mask = F.lit(bits - 1).cast("long")
    filter_ = stored(_bits(shingles.select(F.col("shingle").bitwiseAND(mask).alias("cell")).distinct()), "filter")
    cell = F.col("shingle").bitwiseAND(mask)
    rows = stream.withColumn("__bucket", F.shiftright(cell, 6 + LONGS.bit_length() - 1))
    rows = rows.join(F.broadcast(filter_), "__bucket", "left")  # FILTER_BITS at most
    long_ = F.get("__longs", F.shiftright(cell, 6).bitwiseAND(F.lit(LONGS - 1)).cast("int"))
    hit = F.getbit(long_, cell.bitwiseAND(F.lit(63)).cast("int")) == 1
    return rows.withColumn("hit", F.coalesce(hit, F.lit(False))).drop("__bucket", "__longs")


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, print, text): print tells rows of one key apart by their text."""
    own = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("key"), F.xxhash64(own, F.lit(5)).alias("print"), own.alias("text"))


def _hits(docs: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str) -> DataFrame:
    """One row per (key, print): n_rows of the table, n_words, hit_words, items."""
    windows = stored(item_windows(items, item_key, item_text), "windows")
    shortest = windows.agg(F.coalesce(F.min(F.size("window")), F.lit(1))).first()[0]
    size = min(SHINGLE, shortest)

    own = windows.select("window", "items", F.posexplode(F.sequence(F.lit(0), F.size("window") - size)).alias("offset", "__at"))
    own = stored(own.select("window", "items", "offset", _shingle("window", F.col("offset"), size).alias("shingle")), "shingles")
    stream = _rows(docs, key, text).select("key", "print", words(F.col("text")).alias("words"))
    stream = stream.select("key", "print", "words", F.posexplode_outer("words").alias("at", "__word"))
    stream = stream.select("key", "print", "words", "at", F.when(F.col("at") <= F.size("words") - size, _shingle("words", F.col("at"), size)).alias("shingle"))

    counted = _passing(stream.select("shingle").where("shingle IS NOT NULL"), own).where("hit").groupBy("shingle").agg(F.count("*").alias("n"))
    ranked = own.join(counted, "shingle", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    least = F.min(F.struct("n", "shingle", "offset")).alias("least")
    prefix = stored(ranked.groupBy("window", "items").agg(least).where("least.n > 0").select("window", "items", F.col("least.shingle").alias("shingle"), F.col("least.offset").alias("offset")), "prefixes")

    # the words around a shingle hold any window that it is the prefix of
    start = F.greatest(F.col("at") - (WINDOW - size), F.lit(0))
    around = F.slice("words", start + 1, F.lit(2 * WINDOW - size))
    near = _passing(stream, prefix)
    found = near.where("hit").select("key", "print", "shingle", "at", start.alias("start"), around.alias("around")).join(prefix, "shingle")
    begin, length = F.col("at") - F.col("offset") - F.col("start"), F.size("window")
    holds = (begin >= 0) & (begin + length <= F.size("around"))
    match = F.when(holds, F.slice("around", F.when(holds, begin + 1).otherwise(1), F.when(holds, length).otherwise(1)) == F.col("window")).otherwise(False)
    spans = found.where(match).groupBy("key", "print").agg(F.collect_set(F.struct((F.col("start") + begin).alias("start"), length.alias("length"))).alias("spans"), F.collect_set("items").alias("items"))
    sizes = _rows(docs, key, text).select("key", "print", F.size(F.array_remove(F.split("text", NO_WORD_CASED), "")).cast("long").alias("n_words")).groupBy("key", "print").agg(F.count("*").alias("n_rows"), F.first("n_words").alias("n_words"))
    # pairs of keys that may be null
    both = sizes.join(spans.withColumnsRenamed({"key": "__key", "print": "__print"}), (F.col("print") == F.col("__print")) & F.col("key").eqNullSafe(F.col("__key")), "left")
    at = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))
    none = F.array().cast("array<int>")
    return both.select("key", "print", "n_rows", "n_words", F.coalesce(F.array_distinct(at), none).alias("hit_words"), F.coalesce(F.sort_array(F.array_distinct(F.flatten("items"))), F.array().cast("array<string>")).alias("items"))


def hits(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: key, n_words, hit_words (positions of hit words), items."""
    found = _hits(docs, items, key, text, item_key, item_text)
    each = found.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    return each.select(F.col("key").alias(key), "n_words", "hit_words", "items")


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without any benchmark window, with all their columns."""
    hit = stored(_hits(docs, items, key, text, "item_id", "text").where(F.size("hit_words") > 0).select(F.col("key").alias("__key"), F.col("print").alias("__print")), "hit")
    own = docs.withColumn("__own", F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.lit(5)))
    hit = F.broadcast(hit) if hit.count() <= BROADCAST_ROWS else hit
    return own.join(hit, (F.col("__own") == F.col("__print")) & own[key].eqNullSafe(hit["__key"]), "left_anti").drop("__own")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hit_words").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


QUERIES = {"op5_decontaminate": op5_decontaminate}
ORACLES = {
    "op5_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
w AS (SELECT item, words[s : s + 9] AS win FROM (SELECT item, words, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS s FROM b WHERE len(words) > 0)),
lens AS (SELECT DISTINCT len(win) AS n FROM w),
o AS (SELECT doc_id, s, n, words[s : s + n - 1] AS win FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS s FROM d, lens WHERE len(words) >= n)),
m AS (SELECT DISTINCT doc_id, s, n, item FROM o JOIN w USING (win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)"""
}
