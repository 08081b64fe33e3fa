"""Typed CSV and Parquet sources, sinks, and the guards around held-out tables."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import schema as S
from ..functions import text as X

HELD_OUT = ("test", "cold_final")
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BROADCAST, ADAPTIVE_BROADCAST = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def _csv(spark: SparkSession, path: str, kind: T.StructType) -> DataFrame:
    return spark.read.schema(kind).option("header", True).option("escape", '"').csv(path)


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, S.RATINGS_CSV).toDF("user_id", "item_id", "rating", "ts")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items with their title, year and genres taken apart."""
    raw = _csv(spark, path, S.ITEMS_CSV).toDF("item_id", "raw_title", "genres")
    return raw.select(
        "item_id",
        X.clean_title(F.col("raw_title")).alias("title"),
        X.genre_list(F.col("genres")).alias("genres"),
        X.title_year(F.col("raw_title")).alias("year"),
        (F.trim("genres") == X.NO_GENRES).alias("no_genres_flag"),
        "raw_title",
    )


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    tags = _csv(spark, path, S.TAGS_CSV).toDF("user_id", "item_id", "tag", "ts")
    return tags.withColumn("tag", F.trim(F.coalesce("tag", F.lit("")))).where(F.length("tag") > 0)


def read_links(spark: SparkSession, path: str) -> DataFrame:
    links = _csv(spark, path, S.LINKS_CSV).toDF("item_id", "imdb_id", "tmdb_id")
    return links.select("item_id", "imdb_id", F.col("tmdb_id").cast("int").alias("tmdb_id"), F.col("tmdb_id").isNull().alias("tmdb_missing"))


def read_scores(spark: SparkSession, path: str, tags_path: str) -> DataFrame:
    """Item, tag and relevance, with the text of the tag."""
    scores = _csv(spark, path, S.SCORES_CSV).toDF("item_id", "tag_id", "relevance")
    return scores.join(_csv(spark, tags_path, S.SCORE_TAGS_CSV).toDF("tag_id", "tag"), "tag_id").select("item_id", "tag_id", "tag", "relevance")


def load(spark: SparkSession, config: S.DatasetConfig) -> S.Dataset:
    """The tables of a data set; optional ones by the flags of its configuration."""
    at = config.path.rstrip("/")
    return S.Dataset(
        read_ratings(spark, f"{at}/ratings.csv"),
        read_items(spark, f"{at}/movies.csv"),
        read_tags(spark, f"{at}/tags.csv") if config.has_tags else None,
        read_links(spark, f"{at}/links.csv") if config.has_links else None,
        read_scores(spark, f"{at}/genome-scores.csv", f"{at}/genome-tags.csv") if config.has_genome else None,
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local
    master gets one of its own where the setting is missing."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Written as Parquet to the shared folder and read again: cuts the lineage, survives lost
    executors and is compressed, unlike checkpoint(). The shuffle files of the query that
    wrote it are of no more use and go at its end, where the session allows it; a stored
    table that this one replaces goes too."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with shuffle_files_dropped(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    _note(out)
    if instead_of is not None:
        discard(instead_of)
    return out


_SCOPES = threading.local()


def _note(df: DataFrame) -> None:
    if getattr(_SCOPES, "open", None):
        _SCOPES.open[-1].append(df)


@contextlib.contextmanager
def temporary():
    """Tables that this thread stores within are deleted at the end, failed or not, but for those
    that are handed to what this yields; it returns them. An outer scope takes these over."""
    _SCOPES.open = [*getattr(_SCOPES, "open", []), []]
    kept = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        made = _SCOPES.open.pop()
        discard(*(df for df in made if not any(df is k for k in kept)))
        for df in kept:
            _note(df)


_SETTING = threading.Lock()
_SET_NOW: dict[tuple[str, ...], list] = {}


@contextlib.contextmanager
def _held(spark: SparkSession, settings: dict[str, str]):
    """While any query of the session is within, the settings have these values; the last one out
    puts the old ones back."""
    own = str(spark.sparkContext.applicationId) + spark._jsparkSession.sessionUUID(), *settings
    with _SETTING:
        inside = _SET_NOW.setdefault(own, [0, {k: spark.conf.get(k, None) for k in settings}])
        inside[0] += 1
        if inside[0] == 1:
            for k, value in settings.items():
                spark.conf.set(k, value)
    try:
        yield
    finally:
        with _SETTING:
            inside[0] -= 1
            if not inside[0]:
                for k, old in _SET_NOW.pop(own)[1].items():
                    spark.conf.unset(k) if old is None else spark.conf.set(k, old)


def shuffle_files_dropped(spark: SparkSession):
    """Shuffle files of a query that ends within go at its end."""
    return _held(spark, {CLEANUP: "true"})


def sized_in_memory(spark: SparkSession):
    """Queries that start within broadcast a table on purpose, or once its rows have been made and
    their size in memory is known. By the size of a file, ten megabytes of Parquet, which may be
    millions of ids, pass for a table to broadcast, and the driver collects them."""
    with _SETTING:
        most = spark.conf.get(ADAPTIVE_BROADCAST, None) or spark.conf.get(BROADCAST)
    return _held(spark, {BROADCAST: "-1", ADAPTIVE_BROADCAST: most})


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        path, table = getattr(df, "stored_at", None), getattr(df, "stored_table", None)
        if table:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def through_csv(df: DataFrame, name: str) -> str:
    """Writes df as CSV with a header; returns the path."""
    path = scratch(df.sparkSession, name)
    df.write.option("header", True).option("escape", '"').csv(path)
    return path


def allowed(split: str, final: bool = False, frozen: str | None = None) -> str:
    """The name of a split that may be read: held-out ones ask for `final`, and the test
    split for the id of a frozen configuration too."""
    if split in HELD_OUT and not final:
        raise PermissionError(f"{split} is held out; pass final=True for the one final evaluation")
    if split == "test" and not frozen:
        raise PermissionError("the test split is read with a frozen configuration only")
    return split


def assert_not_held_out(paths: list[str]) -> list[str]:
    """The same paths, unless one of them leads to held-out rows."""
    for path in paths:
        if any(f"{name}." in path or f"/{name}/" in path or path.endswith(f"/{name}") for name in HELD_OUT):
            raise PermissionError(f"{path} is held out")
    return paths


def upsert(cache: DataFrame, news: DataFrame, key: str, at: str) -> DataFrame:
    """The latest row of each key; a new row wins over an old one of the same time."""
    both = cache.withColumn("__new", F.lit(0)).unionByName(news.withColumn("__new", F.lit(1)))
    order = Window.partitionBy(key).orderBy(F.desc(at), F.desc("__new"))
    return both.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "__new")


def bucketed(df: DataFrame, name: str, key: str, buckets: int = 8) -> DataFrame:
    """Written to the shared folder as a table of buckets of a key, sorted within, and read
    again: tables of the same number of buckets join and group by the key without a shuffle.
    One shuffle puts each bucket into one file."""
    spark = df.sparkSession
    path, table = scratch(spark, name), f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key)
    writer.option("path", path).saveAsTable(table)
    out = spark.table(table)
    out.stored_at, out.stored_table = path, table
    _note(out)
    return out


@dataclass(frozen=True)
class KeyedTable:
    """Parquet files in one folder a bucket of a key's hash, of which an upsert rewrites only
    those that its keys fall into. `at` tells how new a row is."""

    path: str
    schema: T.StructType
    key: str
    at: str
    buckets: int = 64

    def _with_bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn("__bucket", F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int"))

    def create(self, df: DataFrame) -> KeyedTable:
        self._with_bucket(df).repartition(self.buckets, "__bucket").write.partitionBy("__bucket").parquet(self.path)
        return self

    def _all(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(T.StructType([*self.schema.fields, T.StructField("__bucket", T.IntegerType())])).parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._all(spark).drop("__bucket")

    def upsert(self, news: DataFrame) -> list[int]:
        """Merges new rows into their buckets; returns these. Other buckets are neither read nor
        written. The merged rows are stored first, so a job that fails while the folders
        are replaced can be run again from the same news."""
        spark = news.sparkSession
        own = stored(self._with_bucket(news), "news")
        touched = sorted(r[0] for r in own.select("__bucket").distinct().collect())  # at most as many as buckets
        if touched:
            old = self._all(spark).where(F.col("__bucket").isin(touched))
            merged = stored(upsert(old, own, self.key, self.at), "merged")
            merged.repartition(len(touched), "__bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__bucket").parquet(self.path)
            discard(merged)
        discard(own)
        return touched
