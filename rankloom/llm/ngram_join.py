"""Operator 6: n-gram Jaccard join by PartEnum signatures.

The set of a document is its distinct word shingles. Sets of nearly equal size form a
band; a set that could pair with a larger one of the next band takes part in that band
too. Within a band, similar sets differ in at most k features. The feature domain is cut
into k // 2 + 1 + spare groups, each of three partitions. Two similar sets have two or
more differences in k // 2 groups at most; in each other group at most one of the three
partitions differs, so that the sets agree on two whole partitions: the contents of
each subset of two partitions of a group are a signature. A signature of two empty
partitions says nothing and is left out, which is safe for a set with at most `spare`
groups that have one. A set with more takes part again under the next seed, as does
every set that agrees with it on empty partitions only, until few enough are empty; sets
that no seed suits share one more signature. So each similar pair shares a signature.

All signatures shuffle once, and each meets its sets in one place; the few signatures that
over HOT of a bounded sample of sets have are told by a broadcast and summed before they
shuffle. Equal sets are one node. A signature that is shared by different sets
first pairs all of them with one hub only; pairs are verified on the sets. Where the
sets of a signature then lie in one component, nothing more can be learned from it.
The others go on with more hubs in each round, against sets of other components only,
until every pair that could join two components has been verified or ruled out.
Ruled out is a pair whose sizes differ too much, or whose parity sketches do: each
feature flips one of SKETCH bits, so two sketches differ in no more bits than the
sets in features. The join itself tests this, so a large group of near copies costs a
row for each member and for pairs close to the threshold, not for all pairs; the members
of a large signature are dealt to several tasks.

Nodes are 64-bit fingerprints of sets and shingles are 64-bit hashes; two different sets
of a billion documents share one with probability below 0.03. Tables that later steps
replace are deleted at once.

Cases: null texts and texts without words have an empty set and link with nothing; fewer
words than a shingle are one shingle; equal texts are linked; repeated rows are
one node; a row without an id is linked through equal texts that have one only; an
empty table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, slices, stored, table
from .components import components
from .shingles import mix, shingle_set

SIZE = 4
PERCENT = 85
BROADCAST_ROWS = 1_000_000
WIDER = 16  # how many times more hubs each round has
SKETCH = 512
SUBSETS = ((0, 1), (0, 2), (1, 2))
SEEDS = 64
SAMPLE = 20_000  # about so many sets tell which signatures are hot
HOT = 0.002  # of the sample; a signature near the limit may fall on either side, so the limit lies where few rows depend on it
TASK_MEMBERS = 2000


class Bands:
    """Bands of set sizes, and the groups of partitions of each."""

    def __init__(self, percent: int):
        self.percent, self.tops = percent, np.array(list(range(1, 9)), np.int64)
        while self.tops[-1] < 1 << 40:
            self.tops = np.append(self.tops, max(self.tops[-1] + 1, self.tops[-1] * 3 // 2 if percent >= 67 else self.tops[-1] * 100 // percent + 1))

    def differences(self, band: int) -> int:
        """How many features two similar sets of a band differ in at most."""
        return int((100 - self.percent) * 2 * int(self.tops[band]) // (100 + self.percent))

    def spare(self, band: int) -> int:
        weak = 0.027 * (self.differences(band) // 2 + 1)  # as many as the least set of a band has on average
        return ceil(weak + sqrt(weak)) if weak > 0.2 else 0

    def groups(self, band: int) -> int:
        return self.differences(band) // 2 + 1 + self.spare(band)

    def of(self, n: int) -> list[int]:
        """The bands in which a set of n features takes part."""
        band = int(np.searchsorted(self.tops, n))
        out = [band]
        while 100 * n >= self.percent * (int(self.tops[band]) + 1):
            band += 1
            out.append(band)
        return out


def fingerprint(features: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(features, 101).sum(dtype=np.uint64)]), len(features))[0])


def _named(sums: np.ndarray, band: int, seed: int) -> np.ndarray:
    """Signatures from the summed contents of subsets."""
    tag = mix(np.array([band * (SEEDS + 1) + seed], np.uint64), 3)[0]
    with np.errstate(over="ignore"):
        return mix(sums + mix(np.arange(len(sums), dtype=np.uint64) + tag, 11))


def signatures(features: np.ndarray, bands: Bands) -> np.ndarray:
    """The PartEnum signatures of a set."""
    out = []
    contents = mix(features, 7)
    for band in bands.of(len(features)):
        if not bands.differences(band):
            out.append(_named(contents.sum(dtype=np.uint64, keepdims=True), band, 0))
            continue
        groups, spare = bands.groups(band), bands.spare(band)
        for seed in range(SEEDS):
            at = (mix(features, 1000 + seed) % np.uint64(3 * groups)).astype(np.int64)
            sums = np.zeros(3 * groups, np.uint64)
            np.add.at(sums, at, contents)
            sums, full = sums.reshape(groups, 3), np.bincount(at, minlength=3 * groups).reshape(groups, 3) > 0
            with np.errstate(over="ignore"):
                pairs = np.stack([sums[:, x] + sums[:, y] for x, y in SUBSETS], axis=1)
            says = np.stack([full[:, x] | full[:, y] for x, y in SUBSETS], axis=1)
            out.append(_named(pairs.ravel(), band, seed)[says.ravel()])
            if int((~says).any(axis=1).sum()) <= spare:
                break
        else:
            out.append(_named(np.zeros(1, np.uint64), band, SEEDS))
    return np.concatenate(out)


def sketch(features: np.ndarray) -> np.ndarray:
    """The parity of how many features fall on each of SKETCH bits."""
    odd = np.bincount((mix(features, 77) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sets(docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """(key, print, n, fp, sketch, sigs) of each document; print is a hash of its text and fp, that
    of its set, is null for an empty one."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        bands = Bands(percent)
        for batch in slices(batches):
            counts, prints, sketches, signed = [], [], [], []
            for value in batch.column(2).to_pylist():
                features = shingle_set(value, size)
                counts.append(len(features))
                prints.append(_print(features))
                sketches.append(sketch(features))
                signed.append(_signed(signatures(features, bands)) if len(features) else np.zeros(0, np.int64))
            ends = np.cumsum([0, *map(len, signed)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(signed)))
            words = SKETCH // 64
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sketches) + 1, dtype=np.int32) * words), pa.array(np.concatenate(sketches)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(prints, pa.int64()), flat, lists], names=["key", "print", "n", "fp", "sketch", "sigs"])

    return docs.select(F.col(key).alias("key"), _text_print(text).alias("print"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, print long, n long, fp long, sketch array<long>, sigs array<long>")


def _text_print(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.lit(5))


def _print(features: np.ndarray) -> int | None:
    return int(np.uint64(fingerprint(features)).view(np.int64)) if len(features) else None


def _features(docs: DataFrame, size: int) -> DataFrame:
    """(fp, features) from (fp, text), for the texts that have the fingerprint."""

    def run(batches):
        for batch in slices(batches):
            prints, found = [], []
            for fp, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                features = shingle_set(text, size)
                if _print(features) == fp:
                    prints.append(fp)
                    found.append(features.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.int64()), pa.array(found, pa.binary())], names=["fp", "features"])

    return docs.select("fp", "text").mapInArrow(run, "fp long, features binary").dropDuplicates(["fp"])


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _verified(pairs: DataFrame, features: DataFrame, percent: int) -> DataFrame:
    """(a, b) of each pair that is linked, by its sets. Both joins use the same exchange of
    the features, and the sets of one side only shuffle on."""
    left, right = (features.select(F.col("fp").alias(x), F.col("features").alias(f"f{x}")) for x in "ab")

    def run(batches):
        for batch in slices(batches):
            linked = []
            for x, y in zip(batch.column("fa"), batch.column("fb"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                linked.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column(x).filter(pa.array(linked, pa.bool_())) for x in "ab"], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "fa", "fb").mapInArrow(run, "a long, b long")


def _pairs(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _shared(own: DataFrame) -> DataFrame:
    """(sig, fp, lo, size): the nodes of each signature that different nodes share, with the
    smallest of them and about how many rows have it."""
    rows = own.select(F.explode("sigs").alias("sig"), "fp")
    count = own.count()
    draw = F.pmod(F.xxhash64("fp", F.lit(9)), F.lit(1 << 30)) / float(1 << 30)
    often = max(20, int(HOT * min(count, SAMPLE)))
    hot = own.where(draw * count < SAMPLE).select(F.explode("sigs").alias("sig")).groupBy("sig").count().where(F.col("count") > often).select("sig")
    hot = stored(hot, "hot")  # a set has some signatures, so at most 1 / HOT times so many are hot
    w = Window.partitionBy("sig")
    met = rows.join(F.broadcast(hot), "sig", "left_anti").withColumns({"lo": F.min("fp").over(w), "hi": F.max("fp").over(w), "size": F.count("*").over(w)})
    out = met.where("lo <> hi").select("sig", "fp", "lo", "size")
    if not hot.isEmpty():
        told = rows.join(F.broadcast(hot), "sig")
        ends = told.groupBy("sig").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.count("*").alias("size")).where("lo <> hi").drop("hi")
        out = out.unionByName(told.join(F.broadcast(ends), "sig").select("sig", "fp", "lo", "size"))
    return out


def _linked(docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """(key, print, n, label) of each row; rows of one label are linked, those without are not."""
    whole = stored(sets(docs, key, text, size, percent), "sets")
    members = stored(_shared(whole.where("fp IS NOT NULL").select("fp", "sigs")), "members")
    own = stored(whole.select("key", "print", "n", "fp"), "sizes")
    nodes = stored(whole.where("fp IS NOT NULL").groupBy("fp").agg(F.min("key").alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "nodes")
    discard(whole)

    differ = sum(F.bit_count(F.get("sa", i).bitwiseXOR(F.get("sb", i))) for i in range(SKETCH // 64))
    alike = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    alike &= differ * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)
    first = members.where("fp <> lo").select(F.col("lo").alias("a"), F.col("fp").alias("b")).distinct()
    sized = nodes.select("fp", "n", "sketch")
    first = first.join(sized.toDF("a", "na", "sa"), "a").join(sized.toDF("b", "nb", "sb"), "b").where(alike).select("a", "b")
    first = stored(first, "pairs")
    # a signature of two rows is done with their pair
    members = stored(members.where("size > 2").select("sig", "fp", "size").distinct().join(nodes.select("fp", "n"), "fp"), "members", instead_of=members)

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that are linked, by the sets of one document of each node."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(nodes, "fp").select("fp", F.col("first").alias("key"))
        wanted = stored(wanted, "wanted")
        texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(_small(wanted, wanted.count()), "key").select("fp", "text")
        linked = stored(_verified(pairs, _features(texts, size), percent), "linked")
        discard(wanted)
        return linked

    labels, hubs = components(verified(first)), 1
    discard(first)
    while True:
        now = stored(members.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")), "labelled")
        open_ = stored(now.groupBy("sig").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.max("size").alias("most")).where("l <> h").select("sig", "most"), "open")
        count, most = open_.agg(F.count("*"), F.max("most")).first()
        if not count or hubs >= most:
            break
        previous, hubs = hubs, hubs * WIDER
        # what is settled stays settled, so later rounds read the open signatures only
        active = stored(now.join(_small(open_.select("sig"), count), "sig", "left_semi"), "active", instead_of=now)
        discard(members, open_)
        members = active.drop("label")
        active_ = active.join(sized.select("fp", "sketch"), "fp")
        # about `hubs` members of each signature are hubs by now, and all of them in the last round
        draw = F.pmod(F.xxhash64("sig", "fp"), F.lit(1 << 30)) / float(1 << 30)
        hub = active_.where((draw < F.lit(float(hubs)) / F.col("size")) & (draw >= (F.lit(float(previous if previous > 1 else 0)) / F.col("size"))))
        parts = F.ceil(F.col("size") / TASK_MEMBERS).cast("int")
        hub = hub.select("sig", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("fp").alias("hub"), F.col("label").alias("hub_label"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        member = active_.select("sig", F.pmod(F.xxhash64("fp", F.lit(3)), parts).cast("int").alias("part"), "fp", "label", F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        found = member.join(hub, (member["sig"] == hub["sig"]) & (member["part"] == hub["part"]) & (F.col("label") != F.col("hub_label")) & alike)
        found = stored(found.select(*_pairs("fp", "hub")).distinct(), "pairs")
        if found.isEmpty():
            continue
        named = labels.withColumnRenamed("label", "name")
        new = verified(found)
        discard(found)
        for x in "ab":
            new = new.join(named.withColumnRenamed("node", x), x, "left").withColumn(x, F.coalesce("name", x)).drop("name")
        joined = components(new.where("a <> b")).select(F.col("node").alias("label"), F.col("label").alias("to"))
        labels = labels.join(joined, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        labels = stored(labels.unionByName(joined.select(F.col("label").alias("node"), F.col("to").alias("label")).join(labels, "node", "left_anti")), "labels")

    named = stored(nodes.select("fp").join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("label")), "named")
    return stored(own.join(named, "fp", "left").drop("fp"), "linked", instead_of=own)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row per document: key, n_shingles and component_id, the smallest key that links
    reach. Links are exact: 100 * intersection >= percent * union."""
    rows = _linked(docs, key, text, size, percent)
    lowest = rows.where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("rows"), F.min("key").alias("component_id")).where("rows > 1").drop("rows")
    out = rows.join(lowest, "label", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"))


def first_of_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs without near copies, with all their columns: of each group the row of
    the smallest key stays. Rows of one key are told apart by their text."""
    rows = _linked(docs, key, text, size, percent).where("label IS NOT NULL")
    first = rows.groupBy("label").agg(F.count("*").alias("rows"), F.min(F.struct("key", "print")).alias("first")).where("rows > 1").drop("rows")
    gone = rows.join(first, "label").where(~F.struct("key", "print").eqNullSafe(F.col("first"))).select(F.col("key").alias("__key"), F.col("print").alias("__print"))
    gone = stored(gone.distinct(), "gone")
    own = docs.withColumn("__own", _text_print(text))
    gone = _small(gone, gone.count())
    return own.join(gone, (F.col("__own") == F.col("__print")) & own[key].eqNullSafe(gone["__key"]), "left_anti").drop("__own")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op6_ngram_join": op6_ngram_join}
ORACLES: dict[str, str] = {}
