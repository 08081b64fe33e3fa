r"""Operator 12: SimHash near-duplicates by tiled exact comparison.

A text's words (what white space parts, A-Z lower-cased) give shingles of four, repeats
included. Each shingle's XXH64 votes on 64 bits; a bit of the fingerprint is set if over half
the votes set it. Fingerprints that differ in at most `radius` bits are linked, and
components are taken over the links.

Equal fingerprints are one node from the start. Distinct ones are dealt into tiles: all of
a tile have one population count, and a tile has about TILE of them, dealt by a hash. Two fingerprints
within the radius have population counts within the radius, so tile pairs that differ by more
are never made. Pairs of tiles are compared exactly: numpy's exclusive-or and bit
count over blocks; blocks are sorted by the population counts of the four 16-bit parts, and
a pair of blocks whose counts differ by more than the radius over all parts is skipped too.

First each tile is compared with itself and its fingerprints get the label of their component
within the tile. Then tile pairs are compared, and what leaves a task is each pair of labels that
a link joins, once: a group of many near copies is a few labels a tile, not all of its pairs.
Comparison is exact for any number of rows; its work grows with the square of the distinct
fingerprints, divided by what the counts rule out, and is dealt to as many tasks as there are
tile pairs. A tile is TILE numbers whatever the data.

Cases: null texts and texts without words have fingerprint zero, which is linked like any
other; fewer words than a shingle are one shingle; repeated rows and rows of one id get
a row each; rows without an id are linked, and a component without any id has a null one; an
empty table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

import re
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, slices, stored, table
from .components import components

SIZE, RADIUS, SEED = 4, 4, 42
TILE = 16_384
BLOCK = 512
CHUNK = 1 << 15  # hashes whose bits are counted at once
TASK_PAIRS = 4
HEAVY = 1000
SPACE = re.compile(rb"[\x20\x09-\x0D]+")
PARTS = 4


def fingerprint(raw: bytes, size: int = SIZE) -> int:
    """The SimHash of a UTF-8 text."""
    from xxhash import xxh64_intdigest

    joined = SPACE.sub(b" ", raw.lower()).strip(b" ")
    if not joined:
        return 0
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(joined)]])
    n = max(1, len(starts) - size + 1)
    starts, ends = starts[:n], ends[len(ends) - n :]
    votes = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        pairs = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in pairs], ">u8")
        votes += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """(key, fp): the fingerprint, as a signed number, of each document."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            found = np.array([fingerprint(x.as_py() or b"", size) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["key", "fp"])

    return docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).mapInArrow(run, f"key {kind}, fp long")


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    return np.arange(0, 64, 64 // PARTS).astype(np.uint64)


def blocks(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(places, fingerprints, least and largest counts of each part) of blocks of a tile."""
    counts = np.bitwise_count((fps[:, None] >> _shifts()) & np.uint64((1 << (64 // PARTS)) - 1)).astype(np.int64)
    order = np.lexsort(counts.T)
    cuts = [order[at : at + BLOCK] for at in range(0, len(order), BLOCK)]
    return [(c, fps[c], counts[c].min(axis=0), counts[c].max(axis=0)) for c in cuts]


def links(left: list, right: list, radius: int):
    """Places in two tiles of fingerprints within the radius, block pair by block pair."""
    for place, fps, low, high in left:
        for other, theirs, their_low, their_high in right:
            if np.maximum(0, np.maximum(low - their_high, their_low - high)).sum() <= radius:
                x, y = np.nonzero(np.bitwise_count(fps[:, None] ^ theirs) <= radius)
                yield place[x], other[y]


def merged(labels: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The labels after links between places: each component's least one."""
    while True:
        p, q = labels[x], labels[y]
        apart = p != q
        if not apart.any():
            return labels
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        to = np.arange(len(labels))
        np.minimum.at(to, np.maximum(p, q), np.minimum(p, q))
        while (to[to] != to).any():
            to = to[to]
        labels = to[labels]


def _own_labels(fps: np.ndarray, radius: int) -> np.ndarray:
    """Of each fingerprint of a tile, the place of its component's first one."""
    labels, cut = np.arange(len(fps)), blocks(fps)
    for at, block in enumerate(cut):
        for x, y in links([block], cut[at:], radius):
            labels = merged(labels, x, y)
    return labels


def _array(x: pa.Scalar) -> np.ndarray:
    return x.values.to_numpy(zero_copy_only=False).view(np.uint64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x.view(np.int64) for x in arrays])))


def _tiles(nodes: DataFrame, radius: int) -> DataFrame:
    """(tile, count, fps, labels): the tiles, with labels by what is linked within each."""

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                fps = np.sort(_array(batch.column(2)[at]))
                labels = fps[_own_labels(fps, radius)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), batch.column(1).slice(at, 1), _lists([fps]), _lists([labels])], names=["tile", "count", "fps", "labels"])

    sizes = F.broadcast(nodes.groupBy("count").agg(F.ceil(F.count("*") / TILE).alias("parts")))  # 65 rows at most
    dealt = nodes.join(sizes, "count").withColumn("tile", F.col("count") * (1 << 40) + F.pmod(F.xxhash64("fp"), "parts"))
    return dealt.groupBy("tile", "count").agg(F.collect_list("fp").alias("fps")).mapInArrow(run, "tile long, count long, fps array<long>, labels array<long>")


def _joined(tiles: DataFrame, radius: int) -> DataFrame:
    """(a, b): labels of different tiles with a link between them."""

    def run(batches):
        for batch in slices(batches, rows=1):
            fps, labels, their_fps, their_labels = (_array(batch.column(i)[0]) for i in range(4))
            found = [np.zeros((0, 2), np.uint64)]
            for x, y in links(blocks(fps), blocks(their_fps), radius):
                if len(x):
                    found.append(np.unique(np.stack([labels[x], their_labels[y]], axis=1), axis=0))
            both = np.unique(np.concatenate(found), axis=0).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, i])) for i in (0, 1)], names=["a", "b"])

    names = tiles.select("tile", "count")
    near = names.select(F.col("tile").alias("a"), F.explode(F.sequence(F.col("count"), F.col("count") + radius)).alias("count"))
    pairs = stored(near.join(names.withColumnRenamed("tile", "b"), "count").where("a < b").select("a", "b"), "pairs")
    n = pairs.count()
    left, right = (tiles.select(F.col("tile").alias(x), F.col("fps").alias(f"fps_{x}"), F.col("labels").alias(f"labels_{x}")) for x in "ab")
    whole = pairs.join(left, "a").join(right, "b").repartition(max(1, ceil(n / TASK_PAIRS)), "a", "b")
    out = stored(whole.select("fps_a", "labels_a", "fps_b", "labels_b").mapInArrow(run, "a long, b long"), "links")
    discard(pairs)
    return out


def _told(rows: DataFrame, named: DataFrame) -> DataFrame:
    """rows (key, fp) with the component_id of (fp, n, component_id). What many rows have is told by
    a broadcast, HEAVY fingerprints at most, so that no task meets all of these rows."""
    count = rows.count()
    often = F.col("n") >= max(2, ceil(count / HEAVY))
    told = rows.join(F.broadcast(named.where(often).select("fp", F.struct("component_id").alias("c"))), "fp", "left")
    light = told.where("c IS NULL").drop("c").join(named.where(~often).select("fp", F.struct("component_id").alias("c")), "fp")
    return told.where("c IS NOT NULL").unionByName(light).select("key", "fp", "c.component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, radius: int = RADIUS) -> DataFrame:
    """One row per document: key, fingerprint (hexadecimal), component_id, the smallest key that
    links reach."""
    rows = stored(fingerprints(docs, key, text, size), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("key").alias("first"), F.bit_count("fp").cast("long").alias("count")), "nodes")
    tiles = stored(_tiles(nodes.select("fp", "count"), radius), "tiles")
    edges = _joined(tiles, radius)
    labels = tiles.select(F.explode(F.arrays_zip("fps", "labels")).alias("x")).select(F.col("x.fps").alias("fp"), F.col("x.labels").alias("label"))
    joined = components(edges)
    discard(edges)
    own = stored(labels.join(joined.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("fp", F.coalesce("to", "label").alias("label")).join(nodes.select("fp", "n", "first"), "fp"), "labels", instead_of=tiles)
    discard(joined)
    least = own.groupBy("label").agg(F.min("first").alias("component_id"))
    named = stored(own.join(least, "label").select("fp", "n", "component_id"), "named", instead_of=own)
    discard(nodes)
    return _told(rows, named).select(F.col("key").alias(key), _hex(F.col("fp")).alias("fingerprint"), "component_id")


def _hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op12_simhash": op12_simhash}
ORACLES: dict[str, str] = {}
