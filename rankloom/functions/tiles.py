"""Products of all users with all items, tile by tile.

Ids are dealt by their hash to tiles of a bounded number of ids and of entries, a row a tile. Tiles
meet in groups of GROUP by GROUP, a task's key; a tile of users and one of items are multiplied in
numpy and leave as batches of ROWS rows, so what a task holds doesn't grow with either side."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import stored

IDS, ENTRIES = {"user_id": 1024, "item_id": 4096}, 200_000  # the most of a tile, about
GROUP, FEW, TASKS = 8, 64, 2048
WIDTH = 512  # features that are multiplied at once as a matrix
PAIRS = 1 << 20  # products of single entries that are made at once
DENSER = 32  # a product in a matrix costs about this much less than one of single entries
ROWS = 1 << 18

Product = Callable[[pa.Array, pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray | None]]


def _tiles(own: DataFrame, key: str, by: tuple[str, ...]) -> tuple[DataFrame, int, int]:
    """The ids with their tile, the number of tiles for each value of `by`, and how many values
    these have; own is (by, key, f), a row an id, f being an array."""
    sizes = own.groupBy(*by).agg(F.count("*").alias("ids"), F.sum(F.size("f")).alias("entries"))
    most = sizes.agg(F.max("ids").alias("ids"), F.max("entries").alias("entries"), F.count("*").alias("n")).first()
    n = max(1, ceil((most["ids"] or 0) / IDS[key]), ceil((most["entries"] or 0) / ENTRIES))
    return own.withColumn("__tile", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), n, most["n"]


def _products(users: DataFrame, items: DataFrame, by: tuple[str, ...], product: Product) -> DataFrame:
    """(by, user_id, item_id, score) of what `product` makes of the rows of two tiles: a matrix
    of scores, which of them there are, and which of these are null. Ids are copied and
    shuffled one by one, and a tile is put together where it is used."""
    left, n_left, groups = _tiles(users, "user_id", by)
    right, n_right, _ = _tiles(items, "item_id", by)
    p, q = ceil(n_left / GROUP), ceil(n_right / GROUP)
    if p * q * groups < FEW:  # each pair of tiles is dealt on its own
        p, q = n_left, n_right
    keys, tasks = [*by, "__p", "__q"], max(1, min(TASKS, p * q * groups))

    def dealt(side: DataFrame, key: str, own: str, n: int, other: str, copies: int) -> DataFrame:
        rows = side.withColumns({own: F.pmod("__tile", F.lit(n)), other: F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))})
        return rows.repartition(tasks, *keys).groupBy(*keys, "__tile").agg(F.collect_list(F.struct(key, "f")).alias(f"{key}_rows")).drop("__tile")

    met = dealt(left, "user_id", "__p", p, "__q", q).hint("merge").join(dealt(right, "item_id", "__q", q, "__p", p), keys)
    kinds = {f.name: f.dataType.simpleString() for f in (*users.schema, *items.schema)}
    names = [*by, "user_id", "item_id", "score"]

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                us, xs = batch.column("user_id_rows")[r].values, batch.column("item_id_rows")[r].values
                own, ids = us.field("user_id"), xs.field("item_id")
                score, there, null = product(us.field("f"), xs.field("f"))
                step = max(1, ROWS // max(1, len(ids)))
                for a in range(0, len(own), step):
                    u, i = np.nonzero(there[a : a + step])
                    if len(u):
                        u = u + a
                        yield pa.RecordBatch.from_arrays([*(pa.repeat(batch.column(x)[r], len(u)) for x in by), own.take(pa.array(u)), ids.take(pa.array(i)), pa.array(score[u, i], mask=None if null is None else null[u, i])], names=names)

    schema = ", ".join([*(f"`{x}` {kinds[x]}" for x in (*by, "user_id", "item_id")), "score double"])
    return met.select(*by, "user_id_rows", "item_id_rows").mapInArrow(multiplied, schema)


def _entries(rows: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The place of the id, the feature and the value of each entry that has both."""
    at, flat = np.repeat(np.arange(len(rows)), pc.list_value_length(rows).to_numpy()), rows.flatten()
    feature, value = flat.field("feature"), flat.field("value")
    whole = pc.and_(pc.is_valid(feature), pc.is_valid(value))
    return at[whole.to_numpy(zero_copy_only=False)], feature.filter(whole), value.filter(whole).to_numpy()


def _sparse(users: pa.Array, items: pa.Array) -> tuple[np.ndarray, np.ndarray, None]:
    """The products of sparse rows, and which share a feature. Features that many of a tile have
    are multiplied as matrices, others entry by entry."""
    (u, names, x), (i, features, y) = _entries(users), _entries(items)
    known = pc.unique(features)
    uc, ic = pc.index_in(names, value_set=known), pc.index_in(features, value_set=known).to_numpy()
    met = pc.is_valid(uc).to_numpy(zero_copy_only=False)
    u, x, uc = u[met], x[met], uc.filter(pc.is_valid(uc)).to_numpy()
    score, there = np.zeros((len(users), len(items))), np.zeros((len(users), len(items)), bool)
    n_u, n_i = np.bincount(uc, minlength=len(known)), np.bincount(ic, minlength=len(known))
    cost = n_u * n_i
    dense = cost * DENSER > score.size
    often = np.flatnonzero(dense)
    for a in range(0, len(often), WIDTH):
        column = np.full(len(known), -1)
        column[often[a : a + WIDTH]] = np.arange(len(often[a : a + WIDTH]))
        m, n = column[uc] >= 0, column[ic] >= 0
        left, right = np.zeros((len(users), WIDTH)), np.zeros((WIDTH, len(items)))
        np.add.at(left, (u[m], column[uc[m]]), x[m])
        np.add.at(right, (column[ic[n]], i[n]), y[n])
        own = left @ right
        score += own
        if (x[m] > 0).all() and (y[n] > 0).all():
            there |= own > 0
        else:  # scores of zero are told from pairs without a shared feature
            left, right = np.zeros(left.shape, np.float32), np.zeros(right.shape, np.float32)
            left[u[m], column[uc[m]]], right[column[ic[n]], i[n]] = 1, 1
            there |= left @ right > 0
    few = ~dense[uc]
    u, x, uc, order = u[few], x[few], uc[few], np.argsort(ic, kind="stable")
    i, y, first, made = i[order], y[order], np.cumsum(n_i) - n_i, n_i[uc]
    ends, flat, marks = np.cumsum(made), score.ravel(), there.ravel()
    a = 0
    while a < len(u):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
        n = made[a:b]
        at = np.arange(n.sum()) + np.repeat(first[uc[a:b]] - (np.cumsum(n) - n), n)
        cells = np.repeat(u[a:b], n) * len(items) + i[at]
        np.add.at(flat, cells, np.repeat(x[a:b], n) * y[at])
        marks[cells] = True
        a = b
    return score, there, None


def _dense(users: pa.Array, items: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The products of dense rows; null where lengths differ or a number lacks."""
    score, null = np.zeros((len(users), len(items))), np.ones((len(users), len(items)), bool)
    sides = []
    for rows in (users, items):
        n = pc.fill_null(pc.list_value_length(rows), -1).to_numpy()
        at, flat = np.repeat(np.arange(len(rows)), np.maximum(n, 0)), rows.flatten()
        n = n.copy()
        n[at[pc.is_null(flat).to_numpy(zero_copy_only=False)]] = -1
        sides.append((n, at, flat.to_numpy(zero_copy_only=False)))
    (n, at, x), (m, of, y) = sides
    for size in np.intersect1d(n[n >= 0], m[m >= 0]):
        u, i = np.flatnonzero(n == size), np.flatnonzero(m == size)
        where = np.ix_(u, i)
        score[where], null[where] = x[n[at] == size].reshape(len(u), size) @ y[m[of] == size].reshape(len(i), size).T, False
    return score, np.ones(score.shape, bool), null


def sparse_products(users: DataFrame, items: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, user_id, item_id, score): of (by, user_id, feature, value) and (by, item_id, feature,
    value), the products of those that share a feature."""
    sides = []
    for df, key in ((users, "user_id"), (items, "item_id")):
        rows = F.collect_list(F.struct("feature", F.col("value").cast("double").alias("value")))
        sides.append(stored(df.groupBy(*by, key).agg(rows.alias("f")), f"{key}-rows"))
    return _products(*sides, by, _sparse)


def dense_products(users: DataFrame, items: DataFrame) -> DataFrame:
    """(user_id, item_id, score): of (user_id, f) and (item_id, f), the products of all with all."""
    return _products(*(stored(df.withColumn("f", F.col("f").cast("array<double>")), "dense-rows") for df in (users, items)), (), _dense)
