"""Products by tiles."""

import numpy as np
from rankloom.functions import tiles
from rankloom.operators import content


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sparse_products_keep_every_pair_that_shares_a_feature(spark, monkeypatch):
    for name, value in (("IDS", {"user_id": 5, "item_id": 7}), ("WIDTH", 3), ("PAIRS", 10), ("ROWS", 9)):
        monkeypatch.setattr(tiles, name, value)
    draw = np.random.default_rng(3)
    users, items = ({(k, f): float(draw.integers(-1, 2)) for k in range(n) for f in range(40) if draw.random() < (0.6 if f < 4 else 0.04)} for n in (23, 31))
    frames = [spark.createDataFrame([(1, k, f"f{f}", v) for (k, f), v in own.items()], f"vec int, {name} long, feature string, value double") for own, name in ((users, "user_id"), (items, "item_id"))]
    want: dict = {}
    for (u, f), x in users.items():
        for (i, g), y in items.items():
            if f == g:
                want[(1, u, i)] = want.get((1, u, i), 0.0) + x * y
    rows = content.scores(*frames, by=("vec",))
    got = {(r["vec"], r["user_id"], r["item_id"]): r["score"] for r in rows.collect()}
    assert got.keys() == want.keys() and 0.0 in want.values()  # pairs of score zero too, as in SQL
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert "MapInArrow" in _plan(rows)  # products of single features are no rows
    assert content.scores(frames[0].limit(0), frames[1], by=("vec",)).count() == 0


def test_dense_products(spark, monkeypatch):
    monkeypatch.setattr(tiles, "IDS", {"user_id": 3, "item_id": 4})
    draw = np.random.default_rng(4)
    users, items = ([(k, [float(x) for x in draw.normal(size=6)]) for k in range(n)] for n in (8, 11))
    users += [(90, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (91, [1.0]), (92, None)]
    rows = content.all_pairs(spark.createDataFrame(users, "user_id long, profile array<double>"), spark.createDataFrame(items, "item_id long, embedding array<float>"))
    got = {(r["user_id"], r["item_id"]): r["score"] for r in rows.collect()}
    assert len(got) == 11 * 11
    assert all(got[(u, i)] is None if u >= 90 else abs(got[(u, i)] - np.dot(x, np.float32(y).astype(float))) < 1e-9 for u, x in users for i, y in items)
    assert "MapInArrow" in _plan(rows)
