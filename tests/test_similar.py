"""The closest items of many, against all pairs by hand."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import similar as S


def tie(item):
    return (item * 2654435761) & 0xFFFFFFFF


def unit(own):
    length = math.sqrt(sum(v * v for v in own.values()))
    return {f: v / length for f, v in own.items()}


def catalogue(kind):
    draw = random.Random(kind)
    out = {}
    for i in range(220):
        if kind == "dense":  # a year that all have, few groups
            own = {"year": 1 + draw.random(), f"g{draw.randrange(6)}": 1.0, f"g{draw.randrange(6)}": 1.0}
        elif kind == "rare":  # most features are shared by few
            own = {f"t{draw.randrange(400)}": draw.random() + 0.1 for _ in range(draw.choice([1, 2, 6]))}
        elif kind == "signed":
            own = {f"d{n}": draw.uniform(-1, 1) for n in range(4)} | {f"t{draw.randrange(30)}": 1.0}
        else:  # equal items
            own = {f"g{i % 3}": 1.0, "all": 1.0}
        out[i] = unit(own)
    return out


@pytest.mark.parametrize("kind", ["dense", "rare", "signed", "ties"])
def test_similar_items(spark, kind):
    items, n = catalogue(kind), 7
    vectors = spark.createDataFrame([(i, f, v) for i, own in items.items() for f, v in own.items()], "item_id long, feature string, value double")
    asked = [0, 5, 17, 100, 219]
    got = {}
    for r in S.similar_items(spark.createDataFrame([(q,) for q in asked], "q long"), vectors, n).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["item_id"], r["similarity"]))
    for q in asked:
        dot = {i: sum(v * items[q].get(f, 0) for f, v in own.items()) for i, own in items.items() if i != q}
        want = sorted(dot, key=lambda i: (-round(dot[i], 9), tie(i), i))[:n]
        assert [i for _, i, _ in sorted(got[q])] == want
        assert [s for *_, s in sorted(got[q])] == pytest.approx([dot[i] for i in want])


def test_bounds_rule_out_pairs(spark):
    """A feature that all items have brings no candidate where others reach the bound."""
    draw = random.Random(3)
    items = {i: unit({"year": 0.3, f"g{i % 40}": 1.0, f"h{draw.randrange(60)}": 0.5}) for i in range(1200)}
    vectors = spark.createDataFrame([(i, f, v) for i, own in items.items() for f, v in own.items()], "item_id long, feature string, value double")
    queries = vectors.select(F.col("item_id").alias("q")).distinct()
    assert S.candidates(queries, vectors, 10).count() < 0.1 * 1200 * 1200


def test_because_rows(spark):
    similar = spark.createDataFrame([(1, i, i - 1, 0.5) for i in range(2, 8)], "q long, item_id long, rank long, similarity double")
    recent, known = spark.createDataFrame([(9, 1, 1), (8, 2, 1)], "user_id long, nth long, q long"), spark.createDataFrame([(9, 2), (9, 5)], "user_id long, item_id long")
    shown = spark.createDataFrame([(i,) for i in (2, 3, 5, 6, 7)], "item_id long")
    got = sorted(map(tuple, S.because(recent, similar, known, shown, 2).collect()))
    assert got == [(8, 2, 1, 2), (8, 2, 2, 3), (9, 1, 1, 3), (9, 1, 2, 6)]


def test_no_query_and_no_item(spark):
    vectors = spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0)], "item_id long, feature string, value double")
    queries = spark.createDataFrame([(1,)], "q long")
    assert [(r["item_id"], r["similarity"]) for r in S.similar_items(queries, vectors, 5).collect()] == [(2, 0.0)]
    assert S.similar_items(queries.limit(0), vectors, 5).count() == 0


def test_threshold_is_the_percentile_of_paired_cosines(spark):
    from rankloom.operators import content

    rng, rows = np.random.default_rng(5), []
    for i in range(60):
        features = sorted(rng.choice(12, size=3, replace=False).tolist())
        values = rng.random(3)
        rows += [(10 * i + 3, f"f{f}", float(v)) for f, v in zip(features, values / np.linalg.norm(values), strict=True)]
    dense = np.zeros((60, 12))
    for item, f, v in rows:
        dense[item // 10, int(f[1:])] = v
    cosines = [round(float(dense[i] @ dense[(i * 48271 + 11) % 60]), 9) for i in range(60)]
    got = content.similarity_threshold(spark.createDataFrame(rows, "item_id long, feature string, value double")).first()["threshold"]
    assert abs(got - np.quantile(cosines, 0.95)) < 1e-8
    assert 0.0 in cosines


def test_favourite_genre_in_shown_items_and_in_the_row_of_all(spark):
    from rankloom.operators import hybrid

    items = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["b", "b"]), (4, []), (5, None)], "item_id long, genres array<string>")
    picks = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 4)], "user_id long, item_id long")
    shown = spark.createDataFrame([(1, 2), (1, 3), (1, 5), (1, 1), (2, 3), (2, 4), (3, 1)], "user_id long, item_id long")
    got = {r["user_id"]: r for r in hybrid.genre_report(shown, picks, items, items.where("item_id >= 2")).collect()}
    assert set(got) == {1, 2}  # a user whose picks have no genre has no favourite
    assert (got[1]["genre"], got[1]["shown_share"], got[1]["row_share"], got[1]["lift"]) == ("a", 0.5, 0.25, 0.25)
    assert (got[2]["genre"], got[2]["shown_share"]) == ("a", 0.0)  # of equally frequent genres the first by name
