"""Iterated activity filter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import discard, stored


BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Cores:
    """What stays under each pair of thresholds: users (setting, user_id, deg) and items
    (setting, item_id, deg), deg being the ratings that stay; passes by setting, the last one,
    which changes nothing, included."""

    settings: list[tuple[int, int]]
    users: DataFrame
    items: DataFrame
    passes: list[int]


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def cores(ratings: DataFrame, settings: list[tuple[int, int]]) -> Cores:
    """Drops users, then items, with too few ratings until nothing changes, under all pairs of
    thresholds (of a user, of an item) at once. The ratings are written once. A pass takes off the
    degrees of the neighbours of what fell in it, so it reads ratings of these only and writes
    degrees, never the ratings that stay."""
    edges = stored(ratings.select("user_id", "item_id"), "edges")
    least = {k: F.element_at(F.array(*(F.lit(s[n]) for s in settings)), F.col("setting") + 1) for n, k in enumerate(("user_id", "item_id"))}
    every = F.explode(F.sequence(F.lit(0), F.lit(len(settings) - 1))).alias("setting")
    state = {k: stored(edges.groupBy(k).agg(F.count("*").alias("deg")).select(every, k, "deg"), k) for k in ("user_id", "item_id")}
    passes, open_ = [0] * len(settings), set(range(len(settings)))
    while open_:
        fell_in_pass: set[int] = set()
        for key, other in (("user_id", "item_id"), ("item_id", "user_id")):
            fallen = stored(state[key].where(F.col("deg") < least[key]).select("setting", key), "fallen")
            counts = {r["setting"]: r["count"] for r in fallen.groupBy("setting").count().collect()}  # a row a setting
            if counts:
                fell_in_pass |= set(counts)
                lost = edges.join(_small(fallen, sum(counts.values())), key).groupBy("setting", other).agg(F.count("*").alias("lost"))
                rest = state[other].join(lost, ["setting", other], "left").select("setting", other, (F.col("deg") - F.coalesce("lost", F.lit(0))).alias("deg")).where("deg > 0")
                state[key] = stored(state[key].where(F.col("deg") >= least[key]), key, instead_of=state[key])
                state[other] = stored(rest, other, instead_of=state[other])
            discard(fallen)
        for s in open_:
            passes[s] += 1
        open_ &= fell_in_pass
    discard(edges)
    return Cores(settings, state["user_id"], state["item_id"], passes)


def k_core(ratings: DataFrame, least_user: int, least_item: int) -> tuple[DataFrame, int]:
    """The ratings whose user and item stay, and the number of passes."""
    found = cores(ratings, [(least_user, least_item)])
    own = ratings.join(found.users.select("user_id"), "user_id", "left_semi").join(found.items.select("item_id"), "item_id", "left_semi")
    return own.select(*ratings.columns), found.passes[0]


def threshold_grid(ratings: DataFrame, users: tuple[int, ...] = (20, 50, 100), items: tuple[int, ...] = (5, 20, 50)) -> DataFrame:
    """One row for each pair of thresholds: what stays, how dense it is and the passes."""
    found = cores(ratings, [(u, i) for u in users for i in items])
    grid = ratings.sparkSession.createDataFrame([(n, u, i, p) for n, ((u, i), p) in enumerate(zip(found.settings, found.passes, strict=True))], "setting int, min_user int, min_item int, passes int")
    people = found.users.groupBy("setting").agg(F.count("*").alias("n_users"), F.sum("deg").alias("n_ratings"))
    things = found.items.groupBy("setting").agg(F.count("*").alias("n_items"))
    rows = grid.join(people, "setting", "left").join(things, "setting", "left").fillna(0, ["n_users", "n_items", "n_ratings"])
    density = F.coalesce(F.try_divide("n_ratings", F.col("n_users").cast("double") * F.col("n_items")), F.lit(0.0))
    return rows.select("min_user", "min_item", "n_users", "n_items", "n_ratings", density.alias("density"), (1 - density).alias("sparsity"), "passes")


def hash_sample(ratings: DataFrame, share_of: int, one_in: int, key: str = "user_id") -> DataFrame:
    """The ratings of a fixed pseudo-random share of users: share_of in one_in."""
    from ..functions.ranking import tie_hash

    return ratings.where(tie_hash(F.col(key)) % one_in < share_of)


def companions(core: DataFrame, items: DataFrame, tags: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items, tags and links of what stays in a core."""
    kept_items, kept_users = core.select("item_id").distinct(), core.select("user_id").distinct()
    return items.join(kept_items, "item_id", "left_semi"), tags.join(kept_items, "item_id", "left_semi").join(kept_users, "user_id", "left_semi"), links.join(kept_items, "item_id", "left_semi")
