"""Connected components as joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cathodyne.sources.shared import discard, keep


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest reachable id of each linked id: rows (id, component), without the ids that are smallest.

    Contracts the graph round by round: each id hooks on to its smallest neighbour, the hooks are
    flattened by pointer jumping, and the links are rewritten between the roots that remain. The
    links shrink with each round, so the first round dominates. Everything stays in tables of the
    shared folder; the driver only learns whether rows are left. Ids are longs. Self links, repeated
    links and null ends are ignored; an id outside the result is its own component.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = keep(
        links.select(F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi")).where("lo < hi and hi is not null").distinct(),
        "links",
    )
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        first = edges.groupBy("hi").agg(F.min("lo").alias("root")).withColumnRenamed("hi", "id")
        first = keep(first, "hooks")
        hooks = flatten(first)
        rounds.append(hooks)
        high = hooks.join(first.withColumnRenamed("root", "hook"), "id").select(F.col("id").alias("hi"), F.col("root").alias("hi_root"), "hook")
        # A hub's links are the hooks of its neighbours; gone here, they do not meet at the hub.
        moved = edges.join(high, "hi").where("lo != hook").select("lo", "hi_root").distinct()
        low = hooks.select(F.col("id").alias("lo"), F.col("root").alias("lo_root"))
        moved = moved.join(low, "lo", "left")
        p, q = F.coalesce("lo_root", "lo"), F.col("hi_root")
        rest = keep(moved.select(F.least(p, q).alias("lo"), F.greatest(p, q).alias("hi")).where("lo < hi").distinct(), "links")
        discard(edges)
        edges = rest
    if not rounds:
        return edges.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    return follow(rounds).withColumnRenamed("root", "component")


def follow(rounds: list[DataFrame]) -> DataFrame:
    """Rows (id, root) of all rounds of hooks, each id with its root of the last round; a round hooks roots of those before."""
    labels = rounds[0]
    for hooks in rounds[1:]:
        later = hooks.select(F.col("id").alias("root"), F.col("root").alias("next"))
        labels = labels.join(later, "root", "left").select("id", F.coalesce("next", "root").alias("root")).unionByName(hooks)
    return labels


def flatten(hooks: DataFrame) -> DataFrame:
    """Follows hooks (id, root), which make no circles, until each root hooks on to nothing."""
    given = hooks
    while True:
        up = hooks.select(F.col("id").alias("root"), F.col("root").alias("next"))
        once = hooks.join(up, "root", "left").select("id", F.coalesce("next", "root").alias("root"))
        twice = once.join(up, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        stepped = keep(twice, "hooks")
        if hooks is not given:
            discard(hooks)
        hooks = stepped
        if stepped.where("moved").isEmpty():
            return hooks.select("id", "root")
