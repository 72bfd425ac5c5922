"""Connected components of an edge list, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtable.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of ``edges`` (a, b: long, without nulls); component is the smallest id reached.

    Each round sends a node to the least of its closed neighbourhood and contracts the edges. The order
    is by id in the first two rounds (stars round a least id collapse at once), then by a hash that
    changes with the round, under which a constant share of the nodes goes in each round whatever the
    shape. Aggregates combine before they shuffle, and a hub is a skewed join, which AQE splits.
    """
    left = cut(edges.select("a", "b").where("a <> b").distinct())
    maps, turn = [], 0
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = (lambda c: c) if turn < 2 else (lambda c, t=turn: F.xxhash64(c, F.lit(t)))
        least = F.min(F.struct(rank(F.col("b")).alias("rank"), F.col("b").alias("id")))
        up = both.groupBy("a").agg(least.alias("least"))
        own = F.struct(rank(F.col("a")).alias("rank"), F.col("a").alias("id"))
        parent = cut(up.select(F.col("a").alias("id"), F.least(own, F.col("least"))["id"].alias("parent")))
        maps.append(parent)
        pa, pb = parent.toDF("a", "pa"), parent.toDF("b", "pb")
        left = left.join(pa, "a").join(pb, "b").where("pa <> pb")
        left = cut(left.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        turn += 1
    if not maps:
        return edges.select(F.col("a").alias("id"), F.col("a").alias("component")).where("false")
    whole = maps[0]
    for step in maps[1:]:
        step = step.toDF("parent", "next")
        whole = whole.join(step, "parent", "left").select("id", F.coalesce("next", "parent").alias("parent"))
    whole = cut(whole)
    least = whole.groupBy("parent").agg(F.min("id").alias("component"))
    return whole.join(least, "parent").select("id", "component")
