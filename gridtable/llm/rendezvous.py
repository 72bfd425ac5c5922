"""Sharding by weighted rendezvous hashing, in DataFrame functions alone.

Every shard bids for every key: with h a hash of (key, shard) in (0, 1) the bid is weight / -log(h), and
the highest bid wins. A shard's share is its weight's, and one more shard takes rows only into itself,
because the other bids stay as they were.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtable.llm.common import bounded, cut

#: Parts that each shard is numbered in; shards x PARTS counts are what is broadcast.
PARTS = 1024


def bids(key: Column, weights: Sequence[float]) -> Column:
    """An array of (bid, shard), one for each weight."""
    table = F.array(*[F.lit(float(w)) for w in weights])

    def bid(shard: Column) -> Column:
        share = (F.shiftrightunsigned(F.xxhash64(key, shard), 11).cast("double") + 0.5) * F.lit(2.0**-53)
        return F.struct((F.element_at(table, shard + 1) / -F.log(share)).alias("bid"), (-shard).alias("shard"))

    return F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), bid)


def shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard of the highest bid; of equal bids the least shard's. A null key bids like any other."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive, at least one")
    return -F.array_max(bids(key, weights))["shard"]


def place(rows: DataFrame, key: str, weights: Sequence[float], grown_by: float = 1.0, order: Sequence[str] = ()) -> DataFrame:
    """``rows`` with shard, slot and grown_shard (with one more shard of weight ``grown_by``).

    ``slot`` counts the rows of a shard from 0 without gaps. Each shard is numbered in PARTS parts by a
    hash of the key, the columns ``order`` and the input partition, so that a shard or a repeated row
    of any size is many tasks; the counts of the parts, of which there are shards x PARTS at most,
    give each part's first slot. Rows are all kept, those with a null key as one key; an empty table gives an empty
    result. Columns stay, whatever they hold, but one with the name of a column that is made here gives way to it.
    """
    made = ("shard", "slot", "grown_shard")
    kept = [c for c in rows.columns if c.lower() not in made]
    by = [f"order{i}" for i in range(len(order))]
    one = rows.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{key}`").alias("key"), *[F.col(f"`{c}`").alias(b) for c, b in zip(order, by, strict=True)])
    one = one.withColumns({"shard": shard(F.col("key"), weights), "grown_shard": shard(F.col("key"), [*weights, grown_by]), "source": F.spark_partition_id()})
    one = cut(one.withColumn("part", F.pmod(F.xxhash64("key", *by, "source"), F.lit(PARTS)).cast("int")))
    counts = one.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = cut(counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    within = Window.partitionBy("shard", "part").orderBy("key", *by)
    numbered = one.withColumn("at", F.row_number().over(within) - 1)
    placed = numbered.join(bounded(firsts), ["shard", "part"])
    return placed.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "shard", (F.col("first") + F.col("at")).alias("slot"), "grown_shard")
