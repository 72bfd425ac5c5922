"""Operators over rows with ids: joins of column groups, unions without repetition, changes on read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridtable.errors import InvalidQueryError
from gridtable.spec import ROW_ID, TXN

OP, SEQ = "__op", "__seq"
#: Log entries up to which the changes may be broadcast; a row id and a transaction each, so about 16 MB.
BROADCAST_CHANGES = 1_000_000


def vertical_join(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows that all parts have by ``keys``, with the columns of all; a column that several have is the last's."""
    if not parts:
        raise InvalidQueryError("nothing to join")
    whole = parts[0]
    for part in parts[1:]:
        twice = [c for c in whole.columns if c in part.columns and c not in keys]
        whole = whole.drop(*twice).join(part, keys, "inner")
    return whole


def union_distinct(parts: list[DataFrame], key: str = ROW_ID) -> DataFrame:
    """All rows of all parts, one for each ``key``."""
    return reduce(DataFrame.unionByName, parts).dropDuplicates([key])


def latest(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Of the rows that agree in ``by``, the last in ``order``."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order]))
    return rows.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def apply_changes(base: DataFrame, changes: DataFrame | None, entries: int) -> DataFrame:
    """``base`` as the changes leave it: (row id, txn, columns) without what is deleted, replaced or inserted anew later.

    Only the last operation on a row counts. It hides base rows of earlier transactions; an update puts
    its own values in their place. The join is an anti join of the base with the changed ids, which
    filters on the base pass through, and broadcasts the ids if there are few.
    """
    if changes is None:
        return base
    last = latest(changes, [ROW_ID], [TXN, SEQ])
    masks = last.select(F.col(ROW_ID).alias("__changed"), F.col(TXN).alias("__since"))
    if entries <= BROADCAST_CHANGES:
        masks = F.broadcast(masks)
    hidden = (F.col(ROW_ID) == F.col("__changed")) & (F.col(TXN) < F.col("__since"))
    live = base.join(masks, hidden, "left_anti")
    return live.unionByName(last.where(F.col(OP) == "U").select(*base.columns))
