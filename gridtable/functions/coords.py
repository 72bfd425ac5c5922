"""Row ids and buckets as column expressions, and the same for literals."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtable.spec import ROW_ID, TableSpec

#: Where the unsigned numbers' order starts in the signed ones.
UNSIGNED = 1 << 63


def ordered_u64(value: int) -> int:
    """A signed 64-bit number as an unsigned one in the same order."""
    return value + UNSIGNED


def to_u64(column: Column) -> Column:
    """``ordered_u64`` of a column, as decimal(20, 0)."""
    return (column.cast("decimal(20,0)") + F.lit(Decimal(UNSIGNED))).cast("decimal(20,0)")


def floor_div(value: Column, size: int) -> Column:
    """Division that rounds down, in whole numbers throughout; never leaves the long range on the way."""
    n = F.lit(size).cast("long")
    towards_zero = F.call_function("div", value, n)
    return towards_zero - F.when((value < 0) & (F.pmod(value, n) != 0), F.lit(1)).otherwise(F.lit(0)).cast("long")


def bucket_row_range(bucket: int, chunk_rows: int) -> tuple[int, int]:
    """Row ids of a bucket: from, and up to but without."""
    return bucket * chunk_rows, (bucket + 1) * chunk_rows


def overlapping_buckets(low: int | None, high: int | None, size: int, most: int = 10_000) -> list[int] | None:
    """Range buckets that [low, high] touches; None if it is unbounded or touches more than ``most`` + 1."""
    if low is None or high is None:
        return None
    first, last = low // size, high // size
    return None if last - first > most else list(range(first, last + 1))


def hash_bucket(column: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets).cast("long"))


def literal_hash(value: object, kind: T.DataType, buckets: int) -> Column:
    """The bucket of a literal, cast to its column's type so that it hashes as the column does."""
    if isinstance(value, int) and not isinstance(value, bool) and value >= UNSIGNED:
        value = Decimal(value)
    return hash_bucket(F.lit(value).cast(kind), buckets)


def as_number(column: Column, kind: T.DataType) -> Column:
    """The number a range dimension cuts: the value, days of a date, whole seconds of a timestamp, rounded down."""
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("long")
    if isinstance(kind, T.TimestampNTZType):
        micros = F.timestamp_diff("MICROSECOND", F.lit(dt.datetime(1970, 1, 1)).cast("timestamp_ntz"), column)
        return floor_div(micros, 1_000_000)
    if isinstance(kind, T.TimestampType):
        return floor_div(F.unix_micros(column), 1_000_000)
    return column.cast("long")


def number_of(value: object, kind: T.DataType) -> int | None:
    """``as_number`` of a literal; None if it is not of the type's family."""
    if isinstance(kind, T.DateType):
        return (value - dt.date(1970, 1, 1)).days if isinstance(value, dt.date) and not isinstance(value, dt.datetime) else None
    if isinstance(kind, T.TimestampNTZType):
        return (value - dt.datetime(1970, 1, 1)) // dt.timedelta(seconds=1) if isinstance(value, dt.datetime) and value.tzinfo is None else None
    if isinstance(kind, T.TimestampType):
        return None
    return int(value) if isinstance(value, int) and not isinstance(value, bool) else None


def range_bucket(column: Column, kind: T.DataType, size: int) -> Column:
    return floor_div(as_number(column, kind), size)


def row_bucket(row_id: Column, spec: TableSpec) -> Column:
    """Consecutive ids by their order, hashed ids by their remainder."""
    if spec.hashed_ids:
        return F.pmod(row_id, F.lit(spec.hashed_row_buckets).cast("long"))
    return floor_div(row_id, spec.chunk_rows)


def unsigned(kind: T.DataType) -> bool:
    return isinstance(kind, T.DecimalType)


def key_value(value: Column, kind: T.DataType) -> Column:
    """The row id that a key column's value is; unsigned 64-bit numbers move down by 2**63."""
    if unsigned(kind):
        return (value - F.lit(Decimal(UNSIGNED))).cast("long")
    return value.cast("long")


def row_id(spec: TableSpec) -> Column:
    """The row id of a table with a key; a null in the key is an error."""
    columns = [F.col(c) for c in spec.row_id.columns]
    if spec.row_id.kind == "single" and not spec.hashed_ids:
        value = key_value(columns[0], spec.type_of(spec.row_id.columns[0]))
    else:  # the hash of a column seeds that of the next, so ("ab", "c") and ("a", "bc") differ
        value = F.xxhash64(*columns)
    missing = columns[0].isNull()
    for c in columns[1:]:
        missing = missing | c.isNull()
    return F.when(missing, F.raise_error(F.lit(f"null in the key of {spec.name}")).cast("long")).otherwise(value)


def with_counter(df: DataFrame, order: str, start: int) -> DataFrame:
    """``df`` with row ids start, start + 1, ... in place of ``order``, which holds monotonically increasing ids that
    stay the same (df is a table). A count for each partition that gave such ids is all that meets in one place."""
    part, within = F.shiftright(order, 33), F.col(order).bitwiseAND(F.lit((1 << 33) - 1))
    counts = df.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("__part", (F.lit(start) + F.coalesce(F.sum("__n").over(before), F.lit(0))).alias("__first"))
    numbered = df.withColumn("__part", part).join(F.broadcast(firsts), "__part")
    return numbered.withColumn(ROW_ID, F.col("__first") + within).drop("__part", "__first", order)


def with_coordinates(df: DataFrame, spec: TableSpec) -> DataFrame:
    """``df`` (with row ids) and its partition columns."""
    new = {"__rb": row_bucket(F.col(ROW_ID), spec)}
    for i, d in enumerate(spec.hash_dimensions):
        new[f"__h{i}"] = hash_bucket(F.col(d.column), d.num_buckets)
    for i, r in enumerate(spec.range_dimensions):
        new[f"__rg{i}"] = range_bucket(F.col(r.column), spec.type_of(r.column), r.chunk_size)
    return df.withColumns(new)
