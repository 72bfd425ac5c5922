"""Reading a table as of a state: segments, joined column groups, changes, predicates."""

from __future__ import annotations

from collections import OrderedDict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtable.functions import coords
from gridtable.operators.rows import OP, SEQ, apply_changes, vertical_join
from gridtable.plans.groups import ColumnGroups
from gridtable.plans.predicates import Predicate, columns_of, condition, derive
from gridtable.sources.manifest import Segment, State
from gridtable.spec import ROW_ID, TXN, TableSpec


def stored_schema(spec: TableSpec, columns: list[str]) -> T.StructType:
    """Fields of the files of a column group and of its directories; the coordinates are in either."""
    fields = [T.StructField(ROW_ID, T.LongType()), T.StructField(TXN, T.LongType())]
    fields += [T.StructField(c, spec.type_of(c)) for c in columns]
    return T.StructType(fields + [T.StructField(c, T.LongType()) for c in spec.coordinates])


_scans: OrderedDict[tuple, DataFrame] = OrderedDict()
#: Segments whose file lists are kept; a segment never changes, so a list is never stale.
LISTED = 1024


def scan(spark: SparkSession, spec: TableSpec, path: str, columns: list[str]) -> DataFrame:
    """The rows of one directory of a segment; its files are listed once."""
    key = (spark.sparkContext.applicationId, id(spark), path, tuple(columns))
    if key not in _scans:
        _scans[key] = spark.read.schema(stored_schema(spec, columns)).parquet(path)
        if len(_scans) > LISTED:
            _scans.popitem(last=False)
    _scans.move_to_end(key)
    return _scans[key]


def base_rows(spark: SparkSession, spec: TableSpec, state: State, columns: list[str], implied: Column | None) -> DataFrame:
    """(row id, txn, columns, coordinates, and others) of the segments, before changes; ``implied`` prunes their partitions.

    Only the column groups that hold ``columns`` are read, each with only what the caller selects of it: a frame is not
    narrowed here, since each column that is named costs a call to the JVM.
    """
    groups = ColumnGroups(spec)
    needed = groups.required(columns)
    segments = []
    for s in state.segments:
        parts = []
        for g in needed:
            part = scan(spark, spec, s.groups[g], groups.columns(g))
            if s.without:
                part = part.where(~F.col("__rb").isin(list(s.without)))
            parts.append(part if implied is None else part.where(implied))
        # The coordinates follow from the row; so does the transaction, but where segments were merged.
        segments.append(parts[0] if len(parts) == 1 else vertical_join(parts, [ROW_ID, TXN] if s.merged else [ROW_ID]))
    if not segments:
        return spark.createDataFrame([], stored_schema(spec, columns))
    return reduce(DataFrame.unionByName, segments)


def change_rows(spark: SparkSession, spec: TableSpec, state: State, columns: list[str] | None = None) -> DataFrame | None:
    """The change log: (row id, op, txn, seq, columns), None if it is empty."""
    if not state.changes:
        return None
    schema = T.StructType([T.StructField(ROW_ID, T.LongType()), T.StructField(OP, T.StringType()), T.StructField(TXN, T.LongType()), T.StructField(SEQ, T.LongType())] + [T.StructField(c, spec.type_of(c)) for c in (spec.names if columns is None else columns)])
    return spark.read.schema(schema).parquet(*[c.path for c in state.changes])


def read(spark: SparkSession, spec: TableSpec, state: State, columns: list[str], where: Predicate | None = None, buckets: list[int] | None = None) -> DataFrame:
    """(row id, columns, and others) of the rows of ``state`` that ``where`` keeps, of some row buckets if they are named.

    Changed rows are outside the partitions, so only the base is pruned by what the predicate implies;
    the predicate itself is applied to all, and Spark pushes it into the base scan.
    """
    wanted = list(dict.fromkeys([*columns, *(c for c in spec.names if c in columns_of(where))]))
    implied = derive(where, spec) if buckets is None else F.col("__rb").isin(buckets)
    whole = base_rows(spark, spec, state, wanted, implied)
    if state.changes:
        changes = change_rows(spark, spec, state, wanted)
        if buckets is not None:
            changes = changes.where(coords.row_bucket(F.col(ROW_ID), spec).isin(buckets))
        whole = apply_changes(whole.select(ROW_ID, TXN, *wanted), changes, sum(c.entries for c in state.changes))
    return whole if where is None else whole.where(condition(where, spec))


def segment_places(spark: SparkSession, spec: TableSpec, segment: Segment) -> DataFrame:
    """(coordinates, version, rows) of one segment; where all are directories Spark takes the rows from the files' footers."""
    rows = scan(spark, spec, segment.groups[0], ColumnGroups(spec).columns(0))
    if segment.without:
        rows = rows.where(~F.col("__rb").isin(list(segment.without)))
    return rows.groupBy(*spec.coordinates).agg(F.count("*").alias("rows")).withColumn("version", F.lit(segment.txn).cast("long"))


def ids_in_buckets(spark: SparkSession, spec: TableSpec, state: State, implied: Column | None) -> DataFrame:
    """(row id) of the rows of ``state`` in the row buckets that ``implied`` leaves, from the narrowest column group."""
    base = base_rows(spark, spec, state, [], implied).select(ROW_ID, TXN)
    return apply_changes(base, change_rows(spark, spec, state, []), sum(c.entries for c in state.changes)).select(ROW_ID)
