"""Writing: inserts with upsert by row id, deletes and updates as logged changes."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtable.errors import ConfigError, SchemaError
from gridtable.functions import coords
from gridtable.operators.rows import OP, SEQ, latest
from gridtable.plans.groups import ColumnGroups
from gridtable.sources import reader
from gridtable.sources.manifest import Catalog, Change, RangeStats, Segment, State
from gridtable.spec import ROW_ID, TXN, TableSpec


#: Row buckets up to which a write names those that it touches, and reads no others; beyond, it looks at all.
LISTED = 1000
#: Directories that a segment may have however few rows they hold, and rows that each holds on average where there are more.
FEW, SMALL = 1000, 5000


def within(buckets: list[int]) -> Column | None:
    """A condition on the row bucket, None if there are too many to name."""
    if not buckets:
        return F.lit(False)
    return F.col("__rb").isin(buckets) if len(buckets) <= LISTED else None


def fitted(df: DataFrame, spec: TableSpec, with_id: bool, ignore_extra: bool = False) -> DataFrame:
    """``df`` with the table's columns, cast to their types; what is missing, or extra, is an error, as is a null where none may be."""
    missing = [c for c in spec.names if c not in df.columns]
    if missing:
        raise SchemaError(f"columns {missing} of {spec.name} are missing")
    extra = [c for c in df.columns if c not in spec.names and c != ROW_ID]
    if extra and not ignore_extra:
        raise SchemaError(f"{spec.name} has no columns {extra}")

    def fit(name: str):
        column = spec.column(name)
        value = F.col(f"`{name}`").cast(column.type)
        if not column.nullable:
            value = F.when(F.col(f"`{name}`").isNull(), F.raise_error(F.lit(f"null in {spec.name}.{name}")).cast(column.type)).otherwise(value)
        return value.alias(name)

    own = [F.col(ROW_ID).cast("long").alias(ROW_ID)] if with_id and ROW_ID in df.columns else []
    return df.select(*own, *map(fit, spec.names))


class Writer:
    """Writes to one table of a catalog. Each call is one transaction, visible as a whole when its state is committed."""

    def __init__(self, spark: SparkSession, catalog: Catalog, table: str):
        self.spark, self.catalog = spark, catalog
        self.spec = catalog.spec(table)

    def _directory(self, txn: int, kind: str) -> str:
        """A new directory: no two writers have the same, whatever they believe the transaction to be."""
        return self.catalog.files.path(self.spec.name, kind, f"v{txn}-{uuid.uuid4().hex}")

    def touched(self, segment: Segment) -> list[int]:
        """The row buckets of a segment, from the names of its directories."""
        names = self.catalog.files.names(segment.groups[0])
        return sorted(int(n.removeprefix("__rb=")) for n in names if n.startswith("__rb="))

    def axes(self, placed: DataFrame) -> list[str]:
        """The coordinates that get directories in a segment of ``placed`` (rows with coordinates): the row bucket, and
        those that follow as long as the directories are few or not small. The others are columns of the files, which
        are sorted by them, so that the files' statistics say what the directories would."""
        axes = self.spec.coordinates
        if len(axes) == 1:
            return axes
        places = [F.approx_count_distinct(F.xxhash64(*axes[:k])) for k in range(2, len(axes) + 1)]
        rows, *found = placed.agg(F.count("*"), *places).first()
        return axes[: 1 + sum(n <= max(FEW, rows // SMALL) for n in found)]

    def write_segment(self, rows: DataFrame, txn: int, clustered: bool = False, stored: bool = False, like: DataFrame | None = None) -> Segment:
        """Write rows (row id, txn, columns) as a segment: a shuffle by the axes that get directories, files sorted by the
        others and the row id. ``clustered``: the rows lie by row bucket already; ``stored``: they are cheap to read again;
        ``like``: rows with coordinates that lie as these do, to choose the axes by."""
        spec, groups = self.spec, ColumnGroups(self.spec)
        placed = coords.with_coordinates(rows, spec)
        axes = self.axes(placed if like is None else like)
        if not clustered:
            placed = placed.repartition(*axes)
        many = len(groups) > 1 and not stored
        if many:
            placed = placed.persist()
        paths, directory = [], self._directory(txn, "data")
        try:
            for g in range(len(groups)):
                path = f"{directory}/g{g}"
                part = placed.select(ROW_ID, TXN, *groups.columns(g), *spec.coordinates)
                part.sortWithinPartitions(*spec.coordinates, ROW_ID).write.partitionBy(*axes).parquet(path)
                paths.append(path)
        finally:
            if many:
                placed.unpersist()
        return Segment(txn, tuple(paths), 0)

    def insert(self, df: DataFrame, order_by: list[str] | None = None, ignore_extra: bool = False, batch: tuple[str, int] | None = None) -> int:
        """Append rows; a row whose id is there already takes its place, and of equal ids in ``df`` the last stays
        (by ``order_by``, else in the order of df's partitions). Returns the transaction."""
        spec, catalog = self.spec, self.catalog
        state = catalog.state(spec.name)
        if batch and state.streams.get(batch[0], -1) >= batch[1]:
            return state.txn
        txn, staged, clustered = state.txn + 1, None, True
        df = fitted(df, spec, True, ignore_extra)
        keyed = spec.row_id.kind != "snowflake" or ROW_ID in df.columns
        if keyed:
            if spec.row_id.kind != "snowflake":  # the key alone says where a row lies
                df = df.withColumn(ROW_ID, coords.row_id(spec))
            rows = df.withColumn(SEQ, F.monotonically_increasing_id()).withColumn("__rb", coords.row_bucket(F.col(ROW_ID), spec))
            rows = latest(rows.repartition("__rb"), ["__rb", ROW_ID], [*(order_by or []), SEQ]).drop(SEQ, "__rb")
        else:  # the source is read once, so that each row has one number even if it comes in another order the next time
            staged = self._directory(txn, "staged")
            placed = df.withColumn(SEQ, F.monotonically_increasing_id())
            placed.write.parquet(staged)
            placed = self.spark.read.schema(placed.schema).parquet(staged)
            n, parts = placed.agg(F.count("*"), F.approx_count_distinct(F.shiftright(SEQ, 33))).first()
            clustered = n >= parts * spec.chunk_rows  # a part's rows have consecutive numbers, and so few row buckets
            rows = coords.with_counter(placed, SEQ, catalog.allocate_row_ids(state, n))
        rows = rows.withColumn(TXN, F.lit(txn).cast("long"))
        segment = self.write_segment(rows, txn, clustered=clustered, stored=not keyed and clustered, like=coords.with_coordinates(df, spec) if keyed else None)
        if staged:
            catalog.files.delete(staged)
        stats, segment = self._statistics(segment)
        changes, met = list(state.changes), tuple(s for s in state.segments if s.meets(segment))
        if keyed and (met or state.changes) and segment.rows:
            written = reader.scan(self.spark, spec, segment.groups[0], ColumnGroups(spec).columns(0))
            there = reader.base_rows(self.spark, spec, replace(state, segments=met), [], within(self.touched(segment))).select(ROW_ID, "__rb")
            pending = reader.change_rows(self.spark, spec, state, [])
            old = written.select(ROW_ID, "__rb").join(there, [ROW_ID, "__rb"], "left_semi").select(ROW_ID)
            if pending is not None:
                old = old.union(written.select(ROW_ID).join(pending, ROW_ID, "left_semi"))
            marks = old.distinct().select(ROW_ID, F.lit("I").alias(OP), F.lit(txn).cast("long").alias(TXN), F.lit(0).cast("long").alias(SEQ))
            changes += self._log(marks, txn, "I")
        streams = state.streams | ({batch[0]: batch[1]} if batch else {})
        merged = {c: state.stats.get(c, RangeStats()).merge(s) for c, s in stats.items()}
        catalog.commit(spec.name, replace(state, txn=txn, segments=(*state.segments, segment), changes=tuple(changes), stats=merged, streams=streams))
        return txn

    def measured(self, segment: Segment) -> Segment:
        """A segment just written with its rows and row ids, from its files."""
        rows = reader.scan(self.spark, self.spec, segment.groups[0], ColumnGroups(self.spec).columns(0))
        r = rows.agg(F.count("*").alias("rows"), F.min(ROW_ID).alias("low"), F.max(ROW_ID).alias("high")).first()
        return replace(segment, **r.asDict())

    def _statistics_columns(self, group: int) -> list[str]:
        names = ColumnGroups(self.spec).columns(group)
        return [c for c in dict.fromkeys(r.column for r in self.spec.range_dimensions) if c in names]

    def _statistics(self, segment: Segment) -> tuple[dict[str, RangeStats], Segment]:
        """Of the range dimensions' numbers, and the segment with its rows and row ids, from the files just written."""
        spec, found = self.spec, {}
        for g, path in enumerate(segment.groups):
            columns = self._statistics_columns(g)
            if not columns and g:
                continue
            aggregates = [F.count("*").alias("rows"), F.min(ROW_ID).alias("low"), F.max(ROW_ID).alias("high")]
            for i, c in enumerate(columns):
                number = coords.as_number(F.col(f"`{c}`"), spec.type_of(c))
                aggregates += [F.min(number).alias(f"a{i}"), F.max(number).alias(f"b{i}"), F.count(number).alias(f"n{i}")]
            r = reader.scan(self.spark, spec, path, ColumnGroups(spec).columns(g)).agg(*aggregates).first()
            if g == 0:
                segment = replace(segment, rows=r["rows"], low=r["low"], high=r["high"])
            found |= {c: RangeStats(r[f"a{i}"], r[f"b{i}"], r[f"n{i}"]) for i, c in enumerate(columns)}
        return found, segment

    def _log(self, rows: DataFrame, txn: int, op: str) -> list[Change]:
        """Write change rows; nothing is logged if there are none."""
        path = f"{self._directory(txn, 'changes')}/{op}"
        rows.write.parquet(path)
        n = self.spark.read.parquet(path).count()
        return [Change(txn, path, n, op)] if n else []

    def delete(self, ids: Iterable[int] | DataFrame) -> int:
        """Delete rows by row id (ids, or a DataFrame whose first column holds them); unknown ids are ignored."""
        catalog, spec = self.catalog, self.spec
        state = catalog.state(spec.name)
        txn = state.txn + 1
        if not isinstance(ids, DataFrame):
            ids = self.spark.createDataFrame([(int(i),) for i in ids], f"{ROW_ID} long")
        ids = ids.select(F.col(f"`{ids.columns[0]}`").cast("long").alias(ROW_ID)).where(f"{ROW_ID} IS NOT NULL").distinct()
        rows = ids.select(ROW_ID, F.lit("D").alias(OP), F.lit(txn).cast("long").alias(TXN), F.lit(0).cast("long").alias(SEQ))
        return self._commit_changes(state, txn, self._log(rows, txn, "D"))

    def update(self, df: DataFrame) -> int:
        """Replace whole rows by row id: given as __row_id, or by the key. Rows that are not there are ignored; of equal ids the last counts."""
        catalog, spec = self.catalog, self.spec
        state = catalog.state(spec.name)
        df = fitted(df, spec, True)
        if ROW_ID not in df.columns:
            if spec.row_id.kind == "snowflake":
                raise ConfigError(f"an update of {spec.name} needs {ROW_ID}")
            df = df.withColumn(ROW_ID, coords.row_id(spec))
        txn = state.txn + 1
        rows = latest(df.withColumn(SEQ, F.monotonically_increasing_id()), [ROW_ID], [SEQ])
        buckets = df.select(coords.row_bucket(F.col(ROW_ID), spec).alias("b")).distinct().limit(LISTED + 1).collect()
        there = reader.ids_in_buckets(self.spark, spec, state, within(sorted(r["b"] for r in buckets if r["b"] is not None)))
        rows = rows.join(there, ROW_ID, "left_semi")
        rows = rows.select(ROW_ID, F.lit("U").alias(OP), F.lit(txn).cast("long").alias(TXN), SEQ, *spec.names)
        return self._commit_changes(state, txn, self._log(rows, txn, "U"))

    def _commit_changes(self, state: State, txn: int, changes: list[Change]) -> int:
        self.catalog.commit(self.spec.name, replace(state, txn=txn, changes=(*state.changes, *changes)))
        return txn


def rows_of(spark: SparkSession, data: object) -> DataFrame:
    """A DataFrame of what it already is, a pandas frame, an Arrow table or batches, or rows as dictionaries."""
    if isinstance(data, DataFrame):
        return data
    import pyarrow as pa

    if isinstance(data, pa.RecordBatch):
        data = pa.Table.from_batches([data])
    if isinstance(data, list) and data and isinstance(data[0], pa.RecordBatch):
        data = pa.Table.from_batches(data)
    if isinstance(data, pa.Table):
        signed = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0)}
        data = data.cast(pa.schema([pa.field(f.name, signed.get(f.type, f.type), f.nullable) for f in data.schema]))
    return spark.createDataFrame(data)


