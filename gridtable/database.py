"""A database: a directory of tables."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtable.errors import ConfigError, ConflictError
from gridtable.functions import coords
from gridtable.operators import compaction
from gridtable.operators.compaction import AutoCompactionConfig, CompactionHandle, CompactionLock, CompactionResult
from gridtable.plans.query import QueryBuilder, Snapshot, Source
from gridtable.sources import reader
from gridtable.sources.cache import SnapshotCache
from gridtable.sources.files import Files
from gridtable.sources.manifest import Catalog
from gridtable.sources.writer import Writer, rows_of
from gridtable.spec import ROW_ID, TableSpec
from gridtable.streaming.inserter import StreamConfig, StreamInserter, sink


class Database:
    """Opens or creates the database at ``path``, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.files = Files(spark, path)
        self.catalog = Catalog(self.files)
        self.cache = SnapshotCache()
        self._locks = CompactionLock()

    # Tables

    def create_table(self, spec: TableSpec, replace: bool = False) -> TableSpec:
        """Make a table; a name that is taken is an error unless ``replace``, which changes the specification alone
        and so must leave the columns and axes as they are if there are rows."""
        there = spec.name in self.catalog.tables()
        if there:
            if not replace:
                raise ConfigError(f"table {spec.name!r} is there already")
            old = self.catalog.spec(spec.name)
            if self.catalog.state(spec.name).segments and old != spec:
                raise ConfigError(f"table {spec.name!r} has rows of another specification")
        self.catalog.save_spec(spec, new=not there)
        return spec

    def create_table_from_yaml(self, path: str) -> TableSpec:
        return self.create_table(TableSpec.from_yaml(path))

    def list_tables(self) -> list[str]:
        return self.catalog.tables()

    def drop_table(self, table: str) -> None:
        self.catalog.spec(table)
        self.cache.invalidate(table)
        for path in (self.files.path("_meta", table), self.files.path(table)):
            self.files.delete(path)
        self.catalog.forget(table)

    # Writing

    def writer(self, table: str) -> Writer:
        return Writer(self.spark, self.catalog, table)

    inserter = writer

    def insert(self, table: str, rows: object, **options: object) -> int:
        """Insert a DataFrame, a pandas frame, Arrow data; the transaction."""
        txn = self.writer(table).insert(rows_of(self.spark, rows), **options)
        self.cache.invalidate(table)
        return txn

    def delete_rows(self, table: str, ids: Iterable[int] | DataFrame) -> int:
        txn = self.writer(table).delete(ids)
        self.cache.invalidate(table)
        return txn

    def update_rows(self, table: str, rows: object) -> int:
        txn = self.writer(table).update(rows_of(self.spark, rows))
        self.cache.invalidate(table)
        return txn

    def stream_inserter(self, table: str, config: StreamConfig | None = None, most_segments: int = 64) -> StreamInserter:
        """Buffered inserts. Segments are joined beyond ``most_segments``."""

        def committed() -> None:
            self.cache.invalidate(table)
            try:
                self.merge_segments(table, most_segments)
            except ConflictError:  # another writer was first; the rows are there, and the next flush tries again
                pass

        return StreamInserter(self.writer(table), config, committed)

    def stream_sink(self, table: str, stream: DataFrame, query_id: str, checkpoint: str, most_segments: int = 64):
        """A Structured Streaming writer into the table; start it with a trigger. Segments are joined beyond ``most_segments``."""
        return sink(stream, self.writer(table), query_id, checkpoint, lambda: self.merge_segments(table, most_segments))

    # Reading

    def source(self, table: str) -> Source:
        return Source(self, self.catalog.spec(table), self.catalog.state(table))

    def snapshot(self, table: str, txn: int | None = None) -> Snapshot:
        """The table as it is now, or as it was after transaction ``txn``; later commits do not show."""
        state = self.catalog.state(table) if txn is None else self.catalog.state_before(table, txn)
        return Snapshot(self, self.catalog.spec(table), state)

    def select(self, *columns: str) -> QueryBuilder:
        return QueryBuilder(self, None).select(*columns)

    def select_all(self, table: str) -> QueryBuilder:
        return QueryBuilder(self, None).from_(table)

    def change_log(self, table: str, after: int | None = None, up_to: int | None = None) -> DataFrame:
        """The logged operations that are not compacted yet: __row_id, __op, __txn, __seq, columns; transactions in (after, up_to]."""
        spec = self.catalog.spec(table)
        log = reader.change_rows(self.spark, spec, self.catalog.state(table))
        if log is None:
            log = self.spark.createDataFrame([], f"{ROW_ID} long, __op string, __txn long, __seq long").select("*", *[F.lit(None).cast(spec.type_of(c)).alias(c) for c in spec.names])
        if after is not None:
            log = log.where(F.col("__txn") > after)
        return log if up_to is None else log.where(F.col("__txn") <= up_to)

    def dirty_chunks(self, table: str) -> DataFrame:
        """The row buckets with logged operations: __rb, how many, the last one's transaction."""
        spec = self.catalog.spec(table)
        bucket = coords.row_bucket(F.col(ROW_ID), spec).alias("__rb")
        return self.change_log(table).groupBy(bucket).agg(F.count("*").alias("entries"), F.max("__txn").alias("max_txn"))

    def has_patches(self, table: str, row_bucket: int | None = None) -> bool:
        """Whether there are logged operations, in a row bucket or at all; the latter from the state alone."""
        if row_bucket is None:
            return any(c.entries for c in self.catalog.state(table).changes)
        return not self.dirty_chunks(table).where(F.col("__rb") == row_bucket).isEmpty()

    def max_patch_txn(self, table: str) -> int | None:
        """The last transaction that logged operations, from the state alone."""
        return max((c.txn for c in self.catalog.state(table).changes if c.entries), default=None)

    def chunks(self, table: str) -> DataFrame:
        """Rows for each place that the base rows lie in: the coordinates, last segment's transaction, rows. No column
        is read but those coordinates that are no names of directories."""
        spec, state = self.catalog.spec(table), self.catalog.state(table)
        parts = [reader.segment_places(self.spark, spec, s) for s in state.segments]
        whole = reduce(DataFrame.unionByName, parts) if parts else reader.base_rows(self.spark, spec, state, [], None).select(*spec.coordinates, F.col("__txn").alias("version"), F.lit(0).alias("rows"))
        return whole.groupBy(*spec.coordinates).agg(F.max("version").alias("version"), F.sum("rows").alias("rows"))

    def range_stats(self, table: str) -> DataFrame:
        """Least and greatest value ever written to each range dimension, and how many values were."""
        stats = self.catalog.state(table).stats
        return self.spark.createDataFrame([(c, s.low, s.high, s.count) for c, s in sorted(stats.items())], "column string, low long, high long, count long")

    # Compaction

    def compact(self, table: str, most_segments: int | None = None) -> CompactionResult:
        """Bake the changes into the base; a compaction of the table that is under way makes this one do nothing."""
        if not self._locks.try_lock(table):
            return CompactionResult.noop()
        try:
            result = compaction.compact(self.writer(table), most_segments)
        finally:
            self._locks.unlock(table)
        self.cache.invalidate(table)
        return result

    def start_auto_compaction(self, table: str, config: AutoCompactionConfig | None = None) -> CompactionHandle:
        config = config or AutoCompactionConfig()
        spec = self.catalog.spec(table)

        def due() -> bool:
            state = self.catalog.state(table)
            if len(state.segments) > config.max_segments:
                return True
            total = sum(c.entries for c in state.changes)
            if total >= config.max_total_patches:
                return True
            if total < config.max_patches_per_chunk:
                return False
            log = reader.change_rows(self.spark, spec, state, [])
            busiest = log.groupBy(coords.row_bucket(F.col(ROW_ID), spec).alias("b")).count().agg(F.max("count")).first()[0]
            return busiest >= config.max_patches_per_chunk

        def run() -> CompactionResult:
            merged = self.merge_segments(table, config.max_segments)
            return merged if merged.chunks_compacted and not self.has_patches(table) else self.compact(table)

        return CompactionHandle(run, due, config.interval)

    def merge_segments(self, table: str, most: int) -> CompactionResult:
        """Join small segments into one if there are more than ``most``; logged operations stay logged."""
        if not self._locks.try_lock(table):
            return CompactionResult.noop()
        try:
            return compaction.merge_segments(self.writer(table), most)
        finally:
            self._locks.unlock(table)

    def vacuum(self, table: str, keep_from: int | None = None, orphan_hours: float = 24.0) -> int:
        """Delete what only states before ``keep_from`` (default: the latest) need, and what writers that failed left
        more than ``orphan_hours`` ago."""
        return compaction.vacuum(self.writer(table), keep_from, orphan_hours)
