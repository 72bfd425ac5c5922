"""Compaction: the changes are baked into new segments of the row buckets that they touch."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import functions as F

from gridtable.functions import coords
from gridtable.sources import reader
from gridtable.sources.writer import LISTED, Writer
from gridtable.spec import ROW_ID, TXN


@dataclass(frozen=True)
class CompactionResult:
    """chunks_compacted: files written; bytes of the data files read by queries before and after; patches_applied: log entries."""

    chunks_compacted: int = 0
    bytes_before: int = 0
    bytes_after: int = 0
    patches_applied: int = 0

    @classmethod
    def noop(cls) -> CompactionResult:
        return cls()


def compact(writer: Writer, most_segments: int | None = None) -> CompactionResult:
    """Rewrite the row buckets that changed rows lie in, and forget the changes.

    Old segments stay for older snapshots; they are read without those buckets from now on. With
    ``most_segments``, all segments are joined into one if there are more.
    """
    spark, spec, catalog = writer.spark, writer.spec, writer.catalog
    state = catalog.state(spec.name)
    everything = most_segments is not None and len(state.segments) > most_segments
    if not state.changes and not everything:
        return CompactionResult.noop()
    txn = state.txn + 1
    files = catalog.files
    there = {g: files.data_files(g) for s in state.segments for g in s.groups}
    before = sum(size for listed in there.values() for _, size in listed)
    whole = reader.read(spark, spec, state, spec.names)
    like = reader.base_rows(spark, spec, state, [], None)
    dirty: list[int] = []
    if not everything:
        changed = reader.change_rows(spark, spec, state, []).select(ROW_ID).distinct()
        bucket = coords.row_bucket(F.col(ROW_ID), spec)
        found = changed.select(bucket.alias("b")).distinct().limit(LISTED + 1).collect()
        everything = len(found) > LISTED  # more than can be named: all are rewritten
        dirty = sorted(r["b"] for r in found)
        if not everything:
            whole, like = reader.read(spark, spec, state, spec.names, buckets=dirty), like.where(F.col("__rb").isin(dirty))
    segment = writer.write_segment(whole.withColumn(TXN, F.lit(txn).cast("long")), txn, like=like)
    written = [f for g in segment.groups for f in files.data_files(g)]
    segment = writer.measured(segment)
    kept = [] if everything else [replace(s, without=tuple(sorted({*s.without, *dirty}))) for s in state.segments]
    kept = [replace(s, without=tuple(sorted(set(s.without) & own))) for s in kept if (own := set(writer.touched(s))) - set(s.without)]
    catalog.commit(spec.name, replace(state, txn=txn, segments=(*kept, *([segment] if segment.rows else [])), changes=()))
    after = sum(size for _, size in written)
    after += sum(size for s in kept for g in s.groups for name, size in there[g] if not any(f"__rb={b}/" in name for b in s.without))
    return CompactionResult(len(written), before, after, len(state.changes))


def merge_segments(writer: Writer, most: int) -> CompactionResult:
    """Join the smallest segments into one if there are more than ``most``, so many that half of ``most`` are left.

    Rows keep their transactions, so the logged operations apply to them as before. A row is rewritten a number of
    times that grows with the logarithm of the table, since large segments stay as they are.
    """
    spec, catalog = writer.spec, writer.catalog
    state = catalog.state(spec.name)
    if len(state.segments) <= max(1, most):
        return CompactionResult.noop()
    by_size = sorted(state.segments, key=lambda s: s.rows)
    small = set(by_size[: len(by_size) - max(0, most // 2 - 1)])
    chosen = replace(state, segments=tuple(s for s in state.segments if s in small))
    rows = reader.base_rows(writer.spark, spec, chosen, spec.names, None).select(ROW_ID, TXN, *spec.names)
    segment = writer.write_segment(rows, state.txn + 1, like=reader.base_rows(writer.spark, spec, chosen, [], None))
    files = catalog.files
    before = sum(size for s in small for g in s.groups for _, size in files.data_files(g))
    written = [f for g in segment.groups for f in files.data_files(g)]
    segment = replace(writer.measured(segment), merged=True)
    catalog.commit(spec.name, replace(state, txn=state.txn + 1, segments=(*(s for s in state.segments if s not in small), segment)))
    return CompactionResult(len(written), before, sum(size for _, size in written), 0)


def vacuum(writer: Writer, keep_from: int | None = None, orphan_hours: float = 24.0) -> int:
    """Delete the directories and states that no reader at transaction ``keep_from`` or later needs (default: the
    latest), and directories that no state names and that are older than ``orphan_hours``, which writers left that
    failed or lost. Returns how many directories."""
    catalog, spec = writer.catalog, writer.spec
    newest = catalog.state(spec.name)
    since = newest.txn if keep_from is None else keep_from
    known = catalog.transactions(spec.name)
    base = max([t for t in known if t <= since], default=newest.txn)
    old, used = [[catalog.state_at(spec.name, t) for t in known if (t < base) == gone] for gone in (True, False)]
    paths = lambda states: {p.rsplit("/", 1)[0] for s in states for x in s.segments for p in x.groups} | {c.path.rsplit("/", 1)[0] for s in states for c in s.changes}
    needed, files = paths(used), catalog.files
    unnamed = {d for kind in ("data", "changes", "staged") for d, at in files.directories(files.path(spec.name, kind)) if at < (time.time() - orphan_hours * 3600) * 1000}
    gone = [p for p in sorted((paths(old) | unnamed) - needed) if files.exists(p)]
    for path in gone:
        files.delete(path)
    for state in old:
        files.delete(catalog._log(spec.name, state.txn))
    return len(gone)


class CompactionLock:
    """One lock a key; taking one that is held fails at once."""

    def __init__(self) -> None:
        self._held: set[str] = set()
        self._guard = threading.Lock()

    def try_lock(self, key: str) -> bool:
        with self._guard:
            if key in self._held:
                return False
            self._held.add(key)
            return True

    def unlock(self, key: str) -> None:
        with self._guard:
            self._held.discard(key)


@dataclass(frozen=True)
class AutoCompactionConfig:
    """Compact when one row bucket has so many logged changes, or the table so many; join segments when there are more
    than ``max_segments``; looked at every ``interval`` seconds."""

    max_patches_per_chunk: int = 50
    max_total_patches: int = 500
    interval: float = 30.0
    max_segments: int = 64


class CompactionHandle:
    """A background loop that compacts one table when it is due, or when told to."""

    def __init__(self, run: Callable[[], CompactionResult], due: Callable[[], bool], interval: float):
        self._run, self._due, self._interval = run, due, interval
        self._wake, self._stop = threading.Event(), threading.Event()
        self.last_error: Exception | None = None
        self.compactions = 0
        self._thread = threading.Thread(target=self._loop, daemon=True)
        self._thread.start()

    def _loop(self) -> None:
        while not self._stop.is_set():
            self._wake.wait(self._interval)
            self._wake.clear()
            if self._stop.is_set():
                break
            try:
                if self._due():
                    self.compactions += self._run().chunks_compacted > 0
            except Exception as e:  # the loop goes on; the error is there to be looked at
                self.last_error = e

    def trigger_now(self) -> None:
        """Look at once whether a compaction is due."""
        self._wake.set()

    def shutdown(self, timeout: float = 60.0) -> None:
        self._stop.set()
        self._wake.set()
        self._thread.join(timeout)

    @property
    def is_running(self) -> bool:
        return self._thread.is_alive() and not self._stop.is_set()

    def wait(self, condition: Callable[[], bool], timeout: float = 60.0) -> bool:
        end = time.monotonic() + timeout
        while time.monotonic() < end:
            if condition():
                return True
            time.sleep(0.05)
        return condition()
