"""Merged rows of table states, kept in memory."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame


class SnapshotCache:
    """Persisted DataFrames by (table, transaction). States never change, so an entry is never stale; a commit
    makes the table's older ones useless, and the least recently used one goes when there are too many."""

    def __init__(self, entries: int = 64):
        self._entries, self._kept = entries, OrderedDict()

    def get(self, table: str, txn: int) -> DataFrame | None:
        found = self._kept.get((table, txn))
        if found is not None:
            self._kept.move_to_end((table, txn))
        return found

    def put(self, table: str, txn: int, rows: DataFrame) -> DataFrame:
        self._kept[table, txn] = rows.persist()
        self._kept.move_to_end((table, txn))
        while len(self._kept) > self._entries:
            self._kept.popitem(last=False)[1].unpersist()
        return self._kept.get((table, txn), rows)

    def get_or_put(self, table: str, txn: int, make: Callable[[], DataFrame]) -> DataFrame:
        return self.get(table, txn) or self.put(table, txn, make())

    def invalidate(self, table: str) -> None:
        for key in [k for k in self._kept if k[0] == table]:
            self._kept.pop(key).unpersist()

    def clear(self) -> None:
        for table in {t for t, _ in self._kept}:
            self.invalidate(table)

    def __len__(self) -> int:
        return len(self._kept)
