"""The commit log: a table's state at each transaction, in one small file that is written once.

``_meta/<table>/spec.json`` holds the specification, ``_meta/<table>/log/<txn>.json`` the state after a
transaction: its segments (directories of data files), its change files, statistics and the row id
counter. A state lists directories, not files, so its size follows the commits since the last
compaction. Committing is creating the next file; a second writer of the same one fails, and what it has
written lies in directories of its own, which no state names.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from gridtable.errors import CatalogError, ConfigError, ConflictError
from gridtable.sources.files import Files
from gridtable.spec import TableSpec


@dataclass(frozen=True)
class Segment:
    """Rows written by one transaction: a directory for each column group. ``without``: row buckets that later segments
    replace. ``merged``: rows keep the transactions of several segments, and so one row id can be there twice.
    ``low``, ``high``: the least and greatest row id, None if they are not known."""

    txn: int
    groups: tuple[str, ...]
    rows: int
    without: tuple[int, ...] = ()
    merged: bool = False
    low: int | None = None
    high: int | None = None

    def meets(self, other: Segment) -> bool:
        """Whether a row id may be in both."""
        known = None not in (self.low, self.high, other.low, other.high)
        return not known or self.low <= other.high and other.low <= self.high


@dataclass(frozen=True)
class Change:
    """Operations on rows that one transaction logged. ``entries``: rows of the file; ``op``: D, U or I."""

    txn: int
    path: str
    entries: int
    op: str


@dataclass(frozen=True)
class RangeStats:
    """Least and greatest value that was ever written to a range dimension, and how many."""

    low: int | None = None
    high: int | None = None
    count: int = 0

    def merge(self, other: RangeStats) -> RangeStats:
        lows, highs = ([x for x in pair if x is not None] for pair in ((self.low, other.low), (self.high, other.high)))
        return RangeStats(min(lows, default=None), max(highs, default=None), self.count + other.count)

    @property
    def is_initialized(self) -> bool:
        return self.count > 0


@dataclass(frozen=True)
class State:
    txn: int = 0
    segments: tuple[Segment, ...] = ()
    changes: tuple[Change, ...] = ()
    stats: dict[str, RangeStats] = field(default_factory=dict)
    next_row_id: int = 0
    #: The last batch that each streaming query committed.
    streams: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> State:
        d = json.loads(text)
        return cls(
            d["txn"],
            tuple(Segment(s["txn"], tuple(s["groups"]), s["rows"], tuple(s["without"]), s.get("merged", True), s.get("low"), s.get("high")) for s in d["segments"]),
            tuple(Change(**c) for c in d["changes"]),
            {k: RangeStats(**v) for k, v in d["stats"].items()},
            d["next_row_id"],
            d["streams"],
        )


class Catalog:
    """The specifications and states of a database's tables. A table's transactions are numbered from 1 without gaps,
    so that whoever writes the next file of the log has built on the newest state. Each look at a table finds what
    other processes have committed."""

    def __init__(self, files: Files):
        self.files = files
        files.mkdirs(files.path("_meta"))
        self._specs: dict[str, TableSpec] = {}
        self._states: dict[str, State] = {}
        self._row_id = 0

    def _spec_path(self, table: str) -> str:
        return self.files.path("_meta", table, "spec.json")

    def _log(self, table: str, txn: int | None = None) -> str:
        return self.files.path("_meta", table, "log", *([] if txn is None else [f"{txn:020d}.json"]))

    def transactions(self, table: str) -> list[int]:
        """Those whose states are kept, in order."""
        return [int(n.removesuffix(".json")) for n in self.files.names(self._log(table)) if n.endswith(".json") and not n.startswith(".")]

    def state_at(self, table: str, txn: int) -> State:
        try:
            return State.from_json(self.files.read(self._log(table, txn)))
        except (KeyError, ValueError, TypeError) as e:
            raise CatalogError(f"state {txn} of {table} is unreadable") from e

    def state_before(self, table: str, txn: int) -> State:
        """The state that a reader at transaction ``txn`` sees."""
        known = [t for t in self.transactions(table) if t <= txn]
        return self.state_at(table, known[-1]) if known else State()

    def tables(self) -> list[str]:
        return [n for n in self.files.names(self.files.path("_meta")) if self.files.exists(self._spec_path(n))]

    def spec(self, table: str) -> TableSpec:
        if table not in self._specs:
            if not self.files.exists(self._spec_path(table)):
                raise ConfigError(f"there is no table {table!r}")
            self._specs[table] = TableSpec.from_json(self.files.read(self._spec_path(table)))
        return self._specs[table]

    def state(self, table: str) -> State:
        """The newest state. The one known is looked at first: it is in the log, and the next one is not."""
        self.spec(table)
        known = self._states.get(table)
        if known is None or known.txn and not self.files.exists(self._log(table, known.txn)):
            txns = self.transactions(table)
            known = self.state_at(table, txns[-1]) if txns else State()
        while self.files.exists(self._log(table, known.txn + 1)):
            known = self.state_at(table, known.txn + 1)
        self._states[table] = known
        return known

    def save_spec(self, spec: TableSpec, new: bool) -> None:
        self.files.mkdirs(self._log(spec.name))
        if not self.files.write(self._spec_path(spec.name), spec.to_json(), replace=not new):
            raise ConfigError(f"table {spec.name!r} is there already")
        self._specs[spec.name] = spec

    def forget(self, table: str) -> None:
        self._specs.pop(table, None)
        self._states.pop(table, None)

    def current_txn(self, table: str) -> int:
        return self.state(table).txn

    def allocate_row_ids(self, state: State, n: int) -> int:
        """The first of ``n`` ids of the counter, which the tables of this database object share."""
        first = max(self._row_id, state.next_row_id)
        self._row_id = first + n
        return first

    def commit(self, table: str, state: State) -> State:
        """Make ``state`` the table's next. The caller built it on the one before; another commit in between fails it: it
        has made the file, or the one before is gone as well. The log is not listed, which would take longer each time."""
        state = replace(state, next_row_id=max(state.next_row_id, self._row_id))
        newest = [] if state.txn > 1 and self.files.exists(self._log(table, state.txn - 1)) else self.transactions(table)[-1:]
        if newest and newest[0] != state.txn - 1 or not self.files.write(self._log(table, state.txn), state.to_json()):
            raise ConflictError(f"another writer committed to {table} first")
        self._states[table] = state
        return state
