"""Column groups: which columns are stored together, and which groups a query needs."""

from __future__ import annotations

from collections.abc import Iterable

from gridtable.spec import TableSpec


class ColumnGroups:
    """Without declared groups there is one; columns that no group names form one more at the end. A column
    that several groups name is stored in each and read from the last."""

    def __init__(self, spec: TableSpec):
        named = [list(g) for g in spec.column_groups]
        rest = [c for c in spec.names if not any(c in g for g in named)]
        self.groups = named + ([rest] if rest or not named else [])
        self.of = {c: i for i, g in enumerate(self.groups) for c in g}

    def __len__(self) -> int:
        return len(self.groups)

    def columns(self, group: int) -> list[str]:
        return self.groups[group]

    def group(self, column: str) -> int:
        return self.of[column]

    def required(self, columns: Iterable[str]) -> list[int]:
        """The groups to read; the narrowest one where no column is asked for."""
        needed = sorted({self.of[c] for c in columns})
        return needed or [min(range(len(self.groups)), key=lambda i: len(self.groups[i]))]
