"""Predicates of queries, and what they say about the partitions to read."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from decimal import Decimal
from enum import Enum
from functools import reduce
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtable.errors import InvalidQueryError
from gridtable.functions import coords
from gridtable.spec import INTEGERS, ROW_ID, TableSpec


class FilterOp(Enum):
    Eq = "="
    NotEq = "<>"
    Gt = ">"
    GtEq = ">="
    Lt = "<"
    LtEq = "<="
    In = "IN"
    Like = "LIKE"
    IsNull = "IS NULL"
    IsNotNull = "IS NOT NULL"


COMPARE = {
    FilterOp.Eq: lambda c, v: c == v,
    FilterOp.NotEq: lambda c, v: c != v,
    FilterOp.Gt: lambda c, v: c > v,
    FilterOp.GtEq: lambda c, v: c >= v,
    FilterOp.Lt: lambda c, v: c < v,
    FilterOp.LtEq: lambda c, v: c <= v,
}
NUMBERS = (*INTEGERS, T.FloatType, T.DoubleType, T.DecimalType)


class Predicate:
    """A condition; ``&`` and ``|`` combine."""

    def __and__(self, other: Predicate) -> CompositeFilter:
        return CompositeFilter.and_([self, other])

    def __or__(self, other: Predicate) -> CompositeFilter:
        return CompositeFilter.or_([self, other])


@dataclass(frozen=True)
class Filter(Predicate):
    """``column op value``."""

    column: str
    op: FilterOp
    value: object = None

    @classmethod
    def eq(cls, column: str, value: object) -> Filter:
        return cls(column, FilterOp.Eq, value)

    @classmethod
    def neq(cls, column: str, value: object) -> Filter:
        return cls(column, FilterOp.NotEq, value)

    @classmethod
    def gt(cls, column: str, value: object) -> Filter:
        return cls(column, FilterOp.Gt, value)

    @classmethod
    def gte(cls, column: str, value: object) -> Filter:
        return cls(column, FilterOp.GtEq, value)

    @classmethod
    def lt(cls, column: str, value: object) -> Filter:
        return cls(column, FilterOp.Lt, value)

    @classmethod
    def lte(cls, column: str, value: object) -> Filter:
        return cls(column, FilterOp.LtEq, value)

    @classmethod
    def between(cls, column: str, low: object, high: object) -> list[Filter]:
        """Both ends included, as two filters that both must hold."""
        return [cls.gte(column, low), cls.lte(column, high)]

    @classmethod
    def isin(cls, column: str, values: list) -> Filter:
        return cls(column, FilterOp.In, tuple(values))

    @classmethod
    def like(cls, column: str, pattern: str) -> Filter:
        return cls(column, FilterOp.Like, pattern)

    @classmethod
    def is_null(cls, column: str) -> Filter:
        return cls(column, FilterOp.IsNull)

    @classmethod
    def is_not_null(cls, column: str) -> Filter:
        return cls(column, FilterOp.IsNotNull)


@dataclass(frozen=True)
class CompositeFilter(Predicate):
    """All of (AND) or any of (OR) some conditions; of none, AND is true and OR is false."""

    kind: str
    children: tuple[Predicate, ...] = field(default=())

    @classmethod
    def and_(cls, filters: list[Predicate]) -> CompositeFilter:
        return cls("and", tuple(filters))

    @classmethod
    def or_(cls, filters: list[Predicate]) -> CompositeFilter:
        return cls("or", tuple(filters))

    @classmethod
    def single(cls, one: Filter) -> CompositeFilter:
        return cls("and", (one,))

    @classmethod
    def of(cls, value: Predicate | list[Predicate]) -> Predicate:
        """A predicate as it is, a list as its conjunction."""
        return cls.and_(list(value)) if isinstance(value, (list, tuple)) else value

    def has_or(self) -> bool:
        return self.kind == "or" or any(isinstance(c, CompositeFilter) and c.has_or() for c in self.children)

    def flatten(self) -> list[Filter]:
        """The conditions of a tree without OR."""
        if self.has_or():
            raise InvalidQueryError("a tree with OR has no flat form")
        return [f for c in self.children for f in (c.flatten() if isinstance(c, CompositeFilter) else [c])]

    def normalize(self) -> list[list[Filter]]:
        """Disjunctive normal form. Its size is exponential at worst; queries do not need it."""
        each = [c.normalize() if isinstance(c, CompositeFilter) else [[c]] for c in self.children]
        if self.kind == "or":
            return [branch for branches in each for branch in branches]
        return [[f for branch in chosen for f in branch] for chosen in product(*each)]


def columns_of(p: Predicate | None) -> set[str]:
    if p is None:
        return set()
    if isinstance(p, CompositeFilter):
        return set().union(*map(columns_of, p.children)) if p.children else set()
    return {p.column}


def check(p: Predicate, spec: TableSpec) -> None:
    """The strict typing rules, before anything is read: strings compare by = and <> (IN, LIKE), booleans by =,
    numbers with numbers, dates with dates, timestamps with timestamps."""
    if isinstance(p, CompositeFilter):
        for c in p.children:
            check(c, spec)
        return
    if p.column not in spec.names:
        raise InvalidQueryError(f"table {spec.name} has no column {p.column!r}")
    kind, op = spec.type_of(p.column), p.op
    if op in (FilterOp.IsNull, FilterOp.IsNotNull):
        return
    for v in p.value if op is FilterOp.In else (p.value,):
        equality = op in (FilterOp.Eq, FilterOp.NotEq, FilterOp.In)
        if isinstance(v, bool):
            fits = isinstance(kind, T.BooleanType) and op is FilterOp.Eq
        elif isinstance(v, (int, float, Decimal)):
            fits = isinstance(kind, NUMBERS) and op is not FilterOp.Like
        elif isinstance(v, str):
            fits = isinstance(kind, T.StringType) and (equality or op is FilterOp.Like)
        elif isinstance(v, dt.datetime):
            fits = isinstance(kind, (T.TimestampType, T.TimestampNTZType)) and op is not FilterOp.Like
        elif isinstance(v, dt.date):
            fits = isinstance(kind, T.DateType) and op is not FilterOp.Like
        else:
            fits = False
        if not fits:
            raise InvalidQueryError(f"{p.column} ({kind.simpleString()}) {op.value} {v!r} is not supported")


def literal(value: object, kind: T.DataType) -> Column:
    """A literal that compares with a column of type ``kind``; timestamps without a zone stay without."""
    if isinstance(value, dt.datetime) and isinstance(kind, T.TimestampNTZType):
        return F.lit(value).cast("timestamp_ntz") if value.tzinfo is None else F.lit(value)
    if isinstance(value, int) and not isinstance(value, bool) and not -(1 << 63) <= value < 1 << 63:
        return F.lit(Decimal(value))
    return F.lit(value)


def condition(p: Predicate, spec: TableSpec) -> Column:
    """The predicate as a column: SQL's three-valued logic, so a comparison with null keeps nothing."""
    if isinstance(p, CompositeFilter):
        parts = [condition(c, spec) for c in p.children]
        if not parts:
            return F.lit(p.kind == "and")
        return reduce((lambda a, b: a & b) if p.kind == "and" else (lambda a, b: a | b), parts)
    c = F.col(f"`{p.column}`")
    if p.op is FilterOp.IsNull:
        return c.isNull()
    if p.op is FilterOp.IsNotNull:
        return c.isNotNull()
    if p.op is FilterOp.Like:
        return c.like(p.value)
    kind = spec.type_of(p.column)
    if p.op is FilterOp.In:
        return c.isin(*[literal(v, kind) for v in p.value]) if p.value else F.lit(False)
    return COMPARE[p.op](c, literal(p.value, kind))


def fits(value: object, kind: T.DataType) -> bool:
    """Whether a literal is a value of the column's type, so that equal means equal hashes."""
    if isinstance(kind, T.BooleanType):
        return isinstance(value, bool)
    if isinstance(kind, T.StringType):
        return isinstance(value, str)
    if isinstance(value, int) and not isinstance(value, bool):
        if isinstance(kind, T.DecimalType):
            return kind.scale == 0 and 0 <= value < 1 << 64
        bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}.get(type(kind))
        return bits is not None and -(1 << bits) <= value < 1 << bits
    if isinstance(kind, T.DoubleType):
        return isinstance(value, float)
    return coords.number_of(value, kind) is not None


def derive(p: Predicate | None, spec: TableSpec) -> Column | None:
    """What the predicate implies about the partition columns and the row id; None where it implies nothing.

    It is implied, never equivalent: the predicate itself is always applied too. AND keeps what either
    side implies, OR needs both. Bounds are on buckets, inclusive, so nothing overflows at the ends.
    """
    if p is None:
        return None
    if isinstance(p, CompositeFilter):
        parts = [derive(c, spec) for c in p.children]
        if p.kind == "and":
            parts = [x for x in parts if x is not None]
            return reduce(lambda a, b: a & b, parts) if parts else None
        if not parts:
            return F.lit(False)
        return None if any(x is None for x in parts) else reduce(lambda a, b: a | b, parts)
    kind = spec.type_of(p.column)
    if p.op is FilterOp.In:
        return derive(CompositeFilter.or_([Filter.eq(p.column, v) for v in p.value]), spec)
    if p.op not in COMPARE or p.op is FilterOp.NotEq:
        return None
    found: list[Column] = []
    if p.op is FilterOp.Eq and fits(p.value, kind):
        found += [F.col(f"__h{i}") == coords.literal_hash(p.value, kind, d.num_buckets) for i, d in enumerate(spec.hash_dimensions) if d.column == p.column]
    number = coords.number_of(p.value, kind)
    on_bucket = COMPARE[{FilterOp.Gt: FilterOp.GtEq, FilterOp.Lt: FilterOp.LtEq}.get(p.op, p.op)]
    if number is not None:
        for i, r in enumerate(spec.range_dimensions):
            if r.column == p.column and -(1 << 63) <= number < 1 << 63:
                found.append(on_bucket(F.col(f"__rg{i}"), F.lit(number // r.chunk_size).cast("long")))
        if spec.row_id.kind == "single" and spec.row_id.columns[0] == p.column and not spec.hashed_ids and fits(p.value, kind):
            key = number - coords.UNSIGNED if coords.unsigned(kind) else number
            found.append(on_bucket(F.col("__rb"), F.lit(key // spec.chunk_rows).cast("long")))
            found.append(COMPARE[p.op](F.col(ROW_ID), F.lit(key).cast("long")))  # every column group has it
    if spec.hashed_ids and spec.row_id.columns == (p.column,) and p.op is FilterOp.Eq and fits(p.value, kind):
        row = F.xxhash64(F.lit(p.value).cast(kind))
        found.append(F.col("__rb") == F.pmod(row, F.lit(spec.hashed_row_buckets).cast("long")))
    return reduce(lambda a, b: a & b, found) if found else None
