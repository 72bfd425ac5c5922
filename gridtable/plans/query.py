"""The query builder: columns, predicates, a limit, five aggregates; results are DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtable.errors import InvalidQueryError
from gridtable.plans.predicates import CompositeFilter, Predicate, check, columns_of
from gridtable.sources import reader
from gridtable.sources.manifest import State
from gridtable.spec import ROW_ID, TableSpec

if TYPE_CHECKING:
    from gridtable.database import Database


class Source:
    """A table as of one state; what snapshots and queries read."""

    def __init__(self, db: Database, spec: TableSpec, state: State):
        self.db, self.spec, self.state = db, spec, state

    def rows(self, columns: list[str], where: Predicate | None, cached: bool = False) -> DataFrame:
        """(row id, columns, and others) of the rows that ``where`` keeps."""
        if cached:
            from gridtable.plans.predicates import condition

            whole = self.db.cache.get_or_put(self.spec.name, self.state.txn, lambda: reader.read(self.db.spark, self.spec, self.state, self.spec.names).select(ROW_ID, *self.spec.names))
            return whole if where is None else whole.where(condition(where, self.spec))
        return reader.read(self.db.spark, self.spec, self.state, columns, where)


def referenced(plan) -> set[str]:
    """Names of all columns that the nodes of a logical plan refer to."""
    found, each = set(), plan.references().iterator()
    while each.hasNext():
        found.add(each.next().name())
    below = plan.children().iterator()
    while below.hasNext():
        found |= referenced(below.next())
    return found


class Groups:
    """The filtered rows of a query by some columns; aggregates read those and their own."""

    def __init__(self, query: QueryBuilder, columns: tuple[str, ...]):
        self._query, self._columns = query, columns

    def agg(self, *aggregates: Column) -> DataFrame:
        return self._query._reading(lambda rows: rows.groupBy(*self._columns).agg(*aggregates))

    def count(self) -> DataFrame:
        return self.agg(F.count(F.lit(1)).alias("count"))


class QueryBuilder:
    """``db.select("a", "b").from_("t").filter(Filter.eq("a", 1)).limit(5).execute()``.

    Filters are ANDed. ``execute`` gives a lazy DataFrame; the aggregates run. ``strict`` keeps to the
    typing rules of comparisons (see ``predicates.check``), else Spark's coercions hold.
    """

    def __init__(self, db: Database, columns: list[str] | None, source: Source | None = None, strict: bool = True):
        self._db, self._columns, self._source, self._strict = db, columns, source, strict
        self._filters: list[Predicate] = []
        self._limit: int | None = None
        self._order: list[Column] = []
        self._with_id, self._cached = False, False

    def select(self, *columns: str) -> QueryBuilder:
        self._columns = [c for x in columns for c in ([x] if isinstance(x, str) else x)]
        return self

    def select_all(self) -> QueryBuilder:
        self._columns = None
        return self

    def from_(self, table: str) -> QueryBuilder:
        self._source = self._db.source(table)
        return self

    def filter(self, predicate: Predicate | list[Predicate]) -> QueryBuilder:
        self._filters.append(CompositeFilter.of(predicate))
        return self

    def limit(self, n: int) -> QueryBuilder:
        if n < 0:
            raise InvalidQueryError("a limit is not negative")
        self._limit = n
        return self

    def order_by(self, *columns: str | Column) -> QueryBuilder:
        self._order += [F.col(c) if isinstance(c, str) else c for c in columns]
        return self

    def with_row_id(self) -> QueryBuilder:
        self._with_id = True
        return self

    def cached(self) -> QueryBuilder:
        """Keep the merged rows of the table's state in memory for later queries of the same state."""
        self._cached = True
        return self

    def strict(self, on: bool) -> QueryBuilder:
        self._strict = on
        return self

    def _where(self) -> Predicate | None:
        if not self._filters:
            return None
        return self._filters[0] if len(self._filters) == 1 else CompositeFilter.and_(self._filters)

    def _rows(self, columns: list[str]) -> DataFrame:
        if self._source is None:
            raise InvalidQueryError("no table: from_() is missing")
        spec, where = self._source.spec, self._where()
        unknown = sorted((set(columns) - {ROW_ID} | columns_of(where)) - set(spec.names))
        if unknown:
            raise InvalidQueryError(f"table {spec.name} has no columns {unknown}")
        if where is not None and self._strict:
            check(where, spec)
        return self._source.rows([c for c in columns if c != ROW_ID], where, self._cached)

    def execute(self) -> DataFrame:
        spec = self._source.spec if self._source else None
        columns = self._columns if self._columns is not None else (spec.names if spec else [])
        rows = self._rows(columns)
        if self._order:
            rows = rows.orderBy(*self._order)
        shown = [ROW_ID, *(c for c in columns if c != ROW_ID)] if self._with_id else columns
        rows = rows.select(*shown)
        return rows if self._limit is None else rows.limit(self._limit)

    def _reading(self, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``make`` of the filtered rows, with those columns alone that it refers to."""
        if self._source is None:
            raise InvalidQueryError("no table: from_() is missing")
        spec = self._source.spec
        plan = make(self._db.spark.createDataFrame([], spec.schema))._jdf.queryExecution().analyzed()
        return make(self._rows([c for c in spec.names if c in referenced(plan)]))

    def aggregate(self, *aggregates: Column) -> DataFrame:
        """Any aggregates of the filtered rows as one row. A limit has no effect on aggregates."""
        return self._reading(lambda rows: rows.agg(*aggregates))

    def group_by(self, *columns: str) -> Groups:
        return Groups(self, columns)

    def _one(self, column: str, aggregate: Callable[[Column], Column]):
        return self._rows([column]).agg(aggregate(F.col(f"`{column}`")).alias("x")).first()["x"]

    def count(self) -> int:
        return self._rows([]).agg(F.count(F.lit(1)).alias("n")).first()["n"]

    def sum(self, column: str):
        """0 of no rows."""
        return self._one(column, lambda c: F.coalesce(F.sum(c), F.lit(0)))

    def avg(self, column: str, null_as_zero: bool = False) -> float:
        """0.0 of no rows; nulls do not count, or with ``null_as_zero`` count as 0."""
        mean = self._one(column, lambda c: F.avg(F.coalesce(c, F.lit(0)) if null_as_zero else c))
        return 0.0 if mean is None else float(mean)

    def min(self, column: str):
        """None of no rows."""
        return self._one(column, F.min)

    def max(self, column: str):
        return self._one(column, F.max)


class Snapshot(Source):
    """A table at one transaction, whatever is committed later."""

    @property
    def txn(self) -> int:
        return self.state.txn

    def select(self, *columns: str) -> QueryBuilder:
        return QueryBuilder(self.db, None, self).select(*columns)

    def select_all(self) -> QueryBuilder:
        return QueryBuilder(self.db, None, self)

    def filter(self, predicate: Predicate | list[Predicate]) -> QueryBuilder:
        return self.select_all().filter(predicate)

    def count(self, predicate: Predicate | list[Predicate] | None = None) -> int:
        query = self.select_all()
        return (query if predicate is None else query.filter(predicate)).count()
