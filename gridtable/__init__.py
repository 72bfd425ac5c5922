"""A table engine on PySpark: tables split along several axes, pruned by the predicates of a query."""

from gridtable.database import Database
from gridtable.operators.compaction import AutoCompactionConfig, CompactionResult
from gridtable.plans.predicates import CompositeFilter, Filter, FilterOp
from gridtable.plans.query import QueryBuilder, Snapshot
from gridtable.spec import TableBuilder, TableSpec
from gridtable.streaming.inserter import StreamConfig

__all__ = ["AutoCompactionConfig", "CompactionResult", "CompositeFilter", "Database", "Filter", "FilterOp", "QueryBuilder", "Snapshot", "StreamConfig", "TableBuilder", "TableSpec"]
