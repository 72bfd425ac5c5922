"""Specifications of tables: columns, the axes along which they are split, row identity."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import types as T

from gridtable.errors import ConfigError

ROW_ID = "__row_id"
TXN = "__txn"

#: Type names, and the Spark types that hold them; unsigned types take the next wider one.
TYPES: dict[str, T.DataType] = {
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "uint8": T.ShortType(),
    "uint16": T.IntegerType(),
    "uint32": T.LongType(),
    "uint64": T.DecimalType(20, 0),
    "float32": T.FloatType(),
    "float": T.FloatType(),
    "float64": T.DoubleType(),
    "double": T.DoubleType(),
    "utf8": T.StringType(),
    "string": T.StringType(),
    "bool": T.BooleanType(),
    "boolean": T.BooleanType(),
    "date32": T.DateType(),
    "date": T.DateType(),
    "timestamp": T.TimestampNTZType(),
}
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def spark_type(name: str) -> T.DataType:
    """The Spark type of a type name in any case, or of Spark's own DDL; an unknown name is an error."""
    known = TYPES.get(name.strip().lower())
    if known is not None:
        return known
    try:
        return T._parse_datatype_string(name) if any(c in name for c in "<(") else T._parse_datatype_json_string(json.dumps(name.strip().lower()))
    except Exception as e:
        raise ConfigError(f"unknown type {name!r}") from e


def whole_number(kind: T.DataType) -> bool:
    return isinstance(kind, INTEGERS) or isinstance(kind, T.DecimalType) and kind.scale == 0


@dataclass(frozen=True)
class Column:
    name: str
    data_type: str
    nullable: bool = True
    primary_key: bool = False

    @property
    def type(self) -> T.DataType:
        return spark_type(self.data_type)


@dataclass(frozen=True)
class RangeDimension:
    """Rows of ``chunk_size`` consecutive values (days of a date, seconds of a timestamp) lie together."""

    column: str
    chunk_size: int


@dataclass(frozen=True)
class HashDimension:
    column: str
    num_buckets: int
    strategy: str = "PureHash"


@dataclass(frozen=True)
class RowIdStrategy:
    """snowflake: a counter; single: the value of one column; composite: a hash of several."""

    kind: str = "snowflake"
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[Column, ...]
    chunk_rows: int = 100_000
    range_dimensions: tuple[RangeDimension, ...] = ()
    hash_dimensions: tuple[HashDimension, ...] = ()
    column_groups: tuple[tuple[str, ...], ...] = ()
    row_id: RowIdStrategy = field(default_factory=RowIdStrategy)
    #: Row buckets of tables whose row ids are hashes, which have no order to cut by.
    hashed_row_buckets: int = 16

    def __post_init__(self) -> None:
        names = [c.name for c in self.columns]
        if not self.name or "/" in self.name or self.name.startswith(("_", ".")):
            raise ConfigError(f"bad table name {self.name!r}")
        if not names or len({n.lower() for n in names}) < len(names):
            raise ConfigError("column names must be there and differ")
        if any(n.startswith("__") for n in names):
            raise ConfigError("column names that start with __ are the engine's own")
        if self.chunk_rows <= 0 or self.hashed_row_buckets <= 0:
            raise ConfigError("chunk_rows and hashed_row_buckets must be positive")
        for d in self.hash_dimensions:
            if d.num_buckets <= 0:
                raise ConfigError("num_buckets must be positive")
            if isinstance(self.type_of(d.column), (T.ArrayType, T.StructType, T.MapType)):
                raise ConfigError(f"no hash dimension on {d.column}")
        for r in self.range_dimensions:
            kind = self.type_of(r.column)
            if r.chunk_size <= 0:
                raise ConfigError("chunk_size must be positive")
            if not (isinstance(kind, (*INTEGERS, T.DateType, T.TimestampNTZType, T.TimestampType))):
                raise ConfigError(f"no range dimension on {r.column} of {kind.simpleString()}")
        for n in [n for g in self.column_groups for n in g] + list(self.row_id.columns):
            self.type_of(n)
        if self.row_id.kind not in ("snowflake", "single", "composite"):
            raise ConfigError(f"unknown row id strategy {self.row_id.kind!r}")
        if self.row_id.kind == "single":
            kind = self.type_of(self.row_id.columns[0])
            if not (whole_number(kind) or isinstance(kind, T.StringType)):
                raise ConfigError(f"no row id from {kind.simpleString()}")

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise ConfigError(f"table {self.name} has no column {name!r}")

    def type_of(self, name: str) -> T.DataType:
        return self.column(name).type

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type, c.nullable, {"primary_key": c.primary_key}) for c in self.columns])

    @property
    def primary_key(self) -> list[str]:
        return [c.name for c in self.columns if c.primary_key]

    @property
    def hashed_ids(self) -> bool:
        return self.row_id.kind == "composite" or self.row_id.kind == "single" and isinstance(self.type_of(self.row_id.columns[0]), T.StringType)

    @property
    def coordinates(self) -> list[str]:
        """The partition columns: row bucket, hash buckets, range buckets."""
        return ["__rb", *(f"__h{i}" for i in range(len(self.hash_dimensions))), *(f"__rg{i}" for i in range(len(self.range_dimensions)))]

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @classmethod
    def from_json(cls, text: str) -> TableSpec:
        d = json.loads(text)
        return cls(
            d["name"],
            tuple(Column(**c) for c in d["columns"]),
            d["chunk_rows"],
            tuple(RangeDimension(**r) for r in d["range_dimensions"]),
            tuple(HashDimension(**h) for h in d["hash_dimensions"]),
            tuple(map(tuple, d["column_groups"])),
            RowIdStrategy(d["row_id"]["kind"], tuple(d["row_id"]["columns"])),
            d["hashed_row_buckets"],
        )

    @classmethod
    def from_record(cls, d: dict) -> TableSpec:
        """From the record form: name, columns, partitioning, row_id_strategy (see the README)."""
        try:
            part = d["partitioning"]
            columns = tuple(Column(c["name"], c["data_type"], c.get("nullable", False), c.get("primary_key", False)) for c in d["columns"])
            return cls(
                d["name"],
                columns,
                int(part["chunk_rows"]),
                tuple(RangeDimension(r["column"], int(r["chunk_size"])) for r in part.get("range_dimensions") or ()),
                tuple(HashDimension(h["column"], int(h["num_buckets"]), h.get("strategy") or "PureHash") for h in part.get("hash_dimensions") or ()),
                tuple(tuple(g) for g in part.get("column_groups") or ()),
                strategy_of(d["row_id_strategy"]) if d.get("row_id_strategy") else infer_row_id(columns),
            )
        except (KeyError, TypeError) as e:
            raise ConfigError(f"bad table record: {e!r}") from e

    @classmethod
    def from_yaml(cls, path: str) -> TableSpec:
        """From a YAML or JSON file in the record form."""
        with open(path, encoding="utf-8") as f:
            text = f.read()
        try:
            import yaml

            record = yaml.safe_load(text)
        except ImportError:
            record = json.loads(text)
        except Exception as e:
            raise ConfigError(f"{path}: {e}") from e
        if not isinstance(record, dict):
            raise ConfigError(f"{path} holds no record")
        return cls.from_record(record)


def strategy_of(value: object) -> RowIdStrategy:
    """``Snowflake``, ``{SingleColumn: name}`` or ``{CompositeHash: [names]}``, also written Name(column, ...)."""
    if isinstance(value, dict) and len(value) == 1:
        kind, columns = next(iter(value.items()))
        columns = [columns] if isinstance(columns, str) else list(columns)
    else:
        kind, _, rest = str(value).partition("(")
        columns = [c.strip(" []\"'") for c in rest.rstrip(")").split(",") if c.strip(" []\"'")]
    kinds = {"snowflake": "snowflake", "singlecolumn": "single", "compositehash": "composite"}
    if kind.strip().lower() not in kinds:
        raise ConfigError(f"unknown row id strategy {value!r}")
    return RowIdStrategy(kinds[kind.strip().lower()], tuple(columns))


def infer_row_id(columns: tuple[Column, ...]) -> RowIdStrategy:
    """No key: a counter; one key of whole numbers: its value; else a hash of the key."""
    key = [c for c in columns if c.primary_key]
    if not key:
        return RowIdStrategy()
    if len(key) == 1 and whole_number(key[0].type):
        return RowIdStrategy("single", (key[0].name,))
    return RowIdStrategy("composite", tuple(c.name for c in key))


class TableBuilder:
    """A table specification step by step; ``build`` infers the row id strategy if none was named."""

    def __init__(self, name: str):
        self._name, self._columns, self._chunk_rows = name, [], 100_000
        self._ranges, self._hashes, self._groups = [], [], []
        self._row_id: RowIdStrategy | None = None

    def add_column(self, name: str, data_type: str, nullable: bool = True) -> TableBuilder:
        self._columns.append(Column(name, data_type, nullable))
        return self

    def add_primary_key(self, name: str, data_type: str) -> TableBuilder:
        self._columns.append(Column(name, data_type, False, True))
        return self

    def chunk_rows(self, rows: int) -> TableBuilder:
        self._chunk_rows = rows
        return self

    def add_range_dimension(self, column: str, chunk_size: int) -> TableBuilder:
        self._ranges.append(RangeDimension(column, chunk_size))
        return self

    def add_hash_dimension(self, column: str, num_buckets: int) -> TableBuilder:
        self._hashes.append(HashDimension(column, num_buckets))
        return self

    def add_column_group(self, columns: list[str]) -> TableBuilder:
        self._groups.append(tuple(columns))
        return self

    def with_snowflake_id(self) -> TableBuilder:
        self._row_id = RowIdStrategy()
        return self

    def with_primary_key_as_row_id(self, column: str) -> TableBuilder:
        self._row_id = RowIdStrategy("single", (column,))
        return self

    def with_composite_key_as_row_id(self, columns: list[str]) -> TableBuilder:
        self._row_id = RowIdStrategy("composite", tuple(columns))
        return self

    def build(self) -> TableSpec:
        columns = tuple(self._columns)
        row_id = self._row_id or infer_row_id(columns)
        if row_id.kind != "snowflake":
            columns = tuple(replace(c, nullable=False) if c.name in row_id.columns else c for c in columns)
        return TableSpec(self._name, columns, self._chunk_rows, tuple(self._ranges), tuple(self._hashes), tuple(self._groups), row_id)
