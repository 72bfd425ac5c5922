"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows up to which an id list may be broadcast: 8 bytes each, so about 16 MB.
BROADCAST_IDS = 1_000_000


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; the labelled rows with remainder 2 are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def scratch(spark: SparkSession) -> str:
    """A new folder for cut lineage in spark.checkpoint.dir. Where that is unset a cluster is an error, and a session on
    one machine, as in tests, has one made."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not base:  # one machine
        base = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/gridtable-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: a lost executor costs no recomputation."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    trim(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(ids: DataFrame, rows: int | None = None) -> DataFrame:
    """``ids`` with a broadcast hint if it is known to be small; else Spark shuffles."""
    n = ids.count() if rows is None else rows
    return F.broadcast(ids) if n <= BROADCAST_IDS else ids.hint("merge")


#: Bytes of a batch of rows between Spark and Python; a longer row is a batch of its own.
BATCH = 4 << 20
LIMIT, DEFAULT_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` in batches of BATCH bytes. The limit is a setting of the session, which keeps it if it has none of its own."""
    conf = df.sparkSession.conf
    if conf.get(LIMIT) == DEFAULT_LIMIT:
        conf.set(LIMIT, str(BATCH))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(whole, schema)


def give_back() -> None:
    """Return freed memory to the system: a worker waits for other tasks beside the next stage's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library that has it
    if trim is not None:
        trim(0)


def trim(spark: SparkSession) -> bool:
    """Return the memory that the driver's JVM has freed outside its heap, by many threads in many arenas, to the system;
    false on a JVM that can't. The method is the interface's: the class that implements it is not exported."""
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm

    def array(kind: object, *items: object) -> object:
        out = gateway.new_array(kind, len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out

    try:
        of = jvm.java.lang.Class.forName
        kinds = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
        invoke = of("javax.management.MBeanServer").getMethod("invoke", array(jvm.Class, *map(of, kinds)))
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        invoke.invoke(server, array(jvm.Object, name, "systemTrimNativeHeap", array(jvm.Object), array(jvm.String)))
    except Py4JError:
        return False
    return True


def slices(batch: pa.RecordBatch, text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``most`` bytes of text, or one longer row."""
    if not batch.num_rows:
        return
    _, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, concatenated, and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def binary(values: np.ndarray, upto: np.ndarray) -> pa.Array:
    """A binary column: the bytes of values[upto[i]:upto[i + 1]] in row i."""
    at = (upto * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(upto) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


#: Base of the rolling hash, odd, and its inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power_table(name: str, base: np.uint64, n: int) -> np.ndarray:
    """Powers from 0 on. A long text's table is not kept."""
    if len(_powers[name]) >= n:
        return _powers[name][:n]
    steps = np.full(max(n, 1 << 16), base, np.uint64)
    steps[0] = 1
    table = np.multiply.accumulate(steps)
    if n <= 4 << 20:
        _powers[name] = table
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes that ``inside`` (256 flags) marks; runs end with their row."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    mask = inside[data]
    opens = mask.copy()
    opens[1:] &= ~mask[:-1]
    closes = mask.copy()
    closes[:-1] &= ~mask[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    opens[cuts] = mask[cuts]
    closes[cuts - 1] = mask[cuts - 1]
    starts = np.flatnonzero(opens)
    ends = np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def rolling(data: np.ndarray, fold_table: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``run_hashes`` takes the hash of any run of bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(fold_table[data] * _power_table("up", BASE, len(data)), out=sums[1:])
    return sums


def run_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs [start, end)."""
    down = _power_table("down", INVERSE, len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_table: np.ndarray) -> np.ndarray:
    """``run_hashes`` after ``fold_table`` (256 values, 1 or more)."""
    return run_hashes(rolling(data, fold_table), starts, ends)


#: Bytes of letters, digits and everything beyond ASCII.
ALNUM = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def code_points(data: np.ndarray, offsets: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Byte positions ``at`` in their ``row`` as code points since the start of that row."""
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    return lead[at] - lead[offsets[row]]


def lower_ascii() -> np.ndarray:
    """A fold table that maps A-Z to a-z and adds 1, so that no byte counts as nothing."""
    table = np.arange(256, dtype=np.uint64)
    table[65:91] += 32
    return table + np.uint64(1)
