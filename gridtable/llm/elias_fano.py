"""Token ids as binary blocks with Elias-Fano encoded document boundaries.

Documents are tokenized in ascending order of doc_id and their ids, each document closed by an end id,
are concatenated. A block of the file holds a stretch of whole documents: the ids at the least width in
bytes that the vocabulary allows, and the documents' ends as an Elias-Fano sequence, whose low bits are
packed and whose high bits are unary, with the position of every 64th one so that the i-th end is found
without decoding the others. n ends below u take about 2 + log2(u / n) bits each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridtable.llm.common import arrow, binary, slices, utf8
from gridtable.llm.pieces import BYTE_LEVEL, Pieces, spread

#: Ids after which a block is closed, between two slices of texts.
BLOCK = 1 << 19
#: Bytes of text that are encoded together; a longer text is encoded by itself.
SLICE = 1 << 19
#: Ones between two samples of the select structure.
SAMPLE = 64
#: Pieces that a worker keeps the ids of.
PIECES = 600_000
#: Pieces that the library encodes in one call.
TOGETHER = 8192
#: Number of ones in a byte, and the place of its first, second, ... one.
ONES = np.array([b.bit_count() for b in range(256)])
PLACE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)])
FILE = "shard int, block int, first long, n_docs int, n_ids long, width int, low_bits int, doc_ids array<long>, low binary, high binary, samples binary, ids binary"


@dataclass(frozen=True)
class EliasFano:
    """A non-decreasing sequence of ``n`` integers: low bits packed, high bits unary, every 64th one's position."""

    n: int
    low_bits: int
    low: np.ndarray  # uint8
    high: np.ndarray  # uint8
    samples: np.ndarray  # uint32

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        shifts = np.arange(bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        return cls(n, bits, low, np.packbits(high, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def all(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            out = out + (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)
        return out

    def select(self, i: int) -> int:
        """The i-th value, from the sample before it and a few bytes."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, skip = at // 8, at % 8
        word = int(self.high[byte]) >> skip << skip
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        position = 8 * byte + (word & -word).bit_length() - 1
        first = i * self.low_bits
        raw = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little")
        return (position - i) << self.low_bits | raw >> first % 8 & ((1 << self.low_bits) - 1)

    def selected(self, places: np.ndarray) -> np.ndarray:
        """``select`` at an array of places: all go on from their samples together, over the bytes that hold ones."""
        if not len(places):
            return np.zeros(0, np.int64)
        filled = np.flatnonzero(self.high)
        at, left = self.samples[places // SAMPLE].astype(np.int64), places % SAMPLE
        nth = np.searchsorted(filled, at >> 3)
        word = self.high[at >> 3] & (0xFF << (at & 7)).astype(np.uint8)
        todo = np.arange(len(places))
        while len(todo := todo[ONES[word[todo]] <= left[todo]]):
            left[todo] -= ONES[word[todo]]
            nth[todo] += 1
            word[todo] = self.high[filled[nth[todo]]]
        value = (8 * filled[nth] + PLACE[word, left] - places) << self.low_bits
        bit = places * self.low_bits
        padded = np.append(self.low, np.zeros(8, np.uint8))
        raw = np.ndarray(len(self.low) + 1, "<i8", padded, strides=(1,))[bit >> 3]
        return value | raw >> (bit & 7) & ((1 << self.low_bits) - 1)

    @property
    def size(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.samples.nbytes


class Tokens:
    """A tokenizer of the tokenizers library. With the pattern by which it splits texts, pieces are encoded once and kept.

    ``plain``: the literal of a special token is text like any other; else texts that hold an added token go whole through the library.
    """

    def __init__(self, path: str, pattern: str | None, plain: bool = True):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = plain
        self.added = [] if plain else [t.content.encode() for t in self.own.get_added_tokens_decoder().values()]
        self.size = self.own.get_vocab_size()
        self.pieces = Pieces(pattern, self.learn, PIECES) if pattern else None
        self.line = self._ids(["\n"])[0] if pattern == BYTE_LEVEL else []

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for a in range(0, len(texts), TOGETHER) for x in self.own.encode_batch_fast(texts[a : a + TOGETHER], add_special_tokens=False)]

    def learn(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of pieces. Those of a space and more go together, with line ends between them, which the pattern and so
        the library splits off by themselves, and whose id no other piece has."""
        texts = [p.decode() for p in pieces]
        after = [i for i, t in enumerate(texts) if len(self.line) == 1 and len(t) > 1 and t[0] == " " and not t[1].isspace()]
        found: list[list[int]] = [[]] * len(texts)
        for a in range(0, len(after), TOGETHER):
            some = after[a : a + TOGETHER]
            ids = self._ids(["\n".join([texts[i] for i in some])])[0]
            ends = [*np.flatnonzero(np.array(ids) == self.line[0]).tolist(), len(ids)]
            for i, start, end in zip(some, [0, *(e + 1 for e in ends)], ends, strict=False):
                found[i] = ids[start:end]
        rest = sorted(set(range(len(texts))) - set(after))
        for i, ids in zip(rest, self._ids([texts[i] for i in rest]), strict=True):
            found[i] = ids
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, concatenated, and the offsets of the texts among them; null is empty."""
        data, offsets = utf8(texts)
        raw = data.tobytes() if self.added or not self.pieces else b""
        if self.pieces and not any(a in raw for a in self.added):
            return self.pieces.encode(data, offsets)
        rows = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        whole = [i for i, r in enumerate(rows) if not self.pieces or any(a in r for a in self.added)]
        ids: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(rows)
        if self.pieces:
            rest = sorted(set(range(len(rows))) - set(whole))
            flat, upto = self.pieces.encode(*utf8(texts.take(pa.array(rest, pa.int64()))))
            for i, x in zip(rest, np.split(flat, upto[1:-1]), strict=False):
                ids[i] = x
        for i, x in zip(whole, self._ids([rows[i].decode() for i in whole]), strict=True):
            ids[i] = np.array(x, np.uint32)
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.append(0, np.cumsum([len(x) for x in ids], dtype=np.int64))


@lru_cache(maxsize=1)
def tokens(path: str, pattern: str | None, plain: bool = True) -> Tokens:
    """One for each worker process."""
    return Tokens(path, pattern, plain)


def write(docs: DataFrame, folder: str, path: str, pattern: str | None = None, end: int = 0, plain: bool = True) -> None:
    """Write the ids of ``docs`` (doc_id, text) to ``folder``, in ascending order of doc_id, ``end`` after each document.

    A null or empty text has the end id alone; a text of any length is encoded whole. Rows of one doc_id follow
    each other by a hash of the text, equal ones as they come; those without doc_id come first. An empty table gives
    a folder without blocks. Other columns are not read, whatever their names. ``plain`` as in Tokens. The documents
    are dealt out by ranges of doc_id, one shard a task, so that the shards in order are the corpus in order; many
    rows of one doc_id, or without any, fall into several ranges.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "tie", "row"]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard = tokens(path, pattern, plain), TaskContext.get().partitionId()
        width = 2 if own.size <= 1 << 16 and end < 1 << 16 else 4
        block, first, ids, chunks, sizes = 0, 0, [], [], []

        def row() -> pa.RecordBatch:
            ends = EliasFano.of(np.cumsum(np.concatenate(sizes)))
            flat = np.concatenate(chunks)
            values = [shard, block, first, ends.n, len(flat), width, ends.low_bits]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
            columns = [pa.array([v], k) for v, k in zip(values, kinds, strict=True)]
            columns.append(pa.ListArray.from_arrays(pa.array([0, ends.n], pa.int32()), pa.concat_arrays(ids)))
            columns += [binary(x, np.array([0, len(x)])) for x in (ends.low, ends.high, ends.samples.astype("<u4"), flat)]
            return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in FILE.split(", ")])

        for batch in batches:
            for part in slices(batch, "text", SLICE):
                flat, upto = own.encode(part.column(1))
                ids.append(part.column(0))
                chunks.append(np.insert(flat, upto[1:], end).astype(f"<u{width}"))
                sizes.append(np.diff(upto) + 1)
                if sum(map(len, chunks)) >= BLOCK:
                    yield row()
                    block, first, ids, chunks, sizes = block + 1, first + sum(map(len, chunks)), [], [], []
        if chunks:
            yield row()

    arrow(rows, run, FILE).write.option("compression", "zstd").parquet(folder)


def read(docs_folder: str, spark: SparkSession, only: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of the files in ``docs_folder``, or of those with an id in ``only``.

    ``start`` counts the ids of all documents before it; ids is binary, little-endian unsigned 32 bits each. Where a
    document begins and ends comes from the select structure of its block. A null doc_id stays null; repeated ids and
    equal documents have a row each; a folder without blocks gives no rows. Files that ``write`` did not make are not read.
    """
    blocks = spark.read.schema(FILE).parquet(docs_folder)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("total"))  # a row a shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    whole = blocks.join(F.broadcast(offsets), "shard").withColumn("first", F.col("first") + F.col("offset"))
    if only is not None:
        whole = whole.where(F.arrays_overlap("doc_ids", F.lit(only).cast("array<long>")))
    whole = whole.select("first", "n_docs", "width", "low_bits", "doc_ids", "low", "high", "samples", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                first, n, width, bits = (c[r].as_py() for c in batch.columns[:4])
                doc_ids = batch.column(4)[r].values
                low, high, samples, ids = (np.frombuffer(c[r].as_buffer(), kind) for c, kind in zip(batch.columns[5:], ("u1", "u1", "<u4", f"<u{width}"), strict=True))
                sequence = EliasFano(n, bits, low, high, samples)
                wanted = np.arange(n) if only is None else np.flatnonzero(np.isin(doc_ids.to_numpy(zero_copy_only=False), only))
                ends = sequence.selected(wanted)
                starts = np.where(wanted > 0, sequence.selected(np.maximum(wanted - 1, 0)), 0)
                n_tokens = ends - starts
                flat = ids[spread(starts, n_tokens)] if only is not None else ids
                columns = [doc_ids.take(pa.array(wanted)), pa.array(starts + first), pa.array(n_tokens), binary(flat.astype("<u4"), np.append(0, np.cumsum(n_tokens)))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])

    return arrow(whole, run, "doc_id long, start long, n_tokens long, ids binary")
