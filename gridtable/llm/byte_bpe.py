"""Byte-level BPE by dynamic programming over prefixes.

Each prefix of a byte string has exactly one token that can end its encoding: a token t that ends there
and whose predecessor, the last token of the prefix before t, stands next to t in some encoding. Two
tokens can stand side by side if undoing their merges from the latest back never meets a merge across
the border that would have come first. The table of last tokens is all there is to keep: walking it from
the end gives the ids, appended bytes extend it, and after an edit it is recomputed only until it agrees
with the old one over the length of the longest token.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridtable.llm.common import arrow, binary, slices, utf8
from gridtable.llm.pieces import Pieces

#: Pieces and pairs of tokens that a worker keeps; of the pieces half are forgotten when there are more, of the pairs all.
PIECES, PAIRS = 300_000, 250_000
#: More than any id.
PAIR = 1 << 32
#: Bytes of text that are encoded together.
SLICE = 1 << 19


class Vocabulary:
    """Ranks of byte strings; the merges that make each token are derived from them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: dict[int, bytes] = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.endings = {b[i:]: -1 for b in ranks for i in range(len(b))} | ranks  # -1: only the end of a token
        self.halves: dict[int, tuple[int, int]] = {}
        self.whole: dict[tuple[int, int], int] = {}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = self.merged(token, i)
                if len(parts) == 2:
                    self.halves[i] = (parts[0], parts[1])
                    self.whole[parts[0], parts[1]] = i
        self.sound: dict[int, bool] = {}  # by PAIR * left + right

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        return cls(read_ranks(path))

    def merged(self, text: bytes, below: int) -> list[int]:
        """Plain BPE with the merges of rank less than ``below``."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def adjacent(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' bytes is these two tokens."""
        known = self.sound.get(PAIR * left + right)
        if known is None:
            if len(self.sound) >= PAIRS:
                self.sound.clear()
            known = self.sound[PAIR * left + right] = self._undo(left, right)
        return known

    def _undo(self, left: int, right: int) -> bool:
        """Undo the later of the two sides' merges in turn; a merge across the border that precedes what was undone forbids the pair."""
        undone = 1 << 60
        while True:
            if self.whole.get((left, right), 1 << 60) < undone:
                return False
            if left in self.halves and (left > right or right not in self.halves):
                undone, left = left, self.halves[left][1]
            elif right in self.halves:  # of two equal merges the left one comes first
                undone, right = right + 1, self.halves[right][0]
            else:
                return True


class Prefixes:
    """The last tokens of all prefixes of a byte string that grows and changes."""

    def __init__(self, vocabulary: Vocabulary, text: bytes = b""):
        self.v, self.text, self.last = vocabulary, b"", [-1]
        self.append(text)

    def _extend(self, start: int, stop: int) -> None:
        """The last tokens of the prefixes of lengths start + 1 to stop."""
        text, last, adjacent = self.text, self.last, self.v.adjacent
        ending, sound = self.v.endings.get, self.v.sound.get
        for i in range(start + 1, stop + 1):
            fits, j = [], i - 1
            while j >= 0 and (token := ending(text[j:i])) is not None:
                if token >= 0:
                    fits.append((j, token))
                j -= 1
            for j, token in reversed(fits):
                if not j:
                    break
                left = last[j]
                known = sound(PAIR * left + token)
                if known or (known is None and adjacent(left, token)):
                    break
            else:
                raise ValueError("a byte is not in the vocabulary")
            last.append(token)

    def append(self, more: bytes) -> None:
        start, self.text = len(self.text), self.text + more
        self._extend(start, len(self.text))

    def cut(self, n: int) -> None:
        """Keep the first ``n`` bytes."""
        self.text = self.text[:n]
        del self.last[n + 1 :]

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of text[start:stop]; returns how many prefixes were computed."""
        old, shift = self.last, len(new) - (stop - start)
        self.text = self.text[:start] + new + self.text[stop:]
        self.last = old[: start + 1]
        same, done = 0, 0
        for i in range(start + 1, len(self.text) + 1):
            self._extend(i - 1, i)
            done += 1
            same = same + 1 if i - shift > stop and old[i - shift] == self.last[i] else 0
            if same >= self.v.longest:
                self.last += old[i - shift + 1 :]
                break
        return done

    def ids(self) -> list[int]:
        out, i = [], len(self.text)
        while i:
            out.append(self.last[i])
            i -= len(self.v.tokens[self.last[i]])
        return out[::-1]


class Encoder:
    """Encodes each match of a pattern by itself; pieces of earlier texts come from a bounded table."""

    def __init__(self, path: str, pattern: str):
        self.v = Vocabulary.read(path)
        self.pieces = Pieces(pattern, self.learn, PIECES)

    def learn(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of pieces. In sorted order each one shares a prefix's last tokens with the one before."""
        rank, found, table = self.v.ranks.get, {}, Prefixes(self.v)
        for raw in sorted(pieces):
            whole = rank(raw)
            if whole is not None:
                found[raw] = [whole]
                continue
            shared = 0
            for x, y in zip(raw, table.text, strict=False):
                if x != y:
                    break
                shared += 1
            table.cut(shared)
            table.append(raw[shared:])
            found[raw] = table.ids()
        return [found[p] for p in pieces]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, concatenated, and the offsets of the texts among them; null is empty."""
        return self.pieces.encode(*utf8(texts))


@lru_cache(maxsize=1)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path, pattern)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=1)
def token_bytes(path: str) -> dict[int, bytes]:
    """All that decoding needs of a vocabulary."""
    return {i: b for b, i in read_ranks(path).items()}


def decoded(ids: bytes, tokens: dict[int, bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, ids and the columns ``keep``): ids is binary, little-endian unsigned 32 bits an id.

    Null and empty texts have no ids; a text of any length is encoded whole. Rows are encoded one by one, repeated ones
    too, and an empty table gives none. Columns that are not named are not read; one of ``keep`` with the name of a
    column of the result gives way to it.
    """
    columns = list(dict.fromkeys(["doc_id", *(c for c in keep if c.lower() not in ("doc_id", "text", "n_tokens", "ids"))]))
    docs = docs.select("text", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, upto = own.encode(part.column(0))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(np.diff(upto)), binary(ids.astype("<u4", copy=False), upto)], names=[*columns, "n_tokens", "ids"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[1:])
    return arrow(docs, run, f"{kinds}, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with a column ``decoded``: the bytes that its ids stand for.

    Null ids are none and stand for no bytes; an empty table stays empty; other columns stay as they are, but for one
    that is named ``decoded`` already, which gives way. An id that the vocabulary does not have is an error.
    """
    encoded = encoded.select([f"`{c}`" for c in encoded.columns if c.lower() != "decoded"])
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_bytes(path)
        for batch in batches:
            texts = [decoded(x or b"", tokens) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return arrow(encoded, run, f"{kinds}, decoded binary")
