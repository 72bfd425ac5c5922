"""Splitting texts into the pieces that tokenizers encode by themselves, and encoding each piece once.

The rows of a batch are split together, by array operations over their characters, and looked up
together in a table of pieces that an earlier text of the same worker had. Keys are the bytes of the
pieces themselves, so that no hash decides what a piece is.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

from gridtable.llm.common import mix

#: Fixed value: the pattern of byte-level BPE vocabularies, which is split by arrays here; others by their own regular expression.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OTHER, SPACE, LETTER, NUMBER = range(4)
#: Words of 8 bytes in a key; pieces of more bytes than fit are not kept.
WORDS = 3
LONGEST = 8 * WORDS - 1
#: The first n bytes of a word.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """For each code point whether it is a space, a letter, a number or something else, as the regular expressions take it."""
    table = np.full(0x110000, OTHER, np.uint8)
    known = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, name in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(name, known):
            table[ord(m.group()[0]) : ord(m.group()[-1]) + 1] = kind
    return table


def split_byte_level(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end, in bytes, of all matches of BYTE_LEVEL in the rows; the matches of a row leave nothing out."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if data.max() < 0x80:
        lead, points = None, data
        rows, stop = offsets[:-1], offsets[1:]
    else:
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        rows, stop = np.searchsorted(lead, offsets[:-1]), np.searchsorted(lead, offsets[1:])
    kind, n = classes()[points], len(points)
    begins = np.zeros(n + 1, bool)
    begins[rows] = begins[n] = True
    opens = begins.copy()
    opens[1:n] |= kind[1:] != kind[:-1]
    # The last character of a run of spaces stands by itself before something else, or goes with it if it is \x20.
    after = np.flatnonzero(opens[1:n] & ~begins[1:n] & (kind[:-1] == SPACE)) + 1
    opens[after - 1] = True
    opens[after] = points[after - 1] != 0x20
    # Contractions are matched only where a match begins.
    quote = np.flatnonzero((points == 0x27) & opens[:n])
    if len(quote):
        end = stop[np.searchsorted(rows, quote, side="right") - 1]
        padded = np.append(points, np.zeros(2, points.dtype))
        one, two = padded[quote + 1], padded[quote + 2]
        short = (quote + 1 < end) & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        pair = ((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)
        pair &= quote + 2 < end
        opens[quote[short | pair] + 1] = False
        opens[quote[pair] + 2] = False
        opens[quote[short] + 2] = opens[quote[pair] + 3] = True
    starts = np.flatnonzero(opens)
    if lead is not None:
        starts = np.append(lead, len(data))[starts]
    return starts[:-1], starts[1:]


def splitter(pattern: str) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """From the bytes of some rows and their offsets to start and end, in bytes, of all matches of ``pattern`` in each."""
    if pattern == BYTE_LEVEL:
        return split_byte_level
    each = regex.compile(pattern).finditer

    def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [np.zeros((0, 2), np.int64)]
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            spans = np.array([m.span() for m in each(data[a:b].tobytes().decode())], np.int64).reshape(-1, 2)
            spans = spans[spans[:, 1] > spans[:, 0]]
            found.append(np.append(np.flatnonzero((data[a:b] & 0xC0) != 0x80), b - a)[spans] + a)
        both = np.concatenate(found)
        return both[:, 0], both[:, 1]

    return split


def grown(x: np.ndarray, n: int) -> np.ndarray:
    """``x`` with room for ``n`` entries."""
    if len(x) >= n:
        return x
    out = np.zeros(max(n, 2 * len(x)), x.dtype)
    out[: len(x)] = x
    return out


class Pieces:
    """Ids of texts by way of their pieces. ``learn`` gives the ids of new pieces. Of pieces of at most LONGEST bytes about
    ``most`` are kept, at 50 bytes each and 4 an id; when there are more, the half that occurred least is forgotten."""

    def __init__(self, pattern: str, learn: Callable[[list[bytes]], list[list[int]]], most: int):
        self.split, self.learn, self.most = splitter(pattern), learn, most
        self._clear()

    def _clear(self) -> None:
        self.used, self.ids = 0, 0
        self.keys = [np.zeros(1024, np.uint64) for _ in range(WORDS)]
        self.start, self.size, self.hits = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.uint32)
        self.slots = np.full(4096, -1, np.int32)

    def _hashes(self, keys: list[np.ndarray]) -> np.ndarray:
        return mix(sum(k * m for k, m in zip(keys, ODD, strict=True)))

    def _find(self, keys: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
        """The entries of keys, -1 for those that are not there."""
        mask = np.uint64(len(self.slots) - 1)
        at = (hashes & mask).astype(np.int64)
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        while len(left):
            entry = self.slots[at].astype(np.int64)
            there = entry >= 0
            entry, at, left = entry[there], at[there], left[there]
            same = self.keys[0][entry] == keys[0][left]
            for mine, theirs in zip(self.keys[1:], keys[1:], strict=True):
                same &= mine[entry] == theirs[left]
            out[left[same]] = entry[same]
            at, left = (at[~same] + 1) & int(mask), left[~same]
        return out

    def _place(self, entries: np.ndarray) -> None:
        """Give entries, whose keys are all different and new, a slot each."""
        mask = len(self.slots) - 1
        at = (self._hashes([k[entries] for k in self.keys]) & np.uint64(mask)).astype(np.int64)
        while len(entries):
            free = self.slots[at] < 0
            self.slots[at[free]] = entries[free]
            left = self.slots[at] != entries
            entries, at = entries[left], (at[left] + 1) & mask

    def _add(self, keys: list[np.ndarray], found: list[list[int]]) -> None:
        n = self.used + len(found)
        self.keys = [grown(k, n) for k in self.keys]
        self.start, self.size, self.hits = grown(self.start, n), grown(self.size, n), grown(self.hits, n)
        new = np.arange(self.used, n)
        for mine, k in zip(self.keys, keys, strict=True):
            mine[new] = k
        size = np.fromiter(map(len, found), np.int64, len(found))
        ends = self.ids + np.cumsum(size)
        self.flat = grown(self.flat, int(ends[-1]))
        self.flat[self.ids : ends[-1]] = np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))
        self.start[new], self.size[new], self.hits[new] = ends - size, size, 0
        self.used, self.ids = n, int(ends[-1])
        if 2 * n > len(self.slots):
            self.slots = np.full(1 << (4 * n).bit_length(), -1, np.int32)
            new = np.arange(n)
        self._place(new)

    def _forget(self) -> None:
        """Keep the half of the pieces that occurred most, if they did so again at all."""
        hits = self.hits[: self.used]
        kept = np.argsort(-hits, kind="stable")[: self.most // 2]
        kept = kept[hits[kept] > 1]
        keys, size, start, flat = [k[kept] for k in self.keys], self.size[kept], self.start[kept], self.flat
        hits = hits[kept] // 2
        self._clear()
        if len(kept):
            ids = flat[spread(start, size)]
            self._add(keys, np.split(ids, np.cumsum(size)[:-1]))
            self.hits[: len(kept)] = hits

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, concatenated, as unsigned 32-bit numbers, and the n + 1 offsets of the rows among them."""
        if self.used > self.most:
            self._forget()
        starts, ends = self.split(data, offsets)
        length, raw = ends - starts, data.tobytes()
        padded = np.frombuffer(raw + bytes(8 * WORDS), np.uint8)
        words = np.ndarray(len(data) + 8 * WORDS - 7, "<u8", padded, strides=(1,))
        short = np.flatnonzero(length <= LONGEST)
        a, n = starts[short], length[short]
        keys = [words[a + 8 * i] & FIRST[np.clip(n - 8 * i, 0, 8)] for i in range(WORDS)]
        keys[-1] |= n.astype(np.uint64) << np.uint64(56)
        hashes = self._hashes(keys)
        entry = np.full(len(starts), -1, np.int64)
        entry[short] = self._find(keys, hashes)
        while len(miss := np.flatnonzero(entry[short] < 0)):
            new = miss[np.unique(hashes[miss], return_index=True)[1]]
            pieces = [raw[i:j] for i, j in zip(a[new].tolist(), (a[new] + n[new]).tolist(), strict=True)]
            self._add([k[new] for k in keys], self.learn(pieces))
            entry[short[miss]] = self._find([k[miss] for k in keys], hashes[miss])
        self.hits[: self.used] += np.bincount(entry[short], minlength=self.used)[: self.used]
        where, size = self.start[entry], self.size[entry]
        flat, long = self.flat, np.flatnonzero(length > LONGEST)
        if len(long):
            pieces = [raw[i:j] for i, j in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
            distinct = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
            found = self.learn(list(distinct))
            each = np.fromiter(map(len, found), np.int64, len(found))
            which = np.fromiter(map(distinct.__getitem__, pieces), np.int64, len(pieces))
            where[long], size[long] = (self.ids + np.cumsum(each) - each)[which], each[which]
            flat = np.concatenate([self.flat[: self.ids], np.fromiter(chain.from_iterable(found), np.uint32, int(each.sum()))])
        upto = np.append(0, np.cumsum(size))
        return flat[spread(where, size)], upto[np.searchsorted(starts, offsets)]


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)
