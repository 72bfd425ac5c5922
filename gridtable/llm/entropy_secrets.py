"""Secrets: fixed patterns, and strings whose sliding-window entropy is that of random keys.

Candidate strings are long runs of key characters. For each character class a window slides over the
stretches of the candidate that stay within the class; character counts and the sum of c*log(c) change
by one character in and one out, so the entropy of each window costs a constant. Windows over the class's
threshold are joined to spans. An allow list suppresses what looks random and is not: words, runs of an
alphabet, repeated blocks, identifiers that are known to be public.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridtable.llm.common import arrow, code_points, slices, utf8, word_spans

#: Fixed patterns: kinds in the order in which spans at the same start are listed.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
#: One of these, in any case, is in every match of ASSIGN.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
HEX_BYTES = np.array([chr(b) in "0123456789abcdef" for b in range(256)])


@dataclass(frozen=True)
class CharacterClass:
    """window: characters looked at together; bits: the least entropy of a window, per character."""

    name: str
    members: frozenset[str]
    window: int
    bits: float


LETTERS = "abcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
CLASSES = (
    CharacterClass("hex", frozenset(DIGITS + "abcdefABCDEF"), 24, 3.0),
    CharacterClass("alnum", frozenset(DIGITS + LETTERS + LETTERS.upper()), 24, 3.7),
    CharacterClass("base64", frozenset(DIGITS + LETTERS + LETTERS.upper() + "+/_=-"), 32, 4.0),
)
KEY_BYTES = np.array([b < 128 and chr(b) in CLASSES[-1].members for b in range(256)])
SHORTEST = min(c.window for c in CLASSES)

#: Public identifiers and placeholders, in lower case.
ALLOWED = ("example", "placeholder", "xxxxxxxx", "changeme", "deadbeef", "00000000", "integrity-sha")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


def period(text: str) -> int:
    """The least distance at which a text repeats itself up to its end: its length less its longest border's."""
    borders = [0] * len(text)
    k = 0
    for i in range(1, len(text)):
        while k and text[i] != text[k]:
            k = borders[k - 1]
        k += text[i] == text[k]
        borders[i] = k
    return len(text) - k


def suppressed(text: str) -> bool:
    """Whether the allow list covers a span: words, alphabets, repeated blocks, public identifiers."""
    kinds = sum((any(c in DIGITS for c in text), any(c in LETTERS for c in text), any(c in LETTERS.upper() for c in text)))
    if kinds < 2 or not any(c in DIGITS for c in text):
        return True
    low = text.lower()
    if any(x in low for x in ALLOWED) or UUID.fullmatch(text):
        return True
    steps = sum(abs(ord(b) - ord(a)) <= 1 for a, b in zip(low, low[1:], strict=False))
    if steps > len(text) // 2:
        return True
    if 2 * period(text) <= len(text):
        return True
    words = re.split(r"[^A-Za-z]+", text)
    return sum(len(w) for w in words if len(w) >= 6 and (w[1:].islower() or w.isupper())) > 0.7 * len(text)


def high_entropy(text: str) -> list[tuple[int, int]]:
    """Disjoint spans of ``text`` that windows of high entropy cover."""
    found: list[list[int]] = []
    for c in CLASSES:
        last = [-1, -1]  # the last span of this class, which grows with the windows
        w = c.window
        table = [k * math.log2(k) if k else 0.0 for k in range(w + 2)]
        most = w * (math.log2(w) - c.bits) + 1e-9  # of the sum of k*log(k) in a window
        counts: dict[str, int] = {}
        total, start = 0.0, 0
        for i, x in enumerate(text):
            if x not in c.members:
                counts, total, start = {}, 0.0, i + 1
                continue
            k = counts.get(x, 0)
            counts[x] = k + 1
            total += table[k + 1] - table[k]
            if i - start + 1 > w:
                y = text[start]
                k = counts[y]
                counts[y] = k - 1
                total += table[k - 1] - table[k]
                start += 1
            if i - start + 1 == w and total <= most:
                if start > last[1]:
                    last = [start, i + 1]
                    found.append(last)
                last[1] = i + 1
    joined: list[list[int]] = []
    for a, b in sorted(found):
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(b, joined[-1][1])
        else:
            joined.append([a, b])
    return [(a, b) for a, b in joined if not suppressed(text[a:b])]


def runs(data: np.ndarray, offsets: np.ndarray, members: np.ndarray, least: int) -> list[tuple[int, int, int, str]]:
    """(row, start, end, text) of the maximal runs of ``members`` of at least so many bytes; code points."""
    starts, ends, row = word_spans(data, offsets, members)
    long = ends - starts >= least
    starts, ends, row = starts[long], ends[long], row[long]
    if not len(starts):
        return []
    at = code_points(data, offsets, starts, row)
    raw = [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    return list(zip(row.tolist(), at.tolist(), (at + (ends - starts)).tolist(), raw, strict=True))


def find(column: pa.Array) -> list[list[tuple[int, int, int]]]:
    """For each row the spans (start, kind, end), sorted; kind is a place in KINDS, the last the method's own."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
    for row, text in enumerate(column.to_pylist()):
        if not text:
            continue
        low = text.lower()
        if any(k in low for k in KEYWORDS):
            found[row] += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_ASSIGN]
        if "AKIA" in text:
            found[row] += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    data, offsets = utf8(column)
    for row, a, b, _ in runs(data, offsets, HEX_BYTES, LEAST_HEX):
        found[row].append((a, 2, b))
    for spans in found:
        spans.sort()
    new: list[tuple[int, int, int]] = []
    at, base, reach = -1, [], []
    for row, a, _, text in runs(data, offsets, KEY_BYTES, SHORTEST):
        if row != at:
            at, base = row, [s for s, _, _ in found[row]]
            reach = list(accumulate((e for _, _, e in found[row]), max))  # how far spans that begin here or before go
        for x, y in high_entropy(text):
            before = bisect_right(base, a + x)
            if not before or reach[before - 1] < a + y:
                new.append((row, a + x, a + y))
    for row, x, y in new:
        found[row].append((x, 3, y))
    for spans in found:
        spans.sort()
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_entropy, base, spans) for every row of ``docs`` (doc_id, text).

    ``base`` and ``spans`` are kind:start:end, comma-joined, of the fixed patterns and of everything found.
    Null and empty texts have no spans; a text of any length is read whole, in time that grows with its length; rows are
    taken one by one, so repeated ones have a row each and an empty table gives none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = find(part.column(1))
                count = [[sum(k == i for _, k, _ in spans) for spans in found] for i in range(len(KINDS))]
                base = [joined([s for s in spans if s[1] < 3]) for spans in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, pa.int64()) for c in count), pa.array(base), pa.array([joined(s) for s in found])],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base", "spans"],
                )

    return arrow(docs.select("doc_id", "text"), run, "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base string, spans string")


def redacted(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """``text`` with each stretch that spans cover replaced by ``mask``."""
    out, done = [], 0
    stretches: list[list[int]] = []
    for a, _, b in spans:
        if stretches and a < stretches[-1][1]:
            stretches[-1][1] = max(b, stretches[-1][1])
        else:
            stretches.append([a, b])
    for a, b in stretches:
        out += [text[done:a], mask]
        done = b
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with the secrets in ``text`` masked, and n_chars, where there is one, counted anew; the columns stay.

    Every row stays, whatever its columns are called; null and empty texts stay as they are, and so does n_chars of a
    text without secrets. Rows are taken one by one; an empty table stays empty.
    """
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = find(part.column(at))
                if any(found):
                    columns = list(part.columns)
                    texts = columns[at].to_pylist()
                    changed = [redacted(t, s, mask) if s else t for t, s in zip(texts, found, strict=True)]
                    columns[at] = pa.array(changed, columns[at].type)
                    if chars is not None:
                        counts = columns[chars].to_pylist()
                        columns[chars] = pa.array([len(t) if s else n for t, s, n in zip(changed, found, counts, strict=True)], columns[chars].type)
                    part = pa.RecordBatch.from_arrays(columns, schema=part.schema)
                yield part

    return arrow(docs, run, docs.schema)
