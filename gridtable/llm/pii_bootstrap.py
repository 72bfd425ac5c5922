"""Personal data: fixed patterns, and bootstrapped contextual extraction.

What the fixed patterns find seeds the search. The words before a seed are a lexical pattern of its
kind; a pattern's instances are the identifier-like strings that follow it anywhere in the corpus. Spark
scores the bipartite graph of patterns and instances in turns: a pattern is trusted by the trust in its
instances over all its occurrences, an instance by the chance that not all its patterns are wrong.
What patterns of high trust discover then stands as seed for the next generation of patterns. In the
end the trusted ones find identifiers that no fixed pattern describes. The graph is a table; all that is
broadcast is of bounded size.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtable.llm.common import arrow, cut, lower_ascii, mix, rolling, run_hashes, slices, utf8, word_spans

#: Kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns. An address is looked for from its @, and the word before it taken whole, which finds the same.
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

SPACES = np.array([b in (0x20, 9, 10, 11, 12, 13) for b in range(256)])
WORDS = ~SPACES
DIGITS = np.array([0x30 <= b <= 0x39 for b in range(256)])
LOWER = lower_ascii()
#: Patterns that are looked for in one pass over the texts, at 12 bytes each; more go in more passes.
BLOCK = 1_000_000
#: Most bits of the table that tells which words cannot be patterns, and bits for each pattern below that.
BITS, EACH = 1 << 27, 16
EDGE = "pattern long, instance long, kind int, n long"


@dataclass(frozen=True)
class Settings:
    """support: distinct seeds that a pattern needs; trust: what a pattern needs to be used; turns of the
    scoring; generations of patterns, of which the first comes from the fixed patterns' seeds; digits: digits, or an @,
    make a word identifier-like."""

    support: int = 4
    trust: float = 0.6
    turns: int = 4
    generations: int = 3
    digits: int = 4


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, in the order of kinds and places."""
    found: list[tuple[int, int, int]] = []
    if "@" in text:
        done = 0
        at = AT.search(text)
        while at:
            start = at.start()
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < at.start():
                found.append((0, start, at.end()))
                done = at.end()
                at = AT.search(text, done)
            else:
                at = AT.search(text, at.start() + 1)
    if DIGIT.search(text):
        if "." in text:
            found += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found.append((2, *m.span()))
        if "+" in text:
            found += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdecimal() for c in m.group()) <= 15]
    return found


def hashed(text: str) -> int:
    data = np.frombuffer(text.encode(), np.uint8)
    return int(run_hashes(rolling(data, LOWER), np.array([0]), np.array([len(data)])).view(np.int64)[0])


def contexts(words: list[str]) -> list[int]:
    """The patterns of the last word and of the last two, in lower case."""
    one = [hashed(w) for w in words[-2:]]
    return [one[-1], *([pair(one[0], one[1])] if len(one) == 2 else [])] if one else []


def pair(a: int, b: int) -> int:
    return int(pair_arrays(np.array([a], np.int64), np.array([b], np.int64))[0])


def pair_arrays(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a.view(np.uint64) + np.uint64(1)) + b.view(np.uint64)).view(np.int64)


def core(word: str) -> str:
    """A word without the punctuation round it."""
    return word.strip(".,;:!?\"'()[]{}<>*#$%&|")


class Text:
    """Words of some rows as arrays: byte spans, rows, hashes, patterns that end with each word, and which look like identifiers."""

    def __init__(self, column: pa.Array, least: int):
        self.data, self.offsets = utf8(column)
        starts, self.ends, self.row = word_spans(self.data, self.offsets, WORDS)
        self.starts = starts
        self.word = run_hashes(rolling(self.data, LOWER), starts, self.ends).view(np.int64)
        self.two = np.zeros(len(starts), np.int64)
        self.same = np.zeros(len(starts), bool)
        self.same[1:] = self.row[1:] == self.row[:-1]
        self.two[1:] = pair_arrays(self.word[:-1], self.word[1:])
        digits = np.concatenate([[0], np.cumsum(DIGITS[self.data])])
        at = np.concatenate([[0], np.cumsum(self.data == 0x40)])
        self.like = (digits[self.ends] - digits[starts] >= least) | (at[self.ends] > at[starts])


def batch_of(edges: Counter[tuple[int, int | None, int | None]]) -> pa.RecordBatch:
    p, x, k = zip(*edges, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(x, pa.int64()), pa.array(k, pa.int32()), pa.array(edges.values(), pa.int64())], names=["pattern", "instance", "kind", "n"])


def gather(docs: DataFrame, s: Settings) -> DataFrame:
    """(pattern, instance, kind, n): the contexts of what the fixed patterns find, and with a null kind those of every
    word that is like an identifier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges: Counter[tuple[int, int | None, int | None]] = Counter()
            for part in slices(batch, "text"):
                for text in part.column(0).to_pylist():
                    for kind, a, b in base_spans(text) if text else []:
                        before = re.findall(r"[^\x20\x09-\x0D]+", text[max(0, a - 120) : a])
                        for pattern in contexts(before):
                            edges[pattern, hashed(text[a:b]), kind] += 1
                words = Text(part.column(0), s.digits)
                at = np.flatnonzero(words.like & words.same)
                for i, pair in zip(at.tolist(), (words.same[at - 1]).tolist(), strict=True):
                    word = core(words.data[words.starts[i] : words.ends[i]].tobytes().decode())
                    if word:
                        instance = hashed(word)
                        edges[int(words.word[i - 1]), instance, None] += 1
                        if pair:
                            edges[int(words.two[i - 1]), instance, None] += 1
            if edges:
                yield batch_of(edges)

    return arrow(docs.select("text"), run, EDGE).groupBy("pattern", "instance", "kind").agg(F.sum("n").alias("n"))


def sieve(patterns: DataFrame, n: int) -> np.ndarray:
    """A table of bits, at the places of the ``n`` patterns' hashes; of BITS bits at most, however many there are."""
    bits = min(BITS, max(1 << 16, 1 << (EACH * n).bit_length()))
    at = F.col("pattern").bitwiseAND(F.lit(bits - 1))
    one = F.expr("shiftleft(1L, cast(pattern & 63 as int))")
    rows = patterns.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(one).alias("b")).toArrow()
    table = np.zeros(bits >> 6, np.int64)
    table[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return table


def passes(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False for what cannot be a pattern."""
    at = hashes & ((len(table) << 6) - 1)
    return (table[at >> 6] >> (at & 63)) & 1 == 1


def occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, places): how often a word follows each of the ``patterns`` (pattern), whatever it is.

    What passes the sieve is looked up among the patterns, a BLOCK of them in one pass over the texts, so that a task
    gives one row for each pattern that it has met, and none for other words.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(sieve(patterns, patterns.count()))
    places = patterns.selectExpr("pattern", "0L AS places").where("false")
    for (block,) in blocks(patterns, "pattern"):
        known = spark.sparkContext.broadcast(block)
        counted = arrow(docs.select("text"), counter(table, known), "pattern long, n long").groupBy("pattern")
        places = places.union(cut(counted.agg(F.sum("n").alias("places"))))
        known.destroy()
    table.destroy()
    return places


def counter(table, known):
    """For mapInArrow: how often a word follows each pattern of a broadcast block, once for all texts of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = known.value
        counts = np.zeros(len(patterns), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                text = Text(part.column(0), 0)
                follows = np.append(text.same[1:], False)
                for found, there in ((text.word, follows), (text.two, follows & text.same)):
                    found = found[there & passes(table.value, found)]
                    pos = np.minimum(np.searchsorted(patterns, found), len(patterns) - 1)
                    counts += np.bincount(pos[patterns[pos] == found], minlength=len(patterns))
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(patterns[met]), pa.array(counts[met])], names=["pattern", "n"])

    return run


def trusted(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(pattern, kind, trust, places): the patterns that are used, each for its most likely kind, a lesser one of equals.

    Null and empty texts have no patterns; repeated rows count as often; a corpus without seeds, or an empty table,
    gives no rows. Columns besides text are not read, whatever their names.
    """
    edges = cut(gather(docs, s))
    found, known = edges.where("kind IS NOT NULL"), edges.where("kind IS NOT NULL").select("instance").distinct()
    linked = cut(edges.where("kind IS NULL").drop("kind").join(known, "instance", "left_anti"))
    # A seed of several words is counted from its own edges; what else stands there, from the places.
    of_seeds = cut(found.groupBy("pattern", "kind").agg(F.sum("n").alias("seeded")))
    fresh = cut(found.groupBy("pattern").agg(F.countDistinct("instance").alias("seeds")).where(F.col("seeds") >= s.support).select("pattern"))
    kinds = of_seeds.select("pattern", "kind")
    best = docs.sparkSession.createDataFrame([], "pattern long, kind int, trust double, places long")
    places = None
    for generation in range(s.generations):
        if fresh.isEmpty():
            break
        counted = occurrences(docs, fresh)
        places = counted if places is None else cut(places.union(counted))
        base = kinds.join(places, "pattern").join(of_seeds, ["pattern", "kind"], "left").withColumn("seeded", F.coalesce("seeded", F.lit(0)))
        base = cut(base.withColumn("trust", F.least(F.lit(1.0), F.col("seeded") / F.greatest("places", "seeded"))))
        best = cut(scored(base, linked.join(places.select("pattern"), "pattern", "left_semi"), s))
        if generation + 1 < s.generations:
            believed = linked.join(best.select("pattern", "kind"), "pattern").select("instance", "kind").distinct()
            more = linked.join(believed, "instance")
            support = more.groupBy("pattern").agg(F.countDistinct("instance").alias("k")).where(F.col("k") >= s.support).select("pattern")
            fresh = cut(support.join(places.select("pattern"), "pattern", "left_anti"))
            kinds = cut(kinds.union(more.join(fresh, "pattern", "left_semi").select("pattern", "kind")).distinct())
    return best


def scored(base: DataFrame, linked: DataFrame, s: Settings) -> DataFrame:
    """The trusted of the patterns ``base`` (pattern, kind, seeded, places, trust), after turns between them and the
    instances that they are ``linked`` with (pattern, instance, n)."""
    trust = base
    for _ in range(s.turns):
        doubt = F.sum(F.log1p(-F.least(F.col("trust"), F.lit(0.999))))
        instances = linked.join(trust.select("pattern", "kind", "trust"), "pattern").groupBy("instance", "kind").agg((1 - F.exp(doubt)).alias("score"))
        gained = linked.join(instances, "instance").groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("gained"))
        share = (F.col("seeded") + F.coalesce("gained", F.lit(0.0))) / F.greatest("places", "seeded")
        trust = cut(base.drop("trust").join(gained, ["pattern", "kind"], "left").withColumn("trust", F.least(F.lit(1.0), share)).drop("gained"))
    best = trust.where(F.col("trust") >= s.trust).groupBy("pattern").agg(F.max(F.struct("trust", (-F.col("kind")).alias("kind"), "places")).alias("m"))
    return best.select("pattern", (-F.col("m.kind")).alias("kind"), F.col("m.trust").alias("trust"), F.col("m.places").alias("places"))


def discovered(part: pa.Array, patterns: np.ndarray, kinds: np.ndarray, s: Settings) -> dict[int, list[tuple[int, int, int]]]:
    """For each row the (kind, start, end) of identifiers after trusted patterns, in code points."""
    text = Text(part, s.digits)
    found: dict[int, list[tuple[int, int, int]]] = {}
    after = np.flatnonzero(text.like & text.same)
    if not len(after) or not len(patterns):
        return found
    for hashes, at in ((text.word, after), (text.two, after[text.same[after - 1]])):
        pos = np.minimum(np.searchsorted(patterns, hashes[at - 1]), len(patterns) - 1)
        hit = patterns[pos] == hashes[at - 1]
        for i, k in zip(at[hit].tolist(), kinds[pos[hit]].tolist(), strict=True):
            row = int(text.row[i])
            begin = int(text.offsets[row])
            word = text.data[text.starts[i] : text.ends[i]].tobytes().decode()
            inner = core(word)
            if inner:
                a = len(text.data[begin : text.starts[i]].tobytes().decode()) + word.index(inner)
                found.setdefault(row, []).append((k, a, a + len(inner)))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


ROW = "doc_id long, text string, more array<struct<kind: int, start: long, end: long>>"


def blocks(patterns: DataFrame, *columns: str) -> Iterator[tuple[np.ndarray, ...]]:
    """These columns of the patterns, sorted by pattern, in as many parts as there are BLOCKs of them; each part is of bounded size."""
    n = patterns.count()
    parts = -(-n // BLOCK)
    for k in range(parts):
        some = patterns if parts == 1 else patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == k)
        rows = some.select(*columns).orderBy("pattern").toArrow()
        if rows.num_rows:
            yield tuple(rows[c].to_numpy() for c in columns)


def extract(docs: DataFrame, patterns: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_found, base, spans) for every row of ``docs`` (doc_id, text).

    ``base`` and ``spans`` are kind:start:end, comma-joined, of the fixed patterns and of everything found;
    what a trusted pattern finds is of the pattern's kind and overlaps no span of the fixed patterns.
    Null and empty texts have no spans, long ones are read whole; rows are taken one by one, so repeated ones have a row
    each and an empty table gives none; other columns are not read. The patterns are broadcast, a BLOCK of them at a
    time: with more of them the spans found so far are written with the rows for the next pass.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    last = spark.sparkContext.broadcast((np.zeros(0, np.int64), np.zeros(0, np.int32)))
    for k, block in enumerate(blocks(patterns, "pattern", "kind")):
        if k:
            rows = cut(arrow(rows, collector(last, s), ROW))
        last.destroy()
        last = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                base = [base_spans(t) if t else [] for t in part.column(1).to_pylist()]
                more = spans_so_far(part, *last.value, s)
                new = []
                for spans, found in zip(base, more, strict=True):
                    taken = sorted((a, b) for _, a, b in spans)
                    reach = list(accumulate((b for _, b in taken), max))
                    free = lambda x: not (k := bisect_left(taken, (x[2], 0))) or reach[k - 1] <= x[1]  # noqa: E731, B023
                    new.append(sorted({x for x in found if free(x)}))
                count = [[sum(k == i for k, _, _ in spans) for spans in base] for i in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, pa.int64()) for c in count), pa.array([len(x) for x in new], pa.int64()), pa.array([joined(x) for x in base]), pa.array([joined(sorted(x + y)) for x, y in zip(base, new, strict=True)])],
                    names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_found", "base", "spans"],
                )

    return arrow(rows, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_found long, base string, spans string")


def spans_so_far(part: pa.RecordBatch, patterns: np.ndarray, kinds: np.ndarray, s: Settings) -> list[list[tuple[int, int, int]]]:
    """For each row what these patterns find, and what earlier ones did, which its column ``more`` holds."""
    found = discovered(part.column(1), patterns, kinds, s)
    old = part.column(2).to_pylist() if part.num_columns > 2 else [[]] * part.num_rows
    return [[(x["kind"], x["start"], x["end"]) for x in more or []] + found.get(i, []) for i, more in enumerate(old)]


def collector(share, s: Settings):
    """For mapInArrow: rows with what a broadcast block of patterns finds added to ``more``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in slices(batch, "text"):
                spans = [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in spans_so_far(part, *share.value, s)]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(spans, kind)], names=["doc_id", "text", "more"])

    return run


def find(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``extract`` with the patterns that ``docs`` itself gives, and as there for nulls, repeated rows and empty tables."""
    return extract(docs, trusted(docs, s), s)
