"""Near-duplicate documents by b-bit MinHash.

One pass over the texts gives each document the size and a 128-bit fingerprint of its shingle set, the
band keys of its minima, and the low bits of the minima packed into a few longs. Documents of equal
sets form a class that one row stands for; only classes go on. Classes that share a band key are
candidates: in a few turns each is held against one class of its bucket, another in each turn. What is
still in buckets of several components then goes through a prefix filter: two similar sets share one
of their rarest shingles, so that texts which have only common passages in common never meet. The buckets
of these shingles have turns of their own, and then longer signatures decide what is compared. A pair is
first estimated from the packed bits (matches corrected for chance collisions) and then confirmed on
full sets, which are written once. Nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtable.llm.common import arrow, bounded, cut, lower_ascii, mix, slices, span_hashes, utf8, word_spans
from gridtable.llm.graph import components

#: Words are runs of anything but \x20 and \x09-\x0D.
WORD_BYTES = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
LOWER = lower_ascii()
BITS = 2
PER_LONG = 64 // BITS


@dataclass(frozen=True)
class Settings:
    """shingle words a shingle; percent: the least Jaccard similarity; rows: minima a band; miss: the
    chance that a pair at the threshold shares no band; sigmas: how far below the threshold an
    estimate may fall before a pair is given up; turns: members of a bucket that all others are held
    against; fine: minima of the longer signatures of what that leaves."""

    shingle: int = 5
    percent: int = 80
    rows: int = 5
    miss: float = 1e-8
    sigmas: float = 5.5
    turns: int = 3
    fine: int = 1024

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log1p(-((self.percent / 100) ** self.rows)))

    @property
    def minima(self) -> int:
        return self.bands * self.rows

    def most_mismatches(self, minima: int) -> int:
        """Packed symbols that may differ in a pair at the threshold, with ``sigmas`` of slack."""
        miss = (1 - self.percent / 100) * (1 - 2.0**-BITS)
        return math.ceil(minima * miss + self.sigmas * math.sqrt(minima * miss * (1 - miss)))


def longs(minima: int) -> int:
    return math.ceil(minima / PER_LONG)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each row, in order with repetitions, and how many each row has."""
    starts, ends, row = word_spans(data, offsets, WORD_BYTES)
    words = span_hashes(data, starts, ends, LOWER)
    count = np.bincount(row, minlength=len(offsets) - 1)
    odd = np.random.default_rng(7).integers(1, 2**63, k, dtype=np.uint64) | np.uint64(1)
    rolled = np.zeros(len(words), np.uint64)
    before = np.concatenate([[0], np.cumsum(count)])
    left = np.repeat(before[1:], count) - np.arange(len(words))
    for j in range(k):
        rolled[: len(words) - j] += np.where(left[: len(words) - j] > j, words[j:] * odd[j], 0).astype(np.uint64)
    first = np.arange(len(words)) == np.repeat(before[:-1], count)
    short = np.repeat(count, count) < k
    keep = (left >= k) | (short & first)
    rolled += np.where(short, np.repeat(count, count), k).astype(np.uint64)
    return mix(rolled[keep]), np.where(count >= k, count - k + 1, np.minimum(count, 1))


def distinct_sets(hashes: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each row, concatenated, and their number."""
    ends = np.cumsum(count)
    sets = [np.unique(hashes[e - c : e]) for e, c in zip(ends, count, strict=True)]
    return (np.concatenate(sets) if sets else hashes), np.array([len(s) for s in sets], np.int64)


def _sums(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    out = np.zeros(len(count), np.uint64)
    full = count > 0
    if full.any():
        out[full] = np.add.reduceat(values, (np.cumsum(count) - count)[full])
    return out


def mixed_minima(sets: np.ndarray, size: np.ndarray, number: int) -> np.ndarray:
    """``number`` minima of each row's set under as many hash functions, mixed so that every bit is fair."""
    rng = np.random.default_rng(11)
    flip = rng.integers(0, 2**32, number, dtype=np.uint32)
    times = rng.integers(0, 2**32, number, dtype=np.uint32) | np.uint32(1)
    full = np.flatnonzero(size)
    at = (np.cumsum(size) - size)[full]
    minima = np.zeros((len(size), number), np.uint32)
    if len(full):
        short = (sets >> np.uint64(32)).astype(np.uint32)
        for k in range(number):
            minima[full, k] = np.minimum.reduceat((short ^ flip[k]) * times[k], at)
    return mix(minima.astype(np.uint64) + np.uint64(1))


def packed(wide: np.ndarray) -> np.ndarray:
    """The low bits of the minima, 64 // BITS to a long."""
    n = longs(wide.shape[1])
    symbols = np.zeros((len(wide), n * PER_LONG), np.uint64)
    symbols[:, : wide.shape[1]] = wide & np.uint64(2**BITS - 1)
    shift = np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS)
    return (symbols.reshape(-1, n, PER_LONG) << shift).sum(axis=2, dtype=np.uint64)


def signer(s: Settings):
    """For mapInArrow: (doc_id, text) to (doc_id, n_shingles, print_a, print_b, bits, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.random.default_rng(13).integers(0, 2**63, (s.bands, s.rows), dtype=np.uint64) | np.uint64(1)
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, count = shingle_hashes(*utf8(part.column(1)), s.shingle)
                sets, size = distinct_sets(hashes, count)
                wide = mixed_minima(sets, size, s.minima)
                keys = mix((wide.reshape(-1, s.bands, s.rows) * weights).sum(axis=2, dtype=np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        *prints(sets, size),
                        _lists(packed(wide)),
                        _lists(keys),
                    ],
                    names=["doc_id", "n_shingles", "print_a", "print_b", "bits", "keys"],
                )

    return run


def prints(sets: np.ndarray, size: np.ndarray) -> list[pa.Array]:
    """n_shingles, print_a and print_b of each row's set."""
    a = _sums(mix(sets ^ np.uint64(0x5851F42D4C957F2D)), size)
    b = _sums(mix(sets + np.uint64(0x14057B7EF767814F)), size)
    return [pa.array(size, pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))]


def _lists(x: np.ndarray) -> pa.Array:
    at = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(at), pa.array(x.reshape(-1).view(np.int64)))


def set_reader(s: Settings):
    """For mapInArrow: (doc_id, text) to (doc_id, n_shingles, print_a, print_b, items), the whole shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets, size = distinct_sets(*shingle_hashes(*utf8(part.column(1)), s.shingle))
                at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                items = pa.ListArray.from_arrays(pa.array(at), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), *prints(sets, size), items], names=["doc_id", "n_shingles", "print_a", "print_b", "items"])

    return run


def similar_bits(s: Settings, a: str, b: str, minima: int) -> Column:
    """Whether two packed signatures may belong to a pair at the threshold."""
    low = f"{0x5555555555555555}L"
    n = longs(minima)
    total = F.lit(0)
    for i in range(n):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        total = total + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.expr(low)))
    return total <= s.most_mismatches(minima)


def similar_sizes(s: Settings, a: str, b: str) -> Column:
    return F.least(F.col(a), F.col(b)) * 100 >= F.greatest(F.col(a), F.col(b)) * s.percent


#: What a class is known by.
KEY = ["n_shingles", "print_a", "print_b"]


def whole_sets(docs: DataFrame, heads: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """(h, items) of the ``wanted`` heads (h): their shingle sets, read from the texts once."""
    heads = heads.join(bounded(wanted), "h", "left_semi").select("h", "doc_id", *KEY)
    texts = docs.join(bounded(cut(heads.select("doc_id").distinct())), "doc_id", "left_semi")
    read = arrow(texts, set_reader(s), "doc_id long, n_shingles long, print_a long, print_b long, items array<long>")
    same = ["doc_id", *KEY]
    return cut(read.dropDuplicates(same).join(heads, same).select("h", "items"))


def confirmed(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Those of the ``pairs`` (hub, doc: heads, and others) whose full sets are similar enough, without hub and doc.

    The hub's set is joined last and not shuffled again, so that it moves once, however many it is held against.
    """
    kept = [c for c in pairs.columns if c not in ("hub", "doc")]
    joined = pairs.join(sets.toDF("doc", "y"), "doc").join(sets.toDF("hub", "x"), "hub")
    both = F.size(F.array_intersect("x", "y"))
    joined = joined.select(*kept, both.alias("both"), (F.size("x") + F.size("y") - both).alias("either"))
    return cut(joined.where(F.col("both") * 100 >= F.col("either") * s.percent).select(kept))


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs`` (doc_id: long, text).

    A set with no words (null or empty text) links with nothing, equal sets link always. Rows that share
    a doc_id are one vertex, with the links of all its texts. A row without doc_id links with nothing, has a null
    component_id and is kept. Texts of any length are read whole. An empty table gives an empty result; columns
    besides doc_id and text are not read, whatever their names.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_shingles long, print_a long, print_b long, bits array<long>, keys array<long>"
    signed = cut(arrow(docs, signer(s), schema))
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy(*KEY).agg(F.min("doc_id").alias("rep"))
    # Nothing but the write follows this join, so that Spark can split a class of many copies.
    members = cut(full.select("doc_id", *KEY).join(classes, KEY).select("doc_id", "rep"))
    heads = full.join(classes.withColumnRenamed("rep", "doc_id"), [*KEY, "doc_id"], "left_semi").dropDuplicates(KEY)
    heads = cut(heads.withColumn("h", F.monotonically_increasing_id()))  # a doc_id may stand for several classes

    bands = heads.select("h", F.col("doc_id").alias("c"), F.posexplode("keys").alias("band", "key"))
    crowd = bands.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    spots = cut(bands.join(crowd, ["band", "key"]))
    sketch = heads.select("h", "doc_id", F.col("n_shingles").alias("n"), "bits")
    links = members.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    sets = None if spots.isEmpty() else whole_sets(docs, heads, cut(spots.select("h").distinct()), s)
    for turn in range(s.turns):
        if spots.isEmpty():
            break
        rank = F.col("c") if turn == 0 else F.xxhash64("h", F.lit(turn))
        hubs = spots.groupBy("band", "key").agg(F.min(F.struct(rank.alias("rank"), "h", "c")).alias("hub"))
        stars = spots.join(hubs, ["band", "key"]).where("c <> hub.c").select(F.col("hub.h").alias("hub"), F.col("h").alias("doc")).distinct()
        links = links.union(confirmed(cut(estimated(stars, sketch, s)), sets, s))
        found = cut(components(links)).toDF("c", "now")
        spots = spots.join(found, "c", "left").select("h", "band", "key", F.coalesce("now", "c").alias("c"))
        mixed = spots.groupBy("band", "key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high")
        spots = cut(spots.join(mixed.select("band", "key"), ["band", "key"]))

    whole = components(links) if spots.isEmpty() else components(links.union(unexplained(spots, sketch, sets, s)))
    out = signed.select("doc_id", "n_shingles").join(whole.toDF("doc_id", "component_id"), "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def estimated(pairs: DataFrame, sketch: DataFrame, s: Settings) -> DataFrame:
    """Those of the ``pairs`` (hub, doc: heads, and others) that sizes and packed bits let be similar enough, with their
    doc_ids a and b."""
    one, two = sketch.toDF("hub", "a", "na", "xa"), sketch.toDF("doc", "b", "nb", "xb")
    fits = similar_sizes(s, "na", "nb") & similar_bits(s, "xa", "xb", s.minima)
    return pairs.join(two, "doc").join(one, "hub").where(fits).select(*pairs.columns, "a", "b")


def fine_signer(s: Settings):
    """For mapInArrow: (h, items) to (h, bits), with ``fine`` minima of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                items = part.column(1)
                sets = np.asarray(items.flatten(), np.int64).view(np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(packed(mixed_minima(sets, np.diff(np.asarray(items.offsets)), s.fine)))], names=["h", "bits"])

    return run


def prefixes(own: DataFrame, s: Settings) -> DataFrame:
    """(h, c, n, item, at) of the first shingles of the sets ``own`` (h, c, items), at: how many come before.

    A set similar to one of n shingles has at least n * percent / 100 of them, so that two similar sets share one of
    their n - ceil(n * percent / 100) + 1 first shingles in any order that is the same for all. Here the rarest come
    first: what only passages of many texts have in common is then no candidate.
    """
    each = own.select("h", "c", F.size("items").alias("n"), F.explode("items").alias("item"))
    often = each.groupBy("item").agg(F.count("*").alias("f")).where("f > 1")
    shared = each.join(often, "item").groupBy("h", "c", "n").agg(F.array_sort(F.collect_list(F.struct("f", "item"))).alias("known"))
    alone = F.col("n") - F.size("known")  # shingles that no other text has, which come before
    length = F.col("n") - least_overlap(s, F.col("n"), F.lit(100)) + 1 - alone
    first = shared.withColumns({"alone": alone, "length": length}).where("length > 0")
    first = first.select("h", "c", "n", "alone", F.posexplode(F.slice("known", F.lit(1), F.col("length"))).alias("nth", "x"))
    return first.select("h", "c", "n", F.col("x.item").alias("item"), (F.col("alone") + F.col("nth")).alias("at"))


def least_overlap(s: Settings, size: Column, of: Column) -> Column:
    """``size`` * percent / ``of``, rounded up, in whole numbers."""
    return F.call_function("div", size.cast("long") * s.percent + of - 1, of.cast("long")).cast("int")


def unexplained(spots: DataFrame, sketch: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) between components (c) among the heads (h) of buckets that are still mixed."""
    own = cut(spots.select("h", "c").distinct().join(sets, "h"))
    first = cut(prefixes(own, s))
    links = None
    for turn in range(s.turns + 1):
        mixed = first.groupBy("item").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high")
        first = cut(first.join(mixed.select("item"), "item"))
        if turn == s.turns or first.isEmpty():
            break
        hubs = first.groupBy("item").agg(F.min(F.struct(F.xxhash64("h", F.lit(100 + turn)).alias("rank"), "h", "c")).alias("hub"))
        stars = first.join(hubs, "item").where("c <> hub.c")
        stars = stars.select(F.col("hub.h").alias("hub"), F.col("h").alias("doc"), F.col("hub.c").alias("ca"), F.col("c").alias("cb")).distinct()
        more = confirmed(cut(estimated(stars, sketch, s)), sets, s)
        links = more.select("a", "b") if links is None else links.union(more.select("a", "b"))
        found = cut(components(more.select(F.col("ca").alias("a"), F.col("cb").alias("b"))))
        first = first.join(found.toDF("c", "now"), "c", "left").withColumn("c", F.coalesce("now", "c")).drop("now")
    if first.isEmpty():
        return links if links is not None else sketch.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")).where("false")
    fine = cut(arrow(own.join(first.select("h").distinct(), "h", "left_semi").select("h", "items"), fine_signer(s), "h long, bits array<long>"))
    names = sketch.select("h", "doc_id")
    rows = first.join(fine, "h").join(names, "h")
    one, two = (rows.select("item", *[F.col(c).alias(c + side) for c in ("h", "c", "n", "at", "bits", "doc_id")]) for side in "12")
    # Of what two sets have in common nothing comes before the first; so much must come with it and after it.
    needed = least_overlap(s, F.col("n1") + F.col("n2"), F.lit(100 + s.percent))
    fits = (F.col("n1") - F.col("at1") >= needed) & (F.col("n2") - F.col("at2") >= needed) & similar_sizes(s, "n1", "n2")
    near = (F.col("c1") != F.col("c2")) & (F.col("h1") < F.col("h2")) & fits & similar_bits(s, "bits1", "bits2", s.fine)
    pairs = one.join(two, "item").where(near).select(F.col("h1").alias("hub"), F.col("h2").alias("doc"), F.col("doc_id1").alias("a"), F.col("doc_id2").alias("b"))
    more = confirmed(cut(pairs.distinct()), sets, s)
    return more if links is None else links.union(more)


def drop_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, the one of least doc_id; the columns stay, whatever their names.

    Repeated rows of that doc_id are reduced to one. Rows without doc_id stay, as do null and empty texts, which are
    near nothing. An empty table stays empty.
    """
    found = cut(near_duplicates(docs, s))
    gone = cut(found.where("NOT kept").select("doc_id").distinct())
    twice = cut(found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    left = docs.join(bounded(gone), "doc_id", "left_anti").select(*docs.columns)
    if twice.isEmpty():
        return left
    repeated = bounded(twice)
    single = left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return left.join(repeated, "doc_id", "left_anti").unionByName(single).select(*docs.columns)
