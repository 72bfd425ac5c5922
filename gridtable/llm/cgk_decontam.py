"""Benchmark decontamination by CGK embeddings and bit-sampling LSH.

Edit distance is counted in words. A random walk embeds a string of words: in step j it writes the word
it stands on and moves on by a random bit of (j, word), so that two strings a few edits apart agree in
most places of their walks. Each repetition has its own bits and samples a few places of the walk as a
key; windows of every document start at every word, windows of an item at strides over the item. A
window that shares a key with an item's window and agrees with it in enough places of the walk is a
candidate, and the exact edit distance between the item and the best stretch of words there decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from gridtable.llm.common import ALNUM, arrow, code_points, lower_ascii, mix, rolling, run_hashes, slices, utf8, word_spans

LOWER = lower_ascii()
#: For items of so many words and more: the words of a window, which but for the shortest fits into them twice, and the
#: places of its walk that are sampled, more where a window is short and would else be found everywhere.
SHAPES = ((4, 4, 3), (8, 4, 5), (16, 8, 4), (32, 16, 3))
LEAST, LONGEST = SHAPES[0][0], SHAPES[-1][1]
#: Items of more words have at least the recall of those of so many, for they have more windows; edited copies that
#: recall is measured on, for each kind of edit; repetitions at which that ends.
MANY, COPIES, MOST = 48, 100, 48
#: Items that are searched for in one pass; it and the next bound what is broadcast.
BLOCK = 20_000
#: Characters of the items of a block, beyond which it ends too.
CHARACTERS = 50_000_000
ANY = "doc_id long, item_id long, edits long, item_words long, start long, end long"


@dataclass(frozen=True)
class Settings:
    """share: the edits allowed, as a share of the item's words; recall: what share of copies with so many edits is to be
    found, whatever the item's length and whichever kind the edits are; agree: the share of a walk's places that a
    candidate agrees in."""

    share: float = 0.2
    recall: float = 0.98
    agree: float = 0.4


def shape(n: int) -> int:
    """Which of SHAPES an item of ``n`` words has."""
    return max(k for k, (least, _, _) in enumerate(SHAPES) if least <= n)


def offsets_of(n: int, w: int) -> list[int]:
    """Where the windows of an item of ``n`` words begin."""
    return sorted({*range(0, n - w + 1, w // 2), n - w})


@lru_cache(maxsize=1)
def plan() -> tuple[np.ndarray, list[list[list[int]]]]:
    """For each repetition the seed of the walks' moves, and the places sampled in the walks of each shape."""
    rng = np.random.default_rng(23)
    seeds = rng.integers(0, 2**63, MOST, dtype=np.uint64)
    edges = [np.linspace(0, w + w // 2, places + 1).astype(int) for _, w, places in SHAPES]
    return seeds, [[[int(rng.integers(a, b)) for a, b in zip(e, e[1:], strict=False)] for e in edges] for _ in range(MOST)]


@lru_cache(maxsize=1024)
def repetitions(n: int, s: Settings) -> int:
    """How many repetitions find ``s.recall`` of the copies of items of ``n`` words with all edits allowed, be these
    words that are changed, put in or left out: counted on copies of random items."""
    kind, edits = shape(n), int(s.share * n + 1e-9)
    w = SHAPES[kind][1]
    rng = np.random.default_rng((n, edits))
    items, copies = [], []
    for k in range(3 * COPIES):
        item = rng.integers(1, 2**63, n, dtype=np.uint64).tolist()
        copy = list(item)
        for _ in range(edits):
            at = int(rng.integers(len(copy)))
            if k % 3 == 2:
                del copy[at]
            else:
                copy[at : at + (k % 3 == 0)] = [int(rng.integers(1, 2**63))]
        other = lambda k: rng.integers(1, 2**63, k, dtype=np.uint64).tolist()  # noqa: E731  what follows
        items.append(item + other(2 * w))
        copies.append(copy + other(n + edits + 2 * w - len(copy)))
    one, two = np.array(items, np.uint64), np.array(copies, np.uint64)
    nth = np.arange(len(one))
    at_one = np.add.outer(nth * one.shape[1], offsets_of(n, w)).ravel()
    at_two = np.add.outer(nth * two.shape[1], np.arange(n + edits)).ravel()
    seeds, sampled = plan()
    found = np.zeros(len(one), bool)
    for r in range(MOST):
        keys = []
        for words, at, width in ((one, at_one, one.shape[1]), (two, at_two, two.shape[1])):
            wrote = walk(words.ravel(), at, w + w // 2, seeds[r])[sampled[r][kind]]
            keys.append(running_keys(wrote)[-1] ^ mix((at // width).astype(np.uint64)))
        found[at_one[np.isin(keys[0], keys[1])] // one.shape[1]] = True
        if min(found[x::3].mean() for x in range(3)) >= s.recall:
            return r + 1
    return MOST


def read_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, row offsets, and hash, start, end and row of every word (letters and digits, in lower case)."""
    data, offsets = utf8(pc.utf8_lower(column.cast(pa.large_string()).fill_null("")))
    starts, ends, row = word_spans(data, offsets, ALNUM)
    return data, offsets, run_hashes(rolling(data, LOWER), starts, ends), starts, ends, row


class Index:
    """Keys of the windows of some items, for every repetition and window size."""

    def __init__(self, ids: list[int], texts: list[str], s: Settings):
        self.s, self.ids = s, ids
        _, offsets, words, _, _, row = read_words(pa.array(texts, pa.large_string()))
        count = np.bincount(row, minlength=len(ids))
        first = np.cumsum(count) - count
        self.items = [words[a : a + n] for a, n in zip(first, count, strict=True)]
        self.lists = [x.tolist() for x in self.items]
        self.seeds, sampled = plan()
        self.exact: dict[int, dict[int, list[int]]] = {}
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        starts: list[list[tuple[int, int]]] = [[] for _ in SHAPES]
        turns = [0] * len(SHAPES)
        for i, n in enumerate(count.tolist()):
            if n and (n < LEAST or int(s.share * n + 1e-9) == 0):  # no edit is allowed
                key = int(consecutive(self.items[i], n)[0])
                self.exact.setdefault(n, {}).setdefault(key, []).append(i)
            elif n:
                k = shape(n)
                starts[k] += [(i, o) for o in offsets_of(n, SHAPES[k][1])]
                turns[k] = max(turns[k], repetitions(min(n, MANY), s))
        for k, found in enumerate(starts):
            if found:
                which = np.array(found, np.int64)
                self.windows[k] = (which[:, 0], which[:, 1])
        padded = np.append(words, np.zeros(2 * LONGEST, np.uint64))
        self.samples, self.walks, self.tables = [], [], []
        for r in range(max(turns)):
            places, walks, tables = {}, {}, {}
            for k, (item, at) in self.windows.items():
                if r < turns[k]:
                    w = SHAPES[k][1]
                    places[k] = sampled[r][k]
                    walks[k] = walk(padded, first[item] + at, w + w // 2, self.seeds[r])
                    prefixes = running_keys(walks[k][places[k]])
                    order = np.argsort(prefixes[-1], kind="stable")
                    tables[k] = ([bit_table(x) for x in prefixes], prefixes[-1][order], order)
            self.samples.append(places)
            self.walks.append(walks)
            self.tables.append(tables)


def bits(words: np.ndarray, seed: np.uint64) -> np.ndarray:
    """A random word of 64 bits for each word: bit j is its move in step j."""
    return mix(words ^ seed)


def walk(words: np.ndarray, at: np.ndarray, steps: int, seed: np.uint64) -> np.ndarray:
    """The words that the walks starting at ``at`` write: steps x walks."""
    moves, at = bits(words, seed), at.copy()
    out = np.empty((steps, len(at)), np.uint64)
    for j in range(steps):
        out[j] = words[at]
        at += ((moves[at] >> np.uint64(j)) & np.uint64(1)).astype(np.int64)
    return out


def extend(key: np.ndarray, word: np.ndarray, place: int) -> np.ndarray:
    return mix(key + word * np.uint64(2 * place + 3))


def running_keys(rows: list[np.ndarray] | np.ndarray) -> list[np.ndarray]:
    """Keys of the first, the first two, ... sampled words."""
    keys, key = [], np.zeros(len(rows[0]), np.uint64)
    for i, x in enumerate(rows):
        key = extend(key, x, i)
        keys.append(key)
    return keys


def bit_table(keys: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << 16, bool)
    table[keys & np.uint64(0xFFFF)] = True
    return table


def among(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """False for keys that cannot be among those of the table."""
    return table[(keys & np.uint64(0xFFFF)).astype(np.uint16)]


def consecutive(words: np.ndarray, n: int) -> np.ndarray:
    return running_keys([words[j : len(words) - n + 1 + j] for j in range(n)])[-1]


def advance(moves: np.ndarray, now: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Where walks that stand at ``now`` in step ``start`` stand in step ``stop``."""
    for j in range(start, stop):
        now = now + ((moves >> np.uint64(j)).astype(np.int8) & 1)[now]
    return now


def best_stretch(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of the item to a stretch of ``words``, and that stretch; the first of the shortest among equals."""
    n = len(words)
    cost = np.zeros(n + 1, np.int64)
    since = np.arange(n + 1)
    along = np.arange(n + 1)
    for i, x in enumerate(item, 1):
        diagonal = np.append(i, cost[:-1] + (words != x))
        from_diagonal = np.append(since[0], since[:-1])
        down = cost + 1
        take = down < diagonal
        step = np.where(take, down, diagonal)
        start = np.where(take, since, from_diagonal)
        shifted = step - along  # insertions: the least of step[k] + (j - k) for k <= j
        least = np.minimum.accumulate(shifted)
        source = np.maximum.accumulate(np.where(shifted == least, along, 0))
        cost, since = least + along, start[source]
    end = int(np.argmin(cost))
    return int(cost[end]), int(since[end]), end


def find(index: Index, words: np.ndarray, row: np.ndarray, rows: int) -> list[tuple[int, int, int, int, int]]:
    """(row, item, edits, first word, last word + 1): the best stretch of each row for each item within reach."""
    n, s = len(words), index.s
    count = np.bincount(row, minlength=rows)
    first = np.cumsum(count) - count
    padded = np.append(words, np.zeros(2 * LONGEST, np.uint64))
    candidates: set[tuple[int, int, int]] = set()
    for size, keys in index.exact.items():
        if n >= size:
            mine = consecutive(words, size)
            for at in np.flatnonzero(np.isin(mine, np.fromiter(keys, np.uint64))).tolist():
                candidates.update((int(row[at]), i, at) for i in keys[int(mine[at])])
    for r in range(len(index.samples) if n else 0):
        moves, now, steps = bits(padded, index.seeds[r]), np.arange(n, dtype=np.int32), 0
        for shaped, places in sorted(index.samples[r].items(), key=lambda x: x[1][0]):
            tables, table, order = index.tables[r][shaped]
            w = SHAPES[shaped][1]
            now, steps = advance(moves, now, steps, places[0]), places[0]
            opening = extend(np.zeros(len(padded), np.uint64), padded, 0)
            at = np.flatnonzero(among(opening, tables[0])[now])
            here, key = now[at], opening[now[at]]
            for k in range(1, len(places)):
                here = advance(moves, here, places[k - 1], places[k])
                key = extend(key, padded[here], k)
                ok = np.flatnonzero(among(key, tables[k]))
                at, here, key = at[ok], here[ok], key[ok]
            mine = key
            low = np.searchsorted(table, mine, side="left")
            high = np.searchsorted(table, mine, side="right")
            hit = np.flatnonzero(high > low)
            while len(hit):  # one more item window of the same key in each turn
                which = order[low[hit]]
                for a in range(0, len(hit), 1 << 16):
                    part = hit[a : a + (1 << 16)]
                    mine_walk = walk(padded, at[part], w + w // 2, index.seeds[r])
                    item_walk = index.walks[r][shaped][:, which[a : a + (1 << 16)]]
                    good = (mine_walk == item_walk).mean(axis=0) >= s.agree
                    item, offset = (x[which[a : a + (1 << 16)][good]] for x in index.windows[shaped])
                    start = at[part][good]
                    candidates.update(zip(row[start].tolist(), item.tolist(), ((start - offset) // 4 * 4).tolist(), strict=True))
                low[hit] += 1
                hit = hit[high[hit] > low[hit]]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for r, i, at in sorted(candidates):
        item = index.items[i]
        most = int(s.share * len(item) + 1e-9)
        a = max(int(first[r]), at - most - 4)
        b = min(int(first[r] + count[r]), at + len(item) + most + 8)
        if b <= a or b - a < len(item) - most:
            continue
        if sum(map(set(words[a:b].tolist()).__contains__, index.lists[i])) < len(item) - most:
            continue  # every word that isn't there is an edit
        edits, x, y = best_stretch(item, words[a:b])
        if edits <= most and (edits, a + x) < best.get((r, i), (1 << 60, 0, 0))[:2]:
            best[r, i] = (edits, a + x, a + y)
    return [(r, i, *found) for (r, i), found in sorted(best.items())]


def indexes(items: DataFrame, s: Settings) -> Iterator[Index]:
    """Indexes of blocks of the items (item_id, text); those without a word match nothing."""
    known = items.selectExpr("cast(item_id AS long) AS item_id", "text").where("text IS NOT NULL")
    ids, texts, size = [], [], 0
    for r in known.orderBy("item_id", "text").toLocalIterator():
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += len(r["text"])
        if len(ids) == BLOCK or size >= CHARACTERS:
            yield Index(ids, texts, s)
            ids, texts, size = [], [], 0
    if ids:
        yield Index(ids, texts, s)


def matches(docs: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, edits, item_words, start, end): where a row of ``docs`` (doc_id, text) holds an item.

    The best stretch for each row and item whose distance in words is at most ``share`` of the item's
    words; start and end are code points. Items that are too short for an edit must be there word for word; items
    and texts that are null or have no word match nothing; a repeated row is reported again; an item
    given twice is reported twice. Other columns are not read. Items go in blocks of bounded size.
    """
    docs, spark = docs.select("doc_id", "text"), docs.sparkSession
    out = spark.createDataFrame([], ANY)
    for k, index in enumerate(indexes(items, s)):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for part in slices(batch, "text"):
                    data, offsets, words, starts, ends, row = read_words(part.column(1))
                    found = find(index, words, row, part.num_rows)
                    if found:
                        r, i, edits, x, y = (np.array(c, np.int64) for c in zip(*found, strict=True))
                        yield pa.RecordBatch.from_arrays(
                            [
                                part.column(0).take(pa.array(r)),
                                pa.array([index.ids[j] for j in i], pa.int64()),
                                pa.array(edits),
                                pa.array([len(index.items[j]) for j in i], pa.int64()),
                                pa.array(code_points(data, offsets, starts[x], r)),
                                pa.array(code_points(data, offsets, ends[y - 1], r)),
                            ],
                            names=["doc_id", "item_id", "edits", "item_words", "start", "end"],
                        )

        found = arrow(docs, run, ANY)
        out = found if k == 0 else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs`` without the rows that hold an item; the columns stay, whatever their names.

    Null and empty texts stay, null and empty items match nothing, repeated rows stay or go together, and an empty table
    of either kind leaves ``docs`` as it is. Long texts are read whole.
    """
    for index in indexes(items, s):
        shared, at = docs.sparkSession.sparkContext.broadcast(index), docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], shared=shared, at=at) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    _, _, words, _, _, row = read_words(part.column(at))
                    clean = np.ones(part.num_rows, bool)
                    clean[[f[0] for f in find(shared.value, words, row, part.num_rows)]] = False
                    yield part.filter(pa.array(clean))

        docs = arrow(docs, run, docs.schema)
    return docs
