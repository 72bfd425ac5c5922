"""Near-duplicate vectors by sorted projection passes.

In each pass the vectors are sorted by a code of concatenated random hashes (quantized projections, the
first of which decide most), and each is compared with a window of its neighbours on both sides. If the
window holds all vectors that share the first k hashes with a vector (or these are joined with it
already), a neighbour at the least cosine was missed with a chance that its place in its k cells gives.
Passes go on until the product of these chances is at most ``miss`` for every vector, so that their
number follows from the rows and how dense they lie; a vector that has come so far leaves, since all its
pairs have come so far with it. What is left after the most passes is compared exactly, block against
block. Verified pairs are joined over all passes; then the links of each component are counted
exactly, since a link never leaves a component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtable.llm.common import arrow, cut
from gridtable.llm.graph import components

#: Vectors of a block in which the links of a component are counted, and of a strip that is multiplied at once.
BLOCK, STRIP = 2048, 256
#: Windows of a span, the rows of a sorted order that one task compares.
SPAN = 4
#: Passes that run together.
ROUND = 2
#: Vectors of a block of those that are compared exactly.
EXACT = 4096
STATE = "a long, b long, gain double"  # an edge, or with null for b what a pass adds to the logarithm of a's chance
ERF = np.vectorize(math.erf, otypes=[float])


@dataclass(frozen=True)
class Settings:
    """cosine: least similarity of a link; miss: greatest chance to miss a pair of that similarity; passes:
    most sorted orders; window: neighbours compared on each side; hashes of a code; cell: width of a
    hash's cell on the unit sphere's projections."""

    cosine: float = 0.95
    miss: float = 1e-4
    passes: int = 64
    window: int = 2048
    hashes: int = 24
    cell: float = 0.35


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column as unit vectors in double precision, and which rows have one; rows of another length than the most are each their own kind and dropped from the matrix by the caller."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lists = column.to_pylist() if not len(column) or column.null_count or column.values.null_count else None
    if lists is None:
        at = np.asarray(column.offsets)
        size = np.diff(at)
        if len(size) and (size == size[0]).all():
            flat = np.asarray(column.values, np.float64)[at[0] : at[-1]]
            x = flat.reshape(len(size), -1)
            return units(x)
        lists = column.to_pylist()
    wide = max((len(v) for v in lists if v is not None), default=0)
    x = np.full((len(lists), wide), np.nan)
    for i, v in enumerate(lists):
        if v is not None and len(v) == wide and None not in v:
            x[i] = v
    return units(x)


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    good = np.isfinite(x).all(axis=1) & (x.shape[1] > 0)
    with np.errstate(all="ignore"):
        scale = np.abs(x).max(axis=1, initial=0)
        good &= scale > 0
        y = np.where(good[:, None], x / np.where(good, scale, 1)[:, None], 0)
        y = y / np.where(good, np.sqrt((y * y).sum(axis=1)), 1)[:, None]
    return y, good


def projections(dims: int, turn: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng((turn, dims))
    return rng.standard_normal((dims, s.hashes)), rng.uniform(0, s.cell * 3, s.hashes)


def codes(x: np.ndarray, turn: int, s: Settings) -> list[bytes]:
    """A code for each row: the cells of its projections, each as one byte, which sort in lexicographic order."""
    directions, shift = projections(x.shape[1], turn, s)
    cells = np.floor((x @ directions + shift) / (3 * s.cell)).clip(-120, 120) + 128
    return [c.tobytes() for c in cells.astype(np.uint8)]


def valid(vectors: DataFrame, ids: str, vector: str) -> DataFrame:
    """(id, v, dims): rows with an id whose vector is finite and not zero."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(ids).cast("long").alias("id"), F.col(vector).alias("v"), v.alias("d"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(F.size("d") > 0)
    return rows.where(F.forall("d", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("d", lambda x: x != 0)).select("id", "v", F.size("v").alias("dims"))


def neighbours(x: np.ndarray, s: Settings) -> np.ndarray:
    """For each row in sorted order the first row of the group that windows join it to."""
    n = len(x)
    root = np.arange(n)
    step = 256
    for a in range(0, n, step):
        b = min(n, a + step)
        start, stop = a, min(n, b + s.window)
        while start < n:
            close = x[a:b] @ x[start:stop].T >= s.cosine
            close &= np.arange(start, stop) > np.arange(a, b)[:, None]
            for i in np.flatnonzero(close.any(axis=1)):
                near = root[start + np.flatnonzero(close[i])]
                if (near != root[a + i]).any():
                    to = np.arange(n)
                    to[near] = to[root[a + i]] = min(near.min(), root[a + i])
                    root = to[root]
            if stop == n or not close[:, -s.window :].any():
                break
            start, stop = stop, min(n, stop + max(s.window, step))
    return root


def stars(ids: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    other = root != np.arange(len(root))
    return ids[root[other]], ids[other]


def gains(x: np.ndarray, code: np.ndarray, root: np.ndarray, turn: int, first: bool, last: bool, s: Settings) -> np.ndarray:
    """Logarithms of the chances that the windows missed a neighbour at the least cosine, for each row in
    sorted order. first, last: the rows begin or end the whole order; beyond another end nothing is known."""
    n = len(x)
    at = np.arange(n)
    new = np.append(True, root[1:] != root[:-1])
    begin = np.maximum.accumulate(np.where(new, at, 0))
    end = np.minimum.accumulate(np.where(np.append(new[1:], True), at, n)[::-1])[::-1]
    low, high = np.minimum(at - s.window, begin), np.maximum(at + s.window, end)
    depth = np.full(n, s.hashes + 1)
    differ = code[1:] != code[:-1]
    shared = np.append(-1, np.where(differ.any(axis=1), differ.argmax(axis=1), s.hashes)) if n > 1 else np.array([-1])
    for k in range(s.hashes, -1, -1):
        new = shared < k
        begin = np.maximum.accumulate(np.where(new, at, 0))
        end = np.minimum.accumulate(np.where(np.append(new[1:], True), at, n)[::-1])[::-1]
        whole = (begin >= low) & (end <= high) & (first | (begin > 0)) & (last | (end < n - 1))
        depth[whole] = k
    most = depth[depth <= s.hashes].max(initial=0)
    directions, shift = projections(x.shape[1], turn, s)
    width, spread = 3 * s.cell, math.sqrt(2 * (1 - s.cosine**2))
    edge = (code[:, :most].astype(float) - 128) * width - shift[:most]
    # A neighbour's projection is normal about the cosine times the row's own, whatever the direction's other parts.
    middle = s.cosine * (x @ directions[:, :most])
    stay = (ERF((edge + width - middle) / spread) - ERF((edge - middle) / spread)) / 2 if most else np.zeros((n, 0))
    hit = np.column_stack([np.ones(n), np.cumprod(stay, axis=1), np.zeros(n)])[at, np.minimum(depth, most + 1)]
    return np.log(np.maximum(1 - hit, 1e-300))


def passes(heads: DataFrame, n: int, turn: int, s: Settings) -> DataFrame:
    """STATE of the ``n`` vectors (id, v) after ROUND sorted orders from ``turn`` on.

    A task compares a span of an order with the windows before and after it, wherever Spark's ranges end.
    """
    kind = heads.schema["v"].dataType.simpleString()
    span = SPAN * s.window

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = matrix(batch.column(1))
            for t in range(turn, turn + ROUND):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t] * len(x), pa.int32()), pa.array(codes(x, t, s), pa.binary())], names=["id", "turn", "code"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(k, part, np.int32)), pa.array(np.arange(done, done + k))], names=["id", "turn", "code", "part", "place"])
            done += k

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        x, _ = matrix(group["v"])
        ids, place = group["id"].to_numpy(), group["place"].to_numpy()
        t, span_at = group["turn"][0].as_py(), group["span"][0].as_py()
        root = neighbours(x, s)
        a, b = stars(ids, root)
        cells = np.frombuffer(b"".join(group["code"].to_pylist()), np.uint8).reshape(len(x), -1)
        gain = gains(x, cells, root, t, place[0] == 0, place[-1] == n - 1, s)
        own = place // span == span_at
        none = pa.nulls(int(own.sum()), pa.int64())
        return pa.table({
            "a": pa.array(np.concatenate([a, ids[own]]), pa.int64()),
            "b": pa.chunked_array([pa.array(b, pa.int64()), none]),
            "gain": pa.chunked_array([pa.nulls(len(a), pa.float64()), pa.array(gain[own], pa.float64())]),
        })

    parts = int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coded = arrow(heads.select("id", "v"), code, "id long, turn int, code binary")
    spread = coded.repartitionByRange(parts, "turn", "code", "id").sortWithinPartitions("turn", "code", "id")
    numbered = cut(arrow(spread, number, "id long, turn int, code binary, part int, place long"))
    before, total = [], 0
    for part, rows in sorted(map(tuple, numbered.groupBy("part").count().collect())):
        before.append((part, total))
        total += rows
    before = heads.sparkSession.createDataFrame(before, "part int, before long")
    placed = numbered.join(F.broadcast(before), "part")
    placed = placed.withColumn("place", F.col("place") + F.col("before") - (F.col("turn") - turn) * n)
    near = [F.floor((F.col("place") + d) / span).cast("int") for d in (-s.window, 0, s.window)]
    placed = placed.select("id", "turn", "code", "place", F.explode(F.array_distinct(F.array(*near))).alias("span"))
    placed = placed.where((F.col("span") >= 0) & (F.col("span") <= (n - 1) // span))
    whole = placed.join(heads.select("id", "v"), "id").select("id", "turn", "span", "place", "code", F.col("v").cast(kind))
    return whole.groupBy("turn", "span").applyInArrow(compare, STATE)


def exact(heads: DataFrame, n: int, s: Settings) -> DataFrame:
    """Edges (a, b) that join all links among the ``n`` vectors (id, v), each block compared with each."""
    blocks = -(-n // EXACT)

    def compare(group: pa.Table) -> pa.Table:
        x, _ = matrix(group["v"])
        a, b = stars(group["id"].to_numpy(), neighbours(x, replace(s, window=len(x))))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    placed = heads.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    both = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    both = both.select(F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "id", "v")
    return both.groupBy("bi", "bj").applyInArrow(compare, "a long, b long")


def joined(heads: DataFrame, s: Settings) -> list[DataFrame]:
    """Edges (a, b) that join the links among vectors (id, v) of one length."""
    edges, turn = [], 0
    left = heads.select("id", F.lit(0.0).alias("chance"))
    while n := left.count():
        rows = heads.join(left, "id", "left_semi") if turn else heads
        if turn >= s.passes:
            edges.append(cut(exact(rows, n, s)))
            break
        state = cut(passes(rows, n, turn, s))
        edges.append(state.where("b IS NOT NULL").select("a", "b"))
        gained = state.where("b IS NULL").select(F.col("a").alias("id"), F.col("gain").alias("chance"))
        left = left.union(gained).groupBy("id").agg(F.sum("chance").alias("chance"))
        left = cut(left.where(F.col("chance") > math.log(s.miss)))
        turn += ROUND
    return edges


def linked(x: np.ndarray, y: np.ndarray, s: Settings) -> Iterator[tuple[int, np.ndarray]]:
    """For some rows of ``x`` at a time the number of the first and which rows of ``y`` each links with."""
    for a in range(0, len(x), STRIP):
        yield a, x[a : a + STRIP] @ y.T >= s.cosine


def count_links(group: pa.Table, s: Settings) -> pa.Table:
    """(id, n, other): what the vectors of two blocks of a component link with across them, those of one block with each
    other, or those of each of several whole components with their own.

    n adds up the weights of what an id links with. A link of which an end is marked is a row of its own too, with n 0.
    """
    group = group.sort_by("c")
    x, _ = matrix(group["v"])
    ids, weight, marked = group["id"].to_numpy(), group["weight"].to_numpy(), group["marked"].to_numpy(zero_copy_only=False)
    block, c = group["block"].to_numpy(), group["c"].to_numpy()
    i, j = group["bi"][0].as_py(), group["bj"][0].as_py()
    if i < 0:
        edges = [0, *(np.flatnonzero(c[1:] != c[:-1]) + 1).tolist(), len(c)]
        sides = [(np.arange(a, b),) * 2 for a, b in zip(edges, edges[1:], strict=False)]
    else:
        sides = [(np.flatnonzero(block == i), np.flatnonzero(block == j))]
    n = np.zeros(len(ids), np.int64)
    pairs: list[tuple[np.ndarray, np.ndarray]] = [(ids[:0], ids[:0])]
    for one, two in sides:
        same = one is two or i == j
        for a, close in linked(x[one], x[two], s):
            some = one[a : a + len(close)]
            if same:
                close[np.arange(len(close)), a + np.arange(len(close))] = False
            n[some] += close @ weight[two]
            if not same:
                n[two] += close.T @ weight[some]
            if marked[some].any() or marked[two].any():
                p, q = np.nonzero(close & (marked[some][:, None] | marked[two]))
                pairs.append((ids[some[p]], ids[two[q]]))
                if not same:
                    pairs.append((ids[two[q]], ids[some[p]]))
    left, right = (np.concatenate(x) for x in zip(*pairs, strict=True))
    return pa.table({
        "id": pa.array(np.concatenate([ids, left]), pa.int64()),
        "n": pa.array(np.concatenate([n, np.zeros(len(left), np.int64)])),
        "other": pa.chunked_array([pa.nulls(len(ids), pa.int64()), pa.array(right, pa.int64())]),
    })


def counts(heads: DataFrame, found: DataFrame, s: Settings) -> DataFrame:
    """(id, n, other) of ``count_links`` for all heads (id, v, dims, weight, marked) that are in a component.

    No link leaves a component (id, c), so each is compared with itself alone: small ones many to a task, large ones
    block against block, which costs the square of their rows, as the number of their links may be.
    """
    placed = heads.join(found.toDF("id", "c"), "id")
    size = placed.groupBy("c").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = cut(placed.join(size, "c"))
    rows = placed.where("blocks = 1").count()
    whole, none = max(1, rows // BLOCK), F.lit(-1)
    few = placed.where("blocks = 1").withColumns({"g": F.pmod(F.xxhash64("c"), F.lit(whole)), "bi": none, "bj": none, "block": none})
    many = placed.where("blocks > 1").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.withColumns({"g": F.col("c"), "bi": F.least("block", "other"), "bj": F.greatest("block", "other")})
    columns = ["g", "bi", "bj", "block", "c", "dims", "id", "weight", "marked", "v"]
    both = few.select(columns).union(many.select(columns))
    return both.groupBy("g", "dims", "bi", "bj").applyInArrow(lambda t: count_links(t, s), "id long, n long, other long")


def near_vectors(vectors: DataFrame, ids: str = "vec_id", vector: str = "embedding", s: Settings = Settings()) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``, under the name ``ids`` for id.

    A link is a cosine of at least ``s.cosine`` in double precision between two ids. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different lengths. Equal vectors are collapsed first and counted by their number. An id given
    several times is one vertex, with the links of all its vectors, and n_links counts each other id
    once, however many of its vectors are near. Rows without an id have no links, a null component_id and are kept. An
    empty table gives an empty result; other columns are not read, whatever their names.
    """
    rows = cut(valid(vectors, ids, vector).dropDuplicates(["id", "v"]))
    several = cut(rows.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select("id", F.lit(True).alias("marked")))
    classes = rows.join(several, "id", "left").withColumn("marked", F.coalesce("marked", F.lit(False)))
    weight = F.sum((~F.col("marked")).cast("long")).alias("weight")  # ids that have this vector alone
    classes = cut(classes.groupBy("v").agg(F.min("id").alias("rep"), weight, F.max("marked").alias("marked"), F.first("dims").alias("dims")))
    # A representative that has several vectors stands for several classes, which have numbers of their own.
    clash = classes.groupBy("rep").agg(F.count("*").alias("k")).where("k > 1")
    if clash.isEmpty():
        classes = classes.withColumn("head", F.col("rep"))
    else:
        classes = cut(classes.withColumn("head", F.monotonically_increasing_id()))
    same = cut(rows.join(classes.select("v", "rep", "head", "weight", "marked"), "v").select("id", "rep", "head", "weight", "marked"))
    heads = cut(classes.select(F.col("head").alias("id"), "v", "dims", "weight", "marked", "rep"))
    names = heads.select(F.col("id").alias("head"), "rep")
    edges = None
    for (dims,) in heads.select("dims").distinct().collect():
        own = heads.where(F.col("dims") == dims)
        for more in joined(own, s):
            edges = more if edges is None else edges.union(more)
    ties = same.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    if edges is not None:
        edges = edges.join(names.toDF("a", "ra"), "a").join(names.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    found = cut(components(ties if edges is None else ties.union(edges)))

    of_heads = names.join(found.toDF("rep", "c"), "rep").select("head", "c")
    counted = cut(counts(heads, of_heads, s))
    direct = counted.where("other IS NULL").groupBy("id").agg(F.sum("n").alias("n")).toDF("head", "n")
    links = same.join(direct, "head", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    single = links.join(several, "id", "left_anti").select("id", "head", (F.col("n") + F.col("weight") - 1).alias("n_links"))
    if several.isEmpty():
        per = single.select("id", "n_links")
    else:
        per = with_several(single, same, several, counted)

    out = vectors.select(F.col(ids).cast("long").alias("id")).join(per, "id", "left").join(found.toDF("id", "component"), "id", "left")
    component = F.coalesce("component", "id")
    kept = F.coalesce(F.col("id") == component, F.lit(True))
    return out.select(F.col("id").alias(ids), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))


def with_several(single: DataFrame, same: DataFrame, several: DataFrame, counted: DataFrame) -> DataFrame:
    """(id, n_links) of all ids, where ``several`` have more than one vector.

    single (id, head, n_links) has what the other ids link with among themselves; same (id, head, weight, marked) the
    vectors of all ids; counted the links of which an end belongs to one of the several.
    """
    mine = same.join(several.select("id"), "id", "left_semi").select("id", "head")
    own = same.where("marked").select(F.col("head").alias("a"), F.col("head").alias("b")).distinct()
    reach = cut(counted.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")).union(own).distinct())
    near = reach.join(mine.toDF("m", "b"), "b").select("a", "m").distinct().groupBy("a").agg(F.count("*").alias("more"))
    plain = single.join(near.withColumnRenamed("a", "head"), "head", "left").select("id", (F.col("n_links") + F.coalesce("more", F.lit(0))).alias("n_links"))
    wide = mine.withColumnRenamed("head", "a").join(reach, "a").select("id", "b").distinct()
    weights = same.select(F.col("head").alias("b"), "weight").distinct()
    ones = wide.join(weights, "b").groupBy("id").agg(F.sum("weight").alias("ones"))
    others = wide.join(mine.toDF("m", "b"), "b").where("m <> id").select("id", "m").distinct().groupBy("id").agg(F.count("*").alias("others"))
    both = ones.join(others, "id", "left").select("id", (F.col("ones") + F.coalesce("others", F.lit(0))).alias("n_links"))
    return plain.union(both)
