"""Toxicity by a linear-chain conditional random field.

Documents are chains of words with the labels 0 and 1 (toxic). A word's potential is a sum of weights
of hashed features (the whole word, its prefixes); neighbours share transition potentials. Word labels
for learning come from the document labels: a word of a toxic document is toxic if one of its features
is far more frequent in toxic documents. Forward-backward gives exact marginals over whole documents; the document score is
a logistic function of sums over them, learned on labelled documents that the field has not seen, and
the offending offsets are the runs of words whose marginal passes one half.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtable.llm.common import ALNUM, arrow, code_points, fold, give_back, lower_ascii, mix, rolling, run_hashes, slices, trim, utf8, word_spans

#: Prefix lengths in bytes that are features; 0 is the whole word.
PREFIXES = (0, 4, 5, 6, 7, 8)
SLOTS = 1 << 18
#: Words of a span. The spans of a chain are worked on side by side, as are those of other chains.
SPAN = 64
#: Words of the rows that are learned from at a time: besides features and labels, only so many have figures in memory.
BLOCK = 1 << 17
#: Marginals below this are not added up: long texts have many words that are a little unlikely to be toxic.
DOUBT = 0.1
LOWER = lower_ascii()


@dataclass(frozen=True)
class Sample:
    """The bound of what is learned from: so many labelled rows of each class, of at most so many characters. Longer ones,
    and null texts, are replaced by others."""

    rows: int = 2500
    longest: int = 50_000


@dataclass
class Model:
    weights: np.ndarray  # float32, SLOTS
    bias: float
    moves: np.ndarray  # transition potentials from, to
    document: np.ndarray  # logistic weights over document_features


@dataclass
class Words:
    """The words of some rows: byte spans, row, hashed features (words x PREFIXES), words a row."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    features: np.ndarray
    count: np.ndarray


def read_words(column: pa.Array) -> Words:
    data, offsets = utf8(pc.utf8_lower(column.cast(pa.large_string()).fill_null("")))
    starts, ends, row = word_spans(data, offsets, ALNUM)
    sums = rolling(data, LOWER)
    features = np.empty((len(starts), len(PREFIXES)), np.int32)
    for i, n in enumerate(PREFIXES):
        upto = np.minimum(starts + n, ends) if n else ends
        features[:, i] = (run_hashes(sums, starts, upto) + np.uint64(n * 0x51ED2701)) >> np.uint64(46)
    return Words(data, offsets, starts, ends, row, features, np.bincount(row, minlength=len(offsets) - 1))


def read_sample(texts: pa.Array) -> Words:
    """The words of many rows without their bytes, read a few rows at a time to keep the driver's memory small."""
    none = np.zeros(0, np.int64)
    counts, features = [none], np.zeros((0, len(PREFIXES)), np.int32)
    for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
        words, at = read_words(part.column(0)), len(features)
        features.resize((at + len(words.features), len(PREFIXES)), refcheck=False)  # in place: never held twice
        features[at:] = words.features
        counts.append(words.count)
    count = np.concatenate(counts)
    return Words(none, none, none, none, np.repeat(np.arange(len(count), dtype=np.int32), count), features, count)


def blocks(count: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """The rows and the words of runs of whole rows, with at most BLOCK words or one longer row."""
    ends, first = np.cumsum(count), 0
    while first < len(count):
        before = int(ends[first] - count[first])
        last = max(int(np.searchsorted(ends, before + BLOCK, side="right")), first + 1)
        yield slice(first, last), slice(before, int(ends[last - 1]))
        first = last


def potentials(features: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """Each word's sum of weights, a feature at a time."""
    total = np.full(len(features), bias)
    for i in range(features.shape[1]):
        total += weights[features[:, i]]
    return total


@dataclass
class Spans:
    """The spans of some chains, longest first: first word, words, whether a chain begins there, and place in the order
    of the chains; spans a chain."""

    first: np.ndarray
    size: np.ndarray
    head: np.ndarray
    place: np.ndarray
    per: np.ndarray

    @classmethod
    def of(cls, count: np.ndarray) -> Spans:
        per = -(-count // SPAN)
        base = np.cumsum(per) - per
        nth = np.arange(per.sum()) - np.repeat(base, per)
        first = np.repeat(np.cumsum(count) - count, per) + nth * SPAN
        size = np.minimum(np.repeat(count, per) - nth * SPAN, SPAN)
        order = np.argsort(-size, kind="stable")
        return cls(first[order], size[order], (nth == 0)[order], order, per)

    def steps(self) -> list[tuple[int, np.ndarray]]:
        """For each step within a span the step and the words that the spans which have one hold there."""
        longest = int(self.size[0]) if len(self.size) else 0
        active = np.searchsorted(-self.size, -np.arange(1, longest + 1), side="right")
        return [(t, self.first[: active[t]] + t) for t in range(longest)]


def products(unary: np.ndarray, spans: Spans, moves: np.ndarray) -> np.ndarray:
    """What a span makes of a message, as a 2 x 2 matrix up to a factor, in the order of the chains."""
    whole = np.zeros((len(spans.first), 2, 2))
    whole[:, 0, 0] = whole[:, 1, 1] = 1
    move = np.exp(moves - moves.max())
    for t, at in spans.steps():
        u = np.clip(unary[at], -300, 300)
        own = np.exp(np.stack([np.minimum(-u, 0), np.minimum(u, 0)], axis=1))
        k = len(at)
        step = np.einsum("nij,jk->nik", whole[:k], move)
        if t == 0:  # nothing comes before the first word of a chain: both labels are as likely
            step[spans.head[:k]] = whole[:k][spans.head[:k]][:, :, :1]
        step *= own[:, None, :]
        whole[:k] = step / step.max(axis=(1, 2), keepdims=True)
    out = np.empty_like(whole)
    out[spans.place] = whole
    return out


def log_ratio(m: np.ndarray) -> np.ndarray:
    m = np.maximum(m, 1e-300)
    return np.log(m[:, 1]) - np.log(m[:, 0])


def messages(unary: np.ndarray, spans: Spans, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each span the log ratio of the message that enters it from the left and of the one from the right."""
    left, right = np.zeros(len(spans.first)), np.zeros(len(spans.first))
    most = int(spans.per.max(initial=0))
    if most > 1:
        whole = products(unary, spans, moves)
        base = np.cumsum(spans.per) - spans.per
        order = np.argsort(-spans.per, kind="stable")
        base, per = base[order], spans.per[order]
        active = np.searchsorted(-per, -np.arange(1, most + 1), side="right")  # chains with so many spans
        now = whole[base[: active[0]], 0]
        for j in range(1, most):
            left[base[: active[j]] + j] = log_ratio(now[: active[j]])
            now = np.einsum("ni,nij->nj", now[: active[j]], whole[base[: active[j]] + j])
            now /= now.max(axis=1, keepdims=True)
        now = np.ones((len(base), 2))
        for j in range(most - 1, 0, -1):
            k = active[j]
            now[:k] = np.einsum("nij,nj->ni", whole[base[:k] + j], now[:k])
            now[:k] /= now[:k].max(axis=1, keepdims=True)
            right[base[:k] + j - 1] = log_ratio(now[:k])
    return left[spans.place], right[spans.place]


def forward_backward(unary: np.ndarray, count: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log ratios of label 1 to 0 of the forward messages (with the word's own potential) and the backward ones.

    Chains of any length are one chain each: products of the steps of each span give the messages at its ends, and
    from there the words of all spans are worked on at the same time.
    """
    (t00, t01), (t10, t11) = moves
    spans = Spans.of(count)
    left, right = messages(unary, spans, moves)
    ahead, back = np.array(unary, np.float64), np.zeros(len(unary))
    for t, at in spans.steps():
        a = left[: len(at)] if t == 0 else ahead[at - 1]
        more = np.logaddexp(t01, a + t11) - np.logaddexp(t00, a + t10)
        ahead[at] += more if t else np.where(spans.head[: len(at)], 0, more)
    back[spans.first + spans.size - 1] = right
    for t, at in reversed(spans.steps()):
        if t:
            x = unary[at] + back[at]
            back[at - 1] = np.logaddexp(t10, t11 + x) - np.logaddexp(t00, t01 + x)
    return ahead, back


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def marginals(words: Words, model: Model) -> np.ndarray:
    unary = potentials(words.features, model.weights, model.bias)
    ahead, back = forward_backward(unary, words.count, model.moves)
    return sigmoid(ahead + back)


def document_features(p: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A constant; the expected toxic words, of marginals that matter; their share; the greatest marginal; some at all; words with at least a half."""
    full = np.flatnonzero(count)
    at = (np.cumsum(count) - count)[full]
    out = np.zeros((len(count), 6))
    out[:, 0] = 1
    if len(full):
        total = np.add.reduceat(np.where(p >= DOUBT, p, 0.0), at)
        many = np.add.reduceat((p >= 0.5).astype(np.float64), at)
        out[full, 1:] = np.stack([np.log1p(total), np.minimum(1, 30 * total / count[full]), np.maximum.reduceat(p, at), np.minimum(many, 1), np.minimum(many, 4) / 4], axis=1)
    return out


def score_features(words: Words, model: Model, rows: slice, own: slice) -> np.ndarray:
    """``document_features`` of some rows."""
    none = words.data[:0]
    some = Words(none, none, none, none, words.row[own], words.features[own], words.count[rows])
    return document_features(marginals(some, model), some.count)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method for a ridge logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = sigmoid(x @ w)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def word_labels(words: Words, toxic: np.ndarray) -> np.ndarray:
    """Label 1 for words of toxic rows that have a feature typical of such rows."""
    marked = np.zeros(len(words.row), bool)
    n1, n0 = toxic.sum(), (~toxic).sum()
    for i in range(len(PREFIXES)):
        seen = np.zeros((2, SLOTS), np.int64)
        for _, own in blocks(words.count):
            pairs = np.unique(words.row[own].astype(np.int64) * SLOTS + words.features[own, i])
            bad = toxic[pairs // SLOTS]
            seen[1] += np.bincount(pairs[bad] % SLOTS, minlength=SLOTS)
            seen[0] += np.bincount(pairs[~bad] % SLOTS, minlength=SLOTS)
        odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
        marked |= ((odds > 2.5) & (seen[1] >= 5))[words.features[:, i]]
    return marked & toxic[words.row]


def fit_field(words: Words, labels: np.ndarray, rounds: int = 30) -> Model:
    """Adaptive gradient ascent on the conditional likelihood; its gradient comes from forward-backward."""
    inner = np.ones(len(labels), bool)
    inner[(np.cumsum(words.count) - words.count)[words.count > 0]] = False
    weights, bias, moves = np.zeros(SLOTS, np.float32), -3.0, np.zeros((2, 2))
    squares, square_bias, square_moves = np.full(SLOTS, 1e-3), 1e-3, np.full((2, 2), 1e-3)
    pairs = 2 * labels[:-1].astype(np.int8) + labels[1:].astype(np.int8)
    seen = np.bincount(pairs[inner[1:]], minlength=4).reshape(2, 2).astype(float)
    for _ in range(rounds):
        expected, off, g = np.zeros((2, 2)), 0.0, np.zeros(SLOTS)
        for rows, own in blocks(words.count):
            features = words.features[own]
            unary = potentials(features, weights, bias)
            ahead, back = forward_backward(unary, words.count[rows], moves)
            miss = labels[own] - sigmoid(ahead + back)
            later = np.flatnonzero(inner[own])
            a, x = ahead[later - 1], unary[later] + back[later]
            joint = np.stack([np.full(len(later), moves[0, 0]), moves[0, 1] + x, moves[1, 0] + a, moves[1, 1] + a + x])
            joint = np.exp(joint - joint.max(axis=0, initial=-np.inf))
            expected += (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
            off += miss.sum()
            for i in range(len(PREFIXES)):
                g += np.bincount(features[:, i], miss, minlength=SLOTS)
        scale = 1 / max(1.0, labels.sum())
        g = g * scale - 1e-5 * weights
        squares += g * g
        weights += (0.5 * g / np.sqrt(squares)).astype(np.float32)
        gb = off * scale
        square_bias += gb * gb
        bias += 0.3 * gb / np.sqrt(square_bias)
        gm = (seen - expected) * scale
        square_moves += gm * gm
        moves += 0.3 * gm / np.sqrt(square_moves)
    return Model(weights, float(bias), moves, np.zeros(6))


def fit(texts: pa.Array, toxic: np.ndarray) -> Model:
    """The field from two thirds of the rows, the document score from the rest; without rows all scores are one half."""
    toxic = np.asarray(toxic, bool)
    if not len(toxic):
        return Model(np.zeros(SLOTS, np.float32), -3.0, np.zeros((2, 2)), np.zeros(6))
    rest = np.arange(len(toxic)) % 3 == 0
    own = read_sample(texts.filter(pa.array(~rest)))
    model = fit_field(own, word_labels(own, toxic[~rest]))
    del own
    seen = read_sample(texts.filter(pa.array(rest)))
    x = np.concatenate([score_features(seen, model, *run) for run in blocks(seen.count)])
    model.document = logistic(x, toxic[rest].astype(np.float64), np.ones(rest.sum()))
    return model


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: Sample) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts, labels and weights of a bounded sample of the rows that may be learned from, spread evenly by a hash of the id.

    The weight of a class says how many labelled rows each of its sampled rows stands for. Labels that are null or
    have no text are left out; a document or label that is repeated counts as often. Without labels nothing is returned.
    """
    known = labels.where((fold(F.col("doc_id")) != 2) & F.col(label).isNotNull())
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rank = F.xxhash64("doc_id", F.lit(17))
    # Twice as many as are wanted, since some are null or too long; then the first of those that are left.
    parts = [known.where(F.col("y") == y).orderBy(rank, "doc_id").limit(2 * sample.rows) for y in (0, 1)]
    chosen = F.broadcast(parts[0].union(parts[1]))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    usable = docs.where(F.length("text") <= sample.longest).join(chosen, "doc_id").select("doc_id", "text", "y", rank.alias("rank"))
    parts = [usable.where(F.col("y") == y).orderBy("rank", "doc_id").limit(sample.rows) for y in (0, 1)]
    got = parts[0].union(parts[1]).toArrow()
    got = got.sort_by([("doc_id", "ascending")]).combine_chunks()
    order = np.argsort(mix(got["doc_id"].to_numpy().view(np.uint64)), kind="stable")
    got = got.take(pa.array(order))
    y = got["y"].to_numpy()
    each = {k: total.get(k, 0) / max(1, (y == k).sum()) for k in (0, 1)}
    column = got["text"].combine_chunks()
    return column, y, np.where(y == 1, each[1], each[0])


def train(docs: DataFrame, labels: DataFrame, sample: Sample = Sample()) -> Model:
    """A model from the labels' ``toxic``; held-out rows, lang, source and ids give it nothing.

    Null texts and labels teach nothing, empty texts are chains without words. With no labels, or empty tables, all
    scores are one half. Other columns are not read, whatever their names.
    """
    texts, y, weight = labelled(docs, labels, "toxic", sample)
    model = fit(texts, y == 1)
    del texts
    give_back()
    trim(docs.sparkSession)
    if len(y):  # the sample has more toxic rows than the corpus
        model.document[0] += np.log(max(weight[y == 1].mean() if (y == 1).any() else 1, 1e-9) / max(weight[y == 0].mean() if (y == 0).any() else 1, 1e-9))
    return model


def score_rows(column: pa.Array, model: Model) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Scores, offending spans (start:end in code points, comma-joined) and their number."""
    words = read_words(column)
    p = marginals(words, model)
    score = sigmoid(document_features(p, words.count) @ model.document)
    hit = p >= 0.5
    texts = [""] * len(score)
    number = np.zeros(len(score), np.int64)
    if hit.any():
        row = words.row
        joined = np.zeros(len(hit), bool)
        joined[1:] = hit[1:] & hit[:-1] & (row[1:] == row[:-1])
        heads = np.flatnonzero(hit & ~joined)
        tails = np.flatnonzero(hit & ~np.append(joined[1:], False))
        starts = code_points(words.data, words.offsets, words.starts[heads], row[heads])
        ends = code_points(words.data, words.offsets, words.ends[tails], row[tails])
        found: dict[int, list[str]] = {}
        for r, s, e in zip(row[heads].tolist(), starts.tolist(), ends.tolist(), strict=True):
            found.setdefault(r, []).append(f"{s}:{e}")
        for r, spans in found.items():
            texts[r], number[r] = ",".join(spans), len(spans)
    return score, pa.array(texts, pa.string()), number


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_spans, offending) for every row of ``docs`` (doc_id, text).

    Null and empty texts have the score of a text without words and no spans. Rows are scored one by
    one, so ties, repeated rows and an empty table need no care; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                value, spans, number = score_rows(part.column(1), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(value), pa.array(number), spans], names=["doc_id", "score", "n_spans", "offending"])

    return arrow(docs.select("doc_id", "text"), run, "doc_id long, score double, n_spans long, offending string")


def drop_toxic(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """``docs`` without the rows that score ``least`` or more; the columns stay, whatever their names.

    Null and empty texts have the score of a text without words, and stay if that is below ``least``. Repeated rows
    stay or go together. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                value, _, _ = score_rows(part.column(at), shared.value)
                yield part.filter(pa.array(value < least))

    return arrow(docs, run, docs.schema)
