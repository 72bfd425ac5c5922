"""Text quality by a byte-level convolutional network in numpy.

Bytes are embedded, filters of eight bytes slide over them four at a time, and rectified responses are
max-pooled over chunks that overlap and together cover the whole document. The mean and the greatest of
the chunks' features, and the document's length, are combined by a logistic function into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridtable.llm.common import arrow, slices, utf8
from gridtable.llm.toxicity_crf import Sample, labelled, logistic, sigmoid

#: Bytes of a step of the filters (a filter spans two), and steps of a chunk, whose neighbours it overlaps by so many.
STEP, CHUNK, OVERLAP = 4, 112, 16
EMBED, FILTERS = 8, 24


@dataclass
class Model:
    embed: np.ndarray  # 256 x EMBED, float32; byte 0 is padding and stays zero
    near: np.ndarray  # STEP * EMBED x FILTERS, over a filter's first half
    far: np.ndarray  # over its second half
    bias: np.ndarray
    out: np.ndarray  # logistic weights over document_features


@dataclass
class Laid:
    """Rows laid out in chunks: padded bytes in steps, first chunk and number of chunks of each row."""

    steps: np.ndarray  # (chunks * CHUNK) x STEP
    row: np.ndarray  # row of each chunk
    last: np.ndarray  # whether a chunk is its row's last
    first: np.ndarray
    length: np.ndarray


def lay(data: np.ndarray, offsets: np.ndarray) -> Laid:
    length = np.diff(offsets)
    chunks = (length + 2 * STEP + CHUNK * STEP - 1) // (CHUNK * STEP)
    first = np.cumsum(chunks) - chunks
    out = np.zeros(int(chunks.sum()) * CHUNK * STEP, np.uint8)
    row_of = np.repeat(np.arange(len(length)), length)
    out[np.arange(len(data)) - offsets[row_of] + first[row_of] * CHUNK * STEP] = data
    row = np.repeat(np.arange(len(length)), chunks)
    last = np.zeros(len(row), bool)
    last[first + chunks - 1] = True
    return Laid(out.reshape(-1, STEP), row, last, first, length)


def convolved(model: Model, laid: Laid) -> np.ndarray:
    """Responses of the filters at every step: chunks x CHUNK x FILTERS. A row's last step has no second half."""
    x = model.embed[laid.steps].reshape(len(laid.steps), STEP * EMBED)
    second = x @ model.far
    second[laid.first * CHUNK] = 0
    r = x @ model.near
    r[:-1] += second[1:]
    return r.reshape(-1, CHUNK, FILTERS)


def responses(model: Model, laid: Laid) -> tuple[np.ndarray, np.ndarray]:
    """Greatest response of each filter in each chunk, and the step where it is."""
    r = convolved(model, laid)
    at = r.argmax(axis=1)
    best = np.take_along_axis(r, at[:, None, :], axis=1)[:, 0]
    at = at + np.arange(len(r))[:, None] * CHUNK
    head = r[:, :OVERLAP].argmax(axis=1)
    head_best = np.take_along_axis(r, head[:, None, :], axis=1)[:, 0]
    head = head + np.arange(len(r))[:, None] * CHUNK
    ahead = np.flatnonzero(~laid.last)
    over = head_best[ahead + 1] > best[ahead]
    best[ahead] = np.where(over, head_best[ahead + 1], best[ahead])
    at[ahead] = np.where(over, head[ahead + 1], at[ahead])
    return best, at


def greatest(model: Model, laid: Laid) -> np.ndarray:
    """``responses`` without the places."""
    r = convolved(model, laid)
    best = r.max(axis=1)
    ahead = np.flatnonzero(~laid.last)
    best[ahead] = np.maximum(best[ahead], r[ahead + 1, :OVERLAP].max(axis=1))
    return best


def document_features(pooled: np.ndarray, laid: Laid) -> np.ndarray:
    """Mean and maximum of the chunks' rectified features, log length, short, a constant."""
    count = np.bincount(laid.row, minlength=len(laid.length))
    mean = np.add.reduceat(pooled, laid.first, axis=0) / count[:, None]
    top = np.maximum.reduceat(pooled, laid.first, axis=0)
    size = np.log1p(laid.length)[:, None] / 10
    return np.concatenate([mean, top, size, np.exp(-laid.length / 100)[:, None], np.ones((len(count), 1))], axis=1)


def fit(texts: pa.Array, good: np.ndarray, epochs: int = 10, batch: int = 64) -> Model:
    """Adam on the logistic loss; the outer weights are then solved exactly. Without rows all scores are one half."""
    rng = np.random.default_rng(3)
    scale = 1 / np.sqrt(STEP * EMBED * 2)
    model = Model(
        rng.standard_normal((256, EMBED)).astype(np.float32),
        (rng.standard_normal((STEP * EMBED, FILTERS)) * scale).astype(np.float32),
        (rng.standard_normal((STEP * EMBED, FILTERS)) * scale).astype(np.float32),
        np.full(FILTERS, -1.0, np.float32),
        np.zeros(2 * FILTERS + 3),
    )
    model.embed[0] = 0
    if not len(good):
        return model
    names = ("embed", "near", "far", "bias", "out")
    model.out[: 2 * FILTERS] = rng.standard_normal(2 * FILTERS) * 0.2
    moments = {n: (np.zeros_like(getattr(model, n), np.float64), np.zeros_like(getattr(model, n), np.float64)) for n in names}
    turn = 0
    for epoch in range(epochs):
        order = rng.permutation(len(good))
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            laid = lay(*utf8(texts.take(pa.array(rows))))
            best, at = responses(model, laid)
            pooled = np.maximum(best + model.bias, 0)
            x = document_features(pooled, laid)
            err = (sigmoid(x @ model.out) - good[rows]) / len(rows)
            grads = {"out": x.T @ err + 1e-4 * model.out}
            count = np.bincount(laid.row, minlength=len(rows))
            back = np.outer(err, model.out)
            top = x[:, FILTERS : 2 * FILTERS]
            is_top = pooled >= top[laid.row]
            d = back[laid.row, :FILTERS] / count[laid.row, None] + back[laid.row, FILTERS : 2 * FILTERS] * is_top
            d = d * (pooled > 0)
            grads["bias"] = d.sum(axis=0)
            emb = model.embed[laid.steps].reshape(len(laid.steps), STEP * EMBED)
            emb = np.concatenate([emb, np.zeros((1, STEP * EMBED), np.float32)])
            after = np.append(np.arange(1, len(laid.steps)), len(laid.steps))
            after[laid.first[1:] * CHUNK - 1] = len(laid.steps)  # padding follows a row's last step
            one, two = emb[at], emb[after[at]]  # chunks x FILTERS x STEP * EMBED
            grads["near"] = np.einsum("cf,cfk->kf", d, one)
            grads["far"] = np.einsum("cf,cfk->kf", d, two)
            steps = np.concatenate([laid.steps, np.zeros((1, STEP), np.uint8)])
            g = np.zeros((256, EMBED))
            for places, weights in ((at, model.near), (after[at], model.far)):
                to = (d[:, :, None] * weights.T[None]).reshape(-1, EMBED)
                which = steps[places].reshape(-1)
                for k in range(EMBED):
                    g[:, k] += np.bincount(which, to[:, k], minlength=256)
            g[0] = 0
            grads["embed"] = g
            turn += 1
            rate = 0.01 * min(1, turn / 30) * (1 - 0.9 * epoch / epochs)
            for n in names:
                m, v = moments[n]
                m *= 0.9
                m += 0.1 * grads[n]
                v *= 0.99
                v += 0.01 * grads[n] ** 2
                step = rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
                setattr(model, n, (getattr(model, n) - step).astype(getattr(model, n).dtype))
    x = np.concatenate([features(model, texts.slice(a, 256)) for a in range(0, len(good), 256)])
    model.out = logistic(x, good.astype(np.float64), np.ones(len(good)))
    return model


def features(model: Model, texts: pa.Array) -> np.ndarray:
    laid = lay(*utf8(texts))
    return document_features(np.maximum(greatest(model, laid) + model.bias, 0), laid)


def train(docs: DataFrame, labels: DataFrame, sample: Sample = Sample(2500, 30_000)) -> Model:
    """A model from the labels' ``quality``; held-out rows, lang, source and ids give it nothing.

    Null texts and labels teach nothing. With no labels, or empty tables, all scores are one half. Other columns are
    not read, whatever their names.
    """
    texts, y, weight = labelled(docs, labels, "quality", sample)
    model = fit(texts, (y == 1).astype(np.float64))
    if len(y):  # the sample's classes are more even than the corpus's
        model.out[-1] += np.log(max(weight[y == 1].mean() if (y == 1).any() else 1, 1e-9) / max(weight[y == 0].mean() if (y == 0).any() else 1, 1e-9))
    return model


def score_rows(column: pa.Array, model: Model) -> np.ndarray:
    return sigmoid(features(model, column) @ model.out)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of ``docs`` (doc_id, text), from all its bytes.

    Null and empty texts have the score of a chunk of padding. Rows are scored one by one, so ties,
    repeated rows and an empty table need no care; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score_rows(part.column(1), shared.value))], names=["doc_id", "score"])

    return arrow(docs.select("doc_id", "text"), run, "doc_id long, score double")
