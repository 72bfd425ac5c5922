import random

import numpy as np
import pyarrow as pa
import pytest

from gridtable.llm import byte_cnn as m
from gridtable.llm.common import utf8


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"plain{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        tail = "" if good else "$$$"
        texts.append(" ".join(rng.choice(words) + tail for _ in range(rng.randrange(20, 200))))
        labels.append(int(good))
    return texts, labels


@pytest.fixture(scope="module")
def model(spark):
    texts, labels = corpus(500, 1)
    return m.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(labels)), "doc_id long, quality int"))


def test_held_out_accuracy(spark, model):
    texts, labels = corpus(150, 8)
    rows = m.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert sum((r.score >= 0.7) == (labels[r.doc_id] == 1) for r in rows) >= 145


def plain_features(model, raw):
    """The same network, filter by filter and chunk by chunk."""
    n = (len(raw) + 2 * m.STEP + m.CHUNK * m.STEP - 1) // (m.CHUNK * m.STEP) * m.CHUNK * m.STEP
    raw = np.frombuffer(raw.ljust(n, b"\0"), np.uint8)
    x = model.embed[raw].reshape(-1, m.STEP * m.EMBED)
    r = x @ model.near
    r[:-1] += x[1:] @ model.far
    chunks = [r[a : a + m.CHUNK + m.OVERLAP].max(axis=0) for a in range(0, len(r), m.CHUNK)]
    pooled = np.maximum(np.array(chunks) + model.bias, 0)
    return np.concatenate([pooled.mean(axis=0), pooled.max(axis=0)])


def test_against_plain_network(model):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab $é!") for _ in range(n)) for n in (0, 1, 7, 439, 440, 441, 900, 5000)]
    texts[-1] += "$$$"
    got = m.features(model, pa.array(texts))
    for row, t in zip(got, texts, strict=True):
        assert np.allclose(row[: 2 * m.FILTERS], plain_features(model, t.encode()), atol=1e-4)


def test_end_of_a_long_text_counts(model):
    text = "plain1 " * 3000
    one, two = m.score_rows(pa.array([text, text + "plain1$$$ " * 400]), model)
    assert two < one


def test_layout_keeps_rows_apart():
    laid = m.lay(*utf8(pa.array(["ab", None, "c" * 1000, ""])))
    assert laid.length.tolist() == [2, 0, 1000, 0] and laid.row.tolist() == [0, 1, 2, 2, 2, 3]


def test_edges(spark, docs, empty, model):
    rows = m.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4)}) == 1
    assert m.score(empty, model).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in m.score(docs, m.train(docs, none)).collect()} == {0.5}
