import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from gridtable.llm import toxicity_crf as m


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    count = np.array([4, 0, 1, 6])
    unary, moves = rng.standard_normal(11), rng.standard_normal((2, 2))
    ahead, back = m.forward_backward(unary, count, moves)
    got, at = m.sigmoid(ahead + back), 0
    for n in count:
        u = unary[at : at + n]
        total, ones = 0.0, np.zeros(n)
        for labels in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(x * y for x, y in zip(u, labels, strict=True)) + sum(moves[a, b] for a, b in zip(labels, labels[1:], strict=False)))
            total += w
            ones += w * np.array(labels)
        assert np.allclose(got[at : at + n], ones / total)
        at += n


def plain_recursions(u, moves):
    ahead, back = np.array(u), np.zeros(len(u))
    for t in range(1, len(u)):
        ahead[t] += np.logaddexp(moves[0, 1], ahead[t - 1] + moves[1, 1]) - np.logaddexp(moves[0, 0], ahead[t - 1] + moves[1, 0])
    for t in range(len(u) - 1, 0, -1):
        x = u[t] + back[t]
        back[t - 1] = np.logaddexp(moves[1, 0], moves[1, 1] + x) - np.logaddexp(moves[0, 0], moves[0, 1] + x)
    return ahead, back


@pytest.mark.parametrize("strength", [0.1, 1.0, 8.0])
def test_chains_of_any_length_are_one_chain(strength):
    """Also where neighbours pull so hard that what a far word says is felt over many spans."""
    rng = np.random.default_rng(2)
    count = np.array([1, 0, m.SPAN, m.SPAN + 1, 5000, 3, 2 * m.SPAN, 0, 777])
    unary = rng.standard_normal(count.sum()) * 3 / strength
    moves = np.array([[strength, -strength], [-strength, strength]]) + rng.standard_normal((2, 2)) / 4
    ahead, back = m.forward_backward(unary, count, moves)
    at = 0
    for n in count:
        one, two = plain_recursions(unary[at : at + n], moves)
        assert np.allclose(ahead[at : at + n], one, atol=1e-8) and np.allclose(back[at : at + n], two, atol=1e-8)
        at += n


def test_sample_replaces_what_is_too_long(spark):
    rows = [(i, None if i % 5 == 0 else "x" * (100 if i % 2 else 10)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 3 == 0) for i in range(400)], "doc_id long, toxic boolean")
    texts, y, _ = m.labelled(docs, marks, "toxic", m.Sample(30, 50))
    assert set(texts.to_pylist()) == {"x" * 10} and 15 <= (y == 1).sum() <= 30 and 15 <= (y == 0).sum() <= 30


def test_gradient_raises_likelihood():
    texts, labels = corpus(120, 5)
    words = m.read_words(pa.array(texts, pa.large_string()))
    marks = m.word_labels(words, np.array(labels) == 1).astype(float)
    model = m.fit_field(words, marks, rounds=30)
    p = m.marginals(words, model)
    assert np.mean((p >= 0.5) == (marks == 1)) > 0.99 and marks.sum() > 20


def test_learning_holds_a_block_at_a_time():
    """What fit_field holds beside its input is bounded, and the blocks leave the model as it is."""
    import tracemalloc

    rng = np.random.default_rng(3)
    count = rng.integers(0, 400, 4000)
    none, n = np.zeros(0, np.int64), int(count.sum())
    words = m.Words(none, none, none, none, np.repeat(np.arange(len(count)), count), rng.integers(0, m.SLOTS, (n, len(m.PREFIXES)), np.int32), count)
    labels = (rng.random(n) < 0.1).astype(np.float64)
    tracemalloc.start()
    m.fit_field(words, labels, rounds=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20, peak


@pytest.mark.parametrize("block", [1, 50, 1 << 17])
def test_blocks_leave_the_model_as_it_is(monkeypatch, block):
    texts, labels = corpus(120, 5)
    toxic = np.array(labels) == 1
    texts = pa.array(texts, pa.large_string())
    whole = m.fit(texts, toxic)
    monkeypatch.setattr(m, "BLOCK", block)
    cuts = list(m.blocks(np.array([3, 0, 70, 0])))
    assert [r.start for r, _ in cuts] + [4] == [0] + [r.stop for r, _ in cuts] and cuts[-1][1].stop == 73
    again = m.fit(texts, toxic)
    assert np.allclose(again.weights, whole.weights, atol=1e-5) and np.allclose(again.document, whole.document, atol=1e-4)


def test_the_driver_gives_freed_memory_back(spark):
    from gridtable.llm import common

    assert common.trim(spark)


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"plain{i}" for i in range(300)]
    bad = ["vile", "awfulest", "awfuller", "rotten"]
    texts, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        toxic = i % 4 == 0
        for _ in range(4 if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        texts.append(" ".join(text))
        labels.append(int(toxic))
    return texts, labels


@pytest.fixture(scope="module")
def model(spark):
    texts, labels = corpus(600, 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(7, None), (10**6, 1)], "doc_id long, toxic int")
    return m.train(docs, marks)


def test_held_out_accuracy(spark, model):
    texts, labels = corpus(200, 9)
    got = m.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    right = sum((r.score >= 0.3) == (labels[r.doc_id] == 1) for r in got)
    assert right >= 195
    for r in got:
        for span in filter(None, r.offending.split(",")):
            a, b = map(int, span.split(":"))
            assert any(w in texts[r.doc_id][a:b] for w in ("vile", "awfulest", "awfuller", "rotten"))


def test_offsets_are_code_points(model):
    _, spans, _ = m.score_rows(pa.array(["日本é 😀 VILE plain1", None, ""], pa.string()), model)
    assert spans.to_pylist() == ["6:10", "", ""]


def test_edges(docs, empty, model):
    rows = m.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4, 5)}) == 1
    assert m.score(empty, model).count() == 0
    assert m.drop_toxic(docs, model).columns == docs.columns and m.drop_toxic(docs, model).count() == docs.count()


def test_no_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in m.score(docs, m.train(docs, none)).collect()} == {0.5}
