import random

import numpy as np
import pyarrow as pa
import pytest

from gridtable.llm import cgk_decontam as m

VOCABULARY = [f"term{i}" for i in range(800)] + ["the", "of", "and"] * 60


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_best_stretch():
    rng = random.Random(1)
    for _ in range(60):
        item = [rng.randrange(5) for _ in range(rng.randrange(1, 9))]
        words = [rng.randrange(5) for _ in range(rng.randrange(0, 14))]
        got, a, b = m.best_stretch(np.array(item, np.uint64), np.array(words, np.uint64))
        want = min(distance(item, words[i:j]) for i in range(len(words) + 1) for j in range(i, len(words) + 1))
        assert got == want == distance(item, words[a:b])


def edited(rng, words, rate):
    words = list(words)
    for _ in range(int(rate * len(words))):
        at = rng.randrange(len(words))
        what = rng.randrange(3)
        if what == 0:
            words[at] = rng.choice(VOCABULARY)
        elif what == 1:
            words.insert(at, rng.choice(VOCABULARY))
        elif len(words) > 2:
            del words[at]
    return words


@pytest.mark.parametrize(("rate", "least"), [(0, 1.0), (0.1, 0.99), (0.2, 0.95)])
def test_recall(rate, least):
    rng = random.Random(7)
    items = [[rng.choice(VOCABULARY) for _ in range(rng.randrange(12, 70))] for _ in range(60)]
    index = m.Index(list(range(60)), [" ".join(x) for x in items], m.Settings())
    texts = []
    for k in range(300):
        around = [[rng.choice(VOCABULARY) for _ in range(rng.randrange(50))] for _ in range(2)]
        texts.append(" ".join([*around[0], *edited(rng, items[k % 60], rate), *around[1]]).upper())
    _, _, words, _, _, row = m.read_words(pa.array(texts, pa.large_string()))
    found = {(r, i) for r, i, *_ in m.find(index, words, row, len(texts))}
    assert sum((k, k % 60) in found for k in range(300)) >= least * 300


@pytest.mark.parametrize("kind", ["change", "insert", "delete"])
def test_recall_at_every_length(kind):
    """All edits allowed, of one kind; each length by itself, 16 and its like among them."""
    rng = random.Random(19)
    for n in (4, 5, 6, 7, 8, 9, 10, 14, 15, 16, 17, 20, 25, 31, 32, 35, 40, 60):
        items = [[rng.choice(VOCABULARY[:800]) for _ in range(n)] for _ in range(100)]
        index = m.Index(list(range(100)), [" ".join(x) for x in items], m.Settings())
        texts = []
        for item in items:
            words = list(item)
            for _ in range(n // 5):
                at = rng.randrange(len(words))
                words[at : at + (kind != "insert")] = [] if kind == "delete" else [rng.choice(VOCABULARY)]
            texts.append(" ".join([*rng.choices(VOCABULARY, k=30), *words, *rng.choices(VOCABULARY, k=30)]))
        _, _, words, _, _, row = m.read_words(pa.array(texts, pa.large_string()))
        found = {(r, i) for r, i, *_ in m.find(index, words, row, len(texts))}
        assert sum((k, k) in found for k in range(100)) >= 93, n


def test_repetitions_follow_the_target():
    assert m.repetitions(16, m.Settings(recall=0.5)) < m.repetitions(16, m.Settings(recall=0.999)) <= m.MOST


def test_against_brute_force(spark):
    rng = random.Random(11)
    items = [[rng.choice(VOCABULARY) for _ in range(n)] for n in (20, 30, 9, 5, 4, 2)]
    texts = []
    for k in range(60):
        text = [rng.choice(VOCABULARY) for _ in range(80)]
        if k % 2:
            at = rng.randrange(80)
            text[at:at] = edited(rng, items[k % 6], rng.choice([0, 0.1]))
        texts.append(text)
    got = m.matches(
        spark.createDataFrame([(i, " ".join(t), i) for i, t in enumerate(texts)], "doc_id long, text string, item_id long"),
        spark.createDataFrame([(i, ", ".join(x)) for i, x in enumerate(items)] + [(90, None), (91, ""), (92, "?!")], "item_id long, text string"),
    )
    want = set()
    for i, t in enumerate(texts):
        for k, x in enumerate(items):
            most = int(0.2 * len(x) + 1e-9) if len(x) >= 4 else 0
            n = len(x)
            best = min(distance(x, t[a : a + size]) for a in range(len(t)) for size in range(max(0, n - most), n + most + 1))
            if best <= most:
                want.add((i, k, best))
    assert {(r.doc_id, r.item_id, r.edits) for r in got.collect()} == want


def test_positions_and_edges(spark, docs, empty):
    items = spark.createDataFrame([(1, "Drei vier fünf sechs sieben acht"), (1, "Drei vier fünf sechs sieben acht")], "item_id long, text string")
    texts = spark.createDataFrame([(5, "😀 eins zwei. DREI, vier fünf SECHS sieben acht!"), (5, None)], "doc_id long, text string")
    rows = m.matches(texts, items).collect()
    assert [(r.doc_id, r.edits, r.start, r.end) for r in rows] == [(5, 0, 13, 46)] * 2
    assert m.matches(empty, items).count() == 0 and m.matches(docs, items.where("false")).count() == 0
    left = m.drop_contaminated(docs, items)
    assert left.columns == docs.columns and left.count() == docs.count()
    assert m.drop_contaminated(texts, items).count() == 1
