import random
import re

import pytest

from gridtable.llm import bbit_minhash as m

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k):
    words = WORD.findall((text or "").translate(LOW))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def brute(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def same(spark, rows, k, percent):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = m.near_duplicates(df, m.Settings(shingle=k, percent=percent)).collect()
    want = brute(rows, k, percent)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert (r.component_id, r.kept) == (None, True)
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], r.doc_id == want[r.doc_id][1])


def test_against_brute_force(spark, documents):
    rows = [(i, t) for i, t, *_ in documents] + [(None, "one two"), (None, None)]
    same(spark, rows, 3, 85)


def test_chains_and_crowds(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows, text = [], list(base)
    for i in range(60):  # a chain: neighbours are near, ends are far apart
        text[rng.randrange(150)] = f"c{i}"
        text[rng.randrange(150)] = f"d{i}"
        rows.append((100 - i, " ".join(text)))
    for i in range(80):  # a crowd round one text, not all near each other
        copy = list(base)
        for _ in range(rng.randrange(9)):
            copy[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(copy)))
    rng.shuffle(rows)
    same(spark, rows, 3, 85)
    same(spark, rows, 5, 80)


def test_empty_and_drop(spark, docs, empty):
    assert m.near_duplicates(empty).count() == 0
    kept = m.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5, 6, 8, 9, 10, 11]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 1, 2), (2, "a b c d e f", 3, 4)], "doc_id long, text string, rep long, n long")
    assert [(r.doc_id, r.rep) for r in m.drop_duplicates(df).collect()] == [(1, 1)]


@pytest.mark.parametrize("minima", [160, 1024])
def test_estimate_is_safe(minima):
    s = m.Settings(shingle=3, percent=85)
    assert s.most_mismatches(minima) / minima > 0.15 * 0.75


def test_an_id_with_two_texts_keeps_the_links_of_both(spark):
    words = [[f"{p}{i}" for i in range(200)] for p in "abcd"]
    rows = []
    for i, w in enumerate(words):
        rows += [(1, " ".join(w)), (10 + i, " ".join([*w[:199], "other"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = m.near_duplicates(docs, m.Settings(turns=0)).collect()  # all is left to the last step
    assert {r.component_id for r in got} == {1}


@pytest.mark.parametrize("turns", [0, 3])
def test_boilerplate(spark, turns):
    """Texts that share most of their words and are no copies, and copies among them; all is left to the prefixes, or the last."""
    rng = random.Random(8)
    common = [f"common{i}" for i in range(110)]
    rows = []
    for i in range(120):
        own = [f"own{i}x{k}" for k in range(rng.randrange(20, 60))]
        rows.append((i, " ".join([*common, *own])))
        if i % 3 == 0:
            own[rng.randrange(len(own))] = "changed"
            rows.append((500 + i, " ".join([*common, *own])))
        if i % 10 == 0:
            rows.append((900 + i, " ".join(common[: 110 - i // 10])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = m.near_duplicates(df, m.Settings(shingle=3, percent=85, turns=turns)).collect()
    want = brute(rows, 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert 40 < len({c for _, c in want.values()}) < len(rows)
