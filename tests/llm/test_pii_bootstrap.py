import random
import re
from collections import Counter

import pytest

from gridtable.llm import pii_bootstrap as m

#: The patterns as they are given, searched from left to right.
PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute(text):
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for x in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", x[0])
            ok = [True, kind == 1 and all(int(p) <= 255 for p in x[0].split(".")), 16 <= len(digits) <= 19 and m.luhn(digits), 8 <= len(digits) <= 15]
            if ok[kind]:
                found.append((kind, *x.span()))
    return found


def test_fixed_patterns_as_brute_force():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice(rng.choice(["0123456789. ", "ab@.-c@é", "+0123 ()-.", "1 -4"])) for _ in range(rng.randrange(40)))
        assert m.base_spans(text) == brute(text), repr(text)
    card = "4539 1488 0343 6467"
    assert m.base_spans(f"x {card} y") == brute(f"x {card} y") != []


def test_long_runs_are_linear():
    assert m.base_spans("a" * 300_000 + " @ " + "7" * 300_000 + ".") == []


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = []
    for i in range(300):
        text = [rng.choice(words) for _ in range(40)]
        if i % 3 == 0:
            text += ["Reach", "me:", f"user{i}@mail{i % 7}.example.com"]
        elif i % 10 == 1:
            text += ["reach", "me:", f"user{i}@intranet"]  # no fixed pattern finds it
        text += [rng.choice(words) for _ in range(10)]
        if i % 7 == 0:
            text += ["order", f"77{i:06d}"]
        rows.append((i, " ".join(text)))
    return spark.createDataFrame(rows, "doc_id long, text string"), dict(rows)


def test_unseen_identifiers_are_found(corpus):
    df, texts = corpus
    rows = m.find(df).collect()
    assert len(rows) == 300
    for r in rows:
        text = texts[r.doc_id]
        assert r.base == m.joined(brute(text))
        new = [s.split(":") for s in r.spans.split(",") if s and s not in r.base.split(",")]
        want = [x[0] for x in re.finditer(r"user\d+@intranet", text)]
        assert [text[int(a) : int(b)] for _, a, b in new] == want
        assert all(kind == "email" for kind, *_ in new) and r.n_found == len(new)


def test_discovered_identifiers_induce_patterns(spark):
    """ref: is never followed by what a fixed pattern finds; only what follows "Reach me:" shows what it is."""
    rng = random.Random(5)
    rows = []
    for i in range(240):
        text = [rng.choice(["lorem", "ipsum", "dolor", "sit"]) for _ in range(15)]
        k = i % 40
        if i % 3 == 0:
            text += ["Reach", "me:", f"user{i}@mail.example.com"]
        elif i % 3 == 1:
            text += ["Reach", "me:", f"user{k}@intranet"]
        else:
            text += ["Owner", "ref:", f"user{k + (60 if i % 5 == 0 else 0)}@intranet"]
        rows.append((i, " ".join([*text, "end"])))
    df, texts = spark.createDataFrame(rows, "doc_id long, text string"), dict(rows)

    def found(s):
        return {r.doc_id for r in m.find(df, s).collect() if r.n_found}

    after = {w: {i for i, t in texts.items() if f"{w} user" in t and "@intranet" in t} for w in ("me:", "ref:")}
    assert found(m.Settings(generations=1)) == after["me:"]
    assert found(m.Settings(generations=2)) == after["me:"] | after["ref:"]


def test_blocks_of_patterns_find_what_one_does(corpus, monkeypatch):
    df, _ = corpus
    patterns = m.cut(m.trusted(df))
    whole = sorted(map(tuple, m.extract(df, patterns).collect()))
    monkeypatch.setattr(m, "BLOCK", 1)
    assert patterns.count() > 1 and sorted(map(tuple, m.extract(df, patterns).collect())) == whole


def test_the_sieve_lets_all_patterns_through(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    known = rng.integers(-(2**63), 2**63, 5000)
    for bits in (1 << 27, 1 << 16):
        monkeypatch.setattr(m, "BITS", bits)
        table = m.sieve(spark.createDataFrame([(int(x),) for x in known], "pattern long"), 5000)
        assert m.passes(table, known).all() and m.passes(table, rng.integers(-(2**63), 2**63, 5000)).mean() < 0.1
        assert table.nbytes * 8 <= bits


@pytest.mark.parametrize("block", [1_000_000, 60])
def test_places_are_counted_for_patterns_alone(spark, monkeypatch, block):
    """Words that pass the sieve and are no patterns make no rows, and a pattern one row a task."""
    rng = random.Random(7)
    texts = [" ".join(f"{rng.choice(['the', 'of', 'as'])} w{rng.randrange(100_000)}" for _ in range(250)) for _ in range(400)]
    words = [t.split(" ") for t in texts]
    after = Counter(x for w in words for x in w[:-1]) + Counter(" ".join(x) for w in words for x in zip(w, w[1:-1], strict=False))
    known = ["the", "of", "as", *rng.sample(sorted(x for x in after if " " not in x), 100), *rng.sample(sorted(x for x in after if " " in x), 100), "neverseen"]
    hashes = {m.contexts(x.split(" "))[-1]: x for x in known}
    patterns = spark.createDataFrame([(h,) for h in hashes], "pattern long")
    raw = []
    seen = m.arrow
    monkeypatch.setattr(m, "arrow", lambda *args: raw.append(m.cut(seen(*args))) or raw[-1])
    monkeypatch.setattr(m, "BLOCK", block)
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(limit, "20")
    try:
        docs = spark.createDataFrame(list(enumerate([*texts, None, "", "the"])), "doc_id long, text string").repartition(2)
        got = {hashes[r.pattern]: r.places for r in m.occurrences(docs, patterns).collect()}
        assert got == {x: after[x] for x in hashes.values() if after[x]}
        rows = [r.pattern for x in raw for r in x.collect()]
    finally:
        spark.conf.unset(limit)
    assert set(rows) <= set(hashes) and max(Counter(rows).values()) <= 2
    assert m.occurrences(docs, patterns.where("false")).count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "mail a@b.co", "x", 2, 3)], "doc_id long, text string, pattern string, kind int, more int")
    assert m.find(df).first().base == "email:5:11"


def test_trust(corpus):
    df, _ = corpus
    rows = m.trusted(df).collect()
    assert rows and all(0.6 <= r.trust <= 1 and r.places >= 100 for r in rows)


def test_edges(spark, docs, empty):
    assert m.find(empty).count() == 0
    rows = m.find(docs).collect()
    assert len(rows) == docs.count() and all(r.spans == "" for r in rows)
    code = spark.createDataFrame([(1, "日本 😀 a@b.co")], "doc_id long, text string")
    assert m.find(code).collect()[0].spans == "email:5:11"
