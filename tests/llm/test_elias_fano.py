import random
import zlib

import numpy as np
import pytest

from gridtable.llm import elias_fano as m
from gridtable.llm.queries import BYTE_LEVEL, PATTERN


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [1, 2, 3, 4], [7] * 300, list(range(0, 100_000, 37))])
def test_sequences(values):
    e = m.EliasFano.of(np.array(values, np.int64))
    assert [e.select(i) for i in range(len(values))] == values
    assert e.selected(np.arange(len(values))).tolist() == values
    with pytest.raises(IndexError):
        e.select(len(values))


def test_random_and_size():
    rng = np.random.default_rng(1)
    for _ in range(30):
        values = np.sort(rng.integers(0, rng.integers(1, 10**7), rng.integers(1, 3000)))
        e = m.EliasFano.of(values)
        some = rng.integers(0, len(values), 20)
        assert (e.selected(np.arange(len(values))) == values).all() and (e.selected(some) == values[some]).all()
        assert all(e.select(int(i)) == values[i] for i in some)
    values = np.cumsum(rng.integers(1, 2000, 10_000))
    assert m.EliasFano.of(values).size * 8 < 10_000 * (2 + np.log2(values[-1] / 10_000) + 1.5)


@pytest.mark.parametrize("pattern", [PATTERN, None])
def test_files(spark, tmp_path, documents, docs, pattern):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(BYTE_LEVEL)
    own.encode_special_tokens = True
    folder = f"file://{tmp_path}/ids"
    extra = spark.createDataFrame([(None, "no id <|endoftext|>", "", "", 0), (-4, "before", "", "", 0)], docs.schema)
    m.write(docs.union(extra), folder, BYTE_LEVEL, pattern)
    rows = m.read(folder, spark).collect()
    rows.sort(key=lambda r: r.start)
    texts = sorted([(i, t or "") for i, t, *_ in documents] + [(-4, "before")])
    want = [(None, "no id <|endoftext|>"), *texts]
    start = 0
    assert [r.doc_id for r in rows] == [i for i, _ in want]
    for r, (_, t) in zip(rows, want, strict=True):
        ids = [*own.encode(t, add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_order(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["a", "bc", "def"]) for _ in range(rng.randrange(50)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    m.write(df, f"file://{tmp_path}/x", BYTE_LEVEL, PATTERN)
    got = sorted(m.read(f"file://{tmp_path}/x", spark).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == list(range(300))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))


def test_single_documents(spark, tmp_path):
    rows = [(i % 400, "w" * (i % 7) + " x" * (i % 5)) for i in range(500)] + [(None, "none")]
    folder = f"file://{tmp_path}/some"
    m.write(spark.createDataFrame(rows, "doc_id long, text string"), folder, BYTE_LEVEL, PATTERN)
    whole = [tuple(r) for r in m.read(folder, spark).collect()]
    for only in ([], [5], [399, 0, 17, 1000]):
        assert sorted(map(tuple, m.read(folder, spark, only).collect())) == sorted(r for r in whole if r[0] in only)


def test_one_id_is_dealt_out(spark, tmp_path):
    """Rows without an id, or all of one, fall into several shards and stay in order."""
    rows = [(None if i % 3 else 7, f"text {i % 50}", i) for i in range(3000)]
    folder = f"file://{tmp_path}/hot"
    m.write(spark.createDataFrame(rows, "doc_id long, text string, shard int"), folder, BYTE_LEVEL, PATTERN)
    assert spark.read.parquet(folder).select("shard").distinct().count() > 2
    got = sorted(m.read(folder, spark).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 2000 + [7] * 1000
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))


def test_empty(spark, tmp_path, empty):
    m.write(empty, f"file://{tmp_path}/none", BYTE_LEVEL, PATTERN)
    assert m.read(f"file://{tmp_path}/none", spark).count() == 0


def test_query_gives_the_ids_of_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    from gridtable.llm.queries import op4_elias_fano

    own = Tokenizer.from_file(BYTE_LEVEL)
    texts = ["plain text", "a <|endoftext|> b", "<|endoftext|>", "<|endoftext", "x<|endoftext|><|endoftext|>\n y"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in op4_elias_fano(spark, f"file://{tmp_path}").collect()}
    want = {i: np.array([*own.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in enumerate(texts)}
    assert 50256 in want[1]
    assert got == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in want.items()}
