"""The stages over a small corpus, each against what it should do to its own input."""

import numpy as np
import pytest
import tiktoken

import corpus_pipeline
from gridtable.llm import byte_bpe
from gridtable.llm.queries import MULTILINGUAL, PATTERN

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = [docs]
    for name, f in corpus_pipeline.STAGES:
        f(spark, kept[-1], FOLDER).write.parquet(f"file://{folder}/{name}")
        kept.append(spark.read.parquet(f"file://{folder}/{name}"))
    return kept


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_each_stage_keeps_rows_whole(stages):
    counts = [df.count() for df in stages]
    assert counts == sorted(counts, reverse=True) and counts[0] == 200
    for before, after in ((0, 1), (1, 2), (2, 3)):
        one, two = texts(stages[before]), texts(stages[after])
        assert all(one[i] == t for i, t in two.items())


def test_near_duplicates(stages):
    before, after = texts(stages[1]), texts(stages[2])
    sets = {}
    for i, t in before.items():
        words = t.lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(after) == {find(i) for i in sets}


def test_decontamination(spark, stages):
    before, after = texts(stages[2]), texts(stages[3])
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert not any(x in t for x in items for t in after.values())
    gone = set(before) - set(after)
    assert {i for i, t in before.items() if any(x in t for x in items)} <= gone


def test_encoding(stages):
    vocabulary = byte_bpe.Vocabulary.read(MULTILINGUAL)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    masked = texts(stages[4])
    rows = stages[5].collect()
    assert {r.doc_id for r in rows} == set(masked)
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(masked[r.doc_id])


def test_run_is_the_stages(spark, stages):
    got = {(r.doc_id, r.n_tokens, bytes(r.ids)) for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == {(r.doc_id, r.n_tokens, bytes(r.ids)) for r in stages[5].collect()}


def test_toxicity_stage_is_the_operator(spark):
    """The stage keeps what op1's scores leave, learned from the same labels; of the next larger table, that there be toxic ones."""
    from gridtable.llm import toxicity_crf

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity_crf.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity_crf.score(docs, model).collect()}
    kept = texts(corpus_pipeline.toxicity(spark, docs, folder))
    assert set(kept) == {i for i, x in scores.items() if x < 0.3}
    assert 0 < len(kept) < len(scores)


def test_secrets_stage_as_brute_force(stages):
    """Each masked text is the old one with what the patterns and windows find replaced, and no base secret is left."""
    import pyarrow as pa

    from gridtable.llm import entropy_secrets

    before, after = texts(stages[3]), texts(stages[4])
    assert set(before) == set(after) and before != after
    for i, t in before.items():
        (spans,) = entropy_secrets.find(pa.array([t], pa.string()))
        covered = {k for a, _, b in spans for k in range(a, b)}
        kept = "".join(c for k, c in enumerate(t or "") if k not in covered)
        assert (after[i] or "").replace("[SECRET]", "") == kept.replace("[SECRET]", "")


def odd_folder(spark, path, docs):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, rep long"
    spark.createDataFrame(docs, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (2, 1, 1), (3, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_odd_tables_go_through(spark, tmp_path):
    """Nulls in every column, empty texts, a long one, repeated rows, columns with clashing names."""
    long = " ".join(f"w{i}" for i in range(30_000))
    docs = [(i, f"some words of number {i} " * 3, "en", "s", 5, 0.5, 7) for i in range(20)]
    docs += [(None, None, None, None, None, None, None), (40, None, "en", "s", 0, 0.1, 1), (41, "", "en", "s", 0, 0.1, 1), (42, long, "de", None, None, None, None), (5, docs[5][1], "en", "s", 5, 0.5, 7)]
    odd_folder(spark, f"file://{tmp_path}/odd", docs)
    kept = spark.read.parquet(f"file://{tmp_path}/odd/documents.parquet")
    for k, (name, f) in enumerate(corpus_pipeline.STAGES[:-1]):
        f(spark, kept, f"file://{tmp_path}/odd").write.parquet(f"file://{tmp_path}/{name}")
        kept = spark.read.parquet(f"file://{tmp_path}/{name}")
        assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "rep"]
    rows = corpus_pipeline.run(spark, f"file://{tmp_path}/odd").collect()
    assert len(rows) == kept.count() and len({r.doc_id for r in rows}) == len(rows)


def test_empty_tables_go_through(spark, tmp_path):
    odd_folder(spark, f"file://{tmp_path}/none", [])
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").collect() == []
