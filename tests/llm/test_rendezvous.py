from collections import Counter

import xxhash
from pyspark.sql import functions as F

from gridtable.llm import rendezvous as m


def bid(i, s):
    seed = 42 if i is None else xxhash.xxh64(int(i).to_bytes(8, "little", signed=True), seed=42).intdigest()
    return xxhash.xxh64(s.to_bytes(4, "little"), seed=seed).intdigest() >> 11


def test_as_brute_force(spark):
    ids = [*range(-50, 400), None, None]
    rows = m.place(spark.createDataFrame([(i, 1) for i in ids], "doc_id long, n int"), "doc_id", [1.0] * 24, order=("n",)).collect()
    assert len(rows) == len(ids)
    for r in rows:
        assert r.shard == max(range(24), key=lambda s: (bid(r.doc_id, s), -s))
        assert r.grown_shard == max(range(25), key=lambda s: (bid(r.doc_id, s), -s)) and r.grown_shard in (r.shard, 24)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_weights(spark):
    rows = spark.range(20_000).select(m.shard(F.col("id"), [1.0, 2.0, 5.0]).alias("s")).groupBy("s").count()
    share = {r.s: r["count"] / 20_000 for r in rows.collect()}
    assert all(abs(share[s] - w / 8) < 0.02 for s, w in enumerate([1, 2, 5]))


def test_hot_key_and_empty(spark):
    df = spark.createDataFrame([(7,)] * 500 + [(i,) for i in range(100)], "doc_id long").repartition(5)
    rows = m.place(df, "doc_id", [1.0] * 4).collect()
    assert Counter(r.doc_id for r in rows)[7] == 501
    for s in range(4):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    assert m.place(df.where("false"), "doc_id", [1.0] * 4).count() == 0


def test_native(spark):
    plan = m.place(spark.range(10).withColumnRenamed("id", "doc_id"), "doc_id", [1.0] * 3)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_clashing_names(spark):
    """What is made here takes the place of columns of its name; others stay."""
    rows = [(i, i % 3, "a", 5, 6, 7, 8) for i in range(50)] + [(None, None, None, None, None, None, None)] * 2
    df = spark.createDataFrame(rows, "shard long, slot long, key string, part int, row int, n int, first int")
    got = m.place(df, "shard", [1.0] * 3, order=("key", "slot")).collect()
    assert len(got) == 52 and set(got[0].asDict()) == {"shard", "slot", "grown_shard", "key", "part", "row", "n", "first"}
    assert sum(r.part == 5 and r.key == "a" for r in got) == 50
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
