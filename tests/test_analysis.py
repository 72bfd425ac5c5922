"""Percentiles against Spark's own, which keeps a table of all values in one place."""

import random

import pytest
from pyspark.sql import functions as F

from gridtable.operators import analysis

SHARES = [0.0, 0.1, 0.25, 0.5, 0.95, 0.999, 1.0]


def values(rng, kind, n):
    make = {"spread": lambda: rng.uniform(-1e6, 1e6), "equal": lambda: 7.0, "few": lambda: float(rng.randrange(3)), "tail": lambda: rng.paretovariate(0.4), "holes": lambda: rng.choice([None, float("nan"), -0.0, 0.0, rng.random()])}[kind]
    return [make() for _ in range(n)]


@pytest.mark.parametrize("near", [2e-4, 0.05])
def test_percentiles_are_exact(spark, monkeypatch, near):
    monkeypatch.setattr(analysis, "NEAR", near)
    monkeypatch.setattr(analysis, "ACCURACY", round(4 / near))
    rng = random.Random(3)
    rows = [(kind, v) for kind in ("spread", "equal", "few", "tail", "holes", None) for v in values(rng, kind or "spread", 1500)] + [("one", 4.5), ("two", 1.0), ("two", 2.0), ("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "kind string, v double").repartition(5).cache()
    names = {f"p{i}": p for i, p in enumerate(SHARES)}
    got = {r["kind"]: r for r in analysis.ranked(df, ["kind"], "v", names).collect()}
    want = {r["kind"]: r for r in df.groupBy("kind").agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in names.items()]).collect()}
    assert set(got) == set(want)
    for kind in want:
        assert [got[kind][n] for n in names] == [None if want[kind][n] is None else pytest.approx(want[kind][n], rel=1e-13, nan_ok=True) for n in names], kind
    median = {r["kind"]: (r["median"], r["n"]) for r in analysis.summary(df, ["kind"], "v").collect()}
    assert median == {r["kind"]: (None if r["m"] is None else pytest.approx(r["m"], rel=1e-13, nan_ok=True), r["n"]) for r in df.groupBy("kind").agg(F.median("v").alias("m"), F.count("v").alias("n")).collect()}


def test_percentiles_of_nothing_and_of_whole_numbers(spark):
    empty = spark.createDataFrame([], "v long")
    assert [tuple(r) for r in analysis.percentile(empty, "v", [0.5]).collect()] == [(None,)]
    assert analysis.summary(empty, [], "v").first()["n"] == 0
    assert tuple(analysis.percentile(spark.range(10), "id", [0.5, 0.95]).first()) == (4.5, pytest.approx(8.55))


def test_no_table_of_all_values(spark):
    plans = [analysis.percentile(spark.range(1000), "id", [0.5]), analysis.summary(spark.range(1000), [], "id")]
    assert not any(f"{name}(" in p._jdf.queryExecution().optimizedPlan().toString() for p in plans for name in ("percentile", "median"))
