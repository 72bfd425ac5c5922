"""Analysis of measurements: percentiles, summaries, pivots, best and worst, correlation, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: The share of the rows around a rank whose values are looked at, to each side, and the sketch's accuracy, 4 times as fine.
NEAR, ACCURACY = 2e-4, 20_000
#: Groups up to which what the sketch says of them is sent to all tasks.
FEW_GROUPS = 10_000


def ranked(df: DataFrame, by: list[str], column: str, shares: dict[str, float], *others: Column) -> DataFrame:
    """Exact percentiles with linear interpolation, a column for each of ``shares``, and ``others``, for each group (or
    of all rows). Nulls do not count; of no values a percentile is null.

    No table of all values is made: a pass finds two values around each rank, by a sketch whose error is a quarter of
    ``NEAR`` (of few rows, the least and the greatest); a second one counts those below and keeps those between, which
    are about 2 x ``NEAR`` of the rows however often a value occurs.
    """
    df = df.select(*dict.fromkeys([*by, column]))
    value = F.col(column).cast("double")
    v = F.when(F.isnan(value), F.lit(float("inf"))).otherwise(value)  # the sketch has no place for NaN, the greatest value
    ends = F.array(*[F.lit(min(max(p + side, 0.0), 1.0)) for p in shares.values() for side in (-NEAR, NEAR)])
    around = F.when(F.count(v) <= 4 / NEAR, F.array(*[F.min(v), F.max(v)] * len(shares))).otherwise(F.percentile_approx(v, ends, ACCURACY))
    sketch = df.groupBy(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)]).agg(F.count(v).alias("__n"), F.count_if(F.isnan(value)).alias("__nan"), around.alias("__ends"))
    found = sketch.limit(FEW_GROUPS + 1).collect()
    if len(found) <= FEW_GROUPS:
        sketch = F.broadcast(df.sparkSession.createDataFrame(found, sketch.schema))
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)]
    rows = df.join(sketch, same) if by else df.crossJoin(sketch)
    bounds = [(F.col("__ends")[2 * i], F.col("__ends")[2 * i + 1]) for i in range(len(shares))]
    counts = [
        F.struct(F.count_if(v < low).alias("below"), F.count_if(v <= low).alias("low"), F.count_if(v <= high).alias("high"), F.sort_array(F.collect_list(F.when((v > low) & (v < high), v))).alias("between")).alias(f"__c{i}")
        for i, (low, high) in enumerate(bounds)
    ]
    grouped = rows.groupBy(*by).agg(F.first("__n").alias("__n"), F.first("__nan").alias("__nan"), F.first("__ends").alias("__ends"), *counts, *others)

    def at(p: float, i: int) -> Column:
        (low, high), c, place = bounds[i], F.col(f"__c{i}"), (F.col("__n") - 1) * F.lit(p)
        first, last = F.floor(place), F.ceil(place)
        near = lambda rank: F.when(rank < c["low"], low).when(rank < c["low"] + F.size(c["between"]), F.get(c["between"], (rank - c["low"]).cast("int"))).otherwise(high)
        one, other = (F.when(rank < F.col("__n") - F.col("__nan"), near(rank)).otherwise(F.lit(float("nan"))) for rank in (first, last))
        mean = F.when(one == other, one).otherwise(one + (other - one) * (place - first))
        missed = F.raise_error(F.lit(f"the sketch of {column} has missed a rank")).cast("double")
        return F.when(F.col("__n") > 0, F.when((first < c["below"]) | (last >= c["high"]), missed).otherwise(mean))

    return grouped.withColumns({name: at(p, i) for i, (name, p) in enumerate(shares.items())}).drop("__n", "__nan", "__ends", *[f"__c{i}" for i in range(len(shares))])


def percentile(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """Exact percentiles with linear interpolation, one row with a column p<percent> for each."""
    names = {f"p{round(100 * p)}": p for p in shares}
    return ranked(df, [], column, names).select(*names)


def summary(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Least, median, mean, greatest value, standard deviation and count, for each group (or of all rows)."""
    c = F.col(column)
    found = ranked(df, by, column, {"median": 0.5}, F.min(c).alias("min"), F.avg(c).alias("mean"), F.max(c).alias("max"), F.stddev(c).alias("std"), F.count(c).alias("n"))
    return found.select(*by, "min", "median", "mean", "max", "std", "n")


def heat_map(df: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """The mean of ``value`` for each row and each of the ``columns``."""
    return df.groupBy(row).pivot(column, columns).agg(F.avg(value))


def best_and_worst(df: DataFrame, label: str, value: str, by: list[str] | None = None) -> DataFrame:
    """The labels of the least and greatest value, the least label among equals."""
    order = F.struct(F.col(value), F.col(label))
    worst = F.max(F.col(value)).alias("worst_value")
    return df.groupBy(*(by or [])).agg(F.min_by(label, order).alias("best"), F.min(value).alias("best_value"), F.max_by(label, order).alias("worst"), worst)


def correlation(df: DataFrame, one: str, other: str) -> DataFrame:
    return df.agg(F.corr(one, other).alias("corr"))


def added_cost(df: DataFrame, size: str, value: str, by: list[str]) -> DataFrame:
    """The growth of ``value`` from one ``size`` to the next, for each unit of size, within each group."""
    w = Window.partitionBy(*by).orderBy(size)
    step = (F.col(value) - F.lag(value).over(w)) / (F.col(size) - F.lag(size).over(w))
    return df.select(*by, size, value, step.alias("added"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
