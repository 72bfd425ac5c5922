"""Eight query shapes over two tables: our layout against a plain Parquet file of the same rows.

``queries`` are median seconds over our tables, ``plain`` the same over plain files. The shapes without a prefix
are over the line items of the given scale, those with ``published_`` over a table of the size and layout of the
each shape read, and ``of`` how many there are. ``sweep`` has the insert and two shapes at other bucket sizes.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import sys
import tempfile
import time
from collections.abc import Callable
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridtable import Database, Filter, TableBuilder

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))
#: Of the table of the published figures.
ROWS = int(os.environ.get("BENCH_ROWS", "2000000"))
SENSORS, HASHES, CHUNK = 200, 20, 50_000
UNITS = {"B": 1, "KiB": 2**10, "MiB": 2**20, "GiB": 2**30}
Shapes = dict[str, tuple[Callable[[], DataFrame], Callable[[], DataFrame]]]


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(make: Callable[[], DataFrame]) -> float:
    run(make())
    took = []
    for _ in range(RUNS):
        start = time.perf_counter()
        run(make())
        took.append(time.perf_counter() - start)
    return round(median(took), 4)


def read(spark: SparkSession, make: Callable[[], DataFrame]) -> list[float]:
    """Files and MB that the scans of a query read."""
    run(make())
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last()
    values, total = store.executionMetrics(last.executionId()), {"number of files read": 0.0, "size of files read": 0.0}
    each, seen = last.metrics().iterator(), set()  # a plan that changes while it runs lists a scan again
    while each.hasNext():
        m = each.next()
        if m.name() in total and values.contains(m.accumulatorId()) and m.accumulatorId() not in seen:
            seen.add(m.accumulatorId())
            number, unit = re.search(r"([\d.,]+) ?(\w*)", values.apply(m.accumulatorId()).split("\n")[-1]).groups()
            total[m.name()] += float(number.replace(",", "")) * UNITS.get(unit, 1)
    return [int(total["number of files read"]), round(total["size of files read"] / 1e6, 3)]


def shapes(db: Database, table: str, plain: DataFrame, n: int, key: str, sensor: str, one: str) -> Shapes:
    """By a hash column, by ranges of the key, by both, by neither; all columns, or one."""
    first, second = f"{sensor.split('_')[0]}_7", f"{sensor.split('_')[0]}_90"
    eq = Filter.eq(sensor, first)
    part = lambda p: Filter.between(key, n // 3, n // 3 + n * p // 100)
    column = F.col(sensor) == first
    between = lambda p: F.col(key).between(n // 3, n // 3 + n * p // 100)
    every = lambda *f: db.select_all(table).filter(list(f)).execute()
    single = lambda *f: db.select(one).from_(table).filter(list(f)).execute()
    return {
        "all_hash_eq": (lambda: every(eq), lambda: plain.where(column)),
        "one_hash_eq": (lambda: single(eq), lambda: plain.where(column).select(one)),
        "all_range_1pct": (lambda: every(*part(1)), lambda: plain.where(between(1))),
        "all_range_10pct": (lambda: every(*part(10)), lambda: plain.where(between(10))),
        "all_hash_and_range": (lambda: every(eq, *part(1)), lambda: plain.where(column & between(1))),
        "all_hash_or_hash": (lambda: db.select_all(table).filter(eq | Filter.eq(sensor, second)).execute(), lambda: plain.where(F.col(sensor).isin(first, second))),
        "one_full": (lambda: single(), lambda: plain.select(one)),
        "all_full": (lambda: every(), lambda: plain),
    }


def line_items(spark: SparkSession, db: Database, folder: str) -> tuple[Shapes, DataFrame, float]:
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    key = F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1
    rows = lines.withColumn("id", key.cast("long")).withColumn("sensor", F.concat(F.lit("sensor_"), F.col("l_suppkey") % SENSORS))
    rows.write.parquet(f"{folder}/lines")
    plain = spark.read.parquet(f"{folder}/lines")
    n = plain.count()
    kinds = {"bigint": "int64", "int": "int32", "timestamp_ntz": "timestamp"}
    b = TableBuilder("lines")
    for c, t in plain.dtypes:
        b.add_column(c, kinds.get(t, t), c != "id")
    db.create_table(b.chunk_rows(max(1, n // 10)).add_hash_dimension("sensor", 8).with_primary_key_as_row_id("id").build())
    start = time.perf_counter()
    db.insert("lines", plain)
    return shapes(db, "lines", plain, n, "id", "sensor", "l_extendedprice"), plain, time.perf_counter() - start


def published(spark: SparkSession, db: Database, folder: str) -> tuple[Shapes, DataFrame, float]:
    """Measurements of sensors by a permuted time, 50 values each."""
    i = F.col("id")
    values = [f"value{k}" for k in range(1, 51)]
    rows = spark.range(0, ROWS, 1, int(CPUS)).select(
        "id", F.pmod(i * 2654435761, F.lit(ROWS)).alias("timestamp"), F.concat(F.lit("sensor_"), i % SENSORS).alias("sensor_id"),
        *[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000 * k)).alias(c) for k, c in enumerate(values, 1)],
    )
    rows.write.parquet(f"{folder}/measured")
    plain = spark.read.parquet(f"{folder}/measured")
    b = TableBuilder("measured").add_column("id", "int64").add_column("timestamp", "int64", False).add_column("sensor_id", "utf8")
    for c in values:
        b.add_column(c, "int64")
    for group in (["id", "timestamp", "sensor_id"], values[:16], values[16:]):
        b.add_column_group(group)
    db.create_table(b.chunk_rows(CHUNK).add_hash_dimension("sensor_id", HASHES).with_primary_key_as_row_id("timestamp").build())
    start = time.perf_counter()
    db.insert("measured", plain)
    return shapes(db, "measured", plain, ROWS, "timestamp", "sensor_id", "value1"), plain, time.perf_counter() - start


def sweep(db: Database, plain: DataFrame, n: int) -> dict[str, list[float]]:
    """Over row buckets and hash buckets: seconds of the insert, of a 1 % range and of one hash value."""
    out = {}
    rows = plain.select("id", "sensor", "l_extendedprice")
    for cuts, hashes in ((4, 2), (4, 16), (32, 2), (32, 16)):
        name = f"sweep{cuts}x{hashes}"
        b = TableBuilder(name).add_column("id", "int64", False).add_column("sensor", "utf8").add_column("l_extendedprice", dict(rows.dtypes)["l_extendedprice"])
        db.create_table(b.chunk_rows(max(1, n // cuts)).add_hash_dimension("sensor", hashes).with_primary_key_as_row_id("id").build())
        start = time.perf_counter()
        db.insert(name, rows)
        took = round(time.perf_counter() - start, 3)
        found = shapes(db, name, rows, n, "id", "sensor", "l_extendedprice")
        out[f"{cuts} row buckets, {hashes} hash buckets"] = [took, timed(found["all_range_1pct"][0]), timed(found["all_hash_eq"][0])]
    return out


def main() -> None:
    folder = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{folder}/shared")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    try:
        db = Database(spark, f"{folder}/db")
        lines, plain, insert = line_items(spark, db, folder)
        ours = {k: timed(f) for k, (f, _) in lines.items()}
        theirs = {k: timed(g) for k, (_, g) in lines.items()}
        value, n = round(sum(ours.values()), 4), plain.count()
        grids = sweep(db, plain, n)
        wide, _, insert_wide = published(spark, db, folder)
        ours |= {f"published_{k}": timed(f) for k, (f, _) in wide.items()}
        theirs |= {f"published_{k}": timed(g) for k, (_, g) in wide.items()}
        files = {k: read(spark, f) for k, (f, _) in wide.items()}
        print(json.dumps({
            "metric": "eight query shapes over line items, sum of medians", "value": value, "unit": "sec", "queries": ours, "sf": SF_DIR.rsplit("sf", 1)[-1], "plain": theirs, "rows": n, "insert_sec": round(insert, 3),
            "published": {"rows": ROWS, "columns": 53, "insert_sec": round(insert_wide, 3), "read": files, "of": files["all_full"]}, "sweep": grids,
        }))
    finally:
        spark.stop()
        shutil.rmtree(folder, ignore_errors=True)


if __name__ == "__main__":
    main()
