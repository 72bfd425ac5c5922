"""Pure functions and column expressions against plain arithmetic."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtable import CompositeFilter, Filter, FilterOp, TableBuilder, TableSpec
from gridtable.errors import ConfigError, InvalidChunkNameError, InvalidQueryError
from gridtable.functions import coords
from gridtable.functions.naming import Chunk, chunk_path, format_chunk, parse_chunk
from gridtable.operators.compaction import CompactionLock, CompactionResult
from gridtable.operators.rows import union_distinct, vertical_join
from gridtable.plans.groups import ColumnGroups
from gridtable.plans.predicates import check
from gridtable.sources.cache import SnapshotCache
from gridtable.sources.manifest import RangeStats, State
from gridtable.spec import RowIdStrategy, spark_type

LEAST, MOST = -(1 << 63), (1 << 63) - 1


def test_ordered_numbers():
    assert (coords.ordered_u64(LEAST), coords.ordered_u64(MOST)) == (0, (1 << 64) - 1)
    values = [LEAST, -5, 0, 7, MOST]
    assert sorted(values, key=coords.ordered_u64) == values


@pytest.mark.parametrize("size", [1, 7, 1000, 100_000])
def test_floor_div(spark, size):
    values = [LEAST, LEAST + 1, -1001, -1000, -999, -1, 0, 1, 999, 1000, 2**53 + 1, MOST - 1, MOST]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", coords.floor_div(F.col("v"), size).alias("b"), coords.to_u64(F.col("v")).alias("u")).collect()
    assert all((r.b, int(r.u)) == (r.v // size, coords.ordered_u64(r.v)) for r in rows)


def test_overlapping_buckets():
    for low, high, size in ((3, 29, 8), (-41, -3, 13), (-7, 22, 10), (16, 16, 4), (0, 0, 1)):
        assert coords.overlapping_buckets(low, high, size) == sorted({v // size for v in range(low, high + 1)})
    assert coords.overlapping_buckets(None, 6, 3) is None and coords.overlapping_buckets(2, 7**12, 9) is None
    for bucket in (-4, 0, 11):
        first, stop = coords.bucket_row_range(bucket, 23)
        assert {i for i in range(-200, 400) if i // 23 == bucket} == set(range(first, stop))


def test_times_round_down(spark):
    values = [dt.datetime(1969, 12, 31, 23, 59, 59, 500_000), dt.datetime(1970, 1, 1), dt.datetime(2024, 2, 29, 12, 0, 0, 999_999)]
    df = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("t", T.TimestampNTZType())]))
    got = [r[0] for r in df.select(coords.as_number(F.col("t"), T.TimestampNTZType())).collect()]
    assert got == [coords.number_of(v, T.TimestampNTZType()) for v in values] and got[:2] == [-1, 0]
    day = spark.createDataFrame([(dt.date(1969, 12, 31),)], "d date").select(coords.as_number(F.col("d"), T.DateType())).first()[0]
    assert day == coords.number_of(dt.date(1969, 12, 31), T.DateType()) == -1


def test_composite_keys_differ(spark):
    spec = TableBuilder("t").add_column("a", "utf8").add_column("b", "utf8").with_composite_key_as_row_id(["a", "b"]).build()
    rows = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("", "abc")], "a string, b string").select(coords.row_id(spec).alias("i")).collect()
    assert len({r.i for r in rows}) == 3
    with pytest.raises(Exception, match="null in the key"):
        spark.createDataFrame([("a", None)], "a string, b string").select(coords.row_id(spec)).collect()


def test_counter(spark):
    df = spark.range(1000).repartition(7).withColumn("nth", F.monotonically_increasing_id()).persist()
    got = coords.with_counter(df, "nth", 50)
    assert got.columns == ["id", "__row_id"] and sorted(r["__row_id"] for r in got.collect()) == list(range(50, 1050))
    assert coords.with_counter(df.where("false"), "nth", 0).count() == 0
    df.unpersist()


def test_chunk_names():
    # Fixed format: chunk_r<row bucket>_c<group>[_h<hash>-...][_rg<range>-...]_v<version>.parquet
    for chunk, name in ((Chunk(12, 1, (7, 0, 3), (64,), 9), "chunk_r12_c1_h7-0-3_rg64_v9.parquet"), (Chunk(3, 0, (), (8, 1), 2), "chunk_r3_c0_rg8-1_v2.parquet"), (Chunk(81, 4, (), (), 6), "chunk_r81_c4_v6.parquet")):
        assert format_chunk(chunk) == name and parse_chunk(name) == chunk
    assert chunk_path("/lake/", "parcels", Chunk(81, 4, version=6)) == "/lake/parcels/chunks/chunk_r81_c4_v6.parquet"
    assert Chunk(9, 3, (1,)).row_key == Chunk(9, 8, (1,), (), 4).row_key
    for bad in ("chunk_r12_q1_v9.parquet", "chunk_r12_c1.parquet", "chunk_r12_c1_v9", "piece_r12_c1_v9.parquet", "chunk_r3_r3_c0_v2.parquet"):
        with pytest.raises(InvalidChunkNameError):
            parse_chunk(bad)


def test_range_stats():
    batches = [[17, -4, 33], [], [8], [-90, 250, 250, 1]]
    stats = RangeStats()
    for i, batch in enumerate(batches):
        stats = stats.merge(RangeStats(min(batch), max(batch), len(batch)) if batch else RangeStats())
        seen = sum(batches[: i + 1], [])
        assert (stats.low, stats.high, stats.count, stats.is_initialized) == (min(seen), max(seen), len(seen), True)
    assert not RangeStats().is_initialized
    state = State(txn=3, stats={"a": RangeStats(-5, -1, 2)})
    assert State.from_json(state.to_json()) == state


def test_types():
    assert spark_type("UInt64") == T.DecimalType(20, 0) and spark_type("Utf8") == T.StringType() and spark_type("timestamp") == T.TimestampNTZType()
    assert spark_type("array<int>") == T.ArrayType(T.IntegerType())
    with pytest.raises(ConfigError):
        spark_type("wibble")


def test_specs(tmp_path):
    infer = lambda *kinds: TableSpec.from_record({"name": "t", "columns": [{"name": f"c{i}", "data_type": k, "primary_key": True} for i, k in enumerate(kinds)] + [{"name": "x", "data_type": "bool"}], "partitioning": {"chunk_rows": 10}}).row_id
    assert infer() == RowIdStrategy() and infer("int8") == RowIdStrategy("single", ("c0",))
    assert infer("utf8") == RowIdStrategy("composite", ("c0",)) and infer("int64", "utf8").columns == ("c0", "c1")
    (tmp_path / "t.yaml").write_text(
        "name: events\ncolumns:\n  - {name: event_id, data_type: int64, nullable: false, primary_key: true}\n  - {name: event_type, data_type: utf8}\n"
        "partitioning:\n  chunk_rows: 1000\n  range_dimensions: [{column: event_id, chunk_size: 250}]\n  hash_dimensions: [{column: event_type, num_buckets: 4, strategy: PureHash}]\n"
        "  column_groups: [[event_id], [event_type]]\nstorage: {base_path: /data}\nrow_id_strategy: {SingleColumn: event_id}\n"
    )
    spec = TableSpec.from_yaml(str(tmp_path / "t.yaml"))
    assert TableSpec.from_json(spec.to_json()) == spec and spec.coordinates == ["__rb", "__h0", "__rg0"] and spec.primary_key == ["event_id"]
    for change in ({"chunk_rows": 0}, {"hash_dimensions": [{"column": "c", "num_buckets": 0}]}, {"range_dimensions": [{"column": "s", "chunk_size": 5}]}, {"range_dimensions": [{"column": "c", "chunk_size": 0}]}, {"column_groups": [["nope"]]}):
        with pytest.raises(ConfigError):
            TableSpec.from_record({"name": "t", "columns": [{"name": "c", "data_type": "int64"}, {"name": "s", "data_type": "utf8"}], "partitioning": {"chunk_rows": 1} | change})
    (tmp_path / "bad.yaml").write_text("just text")
    with pytest.raises(ConfigError):
        TableSpec.from_yaml(str(tmp_path / "bad.yaml"))


def test_column_groups():
    make = lambda *groups: ColumnGroups(TableSpec.from_record({"name": "t", "columns": [{"name": c, "data_type": "int64"} for c in "abcd"], "partitioning": {"chunk_rows": 1, "column_groups": [list(g) for g in groups]}}))
    assert make().groups == [["a", "b", "c", "d"]]
    g = make("ab", "c")
    assert g.groups == [["a", "b"], ["c"], ["d"]] and g.required(["a", "d"]) == [0, 2] and g.required([]) == [1]
    assert make("ab", "bcd").group("b") == 1


def test_filters():
    a, b, c = Filter.eq("a", 1), Filter.gt("b", 2), Filter("c", FilterOp.LtEq, 3)
    tree = (a | b) & c
    assert tree.has_or() and not (a & b).has_or() and CompositeFilter.of([a, b]).flatten() == [a, b]
    assert tree.normalize() == [[a, c], [b, c]]
    assert CompositeFilter.and_([]).normalize() == [[]] and CompositeFilter.or_([]).normalize() == []
    with pytest.raises(InvalidQueryError):
        tree.flatten()


def test_strict_rules():
    b = TableBuilder("t")
    for name, kind in (("i", "int32"), ("u", "uint64"), ("s", "utf8"), ("f", "bool"), ("d", "date"), ("t", "timestamp"), ("x", "double")):
        b.add_column(name, kind)
    spec = b.build()
    for good in (Filter.gt("i", 1), Filter.lte("u", 2**63), Filter.neq("s", "a"), Filter.eq("f", True), Filter.lt("d", dt.date(2020, 1, 1)), Filter.gte("t", dt.datetime(2020, 1, 1)), Filter.gt("x", 1.5), Filter.isin("s", ["a"]), Filter.is_null("f"), Filter.like("s", "a%")):
        check(good, spec)
    for bad in (Filter.gt("s", "a"), Filter.eq("s", 1), Filter.eq("i", "1"), Filter.neq("f", True), Filter.gt("f", False), Filter.eq("i", True), Filter.eq("d", dt.datetime(2020, 1, 1)), Filter.like("i", "a"), Filter.eq("none", 1), Filter.eq("i", None)):
        with pytest.raises(InvalidQueryError):
            check(bad, spec)


def test_row_operators(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "__row_id long, x string")
    two = spark.createDataFrame([(2, 20), (3, 30)], "__row_id long, y int")
    assert vertical_join([one, two], ["__row_id"]).collect() == [(2, "b", 20)]
    assert vertical_join([one], ["__row_id"]).count() == 2
    with pytest.raises(InvalidQueryError):
        vertical_join([], ["__row_id"])
    assert union_distinct([one, one, one.where("x = 'a'")]).count() == 2


def test_lock_and_cache(spark):
    lock = CompactionLock()
    assert lock.try_lock("a") and not lock.try_lock("a") and lock.try_lock("b")
    lock.unlock("a")
    assert lock.try_lock("a") and CompactionResult.noop().patches_applied == 0
    cache = SnapshotCache(2)
    for i in range(3):
        cache.put("t", i, spark.range(i + 1))
    assert len(cache) == 2 and cache.get("t", 0) is None and cache.get("t", 2).count() == 3
    cache.put("u", 1, spark.range(1))
    cache.invalidate("t")
    assert len(cache) == 1 and cache.get("t", 2) is None
    cache.clear()
    assert len(cache) == 0
