"""Random sequences of changes against a dictionary, random predicates against plain filters."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gridtable import CompositeFilter, Database, Filter, TableBuilder, TableSpec
from gridtable.errors import ConfigError, ConflictError, InvalidQueryError, SchemaError
from gridtable.plans.predicates import condition, derive

SCHEMA = "id long, kind string, n long, day date"
KINDS = ["a", "b", "c", None]


def spec(groups=False):
    b = TableBuilder("t").add_column("id", "int64", False).add_column("kind", "utf8").add_column("n", "int64").add_column("day", "date")
    if groups:
        b.add_column_group(["kind"]).add_column_group(["n", "day"])
    return b.chunk_rows(7).add_hash_dimension("n", 2).add_hash_dimension("kind", 3).add_range_dimension("n", 10).add_range_dimension("day", 5).with_primary_key_as_row_id("id").build()


def rows(rng, ids):
    return [(i, rng.choice(KINDS), rng.choice([None, *range(-25, 25)]), rng.choice([None, dt.date(2024, 1, 1) + dt.timedelta(rng.randrange(20))])) for i in ids]


@pytest.mark.parametrize(("seed", "groups"), [(1, False), (2, True)])
def test_changes(spark, tmp_path, seed, groups):
    rng = random.Random(seed)
    db = Database(spark, str(tmp_path))
    db.create_table(spec(groups))
    model, snapshots = {}, []
    for step in range(9):
        ids = rng.sample(range(-30, 30), rng.randrange(1, 25))
        what = rng.choice(["insert", "insert", "delete", "update", "compact"]) if step else "insert"
        if what == "insert":
            new = rows(rng, ids)
            db.insert("t", spark.createDataFrame(new, SCHEMA))
            model |= {r[0]: r for r in new}
        elif what == "delete":
            db.delete_rows("t", ids)
            model = {i: r for i, r in model.items() if i not in ids}
        elif what == "update":
            new = rows(rng, ids)
            db.update_rows("t", spark.createDataFrame(new, SCHEMA))
            model |= {r[0]: r for r in new if r[0] in model}
        else:
            db.compact("t")
        snapshots.append((db.snapshot("t"), dict(model)))
        if step % 4 == 3:
            db = Database(spark, str(tmp_path))
    for snapshot, then in (snapshots[0], snapshots[4], snapshots[-1]):
        assert {r.id: tuple(r) for r in snapshot.select_all().execute().collect()} == then
    for _ in range(6):
        p = tree(rng, 2)
        got = {r.id for r in db.select_all("t").filter(p).execute().collect()}
        assert got == {i for i, r in model.items() if holds(p, dict(zip(("id", "kind", "n", "day"), r, strict=True)))}


def tree(rng, depth):
    if depth and rng.random() < 0.7:
        make = rng.choice([CompositeFilter.and_, CompositeFilter.or_])
        return make([tree(rng, depth - 1) for _ in range(rng.randrange(1, 4))])
    column = rng.choice(["id", "kind", "n", "day"])
    if column == "kind":
        return rng.choice([Filter.eq("kind", "a"), Filter.neq("kind", "b"), Filter.isin("kind", ["a", "c"]), Filter.is_null("kind")])
    value = dt.date(2024, 1, 1) + dt.timedelta(rng.randrange(20)) if column == "day" else rng.randrange(-30, 30)
    return rng.choice([Filter.eq, Filter.neq, Filter.gt, Filter.gte, Filter.lt, Filter.lte])(column, value)


def holds(p, row):
    if isinstance(p, CompositeFilter):
        return (all if p.kind == "and" else any)(holds(c, row) for c in p.children)
    x, v = row[p.column], p.value
    if p.op.name == "IsNull":
        return x is None
    if x is None:
        return False
    return {"Eq": lambda: x == v, "NotEq": lambda: x != v, "Gt": lambda: x > v, "GtEq": lambda: x >= v, "Lt": lambda: x < v, "LtEq": lambda: x <= v, "In": lambda: x in v}[p.op.name]()


def test_derived_predicates_lose_nothing(spark):
    """What a predicate implies about partitions holds for every row that it keeps."""
    from gridtable.functions.coords import with_coordinates

    rng = random.Random(5)
    own = spec()
    df = spark.createDataFrame(rows(rng, range(-200, 200)), SCHEMA).withColumn("__row_id", F.col("id"))
    df = with_coordinates(df, own).persist()
    for _ in range(15):
        p = tree(rng, 3)
        implied = derive(p, own)
        kept = df.where(condition(p, own))
        assert implied is None or kept.where(~F.coalesce(implied, F.lit(False))).count() == 0
    df.unpersist()


def test_partitions_are_pruned(spark, tmp_path):
    db = Database(spark, str(tmp_path))
    db.create_table(spec())
    db.insert("t", spark.createDataFrame(rows(random.Random(1), range(100)), SCHEMA))
    db.delete_rows("t", [1])
    q = db.select("id").from_("t").filter(Filter.eq("kind", "a")).filter(Filter.between("id", 10, 20))
    plan = q.execute()._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "kind" in line)
    filters = scan.split("PartitionFilters: [")[1].split("]")[0]
    assert "__rb" in filters and "__h1" in filters and "PushedFilters: [" in scan and "EqualTo(kind,a)" in scan
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan and "NestedLoop" not in plan


def test_second_hash_dimension_alone(spark, tmp_path):
    db = Database(spark, str(tmp_path))
    db.create_table(spec())
    data = rows(random.Random(3), range(60))
    db.insert("t", spark.createDataFrame(data, SCHEMA))
    for k in "abc":
        assert db.select_all("t").filter(Filter.eq("kind", k)).count() == sum(r[1] == k for r in data)


def test_errors(spark, tmp_path):
    db = Database(spark, str(tmp_path))
    db.create_table(spec())
    with pytest.raises(ConfigError):
        db.create_table(spec())
    db.create_table(spec(), replace=True)
    with pytest.raises(ConfigError):
        db.insert("nope", spark.range(1))
    with pytest.raises(SchemaError):
        db.insert("t", spark.range(1))
    with pytest.raises(SchemaError):
        db.insert("t", spark.createDataFrame(rows(random.Random(1), [1]), SCHEMA).withColumn("extra", F.lit(1)))
    assert db.insert("t", spark.createDataFrame(rows(random.Random(1), [1]), SCHEMA).withColumn("extra", F.lit(1)), ignore_extra=True) > 0
    with pytest.raises(InvalidQueryError):
        db.select("id").execute()
    with pytest.raises(InvalidQueryError):
        db.select("nope").from_("t").execute()
    with pytest.raises(InvalidQueryError):
        db.select_all("t").filter(Filter.gt("kind", "a")).count()
    assert db.select_all("t").strict(False).filter(Filter.gt("kind", "")).count() <= 1
    with pytest.raises(Exception, match="null"):
        db.insert("t", spark.createDataFrame([(None, "a", 1, None)], SCHEMA))
    db.delete_rows("t", [1])
    assert db.select_all("t").count() == 0
    assert db.list_tables() == ["t"]
    db.drop_table("t")
    assert db.list_tables() == [] and Database(spark, str(tmp_path)).list_tables() == []


def ids(db):
    return {r.id for r in db.select("id").from_("t").execute().collect()}


def beaten(monkeypatch, writer, method, winner):
    """``writer``'s transaction in which ``winner`` commits between its reading and its commit."""
    write = getattr(writer, method)

    def late(*args, **options):
        out = write(*args, **options)
        winner()
        return out

    monkeypatch.setattr(writer, method, late)
    return writer


def test_a_writer_that_loses_destroys_nothing(spark, tmp_path, monkeypatch):
    one, two = Database(spark, str(tmp_path)), Database(spark, str(tmp_path))
    one.create_table(spec())
    some = [spark.createDataFrame(rows(random.Random(k), range(10 * k, 10 * k + 5)), SCHEMA) for k in range(4)]
    loser = beaten(monkeypatch, two.writer("t"), "write_segment", lambda: one.insert("t", some[0]))
    with pytest.raises(ConflictError):
        loser.insert(some[1])
    fresh = Database(spark, str(tmp_path))
    assert ids(one) == ids(two) == ids(fresh) == set(range(5))
    two.insert("t", some[1])
    loser = beaten(monkeypatch, two.writer("t"), "_log", lambda: one.insert("t", some[2]))
    with pytest.raises(ConflictError):
        loser.delete([0])
    loser = beaten(monkeypatch, two.writer("t"), "_log", lambda: one.delete_rows("t", [12]))
    with pytest.raises(ConflictError):
        loser.update(some[0])
    two.delete_rows("t", [0])
    want = {*range(1, 5), *range(10, 15), *range(20, 25)} - {12}
    assert ids(one) == ids(two) == ids(fresh) == want
    data = tmp_path / "t" / "data"
    before = len(list(data.iterdir()))
    assert one.vacuum("t") < one.vacuum("t", orphan_hours=-1.0) and len(list(data.iterdir())) < before
    assert ids(one) == ids(Database(spark, str(tmp_path))) == want


def test_only_one_of_many_writes_a_log_file(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from gridtable.sources.files import Files

    files = Files(spark, str(tmp_path))
    path = files.path("log.json")
    with ThreadPoolExecutor(8) as pool:
        done = list(pool.map(lambda k: files.write(path, f"writer {k}"), range(16)))
    assert sum(done) == 1 and files.read(path) == f"writer {done.index(True)}" and files.names(files.base) == ["log.json"]


def test_tables_of_other_objects(spark, tmp_path):
    one, two = Database(spark, str(tmp_path)), Database(spark, str(tmp_path))
    one.create_table(spec())
    assert two.list_tables() == ["t"]
    for k in range(3):
        (one, two)[k % 2].insert("t", spark.createDataFrame(rows(random.Random(k), [k]), SCHEMA))
        assert ids(one) == ids(two) == set(range(k + 1))
    old = one.snapshot("t")
    two.compact("t", most_segments=1)
    assert two.vacuum("t") > 0 and ids(one) == {0, 1, 2}
    assert old.txn == 3 and one.catalog.current_txn("t") == 4


def test_writes_read_the_row_buckets_that_they_touch(spark, tmp_path, monkeypatch):
    """A row of a bucket that a small insert or update does not touch may be unreadable."""
    db = Database(spark, str(tmp_path))
    db.create_table(spec())
    db.insert("t", spark.createDataFrame(rows(random.Random(4), range(70)), SCHEMA))
    for f in (tmp_path / "t" / "data").glob("*/g0/__rb=[1-9]/**/*.parquet"):
        f.write_bytes(b"broken")
    for f in (tmp_path / "t" / "data").glob("*/g0/__rb=[1-9]/**/.*.crc"):
        f.unlink()
    db.insert("t", spark.createDataFrame(rows(random.Random(5), [2, 3]), SCHEMA))
    db.update_rows("t", spark.createDataFrame(rows(random.Random(6), [4, -1]), SCHEMA))
    assert db.change_log("t").count() == 3  # two rows inserted anew, one updated
    assert db.select_all("t").filter(Filter.between("id", 0, 6)).count() == 7


def test_compaction_reads_the_row_buckets_that_changed(spark, tmp_path):
    """A row of a bucket without logged operations may be unreadable."""
    db = Database(spark, str(tmp_path))
    db.create_table(spec())
    db.insert("t", spark.createDataFrame(rows(random.Random(4), range(70)), SCHEMA))
    for f in (tmp_path / "t" / "data").glob("*/g0/__rb=[1-9]/**/*.parquet"):
        f.write_bytes(b"broken")
    for f in (tmp_path / "t" / "data").glob("*/g0/__rb=[1-9]/**/.*.crc"):
        f.unlink()
    db.delete_rows("t", [2])
    assert db.compact("t").patches_applied == 1
    assert db.select_all("t").filter(Filter.between("id", 0, 6)).count() == 6


def test_axes_that_leave_few_rows_in_a_directory_are_columns(spark, tmp_path):
    """Places of one row each: the files are few, and the same rows are found."""
    db = Database(spark, str(tmp_path))
    b = TableBuilder("fine").add_column("id", "int64", False).add_column("kind", "utf8").add_column("n", "int64").chunk_rows(500)
    db.create_table(b.add_hash_dimension("kind", 3).add_range_dimension("n", 1).with_primary_key_as_row_id("id").build())
    model = {i: (i, KINDS[i % 4], None if i % 9 == 4 else i * 7 % 1501) for i in range(1500)}
    frame = lambda ids: spark.createDataFrame([model[i] for i in ids], "id long, kind string, n long")
    db.insert("fine", frame(range(1500)))
    assert len(list((tmp_path / "fine" / "data").glob("**/*.parquet"))) <= 9  # 3 row buckets, 3 hash buckets
    places = {r["__rg0"]: r["n"] for r in db.chunks("fine").groupBy("__rg0").agg(F.sum("rows").alias("n")).collect()}
    assert places == {None: sum(n is None for _, _, n in model.values())} | {n: 1 for _, _, n in model.values() if n is not None}
    q = db.select_all("fine").filter(Filter.between("n", 40, 90)).execute()
    assert "GreaterThanOrEqual(__rg0,40)" in q._jdf.queryExecution().executedPlan().toString()
    model |= {i: (i, "new", -i) for i in range(100, 120)}
    db.update_rows("fine", frame(range(100, 120)))
    db.delete_rows("fine", range(700, 720))
    model = {i: r for i, r in model.items() if not 700 <= i < 720}
    for _ in range(2):
        assert {tuple(r) for r in db.select_all("fine").execute().collect()} == set(model.values())
        for p, keep in ((Filter.between("n", -110, 90), lambda r: r[2] is not None and -110 <= r[2] <= 90), ([Filter.eq("kind", "a"), Filter.lt("n", 300)], lambda r: r[1] == "a" and r[2] is not None and r[2] < 300), ([Filter.is_null("n")], lambda r: r[2] is None)):
            assert {tuple(r) for r in db.select_all("fine").filter(p).execute().collect()} == set(filter(keep, model.values()))
        db.compact("fine")


def test_a_stream_of_growing_keys_reads_no_other_segments(spark, tmp_path, monkeypatch):
    """Segments whose ids are not met may be unreadable, the log is not listed, and the segments stay few."""
    import pyarrow as pa

    from gridtable import StreamConfig

    db = Database(spark, str(tmp_path))
    db.create_table(TableBuilder("s").add_column("id", "int64", False).add_column("x", "int64").with_primary_key_as_row_id("id").build())
    batch = lambda ids: pa.table({"id": pa.array(ids, pa.int64()), "x": pa.array([i * 2 for i in ids], pa.int64())})
    stream = db.stream_inserter("s", StreamConfig(10), most_segments=4)
    stream.write(batch(range(10)))
    monkeypatch.setattr(db.catalog, "transactions", lambda table: pytest.fail("the log is listed"))
    broken = next((tmp_path / "s" / "data").glob("*/g0/**/*.parquet"))
    kept = broken.read_bytes()
    broken.write_bytes(b"broken" * 200)
    for crc in (tmp_path / "s" / "data").glob("*/g0/**/.*.crc"):
        crc.unlink()
    stream.write(batch(range(10, 22)))
    broken.write_bytes(kept)
    for k in range(2, 7):
        stream.write(batch(range(12 * k, 12 * k + 12)))
        assert len(db.catalog.state("s").segments) <= 4
    stream.write(batch(range(5, 17)))  # take their places
    assert (stream.flush_count, stream.total_flushed_rows) == (8, 10 + 12 * 7)
    got = sorted(r.id for r in db.select_all("s").execute().collect())
    assert got == [*range(22), *range(24, 84)]


def test_row_ids_of_the_counter(spark, tmp_path):
    """The source gives other rows each time that it is read; each row is stored once, under a number of its own."""
    db = Database(spark, str(tmp_path))
    db.create_table(TableBuilder("c").add_column("x", "double").chunk_rows(100).with_snowflake_id().build())
    for k in range(3):
        db.insert("c", spark.range(0, 150, 1, 5).select(F.rand().alias("x")).where("x > 0.3"))
    got = [r["__row_id"] for r in db.select_all("c").with_row_id().execute().collect()]
    assert sorted(got) == list(range(len(got))) and 100 < len(got) < 450
    assert not (tmp_path / "c" / "staged").exists() or not list((tmp_path / "c" / "staged").iterdir())


def test_counted_rows_are_written_where_they_lie(spark, tmp_path, monkeypatch):
    """Numbered parts hold whole row buckets but for their ends, so no row is moved or kept for the column groups."""
    db = Database(spark, str(tmp_path))
    b = TableBuilder("c").add_column("x", "int64").add_column("y", "int64").add_column("z", "int64").add_column_group(["x"]).add_column_group(["y", "z"])
    db.create_table(b.chunk_rows(10).with_snowflake_id().build())
    rows = spark.range(0, 200, 1, 4).select(F.col("id").alias("x"), (F.col("id") * 2).alias("y"), (F.col("id") % 3).alias("z"))
    for method in ("repartition", "persist"):
        monkeypatch.setattr(type(rows), method, lambda *_, **__: pytest.fail("rows are moved or kept"))
    db.insert("c", rows)
    found = db.select_all("c").with_row_id().execute()
    assert "hashpartitioning(__txn" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "__txn" not in plan.split("SortMergeJoin" if "SortMergeJoin" in plan else "HashJoin")[1].split("\n")[0]
    got = sorted(tuple(r) for r in found.collect())
    assert [r[0] for r in got] == list(range(200)) and sorted(r[1:] for r in got) == [(i, 2 * i, i % 3) for i in range(200)]
    assert len(list((tmp_path / "c" / "data").glob("*/g0/**/*.parquet"))) <= 20 + 4


def test_column_groups_of_merged_segments(spark, tmp_path):
    """An id is there twice, under two transactions; its column groups do not mix."""
    db = Database(spark, str(tmp_path))
    db.create_table(spec(True))
    model = {}
    for k in range(3):
        new = rows(random.Random(k), range(4 * k, 4 * k + 9))
        db.insert("t", spark.createDataFrame(new, SCHEMA))
        model |= {r[0]: r for r in new}
    db.merge_segments("t", 1)
    assert len(db.catalog.state("t").segments) == 1
    for again in (db, Database(spark, str(tmp_path))):
        assert sorted(map(tuple, again.select_all("t").execute().collect())) == [model[i] for i in sorted(model)]


def test_duplicates_in_one_batch(spark, tmp_path):
    db = Database(spark, str(tmp_path))
    db.create_table(spec())
    batch = spark.createDataFrame([(1, "a", 1, None), (1, "b", 2, None), (1, "c", 3, None)], SCHEMA).coalesce(1)
    db.insert("t", batch)
    assert [r.kind for r in db.select_all("t").execute().collect()] == ["c"]
    db.insert("t", batch, order_by=["n"])
    db.update_rows("t", batch)
    assert [r.n for r in db.select_all("t").execute().collect()] == [3]


def test_nulls_and_aggregates(spark, tmp_path):
    db = Database(spark, str(tmp_path))
    db.create_table(spec())
    db.insert("t", spark.createDataFrame([(1, None, None, None), (2, "a", 4, None), (3, "b", 8, dt.date(2024, 1, 3))], SCHEMA))
    q = db.select_all("t")
    assert (q.count(), q.sum("n"), q.avg("n"), q.avg("n", null_as_zero=True), q.min("n"), q.max("n")) == (3, 12, 6.0, 4.0, 4, 8)
    assert db.select_all("t").filter(Filter.eq("day", dt.date(2024, 1, 3))).count() == 1
    assert db.select_all("t").filter(Filter.neq("kind", "a")).count() == 1
    assert db.select_all("t").limit(1).count() == 3  # a limit has no effect on aggregates


def test_compacting_all_segments(spark, tmp_path):
    db = Database(spark, str(tmp_path))
    db.create_table(spec(True))
    for k in range(4):
        db.insert("t", spark.createDataFrame(rows(random.Random(k), range(10 * k, 10 * k + 15)), SCHEMA))
    before = {tuple(r) for r in db.select_all("t").execute().collect()}
    result = db.compact("t", most_segments=2)
    assert result.chunks_compacted > 0 and len(db.catalog.state("t").segments) == 1
    assert {tuple(r) for r in db.select_all("t").execute().collect()} == before
    assert db.chunks("t").agg(F.sum("rows")).first()[0] == len(before) == 45


def test_arrow_and_pandas(spark, tmp_path):
    import pyarrow as pa

    db = Database(spark, str(tmp_path))
    db.create_table(TableBuilder("u").add_primary_key("id", "uint64").add_column("x", "int32").chunk_rows(10).build())
    db.insert("u", pa.table({"id": pa.array([0, 2**63, 2**64 - 1], pa.uint64()), "x": pa.array([1, 2, 3], pa.int32())}))
    assert db.select_all("u").filter(Filter.gte("id", 2**63)).count() == 2
    assert db.select_all("u").filter(Filter.eq("id", 2**64 - 1)).sum("x") == 3
    assert isinstance(db.catalog.spec("u"), TableSpec)
