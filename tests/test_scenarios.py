"""A table's life, step by step; what is expected is computed from the same rows in Python."""

import random
from decimal import Decimal
from statistics import mean

import pytest

from gridtable import AutoCompactionConfig, CompositeFilter, Database, Filter, StreamConfig, TableBuilder
from gridtable.errors import InvalidQueryError

PARCELS = "parcel long, depot string, grams long, fragile boolean, stamp decimal(20,0)"
DEPOTS = ["Aarhus", "Brno", "Cork", "Dijon", "Évora"]


class Ledger:
    """A table of parcels and the same rows as a dictionary."""

    def __init__(self, spark, path, groups=(), keys=range(30), seed=0):
        self.spark, self.path, self.rng, self.rows = spark, str(path), random.Random(seed), {}
        self.db = Database(spark, self.path)
        b = TableBuilder("parcels").add_column("parcel", "Int64", False).add_column("depot", "Utf8", False).add_column("grams", "Int64")
        b.add_column("fragile", "Bool").add_column("stamp", "UInt64").chunk_rows(37).add_hash_dimension("depot", 3)
        for g in groups:
            b.add_column_group(list(g))
        self.db.create_table(b.with_primary_key_as_row_id("parcel").build())
        if keys:
            self.insert(keys)

    def make(self, keys):
        r = self.rng
        return [(k, r.choice(DEPOTS), r.choice([None, r.randrange(50, 9000)]), r.random() < 0.3, Decimal(2**63 + k)) for k in keys]

    def frame(self, rows):
        return self.spark.createDataFrame(rows, PARCELS)

    def insert(self, keys):
        new = self.make(keys)
        self.rows |= {r[0]: r for r in new}
        return self.db.insert("parcels", self.frame(new))

    def update(self, keys):
        new = self.make(keys)
        self.rows |= {r[0]: r for r in new if r[0] in self.rows}
        return self.db.update_rows("parcels", self.frame(new))

    def delete(self, keys):
        self.rows = {k: r for k, r in self.rows.items() if k not in keys}
        return self.db.delete_rows("parcels", keys)

    def query(self, *filters):
        return self.db.select_all("parcels").filter(list(filters))

    def stored(self, db=None):
        return {r.parcel: tuple(r) for r in (db or self.db).select_all("parcels").execute().collect()}

    def check(self):
        assert self.stored() == self.rows


def test_queries_of_overlapping_batches(spark, tmp_path):
    t = Ledger(spark, tmp_path)
    t.insert(range(20, 140))
    t.insert(range(300, 345))
    t.check()
    rows = list(t.rows.values())
    at = lambda d: Filter.eq("depot", d)
    for d in DEPOTS:
        grams = [r[2] for r in rows if r[1] == d and r[2] is not None]
        q = t.query(at(d))
        assert (q.count(), q.sum("grams"), q.min("grams"), q.max("grams")) == (sum(r[1] == d for r in rows), sum(grams), min(grams), max(grams))
        assert q.avg("grams") == pytest.approx(mean(grams))
    assert t.query(*Filter.between("parcel", 25, 310)).count() == sum(25 <= r[0] <= 310 for r in rows)
    assert t.query(at("Cork"), *Filter.between("parcel", 30, 90)).count() == sum(r[1] == "Cork" and 30 <= r[0] <= 90 for r in rows)
    assert t.query(at("Cork") | at("Évora")).count() == sum(r[1] in ("Cork", "Évora") for r in rows)
    assert t.query(Filter.eq("fragile", True)).count() == sum(r[3] for r in rows)
    assert t.query(Filter.gte("stamp", 2**63 + 100)).count() == sum(r[4] >= 2**63 + 100 for r in rows)
    assert t.query().limit(7).execute().count() == 7 and t.query().limit(0).execute().count() == 0
    nowhere = t.query(at("Oslo"))
    assert (nowhere.count(), nowhere.sum("grams"), nowhere.avg("grams"), nowhere.min("grams")) == (0, 0, 0.0, None)
    with pytest.raises(InvalidQueryError):
        t.query(Filter.gt("depot", "Brno")).count()
    two = t.db.select("depot", "parcel").from_("parcels").filter(Filter.between("parcel", 28, 33)).execute()
    assert two.columns == ["depot", "parcel"] and {(r.depot, r.parcel) for r in two.collect()} == {(r[1], r[0]) for r in rows if 28 <= r[0] <= 33}


def test_hash_axis_of_numbers(spark, tmp_path):
    db = Database(spark, str(tmp_path))
    db.create_table(TableBuilder("reads").add_column("nr", "int64", False).add_column("meter", "int64").chunk_rows(16).add_hash_dimension("meter", 7).with_primary_key_as_row_id("nr").build())
    rng = random.Random(8)
    rows = [(i, rng.choice([-9, 0, 4, 1 << 40, None])) for i in range(-60, 60)]
    db.insert("reads", spark.createDataFrame(rows, "nr long, meter long"))
    for m in (-9, 0, 4, 1 << 40, 5):
        assert {r.nr for r in db.select("nr").from_("reads").filter(Filter.eq("meter", m)).execute().collect()} == {n for n, x in rows if x == m}
    assert db.select_all("reads").filter(Filter.between("nr", -33, -1)).count() == 33  # keys below zero
    assert db.select_all("reads").filter(Filter.is_null("meter")).count() == sum(x is None for _, x in rows)


def test_column_groups(spark, tmp_path):
    t = Ledger(spark, tmp_path, groups=[("parcel", "depot"), ("grams",), ("fragile", "stamp")])
    t.update([3, 4, 1000])
    t.delete([9])
    t.check()
    some = t.db.select("parcel", "grams").from_("parcels").filter(Filter.eq("depot", "Brno")).execute()
    assert {(r.parcel, r.grams) for r in some.collect()} == {(r[0], r[2]) for r in t.rows.values() if r[1] == "Brno"}
    t.db.compact("parcels")
    t.check()
    joins = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Join ")
    assert joins(t.db.select("depot").from_("parcels").execute()) == 0 < joins(t.db.select("depot", "grams").from_("parcels").execute())


def test_aggregates_read_their_columns_alone(spark, tmp_path):
    from pyspark.sql import functions as F

    t = Ledger(spark, tmp_path, groups=[("parcel", "depot"), ("grams",), ("fragile", "stamp")])
    plans = [t.query().aggregate(F.sum("grams").alias("s")), t.query().group_by("depot").agg(F.count("*").alias("n")), t.query().group_by("depot").count()]
    assert not any("Join" in p._jdf.queryExecution().executedPlan().toString() for p in plans)
    grams = [r[2] for r in t.rows.values() if r[2] is not None]
    assert plans[0].first()["s"] == sum(grams)
    assert {r.depot: r.n for r in plans[1].collect()} == {r["depot"]: r["count"] for r in plans[2].collect()} == {d: sum(r[1] == d for r in t.rows.values()) for d in {r[1] for r in t.rows.values()}}
    both = t.query(Filter.eq("fragile", True)).group_by("depot").agg(F.max(F.col("grams") + F.length("depot")).alias("m")).collect()
    want = {}
    for r in t.rows.values():
        if r[3]:
            want[r[1]] = max([x for x in (want.get(r[1]), None if r[2] is None else r[2] + len(r[1])) if x is not None], default=None)
    assert {r.depot: r.m for r in both} == want


def test_changes_outlive_the_object(spark, tmp_path):
    t = Ledger(spark, tmp_path)
    t.delete([2, 11, 4711])
    t.update([5, 6, 815])
    t.check()
    assert t.stored(Database(spark, t.path)) == t.rows
    places = {r["__rb"]: (r["entries"], r["max_txn"]) for r in t.db.dirty_chunks("parcels").collect()}
    assert places[0] == (4, 3) and sum(n for n, _ in places.values()) == 5  # 4711 is logged, 815 is not there
    assert t.db.has_patches("parcels") and t.db.has_patches("parcels", 0) and not t.db.has_patches("parcels", 1)
    assert t.db.max_patch_txn("parcels") == 3
    assert [t.db.change_log("parcels", *span).count() for span in ((None, 2), (2, None), (2, 2))] == [3, 2, 0]


def test_stream_inserter(spark, tmp_path):
    t = Ledger(spark, tmp_path, keys=())
    stream = t.db.stream_inserter("parcels", StreamConfig(25))
    for k in range(4):
        new = t.make(range(12 * k, 12 * k + 12))
        t.rows |= {r[0]: r for r in new}
        flushed = stream.write(t.frame(new))
        assert (flushed is not None) == (k == 2)
    assert (stream.flush_count, stream.buffered_rows) == (1, 12)
    stream.close()
    assert (stream.flush_count, stream.buffered_rows, stream.total_flushed_rows) == (2, 0, 48)
    with t.db.stream_inserter("parcels", StreamConfig(1000)) as more:
        more.write(t.frame(t.make([])))
        new = t.make([5, 99])
        t.rows |= {r[0]: r for r in new}
        more.write(t.frame(new))
    t.check()


def test_compaction(spark, tmp_path):
    t = Ledger(spark, tmp_path)
    t.delete([3, 8])
    t.update([1])
    result = t.db.compact("parcels")
    assert result.patches_applied == 2 and result.chunks_compacted > 0 and result.bytes_after > 0
    assert not t.db.has_patches("parcels") and t.db.change_log("parcels").count() == 0
    t.check()
    assert t.db.compact("parcels").chunks_compacted == 0
    t.delete([1])
    t.insert([1, 500])
    t.check()
    assert t.db.vacuum("parcels") > 0
    t.check()


def test_auto_compaction(spark, tmp_path):
    t = Ledger(spark, tmp_path)
    handle = t.db.start_auto_compaction("parcels", AutoCompactionConfig(4, 9, 0.05))
    assert handle.is_running
    t.delete([10, 12, 14, 16, 18])
    assert handle.wait(lambda: handle.compactions > 0)
    handle.trigger_now()
    handle.shutdown()
    assert not handle.is_running and handle.last_error is None
    assert t.db.change_log("parcels").count() == 0
    t.check()


def test_many_small_commits_leave_few_segments(spark, tmp_path):
    t = Ledger(spark, tmp_path, keys=())
    for k in range(14):
        t.insert([k, 40 + k])
        t.db.merge_segments("parcels", 4)
        assert len(t.db.catalog.state("parcels").segments) <= 4
    t.delete([2, 41])
    t.update([7])
    t.check()
    handle = t.db.start_auto_compaction("parcels", AutoCompactionConfig(interval=0.05, max_segments=2))
    assert handle.wait(lambda: len(t.db.catalog.state("parcels").segments) <= 2)
    handle.shutdown()
    assert handle.last_error is None
    t.check()
    t.db.compact("parcels")
    t.check()


def test_snapshots(spark, tmp_path):
    t = Ledger(spark, tmp_path)
    kept = [(t.db.snapshot("parcels"), dict(t.rows))]
    for step in (lambda: t.delete([4]), lambda: t.insert([4, 70]), lambda: t.update([70]), lambda: t.db.compact("parcels")):
        step()
        kept.append((t.db.snapshot("parcels"), dict(t.rows)))
    for snapshot, rows in kept:
        assert {r.parcel: tuple(r) for r in snapshot.select_all().execute().collect()} == rows
        assert t.db.snapshot("parcels", snapshot.txn).count() == len(rows)
        assert snapshot.count(Filter.eq("fragile", True)) == sum(r[3] for r in rows.values())


def test_cache(spark, tmp_path):
    t = Ledger(spark, tmp_path)
    cached = lambda *f: t.query(*f).cached().execute().count()
    for step in (lambda: t.delete([6]), lambda: t.insert([6, 31]), lambda: t.update([31])):
        step()
        assert cached() == cached() == len(t.rows) and len(t.db.cache) == 1
        assert cached(Filter.eq("depot", "Cork")) == sum(r[1] == "Cork" for r in t.rows.values())


def test_rows_that_come_and_go(spark, tmp_path):
    t = Ledger(spark, tmp_path, keys=range(-6, 6))
    for step in (lambda: t.delete([-6, 1]), lambda: t.insert([1]), lambda: t.update([1]), lambda: t.insert([1]), lambda: t.db.compact("parcels"), lambda: t.delete(list(range(-6, 6))), lambda: t.db.compact("parcels"), lambda: t.insert([1])):
        step()
        t.check()


def test_empty_composites(spark, tmp_path):
    t = Ledger(spark, tmp_path)
    assert t.query(CompositeFilter.and_([])).count() == 30
    assert t.query(CompositeFilter.or_([])).count() == 0
