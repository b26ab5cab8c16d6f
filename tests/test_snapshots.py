"""Stages, upserts and model loads that are published whole or not at all."""

import pytest
from pyspark.sql import functions as F

from rentloom.operators import relational as R
from rentloom.sources.snapshots import current, exists, input_key, publish
from rentloom.sources.stages import LoadRefused, load_model, load_order, stage

ROWS = "k long, v string, seq long"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_a_stage_is_built_anew_when_its_input_changes(spark, tmp_path):
    source, place = str(tmp_path / "in"), str(tmp_path / "stage")
    spark.range(3).write.parquet(source)

    def build():
        return spark.read.parquet(source).select((F.col("id") * 2).alias("x"))

    def never():
        raise AssertionError("nothing has changed")

    first = input_key(spark.read.parquet(source), factor=2)
    assert stage(spark, place, build, key=first).count() == 3
    assert stage(spark, place, never, key=input_key(spark.read.parquet(source), factor=2)).count() == 3
    assert input_key(spark.read.parquet(source), factor=3) != first
    spark.range(5).write.mode("append").parquet(source)
    assert stage(spark, place, build, key=input_key(spark.read.parquet(source), factor=2)).count() == 8


def test_a_failed_rebuild_leaves_the_old_stage(spark, tmp_path):
    place = str(tmp_path / "stage")
    assert stage(spark, place, lambda: spark.range(4)).count() == 4

    def broken():
        return spark.range(9).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))

    with pytest.raises(Exception, match="lost"):
        stage(spark, place, broken, refresh=True)
    assert stage(spark, place, broken).count() == 4
    # A manifest without its marker, as a job that dies leaves it, is no version.
    spark.createDataFrame([("data", "/nowhere", "")], "part string, path string, label string").write.parquet(f"{place}/versions/000000009")
    (tmp_path / "stage" / "versions" / "000000009" / "_SUCCESS").unlink()
    assert stage(spark, place, broken).count() == 4
    # A rebuild may read the stage itself, and takes a number of its own.
    assert stage(spark, place, lambda: stage(spark, place, broken).where("id > 0"), refresh=True).count() == 3
    assert current(spark, place).version == 10


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    from rentloom.sources import snapshots
    root = str(tmp_path / "t")
    publish(spark, root, {"a": "x"})
    monkeypatch.setattr(snapshots, "_numbers", lambda *_: [])
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        publish(spark, root, {"a": "y"})
    monkeypatch.undo()
    assert current(spark, root).parts == {"a": "x"}


@pytest.fixture
def target(spark):
    return spark.createDataFrame([(1, "old", 0), (2, "old", 0), (3, "old", 0), (None, "no key", 0)], ROWS)


@pytest.fixture
def source(spark):
    return spark.createDataFrame([(2, "a", 1), (2, "c", 3), (2, "b", 2), (3, "same", 1), (3, "same", 1), (4, "new", None), (None, "lost", 9)], ROWS)


def test_last_writer_wins(target, source):
    got = rows_of(R.upsert(target, source, ["k"], "seq"))
    assert got == sorted([(1, "old", 0), (2, "c", 3), (3, "same", 1), (4, "new", None), (None, "no key", 0)], key=str)
    refused = {(r.k, r.reason): r.rows for r in R.refused_rows(source, ["k"], "seq").collect()}
    assert refused == {(2, "superseded"): 2, (3, "superseded"): 1, (None, "missing key"): 1}


def test_without_an_order_differing_rows_of_a_key_are_refused(target, source):
    got = rows_of(R.upsert(target, source, ["k"]))
    assert got == sorted([(1, "old", 0), (2, "old", 0), (3, "same", 1), (4, "new", None), (None, "no key", 0)], key=str)
    assert {(r.k, r.reason): r.rows for r in R.refused_rows(source, ["k"]).collect()} == {(2, "conflict"): 3, (None, "missing key"): 1}


def test_a_third_of_all_rows_under_one_key(spark):
    source = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") + 10).alias("k"), F.col("id").cast("string").alias("v"), F.col("id").alias("seq"))
    target = spark.createDataFrame([(7, "old", 0)], ROWS)
    out = R.upsert(target, source, ["k"], "seq")
    assert out.groupBy("k").count().where("count > 1").isEmpty() and out.where("k = 7").first().seq == 29_997


def test_snapshot_writes_only_touched_buckets(spark, tmp_path):
    root = str(tmp_path / "table")
    rows = spark.range(200).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.lit(0).cast("long").alias("seq"))
    first = R.upsert_snapshot(spark, root, rows, ["k"], "seq", buckets=16)
    assert len(first.parts) == 16
    change = spark.createDataFrame([(5, "x", 1), (5, "y", 2), (1000, "new", 1), (None, "lost", 1)], ROWS)
    second = R.upsert_snapshot(spark, root, change, ["k"], "seq", buckets=16)
    moved = {p for p in second.parts if second.parts[p] != first.parts[p]}
    assert 1 <= len(moved) <= 2
    table = second.read(spark)
    assert table.count() == 201 and rows_of(table.where("k IN (5, 1000)")) == [(1000, "new", 1), (5, "y", 2)]
    assert first.read(spark).count() == 200                     # readers of the version before go on
    assert R.check_keys(table, ["k"]).isEmpty()
    third = R.upsert_snapshot(spark, root, change.limit(0), ["k"], "seq", buckets=16)
    assert third.parts == second.parts
    with pytest.raises(ValueError, match="buckets"):
        R.upsert_snapshot(spark, root, change, ["k"], "seq", buckets=8)


def test_load_order_from_references():
    refs = [("child", {"p": "id"}, "parent"), ("grandchild", {"c": "id"}, "child"), ("child", {"q": "id"}, "other"), ("child", {"up": "id"}, "child")]
    assert load_order(["grandchild", "child", "parent", "other"], refs) == ["parent", "other", "child", "grandchild"]
    with pytest.raises(ValueError, match="a.*b|b.*a"):
        load_order(["a", "b"], [("a", {"x": "y"}, "b"), ("b", {"x": "y"}, "a")])
    with pytest.raises(ValueError, match="nowhere"):
        load_order(["a"], [("a", {"x": "y"}, "nowhere")])


def test_an_orphan_stops_the_whole_load(spark, tmp_path):
    root = str(tmp_path / "model")
    parent, child = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id int, p int")
    keys, refs = {"parent": ["id"], "child": ["id"]}, [("child", {"p": "id"}, "parent")]
    loaded = load_model(spark, {"child": child, "parent": parent}, keys, refs, root)
    assert loaded.version == 1 and loaded.read(spark, "child").count() == 3
    orphan = child.unionByName(spark.createDataFrame([(13, 99), (10, 1)], "id int, p int"))
    with pytest.raises(LoadRefused) as refused:
        load_model(spark, {"child": orphan, "parent": parent}, keys, refs, root)
    assert sorted(refused.value.faults) == [("child", "key id", 1), ("child", "p -> parent", 1)]
    assert current(spark, root).version == 1 and current(spark, root).read(spark, "child").count() == 3
    assert not exists(spark, f"{root}/versions/000000002")
