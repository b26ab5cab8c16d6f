"""Exactness of the building blocks with hot keys, small limits and different partition counts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rentloom.operators import scale
from rentloom.operators.aggregates import first_last_change, group_count_column, min_group_size
from rentloom.operators.quality import dedupe_keep_first, flag_duplicates
from rentloom.operators.sampling import sample_per_group, train_test_split


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows and one value a fifth of them."""
    rng = random.Random(7)
    rows = []
    for i in range(30_000):
        key = "hot" if i % 3 == 0 else f"k{i % 50}"
        value = 5.0 if i % 5 == 0 else round(rng.lognormvariate(3, 1), 3)
        rows.append((i, key, value))
    return spark.createDataFrame(rows, "id long, k string, v double").repartition(6).cache()


def quantiles_by_numpy(skewed, probs):
    pdf = skewed.toPandas()
    return {k: np.quantile(g["v"], probs) for k, g in pdf.groupby("k")}


@pytest.mark.parametrize("limits", [{}, {"WHOLE_GROUP_ROWS": 10}, {"WHOLE_GROUP_ROWS": 10, "BRACKET_ROWS": 50}, {"BROADCAST_ROWS": 3, "WHOLE_GROUP_ROWS": 10}])
def test_quantiles_are_exact(skewed, monkeypatch, limits):
    for name, value in {"GRID_STEPS": 5, **limits}.items():
        monkeypatch.setattr(scale, name, value)
    probs = [0, 0.01, 0.25, 0.5, 0.99, 1]
    want = quantiles_by_numpy(skewed, probs)
    got = {r["k"]: [r[f"q{i}"] for i in range(len(probs))] for r in scale.exact_quantiles(skewed, "v", probs, ["k"]).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(list(want[k]), rel=1e-12), k
    whole = scale.exact_quantiles(skewed, "v", [0.37]).first()
    assert whole["q0"] == pytest.approx(float(np.quantile(skewed.toPandas()["v"], 0.37)), rel=1e-12)


def test_quantiles_of_nothing(spark):
    assert scale.exact_quantiles(spark.createDataFrame([], "k string, v double"), "v", [0.5], ["k"]).collect() == []


@pytest.mark.parametrize("how", ["left", "inner"])
def test_skew_join_splits_hot_keys(skewed, monkeypatch, how):
    lookup = skewed.select("k").distinct().where("k <> 'k7'").withColumn("name", F.upper("k"))
    want = sorted(map(tuple, skewed.join(lookup, "k", how).select("id", "k", "name").collect()))
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 2)
    got = scale.skew_join(skewed, lookup, ["k"], how)
    assert sorted(map(tuple, got.select("id", "k", "name").collect())) == want


def test_wide_lookups_are_not_broadcast(spark, skewed, monkeypatch, capsys):
    lookup = skewed.select("k").distinct().withColumn("name", F.repeat("k", 1000))
    assert scale.fits_broadcast(lookup)
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 10_000)
    assert not scale.fits_broadcast(lookup)
    assert not scale.fits_broadcast(lookup.select(F.array("name").alias("names")))
    monkeypatch.setattr(scale, "HOT_ROWS", 3)      # every key is hot
    got = scale.skew_join(skewed, lookup, ["k"])
    assert got.count() == skewed.count() and got.where("name IS NULL AND k IS NOT NULL").isEmpty()


def test_average_ranks(skewed):
    pdf = skewed.toPandas()
    want = dict(zip(pdf["v"], pdf["v"].rank()))
    got = {r["v"]: r["rank"] for r in scale.value_ranks(skewed, "v").collect()}
    assert got == want


def test_dense_positions(skewed):
    got = {r["id"]: r["position"] for r in scale.dense_positions(skewed.where("id % 7 <> 0"), "id").collect()}
    assert got == {i: p for p, i in enumerate(sorted(got))}


def test_sample_sizes_and_stability(spark, skewed):
    first = {r["id"] for r in sample_per_group(skewed, ["k"], "id", 500, 120).collect()}
    other = {r["id"] for r in sample_per_group(skewed.repartition(3, "v"), ["k"], "id", 500, 120).collect()}
    assert first == other
    sizes = {r["k"]: r["count"] for r in skewed.groupBy("k").count().collect()}
    taken = skewed.where(F.col("id").isin(list(first))).groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in taken} == {k: min(n, 120) for k, n in sizes.items() if n >= 500}


def test_sample_orders_few_hashes_of_a_group(spark, monkeypatch):
    """Groups are counted, and no sketch of all their hashes is made; ids that repeat still give the whole sample."""
    from rentloom.operators import sampling

    sketched, quantiles = [], sampling.exact_quantiles

    def counted(df, *rest, **more):
        sketched.append(df.count())
        return quantiles(df, *rest, **more)
    monkeypatch.setattr(sampling, "exact_quantiles", counted)
    rows = [("big", i) for i in range(4000)] + [("small", i) for i in range(20)] + [("some", i) for i in range(90)] + [(None, 5)]
    df = spark.createDataFrame(rows, "k string, id long")
    got = sample_per_group(df, ["k"], "id", 30, 40)
    hashes = {(r["k"], r["id"]): r["h"] for r in df.select("k", "id", sampling.seeded_hash("id", 42).alias("h")).collect()}
    want = {key for k in ("big", "some") for key in sorted((x for x in hashes if x[0] == k), key=hashes.get)[:40]}
    assert {(r["k"], r["id"]) for r in got.collect()} == want and not sketched
    # All rows of one id: their hash lies above or below every bound together.
    same = spark.createDataFrame([(i % 7, i % 7) for i in range(7000)], "k long, id long")
    assert sample_per_group(same, ["k"], "id", 30, 40).groupBy("k").count().where("count = 1000").count() == 7


def test_split_is_exact_and_stable(skewed):
    part = skewed.where("id < 1237")
    a = {r["id"] for r in train_test_split(part, "id").where("is_train").collect()}
    b = {r["id"] for r in train_test_split(part.repartition(1), "id").where("is_train").collect()}
    assert a == b and len(a) == round(1237 * 0.8)


def test_group_helpers_with_hot_key(skewed, monkeypatch):
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 2)
    sizes = {r["k"]: r["count"] for r in skewed.groupBy("k").count().collect()}
    assert {(r["k"], r["Count"]) for r in group_count_column(skewed, ["k"]).select("k", "Count").distinct().collect()} == set(sizes.items())
    assert min_group_size(skewed, ["k"], 1000).select("k").distinct().count() == sum(n >= 1000 for n in sizes.values())


def test_copies(spark):
    rows = [(i, "copy" if i % 3 == 0 else f"t{i}", i % 4) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, text string, other int").repartition(5)
    kept = dedupe_keep_first(df, "id", ["text"])
    assert kept.count() == 2001 and kept.where("text = 'copy'").first()["id"] == 0
    assert flag_duplicates(df, "id", ["text"]).where("_dup").count() == 999


@pytest.mark.parametrize("partitions", [1, 2, 8])
def test_change_does_not_depend_on_partitions(spark, skewed, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        dated = skewed.withColumn("d", F.col("id") % 11)
        rows = first_last_change(dated.repartition(partitions), ["k"], "v", ["d", "id"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    pdf = skewed.toPandas().assign(d=lambda x: x["id"] % 11).sort_values(["d", "id"])
    want = {k: (g["v"].iloc[-1] - g["v"].iloc[0]) / g["v"].iloc[0] for k, g in pdf.groupby("k")}
    assert {r["k"]: r["change"] for r in rows} == pytest.approx(want)


def test_change_of_short_series(spark):
    df = spark.createDataFrame([("a", 1, 1, 0.0), ("a", 2, 2, 5.0), ("b", 1, 3, 7.0), ("c", 1, 4, 2.0), ("c", 1, 5, 4.0)], "k string, d int, id int, v double")
    got = {r["k"]: r["change"] for r in first_last_change(df, ["k"], "v", ["d", "id"]).collect()}
    assert got == {"a": None, "c": 1.0}
    kept = {r["k"]: r["change"] for r in first_last_change(df, ["k"], "v", ["d", "id"], "absolute", 1).collect()}
    assert kept == {"a": 5.0, "b": 0.0, "c": 2.0}


@pytest.mark.parametrize("dtype", ["date", "timestamp", "timestamp_ntz"])
def test_positions_by_time(spark, dtype):
    df = spark.range(500).select("id", F.expr(f"cast(timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(id as int), 7) as {dtype}) as t"))
    got = {r["id"]: r["position"] for r in scale.dense_positions(df, "t").collect()}
    assert got == {i: i for i in range(500)}


@pytest.mark.parametrize("kind", ["int", "date", "timestamp", "string"])
def test_first_and_last_by_any_order_type(spark, kind):
    """Ties on the date go by the row id, also for negative and very large ids; text takes the struct."""
    big = 9_000_000_000_000_000_000
    rows = [("a", 3, -big, 1.0), ("a", 3, big, 2.0), ("a", 1, 5, 4.0), ("a", 1, -5, 8.0), ("b", -2, 1, 3.0), ("b", 2, 0, 9.0)]
    df = spark.createDataFrame(rows, "k string, n int, id long, v double")
    days = F.date_add(F.lit("2024-01-05").cast("date"), F.col("n"))
    when = {"int": F.col("n"), "date": days, "timestamp": days.cast("timestamp"), "string": days.cast("string")}[kind]
    got = {r["k"]: r["change"] for r in first_last_change(df.withColumn("d", when), ["k"], "v", ["d", "id"], "absolute").collect()}
    assert got == {"a": 2.0 - 8.0, "b": 6.0}
