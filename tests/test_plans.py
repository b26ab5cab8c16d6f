"""Whole plans: invariants of the ledger, the relational model, the statistics and the models."""

import random

import pytest
from pyspark.sql import functions as F

from rentloom import schema as S
from rentloom.cases import tables as V
from rentloom.cases.relations import cleaned
from rentloom.operators import model as N
from rentloom.operators import relational as R
from rentloom.operators import replies as P
from rentloom.operators import stats as M
from rentloom.plans import modelling
from rentloom.plans.cleaning import add_features, clean_listings
from rentloom.plans.modelling import ModelRun, explain_cluster, run_model


def test_ledger_accounts_for_every_row(spark, sf):
    raw = V.messy_listings(spark, sf).cache()
    result = clean_listings(raw, V.rates(spark, sf))
    kept = {r[0] for r in result.kept.select(S.ROW_ID).collect()}
    gone = {r[0]: r[1] for r in result.excluded.select(S.ROW_ID, S.REASON).collect()}
    assert not kept & gone.keys()
    assert kept | gone.keys() == {r[0] for r in raw.select(S.ROW_ID).collect()}
    assert all(gone.values())
    wide = add_features(result.kept)
    assert wide.where(F.col(S.MONTHLY_USD_PRICE).isNull() | F.col(S.PRICE_BAND).isNull()).count() == 0
    families = [c for c in wide.columns if c.startswith("1_")]
    assert wide.where(sum(F.col(f"`{c}`") for c in families) != F.col(S.FAMILY_RANK[S.AMENITIES])).count() == 0


def test_relational_model_is_sound(spark, sf):
    tables = R.relational_model(cleaned(spark, sf), V.rates(spark, sf))
    assert set(S.LOAD_ORDER) == set(tables)
    assert R.check_references(tables[S.ADDRESS], {S.UNIT: "name", S.PROVINCE: "province"}, tables[S.UNIT]).isEmpty()
    assert R.check_references(tables["Property"], {"Listing": S.ROW_ID}, tables["Listing"]).isEmpty()
    assert R.check_references(tables["Property_Amenities"], {"Amenities_type": "type"}, tables[S.AMENITIES]).isEmpty()
    assert R.check_keys(tables["Property"], [S.ROW_ID]).isEmpty()


def test_upsert_with_key_only_table(spark):
    a = spark.createDataFrame([("x",), ("y",)], "k string")
    b = spark.createDataFrame([("y",), ("z",)], "k string")
    assert sorted(r[0] for r in R.upsert(a, b, ["k"]).collect()) == ["x", "y", "z"]


def test_correlations_against_known_values(spark):
    rng = random.Random(3)
    rows = [(float(i), i * 0.5 + rng.gauss(0, 20), i % 2 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "x double, y double, f boolean")
    pdf = df.toPandas()
    matrix = {(r["row"], r["col"]): r for r in M.correlation_matrix(df, ["x", "y", "f"], ["f"]).collect()}
    assert matrix["x", "y"]["r"] == pytest.approx(pdf["x"].rank().corr(pdf["y"].rank()))
    assert matrix["x", "f"]["r"] == pytest.approx(pdf["x"].corr(pdf["f"].astype(int)))
    assert all(matrix[a, b]["r"] == matrix[b, a]["r"] and abs(matrix[a, b]["r"]) <= 1 for a, b in matrix)
    assert matrix["x", "x"]["label"] == "1.00"
    assert matrix["x", "y"]["label"].split("\n")[1:] == ["P < 0.001", "Strong"]


def test_dunn_adjustment(spark):
    rows = [("a", float(i)) for i in range(30)] + [("b", float(i) + 0.5) for i in range(30)] + [("c", float(i) + 60) for i in range(30)]
    got = {(r["g1"], r["g2"]): r for r in M.dunn_posthoc(spark.createDataFrame(rows, "g string, v double"), "v", "g").collect()}
    assert got["a", "b"]["p"] == 1.0 and got["a", "b"]["label"] == "NOT SIGNIFICANT"
    assert got["a", "c"]["p"] < 1e-6 and got["a", "c"]["z"] < 0


def test_replies_that_lack_everything(spark):
    df = spark.createDataFrame([("{}",), ("[]",), ('{"response": {}}',), ("no json",), (None,)], "body string")
    for flatten in (P.flatten_yandex, P.flatten_azure, P.flatten_nominatim, P.flatten_labels):
        rows = flatten(df).collect()
        assert all(r[S.STREET] is None and r[S.LATITUDE] is None for r in rows)


def test_model_finds_a_planted_signal_and_attributions_add_up(spark):
    rng = random.Random(11)
    rows = []
    for i in range(900):
        place, rooms = f"p{i % 4}", i % 5 + 1
        rows.append((i, place, rooms, float(i % 3), 100.0 * rooms + 300.0 * (i % 4) + rng.gauss(0, 10)))
    df = spark.createDataFrame(rows, "ID long, place string, rooms int, other double, price double")
    run = run_model(df, "ID", "price", ["place"], ["rooms", "other"], rounds=8, clusters=2)
    metrics = run.metrics.first()
    assert metrics["r2"] > 0.5 and metrics["n"] == run.predictions.count() == 180
    group = min(run.models)
    parts = explain_cluster(run, "ID", group, permutations=2)
    sums = {r[0]: r[1] for r in parts.groupBy("ID").agg(F.sum("attribution")).collect()}
    scored = {r[0]: r[1] for r in run.models[group].transform(run.predictions.where(F.col("Cluster") == group)).select("ID", "_pred").collect()}
    base = {round(scored[i] - sums[i], 6) for i in sums}
    assert sums.keys() == scored.keys()
    lowest, highest = min(r[4] for r in rows), max(r[4] for r in rows)
    assert all(lowest - 100 <= b <= highest + 100 for b in base)
    total = N.global_importance(parts).collect()
    assert {r["feature"] for r in total} == {"place", "rooms", "other"}


def test_unseen_cluster_has_no_prediction(spark):
    df = spark.createDataFrame([(1, 5)], "id int, `Cluster` int")
    assert N.predict_per_cluster(df, {}).first()["Predicted"] is None


def test_feature_labels():
    assert N.clean_feature_label("cat_Street_Abovyan", ["Street"]) == "Abovyan"
    assert N.clean_feature_label("num_Duration", ["Duration"]) == "num_Duration"


def test_counts_come_from_observations(spark):
    from pyspark.sql import Observation

    from rentloom.operators.quality import exclude_zero_rank, require_columns

    df = spark.createDataFrame([("a", 0.0), (" ", 1.0), (None, 2.0), ("b", 3.0)], "k string, r double")
    seen, zero = Observation(), Observation()
    assert require_columns(df, ["k"], seen).count() == 2
    assert seen.get == {"rows": 4, "excluded": 2}
    assert exclude_zero_rank(df, "r", zero).count() == 3
    assert zero.get == {"excluded": 1}


def test_misspelt_addresses_share_a_cluster(spark):
    from rentloom.operators.clusters import embed_and_cluster

    names = {"Abovyan Street, Kentron": 0, "Abovian Street, Kentron": 0, "Abovyan Stret, Kentron": 0,
             "Tigran Mets Avenue, Shengavit": 1, "Tigran Metz Avenue, Shengavit": 1, "Tigran Mets Avenu, Shengavit": 1}
    df = spark.createDataFrame(list(names), "string").withColumnRenamed("value", "address")
    found = {r["address"]: r["cluster"] for r in embed_and_cluster(df, 2, text="address").collect()}
    assert len({(names[a], c) for a, c in found.items()}) == 2


def test_city_by_coordinate_range(spark):
    from rentloom.operators.clusters import infer_city

    rows = [(1, "A", 40.0, 44.0), (2, "A", 40.4, 44.4), (3, "B", 40.1, 44.1), (4, "B", 40.2, 44.2), (5, None, 40.15, 44.15), (6, "", 40.3, 44.3), (7, None, 10.0, 10.0)]
    df = spark.createDataFrame(rows, "id int, `Town` string, `Latitude` double, `Longitude` double")
    assert {r["id"]: r["Town"] for r in infer_city(df).collect()} == {1: "A", 2: "A", 3: "B", 4: "B", 5: "B", 6: "A", 7: None}


def _rows_and_background(spark):
    rows = spark.createDataFrame([(i, float(i), float(i * i % 7)) for i in range(40)], "id long, a double, b double")
    back = spark.createDataFrame([(0, (1.0, 2.0))], "slot int, row struct<a: double, b: double>")
    return rows, back


def test_attributions_of_a_linear_score_are_exact(spark):
    rows, back = _rows_and_background(spark)
    parts = N.shapley_importance(rows, "id", ["a", "b"], lambda d: d.withColumn("_pred", 2 * F.col("a") + 3 * F.col("b")), back, 3)
    got = {(r["id"], r["feature"]): r["attribution"] for r in parts.collect()}
    for r in rows.collect():
        assert got[r["id"], "a"] == pytest.approx(2 * (r["a"] - 1.0))
        assert got[r["id"], "b"] == pytest.approx(3 * (r["b"] - 2.0))


def test_attributions_sum_to_the_difference_from_the_background(spark):
    rows, back = _rows_and_background(spark)
    parts = N.shapley_importance(rows, "id", ["a", "b"], lambda d: d.withColumn("_pred", F.col("a") * F.col("b") + 1), back, 5)
    got = {r[0]: r[1] for r in parts.groupBy("id").agg(F.sum("attribution")).collect()}
    for r in rows.collect():
        assert got[r["id"]] == pytest.approx(r["a"] * r["b"] - 2.0)


def test_background_is_bounded_and_stable(spark):
    df = spark.range(1000).withColumn("a", F.col("id") * 1.0)
    first = N.background_rows(df, "id", ["a"]).collect()
    again = N.background_rows(df.repartition(7), "id", ["a"]).collect()
    assert len(first) == N.BACKGROUND_ROWS and sorted(map(str, first)) == sorted(map(str, again))


def test_unknown_category_encodes_to_zeros(spark):
    from pyspark.ml.functions import vector_to_array

    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("b", 5.0)], "c string, x double")
    encoder = N.FeaturePipeline(["c"], ["x"]).fit(df)
    got = [r[0] for r in encoder.transform(spark.createDataFrame([("z", 3.0), ("b", 3.0)], "c string, x double")).select(vector_to_array("features")).collect()]
    assert got == [[0.0, 0.0, 0.0], [0.0, 1.0, 0.0]]
    assert encoder.names == ["a", "b", "x"]


def test_registered_models_use_the_defaults_and_explain_every_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from rentloom.cases import models
    rows = spark.createDataFrame([(i, float(i), i % 3) for i in range(30)], f"`{S.ROW_ID}` long, a double, Cluster int")
    pipeline = SimpleNamespace(categoricals=[], numerics=["a"], transform=lambda df: df)
    score = {g: SimpleNamespace(transform=lambda df, g=g: df.withColumn("_pred", (g + 1) * F.col("a"))) for g in range(3)}
    run = ModelRun(rows, None, score, pipeline, rows)
    calls, explained = [], []
    monkeypatch.setattr(models, "features", lambda spark, sf: None)
    monkeypatch.setattr(models, "run_model", lambda *args, **options: calls.append(options) or run)
    whole = modelling.shapley_importance
    monkeypatch.setattr(modelling, "shapley_importance", lambda *args: explained.append(args[5]) or whole(*args))
    got = models.shapley_importance(spark, "").collect()
    assert sorted((r.Cluster, r.feature) for r in got) == [(0, "a"), (1, "a"), (2, "a")] and all(r.mean_abs > 0 for r in got)
    assert calls == [{}] and explained == [4, 4, 4]
