"""Boosting and attributions see equal rows once and give what all rows give."""

from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from rentloom.operators import model as N


def test_equal_rows_are_fitted_once_with_the_result_of_all_rows(spark, monkeypatch):
    cells = [(float(i % 3), float(i % 5), 10.0 * (i % 3) + (i % 5) + (i % 7) / 10) for i in range(420)]
    rows = [(0, Vectors.dense(a, b), y) for a, b, y in cells] + [(1, Vectors.dense(1.0, 1.0), float(i)) for i in range(9)]
    train = spark.createDataFrame(rows, ["Cluster", "features", "y"]).repartition(3)
    seen = []
    fit = GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, df: seen.append(df.count()) or fit(self, df))
    models = N.fit_per_cluster(train, "y", rounds=3)
    assert sorted(seen) == [1, 15]
    plain = GBTRegressor(labelCol="y", predictionCol="_pred", maxIter=3, maxBins=255, minInstancesPerNode=20, seed=42)
    for g in (0, 1):
        part = train.where(F.col("Cluster") == g)
        want = {tuple(r.features): r._pred for r in fit(plain, part).transform(part).collect()}
        got = {tuple(r.features): r._pred for r in models[g].transform(part).collect()}
        assert want.keys() == got.keys() and all(abs(want[k] - got[k]) < 1e-9 for k in want)


def test_leaves_of_just_20_rows_stay_allowed(spark):
    rows = [(0, Vectors.dense(float(i >= 20)), float(i >= 20)) for i in range(40)]
    model = N.fit_per_cluster(spark.createDataFrame(rows, ["Cluster", "features", "y"]), "y", rounds=1)[0]
    assert model.trees[0].numNodes == 3
    model = N.fit_per_cluster(spark.createDataFrame(rows[1:], ["Cluster", "features", "y"]), "y", rounds=1)[0]
    assert model.trees[0].numNodes == 1


def test_every_mix_of_cells_is_scored_once(spark):
    rows = spark.createDataFrame([(i, float(i % 2), None if i % 3 else "x") for i in range(60)], "id long, a double, b string")
    background = N.background_rows(rows.where("id < 2"), "id", ["a", "b"])
    sizes = []

    def score(df):
        sizes.append((df.count(), df.select("a", "b").distinct().count()))
        return df.withColumn("_pred", 3 * F.col("a") + F.length(F.coalesce("b", F.lit(""))))

    got = {(r.id, r.feature): r.attribution for r in N.shapley_importance(rows, "id", ["a", "b"], score, background).collect()}
    assert len(got) == 120 and all(n == distinct <= 4 for n, distinct in sizes)
    # Background rows are (0, x) and (1, missing).
    for i in range(60):
        whole = got[i, "a"] + got[i, "b"]
        assert any(abs(whole - (3 * (i % 2) + (i % 3 == 0) - base)) < 1e-9 for base in (1, 1.5, 2, 2.5, 3))
