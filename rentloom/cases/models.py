"""Clusters, boosted models and attributions over the given tables."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentloom import schema as S
from rentloom.cases.registry import case
from rentloom.cases.tables import LISTING, listings, table
from rentloom.functions.casts import flag_equals
from rentloom.operators import clusters as C
from rentloom.operators import model as N
from rentloom.plans.modelling import explain_clusters, run_model

CATEGORICALS = [S.UNIT, S.CONSTRUCTION, S.STREET]
NUMERICS = ["Monthly", S.ROOMS, S.FLOOR_AREA]


def features(spark, sf) -> DataFrame:
    """Listings with the model columns and a target that follows area, rooms and duration."""
    v = listings(spark, sf).withColumn("Monthly", flag_equals(S.DURATION, "Monthly").cast("double"))
    target = 200 + 4 * F.col(S.FLOOR_AREA) + 60 * F.col(S.ROOMS) + 150 * F.col("Monthly") + F.col(S.PRICE) / 5000
    return v.withColumn(S.MONTHLY_USD_PRICE, target)


def _run(spark, sf):
    return run_model(features(spark, sf), S.ROW_ID, S.MONTHLY_USD_PRICE, CATEGORICALS, NUMERICS)


@case("feature_vectors", f"""
WITH {LISTING}, t AS (SELECT id, (duration = 'Monthly')::INTEGER::DOUBLE AS a, rooms::DOUBLE AS b, area AS c FROM listing)
SELECT id, round((a - avg(a) OVER ()) / stddev_pop(a) OVER (), 6) AS monthly, round((b - avg(b) OVER ()) / stddev_pop(b) OVER (), 6) AS rooms,
       round((c - avg(c) OVER ()) / stddev_pop(c) OVER (), 6) AS area, CAST(3 AS DOUBLE) AS hot FROM t""")
def feature_vectors(spark, sf):
    df = features(spark, sf)
    pipeline = N.FeaturePipeline(CATEGORICALS, NUMERICS).fit(df)
    cells = pipeline.transform(df).select(F.col(S.ROW_ID).alias("id"), vector_to_array("features").alias("v"))
    size = F.size("v")
    hot = F.aggregate(F.slice("v", F.lit(1), size - 3), F.lit(0.0), lambda a, x: a + x)
    named = [F.round(F.element_at("v", -k), 6).alias(n) for k, n in ((3, "monthly"), (2, "rooms"), (1, "area"))]
    return cells.select("id", *named, hot.alias("hot"))


@case("pca_reduce")
def pca_reduce(spark, sf):
    df = features(spark, sf)
    out = N.pca_reduce(N.FeaturePipeline(CATEGORICALS, NUMERICS).fit(df).transform(df))
    xyz = vector_to_array("components")
    return out.select(F.col(S.ROW_ID).alias("id"), *[xyz[i].alias(f"pc{i + 1}") for i in range(3)])


@case("explained_variance")
def explained_variance(spark, sf):
    df = features(spark, sf)
    return N.explained_variance(N.FeaturePipeline(CATEGORICALS, NUMERICS).fit(df).transform(df))


@case("cluster_listings")
def cluster_listings(spark, sf):
    df = features(spark, sf)
    out = N.cluster(N.pca_reduce(N.FeaturePipeline(CATEGORICALS, NUMERICS).fit(df).transform(df)))
    return N.cluster_points(out, S.ROW_ID)


@case("fit_predict_per_cluster")
def fit_predict_per_cluster(spark, sf):
    return N.error_points(_run(spark, sf).predictions, S.ROW_ID)


@case("model_metrics")
def model_metrics(spark, sf):
    return _run(spark, sf).metrics


@case("shapley_importance")
def shapley_importance(spark, sf):
    return N.global_importance(explain_clusters(_run(spark, sf), S.ROW_ID), "Cluster")


@case("cluster_embeddings", "SELECT count(*) AS rows, 10::BIGINT AS clusters FROM embeddings")
def cluster_embeddings(spark, sf):
    out = C.embed_and_cluster(table(spark, sf, "embeddings"), 10, vector="embedding")
    return out.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("cluster").alias("clusters"))


@case("cluster_addresses")
def cluster_addresses(spark, sf):
    names = listings(spark, sf).select(F.concat_ws(", ", S.STREET, S.UNIT).alias("address")).distinct()
    return C.embed_and_cluster(names, 25, text="address").select("address", "cluster")
