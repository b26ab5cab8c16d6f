"""Clusters, per-cluster gradient boosting and additive attributions with ``pyspark.ml``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentloom.operators.sampling import seeded_hash
from rentloom.session import checkpointed

BACKGROUND_ROWS = 100
LEAF_ROWS = 20
FIT_ROWS = 50_000  # weighted rows in a partition of a fit


@dataclass
class FeaturePipeline:
    """One-hot categoricals (an unknown value is all zeros) and numerics standardised by population deviation."""

    categoricals: Sequence[str]
    numerics: Sequence[str]
    output: str = "features"

    def fit(self, df: DataFrame) -> FeaturePipeline:
        clean = self._clean(df)
        # The indexer's extra last slot takes unknown values and the encoder drops the last slot.
        self._indexer = StringIndexer(
            inputCols=list(self.categoricals), outputCols=[f"_i_{i}" for i in range(len(self.categoricals))],
            handleInvalid="keep", stringOrderType="alphabetAsc").fit(clean)
        self._encoder = OneHotEncoder(
            inputCols=self._indexer.getOutputCols(), outputCols=[f"_h_{i}" for i in range(len(self.categoricals))],
            dropLast=True).fit(self._indexer.transform(clean))
        row = clean.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(self.numerics)],
                        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(self.numerics)]).first()
        self._scale = [(row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i in range(len(self.numerics))]
        self.names = [label for labels in self._indexer.labelsArray for label in labels] + list(self.numerics)
        return self

    def _clean(self, df: DataFrame) -> DataFrame:
        text = {c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in self.categoricals}
        return df.withColumns({**text, **{c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in self.numerics}})

    def transform(self, df: DataFrame) -> DataFrame:
        out = self._encoder.transform(self._indexer.transform(self._clean(df)))
        scaled = {f"_z_{i}": (F.col(f"`{c}`") - m) / s for i, (c, (m, s)) in enumerate(zip(self.numerics, self._scale))}
        out = out.withColumns(scaled) if scaled else out
        parts = [*self._encoder.getOutputCols(), *scaled]
        out = VectorAssembler(inputCols=parts, outputCol=self.output).transform(out)
        return out.drop(*self._indexer.getOutputCols(), *self._encoder.getOutputCols(), *scaled)


def pca_reduce(df: DataFrame, features: str = "features", k: int = 3, output: str = "components") -> DataFrame:
    """Centred principal-component scores. Sparse input stays sparse: only the k scores are centred."""
    raw = PCA(k=k, inputCol=features, outputCol="_raw").fit(df).transform(df)
    centred = StandardScaler(inputCol="_raw", outputCol=output, withMean=True, withStd=False).fit(raw).transform(raw)
    return centred.drop("_raw")


def explained_variance(df: DataFrame, features: str = "features", line: float = 0.95) -> DataFrame:
    """(component, ratio, cumulative, above_line) for every component."""
    width = df.select(F.size(vector_to_array(features)).alias("w")).first()["w"]
    ratios = PCA(k=width, inputCol=features, outputCol="_raw").fit(df).explainedVariance.toArray()
    rows, total = [], 0.0
    for i, ratio in enumerate(ratios, 1):
        total += float(ratio)
        rows.append((i, float(ratio), total, total >= line))
    return df.sparkSession.createDataFrame(rows, "component int, ratio double, cumulative double, above_line boolean")


def cluster(df: DataFrame, features: str = "components", k: int = 3, seed: int = 42, output: str = "Cluster") -> DataFrame:
    return KMeans(k=k, seed=seed, featuresCol=features, predictionCol=output).fit(df).transform(df)


def _weighted_rows(df: DataFrame, group: str, features: str, label: str) -> DataFrame:
    """One row per group and feature vector: the mean label and the number of rows ``_n``.

    Squared error sees rows with equal features as their mean, so a booster
    splits and predicts as on all rows. A missing label stays missing.
    """
    whole = F.count(label) == F.count(F.lit(1))
    return df.where(F.col(group).isNotNull()).groupBy(group, features).agg(
        F.when(whole, F.avg(label)).alias(label), F.count(F.lit(1)).cast("double").alias("_n"))


def fit_per_cluster(train: DataFrame, label: str, group: str = "Cluster", features: str = "features",
                    rounds: int = 200, rate: float = 0.1, seed: int = 42) -> dict:
    """One boosted model per cluster label. Each fit is distributed; the few labels are fitted side by side.

    Rows with equal features are fitted as one weighted row, and the least 20
    rows of a leaf are a share of the weight. A fit makes ``rounds`` times six
    small jobs, so a cluster has no more partitions than its share of the cores
    unless these would hold over FIT_ROWS rows.
    """
    spark = train.sparkSession
    weighted = checkpointed(_weighted_rows(train, group, features, label))
    sizes = {r[0]: r for r in weighted.groupBy(group).agg(F.sum("_n"), F.count(F.lit(1))).collect()}
    share = max(1, spark.sparkContext.defaultParallelism // max(1, len(sizes)))

    def fit(g):
        _, total, distinct = sizes[g]
        booster = GBTRegressor(
            featuresCol=features, labelCol=label, weightCol="_n", predictionCol="_pred", maxIter=rounds, stepSize=rate, maxBins=255,
            # Half a row less, as a share, takes exactly the leaves of LEAF_ROWS rows and more; two of them need twice the rows.
            minWeightFractionPerNode=min(0.49, (LEAF_ROWS - 0.5) / total), maxDepth=5 if total >= 2 * LEAF_ROWS else 0,
            seed=seed, checkpointInterval=10)
        return booster.fit(weighted.where(F.col(group) == g).coalesce(max(share, -(-distinct // FIT_ROWS))))

    with ThreadPoolExecutor(max_workers=min(8, max(1, len(sizes)))) as pool:
        return dict(zip(sorted(sizes), pool.map(inheritable_thread_target(spark)(fit), sorted(sizes))))


def predict_per_cluster(df: DataFrame, models: Mapping, group: str = "Cluster", output: str = "Predicted") -> DataFrame:
    """Every row scored by its cluster's model, two decimals; a cluster without a model gives NULL."""
    known = list(models)
    rest = df.where(F.col(group).isNull() | ~F.col(group).isin(known)) if known else df
    parts = [m.transform(df.where(F.col(group) == g)).withColumn(output, F.round("_pred", 2)).drop("_pred") for g, m in models.items()]
    parts.append(rest.withColumn(output, F.lit(None).cast("double")))
    return reduce(DataFrame.unionByName, parts)


def evaluate(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """One row (n, mae, rmse, r2, mape) over the rows that have both."""
    both = df.select(F.col(predicted).alias("p"), F.col(actual).alias("a")).dropna()
    e = F.col("a") - F.col("p")
    n = F.count(F.lit(1))
    return both.agg(
        n.alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.sum(e * e) / F.nullif(F.var_pop("a") * n, F.lit(0.0))).alias("r2"),
        (F.avg(F.abs(e) / F.nullif(F.col("a"), F.lit(0.0))) * 100).alias("mape"))


def add_error(df: DataFrame, predicted: str = "Predicted", actual: str = "Actual", name: str = "Error") -> DataFrame:
    return df.withColumn(name, F.round(F.col(actual) - F.col(predicted), 2))


def background_rows(df: DataFrame, row_id: str, columns: Sequence[str], size: int = BACKGROUND_ROWS, seed: int = 42) -> DataFrame:
    """At most ``size`` rows by lowest hash, numbered from 0."""
    chosen = df.select(*columns, seeded_hash(row_id, seed).alias("_h"), F.col(row_id).alias("_id")).orderBy("_h", "_id").limit(size)
    packed = chosen.agg(F.sort_array(F.collect_list(F.struct("_h", "_id", F.struct(*columns).alias("row")))).alias("all"))
    return packed.select(F.posexplode("all").alias("slot", "x")).select("slot", "x.row")


def shapley_importance(df: DataFrame, row_id: str, columns: Sequence[str], score, background: DataFrame,
                       permutations: int = 4, seed: int = 42) -> DataFrame:
    """(row id, feature, attribution): permutation Shapley values, features grouped by source column.

    Each row walks ``permutations`` seeded orders of the columns from a
    background row to itself; every step is one row to score. Scoring walks all
    trees of a model, so different steps with equal cells are scored once:
    ``score(df) -> df with _pred`` sees every mix of cells once, and the steps
    look their mix up. The attributions of a row sum to its prediction minus the
    mean prediction of its background rows. ``background`` has at most
    BACKGROUND_ROWS rows.
    """
    columns = list(columns)
    background = F.broadcast(checkpointed(background))
    size = F.coalesce(background.agg(F.count(F.lit(1)).alias("n")).scalar(), F.lit(1))
    rows = df.select(F.col(row_id), F.struct(*columns).alias("_own"), F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("_p"))
    rows = rows.withColumn("slot", F.pmod(F.xxhash64(row_id, "_p", F.lit(seed)), size).cast("int")).join(background, "slot")
    order = F.transform(
        F.sort_array(F.array(*[F.struct(F.xxhash64(row_id, "_p", F.lit(seed + 1), F.lit(c)).alias("h"), F.lit(c).alias("c")) for c in columns])),
        lambda x: x["c"])
    steps = rows.withColumn("_order", order).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(len(columns)))))
    swapped = F.slice("_order", 1, F.col("_k"))
    mixed = [F.when(F.array_contains(swapped, c), F.col(f"_own.`{c}`")).otherwise(F.col(f"row.`{c}`")).alias(c) for c in columns]
    steps = steps.select(row_id, "_p", "_k", F.struct(*mixed).alias("_mix"))
    # Structs are equal, too, where both have the same missing cells.
    scored = score(steps.select("_mix").distinct().select("_mix", "_mix.*")).select("_mix", "_pred")
    scored = steps.join(scored, "_mix").select(row_id, "_p", "_k", "_pred")
    # Dealt by the row alone, both aggregates find their rows in place; the order of a walk is made again, not shuffled.
    walk = scored.repartition(row_id).groupBy(row_id, "_p").agg(F.sort_array(F.collect_list(F.struct("_k", "_pred"))).alias("w"))
    walk = walk.withColumn("_order", order)
    gains = F.transform("_order", lambda c, i: F.struct(c.alias("feature"), (F.col("w")[i + 1]["_pred"] - F.col("w")[i]["_pred"]).alias("gain")))
    return walk.select(row_id, F.explode(gains).alias("g")).groupBy(row_id, F.col("g.feature").alias("feature")).agg(
        F.avg("g.gain").alias("attribution"))


def global_importance(attributions: DataFrame, *groups: str) -> DataFrame:
    return attributions.groupBy(*groups, "feature").agg(F.avg(F.abs("attribution")).alias("mean_abs"))


def clean_feature_label(name: str, columns: Sequence[str]) -> str:
    """``cat_Street_Abovyan`` to ``Abovyan``; other names stay."""
    bare = name.split("_", 1)[1] if name.startswith(("cat_", "num_")) else name
    for column in columns:
        if bare.startswith(column + "_") and len(bare) > len(column) + 1:
            return bare[len(column) + 1:]
    return name


def cluster_points(df: DataFrame, row_id: str, features: str = "components", group: str = "Cluster") -> DataFrame:
    xy = vector_to_array(features)
    return df.select(row_id, group, xy[0].alias("x"), xy[1].alias("y"))


def error_points(df: DataFrame, row_id: str, predicted: str = "Predicted", actual: str = "Actual") -> DataFrame:
    return df.select(row_id, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).dropna()
