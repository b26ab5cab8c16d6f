"""Coordinates, cities and address clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentloom import schema as S
from rentloom.functions.casts import blank, filled
from rentloom.operators.aggregates import first_last_change, rollup_changes
from rentloom.operators.model import evaluate
from rentloom.operators.scale import exact_quantiles, skew_join
from rentloom.session import checkpointed


def fill_coordinates(df: DataFrame, street: str = S.STREET, town: str = S.TOWN, lat: str = S.LATITUDE, lon: str = S.LONGITUDE) -> DataFrame:
    """Missing coordinates take the median of the same street in the same town."""
    placed = df.where(~blank(street) & ~blank(town))
    out = df
    for column, name in ((lat, "_lat"), (lon, "_lon")):
        medians = exact_quantiles(placed, column, [0.5], [town, street]).select(town, street, F.col("q0").alias(name))
        out = skew_join(out, checkpointed(medians), [town, street])
    return out.withColumns({lat: F.coalesce(F.col(lat), F.col("_lat")), lon: F.coalesce(F.col(lon), F.col("_lon"))}).drop("_lat", "_lon")


LEVELS = 40                 # cells of level k are WORLD / 2**k degrees wide
WORLD = 512.0


def _box_level(height: Column, width: Column) -> Column:
    """The finest level whose cells are no smaller than the box, so that it lies in at most four of them."""
    extent = F.greatest(height, width)
    level = F.floor(F.log2(F.lit(WORLD) / F.greatest(extent, F.lit(WORLD / 2 ** LEVELS))))
    exact = level - F.when(WORLD / F.pow(F.lit(2.0), level) < extent, 1).otherwise(0)      # the logarithm may round up
    return F.least(exact, F.lit(LEVELS)).cast("int")


def _cell(c: str | Column, level: Column) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) * F.pow(F.lit(2.0), level) / WORLD)


def city_boxes(df: DataFrame, town: str = S.TOWN, lat: str = S.LATITUDE, lon: str = S.LONGITUDE) -> DataFrame:
    """Coordinate range of every town, once per cell: at most four rows a town, however wide it is."""
    ranges = df.where(~blank(town)).groupBy(F.col(town).alias("_town")).agg(
        F.min(lat).alias("a0"), F.max(lat).alias("a1"), F.min(lon).alias("o0"), F.max(lon).alias("o1")).dropna()
    area = ((F.col("a1") - F.col("a0")) * (F.col("o1") - F.col("o0"))).alias("area")
    level = _box_level(F.col("a1") - F.col("a0"), F.col("o1") - F.col("o0")).alias("_level")

    def cells(low: str, high: str) -> Column:
        return F.explode(F.sequence(_cell(low, F.col("_level")), _cell(high, F.col("_level"))))

    return ranges.select("*", area, level).select("*", cells("a0", "a1").alias("_cy")).select("*", cells("o0", "o1").alias("_cx"))


def infer_city(df: DataFrame, town: str = S.TOWN, lat: str = S.LATITUDE, lon: str = S.LONGITUDE) -> DataFrame:
    """A missing town is the one whose coordinate range holds the point; the smallest range, then the name, decides.

    Every range is kept at the level of cells that are about its size; the
    points in question, each coordinate once, are looked up at every level in
    use, which makes the range test an equi join on the cell. The best range of
    a point is an aggregate, so no list of ranges is built anywhere.
    """
    boxes = checkpointed(city_boxes(df, town, lat, lon))
    used = boxes.agg(F.collect_set("_level").alias("levels"))
    points = df.where(blank(town)).select(F.col(lat).alias("_y"), F.col(lon).alias("_x")).dropna().distinct()
    levels = F.coalesce(used.scalar(), F.array().cast("array<int>"))
    asked = points.select("_y", "_x", F.explode(levels).alias("_level"))
    asked = asked.withColumns({"_cy": _cell("_y", F.col("_level")), "_cx": _cell("_x", F.col("_level"))})
    met = asked.join(boxes, ["_level", "_cy", "_cx"]).where(F.col("_y").between(F.col("a0"), F.col("a1")) & F.col("_x").between(F.col("o0"), F.col("o1")))
    found = met.groupBy(F.col("_y").alias(lat), F.col("_x").alias(lon)).agg(F.min(F.struct("area", "_town"))["_town"].alias("_found"))
    out = skew_join(df, checkpointed(found), [lat, lon])
    return out.withColumn(town, F.coalesce(filled(town), F.when(blank(town), F.col("_found")))).select(*df.columns)


def simplified_address(street: str = S.STREET, area: str = S.NEIGHBOURHOOD, town: str = S.TOWN) -> Column:
    """Street, or else neighbourhood, and the town; building, block and number are left out."""
    return F.concat_ws(", ", F.coalesce(filled(street), filled(area)), filled(town))


def embed_text(df: DataFrame, text: str, dimensions: int = 256, gram: int = 3, output: str = "vector") -> DataFrame:
    """Unit vector of hashed character n-grams, so that misspelt variants lie close together."""
    padded = F.concat(F.lit(" "), F.lower(F.col(text)), F.lit(" "))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - gram + 1))
    grams = F.transform(starts, lambda i: F.substring(padded, i, F.lit(gram)))
    hashed = HashingTF(numFeatures=dimensions, inputCol="_grams", outputCol="_tf").transform(df.withColumn("_grams", grams))
    return Normalizer(inputCol="_tf", outputCol=output).transform(hashed).drop("_grams", "_tf")


def embed_and_cluster(df: DataFrame, k: int, text: str | None = None, vector: str | None = None, seed: int = 42,
                      output: str = "cluster") -> DataFrame:
    """Cluster number per row, from supplied vectors or from the text's n-grams."""
    if vector is not None:
        source = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    else:
        source = embed_text(df, text, output="_v")
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol=output).fit(source)
    return model.transform(source).drop("_v")


def cluster_change_table(df: DataFrame, cluster: str, unit: str, value: str, order: Sequence[str], method: str = "percent") -> DataFrame:
    """Mean first-to-last change of the units of every cluster."""
    changes = first_last_change(df, [cluster, unit], value, order, method)
    return rollup_changes(changes, [cluster])


def cluster_change_predictor(train: DataFrame, test: DataFrame, cluster: str, unit: str, value: str,
                             order: Sequence[str], method: str = "percent") -> DataFrame:
    """(cluster, predicted, actual): the training mean change of a cluster against its test mean change."""
    predicted = cluster_change_table(train, cluster, unit, value, order, method).select(cluster, F.col("centre").alias("predicted"))
    actual = cluster_change_table(test, cluster, unit, value, order, method).select(cluster, F.col("centre").alias("actual"))
    return actual.join(predicted, cluster, "left")


def score_change_predictor(table: DataFrame) -> DataFrame:
    return evaluate(table, "predicted", "actual")
