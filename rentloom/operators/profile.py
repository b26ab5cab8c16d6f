"""Price profiles by place, time and distance, and the tables behind the charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentloom import schema as S
from rentloom.functions.geo import boxes_at, distance_km, place_label
from rentloom.operators.aggregates import (
    first_last_change, group_count_column, group_price_stats, order_categories, rollup_changes,
)
from rentloom.operators.joins import attach_group_stats
from rentloom.operators.quality import require_columns
from rentloom.operators.sampling import sample_per_group
from rentloom.operators.scale import skew_join
from rentloom.session import checkpointed

POINT_METHODS = ("mean", "median")


def add_distance(df: DataFrame, lat: str = S.LATITUDE, lon: str = S.LONGITUDE, name: str = S.DISTANCE) -> DataFrame:
    return df.withColumn(name, distance_km(lat, lon))


def add_place(df: DataFrame, province: str = S.PROVINCE, unit: str = S.UNIT, name: str = S.PLACE) -> DataFrame:
    return df.withColumn(name, place_label(province, unit))


def density_grid(df: DataFrame, lat: str, lon: str, weight: str, cell: float = 0.01) -> DataFrame:
    """Weight and number of points per square cell; rows with an unreadable part fall out."""
    parts = df.select(*[F.col(f"`{c}`").try_cast("double").alias(n) for c, n in ((lat, "lat"), (lon, "lon"), (weight, "w"))]).dropna()
    cells = [F.floor(F.col(c) / cell).alias(f"{c}_cell") for c in ("lat", "lon")]
    return parts.groupBy(*cells).agg(F.sum("w").alias("weight"), F.count(F.lit(1)).alias("points"))


def within_bbox(df: DataFrame, lat: str, lon: str, boxes: dict = S.COUNTRY_BOXES) -> DataFrame:
    """One row per (row, box holding it); rows outside all boxes fall out."""
    return df.withColumn("box", F.explode(boxes_at(lat, lon, boxes)))


def price_profile(
    df: DataFrame,
    keys: Sequence[str],
    row_id: str,
    method: str | None = None,
    minimum: int = 0,
    maximum: int | None = None,
    by_distance: bool = False,
    price: str = S.MONTHLY_USD_PRICE,
    date: str = S.DATE,
    street: str = S.STREET,
    min_series: int = 2,
) -> tuple[DataFrame, str]:
    """The rows of a profile chart with group figures and ``sort_key``, and the name of its x column.

    Steps: rows complete in the keys; group figures, either of the prices or of
    the street-level changes; group size limits; place label or distance; order
    of the x values by their median. Percent changes and their deviation are
    both scaled to percent.
    """
    keys = list(keys)
    df = require_columns(df, keys + ([street] if method == "percent" else []))
    if method:
        if method in POINT_METHODS:
            stats = group_price_stats(df, keys, price, method)
        else:
            changes = first_last_change(df, list(dict.fromkeys([*keys, street])), price, [date, row_id], method, min_series)
            stats = rollup_changes(changes, keys)
        scale = 100.0 if method == "percent" else 1.0
        stats = stats.select(
            *keys, (F.col("centre") * scale).alias(S.PRICE_CHANGE), (F.col("std") * scale).alias("StdDev"), F.col("count").alias("Count"))
        df = attach_group_stats(df, stats, keys, [S.PRICE_CHANGE, "StdDev", "Count"])
    if minimum or maximum:
        df = sample_per_group(df, keys, row_id, minimum, maximum)
        df = group_count_column(df.drop("Count"), keys, "Count", counted=price)
    x = keys[0]
    if set(keys) == {S.PROVINCE, S.UNIT}:
        df = add_place(df)
        x = S.PLACE
    if by_distance:
        df = add_distance(df)
        x = S.DISTANCE
    order = checkpointed(order_categories(df, x, S.PRICE_CHANGE if method else price))
    return skew_join(df, order.select(x, "sort_key"), [x], "inner"), x


def value_label(method: str | None) -> str:
    """The name of the profile's value axis."""
    return S.VALUE_LABELS[method]


def bar_rows(profile: DataFrame, x: str, method: str | None, price: str = S.MONTHLY_USD_PRICE) -> DataFrame:
    """The bars: distinct (x, centre, deviation, count), or the plain points without a method."""
    if method is None:
        return profile.select(x, price)
    return profile.select(x, F.col(S.PRICE_CHANGE).alias("mean_price"), F.col("StdDev").alias("std_price"), "Count").distinct()
