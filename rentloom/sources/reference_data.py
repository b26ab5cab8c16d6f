"""Exchange rates and the region hierarchy, both nested JSON documents."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def flatten_rates(documents: DataFrame, body: str = "value") -> DataFrame:
    """``date -> currency -> rate`` documents to rows (Date, Currency, USD)."""
    days = documents.select(F.explode(F.from_json(body, "map<string,map<string,double>>")).alias("day", "rates"))
    return days.select(F.to_date("day").alias("Date"), F.explode("rates").alias("Currency", "USD"))


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    return flatten_rates(spark.read.text(path, wholetext=True))


class Hierarchy(NamedTuple):
    """Three tables: provinces(province), units(unit, province), localities(locality, unit, province)."""

    provinces: DataFrame
    units: DataFrame
    localities: DataFrame


def flatten_hierarchy(documents: DataFrame, body: str = "value") -> Hierarchy:
    """A province holds either a list of districts or municipalities with their localities.

    A locality name under several units keeps all its rows.
    """
    top = documents.select(F.explode(F.from_json(body, "map<string,string>")).alias("province", "inner"))
    listed = top.where(F.col("inner").startswith("[")).select(
        F.explode(F.from_json("inner", "array<string>")).alias("unit"), "province")
    nested = top.where(F.col("inner").startswith("{")).select(
        "province", F.explode(F.from_json("inner", "map<string,map<string,string>>")).alias("unit", "places"))
    localities = nested.select(F.explode("places").alias("locality", "kind"), "unit", "province")
    units = listed.unionByName(nested.select("unit", "province")).distinct()
    return Hierarchy(top.select("province").distinct(), units, localities.select("locality", "unit", "province").distinct())


def read_hierarchy(spark: SparkSession, path: str) -> Hierarchy:
    return flatten_hierarchy(spark.read.text(path, wholetext=True))
