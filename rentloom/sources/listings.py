"""Reading listing files and giving them one header and one row key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rentloom.functions.casts import (
    flag_default, number_or_zero, parse_date, text_or_blank, to_number, truthy,
)
from rentloom.operators.scale import dense_positions, scan_positions
from rentloom.schema import HEADERS, NA_TOKENS, NUMERIC_SHARE
from rentloom.sources.csv_splits import read_split_csv


def read_listings(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """CSV with a header; every column is text, missing-value words become NULL.

    Cells may hold line breaks; files are split all the same, at the cost of a
    second pass that finds which line breaks are inside quotes. Data known to
    have none can be read with ``multi_line=False`` in one pass.
    """
    raw = read_split_csv(spark, path) if multi_line else spark.read.csv(path, header=True, escape='"', encoding="UTF-8", inferSchema=False)
    return raw.select(*[F.when(~F.col(f"`{c}`").isin(NA_TOKENS), F.col(f"`{c}`")).alias(c) for c in raw.columns])


def rename_headers(df: DataFrame, headers: Mapping[str, str] = HEADERS) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in headers.items() if k in df.columns})


def align_by_position(df: DataFrame, like: DataFrame) -> DataFrame:
    """Take the other frame's names when the widths agree; else leave the frame alone."""
    return df.toDF(*like.columns) if len(df.columns) == len(like.columns) else df


def assign_row_key(df: DataFrame, prefix: str, order: str | None = None, name: str = "Index") -> DataFrame:
    """``A0, A1, ...`` by a numeric or time column, else by position in the files."""
    placed = dense_positions(df, order, name="_pos") if order else scan_positions(df, name="_pos")
    return placed.withColumn(name, F.concat(F.lit(prefix), F.col("_pos").cast("string"))).drop("_pos")


def stack(*frames: DataFrame) -> DataFrame:
    """Concatenate; columns a frame lacks are NULL there."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def numeric_shares(df: DataFrame, threshold: float = NUMERIC_SHARE, exempt: Sequence[str] = ()) -> DataFrame:
    """Share of rows that parse as a number, per column, from one aggregate pass."""
    scalar = ("string", "double", "float", "tinyint", "smallint", "int", "bigint")
    columns = [c for c, t in df.dtypes if c not in exempt and (t in scalar or t.startswith("decimal"))]
    shares = df.agg(*[F.avg(to_number(c).isNotNull().cast("double")).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("share")) for c in columns])
    out = shares.select(F.explode(pairs).alias("p")).select("p.column", "p.share")
    return out.withColumn("is_numeric", F.coalesce(F.col("share") > threshold, F.lit(False)))


def majority_types(df: DataFrame, threshold: float = NUMERIC_SHARE, exempt: Sequence[str] = ()) -> tuple[list, list]:
    """(numeric, text) column names; the driver sees one row per column."""
    rows = numeric_shares(df, threshold, exempt).collect()
    return [r["column"] for r in rows if r["is_numeric"]], [r["column"] for r in rows if not r["is_numeric"]]


def _replace(df: DataFrame, columns: Sequence[str], build) -> DataFrame:
    made: dict[str, Column] = {c: build(c) for c in columns}
    return df.withColumns(made) if made else df


def numeric_cast(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _replace(df, columns, number_or_zero)


def string_cast(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _replace(df, columns, text_or_blank)


def parse_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _replace(df, columns, parse_date)


def bool_default(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _replace(df, columns, flag_default)


def truthy_encode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _replace(df, columns, truthy)


def drop_pii(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def rank_defaults(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Absent rank columns and missing ranks are 0."""
    return df.withColumns({
        c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in columns})
