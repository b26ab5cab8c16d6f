"""Group figures and price changes."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentloom.functions.casts import blank
from rentloom.operators.scale import dense_positions, exact_quantiles, skew_join
from rentloom.session import checkpointed


def group_price_stats(df: DataFrame, keys: Sequence[str], value: str, method: str = "mean") -> DataFrame:
    """Centre, sample deviation and count of the non-missing values per group."""
    keys = list(keys)
    stats = df.groupBy(*keys).agg(
        F.avg(value).alias("centre"), F.stddev_samp(value).alias("std"), F.count(value).alias("count"))
    if method == "mean":
        return stats
    medians = exact_quantiles(df, value, [0.5], keys).select(*keys, F.col("q0").alias("_m"))
    return stats.join(medians, keys, "left").withColumn("centre", F.col("_m")).drop("_m")


def change(first: Column, last: Column, method: str) -> Column:
    if method == "absolute":
        return last - first
    if method == "percent":
        return F.when(first != 0, (last - first) / first)
    if method == "log":
        return F.when((first > 0) & (last > 0), F.ln(last / first))
    raise ValueError(f"unknown change method: {method}")


def order_key(df: DataFrame, order: Sequence[str]) -> Column:
    """One comparable value for a date or time and a whole-number tie-break.

    A decimal of fixed width can be updated in place, so the aggregate over it
    hashes; over a struct it would have to sort all rows first. Other column
    types fall back to the struct.
    """
    kinds = [dict(df.dtypes)[c] for c in order]
    whole = ("tinyint", "smallint", "int")
    if len(order) != 2 or kinds[1] not in (*whole, "bigint") or kinds[0] not in (*whole, "date", "timestamp"):
        return F.struct(*[F.col(f"`{c}`") for c in order])
    first, second = F.col(f"`{order[0]}`"), F.col(f"`{order[1]}`")
    if kinds[0] == "date":
        first = F.unix_date(first)
    elif kinds[0] == "timestamp":
        first = F.unix_micros(first)
    # Steps of 2 * 10^19 leave room for every 64-bit tie-break.
    return first.cast("decimal(18,0)") * F.lit(Decimal(20_000_000_000_000_000_000)) + second.cast("decimal(19,0)")


def first_last_change(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str],
                      method: str = "percent", min_series: int = 2) -> DataFrame:
    """Chronological first against last value per group, in one combining aggregate.

    ``order`` is the date and then the row id, so ties have one answer. Groups
    with under ``min_series`` rows are left out; 1 keeps them with change 0.
    """
    when = order_key(df, order)
    ends = df.groupBy(*keys).agg(
        F.min_by(value, when).alias("_first"), F.max_by(value, when).alias("_last"), F.count(F.lit(1)).alias("_n"))
    return ends.where(F.col("_n") >= min_series).select(
        *keys, change(F.col("_first"), F.col("_last"), method).alias("change"))


def rollup_changes(changes: DataFrame, keys: Sequence[str], value: str = "change") -> DataFrame:
    """Mean, deviation and count of the lower-level changes per parent group."""
    return changes.groupBy(*keys).agg(
        F.avg(value).alias("centre"), F.stddev_samp(value).alias("std"), F.count(value).alias("count"))


def first_non_blank(df: DataFrame, keys: Sequence[str], column: str, row_id: str) -> DataFrame:
    """The value of the lowest row id that has one."""
    has = ~blank(column)
    return df.groupBy(*keys).agg(F.min_by(F.col(f"`{column}`"), F.when(has, F.col(row_id))).alias("first_value"))


def group_sizes(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def group_count_column(df: DataFrame, keys: Sequence[str], name: str = "Count", counted: str | None = None) -> DataFrame:
    """The group's count on every row: a small aggregate joined back, not a window over the group.

    The groups meet on a struct of the keys, in which nulls are values like any other.
    """
    count = F.count(counted) if counted else F.count(F.lit(1))
    tagged = df.withColumn("_group", F.struct(*keys))
    sizes = checkpointed(tagged.groupBy("_group").agg(count.alias(name)))
    return skew_join(tagged, sizes, ["_group"], "inner").drop("_group")


def min_group_size(df: DataFrame, keys: Sequence[str], minimum: int) -> DataFrame:
    """Only the rows of groups with at least ``minimum`` rows."""
    large = checkpointed(group_sizes(df, keys).where(F.col("n") >= minimum).select(*keys))
    return skew_join(df, large, keys, "inner")


def order_categories(df: DataFrame, column: str, value: str) -> DataFrame:
    """(category, median, sort_key), sort_key counting up from 1 by median, then name."""
    medians = checkpointed(exact_quantiles(df, value, [0.5], [column]).select(column, F.col("q0").alias("median")))
    placed = dense_positions(medians, "median", tie=[column], name="sort_key")
    return placed.withColumn("sort_key", F.col("sort_key") + 1)


def distinct_values(df: DataFrame, columns: Sequence[str], name: str = "value") -> DataFrame:
    """Trimmed, non-blank distinct values over several columns."""
    stacked = df.select(F.explode(F.array(*[F.trim(F.col(f"`{c}`").cast("string")) for c in columns])).alias(name))
    return stacked.where(~blank(name)).distinct()


def parent_child_pairs(df: DataFrame, child: str, parent: str) -> DataFrame:
    """Distinct (name, province) with both parts set."""
    return df.where(~blank(child) & ~blank(parent)).select(
        F.trim(f"`{child}`").alias("name"), F.trim(f"`{parent}`").alias("province")).distinct()


def orphan_children(df: DataFrame, child: str, parent: str) -> DataFrame:
    """Children that never occur with a parent."""
    best = F.max(F.when(~blank(parent), F.trim(f"`{parent}`"))).alias("_p")
    return df.where(~blank(child)).groupBy(F.trim(f"`{child}`").alias("name")).agg(best).where("_p is null").select("name")


def missing_by_group(df: DataFrame, value: str, group: str) -> DataFrame:
    return df.where(F.col(value).isNull()).groupBy(group).agg(F.count(F.lit(1)).alias("missing"))
