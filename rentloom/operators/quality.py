"""Row rules, the exclusion ledger, trimming and duplicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentloom import schema as S
from rentloom.functions.casts import blank, to_number
from rentloom.functions.text import normalize_text
from rentloom.operators.scale import exact_quantiles, skew_join
from rentloom.session import checkpointed


def normalize_text_columns(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    made = {c: normalize_text(c) for c, t in df.dtypes if t == "string" and c not in exclude}
    return df.withColumns(made) if made else df


def fill_category_default(df: DataFrame, column: str, value: str = "") -> DataFrame:
    return df.withColumn(column, F.when(blank(column), F.lit(value)).otherwise(F.col(f"`{column}`")))


def missing_any(columns: Sequence[str]) -> Column:
    return reduce(or_, [blank(c) for c in columns], F.lit(False))


def require_columns(df: DataFrame, columns: Sequence[str], watch=None) -> DataFrame:
    """Drop rows lacking any of the columns; ``watch`` is an Observation for the two counts."""
    gone = missing_any(columns)
    if watch is not None:
        df = df.observe(watch, F.count(F.lit(1)).alias("rows"), F.count_if(gone).alias("excluded"))
    return df.where(~gone)


def missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(missing_any(columns)).alias("excluded"))


def key_field_rules(date: str = S.DATE, address: str = S.ADDRESS, price: str = S.PRICE) -> dict[str, Column]:
    """The required fields, tested on the raw cells before anything is filled."""
    return {S.R_DATE: blank(date), S.R_ADDRESS: blank(address), S.R_PRICE: to_number(price).isNull()}


def sanity_rules(
    floor: str = S.FLOOR, floors: str = S.FLOORS, bathrooms: str = S.BATHROOMS,
    rooms: str = S.ROOMS, area: str = S.FLOOR_AREA, ceiling: str = S.CEILING_HEIGHT,
) -> dict[str, Column]:
    c = {k: F.coalesce(F.col(f"`{k}`").cast("double"), F.lit(0.0)) for k in (floor, floors, bathrooms, rooms, area, ceiling)}
    return {
        S.R_FLOOR: c[floor] > c[floors],
        S.R_BATHROOMS: c[bathrooms] > c[rooms],
        S.R_AREA: c[area] <= S.MIN_AREA,
        S.R_CEILING: c[ceiling] == 0,
    }


REASONS = "_reasons"


class ExclusionLedger:
    """Reasons travel with the row in one array column.

    Rules of one step are judged together on the rows that are still kept; a row
    with a reason takes no part in later steps. Applying a step is a projection:
    no join, no shuffle. Kept and excluded rows are two filters at the end.
    """

    @staticmethod
    def open(df: DataFrame) -> DataFrame:
        return df.withColumn(REASONS, F.array().cast("array<string>"))

    @staticmethod
    def alive() -> Column:
        return F.size(REASONS) == 0

    @classmethod
    def apply(cls, df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
        given = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(r)) for r, bad in rules.items()]))
        return df.withColumn(REASONS, F.when(cls.alive(), given).otherwise(F.col(REASONS)))

    @classmethod
    def kept(cls, df: DataFrame) -> DataFrame:
        return df.where(cls.alive()).drop(REASONS)

    @classmethod
    def excluded(cls, df: DataFrame) -> DataFrame:
        return df.where(~cls.alive()).withColumn(S.REASON, F.array_join(REASONS, "; ")).drop(REASONS)

    @classmethod
    def entries(cls, df: DataFrame, row_id: str) -> DataFrame:
        """One row per (row id, reason)."""
        return df.select(row_id, F.explode(REASONS).alias("reason"))

    @staticmethod
    def summary(df: DataFrame) -> DataFrame:
        return df.select(F.explode(REASONS).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def split_excluded(original: DataFrame, kept: DataFrame, row_id: str, reasons: DataFrame) -> DataFrame:
    """Original rows that are not kept, with their joined reasons ('' when none was logged)."""
    text = reasons.groupBy(row_id).agg(F.array_join(F.sort_array(F.collect_set("reason")), "; ").alias(S.REASON))
    gone = original.join(kept.select(row_id), row_id, "left_anti")
    return gone.join(text, row_id, "left").withColumn(S.REASON, F.coalesce(S.REASON, F.lit("")))


def trim_bounds(df: DataFrame, column: str, low: float, high: float, keys: Sequence[str] = ()) -> DataFrame:
    found = exact_quantiles(df, column, [low, high], keys)
    return found.select(*keys, F.col("q0").alias("_lo"), F.col("q1").alias("_hi"))


def _approximate_bounds(df: DataFrame, column: str, low: float, high: float, keys: Sequence[str]) -> DataFrame:
    both = F.percentile_approx(column, F.array(F.lit(low), F.lit(high)), F.lit(10_000))
    found = df.groupBy(*keys).agg(both.alias("_b")).select(*keys, F.col("_b")[0].alias("_lo"), F.col("_b")[1].alias("_hi"))
    return found


def outside_bounds(df: DataFrame, column: str, low: float, high: float, keys: Sequence[str] = (),
                   among: DataFrame | None = None, approx: bool = False) -> DataFrame:
    """Add ``_out``: the cell is missing or outside the quantile range of its group.

    ``among`` gives the rows that define the range. Rows with a missing group
    key count as outside. The bounds table has one row per group; it is
    joined back by ``skew_join``.
    """
    base = df if among is None else among
    make = _approximate_bounds if approx else trim_bounds
    bounds = make(base, column, low, high, list(keys))
    value = F.col(f"`{column}`")
    if not keys:
        inside = value.between(bounds.select("_lo").scalar(), bounds.select("_hi").scalar())
        return df.withColumn("_out", ~F.coalesce(inside, F.lit(False)))
    tagged = skew_join(df, checkpointed(bounds), keys)
    return tagged.withColumn("_out", ~F.coalesce(value.between(F.col("_lo"), F.col("_hi")), F.lit(False))).drop("_lo", "_hi")


def trim_outliers(df: DataFrame, column: str, low: float = S.TRIM_LOW, high: float = S.TRIM_HIGH,
                  approx: bool = False) -> DataFrame:
    return outside_bounds(df, column, low, high, approx=approx).where(~F.col("_out")).drop("_out")


def trim_grouped_outliers(df: DataFrame, column: str, keys: Sequence[str], low: float = 0.10, high: float = 0.80,
                          approx: bool = False) -> DataFrame:
    return outside_bounds(df, column, low, high, keys, approx=approx).where(~F.col("_out")).drop("_out")


def first_copies(df: DataFrame, row_id: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Lowest row id of every set of equal rows; a hot set collapses on the map side."""
    columns = list(columns or [c for c in df.columns if c != row_id])
    return df.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.min(row_id).alias(row_id))


def dedupe_keep_first(df: DataFrame, row_id: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Keep the first of equal rows. Comparing all business columns, the aggregate is the answer."""
    rest = [c for c in df.columns if c != row_id]
    columns = list(columns or rest)
    other = [c for c in rest if c not in columns]
    if not other:
        return first_copies(df, row_id, columns).select(*df.columns)
    carried = F.min_by(F.struct(*[F.col(f"`{c}`") for c in other]), row_id).alias("_c")
    out = df.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.min(row_id).alias(row_id), carried)
    return out.select(*[F.col(f"_c.`{c}`") if c in other else F.col(f"`{c}`") for c in df.columns])


def flag_duplicates(df: DataFrame, row_id: str, columns: Sequence[str], among: DataFrame | None = None) -> DataFrame:
    """Add ``_dup`` by an equi join on the unique row id, which cannot be skewed."""
    base = df if among is None else among
    first = first_copies(base.select(row_id, *columns), row_id, columns).select(row_id, F.lit(False).alias("_dup"))
    return df.join(first, row_id, "left").withColumn("_dup", F.coalesce("_dup", F.lit(True)))


def exclude_zero_rank(df: DataFrame, column: str, watch=None) -> DataFrame:
    if watch is not None:
        df = df.observe(watch, F.count_if(F.col(column) == 0).alias("excluded"))
    return df.where(F.col(column) != 0)
