"""The preset reports as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from rentloom import schema as S
from rentloom.functions.casts import flag_equals
from rentloom.operators.profile import price_profile
from rentloom.operators.quality import exclude_zero_rank
from rentloom.operators.stats import box_summary, correlation_matrix, point_biserial

MONTHLY = "Duration == Monthly"
PLACE_KEYS = [S.PROVINCE, S.UNIT]


def with_monthly_flag(df: DataFrame) -> DataFrame:
    return df.withColumn(MONTHLY, flag_equals(S.DURATION, "Monthly"))


def duration_tests(df: DataFrame) -> dict[str, DataFrame]:
    flagged = with_monthly_flag(df)
    return {
        "price_test": point_biserial(flagged, MONTHLY, S.MONTHLY_USD_PRICE),
        "rooms_test": point_biserial(flagged, MONTHLY, S.ROOMS),
    }


def duration_boxes(df: DataFrame) -> dict[str, DataFrame]:
    flagged = with_monthly_flag(df)
    return {
        "price": box_summary(flagged, [MONTHLY], S.MONTHLY_USD_PRICE),
        "rooms": box_summary(flagged, [MONTHLY], S.ROOMS),
        **duration_tests(df),
        "matrix": duration_matrix(df),
    }


def duration_matrix(df: DataFrame) -> DataFrame:
    return correlation_matrix(with_monthly_flag(df), [MONTHLY, S.ROOMS, S.MONTHLY_USD_PRICE], [MONTHLY])


RANKS = [S.FAMILY_RANK[f] for f in (S.AMENITIES, S.PARKING, S.APPLIANCES)]


def rank_profiles(df: DataFrame, row_id: str, wanted: Sequence[str] = RANKS, minimum: int = 50) -> dict[str, DataFrame]:
    """Profiles by item rank without zero ranks, each on the rows the one before kept."""
    out = {}
    for column in RANKS:
        df = exclude_zero_rank(df, column)
        if column in wanted:
            out[column] = price_profile(df, [column], row_id, minimum=minimum)[0]
    return out


def rank_matrix(df: DataFrame) -> DataFrame:
    """Rank correlations of the price and the item ranks over rows without a zero rank."""
    for column in RANKS:
        df = exclude_zero_rank(df, column)
    return correlation_matrix(df, [S.MONTHLY_USD_PRICE, *S.FAMILY_RANK.values()])


def rank_correlations(df: DataFrame, row_id: str) -> dict[str, DataFrame]:
    return {**rank_profiles(df, row_id), "matrix": rank_matrix(df)}


def named_reports(row_id: str = S.ROW_ID) -> dict[str, Callable[[DataFrame], DataFrame | dict[str, DataFrame]]]:
    """Report name to a function of the cleaned listings."""
    return {
        "distance_from_centre": lambda df: price_profile(df, PLACE_KEYS, row_id, minimum=100, by_distance=True)[0],
        "district_median": lambda df: price_profile(df, PLACE_KEYS, row_id, "median", minimum=100)[0],
        "streetwise_percent_change": lambda df: price_profile(df, PLACE_KEYS, row_id, "percent", minimum=100)[0],
        "area_log_change": lambda df: price_profile(df, [S.FLOOR_AREA], row_id, "log", minimum=10)[0],
        "duration_boxes": duration_boxes,
        "construction_boxes": lambda df: box_summary(df, [S.CONSTRUCTION], S.MONTHLY_USD_PRICE),
        "rooms_price": lambda df: price_profile(df, [S.ROOMS], row_id, "median", minimum=50)[0],
        "rooms_duration_correlation": lambda df: correlation_matrix(
            with_monthly_flag(df), [S.ROOMS, S.MONTHLY_USD_PRICE, MONTHLY], [MONTHLY]),
        "rank_correlations": lambda df: rank_correlations(df, row_id),
    }


