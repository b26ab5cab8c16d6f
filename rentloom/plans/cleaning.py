"""Cleaning raw listings: typed cells, exclusion ledger, trimming, prices, features."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentloom import schema as S
from rentloom.functions.casts import band, blank, flag_default, number_or_zero, parse_date, text_or_blank, truthy
from rentloom.functions.text import normalize_text
from rentloom.operators.joins import attach_address, monthly_usd_price
from rentloom.operators.lists import one_hot_list, rank_score, split_clean_list
from rentloom.operators.quality import (
    REASONS, ExclusionLedger, first_copies, key_field_rules, outside_bounds, sanity_rules,
)
from rentloom.session import checkpointed
from rentloom.sources.listings import majority_types, rename_headers


class Cleaned(NamedTuple):
    """``kept`` listings, ``excluded`` original rows with their reasons, and the reason ``summary``."""

    kept: DataFrame
    excluded: DataFrame
    summary: DataFrame


FLAGS = [S.ELEVATOR, S.NEW_CONSTRUCTION]
TRUTH = [S.FURNISHED, S.BALCONY]
VERBATIM = [S.CURRENCY, *S.FAMILY_PREFIX]


def type_listings(raw: DataFrame, row_id: str) -> DataFrame:
    """Typed and normalised cells. Columns with over 80 % numbers become numbers, others text."""
    df = rename_headers(raw).drop(*S.PII_COLUMNS)
    special = [row_id, S.DATE, *FLAGS, *TRUTH]
    numeric, text = majority_types(df, exempt=[c for c in special if c in df.columns])
    numeric = sorted({*numeric, S.PRICE} & set(df.columns))
    made: dict[str, Column] = {c: number_or_zero(c) for c in numeric}
    for c in (c for c in text if c not in numeric):
        made[c] = text_or_blank(c) if c in VERBATIM else normalize_text(c)
    made.update({c: flag_default(c) for c in FLAGS if c in df.columns})
    made.update({c: truthy(c) for c in TRUTH if c in df.columns})
    made[S.DATE] = parse_date(F.col(S.DATE).cast("string"))
    if S.RENOVATION in df.columns:
        made[S.RENOVATION] = F.when(blank(made[S.RENOVATION]), S.NO_RENOVATION).otherwise(made[S.RENOVATION])
    return df.withColumns(made)


def clean_listings(raw: DataFrame, rates: DataFrame, row_id: str = S.ROW_ID) -> Cleaned:
    """All exclusion steps in order; ``row_id`` is a unique column of ``raw``.

    The wide rows are scanned for the column types, for the row rules and for
    the result. All steps between work on a narrow checkpointed table (row id,
    reasons, amounts and a fingerprint of the business columns); the verdict is
    joined back on the unique row id.
    """
    raw = rename_headers(raw)
    rules = key_field_rules()
    rules[S.R_DATE] = parse_date(F.col(S.DATE).cast("string")).isNull()
    # The missing-field rules read the raw cells; they ride along the same scan as the typed ones.
    given = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(r)) for r, bad in rules.items()]))
    opened = type_listings(raw.withColumn(REASONS, given), row_id)
    typed = opened.drop(REASONS)
    business = [F.col(f"`{c}`") for c in typed.columns if c != row_id]
    fingerprint = F.sha2(F.to_json(F.struct(*business)), 256)
    opened = ExclusionLedger.apply(opened, sanity_rules())
    narrow = checkpointed(opened.select(
        row_id, REASONS, S.DATE, S.PRICE, S.CURRENCY, S.DURATION, S.FLOOR_AREA, fingerprint.alias("_print")))

    def trim(df: DataFrame, column: str, reason: str, keys: tuple = ()) -> DataFrame:
        judged = outside_bounds(df, column, S.TRIM_LOW, S.TRIM_HIGH, keys, among=df.where(ExclusionLedger.alive()))
        return ExclusionLedger.apply(judged, {reason: F.col("_out")}).drop("_out")

    ledger = trim(narrow, S.PRICE, S.R_PRICE_TRIM, (S.CURRENCY, S.DURATION))
    ledger = trim(ledger, S.FLOOR_AREA, S.R_AREA_TRIM)
    first = first_copies(ledger.where(ExclusionLedger.alive()).select(row_id, "_print"), row_id, ["_print"])
    ledger = ledger.join(first.select(row_id, F.lit(True).alias("_first")), row_id, "left")
    ledger = ExclusionLedger.apply(ledger, {S.R_DUPLICATE: F.col("_first").isNull()}).drop("_first", "_print")
    ledger = checkpointed(monthly_usd_price(ledger, rates))
    ledger = ExclusionLedger.apply(ledger, {S.R_RATE: F.col(S.MONTHLY_USD_PRICE).isNull()})
    ledger = trim(ledger, S.MONTHLY_USD_PRICE, S.R_USD_TRIM)
    verdict = ledger.select(row_id, REASONS, S.MONTHLY_USD_PRICE)
    kept = typed.join(verdict.where(ExclusionLedger.alive()).drop(REASONS), row_id)
    excluded = raw.join(ExclusionLedger.excluded(verdict), row_id)
    return Cleaned(kept, excluded, ExclusionLedger.summary(verdict))


def add_features(kept: DataFrame, addresses: DataFrame | None = None, key: str = S.INDEX, wide: bool = True,
                 items: dict[str, list[str]] | None = None) -> DataFrame:
    """Address columns, item columns or lists, the price band and the item ranks."""
    df = attach_address(kept, addresses, key) if addresses is not None else kept
    families = [f for f in S.FAMILY_PREFIX if f in df.columns]
    df = df.withColumns({f: split_clean_list(f, f) for f in families}) if families else df
    df = df.withColumns({
        **{S.FAMILY_RANK[f]: rank_score(f) if f in families else F.lit(0.0) for f in S.FAMILY_PREFIX},
        S.PRICE_BAND: band(S.MONTHLY_USD_PRICE),
    })
    if wide:
        for f in families:
            df = one_hot_list(df, f, S.FAMILY_PREFIX[f], (items or {}).get(f)).drop(f)
    return df
