"""Equi joins of the listing model: rates, addresses, group figures, look-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentloom import schema as S
from rentloom.functions.casts import blank
from rentloom.functions.geo import monthly_amount, usd_amount
from rentloom.functions.text import address_key
from rentloom.operators.scale import skew_join
from rentloom.session import checkpointed


def join_rates(df: DataFrame, rates: DataFrame, date: str = S.DATE, currency: str = S.CURRENCY) -> DataFrame:
    """Listings with the rate of their exact date and currency, NULL when there is none."""
    side = rates.select(F.col("Date").alias(date), F.col("Currency").alias(currency), F.col("USD").alias("rate"))
    return skew_join(df, side, [date, currency])


def monthly_usd_price(df: DataFrame, rates: DataFrame, price: str = S.PRICE, date: str = S.DATE,
                      currency: str = S.CURRENCY, duration: str = S.DURATION, name: str = S.MONTHLY_USD_PRICE) -> DataFrame:
    rated = join_rates(df, rates, date, currency)
    monthly = monthly_amount(price, date, duration)
    return rated.withColumn(name, usd_amount(monthly, currency, "rate")).drop("rate")


def attach_address(listings: DataFrame, addresses: DataFrame, key: str = S.INDEX) -> DataFrame:
    """Replace the raw address by its components; the key is unique on both sides."""
    return listings.drop(S.ADDRESS).join(addresses.drop(S.ADDRESS), key, "left")


def address_bridge(listings: DataFrame, key: str = S.INDEX, address: str = S.ADDRESS) -> DataFrame:
    """(normalised address, row key): the key lists of the addresses in long form.

    A popular address may own a large part of all listings, so its keys are
    rows of a table and never one array.
    """
    return listings.select(address_key(address).alias(address), key).where(F.col(address).isNotNull())


def keys_per_address(listings: DataFrame, key: str = S.INDEX, address: str = S.ADDRESS) -> DataFrame:
    return address_bridge(listings, key, address).groupBy(address).agg(
        F.count(F.lit(1)).alias("listings"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))


def reindex_addresses(addresses: DataFrame, listings: DataFrame, key: str = S.INDEX) -> DataFrame:
    """One row per (address row, row key); an address row without listings keeps one row with a NULL key.

    Both sides are matched on the normalised text. The listings are the large,
    possibly skewed side; address rows that share a text all stay.
    """
    known = addresses.drop(key).withColumn(S.ADDRESS, address_key(S.ADDRESS))
    known = checkpointed(known)
    bridge = address_bridge(listings, key)
    matched = skew_join(bridge, known, [S.ADDRESS], "inner")
    unused = known.join(bridge.select(S.ADDRESS).distinct(), S.ADDRESS, "left_anti")
    return matched.unionByName(unused, allowMissingColumns=True)


def unmatched_report(addresses: DataFrame, listings: DataFrame, key: str = S.INDEX) -> DataFrame:
    """One row: addresses in all, with listings, without."""
    known = addresses.select(address_key(S.ADDRESS).alias(S.ADDRESS)).distinct()
    used = address_bridge(listings, key).select(S.ADDRESS).distinct().withColumn("_u", F.lit(1))
    return known.join(used, S.ADDRESS, "left").agg(
        F.count(F.lit(1)).alias("total"), F.count("_u").alias("mapped"), F.count_if(F.col("_u").isNull()).alias("missing"))


def attach_group_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Rows with the figures of their group; rows without a complete set fall out."""
    complete = checkpointed(stats.dropna(subset=list(required)))
    return skew_join(df, complete, keys, "inner")


def lookup_parent(df: DataFrame, child: str, mapping: DataFrame, mapping_key: str, parent: str, name: str) -> DataFrame:
    """The parent of ``child`` in a mapping table, '' when there is none."""
    side = mapping.groupBy(F.col(mapping_key).alias(child)).agg(F.min(parent).alias(name))
    return skew_join(df, side, [child]).withColumn(name, F.coalesce(name, F.lit("")))


def apply_translations(df: DataFrame, translations: DataFrame, text: str = S.ADDRESS, name: str = S.TRANSLATED) -> DataFrame:
    """Known texts are replaced by their translation, others stay."""
    side = translations.groupBy(F.col(S.ADDRESS).alias(text)).agg(F.min(S.TRANSLATED).alias("_t"))
    return skew_join(df, side, [text]).withColumn(name, F.coalesce("_t", F.col(text))).drop("_t")


def keep_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def reject_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def difference(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct left values that the right side does not have."""
    return left.select(*columns).distinct().join(right.select(*columns).distinct(), list(columns), "left_anti")


def without_blank(df: DataFrame, column: str) -> DataFrame:
    return df.where(~blank(column))
