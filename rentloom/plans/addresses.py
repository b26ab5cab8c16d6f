"""From raw address texts, translations and stored replies to one component row per listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentloom import schema as S
from rentloom.functions.casts import blank, text_or_blank
from rentloom.functions.text import normalize_address
from rentloom.operators.address import (
    extract_all_components, fill_unit_by_street, repair_generic_streets, resolve_region, split_on_delimiters,
)
from rentloom.operators.joins import apply_translations, reindex_addresses
from rentloom.operators.replies import FIELDS, merge_providers
from rentloom.session import checkpointed
from rentloom.sources.reference_data import Hierarchy


def unique_addresses(listings: DataFrame) -> DataFrame:
    return listings.select(S.ADDRESS).where(~blank(S.ADDRESS)).distinct()


def address_components(addresses: DataFrame, translations: DataFrame, replies: DataFrame, hierarchy: Hierarchy) -> DataFrame:
    """One row per distinct address with all component columns; listings are not touched here."""
    df = apply_translations(addresses, translations)
    merged = merge_providers(replies).withColumnRenamed("address", S.ADDRESS)
    df = df.join(merged, S.ADDRESS, "left")
    absent = [f for f in FIELDS if f not in df.columns]
    df = df.withColumns({f: F.lit(None).cast("string") for f in absent}) if absent else df
    df = df.withColumns({c: normalize_address(c) for c in (S.TRANSLATED, S.STREET, S.NEIGHBOURHOOD)})
    street, town = split_on_delimiters(S.TRANSLATED, S.STREET, S.TOWN)
    df = df.withColumns({S.STREET: street, S.TOWN: town})
    df = checkpointed(repair_generic_streets(extract_all_components(df)))
    df = resolve_region(df, S.ADDRESS, S.TRANSLATED, hierarchy.provinces, hierarchy.units, hierarchy.localities)
    df = fill_unit_by_street(df, S.ADDRESS)
    return df.withColumns({c: text_or_blank(c) for c in S.ADDRESS_COLUMNS})


def resolve_addresses(listings: DataFrame, translations: DataFrame, replies: DataFrame, hierarchy: Hierarchy,
                      key: str = S.INDEX) -> DataFrame:
    """One row per listing key with the components of its address."""
    components = address_components(unique_addresses(listings), translations, replies, hierarchy)
    return reindex_addresses(components, listings, key)
