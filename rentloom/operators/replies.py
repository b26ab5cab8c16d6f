"""Stored geocoder replies: one JSON text per reply to address columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentloom import schema as S
from rentloom.functions.casts import filled
from rentloom.functions.text import non_ascii_flag

FIELDS = [S.LATITUDE, S.LONGITUDE, S.VILLAGE, *S.ADDRESS_COLUMNS]
_TEXT_FIELDS = [f for f in FIELDS if f not in (S.LATITUDE, S.LONGITUDE)]


def _text(c: Column) -> Column:
    return F.when(c != "", c)


def _labelled(get, labels: Mapping[str, str], last_wins: bool) -> dict[str, Column]:
    """Per column the label that counts: the last or the first non-empty one."""
    by_column: dict[str, list[Column]] = {}
    for label, column in labels.items():
        by_column.setdefault(column, []).append(_text(get(label)))
    return {c: F.coalesce(*(reversed(v) if last_wins else v)) for c, v in by_column.items()}


def _with_fields(df: DataFrame, values: Mapping[str, Column], drop: list[str], formatted: Column | None = None) -> DataFrame:
    """All address fields and the provider's own address line; what the provider does not give is NULL."""
    made = {f: values.get(f, F.lit(None)).cast("double" if f in (S.LATITUDE, S.LONGITUDE) else "string") for f in FIELDS}
    line = F.lit(None).cast("string") if formatted is None else _text(formatted)
    return df.withColumns({**made, "Formatted": line}).drop(*drop)


def flatten_nominatim(df: DataFrame, body: str = "body") -> DataFrame:
    """First result. A suburb that is a known district is the unit; of labels for one column the later counts."""
    shape = "array<struct<lat:string,lon:string,address:map<string,string>>>"
    # An object where the list should be would read as a list of one empty result.
    listed = F.when(F.ltrim(F.col(body)).startswith("["), F.col(body))
    out = df.withColumn("_r", F.try_element_at(F.from_json(listed, shape), F.lit(1)))
    known = F.col("_r.address")["suburb"].isin(S.DISTRICTS)

    def get(label: str) -> Column:
        value = F.col("_r.address")[label]
        return F.when(~F.coalesce(known, F.lit(False)), value) if label == "suburb" else value

    values = _labelled(get, S.NOMINATIM_LABELS, last_wins=True)
    values[S.UNIT] = F.coalesce(values[S.UNIT], F.when(known, F.col("_r.address")["suburb"]))
    locality = F.col("_r.address")["locality"]
    values[S.VILLAGE] = F.coalesce(values[S.VILLAGE], F.when(F.lower(locality).contains("village"), locality))
    values[S.LATITUDE] = F.coalesce(F.col("_r.lat").try_cast("double"), F.when(F.col("_r").isNotNull(), 0.0))
    values[S.LONGITUDE] = F.coalesce(F.col("_r.lon").try_cast("double"), F.when(F.col("_r").isNotNull(), 0.0))
    return _with_fields(out, values, ["_r"])


_AZURE_PARTS = [
    "freeformAddress", "countrySubdivision", "countrySecondarySubdivision", "municipality", "neighbourhood",
    "neighborhood", "locality", "streetName", "streetNumber", "country", "countryRegion",
]


def flatten_azure(df: DataFrame, body: str = "body") -> DataFrame:
    """First result unless its score is too low; a bare street name overrides name plus number."""
    parts = ",".join(f"{p}:string" for p in _AZURE_PARTS)
    shape = (f"struct<results:array<struct<matchConfidence:struct<score:double>,"
             f"position:struct<lat:double,lon:double>,address:struct<{parts}>>>>")
    out = df.withColumn("_r", F.try_element_at(F.from_json(body, shape)["results"], F.lit(1)))
    score = F.col("_r.matchConfidence.score")
    trusted = score.isNull() | (score == 0) | (score >= S.AZURE_MIN_SCORE)
    named = F.coalesce(*[F.col(f"_r.address.{p}") for p in _AZURE_PARTS]).isNotNull()
    out = out.withColumn("_r", F.when(trusted & named, F.col("_r")))

    def get(label: str) -> Column:
        return _text(F.col(f"_r.address.{label}"))

    values = {
        S.PROVINCE: get("countrySubdivision"),
        S.UNIT: F.coalesce(get("countrySecondarySubdivision"), get("municipality")),
        S.NEIGHBOURHOOD: F.coalesce(get("neighborhood"), get("neighbourhood")),
        S.TOWN: get("locality"),
        S.STREET: F.coalesce(get("streetName"), get("streetNumber")),
        S.COUNTRY: F.coalesce(get("countryRegion"), get("country")),
        S.LATITUDE: F.col("_r.position.lat"),
        S.LONGITUDE: F.col("_r.position.lon"),
    }
    return _with_fields(out, values, ["_r"], get("freeformAddress"))


def flatten_yandex(df: DataFrame, body: str = "body") -> DataFrame:
    """First object. Of components of one kind the last counts; a "village" locality is a village."""
    address = "struct<formatted:string,Components:array<struct<kind:string,name:string>>>"
    shape = ("struct<response:struct<GeoObjectCollection:struct<featureMember:array<struct<GeoObject:struct<"
             f"metaDataProperty:struct<GeocoderMetaData:struct<Address:{address}>>,Point:struct<pos:string>>>>>>>")
    members = F.from_json(body, shape)["response"]["GeoObjectCollection"]["featureMember"]
    out = df.withColumn("_g", F.try_element_at(members, F.lit(1))["GeoObject"])
    out = out.withColumn("_c", F.col("_g.metaDataProperty.GeocoderMetaData.Address.Components"))
    village = F.lower(_last_of_kind("locality")).contains("village")

    def get(label: str) -> Column:
        value = _last_of_kind(label)
        return F.when(~F.coalesce(village, F.lit(False)), value) if label == "locality" else value

    values = _labelled(get, S.YANDEX_LABELS, last_wins=True)
    values[S.VILLAGE] = F.when(village, _last_of_kind("locality"))
    place = F.split(F.btrim(F.col("_g.Point.pos")), r"\s+")
    values[S.LONGITUDE] = F.try_element_at(place, F.lit(1)).try_cast("double")
    values[S.LATITUDE] = F.try_element_at(place, F.lit(2)).try_cast("double")
    return _with_fields(out, values, ["_g", "_c"], F.col("_g.metaDataProperty.GeocoderMetaData.Address.formatted"))


def _last_of_kind(kind: str) -> Column:
    of_kind = F.filter(F.col("_c"), lambda x: x["kind"] == kind)
    return F.try_element_at(of_kind, F.lit(-1))["name"]


def flatten_labels(df: DataFrame, body: str = "body") -> DataFrame:
    """Label replies: the first non-empty label of a column, trimmed."""
    out = df.withColumn("_m", F.from_json(body, "map<string,string>"))
    values = _labelled(lambda label: F.col("_m")[label], S.POSTAL_LABELS, last_wins=False)
    return _with_fields(out, {c: F.trim(v) for c, v in values.items()}, ["_m"])


def flatten_replies(replies: DataFrame) -> DataFrame:
    """All providers of a (address, candidate, provider, body) table in one layout."""
    flat = [
        flatten_yandex(replies.where("provider = 'Yandex'")),
        flatten_nominatim(replies.where("provider = 'Nominatim'")),
        flatten_azure(replies.where("provider = 'Azure'")),
    ]
    return flat[0].unionByName(flat[1]).unionByName(flat[2]).drop("body")


def merge_providers(replies: DataFrame, flat: DataFrame | None = None, text: str = "text") -> DataFrame:
    """One row per address: per field the first provider that has it.

    ``candidate`` is 'native' or 'translated', ``text`` what was asked. Non-ASCII
    text prefers one provider order, ASCII text the reverse. The native text's
    fields are used when it gave any, else the translation's. Yandex and Azure
    replies only count when they name the address they found.
    """
    flat = flatten_replies(replies) if flat is None else flat
    order = F.when(non_ascii_flag(text), F.array_position(F.array(*map(F.lit, S.PROVIDERS_NON_ASCII)), F.col("provider"))).otherwise(
        F.array_position(F.array(*map(F.lit, S.PROVIDERS_ASCII)), F.col("provider")))
    # A reply that does not count gets no rank. As a filter the test would be pushed below the parsing and repeat it.
    counts = (F.col("provider") == "Nominatim") | filled("Formatted").isNotNull()
    ranked = flat.withColumns({f: filled(f) for f in _TEXT_FIELDS}).withColumn("_p", F.when(counts, order))

    def first(field: str) -> Column:
        c = F.col(f"`{field}`")
        return F.min_by(c, F.when(c.isNotNull(), F.col("_p")))

    any_field = F.coalesce(*[F.col(f"`{f}`").cast("string") for f in FIELDS]).isNotNull()
    ranked = ranked.withColumn("api", F.when(any_field & F.col("_p").isNotNull(), F.col("provider")))
    fields = ["api", *FIELDS]
    per_candidate = ranked.groupBy("address", "candidate").agg(*[first(f).alias(f) for f in fields])
    turn = F.when(F.col("api").isNotNull(), F.when(F.col("candidate") == "native", 1).otherwise(2))
    best = per_candidate.groupBy("address").agg(F.min_by(F.struct(*[F.col(f"`{f}`") for f in fields]), turn).alias("_s"))
    best = replies.select("address").distinct().join(best, "address", "left")
    status = F.when(F.col("_s").isNull(), "FAILED").otherwise("OK").alias("Status")
    return best.select("address", status, *[F.col(f"_s.`{f}`") for f in fields])
