"""The relational output: dimensions, facts, bridges, upsert and key checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentloom import schema as S
from rentloom.functions.casts import blank_to_null
from rentloom.operators.aggregates import distinct_values, parent_child_pairs
from rentloom.operators.lists import bridge
from rentloom.session import checkpointed
from rentloom.sources.snapshots import Snapshot, current, new_data, publish


def null_blanks(df: DataFrame) -> DataFrame:
    """NaN and '' become NULL in every text and floating column."""
    return df.select(*[blank_to_null(c, t).alias(c) for c, t in df.dtypes])


def dimension(df: DataFrame, column: str, key: str = "name") -> DataFrame:
    return distinct_values(df, [column], key)


def district_dimension(df: DataFrame, unit: str = S.UNIT, province: str = S.PROVINCE) -> DataFrame:
    return parent_child_pairs(df, unit, province)


def listing_fact(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in S.LISTING_TABLE])


def address_table(df: DataFrame) -> DataFrame:
    """One row per listing; absent parts are NULL columns."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in S.ADDRESS_TABLE])


def property_table(df: DataFrame) -> DataFrame:
    """The fixed property columns; its address and listing keys are the row id."""
    source = df.withColumns({S.ADDRESS: F.col(S.ROW_ID), "Listing": F.col(S.ROW_ID)})
    return source.select(*[
        (F.col(f"`{c}`") if c in source.columns else F.lit(None)).cast(t).alias(c) for c, t in S.PROPERTY_TYPES.items()])


def family_bridge(df: DataFrame, items: str, family: str) -> DataFrame:
    return bridge(df, S.ROW_ID, items).select(
        F.col(S.ROW_ID).alias("Property_ID"), F.col("item").alias(f"{family}_type"))


def _by_key(source: DataFrame, key: Sequence[str], sequence: str | None) -> DataFrame:
    """One row per key without missing parts: its rows, the one that counts (``row``) and whether there is one (``sound``).

    All in one aggregate that combines before the shuffle, so a key may have any
    number of rows.
    """
    keyed = source.dropna(subset=list(key))
    whole = F.struct(*[F.col(f"`{c}`") for c in source.columns])
    columns = [F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(key)]
    if sequence:
        best = F.max(F.struct(F.col(f"`{sequence}`").alias("_s"), whole.alias("row")))["row"]
        return keyed.groupBy(*columns).agg(F.count(F.lit(1)).alias("_rows"), best.alias("row"), F.lit(True).alias("sound"))
    low, high = F.min(whole), F.max(whole)
    return keyed.groupBy(*columns).agg(F.count(F.lit(1)).alias("_rows"), low.alias("row"), low.eqNullSafe(high).alias("sound"))


def accepted_rows(source: DataFrame, key: Sequence[str], sequence: str | None = None) -> DataFrame:
    """The rows of ``source`` that an upsert takes, one per key.

    With a ``sequence`` column the last writer wins: the row with the largest
    value, a missing one counts as smallest, of equal ones the largest row.
    Without one a key must be clear: equal rows count once, and a key whose rows
    differ is refused as a whole. Rows with a missing key part are refused.
    """
    return _by_key(source, key, sequence).where("sound").select("row.*")


def refused_rows(source: DataFrame, key: Sequence[str], sequence: str | None = None) -> DataFrame:
    """(key columns, rows, reason) of what :func:`accepted_rows` leaves out: missing key, conflict or superseded."""
    kinds = dict(source.dtypes)
    absent = F.greatest(*[F.col(f"`{k}`").isNull() for k in key], F.lit(False))
    missing = source.where(absent).groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).withColumn("reason", F.lit("missing key"))
    lost = F.col("_rows") - 1 if sequence else F.col("_rows")
    other = _by_key(source, key, sequence).where(F.col("_rows") > 1 if sequence else ~F.col("sound"))
    named = [F.col(f"_key{i}").cast(kinds[k]).alias(k) for i, k in enumerate(key)]
    return missing.unionByName(other.select(*named, lost.alias("rows"), F.lit("superseded" if sequence else "conflict").alias("reason")))


def upsert(target: DataFrame, source: DataFrame, key: Sequence[str], sequence: str | None = None) -> DataFrame:
    """Target rows the source does not replace, plus the source's accepted rows: no key of the source stands twice.

    See :func:`accepted_rows` for repeated keys of the source; a refused key
    leaves the target's row as it is. When the table has only key columns an
    existing row stays as it is, which gives the same rows. Target rows without
    a key stay.
    """
    taken = accepted_rows(source, key, sequence)
    return target.join(taken.select(*[F.col(f"`{k}`") for k in key]), list(key), "left_anti").select(*target.columns).unionByName(taken)


def upsert_snapshot(spark: SparkSession, root: str, source: DataFrame, key: Sequence[str], sequence: str | None = None, buckets: int = 64) -> Snapshot:
    """Upsert into a published table of key buckets; only buckets that a source key falls in are written anew.

    The buckets of the version before that no key touches are named again by the
    new one. The first call makes the table. Target and source meet by bucket
    and key; the driver sees the numbers of the touched buckets.
    """
    label = f"buckets {buckets} by {', '.join(key)}"
    before = current(spark, root)
    if before and before.label != label:
        raise ValueError(f"the table has {before.label}, not {label}")
    place = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in key]), F.lit(buckets)).cast("int").alias("_bucket")
    taken = checkpointed(accepted_rows(source, key, sequence).select("*", place))
    touched = sorted(r[0] for r in taken.select("_bucket").distinct().collect())
    parts = dict(before.parts) if before else {}
    if touched:
        old = [str(b) for b in touched if str(b) in parts]
        rows = taken
        if old:
            held = before.read(spark, *old).select(*source.columns)
            kept = held.join(taken.select(*[F.col(f"`{k}`") for k in key]), list(key), "left_anti").select(*source.columns)
            rows = taken.unionByName(kept.select("*", place))
        data = new_data(root)
        rows.repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(data)
        parts |= {str(b): f"{data}/_bucket={b}" for b in touched}
    return publish(spark, root, parts, label)


def check_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that are missing or occur twice; empty when the table is sound."""
    absent = F.greatest(*[F.col(f"`{k}`").isNull() for k in key], F.lit(False))
    return df.groupBy(*[F.col(f"`{k}`") for k in key]).agg(F.count(F.lit(1)).alias("rows")).where((F.col("rows") > 1) | absent)


def check_references(child: DataFrame, columns: Mapping[str, str], parent: DataFrame) -> DataFrame:
    """Child keys without a parent row; a key with a missing part is not checked.

    ``columns`` maps child column to parent column.
    """
    keys = child.select(*[F.col(f"`{c}`").alias(p) for c, p in columns.items()]).dropna().distinct()
    return keys.join(parent.select(*[F.col(f"`{p}`") for p in columns.values()]), list(columns.values()), "left_anti")


def relational_model(cleaned: DataFrame, rates: DataFrame, lists: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """All tables by name. ``lists`` maps a family to its array column."""
    lists = {f: f for f in S.FAMILY_PREFIX} if lists is None else dict(lists)
    df = null_blanks(cleaned)
    tables = {
        S.PROVINCE: dimension(df, S.PROVINCE),
        S.TOWN: dimension(df, S.TOWN),
        S.RENOVATION: dimension(df, S.RENOVATION, "type"),
        S.CONSTRUCTION: dimension(df, S.CONSTRUCTION, "type"),
        S.CURRENCY: dimension(df, S.CURRENCY, "code"),
        "Exchange Rate": rates.select("Date", "Currency", "USD"),
        S.UNIT: district_dimension(df),
        "Listing": listing_fact(df),
        S.ADDRESS: address_table(df),
        "Property": property_table(df),
    }
    for family, column in lists.items():
        tables[family] = dimension(df.select(F.explode(column).alias("item")), "item", "type")
        tables[f"Property_{family}"] = family_bridge(df, column, family)
    return tables
