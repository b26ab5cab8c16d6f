"""Comma-separated cells: lists, item rows, 0/1 columns and bridges.

Everything that belongs to one row is computed inside that row's array, so the
long and the wide form need no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentloom.functions.casts import blank, col
from rentloom.functions.text import normalize_text
from rentloom.schema import DROPPED_ITEMS

MAX_ITEM_COLUMNS = 5_000


def split_clean_list(c: str | Column, family: str | None = None) -> Column:
    """Normalised items without blanks, "nan" and the family's dropped items; [] for NULL."""
    items = F.transform(F.split(col(c), ","), normalize_text)
    dropped = ["", "Nan", *DROPPED_ITEMS.get(family, [])]
    return F.coalesce(F.filter(items, lambda x: ~x.isin(dropped)), F.array().cast("array<string>"))


def item_counts(df: DataFrame, row_id: str, items: str) -> DataFrame:
    """Long form: (row id, item, n), repeats counted."""
    pairs = F.transform(
        F.array_distinct(F.col(items)),
        lambda x: F.struct(x.alias("item"), F.size(F.filter(F.col(items), lambda y: y == x)).cast("bigint").alias("n")))
    return df.select(row_id, F.explode(pairs).alias("p")).select(row_id, "p.item", "p.n")


def item_names(df: DataFrame, items: str) -> list[str]:
    """All item names, for a wide schema; a column per item only makes sense for a short list."""
    names = df.select(F.explode(items).alias("item")).distinct().orderBy("item").limit(MAX_ITEM_COLUMNS + 1)
    found = [r[0] for r in names.collect()]
    if len(found) > MAX_ITEM_COLUMNS:
        raise ValueError(f"over {MAX_ITEM_COLUMNS} distinct items: use the long form")
    return found


def one_hot_list(df: DataFrame, items: str, prefix: str, names: Sequence[str] | None = None) -> DataFrame:
    """One count column per item, 0 where the row lacks it; give ``names`` for a stable schema."""
    names = item_names(df, items) if names is None else names
    made = {f"{prefix}{n}": occurrences(items, n) for n in names}
    return df.withColumns(made) if made else df


def occurrences(items: str | Column, name: str) -> Column:
    return F.size(F.filter(col(items), lambda x: x == name)).cast("bigint")


def rank_score(c: str | Column) -> Column:
    """Number of items in the row's list, which is the sum of its count columns."""
    return F.when(col(c).isNotNull(), F.size(col(c))).otherwise(0).cast("double")


def parse_key_list(c: str | Column) -> Column:
    """``['A0', 'B3']`` as text to an array; any other text is a list of itself."""
    text = col(c)
    quoted = F.regexp_extract_all(text, F.lit(r"'([^']*)'|\"([^\"]*)\""), F.lit(0))
    inner = F.transform(quoted, lambda q: F.substring(q, 2, F.length(q) - 2))
    return F.when(text.rlike(r"^\s*\[.*\]\s*$"), inner).otherwise(F.array(text))


def explode_keys(df: DataFrame, column: str) -> DataFrame:
    """One row per key; text lists are parsed, an empty list keeps one row with NULL."""
    is_array = dict(df.dtypes)[column].startswith("array")
    keys = F.col(column) if is_array else parse_key_list(column)
    rest = [F.col(f"`{c}`") for c in df.columns if c != column]
    return df.select(*rest, F.explode_outer(keys).alias(column))


def melt_bridge(df: DataFrame, row_id: str, prefix: str) -> DataFrame:
    """Wide count columns to (row id, item) rows for items that are present at least once."""
    family = [c for c in df.columns if c.startswith(prefix)]
    if not family:
        return df.select(row_id, F.lit("").alias("item")).where(F.lit(False))
    cells = F.array(*[F.when(F.col(f"`{c}`") >= 1, F.lit(c[len(prefix):])) for c in family])
    return df.select(row_id, F.explode(F.array_compact(cells)).alias("item"))


def bridge(df: DataFrame, row_id: str, items: str) -> DataFrame:
    """(row id, item) straight from the lists."""
    return df.select(row_id, F.explode(F.array_distinct(F.col(items))).alias("item")).where(~blank("item"))
