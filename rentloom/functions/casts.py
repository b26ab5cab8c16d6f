"""Cell-level casts as Column builders; all stay inside generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from rentloom.schema import BAND_EDGES, BAND_LABELS, DATE_FORMATS

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def col(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def blank(c: str | Column) -> Column:
    """True for NULL and for text of spaces only."""
    c = col(c)
    return c.isNull() | (F.trim(c.cast("string")) == "")


def filled(c: str | Column) -> Column:
    """The trimmed text, or NULL when blank."""
    return F.nullif(F.trim(col(c).cast("string")), F.lit(""))


def to_number(c: str | Column) -> Column:
    """Number or NULL; text such as ``12d`` is no number although Java would read it as one."""
    text = col(c).cast("string")
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def number_or_zero(c: str | Column) -> Column:
    return F.coalesce(to_number(c), F.lit(0.0))


def text_or_blank(c: str | Column) -> Column:
    return F.coalesce(F.trim(col(c).cast("string")), F.lit(""))


_SHAPES = {"yyyy": r"\d{4}", "MMMM": "[A-Za-z]+", "MMM": "[A-Za-z]{3}", "d": r"\d{1,2}", "M": r"\d{1,2}"}


def _shape(fmt: str) -> str:
    """A pattern of the texts a date format can read."""
    parts = re.findall(r"'[^']*'|([A-Za-z])(\1*)|(.)", fmt.replace("'T'", "\u0001"))
    return "^" + "".join(
        _SHAPES.get(a + b, r"\d{2}") if a else re.escape(other).replace("\u0001", "T") for a, b, other in parts) + "$"


def parse_date(c: str | Column, formats: list[str] = DATE_FORMATS) -> Column:
    """Mixed-format, day-first date; the first format that reads the whole text wins.

    A format is only tried on text of its shape: a failed attempt costs far more
    than a pattern test. Fractions of a second and a time zone behind a clock
    time are left out: the date is the one that is written. Years of two digits
    lie between 1969 and 2068.
    """
    text = F.regexp_replace(F.trim(col(c)), r"(:\d{2})(\.\d+)?\s*(Z|[+-]\d{2}:?\d{2})?$", "$1")
    for years, century in (("69|[7-9]\\d", 19), ("[0-5]\\d|6[0-8]", 20)):
        text = F.regexp_replace(text, rf"^(\d{{1,2}}[/.]\d{{1,2}}[/.])({years})$", f"$1{century}$2")
    return F.coalesce(*[F.when(text.rlike(_shape(f)), F.to_date(F.try_to_timestamp(text, F.lit(f)))) for f in formats])


def flag_default(c: str | Column) -> Column:
    """Missing is False; the words false, no, f, n and 0 are False; any other text is True."""
    text = F.lower(F.trim(col(c).cast("string")))
    return F.coalesce(~text.isin("", "false", "no", "f", "n", "0", "0.0"), F.lit(False))


def truthy(c: str | Column) -> Column:
    """False when blank, missing, "0" or "not available" in any case; else True."""
    text = col(c).cast("string")
    return F.coalesce(~text.rlike(r"(?i)^(\s*|0|not available)$"), F.lit(False))


def band(c: str | Column, edges: list[float] = BAND_EDGES, labels: list[str] = BAND_LABELS) -> Column:
    """Right-closed bins; the last one is open above, values at or below the first edge are NULL."""
    c = col(c)
    out = F.when(c <= edges[0], F.lit(None).cast("string"))
    for upper, label in zip(edges[1:], labels):
        out = out.when(c <= upper, F.lit(label))
    return out.when(c.isNotNull() & ~F.isnan(c.cast("double")), F.lit(labels[-1]))


def flag_equals(c: str | Column, value: str) -> Column:
    """``c == value`` as a boolean that is False for missing cells."""
    return F.coalesce(col(c) == value, F.lit(False))


def blank_to_null(c: str | Column, dtype: str = "string") -> Column:
    """Blank text and NaN become NULL; other cells are kept as they are."""
    c = col(c)
    if dtype == "string":
        return F.when(c != "", c)
    if dtype in ("double", "float"):
        return F.when(~F.isnan(c), c)
    return c
