"""Text normalisation as Column builders: no Python runs on the rows."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from rentloom import schema as S
from rentloom.functions.casts import col

NON_ASCII = r"[^\x00-\x7F]"


def _ascii_forms() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility decomposition has ASCII in it: one letter, several letters."""
    single, several = {}, {}
    for point in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= point < 0xE000:
            continue
        form = unicodedata.normalize("NFKD", chr(point)).encode("ascii", "ignore").decode()
        if form:
            (single if len(form) == 1 else several)[chr(point)] = form
    return single, several


_SINGLE, _SEVERAL = _ascii_forms()
_SEVERAL_TEXT = "\u0001".join(f"{char}\u0002{form}" for char, form in _SEVERAL.items())


def once(c: Column, build) -> Column:
    """``build(c)`` with ``c`` computed once per row although ``build`` names it several times."""
    return F.element_at(F.transform(F.array(c), build), 1)


def strip_accents(c: str | Column) -> Column:
    """Compatibility decomposition reduced to ASCII, from built-in expressions only.

    ASCII text passes untouched. Only text that holds one of the rare characters
    with a longer form, such as a ligature, takes the per-character branch.
    """
    def reduce_text(text: Column) -> Column:
        letters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
        table = F.str_to_map(F.lit(_SEVERAL_TEXT), F.lit("\u0001"), F.lit("\u0002"))   # folded to a constant
        longer = F.array_join(F.transform(letters, lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), "")
        has_longer = F.translate(text, "".join(_SEVERAL), "") != text
        plain = F.translate(F.when(has_longer, longer).otherwise(text), "".join(_SINGLE), "".join(_SINGLE.values()))
        return F.when(text.rlike(NON_ASCII), F.regexp_replace(plain, NON_ASCII, "")).otherwise(text)

    return once(col(c), reduce_text)


def title_case(c: str | Column) -> Column:
    """Upper-case every letter that follows no letter; ``initcap`` alone misses those after digits."""
    mark = "\u0001 "
    split = F.regexp_replace(F.lower(col(c)), r"(?<=[^a-z ])(?=[a-z])", mark)
    return F.replace(F.initcap(split), F.lit(mark), F.lit(""))


def normalize_text(c: str | Column) -> Column:
    """Fillers to spaces, ASCII only, no punctuation, trimmed, title case; NULL gives ''."""
    c = F.regexp_replace(col(c), S.FILLER, " ")
    c = F.regexp_replace(strip_accents(c), r"[^\w\s]", "")
    return F.coalesce(title_case(F.btrim(c)), F.lit(""))


def non_ascii_flag(c: str | Column) -> Column:
    """True when the text needs translation: it has a non-ASCII character and no '›'."""
    c = col(c)
    return c.rlike(NON_ASCII) & ~c.contains("›")


def compact_ordinals(c: str | Column) -> Column:
    return F.regexp_replace(col(c), S.ORDINAL, "$1$2")


def ordinalize_areas(c: str | Column) -> Column:
    """``1 quarter`` becomes ``1st quarter``; numbers ending in 10 to 20 take ``th``.

    One replacement per suffix: a last digit 1, 2 or 3 counts unless a 1 precedes it.
    """
    out = col(c)
    area = rf"[\s\-]*({S.AREA_SUFFIX})\b"
    for last, suffix in (("1", "st"), ("2", "nd"), ("3", "rd")):
        out = F.regexp_replace(out, rf"(?i)\b0*((?:\d*[02-9])?{last}){area}", f"$1{suffix} $2")
    return F.regexp_replace(out, rf"(?i)\b0*(\d+){area}", "$1th $2")


def join_codes(c: str | Column) -> Column:
    return F.regexp_replace(col(c), S.CODE_WITH_LETTER, "$1$2")


def expand_abbreviations(c: str | Column) -> Column:
    out = F.regexp_replace(col(c), S.STREET_WORD, "Street")
    out = F.regexp_replace(out, S.HIGHWAY_WORD, "Highway")
    out = F.regexp_replace(out, S.AVENUE_WORD, "Avenue")
    return F.replace(out, F.lit("Blok"), F.lit("Block"))


def capitalize_words(c: str | Column) -> Column:
    """First letter up, the rest down, words split on white space; ordinals keep their case."""
    words = F.filter(F.split(col(c), rf"[{S.UNICODE_SPACE}]+"), lambda w: w != "")
    cased = F.transform(words, lambda w: F.when(w.rlike("^" + S.ORDINAL.replace("(?i)", "(?i:") + ")"), w)
                        .otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))))
    return F.array_join(cased, " ")


def normalize_address(c: str | Column) -> Column:
    """The whole address clean-up; text in another script becomes ''."""
    spaced = F.regexp_replace(col(c), S.FILLER, " ")
    out = join_codes(ordinalize_areas(compact_ordinals(spaced)))
    out = capitalize_words(expand_abbreviations(out))
    return F.when(spaced.isNull() | non_ascii_flag(spaced), F.lit("")).otherwise(out)


def address_key(c: str | Column) -> Column:
    """The form two spellings of one address share: trimmed lower case."""
    return F.lower(F.trim(col(c)))
