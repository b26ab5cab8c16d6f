"""Address components as column expressions over the distinct-address table."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentloom import schema as S
from rentloom.functions.casts import blank, col, filled
from rentloom.functions.text import non_ascii_flag, title_case
from rentloom.operators.aggregates import first_non_blank
from rentloom.operators.scale import skew_join
from rentloom.session import checkpointed


def cut_first(text: Column, part: Column) -> Column:
    """``text`` without the first literal occurrence of ``part``."""
    at = F.position(part, text)
    return F.when((part != "") & (at > 0), F.overlay(text, F.lit(""), at, F.length(part))).otherwise(text)


def find_match(text: Column, pattern: str, last: bool = False) -> Column:
    """The first or last match, '' when there is none."""
    if not last:
        return F.regexp_extract(text, pattern, 0)
    return F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lit(-1)), F.lit(""))


def restore_numbered_street(street: Column, component: Column) -> tuple[Column, Column]:
    """Streets with a number in their name get the full name back and give up the component."""
    for name, full in S.NUMBERED_STREETS.items():
        hit = street.contains(name)
        street, component = F.when(hit, F.lit(full)).otherwise(street), F.when(hit, F.lit("")).otherwise(component)
    return street, component


def extract_component(df: DataFrame, source: str, target: str, pattern: str, last: bool = False, keep: bool = False) -> DataFrame:
    """Move a match from ``source`` to ``target``.

    A filled target keeps its value; the match is cut from the source all the
    same, unless ``keep``. A NULL source leaves the row alone.
    """
    text = F.col(f"`{source}`")
    found = find_match(text, pattern, last)
    rest = F.btrim(cut_first(text, found))
    value = F.when(~blank(target), F.col(f"`{target}`")).otherwise(F.btrim(found))
    if target == S.BUILDING:
        rest, value = restore_numbered_street(rest, value)
    return df.withColumns({
        source: text if keep else F.when(text.isNotNull(), rest),
        target: F.when(text.isNotNull(), value).otherwise(F.col(f"`{target}`")),
    })


COMPONENT_STEPS = [
    (S.STREET, S.BLOCK, S.BLOCK_PATTERN, False, False),
    (S.STREET, S.LANE, S.LANE_PATTERN, False, False),
    (S.STREET, S.BUILDING, S.BUILDING_PATTERN, True, False),
    (S.STREET, S.NEIGHBOURHOOD, S.AREA_PATTERN, False, False),
    (S.STREET, S.STREET_NUMBER, S.ORDINAL, False, False),
    (S.NEIGHBOURHOOD, S.BLOCK, S.BLOCK_PATTERN, False, False),
    (S.TRANSLATED, S.BUILDING, S.BUILDING_PATTERN, True, True),
]


def extract_all_components(df: DataFrame) -> DataFrame:
    """All component steps in their order; each one sees what the one before left over."""
    missing = [c for c in S.ADDRESS_COLUMNS if c not in df.columns]
    df = df.withColumns({c: F.lit("") for c in missing}) if missing else df
    for step in COMPONENT_STEPS:
        df = extract_component(df, *step)
    return df


def split_on_delimiters(text: str | Column, street: str | Column, town: str | Column) -> tuple[Column, Column]:
    """(street, town) from "street, town" or "town › street"; filled values stay, short parts are blank."""
    text = F.coalesce(col(text), F.lit(""))

    def parts(mark: str) -> tuple[Column, Column]:
        at = F.instr(text, mark)
        sides = F.substring(text, F.lit(1), at - 1), F.substring(text, at + 1, F.length(text))
        return tuple(F.when(F.length(F.btrim(s)) >= 3, F.btrim(s)).otherwise("") for s in sides)

    comma, arrow = parts(","), parts("›")
    first = F.when(text.contains(","), comma[0]).when(text.contains("›"), arrow[1]).otherwise("")
    second = F.when(text.contains(","), comma[1]).when(text.contains("›"), arrow[0]).otherwise("")
    return (F.when(blank(street), first).otherwise(col(street)), F.when(blank(town), second).otherwise(col(town)))


def repair_generic_street(street: str | Column, places: Sequence[str | Column]) -> Column:
    """A street equal to a place is no street; a bare "Street" takes the first place's name."""
    text = F.regexp_replace(col(street), S.FILLER, " ")
    names = [filled(p) for p in places]
    is_place = F.greatest(*[F.coalesce(text == n, F.lit(False)) for n in names], F.lit(False))
    first = F.coalesce(*names)
    return (F.when(col(street).isNull() | is_place, F.lit(None).cast("string"))
            .when((text == "Street") & first.isNotNull(), F.concat(first, F.lit(" Street"))).otherwise(text))


PLACE_COLUMNS = [S.TOWN, S.VILLAGE, S.UNIT, S.PROVINCE, S.COUNTRY]


def repair_generic_streets(df: DataFrame, places: Sequence[str] = PLACE_COLUMNS) -> DataFrame:
    return df.withColumn(S.STREET, repair_generic_street(S.STREET, [p for p in places if p in df.columns]))


def _title_words(text: Column) -> Column:
    words = F.split(F.replace(title_case(text), F.lit(","), F.lit("")), rf"[{S.UNICODE_SPACE}]+")
    return F.filter(words, lambda w: w != "")


def _max_distance(a: Column, b: Column, cutoff: int) -> Column:
    """Largest edit distance that still scores at least ``cutoff``."""
    return F.floor((a + b) * F.lit(100 - cutoff) / 100).cast("int")


def similar_pairs(phrases: DataFrame, names: DataFrame, cutoff: int = S.FUZZY_CUTOFF) -> DataFrame:
    """(phrase, name, score) for every pair scoring at least ``cutoff``; both inputs distinct lower case.

    score = 100 (1 - distance / (length a + length b)). Exact without comparing
    all pairs: a name is cut in one more piece than the edits it may take, so a
    similar phrase holds at least one piece unchanged, shifted by no more than
    those edits. Pieces and equally long cuts of the phrases meet in an equi join.
    With a low cutoff a name may take more edits than it has letters; such names
    meet the phrases by length.
    """
    both = F.length("phrase") + F.length("name")
    score = 100 * (1 - F.levenshtein("phrase", "name") / both)
    return _near(phrases, names, cutoff).withColumn("score", score).where(F.col("score") >= cutoff)


def _near(phrases: DataFrame, names: DataFrame, cutoff: int) -> DataFrame:
    """(phrase, name) of all pairs whose edit distance can be small enough for ``cutoff``, and some others."""
    ratio = (200 - cutoff) / cutoff           # longest length a match can have, relative to the name
    size = F.length("name")
    longest = F.floor(size * F.lit(ratio) + F.lit(1e-9)).cast("int")
    cut = names.withColumn("_k", _max_distance(size, longest, cutoff)).withColumn("_w", F.floor(size / (F.col("_k") + 1)).cast("int"))
    spans = F.sequence(F.greatest(F.lit(1), size - F.col("_k")), size + F.col("_k"))
    short = cut.where("_w = 0").select("name", F.explode(spans).alias("_length"))
    cut = cut.where("_w > 0").select("name", "_k", "_w", F.explode(F.sequence(F.lit(0), F.col("_k"))).alias("_i"))
    start = F.col("_i") * F.col("_w") + 1
    width = F.when(F.col("_i") == F.col("_k"), F.length("name") - start + 1).otherwise(F.col("_w"))
    pieces = checkpointed(cut.select("name", "_k", start.alias("_at"), F.substring("name", start, width).alias("_piece")))
    widths = pieces.select(F.collect_set(F.length("_piece")).alias("w")).scalar()
    text = F.col("phrase")
    spots = phrases.select("phrase", widths.alias("_ws")).select("phrase", F.explode("_ws").alias("_w")).where(F.length(text) >= F.col("_w"))
    spots = spots.select("phrase", "_w", F.explode(F.sequence(F.lit(1), F.length(text) - F.col("_w") + 1)).alias("_pos"))
    spots = spots.select("phrase", "_pos", F.substring(text, F.col("_pos"), F.col("_w")).alias("_piece"))
    near = spots.join(pieces, "_piece").where(
        (F.abs(F.col("_pos") - F.col("_at")) <= F.col("_k")) & (F.abs(F.length("phrase") - F.length("name")) <= F.col("_k")))
    by_length = phrases.select("phrase", F.length(text).alias("_length")).join(short, "_length")
    return near.select("phrase", "name").unionByName(by_length.select("phrase", "name")).distinct()


ORDER_FREE = 0.95     # fixed value: what a match of the sorted words counts of a match of the words as they stand


def common_letters(a: str, b: str) -> int:
    """Length of the longest common subsequence; one row of the table is the bits of a number."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _ratio_of(phrase: Column, name: Column) -> Column:
    """100 less the share of letters to be left out or put in, of all letters of both."""
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([200.0 * common_letters(x, y) / (len(x) + len(y)) for x, y in zip(a, b, strict=True)], dtype="float64")

    return ratio(phrase, name)


def _sorted_words(text: str) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(text, " "), lambda w: w != "")), " ")


def ratio_pairs(phrases: DataFrame, names: DataFrame, cutoff: int = S.FUZZY_CUTOFF) -> DataFrame:
    """(phrase, name, score) for every pair scoring at least ``cutoff``; inputs as for :func:`similar_pairs`.

    score = 100 (1 - letters left out or put in / length a + length b), where a
    replaced letter counts twice; or ORDER_FREE of the same for the words in
    sorted order, if that is more. No pair is lost: the edit distance is never
    above the letters left out and put in, so the candidates of an edit distance
    hold all; that distance drops most of the others before letters are matched.
    """

    def scored(phrases: DataFrame, names: DataFrame, least: int) -> DataFrame:
        close = F.levenshtein("phrase", "name") <= _max_distance(F.length("phrase"), F.length("name"), least)
        return _near(phrases, names, least).where(close).withColumn("score", _ratio_of(F.col("phrase"), F.col("name")))

    found = scored(phrases, names, cutoff)
    least = int(cutoff / ORDER_FREE)
    if least < 100:
        by_words = [df.select(c, _sorted_words(c).alias("_f")).where("_f != ''") for df, c in ((phrases, "phrase"), (names, "name"))]
        forms = scored(*[df.select(F.col("_f").alias(c)).distinct() for df, c in zip(by_words, ("phrase", "name"), strict=True)], least)
        forms = forms.select(F.col("phrase").alias("_p"), F.col("name").alias("_n"), (ORDER_FREE * F.col("score")).alias("score"))
        again = forms.join(by_words[0].withColumnRenamed("_f", "_p"), "_p").join(by_words[1].withColumnRenamed("_f", "_n"), "_n")
        found = found.unionByName(again.select("phrase", "name", "score"))
    return found.groupBy("phrase", "name").agg(F.max("score").alias("score")).where(F.col("score") >= cutoff)


def fuzzy_lookup(df: DataFrame, row_id: str, text: str, choices: DataFrame, choice: str, cutoff: int = S.FUZZY_CUTOFF,
                 pairs: Callable[..., DataFrame] = similar_pairs) -> DataFrame:
    """(row id, match): the first word that is a choice, else the best similar run of words, else ''.

    Runs are as long as the choice with the most words, two at least.

    Exact words are found by an equi join. Only rows without one go on; their
    distinct phrases are compared once each, so a frequent phrase costs nothing.
    Ties go to the smaller name. ``pairs`` scores phrases and names:
    :func:`similar_pairs` by edit distance or :func:`ratio_pairs`.
    """
    names = choices.select(F.col(choice).alias("name")).where(~blank("name")).distinct()
    words = df.select(row_id, F.posexplode(_title_words(F.col(f"`{text}`"))).alias("pos", "name"))
    exact = skew_join(words, names.withColumn("_hit", F.lit(True)), ["name"], "inner")
    exact = exact.groupBy(row_id).agg(F.min_by("name", "pos").alias("match"))
    rest = df.join(exact, row_id, "left_anti").select(row_id, F.col(f"`{text}`").alias("_t"))
    lower = F.transform(_title_words(F.col("_t")), lambda w: F.lower(w))
    most = max(2, names.agg(F.max(F.size(F.split(F.trim("name"), r"\s+")))).first()[0] or 2)

    def runs(k: int):
        starts = F.sequence(F.lit(1), F.greatest(F.size(lower) - k + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.array_join(F.slice(lower, i, k), " "))

    phrases = rest.where(F.size(lower) > 0).select(row_id, F.explode(F.array_distinct(F.concat(*map(runs, range(1, most + 1))))).alias("phrase"))
    lowered = names.groupBy(F.lower("name").alias("name")).agg(F.min("name").alias("_proper"))
    similar = pairs(phrases.select("phrase").distinct(), lowered.select("name"), cutoff).join(lowered, "name")
    best = similar.groupBy("phrase").agg(
        F.max("score").alias("score"), F.min_by("_proper", F.struct(-F.col("score"), F.col("_proper"))).alias("_proper"))
    scored = skew_join(phrases, checkpointed(best), ["phrase"], "inner")
    fuzzy = scored.groupBy(row_id).agg(F.min_by("_proper", F.struct(-F.col("score"), F.col("_proper"))).alias("match"))
    found = exact.unionByName(fuzzy)
    return df.select(row_id).join(found, row_id, "left").withColumn("match", F.coalesce("match", F.lit("")))


def resolve_region(df: DataFrame, row_id: str, text: str, provinces: DataFrame, units: DataFrame, localities: DataFrame) -> DataFrame:
    """Fill province and unit from the text and the hierarchy.

    A province guess fills an empty province. A unit guess is kept when it lies
    in the row's province. A missing province follows from the unit, a missing
    unit from the town or village: within the row's province, or where the name
    occurs under one unit only.
    """
    provinces, units, localities = checkpointed(provinces), checkpointed(units), checkpointed(localities)
    province = fuzzy_lookup(df, row_id, text, provinces, "province").withColumnRenamed("match", "_pg")
    unit = fuzzy_lookup(df, row_id, text, units, "unit").withColumnRenamed("match", "_ug")
    out = df.join(province, row_id).join(unit, row_id)
    out = out.withColumn(S.PROVINCE, F.coalesce(filled(S.PROVINCE), F.col("_pg")))
    pairs = units.select(F.col("unit").alias("_ug"), F.col("province").alias(S.PROVINCE)).distinct().withColumn("_ok", F.lit(True))
    out = skew_join(out, pairs, ["_ug", S.PROVINCE])
    out = out.withColumn(S.UNIT, F.coalesce(filled(S.UNIT), F.when(F.col("_ok"), F.col("_ug")), F.lit(""))).drop("_ok", "_pg", "_ug")
    homes = units.groupBy(F.col("unit").alias(S.UNIT)).agg(
        F.when(F.count_distinct("province") == 1, F.min("province")).alias("_home"))
    out = skew_join(out, homes, [S.UNIT])
    out = out.withColumn(S.PROVINCE, F.coalesce(filled(S.PROVINCE), F.col("_home"), F.lit(""))).drop("_home")
    places = [p for p in (S.TOWN, S.VILLAGE) if p in out.columns]
    out = out.withColumn("_place", F.coalesce(*[filled(p) for p in places], F.lit("")))
    one_unit = F.when(F.count_distinct("unit") == 1, F.min("unit"))
    local = localities.groupBy(F.col("locality").alias("_place"), F.col("province").alias(S.PROVINCE)).agg(one_unit.alias("_lu"))
    alone = localities.groupBy(F.col("locality").alias("_place")).agg(one_unit.alias("_au"))
    out = skew_join(skew_join(out, local, ["_place", S.PROVINCE]), alone, ["_place"])
    unit_of_place = F.coalesce("_lu", F.when(blank(S.PROVINCE), F.col("_au")), F.lit(""))
    return out.withColumn(S.UNIT, F.coalesce(filled(S.UNIT), unit_of_place)).drop("_place", "_lu", "_au")


def fill_unit_by_street(df: DataFrame, row_id: str, province: str = S.PROVINCE, street: str = S.STREET, unit: str = S.UNIT) -> DataFrame:
    """A blank unit takes the first unit known for the same province and street; blank streets are no group."""
    grouped = df.where(~blank(street))
    known = checkpointed(first_non_blank(grouped, [province, street], unit, row_id).where("first_value is not null"))
    out = skew_join(df, known, [province, street])
    return out.withColumn(unit, F.coalesce(filled(unit), F.col("first_value"), F.lit(""))).drop("first_value")


def select_untranslated(df: DataFrame, text: str = S.ADDRESS) -> DataFrame:
    return df.select(text).where(non_ascii_flag(text)).distinct()


def _weights(texts: Sequence[str]) -> list[int]:
    return [len(json.dumps(t, ensure_ascii=False).encode("utf-8")) for t in texts]


def _range_summary(items: int, size: int):
    """What a range of texts does to the batch that is open when it is entered, one row per way to enter it.

    An open batch takes fewer than ``items`` texts of the range before a new one
    begins, so that is how many places there are where the range's first new
    batch can begin. For each the row has the bytes before it and of its first
    text, the batches begun from there on, and for the last of them its texts,
    its bytes and how many texts that go alone came before it. ``place`` -1 is a
    range without other texts.
    """
    columns = ["part", "place", "before", "first", "items", "used", "begun", "alone_at", "alone"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, total, alone = [], 0, 0
        count, used, begun, alone_at = (np.zeros(items, np.int64) for _ in range(4))     # one entry per place; those in use come first
        for frame in frames:
            for weight in _weights(frame["_t"]):
                if weight > size:
                    alone += 1
                    continue
                n = len(weights)
                full = (count[:n] >= items) | (used[:n] + weight > size)
                count[:n] = np.where(full, 1, count[:n] + 1)
                used[:n] = np.where(full, weight, used[:n] + weight)
                begun[:n] += full
                alone_at[:n] = np.where(full, alone, alone_at[:n])
                if n < items:
                    count[n], used[n], begun[n], alone_at[n] = 1, weight, 1, alone
                    weights.append(weight)
        part, n = TaskContext.get().partitionId(), len(weights)
        if not n:
            yield pd.DataFrame([(part, -1, 0, 0, 0, 0, 0, 0, alone)], columns=columns)
            return
        before = np.cumsum(weights) - weights
        yield pd.DataFrame(dict(zip(columns, (part, np.arange(n), before, weights, count[:n], used[:n], begun[:n], alone_at[:n], alone), strict=True)))

    return run


def _entries(rows: Sequence, items: int, size: int) -> dict[int, tuple[int, int, int, int]]:
    """For every range: texts, bytes and number of the batch that is open when it is entered, and the next number."""
    by_part: dict[int, list] = {}
    for row in sorted(rows, key=lambda r: (r["part"], r["place"])):
        by_part.setdefault(row["part"], []).append(row)
    entries, count, used, own, number = {}, 0, 0, -1, 0
    for part, ways in by_part.items():
        entries[part] = (count, used, own, number)
        alone = ways[0]["alone"]
        ways = [r for r in ways if r["place"] >= 0]
        new = next((r for r in ways if not count or count + r["place"] >= items or used + r["before"] + r["first"] > size), None)
        if new is not None:
            count, used, own = new["items"], new["used"], number + new["begun"] - 1 + new["alone_at"]
            number += new["begun"]
        elif ways:                  # the whole range goes into the batch that is open
            count, used = count + len(ways), used + ways[-1]["before"] + ways[-1]["first"]
        number += alone
    return entries


def pack_batches(df: DataFrame, text: str, items: int = S.BATCH_ITEMS, size: int = S.BATCH_BYTES) -> DataFrame:
    """Greedy batches of the sorted texts, limited by item count and JSON bytes: (batch_no, texts).

    A text over the byte limit goes alone. The batches are those of one packer
    that walks over all texts, whatever the partitions are: ranges of the sorted
    texts are summed up by what they do to any batch they may be entered with,
    the summaries are chained, then all ranges are packed side by side and a
    batch that reaches over a border is put together. Batches are numbered from
    0 in the order of their first texts; missing texts are left out and equal
    ones may lie in several ranges. The driver gets at most ``items`` rows of a
    range.
    """
    texts = df.select(F.col(text).alias("_t")).where("_t IS NOT NULL").withColumn("_s", F.monotonically_increasing_id())
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = checkpointed(texts.repartitionByRange(parts, "_t", "_s").sortWithinPartitions("_t", "_s").select("_t"))
    summary = ranges.mapInPandas(_range_summary(items, size), ", ".join(
        f"{c} long" for c in ("part", "place", "before", "first", "items", "used", "begun", "alone_at", "alone")))
    entries = _entries(summary.collect(), items, size)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        count, used, own, number = entries.get(part, (0, 0, -1, 0))
        held: list[str] = []
        for frame in frames:
            ready = []
            for value, weight in zip(frame["_t"], _weights(frame["_t"]), strict=True):
                if weight > size:
                    ready.append((number, part, [value]))
                    number += 1
                elif not count or count >= items or used + weight > size:
                    if held:
                        ready.append((own, part, held))
                    own, number = number, number + 1
                    count, used, held = 1, weight, [value]
                else:
                    count, used = count + 1, used + weight
                    held.append(value)
            yield pd.DataFrame(ready, columns=["batch_no", "part", "texts"])
        yield pd.DataFrame([(own, part, held)] if held else [], columns=["batch_no", "part", "texts"])

    packed = ranges.mapInPandas(pack, "batch_no long, part int, texts array<string>")
    joined = packed.groupBy("batch_no").agg(F.sort_array(F.collect_list(F.struct("part", "texts"))).alias("_p"))
    return joined.select("batch_no", F.flatten(F.transform("_p", lambda p: p["texts"])).alias("texts"))
