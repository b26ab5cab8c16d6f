"""Golden rows of the text rules, and a comparison with Python's own Unicode functions."""

import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from rentloom import schema as S
from rentloom.functions import text as T
from rentloom.operators import address as A


def one(spark, build, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


def test_title_case(spark):
    assert one(spark, T.title_case, "2nd 123a main", "o'brien x-y", "a1b2") == ["2Nd 123A Main", "O'Brien X-Y", "A1B2"]


def test_filler_rule(spark):
    assert one(spark, lambda c: F.regexp_replace(c, S.FILLER, " "), "Nonesuch_x  y") == [" such x y"]


def test_normalize_text(spark):
    got = one(spark, T.normalize_text, "  Çafé_du  Nord-Ouest, N°5 ", None, "none", "ﬁne ½ ™", "Straße x")
    assert got == ["Cafe Du NordOuest N5".replace("NordOuest", "Nordouest"), "", "", "Fine 12 Tm", "Strae X"]


def test_strip_accents_equals_unicode_decomposition(spark):
    points = [p for p in range(1, 0x3100) if not 0xD800 <= p < 0xE000] + list(range(0xFB00, 0xFB50)) + list(range(0x1D400, 0x1D500)) + [0x1F110]
    texts = ["".join(map(chr, points[i:i + 50])) for i in range(0, len(points), 50)]
    expected = [unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts]
    assert one(spark, T.strip_accents, *texts) == expected


def test_script_flag(spark):
    assert one(spark, T.non_ascii_flag, "abc", "улица", "A › улица") == [False, True, False]


def test_ordinals_and_areas(spark):
    assert one(spark, T.compact_ordinals, "2-nd 3 rd") == ["2nd 3 rd"]
    assert one(spark, T.ordinalize_areas, "1 Quarter, 12 quarter", "21-district 101  micro", "011 quarter 0 quarter") == [
        "1st Quarter, 12th quarter", "21st district 101st micro", "11th quarter 0th quarter"]


def test_codes_and_abbreviations(spark):
    assert one(spark, T.join_codes, "123 A", "123 AB") == ["123A", "123 AB"]
    assert one(spark, T.expand_abbreviations, "Abovyan St. 5, st", "Blok 3 hwy ave") == ["Abovyan Street. 5, Street", "Block 3 Highway Avenue"]


def test_normalize_address(spark):
    got = one(spark, T.normalize_address, "12/3 abovyan ST, 2-ND lane", "улица 5", "A › 1 quarter", None)
    assert got == ["12/3 Abovyan Street, 2ND Lane", "", "A › 1st Quarter", ""]


@pytest.mark.parametrize("text, building, rest", [
    ("Abovyan Street 12/3a", "12/3a", "Abovyan Street"),
    ("2nd Lane 5", "5", "2nd Lane"),
    ("August 23 Street 7", "", "August 23 Street"),
    ("Street 1234", "", "Street 1234"),
    ("2-nd Lane", "", "2-nd Lane"),
    ("5 Main 5", "5", "Main 5"),
])
def test_building_is_the_last_match_and_the_first_occurrence_goes(spark, text, building, rest):
    df = spark.createDataFrame([(text, "")], [S.STREET, S.BUILDING])
    row = A.extract_component(df, S.STREET, S.BUILDING, S.BUILDING_PATTERN, last=True).first()
    assert (row[S.BUILDING], row[S.STREET]) == (building, rest)


def test_filled_target_is_kept_but_the_source_is_cut(spark):
    df = spark.createDataFrame([("Ani 3rd Block Main", "B7"), (None, "x")], "`Street` string, `Block` string")
    rows = A.extract_component(df, S.STREET, S.BLOCK, S.BLOCK_PATTERN).collect()
    assert [tuple(r) for r in rows] == [("Main", "B7"), (None, "x")]


def test_components_in_order(spark):
    df = spark.createDataFrame([("Davidashen 3rd Block 2nd Lane Abovyan 12 4th", "x")], [S.STREET, S.TRANSLATED])
    row = A.extract_all_components(df).first()
    assert row[S.BLOCK] == "Davidashen 3rd Block"
    assert row[S.LANE] == "2nd Lane"
    assert row[S.BUILDING] == "12"
    assert row[S.STREET_NUMBER] == "4th"
    assert row[S.STREET] == "Abovyan"


def test_split_on_delimiters(spark):
    rows = [("Main, Ani", "", ""), ("Ani › Main", None, " "), ("ab, Town", "", ""), ("a, b, c d", "", ""), ("x, Yes", "Old", "")]
    df = spark.createDataFrame(rows, "t string, s string, w string")
    street, town = A.split_on_delimiters("t", "s", "w")
    assert [tuple(r) for r in df.select(street, town).collect()] == [
        ("Main", "Ani"), ("Main", "Ani"), ("", "Town"), ("", "b, c d"), ("Old", "Yes")]


def test_generic_streets(spark):
    rows = [("Abovyan", "Abovyan", None), ("Street", "", "Kotayk"), ("Main_Street", "x", "y"), (None, "x", "y")]
    df = spark.createDataFrame(rows, "`Street` string, `Town` string, `Province` string")
    got = [r[0] for r in A.repair_generic_streets(df, [S.TOWN, S.PROVINCE]).select(S.STREET).collect()]
    assert got == [None, "Kotayk Street", "Main Street", None]


def test_fuzzy_lookup(spark):
    choices = spark.createDataFrame([("Kentron",), ("Nor Nork",), ("Avan",)], ["name"])
    texts = ["7 Main, kentron", "7 Kentrn", "Nor Nrk 5", "Avan Kentron", "nothing", "avam"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["match"] for r in A.fuzzy_lookup(df, "i", "t", choices, "name").collect()}
    assert got == {0: "Kentron", 1: "Kentron", 2: "Nor Nork", 3: "Avan", 4: "", 5: ""}


def test_pack_batches_limits(spark):
    texts = [f"текст {i} " + "ы" * (i % 700) for i in range(1500)] + ["я" * 40_000]
    df = spark.createDataFrame([(t,) for t in texts], ["t"]).repartition(3)
    rows = A.pack_batches(df, "t").collect()
    size = [sum(len(x.encode()) + 2 for x in r["texts"]) for r in rows]
    assert sorted(x for r in rows for x in r["texts"]) == sorted(texts)
    assert all(len(r["texts"]) <= S.BATCH_ITEMS for r in rows)
    assert all(s <= S.BATCH_BYTES or len(r["texts"]) == 1 for s, r in zip(size, rows))
    assert sorted(r["batch_no"] for r in rows) == list(range(len(rows)))


def _packed_one_by_one(texts, items, size):
    batches, opened, used = [], None, 0
    for t in sorted(texts, key=lambda t: t.encode()):
        weight = len(json.dumps(t, ensure_ascii=False).encode())
        if weight > size:
            batches.append([t])
        elif opened is None or len(opened) >= items or used + weight > size:
            opened, used = [t], weight
            batches.append(opened)
        else:
            opened.append(t)
            used += weight
    return batches


@pytest.mark.parametrize("items, size", [(7, 60), (50, 40)])
def test_batches_are_the_same_on_any_number_of_partitions(spark, items, size):
    rng = random.Random(items)
    texts = ["".join(rng.choices("ab\"\\é日", k=rng.randint(0, 30))) for _ in range(400)] + ["same"] * 60 + ["long" * 60] * 3
    want = _packed_one_by_one(texts, items, size)
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 2, 8):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").repartition(parts)
            assert [r.texts for r in A.pack_batches(df, "t", items, size).orderBy("batch_no").collect()] == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert A.pack_batches(spark.createDataFrame([], "t string"), "t").collect() == []


def _ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return 200.0 * row[-1] / (len(a) + len(b))


def test_ratio_pairs_equal_all_pairs(spark):
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdé", k=rng.randint(2, 7))) for _ in range(40)]
    names = sorted({" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(60)})

    def changed(n):
        at, kind = rng.randrange(len(n)), rng.randrange(4)
        if kind == 3:
            return " ".join(reversed(n.split()))
        return n[:at] + ("" if kind == 0 else "e") + n[at + (kind != 1):]
    phrases = sorted({changed(rng.choice(names)) for _ in range(150)} - {""})
    p, n = (spark.createDataFrame([(x,) for x in v], f"{c} string") for v, c in ((phrases, "phrase"), (names, "name")))
    for cutoff in (90, 70):
        want = {}
        for a in phrases:
            for b in names:
                score = max(_ratio(a, b), 0.95 * _ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))) if a.split() else 0)
                if score >= cutoff:
                    want[a, b] = pytest.approx(score)
        assert {(r.phrase, r.name): r.score for r in A.ratio_pairs(p, n, cutoff).collect()} == want and want
    rows = spark.createDataFrame([(1, "Old kentrn road"), (2, "nothing here")], "id int, t string")
    choice = spark.createDataFrame([("Kentron",), ("Arabkir",)], "c string")
    assert {r.id: r.match for r in A.fuzzy_lookup(rows, "id", "t", choice, "c", pairs=A.ratio_pairs).collect()} == {1: "Kentron", 2: ""}
