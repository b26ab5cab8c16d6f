"""Golden rows of casts, money, geography, lists and the small formulas."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from rentloom import schema as S
from rentloom.functions import casts, geo
from rentloom.functions.probability import correlation_p_value, normal_two_sided_p
from rentloom.operators import lists as L
from rentloom.operators import stats as M
from rentloom.operators.joins import monthly_usd_price
from rentloom.operators.scale import exact_quantiles
from rentloom.sources.listings import majority_types, numeric_shares, read_listings, stack
from rentloom.sources.reference_data import read_hierarchy, read_rates
from rentloom.sources.stages import stage, write_stage


def column(spark, build, values, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(build("v")).collect()]


def test_quantile_golden(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,), (100.0,)], "v double")
    row = exact_quantiles(df, "v", [0.01, 0.99]).first()
    assert (row["n"], round(row["q0"], 9), round(row["q1"], 9)) == (5, 1.04, 96.16)


def test_band(spark):
    assert column(spark, casts.band, [0.0, -1.0, 800.0, 800.01, 2000.0, 2001.0, None], "double") == [
        None, None, "Cheap", "Affordable", "Affordable", "Expensive", None]


def test_flags(spark):
    assert column(spark, casts.truthy, ["", "0", "Not Available", "Yes", None, "  "]) == [False, False, False, True, False, False]
    assert column(spark, casts.flag_default, ["False", "true", None, "", "0", "x"]) == [False, True, False, False, False, True]


def test_numbers(spark):
    assert column(spark, casts.to_number, ["1", " 2.5 ", "12d", "1f", "1e3", "x", None, "-.5"]) == [1.0, 2.5, None, None, 1000.0, None, None, -0.5]


def test_majority_boundary(spark):
    df = spark.createDataFrame([("1", "1"), ("2", "2"), ("3", "3"), ("4", "4"), ("x", "5")], "a string, b string")
    assert majority_types(df) == (["b"], ["a"])
    third = spark.createDataFrame([("1",), ("x",), (None,)], "a string")
    assert numeric_shares(third).first()["share"] == pytest.approx(1 / 3)


def test_dates(spark):
    got = column(spark, casts.parse_date, ["2022-11-24", "24/11/2022", "03/04/2023", "soon", None, "1.2.2023"])
    assert got == [dt.date(2022, 11, 24), dt.date(2022, 11, 24), dt.date(2023, 4, 3), None, None, dt.date(2023, 2, 1)]
    forms = ["Nov 24, 2022", "24/11/22", "24-Nov-2022", "2022.11.24", "20221124", "2022-11-24T23:30:00Z", "2022-11-24 10:00:00.5+04:00"]
    assert column(spark, casts.parse_date, forms) == [dt.date(2022, 11, 24)] * len(forms)
    assert column(spark, casts.parse_date, ["1/2/95", "1.2.68"]) == [dt.date(1995, 2, 1), dt.date(2068, 2, 1)]


def test_monthly_usd(spark):
    day = dt.date(2022, 11, 24)
    df = spark.createDataFrame(
        [(1, day, 10.0, "AMD", "Daily"), (2, day, 10.0, "USD", "Monthly"), (3, day, 10.0, "XXX", "Monthly"), (4, None, 10.0, "EUR", "Monthly")],
        "i int, `Date` date, `Price` double, `Currency` string, `Duration` string")
    rates = spark.createDataFrame([(day, "AMD", 393.20), (day, "EUR", 0.96)], "`Date` date, `Currency` string, `USD` double")
    got = {r["i"]: r[S.MONTHLY_USD_PRICE] for r in monthly_usd_price(df, rates).collect()}
    assert got[1] == pytest.approx(0.76297, abs=1e-5)
    assert got[2] == 10.0
    assert got[3] is None and got[4] is None


def test_distance(spark):
    df = spark.createDataFrame([(40.7894, 43.8475)], "a double, b double")
    assert df.select(geo.distance_km("a", "b")).first()[0] == pytest.approx(87.410, abs=5e-4)


def test_one_hot(spark):
    df = spark.createDataFrame([(1, "Fridge, fridge"), (2, None), (3, "Oven,none")], "i int, c string").withColumn("items", L.split_clean_list("c"))
    wide = L.one_hot_list(df, "items", "2_")
    assert sorted((r["i"], r["2_Fridge"], r["2_Oven"]) for r in wide.collect()) == [(1, 2, 0), (2, 0, 0), (3, 0, 1)]
    assert sorted(tuple(r) for r in L.melt_bridge(wide, "i", "2_").collect()) == [(1, "Fridge"), (3, "Oven")]
    assert sorted(tuple(r) for r in L.melt_bridge(wide, "i", "9_").collect()) == []
    assert sorted(tuple(r) for r in L.bridge(df, "i", "items").collect()) == [(1, "Fridge"), (3, "Oven")]


def test_amenities_lose_parking_space(spark):
    df = spark.createDataFrame([("a, parking_space, nan",)], "c string")
    assert df.select(L.split_clean_list("c", S.AMENITIES)).first()[0] == ["A"]


def test_key_lists(spark):
    df = spark.createDataFrame([(1, "['A0', 'B3']"), (2, "A7"), (3, "[]")], "i int, k string")
    assert sorted((r["i"], r["k"] or "") for r in L.explode_keys(df, "k").collect()) == [(1, "A0"), (1, "B3"), (2, "A7"), (3, "")]


def test_fisher_interval(spark):
    df = spark.createDataFrame([(0.5, 100), (1.0, 100), (0.5, 3)], "r double, n int")
    lo, hi = M.fisher_ci("r", "n")
    rows = df.select(lo.alias("lo"), hi.alias("hi")).collect()
    assert rows[0]["lo"] == pytest.approx(0.3366, abs=1e-4)
    assert rows[1]["lo"] is None and rows[2]["hi"] is None


def test_probabilities(spark):
    # Table values of the t and the normal distribution.
    t = 2.228
    assert correlation_p_value(t / math.sqrt(t * t + 10), 12) == pytest.approx(0.05, abs=1e-4)
    t = 3.169
    assert correlation_p_value(t / math.sqrt(t * t + 10), 12) == pytest.approx(0.01, abs=1e-4)
    df = spark.createDataFrame([(1.959964,), (2.575829,)], "z double")
    assert [round(r[0], 6) for r in df.select(normal_two_sided_p("z")).collect()] == [0.05, 0.01]


def test_rates_and_hierarchy_files(spark, tmp_path):
    (tmp_path / "rates.json").write_text('{"2022-11-24": {"USD": 1.0,\n "AMD": 393.2}, "2022-12-15": {"USD": 1}}')
    rows = sorted((str(r[0]), r[1], r[2]) for r in read_rates(spark, str(tmp_path / "rates.json")).collect())
    assert rows == [("2022-11-24", "AMD", 393.2), ("2022-11-24", "USD", 1.0), ("2022-12-15", "USD", 1.0)]
    (tmp_path / "h.json").write_text('{"Y": ["a", "b"],\n "A": {"M": {"x": "V"}, "N": {"x": "C"}}}')
    found = read_hierarchy(spark, str(tmp_path / "h.json"))
    assert sorted(tuple(r) for r in found.units.collect()) == [("M", "A"), ("N", "A"), ("a", "Y"), ("b", "Y")]
    assert sorted(tuple(r) for r in found.localities.collect()) == [("x", "M", "A"), ("x", "N", "A")]
    assert sorted(r[0] for r in found.provinces.collect()) == ["A", "Y"]


def test_csv_with_line_breaks_marks_and_gaps(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('﻿id,text,n\n1,"a\nb ""q""",NA\n2,,nan\n', encoding="utf-8")
    rows = [tuple(r) for r in read_listings(spark, str(path)).collect()]
    assert rows == [("1", 'a\nb "q"', None), ("2", None, None)]


def test_stage_is_reused_and_refreshed(spark, tmp_path):
    path, calls = str(tmp_path / "stage"), []

    def build():
        calls.append(1)
        return spark.range(len(calls))

    assert stage(spark, path, build).count() == 1
    assert stage(spark, path, build).count() == 1 and len(calls) == 1
    assert stage(spark, path, build, refresh=True).count() == 2


def test_csv_stage_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'x "y", z')], "i int, t string")
    back = read_listings(spark, write_stage(df, str(tmp_path / "c"), "csv"))
    assert [tuple(r) for r in back.collect()] == [("1", 'x "y", z')]


def test_stack_fills_missing_columns(spark):
    out = stack(spark.range(1).withColumn("a", F.lit(1)), spark.range(1).withColumn("b", F.lit(2)))
    assert sorted(map(str, out.collect())) == ["Row(id=0, a=1, b=None)", "Row(id=0, a=None, b=2)"]
