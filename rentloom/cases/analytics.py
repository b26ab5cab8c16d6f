"""Geography, statistics, profiles and reports over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentloom import schema as S
from rentloom.cases.registry import case
from rentloom.cases.tables import LISTING, listings, table
from rentloom.functions.geo import boxes_at, distance_km, place_label
from rentloom.operators import clusters as C
from rentloom.operators import spellings
from rentloom.operators import profile as P
from rentloom.operators import stats as M
from rentloom.operators.model import evaluate
from rentloom.plans.reports import MONTHLY, duration_matrix, duration_tests, named_reports, rank_matrix, rank_profiles, with_monthly_flag

PLACE = [S.PROVINCE, S.UNIT]


def r(c, digits=6):
    return F.round(c, digits)


def priced(spark, sf) -> DataFrame:
    """Listings with every column the reports use; the price stands for the monthly USD price."""
    ranks = (F.col(S.ROW_ID) % 4, F.floor(S.PRICE) % 3, F.col(S.FLOOR_AREA) % 5)
    return listings(spark, sf).withColumns({
        S.MONTHLY_USD_PRICE: F.col(S.PRICE), **{name: c.cast("double") for name, c in zip(S.FAMILY_RANK.values(), ranks)}})


# --- geography -----------------------------------------------------------------------------------------

DISTANCE_SQL = ("2 * 6371.009 * asin(sqrt(pow(sin((radians(lat) - radians(40.1792)) / 2), 2) + cos(radians(lat)) * cos(radians(40.1792)) "
                "* pow(sin((radians(lon) - radians(44.4991)) / 2), 2)))")


@case("distance_km", f"WITH {LISTING} SELECT id, round({DISTANCE_SQL}, 6) AS km FROM listing")
def distance_query(spark, sf):
    return listings(spark, sf).select(F.col(S.ROW_ID).alias("id"), r(distance_km(S.LATITUDE, S.LONGITUDE)).alias("km"))


@case("place_label", f"WITH {LISTING} SELECT id, province || ' – ' || district AS place FROM listing")
def place_label_query(spark, sf):
    return listings(spark, sf).select(F.col(S.ROW_ID).alias("id"), place_label(S.PROVINCE, S.UNIT).alias("place"))


@case("density_grid", f"""
WITH {LISTING} SELECT floor(lat / 0.1)::BIGINT AS lat_cell, floor(lon / 0.1)::BIGINT AS lon_cell, round(sum(price), 2) AS weight, count(*) AS points
FROM listing WHERE id % 7 <> 0 GROUP BY 1, 2""")
def density_grid(spark, sf):
    cells = listings(spark, sf).withColumn(S.LATITUDE, F.when(F.col(S.ROW_ID) % 7 == 0, "n/a").otherwise(F.col(S.LATITUDE).cast("string")))
    cells = cells.withColumns({S.LONGITUDE: F.col(S.LONGITUDE).cast("string"), S.PRICE: F.col(S.PRICE).cast("string")})
    return P.density_grid(cells, S.LATITUDE, S.LONGITUDE, S.PRICE, 0.1).withColumn("weight", r("weight", 2))


@case("within_bbox", f"""
WITH {LISTING}, boxes(box, w, s, e, n) AS (VALUES ('Armenia', 43.58, 38.74, 46.51, 41.25), ('Georgia', 39.96, 41.06, 46.64, 43.55), ('Azerbaijan', 44.79, 38.27, 50.39, 41.86))
SELECT id, box FROM listing JOIN boxes ON lon BETWEEN w AND e AND lat BETWEEN s AND n""")
def within_bbox(spark, sf):
    return P.within_bbox(listings(spark, sf), S.LATITUDE, S.LONGITUDE).select(F.col(S.ROW_ID).alias("id"), "box")


@case("outside_all_boxes", f"""
WITH {LISTING} SELECT count(*) AS rows FROM listing WHERE NOT (lon BETWEEN 43.58 AND 46.51 AND lat BETWEEN 38.74 AND 41.25)
AND NOT (lon BETWEEN 39.96 AND 46.64 AND lat BETWEEN 41.06 AND 43.55) AND NOT (lon BETWEEN 44.79 AND 50.39 AND lat BETWEEN 38.27 AND 41.86)""")
def outside_all_boxes(spark, sf):
    gone = listings(spark, sf).where(F.size(boxes_at(S.LATITUDE, S.LONGITUDE)) == 0)
    return gone.agg(F.count(F.lit(1)).alias("rows"))


# --- statistics ------------------------------------------------------------------------------------------

@case("pearson", "SELECT round(corr(l_quantity, l_extendedprice), 9) AS r, count(*) AS n FROM lineitem")
def pearson(spark, sf):
    return M.pearson(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").select(r("r", 9).alias("r"), "n")


def _rank_sql(column: str) -> str:
    return f"rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0"


@case("spearman", f"""
WITH k AS (SELECT {_rank_sql('l_quantity')} AS a, {_rank_sql('l_extendedprice')} AS b FROM lineitem)
SELECT round(corr(a, b), 9) AS r, count(*) AS n FROM k""")
def spearman(spark, sf):
    return M.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").select(r("r", 9).alias("r"), "n")


@case("spearman_with_gaps", f"""
WITH t AS (SELECT user_id, value FROM events WHERE event_type <> 'error'), k AS (SELECT {_rank_sql('user_id')} AS a, {_rank_sql('value')} AS b FROM t)
SELECT round(corr(a, b), 9) AS r, count(*) AS n FROM k""")
def spearman_with_gaps(spark, sf):
    e = table(spark, sf, "events").withColumn("user_id", F.when(F.col("event_type") != "error", F.col("user_id")))
    return M.spearman(e, "user_id", "value").select(r("r", 9).alias("r"), "n")


@case("average_ranks", f"SELECT DISTINCT value, count(*) OVER (PARTITION BY value) AS cnt, {_rank_sql('value')} AS rank FROM events")
def average_ranks(spark, sf):
    from rentloom.operators.scale import value_ranks

    return value_ranks(table(spark, sf, "events"), "value")


@case("point_biserial", "SELECT round(corr((l_returnflag = 'A')::INTEGER, l_extendedprice), 9) AS r, count(*) AS n FROM lineitem")
def point_biserial(spark, sf):
    l = table(spark, sf, "lineitem").withColumn("flag", F.col("l_returnflag") == "A")
    return M.point_biserial(l, "flag", "l_extendedprice").select(r("r", 9).alias("r"), "n")


STRENGTH = "CASE WHEN abs({0}) >= 0.6 THEN 'Strong' WHEN abs({0}) >= 0.3 THEN 'Moderate' WHEN abs({0}) > 0 THEN 'Weak' ELSE '' END"


def _matrix_sql(source: str, columns: dict[str, str], binary: list[str]) -> str:
    """Long matrix of ``source`` (a CTE text ending in table t); ``columns`` maps name to SQL column."""
    ranks = ", ".join(f"{_rank_sql(c)} AS r_{c}" for c in columns.values())
    pairs = []
    for a, x in columns.items():
        for b, y in columns.items():
            if a == b:
                pairs.append(f"SELECT '{a}' AS \"row\", '{b}' AS col, 'identity' AS method, CAST(1 AS DOUBLE) AS r, count({x}) AS n FROM k")
            elif a in binary or b in binary:
                pairs.append(f"SELECT '{a}', '{b}', 'point biserial', corr({x}, {y}), least(count({x}), count({y})) FROM k")
            else:
                pairs.append(f"SELECT '{a}', '{b}', 'spearman', corr(r_{x}, r_{y}), least(count({x}), count({y})) FROM k")
    union = " UNION ALL ".join(pairs)
    return f"""WITH {source}, k AS (SELECT *, {ranks} FROM t), m AS ({union})
SELECT "row", col, method, round(r, 8) AS r, n, CASE WHEN n > 3 AND abs(r) < 1 THEN round(tanh(atanh(r) - 1.959964 / sqrt(n - 3)), 8) END AS lo,
  CASE WHEN n > 3 AND abs(r) < 1 THEN round(tanh(atanh(r) + 1.959964 / sqrt(n - 3)), 8) END AS hi, {STRENGTH.format('r')} AS strength FROM m"""


def _matrix(df: DataFrame) -> DataFrame:
    return df.select("row", "col", "method", r("r", 8).alias("r"), "n", r("lo", 8).alias("lo"), r("hi", 8).alias("hi"), M.strength_label("r").alias("strength"))


@case("correlation_matrix", _matrix_sql(
    "t AS (SELECT l_quantity AS q, l_extendedprice AS p, l_discount AS d, (l_returnflag = 'A')::INTEGER AS f FROM lineitem)",
    {"quantity": "q", "price": "p", "discount": "d", "flag": "f"}, ["flag"]))
def correlation_matrix(spark, sf):
    l = table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"),
        (F.col("l_returnflag") == "A").alias("flag"))
    return _matrix(M.correlation_matrix(l, ["quantity", "price", "discount", "flag"], ["flag"]))


_GAPS = {"quantity": "q", "price": "p", "discount": "d", "tax": "x"}
_GAP_ROWS = """t AS (SELECT l_quantity AS q, CASE WHEN l_linenumber <> 2 THEN l_extendedprice END AS p, CASE WHEN l_quantity > 5 THEN l_discount END AS d,
  CASE WHEN l_linestatus <> 'O' THEN l_tax END AS x FROM lineitem)"""


def _gaps_sql() -> str:
    """Every pair on the rows that have both columns; ranks are taken among those."""
    cells = []
    for a, x in _GAPS.items():
        for b, y in _GAPS.items():
            if a == b:
                cells.append(f"SELECT '{a}' AS \"row\", '{b}' AS col, CAST(1 AS DOUBLE) AS r, count({x}) AS n FROM t")
            else:
                both = f"(SELECT {x}, {y} FROM t WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
                cells.append(f"SELECT '{a}', '{b}', corr(rx, ry), count(*) FROM (SELECT {_rank_sql(x)} AS rx, {_rank_sql(y)} AS ry FROM {both})")
    return f'WITH {_GAP_ROWS}, m AS ({" UNION ALL ".join(cells)}) SELECT "row", col, round(r, 8) AS r, n FROM m'


@case("correlation_matrix_with_gaps", _gaps_sql())
def correlation_matrix_with_gaps(spark, sf):
    l = table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("quantity"), F.when(F.col("l_linenumber") != 2, F.col("l_extendedprice")).alias("price"),
        F.when(F.col("l_quantity") > 5, F.col("l_discount")).alias("discount"), F.when(F.col("l_linestatus") != "O", F.col("l_tax")).alias("tax"))
    return M.correlation_matrix(l, list(_GAPS)).select("row", "col", r("r", 8).alias("r"), "n")


@case("fisher_ci", """
WITH g AS (SELECT l_suppkey AS supp, corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem GROUP BY 1)
SELECT supp, round(tanh(atanh(r) - 1.959964 / sqrt(n - 3)), 8) AS lo, round(tanh(atanh(r) + 1.959964 / sqrt(n - 3)), 8) AS hi FROM g""")
def fisher_ci(spark, sf):
    g = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("supp")).agg(F.corr("l_quantity", "l_extendedprice").alias("r"), F.count(F.lit(1)).alias("n"))
    lo, hi = M.fisher_ci("r", "n")
    return g.select("supp", r(lo, 8).alias("lo"), r(hi, 8).alias("hi"))


@case("significance_labels", f"""
SELECT p, s, t, count(*) AS rows FROM (SELECT CASE WHEN l_discount / 2 < 0.001 THEN 'P < 0.001' WHEN l_discount / 2 < 0.01 THEN 'P < 0.01' WHEN l_discount / 2 < 0.05 THEN 'P < 0.05' ELSE '' END AS p,
  CASE WHEN l_discount / 2 < 0.001 THEN 'P < 0.001' || chr(10) || 'VERY SIGNIFICANT' WHEN l_discount / 2 < 0.01 THEN 'P < 0.01' WHEN l_discount / 2 < 0.05 THEN 'P < 0.05' ELSE 'NOT SIGNIFICANT' END AS t,
  {STRENGTH.format('(l_tax * -10)')} AS s FROM lineitem) GROUP BY ALL""")
def significance_labels(spark, sf):
    p = F.col("l_discount") / 2
    rows = table(spark, sf, "lineitem").select(
        M.significance_label(p).alias("p"), M.posthoc_label(p).alias("t"), M.strength_label(F.col("l_tax") * -10).alias("s"))
    return rows.groupBy("p", "s", "t").agg(F.count(F.lit(1)).alias("rows"))


@case("dunn_posthoc", f"""
WITH k AS (SELECT event_type AS g, value, {_rank_sql('value')} AS rk FROM events), s AS (SELECT g, count(*) AS n, avg(rk) AS m FROM k GROUP BY 1),
tt AS (SELECT sum(c::DOUBLE * c * c - c) AS t FROM (SELECT count(*) AS c FROM events GROUP BY value)), nn AS (SELECT count(*)::DOUBLE AS n FROM events)
SELECT a.g AS g1, b.g AS g2, round((a.m - b.m) / sqrt((nn.n * (nn.n + 1) / 12 - t / (12 * (nn.n - 1))) * (1.0 / a.n + 1.0 / b.n)), 8) AS z
FROM s a JOIN s b ON a.g < b.g, tt, nn""")
def dunn_posthoc(spark, sf):
    return M.dunn_posthoc(table(spark, sf, "events"), "value", "event_type").select("g1", "g2", r("z", 8).alias("z"))


@case("dunn_posthoc_flags", f"""
WITH t AS (SELECT (l_returnflag = 'A')::VARCHAR || '_' || (l_linestatus = 'O')::VARCHAR AS g, l_extendedprice AS v FROM lineitem),
k AS (SELECT g, v, {_rank_sql('v')} AS rk FROM t), s AS (SELECT g, count(*) AS n, avg(rk) AS m FROM k GROUP BY 1),
tt AS (SELECT sum(c::DOUBLE * c * c - c) AS t FROM (SELECT count(*) AS c FROM t GROUP BY v)), nn AS (SELECT count(*)::DOUBLE AS n FROM t)
SELECT a.g AS g1, b.g AS g2, round((a.m - b.m) / sqrt((nn.n * (nn.n + 1) / 12 - t / (12 * (nn.n - 1))) * (1.0 / a.n + 1.0 / b.n)), 8) AS z
FROM s a JOIN s b ON a.g < b.g, tt, nn""")
def dunn_posthoc_flags(spark, sf):
    l = table(spark, sf, "lineitem").withColumns({"a": F.col("l_returnflag") == "A", "o": F.col("l_linestatus") == "O"})
    return M.dunn_posthoc(l, "l_extendedprice", M.flag_group("a", "o")).select("g1", "g2", r("z", 8).alias("z"))


@case("cohens_d", """
WITH s AS (SELECT event_type AS g, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1)
SELECT a.g AS g1, b.g AS g2, round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 8) AS d FROM s a JOIN s b ON a.g < b.g""")
def cohens_d(spark, sf):
    return M.cohens_d(table(spark, sf, "events"), "value", "event_type").withColumn("d", r("d", 8))


def _box_sql(source: str, key: str, value: str) -> str:
    return f"""q AS (SELECT {key} AS g, count({value}) AS n, min({value}) AS lowest, quantile_cont({value}, 0.25) AS q1, median({value}) AS median,
  quantile_cont({value}, 0.75) AS q3, max({value}) AS highest FROM {source} GROUP BY 1),
w AS (SELECT g, min({value}) FILTER ({value} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
  max({value}) FILTER ({value} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
  count(*) FILTER (NOT ({value} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS outliers FROM {source} JOIN q ON {key} = g GROUP BY 1)
SELECT g, n, lowest, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, highest, whisker_low, whisker_high, outliers FROM q JOIN w USING (g)"""


def _box(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(f"`{key}`").alias("g"), "n", F.col("min").alias("lowest"), r("q1").alias("q1"), r("median").alias("median"), r("q3").alias("q3"),
                     F.col("max").alias("highest"), "whisker_low", "whisker_high", "outliers")


@case("box_summary", "WITH " + _box_sql("events", "event_type", "value"))
def box_summary(spark, sf):
    return _box(M.box_summary(table(spark, sf, "events"), ["event_type"], "value"), "event_type")


@case("box_summary_prices", "WITH " + _box_sql("lineitem", "l_returnflag", "l_extendedprice"))
def box_summary_prices(spark, sf):
    return _box(M.box_summary(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice"), "l_returnflag")


@case("box_summary_overall", "WITH t AS (SELECT 'all' AS k, l_extendedprice AS v FROM lineitem), " + _box_sql("t", "k", "v"))
def box_summary_overall(spark, sf):
    return _box(M.box_summary(table(spark, sf, "lineitem"), [], "l_extendedprice").withColumn("k", F.lit("all")), "k")


@case("ols_trend", """
SELECT l_returnflag AS flag, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
       round(regr_r2(l_extendedprice, l_quantity), 9) AS r2, count(*) AS n FROM lineitem GROUP BY 1""")
def ols_trend(spark, sf):
    out = M.ols_trend(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return out.select(F.col("l_returnflag").alias("flag"), r("slope", 5).alias("slope"), r("intercept", 4).alias("intercept"), r("r2", 9).alias("r2"), "n")


@case("evaluate", """
WITH t AS (SELECT l_extendedprice AS a, CASE WHEN l_linenumber <> 3 THEN l_quantity * 2000 END AS p FROM lineitem)
SELECT count(*) AS n, round(avg(abs(a - p)), 4) AS mae, round(sqrt(avg((a - p) * (a - p))), 4) AS rmse,
       round(1 - sum((a - p) * (a - p)) / (var_pop(a) * count(*)), 8) AS r2, round(avg(abs(a - p) / a) * 100, 5) AS mape FROM t WHERE p IS NOT NULL""")
def evaluate_query(spark, sf):
    l = table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("a"), F.when(F.col("l_linenumber") != 3, F.col("l_quantity") * 2000).alias("p"))
    return evaluate(l, "p", "a").select("n", r("mae", 4).alias("mae"), r("rmse", 4).alias("rmse"), r("r2", 8).alias("r2"), r("mape", 5).alias("mape"))


# --- profiles ----------------------------------------------------------------------------------------------

def _profile(df: DataFrame, x: str) -> DataFrame:
    return df.groupBy(F.col(f"`{x}`").alias("x"), "sort_key", r(S.PRICE_CHANGE, 4).alias("centre"), r("StdDev", 4).alias("std"), F.col("Count").alias("n")).agg(
        F.count(F.lit(1)).alias("rows"))


def _profile_sql(keys: str, x: str, stats: str, minimum: int, scale: int = 1) -> str:
    return f"""stats AS ({stats}),
s AS (SELECT {keys}, centre * {scale} AS centre, std * {scale} AS std FROM stats WHERE std IS NOT NULL),
sized AS (SELECT {keys}, count(*) AS n FROM listing JOIN s USING ({keys}) GROUP BY {keys} HAVING count(*) >= {minimum}),
o AS (SELECT {x} AS x, centre, std, n FROM sized JOIN s USING ({keys}))
SELECT x, row_number() OVER (ORDER BY centre, x) AS sort_key, round(centre, 4) AS centre, round(std, 4) AS std, n, n AS rows FROM o"""


def _street_stats(keys: str, change: str) -> str:
    group = keys if "street" in keys else f"{keys}, street"
    return f"""SELECT {keys}, avg({change}) AS centre, stddev_samp({change}) AS std FROM (
  SELECT {group}, arg_min(price, struct_pack(d := date, i := id)) AS f, arg_max(price, struct_pack(d := date, i := id)) AS l FROM listing
  GROUP BY {group} HAVING count(*) >= 2) GROUP BY {keys}"""


MEDIANS = "SELECT {0}, median(price) AS centre, stddev_samp(price) AS std FROM listing GROUP BY {0}"


def _report(name: str, x: str):
    def query(spark, sf):
        return _profile(named_reports()[name](priced(spark, sf)), x)
    return query


case("report_district_median", f"WITH {LISTING}, " + _profile_sql("province, district", "province || ' – ' || district", MEDIANS.format("province, district"), 100))(
    _report("district_median", S.PLACE))
case("report_streetwise_percent_change", f"WITH {LISTING}, " + _profile_sql(
    "province, district", "province || ' – ' || district", _street_stats("province, district", "(l - f) / f"), 100, 100))(_report("streetwise_percent_change", S.PLACE))
case("report_area_log_change", f"WITH {LISTING}, " + _profile_sql("area", "area", _street_stats("area", "ln(l / f)"), 10))(_report("area_log_change", S.FLOOR_AREA))
case("report_rooms_price", f"WITH {LISTING}, " + _profile_sql("rooms", "rooms::INTEGER", MEDIANS.format("rooms"), 50))(_report("rooms_price", S.ROOMS))


@case("price_profile_mean", f"WITH {LISTING}, " + _profile_sql("province", "province", MEDIANS.format("province").replace("median(", "avg("), 0))
def price_profile_mean(spark, sf):
    out, x = P.price_profile(priced(spark, sf), [S.PROVINCE], S.ROW_ID, "mean")
    return _profile(out, x)


@case("price_profile_absolute", f"WITH {LISTING}, " + _profile_sql("district", "district", _street_stats("district", "l - f"), 0))
def price_profile_absolute(spark, sf):
    out, x = P.price_profile(priced(spark, sf), [S.UNIT], S.ROW_ID, "absolute", minimum=1)
    return _profile(out, x)


@case("price_profile_sample", f"""
WITH {LISTING} SELECT district AS x, least(count(*), 200) AS n, least(count(*), 200) AS rows FROM listing GROUP BY 1 HAVING count(*) >= 100""")
def price_profile_sample(spark, sf):
    out, x = P.price_profile(priced(spark, sf), [S.UNIT], S.ROW_ID, "mean", minimum=100, maximum=200)
    return out.groupBy(F.col(f"`{x}`").alias("x"), F.col("Count").alias("n")).agg(F.count(F.lit(1)).alias("rows"))


@case("report_distance_from_centre", f"""
WITH {LISTING}, t AS (SELECT *, {DISTANCE_SQL} AS km, count(*) OVER (PARTITION BY province, district) AS size FROM listing),
big AS (SELECT * FROM t WHERE size >= 100), m AS (SELECT km, median(price) AS med FROM big GROUP BY 1), o AS (SELECT km, row_number() OVER (ORDER BY med, km) AS sort_key FROM m)
SELECT id, province || ' – ' || district AS place, round(km, 6) AS km, size AS n, sort_key FROM big JOIN o USING (km)""")
def report_distance_from_centre(spark, sf):
    out = named_reports()["distance_from_centre"](priced(spark, sf))
    return out.select(F.col(S.ROW_ID).alias("id"), F.col(S.PLACE).alias("place"), r(S.DISTANCE).alias("km"), F.col("Count").alias("n"), "sort_key")


def _duration_case(part: str):
    value = {"price": "price", "rooms": "rooms"}[part]
    sql = f"WITH {LISTING}, t AS (SELECT duration = 'Monthly' AS k, {value}::DOUBLE AS v FROM listing), " + _box_sql("t", "k", "v")

    @case(f"report_duration_boxes_{part}", sql)
    def query(spark, sf):
        flagged = with_monthly_flag(priced(spark, sf)).withColumn(S.ROOMS, F.col(S.ROOMS).cast("double"))
        return _box(M.box_summary(flagged, [MONTHLY], S.MONTHLY_USD_PRICE if part == "price" else S.ROOMS), MONTHLY)
    return query


_duration_case("price")
_duration_case("rooms")


@case("report_duration_tests", f"""
WITH {LISTING} SELECT 'price' AS value, round(corr((duration = 'Monthly')::INTEGER, price), 9) AS r, count(*) AS n FROM listing
UNION ALL SELECT 'rooms', round(corr((duration = 'Monthly')::INTEGER, rooms), 9), count(*) FROM listing""")
def report_duration_tests(spark, sf):
    found = duration_tests(priced(spark, sf))
    parts = [found[f"{k}_test"].select(F.lit(k).alias("value"), r("r", 9).alias("r"), "n") for k in ("price", "rooms")]
    return parts[0].unionByName(parts[1])


@case("report_construction_boxes", f"WITH {LISTING}, " + _box_sql("listing", "construction", "price"))
def report_construction_boxes(spark, sf):
    return _box(named_reports()["construction_boxes"](priced(spark, sf)), S.CONSTRUCTION)


@case("report_rooms_duration_correlation", _matrix_sql(
    f"{LISTING}, t AS (SELECT rooms AS a, price AS b, (duration = 'Monthly')::INTEGER AS c FROM listing)",
    {S.ROOMS: "a", S.MONTHLY_USD_PRICE: "b", MONTHLY: "c"}, [MONTHLY]))
def report_rooms_duration_correlation(spark, sf):
    return _matrix(named_reports()["rooms_duration_correlation"](priced(spark, sf)))


RANKS_OF = f"""{LISTING}, v AS (SELECT price AS a, (id % 4)::DOUBLE AS b, (floor(price)::BIGINT % 3)::DOUBLE AS c, (area::BIGINT % 5)::DOUBLE AS d FROM listing)"""
RANKED = f"{RANKS_OF}, t AS (SELECT * FROM v WHERE b <> 0 AND c <> 0 AND d <> 0)"


@case("report_rank_correlations", _matrix_sql(RANKED, {S.MONTHLY_USD_PRICE: "a", "Amenities_Rank": "b", "Appliances_Rank": "c", "Parking_Rank": "d"}, []))
def report_rank_correlations(spark, sf):
    return _matrix(rank_matrix(priced(spark, sf)))


@case("report_rank_profile", f"""
WITH {LISTING}, t AS (SELECT (id % 4)::DOUBLE AS x, price FROM listing WHERE id % 4 <> 0), g AS (SELECT x, count(*) AS n, median(price) AS m FROM t GROUP BY 1 HAVING count(*) >= 50)
SELECT x, n, n AS rows, row_number() OVER (ORDER BY m, x) AS sort_key FROM g""")
def report_rank_profile(spark, sf):
    out = rank_profiles(priced(spark, sf), S.ROW_ID, ["Amenities_Rank"])["Amenities_Rank"]
    return out.groupBy(F.col("Amenities_Rank").alias("x"), F.col("Count").alias("n"), "sort_key").agg(F.count(F.lit(1)).alias("rows"))


_MEDIANS = "(SELECT x, count(*) AS n, median(price) AS m FROM {} GROUP BY 1 HAVING count(*) >= 50)"
_RANK_STEPS = [("Amenities_Rank", "b", "b <> 0"), ("Parking_Rank", "d", "b <> 0 AND d <> 0"), ("Appliances_Rank", "c", "b <> 0 AND c <> 0 AND d <> 0")]


@case("report_rank_profiles", f"WITH {RANKS_OF} " + " UNION ALL ".join(
    f"SELECT '{name}' AS rank, x, n, n AS rows, row_number() OVER (ORDER BY m, x) AS sort_key FROM "
    + _MEDIANS.format(f"(SELECT {c} AS x, a AS price FROM v WHERE {kept})") for name, c, kept in _RANK_STEPS))
def report_rank_profiles(spark, sf):
    """All three item ranks, each on the rows the one before kept."""
    found = rank_profiles(priced(spark, sf), S.ROW_ID)
    parts = [out.groupBy(F.lit(name).alias("rank"), F.col(name).alias("x"), F.col("Count").alias("n"), "sort_key").agg(F.count(F.lit(1)).alias("rows"))
             for name, out in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@case("report_duration_matrix", _matrix_sql(
    f"{LISTING}, t AS (SELECT rooms AS a, price AS b, (duration = 'Monthly')::INTEGER AS c FROM listing)",
    {MONTHLY: "c", S.ROOMS: "a", S.MONTHLY_USD_PRICE: "b"}, [MONTHLY]))
def report_duration_matrix(spark, sf):
    return _matrix(duration_matrix(priced(spark, sf)))


@case("bar_rows", f"""
WITH {LISTING}, g AS (SELECT province || ' – ' || district AS place, median(price) AS m, stddev_samp(price) AS s, count(*) AS n FROM listing GROUP BY province, district)
SELECT place, round(m, 4) AS mean_price, round(s, 4) AS std_price, n FROM g WHERE n >= 100 AND s IS NOT NULL""")
def bar_rows(spark, sf):
    out, x = P.price_profile(priced(spark, sf), PLACE, S.ROW_ID, "median", minimum=100)
    bars = P.bar_rows(out, x, "median")
    return bars.select(F.col(S.PLACE).alias("place"), r("mean_price", 4).alias("mean_price"), r("std_price", 4).alias("std_price"), F.col("Count").alias("n"))


# --- documented address steps ----------------------------------------------------------------------------------

def _placed(spark, sf) -> DataFrame:
    i = F.col(S.ROW_ID)
    return listings(spark, sf).select(
        i.alias("id"), F.col(S.STREET), F.col(S.UNIT).alias(S.TOWN), F.when(i % 6 != 0, F.col(S.LATITUDE)).alias(S.LATITUDE),
        F.when(i % 6 != 0, F.col(S.LONGITUDE)).alias(S.LONGITUDE))


@case("fill_coordinates", f"""
WITH {LISTING}, m AS (SELECT district, street, median(lat) AS mlat, median(lon) AS mlon FROM listing WHERE id % 6 <> 0 GROUP BY ALL)
SELECT id, round(CASE WHEN id % 6 <> 0 THEN lat ELSE mlat END, 6) AS lat, round(CASE WHEN id % 6 <> 0 THEN lon ELSE mlon END, 6) AS lon
FROM listing LEFT JOIN m USING (district, street)""")
def fill_coordinates(spark, sf):
    return C.fill_coordinates(_placed(spark, sf)).select("id", r(S.LATITUDE).alias("lat"), r(S.LONGITUDE).alias("lon"))


@case("infer_city", f"""
WITH {LISTING}, t AS (SELECT id, lat, lon, CASE WHEN id % 5 <> 0 THEN 'C' || floor((lat - 38.5) * 2)::INTEGER || '-' || floor((lon - 43.5) * 2)::INTEGER END AS town FROM listing),
b AS (SELECT town, min(lat) AS a0, max(lat) AS a1, min(lon) AS o0, max(lon) AS o1 FROM t WHERE town IS NOT NULL GROUP BY 1),
f AS (SELECT id, b.town, row_number() OVER (PARTITION BY id ORDER BY (a1 - a0) * (o1 - o0), b.town) AS rn FROM t JOIN b ON lat BETWEEN a0 AND a1 AND lon BETWEEN o0 AND o1)
SELECT t.id, coalesce(t.town, f.town) AS town FROM t LEFT JOIN (SELECT * FROM f WHERE rn = 1) f USING (id)""")
def infer_city(spark, sf):
    def grid(column, start):
        return F.floor((F.col(column) - F.lit(start)) * 2).cast("string")

    v = listings(spark, sf)
    town = F.concat(F.lit("C"), grid(S.LATITUDE, 38.5), F.lit("-"), grid(S.LONGITUDE, 43.5))
    df = v.select(F.col(S.ROW_ID).alias("id"), S.LATITUDE, S.LONGITUDE, F.when(F.col(S.ROW_ID) % 5 != 0, town).alias(S.TOWN))
    return C.infer_city(df).select("id", F.col(S.TOWN).alias("town"))


MISSPELT = """names AS (SELECT DISTINCT p_name AS name, p_partkey % 4 AS kind, 2 + p_partkey % 5 AS pos FROM part),
t AS (SELECT DISTINCT CASE kind WHEN 0 THEN name WHEN 1 THEN left(name, pos::INTEGER) || substr(name, pos::INTEGER + 2)
      WHEN 2 THEN left(name, pos::INTEGER) || 'x' || substr(name, pos::INTEGER + 1) ELSE left(name, pos::INTEGER) || 'z' || substr(name, pos::INTEGER + 2) END AS t FROM names),
padded AS (SELECT t, ' ' || lower(t) || ' ' AS p FROM t),
g AS (SELECT DISTINCT t, substr(p, i, 3) AS g FROM (SELECT t, p, unnest(range(1, greatest(length(p) - 2, 1) + 1)) AS i FROM padded)),
n AS (SELECT t, count(*) AS n FROM g GROUP BY 1),
alike AS (SELECT x.t AS a, y.t AS b, count(*) AS i FROM g x JOIN g y ON x.g = y.g AND x.t < y.t GROUP BY 1, 2),
links AS (SELECT a, b, i / (p.n + q.n - i) AS likeness FROM alike JOIN n p ON p.t = a JOIN n q ON q.t = b WHERE i / (p.n + q.n - i) >= 0.6)"""


def _misspelt(spark, sf) -> DataFrame:
    """Part names with a letter left out, put in or replaced."""
    p, at, name = table(spark, sf, "part"), (2 + F.col("p_partkey") % 5).cast("int"), F.col("p_name")
    rest = F.substring(name, at + 2, F.lit(99))
    kind = F.col("p_partkey") % 4
    return p.select(F.when(kind == 0, name).when(kind == 1, F.concat(F.left(name, at), rest)).when(
        kind == 2, F.concat(F.left(name, at), F.lit("x"), F.substring(name, at + 1, F.lit(99)))).otherwise(F.concat(F.left(name, at), F.lit("z"), rest)).alias("t"))


@case("spelling_links", f"WITH {MISSPELT} SELECT a, b, round(likeness, 6) AS likeness FROM links")
def spelling_links(spark, sf):
    return spellings.spelling_links(_misspelt(spark, sf), "t").withColumn("likeness", F.round("likeness", 6))


@case("spelling_clusters", f"""
WITH RECURSIVE {MISSPELT}, ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT t AS x, t AS y FROM t UNION SELECT x, b FROM reach JOIN ways ON y = a)
SELECT x AS text, min(y) AS cluster FROM reach GROUP BY 1""")
def spelling_clusters(spark, sf):
    return spellings.spelling_clusters(_misspelt(spark, sf).distinct(), "t").select(F.col("t").alias("text"), "cluster")


@case("simplified_address", f"""
WITH {LISTING} SELECT id, concat_ws(', ', CASE WHEN id % 3 <> 0 THEN street WHEN id % 2 = 0 THEN province END, district) AS address FROM listing""")
def simplified_address(spark, sf):
    i = F.col(S.ROW_ID)
    df = listings(spark, sf).select(
        i.alias("id"), F.when(i % 3 != 0, F.col(S.STREET)).otherwise(" ").alias(S.STREET), F.when(i % 2 == 0, F.col(S.PROVINCE)).alias(S.NEIGHBOURHOOD),
        F.col(S.UNIT).alias(S.TOWN))
    return df.select("id", C.simplified_address().alias("address"))


CLUSTERED = f"""{LISTING}, t AS (SELECT district AS cluster, street AS unit, price, date, id, id % 5 <> 0 AS train FROM listing),
e AS (SELECT cluster, unit, train, arg_min(price, struct_pack(d := date, i := id)) AS f, arg_max(price, struct_pack(d := date, i := id)) AS l FROM t GROUP BY 1, 2, 3 HAVING count(*) >= 2),
c AS (SELECT cluster, avg((l - f) / f) FILTER (train) AS predicted, avg((l - f) / f) FILTER (NOT train) AS actual FROM e GROUP BY 1)"""


def _change_table(spark, sf) -> DataFrame:
    v, i = listings(spark, sf), F.col(S.ROW_ID)
    return C.cluster_change_predictor(v.where(i % 5 != 0), v.where(i % 5 == 0), S.UNIT, S.STREET, S.PRICE, [S.DATE, S.ROW_ID])


@case("cluster_change_predictor", f"WITH {CLUSTERED} SELECT cluster, round(predicted, 6) AS predicted, round(actual, 6) AS actual FROM c WHERE actual IS NOT NULL")
def cluster_change_predictor(spark, sf):
    return _change_table(spark, sf).select(F.col(S.UNIT).alias("cluster"), r("predicted").alias("predicted"), r("actual").alias("actual"))


@case("cluster_change_score", f"""
WITH {CLUSTERED}, d AS (SELECT * FROM c WHERE actual IS NOT NULL AND predicted IS NOT NULL)
SELECT count(*) AS n, round(avg(abs(actual - predicted)), 6) AS mae, round(sqrt(avg(pow(actual - predicted, 2))), 6) AS rmse FROM d""")
def cluster_change_score(spark, sf):
    return C.score_change_predictor(_change_table(spark, sf)).select("n", r("mae").alias("mae"), r("rmse").alias("rmse"))
