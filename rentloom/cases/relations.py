"""Joins, aggregates, sampling, set operations and the relational output."""

from __future__ import annotations

from pyspark.sql import functions as F

from rentloom import schema as S
from rentloom.cases.registry import case
from rentloom.cases.tables import ITEMS, LISTING, RATES, item_cells, listings, rates, table
from rentloom.operators import aggregates as A
from rentloom.operators import joins as J
from rentloom.operators import relational as R
from rentloom.operators import sampling as P
from rentloom.operators.lists import split_clean_list
from rentloom.operators.quality import trim_grouped_outliers
from rentloom.session import new_shared_path
from rentloom.sources.stages import load_in_order, load_model, write_stage


def r(c, digits=6):
    return F.round(c, digits)


# --- joins -------------------------------------------------------------------------------------

@case("join_rates", f"WITH {LISTING}, {RATES} SELECT id, round(rate, 6) AS rate FROM listing LEFT JOIN rates USING (date, currency)")
def join_rates(spark, sf):
    return J.join_rates(listings(spark, sf), rates(spark, sf)).select(F.col(S.ROW_ID).alias("id"), r("rate").alias("rate"))


@case("attach_address", f"WITH {LISTING} SELECT id, price, CASE WHEN id % 3 <> 0 THEN street END AS street FROM listing")
def attach_address(spark, sf):
    v = listings(spark, sf).withColumn(S.INDEX, F.col(S.ROW_ID))
    parts = v.where(F.col(S.ROW_ID) % 3 != 0).select(S.INDEX, S.ADDRESS, F.col(S.STREET).alias("street"))
    joined = J.attach_address(v.select(S.INDEX, S.PRICE, S.ADDRESS), parts)
    return joined.select(F.col(S.INDEX).alias("id"), F.col(S.PRICE).alias("price"), "street")


ADDRESS_SIDE = f"""{LISTING}, known AS (SELECT DISTINCT lower(trim(address)) AS address, district FROM listing
  WHERE district <> 'NATION_3' UNION ALL SELECT 'nowhere 1', 'NATION_X')"""


def _known_addresses(spark, sf):
    v = listings(spark, sf)
    known = v.where(F.col(S.UNIT) != "NATION_3").select(F.concat(F.lit(" "), F.upper(S.ADDRESS)).alias(S.ADDRESS), F.col(S.UNIT).alias("district")).distinct()
    return known.unionByName(spark.range(1).select(F.lit("nowhere 1").alias(S.ADDRESS), F.lit("NATION_X").alias("district")))


@case("reindex_addresses", f"WITH {ADDRESS_SIDE} SELECT k.address, k.district, l.id FROM known k LEFT JOIN listing l ON lower(trim(l.address)) = k.address")
def reindex_addresses(spark, sf):
    keyed = listings(spark, sf).select(F.col(S.ROW_ID).alias("id"), S.ADDRESS)
    found = J.reindex_addresses(_known_addresses(spark, sf), keyed, "id")
    return found.select(F.col(S.ADDRESS).alias("address"), "district", "id")


@case("unmatched_report", f"""
WITH {ADDRESS_SIDE}, u AS (SELECT k.address, any_value(l.id) AS id FROM known k LEFT JOIN listing l ON lower(trim(l.address)) = k.address GROUP BY 1)
SELECT count(*) AS total, count(id) AS mapped, count(*) - count(id) AS missing FROM u""")
def unmatched_report(spark, sf):
    keyed = listings(spark, sf).select(F.col(S.ROW_ID).alias("id"), S.ADDRESS)
    return J.unmatched_report(_known_addresses(spark, sf), keyed, "id")


@case("attach_group_stats", f"""
WITH {LISTING}, s AS (SELECT district, street, avg(price) AS m, stddev_samp(price) AS d, count(price) AS n FROM listing GROUP BY ALL)
SELECT id, round(m, 4) AS centre, round(d, 4) AS std, n FROM listing JOIN s USING (district, street) WHERE d IS NOT NULL""")
def attach_group_stats(spark, sf):
    v, keys = listings(spark, sf), [S.UNIT, S.STREET]
    found = J.attach_group_stats(v, A.group_price_stats(v, keys, S.PRICE), keys, ["centre", "std", "count"])
    return found.select(F.col(S.ROW_ID).alias("id"), r("centre", 4).alias("centre"), r("std", 4).alias("std"), F.col("count").alias("n"))


@case("lookup_parent", """
SELECT s_suppkey AS id, CASE WHEN s_nationkey % 4 = 0 THEN '' ELSE r_name END AS province
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def lookup_parent(spark, sf):
    n, rg = table(spark, sf, "nation"), table(spark, sf, "region")
    mapping = n.join(rg, n.n_regionkey == rg.r_regionkey).select(F.col("n_nationkey").alias("unit"), "r_name")
    s = table(spark, sf, "supplier").withColumn("unit", F.when(F.col("s_nationkey") % 4 != 0, F.col("s_nationkey")))
    return J.lookup_parent(s, "unit", mapping, "unit", "r_name", "province").select(F.col("s_suppkey").alias("id"), "province")


@case("apply_translations", """
SELECT doc_id AS id, md5(CASE WHEN lang = 'fr' THEN 'EN ' || text ELSE text END) AS text FROM documents""")
def apply_translations(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "text")
    known = docs.where("lang = 'fr'").select(F.col("text").alias(S.ADDRESS), F.concat(F.lit("EN "), "text").alias(S.TRANSLATED)).distinct()
    only = docs.withColumn("key", F.when(F.col("lang") == "fr", F.col("text")).otherwise(F.concat(F.lit("\u0001"), "text")))
    out = J.apply_translations(only, known, "key")
    return out.select("id", F.md5(F.ltrim(F.col(S.TRANSLATED), F.lit("\u0001"))).alias("text"))


@case("keep_ids", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def keep_ids(spark, sf):
    returned = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return J.keep_ids(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), returned, "id")


@case("reject_ids", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def reject_ids(spark, sf):
    returned = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return J.reject_ids(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), returned, "id")


@case("set_difference", "SELECT DISTINCT l_partkey AS part, l_suppkey AS supp FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'A'")
def set_difference(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), "l_returnflag")
    return J.difference(l.where("l_returnflag = 'A'"), l.where("l_returnflag <> 'A'"), ["part", "supp"])


@case("union_distinct", "SELECT n_name AS value FROM nation UNION SELECT r_name FROM region UNION SELECT c_mktsegment FROM customer")
def union_distinct(spark, sf):
    names = [table(spark, sf, t).select(F.col(c).alias("value")) for t, c in (("nation", "n_name"), ("region", "r_name"), ("customer", "c_mktsegment"))]
    return names[0].union(names[1]).union(names[2]).distinct()


# --- aggregates --------------------------------------------------------------------------------

TRIMMED = f"""{LISTING}, bounds AS (SELECT currency, duration, quantile_cont(price, 0.01) AS lo, quantile_cont(price, 0.99) AS hi FROM listing GROUP BY ALL),
kept AS (SELECT * FROM listing JOIN bounds USING (currency, duration) WHERE price BETWEEN lo AND hi)"""


def _ends(source: str, keys: str) -> str:
    return f"""ends AS (SELECT {keys}, arg_min(price, struct_pack(d := date, i := id)) AS f, arg_max(price, struct_pack(d := date, i := id)) AS l, count(*) AS n
 FROM {source} GROUP BY {keys} HAVING count(*) >= 2)"""


@case("streetwise_change_by_district", f"""
WITH {TRIMMED}, {_ends('kept', 'province, district, street')},
changes AS (SELECT province, district, CASE WHEN f <> 0 THEN (l - f) / f END AS change FROM ends)
SELECT province, district, round(avg(change), 6) AS mean_change, round(stddev_samp(change), 6) AS std_change, count(change) AS streets FROM changes GROUP BY ALL""")
def streetwise_change_by_district(spark, sf):
    kept = trim_grouped_outliers(listings(spark, sf), S.PRICE, [S.CURRENCY, S.DURATION], S.TRIM_LOW, S.TRIM_HIGH)
    keys = [S.PROVINCE, S.UNIT]
    changes = A.first_last_change(kept, [*keys, S.STREET], S.PRICE, [S.DATE, S.ROW_ID])
    rolled = A.rollup_changes(changes, keys)
    return rolled.select(
        F.col(S.PROVINCE).alias("province"), F.col(S.UNIT).alias("district"), r("centre").alias("mean_change"),
        r("std").alias("std_change"), F.col("count").alias("streets"))


@case("group_price_mean", """
SELECT l_returnflag AS flag, l_linestatus AS status, round(avg(l_extendedprice), 4) AS centre, round(stddev_samp(l_extendedprice), 4) AS std,
       count(l_extendedprice) AS n FROM lineitem GROUP BY ALL""")
def group_price_mean(spark, sf):
    out = A.group_price_stats(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return out.select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), r("centre", 4).alias("centre"), r("std", 4).alias("std"), F.col("count").alias("n"))


@case("group_price_median", """
SELECT l_suppkey AS supp, round(median(l_extendedprice), 4) AS centre, round(stddev_samp(l_extendedprice), 4) AS std, count(l_extendedprice) AS n
FROM lineitem GROUP BY ALL""")
def group_price_median(spark, sf):
    out = A.group_price_stats(table(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice", "median")
    return out.select(F.col("l_suppkey").alias("supp"), r("centre", 4).alias("centre"), r("std", 4).alias("std"), F.col("count").alias("n"))


def _change_case(name: str, method: str, sql_expr: str, min_series: int = 2):
    having = _ends("listing", "district, street")
    if min_series == 1:
        having = having.replace(" HAVING count(*) >= 2", "")

    @case(name, f"WITH {LISTING}, {having} SELECT district, street, round({sql_expr}, 6) AS change FROM ends")
    def query(spark, sf):
        out = A.first_last_change(listings(spark, sf), [S.UNIT, S.STREET], S.PRICE, [S.DATE, S.ROW_ID], method, min_series)
        return out.select(F.col(S.UNIT).alias("district"), F.col(S.STREET).alias("street"), r("change").alias("change"))
    return query


first_last_change_percent = _change_case("first_last_change_percent", "percent", "CASE WHEN f <> 0 THEN (l - f) / f END")
first_last_change_absolute = _change_case("first_last_change_absolute", "absolute", "l - f", 1)
first_last_change_log = _change_case("first_last_change_log", "log", "CASE WHEN f > 0 AND l > 0 THEN ln(l / f) END")


@case("rollup_changes", f"""
WITH {LISTING}, {_ends('listing', 'province, district, street')}, c AS (SELECT province, (l - f) / f AS change FROM ends WHERE f <> 0)
SELECT province, round(avg(change), 6) AS centre, round(stddev_samp(change), 6) AS std, count(change) AS n FROM c GROUP BY ALL""")
def rollup_changes(spark, sf):
    changes = A.first_last_change(listings(spark, sf), [S.PROVINCE, S.UNIT, S.STREET], S.PRICE, [S.DATE, S.ROW_ID])
    out = A.rollup_changes(changes, [S.PROVINCE])
    return out.select(F.col(S.PROVINCE).alias("province"), r("centre").alias("centre"), r("std").alias("std"), F.col("count").alias("n"))


@case("address_key_bridge", f"WITH {LISTING} SELECT lower(trim(address)) AS address, id FROM listing")
def address_key_bridge(spark, sf):
    keyed = listings(spark, sf).select(F.col(S.ROW_ID).alias("id"), F.concat(F.col(S.ADDRESS), F.lit(" ")).alias(S.ADDRESS))
    return J.address_bridge(keyed, "id").withColumnRenamed(S.ADDRESS, "address")


@case("keys_per_address", f"""
WITH {LISTING} SELECT lower(address) AS address, count(*) AS listings, min(id) AS first_key, max(id) AS last_key FROM listing GROUP BY 1""")
def keys_per_address(spark, sf):
    keyed = listings(spark, sf).select(F.col(S.ROW_ID).alias("id"), S.ADDRESS)
    return J.keys_per_address(keyed, "id").withColumnRenamed(S.ADDRESS, "address")


@case("first_non_blank", """
SELECT c_nationkey AS nation, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderkey % 3 <> 0) AS first_value
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def first_non_blank(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("c_nationkey").alias("nation"), "o_orderkey",
        F.when(F.col("o_orderkey") % 6 == 0, " ").when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("v"))
    return A.first_non_blank(rows, ["nation"], "v", "o_orderkey")


@case("group_count_column", """
SELECT o_orderkey AS id, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS n FROM orders""")
def group_count_column(spark, sf):
    return A.group_count_column(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus"], "n").select(F.col("o_orderkey").alias("id"), "n")


@case("min_group_size", """
SELECT o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 12)""")
def min_group_size(spark, sf):
    return A.min_group_size(table(spark, sf, "orders"), ["o_custkey"], 12).select(F.col("o_orderkey").alias("id"))


@case("order_categories", """
WITH m AS (SELECT p_brand AS brand, median(l_extendedprice) AS median FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT brand, round(median, 4) AS median, row_number() OVER (ORDER BY median, brand) AS sort_key FROM m""")
def order_categories(spark, sf):
    l, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    rows = l.join(p, l.l_partkey == p.p_partkey).select(F.col("p_brand").alias("brand"), "l_extendedprice")
    return A.order_categories(rows, "brand", "l_extendedprice").withColumn("median", r("median", 4))


@case("distinct_values", """
SELECT DISTINCT value FROM (SELECT unnest([trim(p_name), trim(p_type), CASE WHEN p_partkey % 2 = 0 THEN p_brand END]) AS value FROM part)
WHERE value IS NOT NULL""")
def distinct_values(spark, sf):
    parts = table(spark, sf, "part").select(
        F.concat(F.lit(" "), "p_name").alias("a"), F.col("p_type").alias("b"),
        F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(" ").alias("c"))
    return A.distinct_values(parts, ["a", "b", "c"])


def _pairs(spark, sf):
    i = F.col(S.ROW_ID)
    return listings(spark, sf).select(
        F.when(i % 7 != 0, F.col(S.UNIT)).alias("unit"), F.when(F.col(S.UNIT) != "NATION_4", F.col(S.PROVINCE)).alias("province"))


@case("parent_child_pairs", f"WITH {LISTING} SELECT DISTINCT district AS name, province FROM listing WHERE id % 7 <> 0 AND district <> 'NATION_4'")
def parent_child_pairs(spark, sf):
    return A.parent_child_pairs(_pairs(spark, sf), "unit", "province")


@case("orphan_children", f"WITH {LISTING} SELECT DISTINCT district AS name FROM listing WHERE district = 'NATION_4' AND id % 7 <> 0")
def orphan_children(spark, sf):
    return A.orphan_children(_pairs(spark, sf), "unit", "province")


@case("missing_by_group", "SELECT o_orderstatus AS status, count(*) AS missing FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1")
def missing_by_group(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("p"))
    return A.missing_by_group(o, "p", "status")


# --- sorting and sampling ------------------------------------------------------------------------

@case("chronological_sort", "SELECT o_orderkey AS id, o_custkey AS cust, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date FROM orders ORDER BY 2, 3, 1")
def chronological_sort(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.to_date("o_orderdate").cast("string").alias("date"))
    return P.chronological_sort(o, ["cust"], "date", "id")


@case("sample_per_group", """
SELECT l_suppkey AS supp, least(count(*), 40) AS rows FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_partkey, l_linenumber FROM lineitem)
GROUP BY 1 HAVING count(*) >= 30""")
def sample_per_group(spark, sf):
    l = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber").distinct()
    keyed = l.withColumn("id", F.concat_ws("-", "l_suppkey", "l_orderkey", "l_partkey", "l_linenumber"))
    taken = P.sample_per_group(keyed, ["l_suppkey"], "id", 30, 40)
    return taken.groupBy(F.col("l_suppkey").alias("supp")).agg(F.count(F.lit(1)).alias("rows"))


@case("train_test_split", "SELECT unnest([true, false]) AS is_train, unnest([round_even(count(*) * 0.8, 0)::BIGINT, count(*) - round_even(count(*) * 0.8, 0)::BIGINT]) AS rows FROM orders")
def train_test_split(spark, sf):
    split = P.train_test_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    return split.groupBy("is_train").agg(F.count(F.lit(1)).alias("rows"))


@case("train_test_split_by_threshold")
def train_test_split_by_threshold(spark, sf):
    split = P.train_test_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", exact=False)
    return split.groupBy("is_train").agg(F.count(F.lit(1)).alias("rows"))


# --- relational output -----------------------------------------------------------------------------

def cleaned(spark, sf):
    """Listings with the columns of the relational tables; item lists from the customer's segment and priority."""
    i = F.col(S.ROW_ID)
    v = listings(spark, sf)
    return v.select(
        S.ROW_ID, S.DATE, S.PRICE, S.CURRENCY, S.DURATION, S.PROVINCE, S.UNIT, S.STREET,
        F.when(i % 5 != 0, F.concat(F.lit("Town "), (i % 40).cast("string"))).otherwise("").alias(S.TOWN),
        F.col(S.CONSTRUCTION), F.when(i % 3 != 0, "Euro").otherwise("Old").alias(S.RENOVATION),
        (i % 9).cast("double").alias(S.FLOOR), F.lit(9.0).alias(S.FLOORS), (F.col(S.FLOOR_AREA) + 0.6).alias(S.FLOOR_AREA), S.ROOMS,
        (i % 2 == 0).alias(S.ELEVATOR),
        split_clean_list(F.concat(S.STREET, F.lit(","), F.lower(S.STREET), F.lit(",wifi")), S.AMENITIES).alias(S.AMENITIES),
        split_clean_list(F.when(i % 4 == 0, "oven, fridge"), S.APPLIANCES).alias(S.APPLIANCES),
        split_clean_list(F.lit("none"), S.PARKING).alias(S.PARKING))


def _model(spark, sf):
    return R.relational_model(cleaned(spark, sf), rates(spark, sf))


@case("dimension_tables", """
SELECT 'Province' AS "table", r_name AS key FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 2
UNION ALL SELECT 'Town', 'Town ' || (o_orderkey % 40) FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 2
UNION ALL SELECT 'Renovation', unnest(['Euro', 'Old'])
UNION ALL SELECT 'Construction', o_orderpriority FROM orders GROUP BY 2
UNION ALL SELECT 'Currency', unnest(['USD', 'EUR', 'RUB', 'AMD'])""")
def dimension_tables(spark, sf):
    tables = _model(spark, sf)
    parts = [tables[n].select(F.lit(n).alias("table"), F.col(tables[n].columns[0]).alias("key")) for n in (S.PROVINCE, S.TOWN, S.RENOVATION, S.CONSTRUCTION, S.CURRENCY)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@case("district_dimension", f"WITH {LISTING} SELECT DISTINCT district AS name, province FROM listing")
def district_dimension(spark, sf):
    return _model(spark, sf)[S.UNIT]


@case("exchange_rate_fact", f"""WITH {RATES} SELECT CAST(date AS VARCHAR) AS "Date", currency AS "Currency", round(rate, 6) AS "USD" FROM rates""")
def exchange_rate_fact(spark, sf):
    return _model(spark, sf)["Exchange Rate"].withColumns({"Date": F.col("Date").cast("string"), "USD": r("USD")})


@case("listing_fact", f"""
WITH {LISTING} SELECT id AS "ID", CAST(date AS VARCHAR) AS "Date", price AS "Price", currency AS "Currency", duration AS "Duration" FROM listing""")
def listing_fact(spark, sf):
    return _model(spark, sf)["Listing"].withColumn("Date", F.col("Date").cast("string"))


@case("address_table", f"""
WITH {LISTING} SELECT id AS "ID", district AS "Administrative District", province AS "Province", NULL::VARCHAR AS "Building", NULL::VARCHAR AS "Street Number",
 street AS "Street", NULL::VARCHAR AS "Block", NULL::VARCHAR AS "Lane", CASE WHEN id % 5 <> 0 THEN 'Town ' || (id % 40) END AS "Town", NULL::VARCHAR AS "Neighbourhood" FROM listing""")
def address_table(spark, sf):
    return _model(spark, sf)[S.ADDRESS]


@case("property_table", f"""
WITH {LISTING} SELECT id AS "ID", id AS "Address", NULL::BOOLEAN AS "New Construction", (id % 9)::INTEGER AS "Floor", 9::INTEGER AS "Floors",
 area::INTEGER AS "Floor_area", rooms::INTEGER AS "Rooms", NULL::INTEGER AS "Bathrooms", NULL::DOUBLE AS "Ceiling_height",
 CASE WHEN id % 3 <> 0 THEN 'Euro' ELSE 'Old' END AS "Renovation", construction AS "Construction", NULL::BOOLEAN AS "Balcony", NULL::BOOLEAN AS "Furnished",
 id % 2 = 0 AS "Elevator", NULL::INTEGER AS "Children Welcome", NULL::INTEGER AS "Pets Allowed", NULL::INTEGER AS "Utility Payments", id AS "Listing" FROM listing""")
def property_table(spark, sf):
    return _model(spark, sf)["Property"]


@case("bridge_tables", f"""
WITH {LISTING}
SELECT 'Amenities' AS family, id AS property, unnest([upper(street[1]) || lower(street[2:]), 'Wifi']) AS item FROM listing
UNION ALL SELECT 'Appliances', id, unnest(['Oven', 'Fridge']) FROM listing WHERE id % 4 = 0""")
def bridge_tables(spark, sf):
    tables = _model(spark, sf)
    parts = [tables[f"Property_{f}"].select(F.lit(f).alias("family"), F.col("Property_ID").alias("property"), F.col(f"{f}_type").alias("item"))
             for f in S.FAMILY_PREFIX]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@case("upsert", """
SELECT c_custkey AS key, CASE WHEN c_custkey % 5 = 0 THEN 'changed' ELSE c_mktsegment END AS segment FROM customer
UNION ALL SELECT s_suppkey + 10000000, 'new' FROM supplier""")
def upsert(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    changed = c.where("key % 5 = 0").withColumn("segment", F.lit("changed"))
    new = table(spark, sf, "supplier").select((F.col("s_suppkey") + 10_000_000).alias("key"), F.lit("new").alias("segment"))
    return R.upsert(c, changed.unionByName(new), ["key"])


def _segments(spark, sf):
    """Customers and what their orders change: one row per order, many per customer, some without one."""
    target = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"), F.lit(0).cast("bigint").alias("seq"))
    o = table(spark, sf, "orders")
    change = o.select(F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey") * 2).alias("key"), F.col("o_orderpriority").alias("segment"), F.col("o_orderkey").alias("seq"))
    return target, change


SEGMENTS = """t AS (SELECT c_custkey AS key, c_mktsegment AS segment, 0::BIGINT AS seq FROM customer),
s AS (SELECT CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey * 2 END AS key, o_orderpriority AS segment, o_orderkey AS seq FROM orders)"""
LAST_WRITER = f"""WITH {SEGMENTS}, l AS (SELECT key, arg_max(segment, seq) AS segment, max(seq) AS seq FROM s WHERE key IS NOT NULL GROUP BY 1)
SELECT * FROM t WHERE key NOT IN (SELECT key FROM l) UNION ALL SELECT * FROM l"""


@case("upsert_last_writer", LAST_WRITER)
def upsert_last_writer(spark, sf):
    return R.upsert(*_segments(spark, sf), ["key"], "seq")


@case("upsert_snapshot", LAST_WRITER)
def upsert_snapshot(spark, sf):
    """The same by two versions of a bucketed table."""
    target, change = _segments(spark, sf)
    root = new_shared_path(spark, "segments")
    R.upsert_snapshot(spark, root, target, ["key"], "seq", buckets=16)
    return R.upsert_snapshot(spark, root, change, ["key"], "seq", buckets=16).read(spark)


@case("upsert_refused", f"""WITH {SEGMENTS}
SELECT key, count(*) AS rows, CASE WHEN key IS NULL THEN 'missing key' ELSE 'conflict' END AS reason FROM s
GROUP BY key HAVING key IS NULL OR count(DISTINCT segment) > 1""")
def upsert_refused(spark, sf):
    return R.refused_rows(_segments(spark, sf)[1].drop("seq"), ["key"])


MODEL = {"lineitem": ["l_orderkey", "l_linenumber"], "orders": ["o_orderkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"],
         "nation": ["n_nationkey"], "region": ["r_regionkey"]}
MODEL_REFERENCES = [
    ("nation", {"n_regionkey": "r_regionkey"}, "region"), ("customer", {"c_nationkey": "n_nationkey"}, "nation"),
    ("supplier", {"s_nationkey": "n_nationkey"}, "nation"), ("orders", {"o_custkey": "c_custkey"}, "customer"),
    ("lineitem", {"l_orderkey": "o_orderkey"}, "orders"), ("lineitem", {"l_partkey": "p_partkey"}, "part"),
    ("lineitem", {"l_suppkey": "s_suppkey"}, "supplier")]


def _model_counts(count: str) -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS \"table\", {count.format(key=k[0])} FROM {t}" for t, k in MODEL.items() if t != "lineitem")


@case("load_model", f"""
WITH lines AS (SELECT row_number() OVER (PARTITION BY l_orderkey, l_linenumber) AS n, * FROM lineitem
               WHERE l_orderkey IN (SELECT o_orderkey FROM orders) AND l_partkey IN (SELECT p_partkey FROM part) AND l_suppkey IN (SELECT s_suppkey FROM supplier))
{_model_counts("count(*) AS rows, sum({key})::BIGINT AS keys")}
UNION ALL SELECT 'lineitem', count(*), sum(l_orderkey)::BIGINT FROM lines WHERE n = 1""")
def load_model_query(spark, sf):
    """All tables as one load; line items are first freed of repeated keys and of rows without a parent, which would stop it."""
    tables = {t: table(spark, sf, t) for t in MODEL}
    lines = tables["lineitem"].dropDuplicates(MODEL["lineitem"])
    for child, columns, parent in MODEL_REFERENCES[-3:]:
        (c, p), = columns.items()
        lines = lines.join(tables[parent].select(F.col(p).alias(c)), c, "left_semi")
    tables["lineitem"] = lines.select(*tables["lineitem"].columns)
    loaded = load_model(spark, tables, MODEL, MODEL_REFERENCES, new_shared_path(spark, "model"))
    counts = [loaded.read(spark, t).agg(F.lit(t).alias("table"), F.count(F.lit(1)).alias("rows"), F.sum(k[0]).cast("bigint").alias("keys")) for t, k in MODEL.items()]
    whole = counts[0]
    for c in counts[1:]:
        whole = whole.unionByName(c)
    return whole


@case("check_keys", """
SELECT o_custkey AS cust, o_orderstatus AS status, count(*) AS rows FROM (SELECT CASE WHEN o_custkey % 9 <> 0 THEN o_custkey END AS o_custkey, o_orderstatus FROM orders)
GROUP BY ALL HAVING count(*) > 1 OR o_custkey IS NULL""")
def check_keys(spark, sf):
    o = table(spark, sf, "orders").select(F.when(F.col("o_custkey") % 9 != 0, F.col("o_custkey")).alias("cust"), F.col("o_orderstatus").alias("status"))
    return R.check_keys(o, ["cust", "status"])


@case("check_model_keys", "SELECT 'all' AS \"table\", 0::BIGINT AS broken")
def check_model_keys(spark, sf):
    """All primary keys of the model; the total of broken keys must be 0."""
    keys = {S.PROVINCE: ["name"], S.TOWN: ["name"], S.RENOVATION: ["type"], S.CONSTRUCTION: ["type"], S.CURRENCY: ["code"],
            "Exchange Rate": ["Date", "Currency"], S.UNIT: ["name", "province"], "Listing": [S.ROW_ID], S.ADDRESS: [S.ROW_ID],
            "Property": [S.ROW_ID], S.AMENITIES: ["type"], "Property_Amenities": ["Property_ID", "Amenities_type"],
            **{t: k for family in (S.APPLIANCES, S.PARKING) for t, k in ((family, ["type"]), (f"Property_{family}", ["Property_ID", f"{family}_type"]))}}
    tables = _model(spark, sf)
    counts = [R.check_keys(tables[t], k).agg(F.count(F.lit(1)).alias("n")) for t, k in keys.items() if t in tables]
    total = counts[0]
    for c in counts[1:]:
        total = total.unionByName(c)
    return total.agg(F.sum("n").alias("broken")).select(F.lit("all").alias("table"), "broken")


@case("check_references", """
SELECT DISTINCT n_name AS name, r_name AS province FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
JOIN orders ON o_custkey = c_custkey WHERE c_nationkey % 6 = 0""")
def check_references(spark, sf):
    tables = _model(spark, sf)
    n = table(spark, sf, "nation").where("n_nationkey % 6 <> 0").select(F.col("n_name").alias("name"))
    parents = tables[S.UNIT].join(n, "name", "left_semi")
    return R.check_references(tables[S.ADDRESS], {S.UNIT: "name", S.PROVINCE: "province"}, parents)


@case("load_order", "SELECT unnest(generate_series(1, 14)) AS position, unnest(['Province', 'Town', 'Renovation', 'Construction', 'Currency', 'Exchange Rate', 'Administrative District', 'Listing', 'Address', 'Property', 'Amenities', 'Property_Amenities', 'Appliances', 'Property_Appliances']) AS name")
def load_order(spark, sf):
    """Writes the model as stages, parents first; the parking tables have no rows and are skipped."""
    # Fourteen tables come from the listings, each read twice: their joins are run once and kept in columns.
    listed = spark.read.parquet(write_stage(cleaned(spark, sf), new_shared_path(spark, "listings")))
    dated = spark.read.parquet(write_stage(rates(spark, sf), new_shared_path(spark, "rates")))
    written = load_in_order(R.relational_model(listed, dated), S.LOAD_ORDER, new_shared_path(spark, "model"))
    return spark.createDataFrame([(i, n) for i, n in enumerate(written, 1)], "position bigint, name string")


@case("family_items", f"WITH {ITEMS} SELECT DISTINCT item AS type FROM items")
def family_items(spark, sf):
    cells = item_cells(spark, sf).select(F.explode(split_clean_list("cell")).alias("item"))
    return R.dimension(cells, "item", "type")
