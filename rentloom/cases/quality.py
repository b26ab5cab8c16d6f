"""Row rules, the ledger, trimming, duplicates, lists and the whole cleaning plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from rentloom import schema as S
from rentloom.cases.registry import case
from rentloom.cases.tables import ITEMS, LISTING, MESSY, RATES, item_cells, listings, messy_listings, rates, table
from rentloom.operators.lists import (
    bridge, explode_keys, item_counts, melt_bridge, one_hot_list, rank_score, split_clean_list,
)
from rentloom.operators.joins import monthly_usd_price
from rentloom.operators.quality import (
    ExclusionLedger, dedupe_keep_first, flag_duplicates, key_field_rules, sanity_rules, split_excluded,
    trim_grouped_outliers, trim_outliers,
)
from rentloom.plans.cleaning import add_features, clean_listings
from rentloom.sources.listings import rename_headers


@case("require_key_fields", f"""
WITH {MESSY}
SELECT reason, count(*) AS rows FROM (SELECT unnest(r1) AS reason FROM keyed) GROUP BY 1""")
def require_key_fields(spark, sf):
    raw = rename_headers(messy_listings(spark, sf))
    ledger = ExclusionLedger.apply(ExclusionLedger.open(raw), key_field_rules())
    return ExclusionLedger.summary(ledger)


SANE_LINES = """
lines AS (SELECT l_returnflag AS flag, l_linenumber > l_quantity / 8 AS a, l_linenumber > p_size AS b, l_quantity <= 10 AS c, l_discount = 0 AS d
          FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _line_rules():
    return sanity_rules("l_linenumber", "floors", "l_linenumber", "p_size", "l_quantity", "l_discount")


@case("sanity_rules", f"""
WITH {SANE_LINES}
SELECT flag, count(*) FILTER (a) AS floor, count(*) FILTER (b) AS bathrooms, count(*) FILTER (c) AS area, count(*) FILTER (d) AS ceiling,
       count(*) FILTER (NOT (a OR b OR c OR d)) AS kept FROM lines GROUP BY 1""")
def sanity_rules_query(spark, sf):
    l, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    rows = l.join(p, l.l_partkey == p.p_partkey).withColumn("floors", F.col("l_quantity") / 8)
    judged = ExclusionLedger.apply(ExclusionLedger.open(rows), _line_rules())
    names = dict(zip(["floor", "bathrooms", "area", "ceiling"], _line_rules()))
    hit = {k: F.count_if(F.array_contains("_reasons", r)).alias(k) for k, r in names.items()}
    return judged.groupBy(F.col("l_returnflag").alias("flag")).agg(*hit.values(), F.count_if(ExclusionLedger.alive()).alias("kept"))


def _ledger(spark, sf):
    raw = rename_headers(messy_listings(spark, sf))
    return ExclusionLedger.apply(ExclusionLedger.apply(ExclusionLedger.open(raw), key_field_rules()), sanity_rules())


@case("exclusion_ledger", f"WITH {MESSY} SELECT id, array_to_string(r2, '; ') AS reason FROM sane WHERE len(r2) > 0")
def exclusion_ledger(spark, sf):
    return ExclusionLedger.excluded(_ledger(spark, sf)).select(F.col(S.ROW_ID).alias("id"), F.col(S.REASON).alias("reason"))


@case("split_excluded", f"WITH {MESSY} SELECT id, array_to_string(list_sort(r2), '; ') AS reason FROM sane WHERE len(r2) > 0")
def split_excluded_query(spark, sf):
    ledger = _ledger(spark, sf)
    original = messy_listings(spark, sf)
    gone = split_excluded(original, ExclusionLedger.kept(ledger), S.ROW_ID, ExclusionLedger.entries(ledger, S.ROW_ID))
    return gone.select(F.col(S.ROW_ID).alias("id"), F.col(S.REASON).alias("reason"))


@case("exclusion_summary", f"WITH {MESSY} SELECT reason, count(*) AS rows FROM (SELECT unnest(r2) AS reason FROM sane) GROUP BY 1")
def exclusion_summary(spark, sf):
    return ExclusionLedger.summary(_ledger(spark, sf))


@case("trim_outliers", """
WITH b AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem)
SELECT l_returnflag AS flag, count(*) AS rows, min(l_extendedprice) AS low, max(l_extendedprice) AS high
FROM lineitem, b WHERE l_extendedprice BETWEEN lo AND hi GROUP BY 1""")
def trim_outliers_query(spark, sf):
    kept = trim_outliers(table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice"), "l_extendedprice")
    return kept.groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


@case("trim_grouped_outliers", f"""
WITH {LISTING}, b AS (SELECT currency, duration, quantile_cont(price, 0.01) AS lo, quantile_cont(price, 0.99) AS hi FROM listing GROUP BY ALL)
SELECT id, price FROM listing JOIN b USING (currency, duration) WHERE price BETWEEN lo AND hi""")
def trim_grouped_outliers_query(spark, sf):
    kept = trim_grouped_outliers(listings(spark, sf), S.PRICE, [S.CURRENCY, S.DURATION], S.TRIM_LOW, S.TRIM_HIGH)
    return kept.select(F.col(S.ROW_ID).alias("id"), F.col(S.PRICE).alias("price"))


@case("trim_grouped_outliers_default", """
WITH b AS (SELECT l_returnflag, l_linestatus, quantile_cont(l_quantity, 0.1) AS lo, quantile_cont(l_quantity, 0.8) AS hi FROM lineitem GROUP BY ALL)
SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS rows, min(l_quantity) AS low, max(l_quantity) AS high
FROM lineitem JOIN b USING (l_returnflag, l_linestatus) WHERE l_quantity BETWEEN lo AND hi GROUP BY ALL""")
def trim_grouped_outliers_default(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    kept = trim_grouped_outliers(rows, "l_quantity", ["l_returnflag", "l_linestatus"])
    return kept.groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))


@case("dedupe_keep_first", "SELECT min(doc_id) AS id, md5(text) AS text FROM documents GROUP BY text")
def dedupe_keep_first_query(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return dedupe_keep_first(docs, "id").withColumn("text", F.md5("text"))


@case("dedupe_on_columns", """
SELECT doc_id AS id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def dedupe_on_columns(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "source", F.md5("text").alias("text"))
    return dedupe_keep_first(docs, "id", ["text"]).select("id", "lang", "source")


@case("flag_duplicates", """
SELECT l_orderkey % 10 AS bucket, count(*) AS rows FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS rn, o_orderkey AS l_orderkey FROM orders)
WHERE rn > 1 GROUP BY 1""")
def flag_duplicates_query(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    marked = flag_duplicates(o, "o_orderkey", ["o_custkey", "o_orderstatus", "o_orderpriority"]).where("_dup")
    return marked.groupBy((F.col("o_orderkey") % 10).alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))


@case("monthly_usd_price", f"""
WITH {LISTING}, {RATES}
SELECT id, CASE WHEN duration = 'Daily' THEN price * day(last_day(date)) ELSE price END
           / CASE WHEN currency = 'USD' THEN 1 ELSE rate END AS usd
FROM listing LEFT JOIN rates USING (date, currency)""")
def monthly_usd_price_query(spark, sf):
    priced = monthly_usd_price(listings(spark, sf), rates(spark, sf))
    return priced.select(F.col(S.ROW_ID).alias("id"), F.col(S.MONTHLY_USD_PRICE).alias("usd"))


@case("clean_listings", f"WITH {MESSY} SELECT id, usd, price, CAST(date AS VARCHAR) AS date, rooms::DOUBLE AS rooms FROM verdict WHERE len(reasons) = 0")
def clean_listings_query(spark, sf):
    kept = clean_listings(messy_listings(spark, sf), rates(spark, sf)).kept
    return kept.select(
        F.col(S.ROW_ID).alias("id"), F.col(S.MONTHLY_USD_PRICE).alias("usd"), F.col(S.PRICE).alias("price"),
        F.col(S.DATE).cast("string").alias("date"), F.col(S.ROOMS).alias("rooms"))


@case("clean_listings_excluded", f"WITH {MESSY} SELECT id, array_to_string(reasons, '; ') AS reason FROM verdict WHERE len(reasons) > 0")
def clean_listings_excluded(spark, sf):
    gone = clean_listings(messy_listings(spark, sf), rates(spark, sf)).excluded
    return gone.select(F.col(S.ROW_ID).alias("id"), F.col(S.REASON).alias("reason"))


@case("clean_listings_features", f"""
WITH {MESSY}
SELECT id, CASE WHEN usd <= 0 THEN NULL WHEN usd <= 800 THEN 'Cheap' WHEN usd <= 2000 THEN 'Affordable' ELSE 'Expensive' END AS band,
       CAST(2 AS DOUBLE) AS amenities, CASE WHEN oid % 3 <> 0 THEN CAST(2 AS DOUBLE) ELSE 0 END AS appliances,
       CAST(oid % 2 AS DOUBLE) AS parking, CAST(1 AS BIGINT) AS wifi, CAST(CASE WHEN oid % 3 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS oven,
       CASE WHEN oid % 4 <> 0 THEN 'Euro Repair' ELSE 'No Renovation' END AS renovation, oid % 5 <> 0 AS furnished, oid % 7 <> 0 AS balcony,
       oid % 2 = 0 AS new, oid % 3 <> 0 AS elevator
FROM verdict WHERE len(reasons) = 0""")
def clean_listings_features(spark, sf):
    kept = clean_listings(messy_listings(spark, sf), rates(spark, sf)).kept
    # A hyphen is punctuation, so the cell "Wi-Fi" reads "Wifi".
    items = {S.AMENITIES: ["Wifi"], S.APPLIANCES: ["Fridge", "Oven"], S.PARKING: ["Garage"]}
    df = add_features(kept, items=items)
    return df.select(
        F.col(S.ROW_ID).alias("id"), F.col(S.PRICE_BAND).alias("band"), F.col(S.FAMILY_RANK[S.AMENITIES]).alias("amenities"),
        F.col(S.FAMILY_RANK[S.APPLIANCES]).alias("appliances"), F.col(S.FAMILY_RANK[S.PARKING]).alias("parking"),
        F.col("1_Wifi").alias("wifi"), F.col("2_Oven").alias("oven"), F.col(S.RENOVATION).alias("renovation"),
        F.col(S.FURNISHED).alias("furnished"), F.col(S.BALCONY).alias("balcony"), F.col(S.NEW_CONSTRUCTION).alias("new"),
        F.col(S.ELEVATOR).alias("elevator"))


def _items(spark, sf, family=None):
    return item_cells(spark, sf).select(F.col(S.ROW_ID).alias("id"), split_clean_list("cell", family).alias("items"))


@case("split_clean_list", f"WITH {ITEMS} SELECT id, item FROM items WHERE item <> 'Parking Space'")
def split_clean_list_query(spark, sf):
    return _items(spark, sf, S.AMENITIES).select("id", F.explode("items").alias("item"))


@case("one_hot_long", f"WITH {ITEMS} SELECT id, item, count(*) AS n FROM items GROUP BY ALL")
def one_hot_long(spark, sf):
    return item_counts(_items(spark, sf), "id", "items")


@case("one_hot_wide", f"""
WITH {ITEMS}
SELECT id, count(*) FILTER (item = 'Small') AS "1_Small", count(*) FILTER (item = 'Parking Space') AS "1_Parking Space",
       count(*) FILTER (item = 'Economy') AS "1_Economy" FROM items GROUP BY id""")
def one_hot_wide(spark, sf):
    return one_hot_list(_items(spark, sf), "items", "1_", ["Small", "Parking Space", "Economy"]).drop("items")


@case("rank_score", f"WITH {ITEMS} SELECT id, CAST(count(*) AS DOUBLE) AS rank FROM items GROUP BY id")
def rank_score_query(spark, sf):
    return _items(spark, sf).select("id", rank_score("items").alias("rank"))


@case("explode_keys", """
SELECT p_partkey AS id, unnest(CASE WHEN p_partkey % 3 = 0 THEN ['A' || p_partkey] ELSE ['A' || p_partkey, 'B' || p_size] END) AS key FROM part""")
def explode_keys_query(spark, sf):
    a = F.concat(F.lit("A"), F.col("p_partkey").cast("string"))
    b = F.concat(F.lit("B"), F.col("p_size").cast("string"))
    cell = F.when(F.col("p_partkey") % 3 == 0, a).otherwise(F.concat(F.lit("['"), a, F.lit("', '"), b, F.lit("']")))
    return explode_keys(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), cell.alias("key")), "key")


@case("melt_bridge", f"WITH {ITEMS} SELECT DISTINCT id, item FROM items")
def melt_bridge_query(spark, sf):
    lists = _items(spark, sf)
    return melt_bridge(one_hot_list(lists, "items", "1_"), "id", "1_")


@case("list_bridge", f"WITH {ITEMS} SELECT DISTINCT id, item FROM items")
def list_bridge(spark, sf):
    return bridge(_items(spark, sf), "id", "items")
