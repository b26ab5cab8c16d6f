"""Sources, stages, casts and projections over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rentloom import schema as S
from rentloom.cases.registry import case
from rentloom.cases.tables import ITEMS, LISTING, RATES, item_cells, listings, rates, table, wide_table
from rentloom.functions.casts import band, flag_equals, parse_date
from rentloom.operators.lists import split_clean_list
from rentloom.operators.quality import (
    exclude_zero_rank, fill_category_default, missing_counts, normalize_text_columns,
)
from rentloom.operators.lists import rank_score
from rentloom.operators.relational import null_blanks
from rentloom.session import new_shared_path
from rentloom.sources.csv_splits import read_split_csv
from rentloom.sources.listings import (
    align_by_position, assign_row_key, bool_default, drop_pii, majority_types, numeric_cast, numeric_shares,
    parse_dates, rank_defaults, read_listings, rename_headers, stack, string_cast, truthy_encode,
)
from rentloom.sources.reference_data import flatten_hierarchy, read_rates
from rentloom.sources.snapshots import input_key
from rentloom.sources.stages import stage, write_stage


@case("read_listings_csv", """
SELECT c_custkey AS id, c_name AS name, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS segment,
       c_acctbal AS balance FROM customer""")
def read_listings_csv(spark, sf):
    cells = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "N/A").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.col("c_acctbal").alias("balance"))
    path = write_stage(cells, new_shared_path(spark, "csv"), "csv")
    raw = read_listings(spark, path)
    numeric, _ = majority_types(raw)
    return numeric_cast(raw, numeric).withColumn("id", F.col("id").cast("bigint")).select("id", "name", "segment", "balance")


@case("read_multiline_csv", "SELECT doc_id, lang, n_chars, md5(coalesce(text, '')) AS text FROM documents")
def read_multiline_csv(spark, sf):
    """Texts with line breaks, commas and quotes in their cells, from files read in splits."""
    path = new_shared_path(spark, "csv")
    table(spark, sf, "documents").select("doc_id", "lang", "n_chars", "text").write.csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return read_split_csv(spark, path).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "lang", F.col("n_chars").cast("bigint").alias("n_chars"), F.md5(F.coalesce("text", F.lit(""))).alias("text"))


@case("read_rates_json", f"WITH {RATES} SELECT CAST(date AS VARCHAR) AS date, currency, rate FROM rates")
def read_rates_json(spark, sf):
    days = rates(spark, sf).groupBy("Date").agg(F.map_from_entries(F.collect_list(F.struct("Currency", "USD"))).alias("m"))
    months = days.groupBy(F.date_format("Date", "yyyy-MM").alias("month")).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("Date").cast("string"), "m")))).alias("value"))
    path = new_shared_path(spark, "rates")
    months.write.partitionBy("month").text(path)
    flat = read_rates(spark, path)
    return flat.select(F.col("Date").cast("string").alias("date"), F.col("Currency").alias("currency"), F.col("USD").alias("rate"))


HIERARCHY_SQL = """
SELECT 'unit' AS level, n_name AS name, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT DISTINCT 'locality', c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 0"""


def hierarchy(spark, sf):
    """Region 0 lists its districts; in the others the nations hold market segments as localities."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    c = table(spark, sf, "customer").select("c_nationkey", "c_mktsegment").distinct()
    nations = n.join(r, n.n_regionkey == r.r_regionkey)
    listed = nations.where("r_regionkey = 0").groupBy("r_name").agg(F.collect_list("n_name").alias("v"))
    listed = listed.select(F.to_json(F.create_map("r_name", "v")).alias("value"))
    places = nations.where("r_regionkey <> 0").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    inner = places.groupBy("r_name", "n_name").agg(F.map_from_entries(F.collect_list(
        F.when(F.col("c_mktsegment").isNotNull(), F.struct("c_mktsegment", F.lit("V"))))).alias("m"))
    nested = inner.groupBy("r_name").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "m"))).alias("v"))
    nested = nested.select(F.to_json(F.create_map("r_name", "v")).alias("value"))
    return flatten_hierarchy(listed.unionByName(nested))


@case("read_hierarchy_json", HIERARCHY_SQL)
def read_hierarchy_json(spark, sf):
    found = hierarchy(spark, sf)
    units = found.units.select(F.lit("unit").alias("level"), F.col("unit").alias("name"), F.col("province").alias("parent"))
    places = found.localities.select(F.lit("locality").alias("level"), F.col("locality").alias("name"), F.col("unit").alias("parent"))
    return units.unionByName(places)


@case("write_stage_csv", "SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation FROM supplier")
def write_stage_csv(spark, sf):
    path = write_stage(table(spark, sf, "supplier"), new_shared_path(spark, "stage"), "csv")
    back = read_listings(spark, path)
    return back.select(F.col("s_suppkey").cast("bigint").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("int").alias("nation"))


@case("stage_reuse", """
SELECT l_returnflag AS flag, count(*) AS rows, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1""")
def stage_reuse(spark, sf):
    path = new_shared_path(spark, "stage")

    def build():
        return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(
            F.count(F.lit(1)).alias("rows"), F.round(F.sum("l_quantity"), 2).alias("quantity"))

    def never():
        raise AssertionError("a finished stage is not rebuilt")

    stage(spark, path, build)
    return stage(spark, path, never)


@case("stage_rebuilt", """
SELECT l_returnflag AS flag, count(*) AS rows, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_quantity > 10 GROUP BY 1""")
def stage_rebuilt(spark, sf):
    """A stage of one parameter is there; asked for another one it is built anew, from the same input."""
    path, items = new_shared_path(spark, "stage"), table(spark, sf, "lineitem")

    def staged(least):
        rows = items.where(F.col("l_quantity") > least).groupBy(F.col("l_returnflag").alias("flag")).agg(
            F.count(F.lit(1)).alias("rows"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
        return stage(spark, path, lambda: rows, key=input_key(items, least=least))

    staged(0)
    return staged(10)


@case("rename_headers", 'SELECT p_partkey AS id, p_size AS "Rooms", p_type AS "Construction", p_retailprice AS other FROM part')
def rename_headers_query(spark, sf):
    return rename_headers(table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_size").alias("Number_of_rooms"), F.col("p_type").alias("Construction_type"),
        F.col("p_retailprice").alias("other")))


@case("align_by_position", """
SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation, c_acctbal AS balance FROM customer
UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier""")
def align_by_position_query(spark, sf):
    first = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    return stack(first, align_by_position(table(spark, sf, "supplier"), first))


@case("assign_row_key", """
SELECT o_orderkey AS id, 'A' || (row_number() OVER (ORDER BY o_orderkey) - 1) AS key FROM orders""")
def assign_row_key_query(spark, sf):
    return assign_row_key(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), "A", "id", "key")


@case("assign_row_key_by_file_position", "SELECT 'B' || unnest(generate_series(0, (SELECT count(*) FROM lineitem) - 1)) AS key")
def assign_row_key_by_file_position(spark, sf):
    return assign_row_key(table(spark, sf, "lineitem").select("l_orderkey"), "B", name="key").select("key")


@case("numeric_column_shares", """
WITH cells AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 10 < 8 THEN '12' ELSE 'x' END AS fifths,
                      left(o_orderpriority, 1) AS digit, o_orderpriority, CASE WHEN o_orderkey % 10 < 9 THEN ' 1.5e2 ' END AS gaps FROM orders),
shares AS (SELECT unnest(['o_orderkey', 'o_totalprice', 'fifths', 'digit', 'o_orderpriority', 'gaps']) AS "column",
  unnest([count(o_orderkey)::DOUBLE, count(o_totalprice), count(*) FILTER (fifths = '12'), count(digit), 0, count(gaps)]) AS n, count(*) AS total FROM cells)
SELECT "column", round(n / total, 6) AS share, n / total > 0.8 AS is_numeric FROM shares""")
def numeric_column_shares(spark, sf):
    i = F.col("o_orderkey")
    cells = table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", F.when(i % 10 < 8, "12").otherwise("x").alias("fifths"),
        F.left("o_orderpriority", F.lit(1)).alias("digit"), "o_orderpriority", F.when(i % 10 < 9, " 1.5e2 ").alias("gaps"))
    return numeric_shares(cells).withColumn("share", F.round("share", 6))


@case("numeric_cast", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 0 WHEN o_orderkey % 7 = 1 THEN 0 ELSE o_totalprice END AS price FROM orders""")
def numeric_cast_query(spark, sf):
    i = F.col("o_orderkey")
    text = F.when(i % 7 == 0, "12d").when(i % 7 != 1, F.concat(F.lit(" "), F.col("o_totalprice").cast("string")))
    return numeric_cast(table(spark, sf, "orders").select(i.alias("id"), text.alias("price")), ["price"])


@case("string_cast", "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS name FROM customer")
def string_cast_query(spark, sf):
    name = F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("  "), "c_name", F.lit(" ")))
    return string_cast(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), name.alias("name")), ["name"])


@case("parse_dates", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 <> 5 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS date FROM orders""")
def parse_dates_query(spark, sf):
    formats = ["yyyy-MM-dd", "dd/MM/yyyy", "d.M.yyyy", "yyyy-MM-dd HH:mm:ss", "d MMM yyyy"]
    text = F.when(F.lit(False), "")
    for k, f in enumerate(formats):
        text = text.when(F.col("o_orderkey") % 6 == k, F.date_format("o_orderdate", f))
    cells = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), text.otherwise("soon").alias("date"))
    return parse_dates(cells, ["date"]).withColumn("date", F.col("date").cast("string"))


MIXED_DATES = ["MMM d, yyyy", "d/M/yy", "d-MMM-yyyy", "yyyy.MM.dd", "yyyyMMdd", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSS'+04:00'"]


@case("parse_dates_mixed", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 8 <> 7 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS date FROM orders""")
def parse_dates_mixed(spark, sf):
    """Month names first, years of two digits, dots, no separators, clock times with a zone."""
    text = F.when(F.lit(False), "")
    for k, f in enumerate(MIXED_DATES):
        text = text.when(F.col("o_orderkey") % 8 == k, F.date_format("o_orderdate", f))
    cells = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), text.otherwise("later").alias("date"))
    return parse_dates(cells, ["date"]).withColumn("date", F.col("date").cast("string"))


FLAG_WORDS = ["", "False", "0", "Yes", "not available", "  "]


def _flag_cells(spark, sf):
    words = F.array(*map(F.lit, FLAG_WORDS))
    i = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        i.alias("id"), F.when(i % 7 < 6, F.element_at(words, (i % 7 + 1).cast("int"))).alias("flag"))


@case("bool_default", "SELECT o_orderkey AS id, o_orderkey % 7 IN (3, 4) AS flag FROM orders")
def bool_default_query(spark, sf):
    return bool_default(_flag_cells(spark, sf), ["flag"])


@case("truthy_encode", "SELECT o_orderkey AS id, o_orderkey % 7 IN (1, 3) AS flag FROM orders")
def truthy_encode_query(spark, sf):
    return truthy_encode(_flag_cells(spark, sf), ["flag"])


@case("drop_pii", "SELECT c_custkey AS id, c_mktsegment AS segment FROM customer")
def drop_pii_query(spark, sf):
    wide = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("Reg_id"), F.lit("f").alias("Gender"))
    return drop_pii(wide, S.PII_COLUMNS)


NORMALIZED = r"""
array_to_string(list_transform(regexp_extract_all(lower(trim(regexp_replace(regexp_replace(strip_accents(
  regexp_replace({c}, '(?i)_|none|\s+', ' ', 'g')), '[^\x00-\x7F]', '', 'g'), '[^\w\s]', '', 'g'))), '[a-z]+|[^a-z]+'),
  lambda x: upper(x[1]) || x[2:]), '')"""


@case("normalize_text_columns", f"SELECT doc_id AS id, lang, md5({NORMALIZED.format(c='text')}) AS text, md5({NORMALIZED.format(c='source')}) AS source FROM documents")
def normalize_text_columns_query(spark, sf):
    docs = wide_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "text", "source")
    return normalize_text_columns(docs, exclude=["lang"]).withColumns({"text": F.md5("text"), "source": F.md5("source")})


@case("normalize_conversations", f"SELECT conv_id, turn, md5({NORMALIZED.format(c='text')}) AS text FROM conversations")
def normalize_conversations(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return normalize_text_columns(turns).withColumn("text", F.md5("text"))


@case("fill_category_default", """
SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 OR p_partkey % 4 = 1 THEN 'No Renovation' ELSE p_type END AS kind FROM part""")
def fill_category_default_query(spark, sf):
    i = F.col("p_partkey")
    kind = F.when(i % 4 == 0, " ").when(i % 4 > 1, F.col("p_type"))
    return fill_category_default(table(spark, sf, "part").select(i.alias("id"), kind.alias("kind")), "kind", S.NO_RENOVATION)


@case("require_columns", """
SELECT count(*) AS rows, count(*) FILTER (o_orderkey % 5 = 0 OR o_custkey % 3 = 0) AS excluded FROM orders""")
def require_columns_query(spark, sf):
    o = table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("a"),
        F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderstatus")).otherwise("").alias("b"))
    return missing_counts(o, ["a", "b"])


@case("price_band", """
SELECT CASE WHEN l_extendedprice - 1000 <= 0 THEN NULL WHEN l_extendedprice - 1000 <= 800 THEN 'Cheap'
            WHEN l_extendedprice - 1000 <= 2000 THEN 'Affordable' ELSE 'Expensive' END AS band, count(*) AS rows
FROM lineitem GROUP BY 1""")
def price_band(spark, sf):
    cells = table(spark, sf, "lineitem").select(band(F.col("l_extendedprice") - 1000).alias("band"))
    return cells.groupBy("band").agg(F.count(F.lit(1)).alias("rows"))


@case("blank_to_null", """
SELECT p_partkey AS id, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS name,
       CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice END AS price FROM part""")
def blank_to_null_query(spark, sf):
    i = F.col("p_partkey")
    return null_blanks(table(spark, sf, "part").select(
        i.alias("id"), F.when(i % 3 != 0, F.col("p_name")).otherwise("").alias("name"),
        F.when(i % 4 != 0, F.col("p_retailprice")).otherwise(F.lit(float("nan"))).alias("price")))


@case("exclude_zero_rank", f"""
WITH {ITEMS}
SELECT id, CAST(count(*) FILTER (item <> 'Parking Space' AND id % 3 <> 0) AS DOUBLE) AS rank FROM items GROUP BY id HAVING id % 3 <> 0""")
def exclude_zero_rank_query(spark, sf):
    cells = item_cells(spark, sf).withColumn("cell", F.when(F.col(S.ROW_ID) % 3 != 0, F.col("cell")))
    ranked = cells.select(F.col(S.ROW_ID).alias("id"), rank_score(split_clean_list("cell", S.AMENITIES)).alias("rank"))
    return exclude_zero_rank(ranked, "rank")


@case("flag_equals", f"WITH {LISTING} SELECT id, duration = 'Monthly' AS monthly FROM listing")
def flag_equals_query(spark, sf):
    return listings(spark, sf).select(F.col(S.ROW_ID).alias("id"), flag_equals(S.DURATION, "Monthly").alias("monthly"))


@case("rank_defaults", """
SELECT p_partkey AS id, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size AS DOUBLE) ELSE 0 END AS "Amenities_Rank",
       CAST(0 AS DOUBLE) AS "Parking_Rank" FROM part""")
def rank_defaults_query(spark, sf):
    i = F.col("p_partkey")
    parts = table(spark, sf, "part").select(i.alias("id"), F.when(i % 3 != 0, F.col("p_size")).alias("Amenities_Rank"))
    return rank_defaults(parts, ["Amenities_Rank", "Parking_Rank"])


@case("stack", """
SELECT o_orderkey AS id, o_totalprice AS price, NULL AS balance FROM orders
UNION ALL SELECT c_custkey, NULL, c_acctbal FROM customer""")
def stack_query(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return stack(a, b)


@case("mixed_date_shares", """
SELECT count(*) AS rows, count(*) FILTER (o_orderkey % 2 = 0) AS readable FROM orders""")
def mixed_date_shares(spark, sf):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "d-M-yyyy")).otherwise(F.col("o_orderpriority"))
    return table(spark, sf, "orders").select(parse_date(text).alias("d")).agg(
        F.count(F.lit(1)).alias("rows"), F.count("d").alias("readable"))
