"""Listing-shaped views of the given tables, in Spark and as SQL common tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rentloom import schema as S
from rentloom.sources.stages import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def wide_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table whose rows cost much work each, spread over all cores."""
    return spread(table(spark, sf, name))


def listings(spark: SparkSession, sf: str, orders: DataFrame | None = None) -> DataFrame:
    """Orders as listings: the nation is the district, the market segment the street."""
    o, c = table(spark, sf, "orders") if orders is None else orders, table(spark, sf, "customer")
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    joined = (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
              .join(r, n.n_regionkey == r.r_regionkey))
    currency = F.element_at(F.array(*map(F.lit, ["USD", "EUR", "RUB", "AMD"])), (F.col("o_custkey") % 4 + 1).cast("int"))
    return joined.select(
        F.col("o_orderkey").alias(S.ROW_ID),
        F.to_date("o_orderdate").alias(S.DATE),
        F.col("o_totalprice").alias(S.PRICE),
        currency.alias(S.CURRENCY),
        F.when(F.col("o_orderstatus") == "F", "Daily").otherwise("Monthly").alias(S.DURATION),
        F.col("r_name").alias(S.PROVINCE),
        F.col("n_name").alias(S.UNIT),
        F.col("c_mktsegment").alias(S.STREET),
        (F.lit(38.5) + (F.col("c_custkey") % 250) / F.lit(100.0)).alias(S.LATITUDE),
        (F.lit(43.5) + (F.col("c_custkey") % 300) / F.lit(100.0)).alias(S.LONGITUDE),
        F.concat(F.lit("12/"), F.col("c_custkey").cast("string"), F.lit(" "), "c_mktsegment", F.lit(" st, "), "n_name").alias(S.ADDRESS),
        F.col("o_orderpriority").alias(S.CONSTRUCTION),
        (F.col("o_orderkey") % 6 + 1).cast("int").alias(S.ROOMS),
        (F.col("c_custkey") % 120 + 5).cast("double").alias(S.FLOOR_AREA),
    )


LISTING = """listing AS (
  SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, o_totalprice AS price,
         CASE o_custkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'RUB' ELSE 'AMD' END AS currency,
         CASE WHEN o_orderstatus = 'F' THEN 'Daily' ELSE 'Monthly' END AS duration,
         r_name AS province, n_name AS district, c_mktsegment AS street,
         CAST(38.5 AS DOUBLE) + (c_custkey % 250) / CAST(100 AS DOUBLE) AS lat,
         CAST(43.5 AS DOUBLE) + (c_custkey % 300) / CAST(100 AS DOUBLE) AS lon,
         '12/' || c_custkey || ' ' || c_mktsegment || ' st, ' || n_name AS address,
         o_orderpriority AS construction, o_orderkey % 6 + 1 AS rooms,
         CAST(c_custkey % 120 + 5 AS DOUBLE) AS area
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def rates(spark: SparkSession, sf: str) -> DataFrame:
    """Units per USD on the order dates; every 50th day of a year has none."""
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("Date")).distinct()
    days = days.where(F.dayofyear("Date") % 50 != 0)
    d = F.day("Date").cast("double")
    units = F.create_map(F.lit("USD"), F.lit(1.0), F.lit("EUR"), 0.9 + d / 100.0, F.lit("RUB"), 60.0 + d, F.lit("AMD"), 390.0 + d / 4.0)
    return days.select("Date", F.explode(units).alias("Currency", "USD"))


RATES = """rates AS (
  SELECT d AS date, cur AS currency,
         CASE cur WHEN 'USD' THEN CAST(1 AS DOUBLE) WHEN 'EUR' THEN CAST(0.9 AS DOUBLE) + CAST(day(d) AS DOUBLE) / 100
                  WHEN 'RUB' THEN CAST(60 AS DOUBLE) + day(d) ELSE CAST(390 AS DOUBLE) + CAST(day(d) AS DOUBLE) / 4 END AS rate
  FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) days,
       (VALUES ('USD'), ('EUR'), ('RUB'), ('AMD')) curs(cur)
  WHERE dayofyear(d) % 50 <> 0)"""


def item_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Parts with a comma-separated cell that repeats its first item and has a blank one."""
    first = F.split("p_name", " ")[0]
    cell = F.concat(F.replace("p_name", F.lit(" "), F.lit(",")), F.lit(", "), "p_type", F.lit(",none,parking space,"), first)
    return table(spark, sf, "part").select(F.col("p_partkey").alias(S.ROW_ID), cell.alias("cell"))


# The item rows of the cells above: names in title case, the blank one dropped.
ITEMS = """words AS (
  SELECT p_partkey AS id,
         unnest([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), p_type, 'parking space', split_part(p_name, ' ', 1)]) AS word
  FROM part),
items AS (
  SELECT id, CASE WHEN word = 'parking space' THEN 'Parking Space' ELSE upper(word[1]) || lower(word[2:]) END AS item
  FROM words)"""


def messy_listings(spark: SparkSession, sf: str) -> DataFrame:
    """Raw text listings with gaps, odd values and copies, made from the listing view by its row id."""
    v, i = listings(spark, sf, wide_table(spark, sf, "orders")), F.col(S.ROW_ID)
    day = F.when(i % 3 == 0, F.date_format(S.DATE, "yyyy-MM-dd")).when(i % 3 == 1, F.date_format(S.DATE, "dd/MM/yyyy")).otherwise(
        F.date_format(S.DATE, "d.M.yyyy"))

    def text(c: Column) -> Column:
        return c.cast("string")

    base = v.select(
        S.ROW_ID,
        F.when(i % 97 != 0, day).alias("Datetime"),
        F.when(i % 89 != 0, F.col(S.ADDRESS)).otherwise("").alias(S.ADDRESS),
        F.when(i % 83 != 0, text(F.col(S.PRICE))).alias(S.PRICE),
        S.CURRENCY, S.DURATION,
        text(i % 12).alias(S.FLOOR),
        text(i % 9 + 4).alias("Floors_in_the_building"),
        text(F.col(S.FLOOR_AREA)).alias(S.FLOOR_AREA),
        text(i % 5 + 1).alias("Number_of_rooms"),
        text(i % 4).alias("Number_of_bathrooms"),
        F.when(i % 71 != 0, "2.75").alias(S.CEILING_HEIGHT),
        F.when(i % 4 != 0, "euro  repair").otherwise("").alias(S.RENOVATION),
        F.col(S.CONSTRUCTION).alias("Construction_type"),
        F.when(i % 2 == 0, "True").alias("New_construction"),
        F.when(i % 3 == 0, "False").otherwise("yes").alias(S.ELEVATOR),
        F.when(i % 5 == 0, "Not Available").otherwise("sofa").alias("Furniture"),
        F.when(i % 7 == 0, "0").otherwise("open").alias(S.BALCONY),
        F.concat(F.lit("Wi-Fi,parking space, "), F.lower(S.CONSTRUCTION)).alias("amenities"),
        F.when(i % 3 != 0, "Fridge,oven").alias("appliances"),
        F.when(i % 2 != 0, "Garage").otherwise("none").alias("parking"),
        F.lit("x").alias("Gender"), text(F.col(S.LATITUDE)).alias(S.LATITUDE), S.PROVINCE, S.UNIT, S.STREET,
    )
    return base.unionByName(base.where(i % 101 == 0).withColumn(S.ROW_ID, i + 1_000_000_000))


MESSY = f"""{LISTING}, {RATES},
base AS (
  SELECT id, id AS oid, CASE WHEN id % 97 <> 0 THEN date END AS date,
         CASE WHEN id % 89 <> 0 THEN address END AS address,
         CASE WHEN id % 83 <> 0 THEN price END AS price, currency, duration,
         id % 12 AS floor, id % 9 + 4 AS floors, area, id % 5 + 1 AS rooms, id % 4 AS bathrooms,
         CASE WHEN id % 71 <> 0 THEN 2.75 ELSE 0 END AS ceiling
  FROM listing),
raw AS (SELECT * FROM base UNION ALL SELECT id + 1000000000, oid, date, address, price, currency, duration, floor, floors, area, rooms, bathrooms, ceiling
        FROM base WHERE id % 101 = 0),
keyed AS (SELECT *, list_filter([CASE WHEN date IS NULL THEN 'Date was Missing' END, CASE WHEN address IS NULL THEN 'Address was Missing' END,
                    CASE WHEN price IS NULL THEN 'Price was Missing' END], lambda x: x IS NOT NULL) AS r1 FROM raw),
sane AS (SELECT *, CASE WHEN len(r1) > 0 THEN r1 ELSE list_filter([
           CASE WHEN floor > floors THEN 'The floor exceeds the number of floors in the building' END,
           CASE WHEN bathrooms > rooms THEN 'There were more bathrooms than rooms' END,
           CASE WHEN area <= 10 THEN 'The area in square metres is 10 or less' END,
           CASE WHEN ceiling = 0 THEN 'The ceiling height was missing or 0' END], lambda x: x IS NOT NULL) END AS r2 FROM keyed),
pb AS (SELECT currency, duration, quantile_cont(price, 0.01) AS lo, quantile_cont(price, 0.99) AS hi FROM sane WHERE len(r2) = 0 GROUP BY ALL),
t1 AS (SELECT s.*, CASE WHEN len(r2) = 0 AND NOT (price BETWEEN lo AND hi)
         THEN ['The price was outside the 1% to 99% range for its currency and duration'] ELSE r2 END AS r3
       FROM sane s LEFT JOIN pb USING (currency, duration)),
ab AS (SELECT quantile_cont(area, 0.01) AS alo, quantile_cont(area, 0.99) AS ahi FROM t1 WHERE len(r3) = 0),
t2 AS (SELECT t1.*, CASE WHEN len(r3) = 0 AND NOT (area BETWEEN alo AND ahi)
         THEN ['The floor area was outside the 1% to 99% range'] ELSE r3 END AS r4 FROM t1, ab),
firsts AS (SELECT min(id) AS id FROM t2 WHERE len(r4) = 0 GROUP BY oid),
t3 AS (SELECT t2.*, CASE WHEN len(r4) = 0 AND id NOT IN (SELECT id FROM firsts) THEN ['Row was a duplicate'] ELSE r4 END AS r5 FROM t2),
t4 AS (SELECT t3.*, CASE WHEN duration = 'Daily' THEN price * day(last_day(date)) ELSE price END
              / CASE WHEN currency = 'USD' THEN 1 ELSE rate END AS usd
       FROM t3 LEFT JOIN rates USING (date, currency)),
t5 AS (SELECT *, CASE WHEN len(r5) = 0 AND usd IS NULL THEN ['The exchange rate was missing'] ELSE r5 END AS r6 FROM t4),
ub AS (SELECT quantile_cont(usd, 0.01) AS ulo, quantile_cont(usd, 0.99) AS uhi FROM t5 WHERE len(r6) = 0),
verdict AS (SELECT t5.*, CASE WHEN len(r6) = 0 AND NOT (usd BETWEEN ulo AND uhi)
         THEN ['The monthly USD price was outside the 1% to 99% range'] ELSE r6 END AS reasons FROM t5, ub)"""
