"""Address text, components, regions, batches and stored replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentloom import schema as S
from rentloom.cases.ingest import hierarchy
from rentloom.cases.registry import case
from rentloom.cases.tables import table, wide_table
from rentloom.functions import text as T
from rentloom.operators import address as A
from rentloom.operators import replies as R
from rentloom.plans.addresses import resolve_addresses

ID = "c_custkey"


def raw_addresses(spark, sf) -> DataFrame:
    """(id, Address): six spellings made from the customers and their nations."""
    c, n = wide_table(spark, sf, "customer"), table(spark, sf, "nation")
    j = c.join(n, c.c_nationkey == n.n_nationkey)
    k, i, seg = F.col(ID) % 6, F.col(ID).cast("string"), F.col("c_mktsegment")
    area, code = (F.col(ID) % 130).cast("string"), (F.col(ID) % 999 + 1).cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("12/"), i, F.lit(" "), seg, F.lit(" st., "), F.col("n_name")))
        .when(k == 1, F.concat(code, F.lit("-nd Lane  "), code, F.lit(" b "), seg, F.lit(" ave")))
        .when(k == 2, F.concat(F.lit("August 23 Street "), code, F.lit(",none "), F.col("n_name")))
        .when(k == 3, F.concat(area, F.lit("  quarter, Davidashen 3rd Blok, "), code, F.lit("A Abovyan Str")))
        .when(k == 4, F.concat(F.col("n_name"), F.lit(" › "), area, F.lit("-microdistrict "), seg, F.lit(" hwy "), code))
        .otherwise(F.concat(F.lit("улица "), i)))
    return j.select(F.col(ID).alias("id"), text.alias(S.ADDRESS), "n_name", "n_regionkey", "c_mktsegment")


RAW = """raw AS (
  SELECT c_custkey AS id, n_name, c_mktsegment AS seg, CASE c_custkey % 6
    WHEN 0 THEN '12/' || c_custkey || ' ' || c_mktsegment || ' st., ' || n_name
    WHEN 1 THEN (c_custkey % 999 + 1) || '-nd Lane  ' || (c_custkey % 999 + 1) || ' b ' || c_mktsegment || ' ave'
    WHEN 2 THEN 'August 23 Street ' || (c_custkey % 999 + 1) || ',none ' || n_name
    WHEN 3 THEN (c_custkey % 130) || '  quarter, Davidashen 3rd Blok, ' || (c_custkey % 999 + 1) || 'A Abovyan Str'
    WHEN 4 THEN n_name || ' › ' || (c_custkey % 130) || '-microdistrict ' || c_mktsegment || ' hwy ' || (c_custkey % 999 + 1)
    ELSE 'улица ' || c_custkey END AS address
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

ORD = r"(?i)(\d+)-?(st|nd|rd|th)"
SUFFIX = r"(district|micro[-\s]?district|micro|neighborhood|quarter)"


def _area_sql(x: str) -> str:
    for digit, suffix in (("1", "st"), ("2", "nd"), ("3", "rd")):
        x = rf"regexp_replace({x}, '(?i)\b0*((?:\d*[02-9])?{digit})[\s\-]*{SUFFIX}\b', '\1{suffix} \2', 'g')"
    return rf"regexp_replace({x}, '(?i)\b0*(\d+)[\s\-]*{SUFFIX}\b', '\1th \2', 'g')"


def _expand_sql(x: str) -> str:
    x = rf"regexp_replace({x}, '(?i)\b(st\.?|street|str|srteet|stret\.?)\b', 'Street', 'g')"
    x = rf"regexp_replace({x}, '(?i)\b(hwy|highway)\b', 'Highway', 'g')"
    x = rf"regexp_replace({x}, '(?i)\b(ave|avenue|avenu)\b', 'Avenue', 'g')"
    return f"replace({x}, 'Blok', 'Block')"


def _normal_sql(x: str) -> str:
    spaced = rf"regexp_replace({x}, '(?i)_|none|\s+', ' ', 'g')"
    out = _area_sql(rf"regexp_replace({spaced}, '{ORD}', '\1\2', 'g')")
    out = _expand_sql(rf"regexp_replace({out}, '\b(\d{{1,5}})\s+([A-Za-z])\b', '\1\2', 'g')")
    words = rf"string_split_regex(trim({out}), '\s+')"
    cased = rf"list_transform({words}, lambda w: CASE WHEN regexp_matches(w, '^{ORD}') THEN w ELSE upper(w[1]) || lower(w[2:]) END)"
    return rf"CASE WHEN regexp_matches({x}, '[^\x00-\x7F]') AND NOT contains({x}, '›') THEN '' ELSE array_to_string({cased}, ' ') END"


# --- text rules ---------------------------------------------------------------------------------

@case("script_flag", r"""
SELECT doc_id AS id, regexp_matches(text, '[^\x00-\x7F]') AND NOT contains(text, '›') AS flag FROM documents
UNION ALL SELECT 10000000 + conv_id * 1000 + turn, regexp_matches(text, '[^\x00-\x7F]') AND NOT contains(text, '›') FROM conversations""")
def script_flag(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    turns = table(spark, sf, "conversations").select((F.lit(10_000_000) + F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return docs.unionByName(turns).select("id", T.non_ascii_flag("text").alias("flag"))


def _on_texts(spark, sf, build) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.md5(build("text")).alias("out"))
    rows = raw_addresses(spark, sf).select((-F.col("id") - 1).alias("id"), F.md5(build(S.ADDRESS)).alias("out"))
    return docs.unionByName(rows)


def _on_texts_sql(expr) -> str:
    return (f"WITH {RAW} SELECT doc_id AS id, md5({expr('text')}) AS out FROM documents "
            f"UNION ALL SELECT -id - 1, md5({expr('address')}) FROM raw")


@case("compact_ordinals", _on_texts_sql(lambda x: rf"regexp_replace({x}, '{ORD}', '\1\2', 'g')"))
def compact_ordinals(spark, sf):
    return _on_texts(spark, sf, T.compact_ordinals)


@case("ordinalize_quarters", """
WITH t AS (SELECT c_custkey AS id, c_custkey AS n, c_custkey % 211 AS m FROM customer),
s AS (SELECT *, CASE WHEN n % 100 BETWEEN 10 AND 20 THEN 'th' WHEN n % 10 = 1 THEN 'st' WHEN n % 10 = 2 THEN 'nd' WHEN n % 10 = 3 THEN 'rd' ELSE 'th' END AS a,
  CASE WHEN m % 100 BETWEEN 10 AND 20 THEN 'th' WHEN m % 10 = 1 THEN 'st' WHEN m % 10 = 2 THEN 'nd' WHEN m % 10 = 3 THEN 'rd' ELSE 'th' END AS b FROM t)
SELECT id, n || a || ' Quarter, x ' || m || b || ' micro-district 7 houses' AS out FROM s""")
def ordinalize_quarters(spark, sf):
    n, m = F.col(ID).cast("string"), (F.col(ID) % 211).cast("string")
    text = F.concat(n, F.lit(" Quarter, x "), m, F.lit(" - micro-district 7 houses"))
    return table(spark, sf, "customer").select(F.col(ID).alias("id"), T.ordinalize_areas(text).alias("out"))


@case("join_alnum_codes", _on_texts_sql(lambda x: rf"regexp_replace({x}, '\b(\d{{1,5}})\s+([A-Za-z])\b', '\1\2', 'g')"))
def join_alnum_codes(spark, sf):
    return _on_texts(spark, sf, T.join_codes)


@case("expand_abbreviations", f"WITH {RAW} SELECT id, {_expand_sql('address')} AS out FROM raw")
def expand_abbreviations(spark, sf):
    return raw_addresses(spark, sf).select("id", T.expand_abbreviations(S.ADDRESS).alias("out"))


@case("normalize_address", f"WITH {RAW} SELECT id, {_normal_sql('address')} AS out FROM raw")
def normalize_address(spark, sf):
    return raw_addresses(spark, sf).select("id", T.normalize_address(S.ADDRESS).alias("out"))


# --- components -----------------------------------------------------------------------------------

PATTERNS = {
    S.BLOCK: r"(?i)\b(?:[A-Za-z]+(?:[-\s][A-Za-z]+)*\s+)?\d*(?:st|nd|rd|th)?\s*(?:Block|Blok)\b",
    S.LANE: r"(?i)\b\d+(?:st|nd|rd|th)\s+(?:Lane|Alley|Line|Deadlock)\b",
    # Ordinals are compact here ("2nd"), so the word boundary alone keeps them out.
    S.BUILDING: r"(?i)\b\d{1,3}(?:[-/]\d+)?[a-zA-Z]?\b",
    S.NEIGHBOURHOOD: rf"(?i)[A-Za-z0-9\-\s]+?\b(?:{SUFFIX[1:-1]})\b(?:\s+[A-Za-z0-9\-]+)?",
    S.STREET_NUMBER: r"(?i)\d+-?(?:st|nd|rd|th)",
}


def _extract_sql(name: str, source: str, src: str, dst: str, column: str, last: bool, keep: bool = False) -> str:
    """One step as a CTE: finds the match, cuts it, keeps a filled target."""
    element = "list_last" if last else "list_first"
    building = column == S.BUILDING
    rest = "CASE WHEN m <> '' THEN trim(left(s, strpos(s, m) - 1) || substr(s, strpos(s, m) + length(m))) ELSE trim(s) END"
    value = "CASE WHEN trim(coalesce(d, '')) <> '' THEN d ELSE trim(m) END"
    if building:
        value = f"CASE WHEN contains({rest}, 'August') OR contains({rest}, 'Commissars') THEN '' ELSE {value} END"
        rest = f"CASE WHEN contains({rest}, 'August') THEN 'August 23 Street' WHEN contains({rest}, 'Commissars') THEN '26 Commissars Street' ELSE {rest} END"
    if keep:
        rest = "s"
    return f"""{name}_m AS (SELECT *, {src} AS s, {dst} AS d, coalesce({element}(regexp_extract_all({src}, '{PATTERNS[column]}')), '') AS m FROM {source}),
{name} AS (SELECT * EXCLUDE ({src}, {dst}, s, d, m), {rest} AS {src}, {value} AS {dst} FROM {name}_m)"""


NORMAL = f"{RAW}, normal AS (SELECT id, n_name, seg, {_normal_sql('address')} AS text FROM raw)"


@case("extract_street_number", f"""
WITH {NORMAL}, input AS (SELECT id, text AS street, CASE WHEN id % 10 = 0 THEN 'kept' ELSE '' END AS number FROM normal),
{_extract_sql('a', 'input', 'street', 'number', S.STREET_NUMBER, False)} SELECT id, street, number FROM a""")
def extract_street_number(spark, sf):
    df = raw_addresses(spark, sf).select(
        "id", T.normalize_address(S.ADDRESS).alias("street"), F.when(F.col("id") % 10 == 0, "kept").otherwise("").alias("number"))
    return A.extract_component(df, "street", "number", S.ORDINAL)


@case("extract_building_last", f"""
WITH {NORMAL}, input AS (SELECT id, text AS street, '' AS building FROM normal),
{_extract_sql('a', 'input', 'street', 'building', S.BUILDING, True)} SELECT id, street, building FROM a""")
def extract_building_last(spark, sf):
    df = raw_addresses(spark, sf).select("id", T.normalize_address(S.ADDRESS).alias("street"), F.lit("").alias(S.BUILDING))
    return A.extract_component(df, "street", S.BUILDING, S.BUILDING_PATTERN, last=True).withColumnRenamed(S.BUILDING, "building")


@case("extract_all_components", f"""
WITH {NORMAL}, input AS (SELECT id, text AS street, text AS translated, '' AS block, '' AS lane, '' AS building, '' AS number,
  CASE WHEN id % 8 = 0 THEN 'Ani 4th Block' ELSE '' END AS area FROM normal),
{_extract_sql('a', 'input', 'street', 'block', S.BLOCK, False)}, {_extract_sql('b', 'a', 'street', 'lane', S.LANE, False)},
{_extract_sql('c', 'b', 'street', 'building', S.BUILDING, True)}, {_extract_sql('d', 'c', 'street', 'area', S.NEIGHBOURHOOD, False)},
{_extract_sql('e', 'd', 'street', 'number', S.STREET_NUMBER, False)}, {_extract_sql('f', 'e', 'area', 'block', S.BLOCK, False)},
{_extract_sql('g', 'f', 'translated', 'building', S.BUILDING, True, True)}
SELECT id, street, block, lane, building, area, number FROM g""")
def extract_all_components(spark, sf):
    text = T.normalize_address(S.ADDRESS)
    df = raw_addresses(spark, sf).select(
        "id", text.alias(S.STREET), text.alias(S.TRANSLATED), F.when(F.col("id") % 8 == 0, "Ani 4th Block").otherwise("").alias(S.NEIGHBOURHOOD))
    out = A.extract_all_components(df)
    names = {S.STREET: "street", S.BLOCK: "block", S.LANE: "lane", S.BUILDING: "building", S.NEIGHBOURHOOD: "area", S.STREET_NUMBER: "number"}
    return out.select("id", *[F.col(f"`{c}`").alias(n) for c, n in names.items()])


@case("restore_numbered_streets", """
SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'August 23 Street' WHEN 1 THEN '26 Commissars Street' ELSE c_mktsegment END AS street,
       CASE WHEN c_custkey % 3 = 2 THEN '7' ELSE '' END AS building FROM customer""")
def restore_numbered_streets(spark, sf):
    k = F.col(ID) % 3
    street = F.when(k == 0, "August  Street").when(k == 1, F.concat(F.lit("Commissars "), "c_mktsegment")).otherwise(F.col("c_mktsegment"))
    fixed, building = A.restore_numbered_street(street, F.lit("7"))
    return table(spark, sf, "customer").select(F.col(ID).alias("id"), fixed.alias("street"), building.alias("building"))


@case("split_on_delimiters", f"""
WITH {RAW}, p AS (SELECT *, CASE WHEN id % 7 = 0 THEN 'Old Street' ELSE '' END AS street0, CASE WHEN id % 5 = 0 THEN 'Old Town' END AS town0,
  CASE WHEN contains(address, ',') THEN ',' WHEN contains(address, '›') THEN '›' END AS mark FROM raw),
q AS (SELECT *, trim(left(address, strpos(address, mark) - 1)) AS a, trim(substr(address, strpos(address, mark) + 1)) AS b FROM p),
w AS (SELECT *, CASE WHEN mark IS NULL OR length(a) < 3 THEN '' ELSE a END AS x, CASE WHEN mark IS NULL OR length(b) < 3 THEN '' ELSE b END AS y FROM q)
SELECT id, CASE WHEN street0 <> '' THEN street0 WHEN mark = '›' THEN y ELSE x END AS street,
  CASE WHEN town0 IS NOT NULL THEN town0 WHEN mark = '›' THEN x ELSE y END AS town FROM w""")
def split_on_delimiters(spark, sf):
    i = F.col("id")
    street, town = A.split_on_delimiters(S.ADDRESS, "street0", "town0")
    df = raw_addresses(spark, sf).withColumns({
        "street0": F.when(i % 7 == 0, "Old Street").otherwise(" "), "town0": F.when(i % 5 == 0, "Old Town")})
    return df.select("id", street.alias("street"), town.alias("town"))


@case("repair_generic_streets", """
WITH t AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Street' WHEN 1 THEN n_name WHEN 2 THEN 'Main Street' END AS street,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS town, n_name AS unit, r_name AS province
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT id, CASE WHEN street = unit THEN NULL WHEN street = 'Street' THEN CASE WHEN town <> '' THEN town ELSE unit END || ' Street' ELSE street END AS street FROM t""")
def repair_generic_streets(spark, sf):
    c, n, r = table(spark, sf, "customer"), table(spark, sf, "nation"), table(spark, sf, "region")
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    k = F.col(ID) % 4
    # The filler rule turns an underscore into a space, so the places are compared without one.
    name = F.replace("n_name", F.lit("_"), F.lit(" "))
    df = j.select(
        F.col(ID).alias("id"), F.when(k == 0, "Street").when(k == 1, F.col("n_name")).when(k == 2, "Main Street").alias(S.STREET),
        F.when(F.col(ID) % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias(S.TOWN), F.lit(None).cast("string").alias(S.VILLAGE),
        name.alias(S.UNIT), F.col("r_name").alias(S.PROVINCE))
    out = A.repair_generic_streets(df)
    return out.select("id", F.replace(S.STREET, F.lit("NATION "), F.lit("NATION_")).alias("street"))


# --- regions ------------------------------------------------------------------------------------------

def _choices(spark, sf) -> DataFrame:
    """Names to look up: market segments and part types in title case, and two-word names."""
    seg = table(spark, sf, "customer").select(F.initcap("c_mktsegment").alias("name")).distinct()
    kind = table(spark, sf, "part").select(F.initcap("p_type").alias("name")).distinct()
    return seg.unionByName(kind).unionByName(seg.select(F.concat(F.lit("North "), "name").alias("name"))).distinct()


def _misspelt(spark, sf) -> DataFrame:
    """Customers with a text naming their segment exactly, with an edit, as two words, or not at all."""
    c, i, s = table(spark, sf, "customer"), F.col(ID), F.lower("c_mktsegment")
    at = (i % 7 + 1).cast("int")
    dropped = F.concat(F.substring(s, F.lit(1), at), F.substring(s, at + 2, F.lit(99)))
    swapped = F.concat(F.substring(s, F.lit(1), at), F.lit("x"), F.substring(s, at + 2, F.lit(99)))
    word = (F.when(i % 6 == 0, s).when(i % 6 == 1, dropped).when(i % 6 == 2, swapped)
            .when(i % 6 == 3, F.concat(F.lit("nort "), s)).when(i % 6 == 4, F.concat(s, F.lit("s, North "), dropped)).otherwise("nowhere"))
    return c.select(i.alias("id"), F.concat((i % 50).cast("string"), F.lit(" main street, "), word, F.lit(" x")).alias("text"))


MISSPELT = """texts AS (
  SELECT id, (id % 50) || ' main street, ' || CASE id % 6 WHEN 0 THEN s WHEN 1 THEN dropped WHEN 2 THEN left(s, cut) || 'x' || substr(s, cut + 2)
    WHEN 3 THEN 'nort ' || s WHEN 4 THEN s || 's, North ' || dropped ELSE 'nowhere' END || ' x' AS text
  FROM (SELECT *, left(s, cut) || substr(s, cut + 2) AS dropped FROM
    (SELECT c_custkey AS id, lower(c_mktsegment) AS s, (c_custkey % 7 + 1)::INTEGER AS cut FROM customer))),
segs AS (SELECT DISTINCT upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS name FROM customer),
choices AS (SELECT name FROM segs UNION SELECT upper(p_type[1]) || lower(p_type[2:]) FROM part UNION SELECT 'North ' || name FROM segs)"""


def _fuzzy_sql(prefix: str, texts: str, choices: str) -> str:
    """Brute force: every distinct phrase against every name."""
    return f"""{prefix}w AS (SELECT id, string_split_regex(trim(lower(replace(text, ',', ''))), '\\s+') AS ws FROM {texts}),
{prefix}x AS (SELECT id, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS pos FROM {prefix}w),
{prefix}exact AS (SELECT id, arg_min(name, pos) AS name FROM {prefix}x JOIN {choices} ON w = lower(name)
  AND name = upper(name[1]) || lower(name[2:]) GROUP BY 1),
{prefix}p AS (SELECT id, unnest(list_concat(ws, list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1]))) AS phrase
  FROM {prefix}w WHERE id NOT IN (SELECT id FROM {prefix}exact)),
{prefix}d AS (SELECT DISTINCT phrase FROM {prefix}p),
{prefix}s AS (SELECT phrase, name, 100 * (1 - levenshtein(phrase, lower(name))::DOUBLE / (length(phrase) + length(name))) AS score FROM {prefix}d, {choices}),
{prefix}f AS (SELECT id, name, row_number() OVER (PARTITION BY id ORDER BY score DESC, name) AS rn FROM {prefix}p JOIN {prefix}s USING (phrase) WHERE score >= 90),
{prefix}match AS (SELECT t.id, coalesce(e.name, f.name, '') AS match FROM {texts} t LEFT JOIN {prefix}exact e USING (id)
  LEFT JOIN (SELECT * FROM {prefix}f WHERE rn = 1) f USING (id))"""


@case("fuzzy_lookup", f"WITH {MISSPELT}, {_fuzzy_sql('z', 'texts', 'choices')} SELECT id, match FROM zmatch")
def fuzzy_lookup(spark, sf):
    return A.fuzzy_lookup(_misspelt(spark, sf), "id", "text", _choices(spark, sf), "name")


@case("similar_pairs", """
WITH a AS (SELECT DISTINCT left(p_name, (p_partkey % 9)::INTEGER) || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE substr(p_name, (p_partkey % 9)::INTEGER + 1, 2) END
  || substr(p_name, (p_partkey % 9)::INTEGER + 2) AS phrase FROM part),
b AS (SELECT DISTINCT p_name AS name FROM part)
SELECT phrase, name, round(100 * (1 - levenshtein(phrase, name)::DOUBLE / (length(phrase) + length(name))), 6) AS score FROM a, b
WHERE 100 * (1 - levenshtein(phrase, name)::DOUBLE / (length(phrase) + length(name))) >= 80""")
def similar_pairs(spark, sf):
    p, at, name = table(spark, sf, "part"), (F.col("p_partkey") % 9).cast("int"), F.col("p_name")
    middle = F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, "x").otherwise(F.substring(name, at + 1, F.lit(2)))
    phrases = p.select(F.concat(F.left(name, at), middle, F.substring(name, at + 2, F.lit(99))).alias("phrase")).distinct()
    return A.similar_pairs(phrases, p.select(name.alias("name")).distinct(), 80).withColumn("score", F.round("score", 6))


@case("ratio_pairs")
def ratio_pairs(spark, sf):
    """The same names with a letter left out, put in or replaced, or their words the other way round."""
    p, at, name = table(spark, sf, "part"), (F.col("p_partkey") % 9).cast("int"), F.col("p_name")
    changed = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.left(name, at), F.lit("x"), F.substring(name, at + 2, F.lit(99)))).otherwise(
        F.array_join(F.reverse(F.split(name, " ")), " "))
    phrases = p.select(changed.alias("phrase")).distinct()
    return A.ratio_pairs(phrases, p.select(name.alias("name")).distinct(), 90).withColumn("score", F.round("score", 6))


def _title(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit("")))


def _region_rows(spark, sf) -> DataFrame:
    c, n, r = table(spark, sf, "customer"), table(spark, sf, "nation"), table(spark, sf, "region")
    j, i = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey), F.col(ID)
    unit, province = _title(F.col("n_name")), F.initcap("r_name")
    return j.select(
        i.alias("id"),
        F.concat(F.lit("1 Main Road, "), F.when(i % 4 == 0, unit).when(i % 4 == 1, F.concat(unit, F.lit(", "), province)).otherwise("Hill")).alias(S.TRANSLATED),
        F.when(i % 4 == 2, province).when(i % 20 == 1, "Asia").otherwise("").alias(S.PROVINCE),
        F.when(i % 8 == 3, unit).otherwise("").alias(S.UNIT),
        F.when(i % 4 == 2, F.concat(F.initcap("c_mktsegment"), F.lit("ville "), unit)).alias(S.TOWN))


def _region_tables(spark, sf):
    found = hierarchy(spark, sf)
    name = F.concat(F.initcap("locality"), F.lit("ville "), _title(F.col("unit")))
    return (found.provinces.select(F.initcap("province").alias("province")),
            found.units.select(_title(F.col("unit")).alias("unit"), F.initcap("province").alias("province")),
            found.localities.select(name.alias("locality"), _title(F.col("unit")).alias("unit"), F.initcap("province").alias("province")))


def _cap(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


REGION_ROWS = f"""units AS (SELECT {_cap("replace(n_name, '_', '')")} AS unit, {_cap('r_name')} AS province, n_nationkey, n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey),
places AS (SELECT DISTINCT {_cap('c_mktsegment')} || 'ville ' || unit AS locality, unit, province FROM customer JOIN units ON c_nationkey = n_nationkey WHERE n_regionkey <> 0),
texts AS (SELECT c_custkey AS id, '1 Main Road, ' || CASE c_custkey % 4 WHEN 0 THEN unit WHEN 1 THEN unit || ', ' || province ELSE 'Hill' END AS text,
  CASE WHEN c_custkey % 4 = 2 THEN province WHEN c_custkey % 20 = 1 THEN 'Asia' ELSE '' END AS p0, CASE WHEN c_custkey % 8 = 3 THEN unit ELSE '' END AS u0,
  CASE WHEN c_custkey % 4 = 2 THEN {_cap('c_mktsegment')} || 'ville ' || unit END AS town FROM customer JOIN units ON c_nationkey = n_nationkey),
pnames AS (SELECT DISTINCT province AS name FROM units), unames AS (SELECT unit AS name FROM units)"""


@case("resolve_region", f"""
WITH {REGION_ROWS}, {_fuzzy_sql('p', 'texts', 'pnames')}, {_fuzzy_sql('u', 'texts', 'unames')},
g AS (SELECT t.*, p.match AS pg, u.match AS ug FROM texts t JOIN pmatch p USING (id) JOIN umatch u USING (id)),
h AS (SELECT g.*, CASE WHEN p0 <> '' THEN p0 ELSE pg END AS p1 FROM g),
i AS (SELECT h.*, CASE WHEN u0 <> '' THEN u0 WHEN EXISTS (SELECT 1 FROM units WHERE unit = ug AND province = p1) THEN ug ELSE '' END AS u1 FROM h),
k AS (SELECT i.*, CASE WHEN p1 <> '' THEN p1 ELSE coalesce((SELECT province FROM units WHERE unit = u1), '') END AS p2 FROM i)
SELECT id, p2 AS province, CASE WHEN u1 <> '' THEN u1 ELSE coalesce((SELECT min(unit) FROM places WHERE locality = town AND (province = p2 OR p2 = '')), '') END AS unit FROM k""")
def resolve_region(spark, sf):
    provinces, units, localities = _region_tables(spark, sf)
    out = A.resolve_region(_region_rows(spark, sf), "id", S.TRANSLATED, provinces, units, localities)
    return out.select("id", F.col(S.PROVINCE).alias("province"), F.col(S.UNIT).alias("unit"))


@case("fill_unit_by_street", """
WITH t AS (SELECT c_custkey AS id, r_name AS province, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE c_mktsegment END AS street, CASE WHEN c_custkey % 4 = 0 THEN n_name ELSE '' END AS unit
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
k AS (SELECT province, street, arg_min(unit, id) AS u FROM t WHERE unit <> '' AND street <> '' GROUP BY ALL)
SELECT id, CASE WHEN unit <> '' THEN unit ELSE coalesce(u, '') END AS unit FROM t LEFT JOIN k USING (province, street)""")
def fill_unit_by_street(spark, sf):
    c, n, r = table(spark, sf, "customer"), table(spark, sf, "nation"), table(spark, sf, "region")
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    df = j.select(
        F.col(ID).alias("id"), F.col("r_name").alias(S.PROVINCE), F.when(F.col(ID) % 9 == 0, " ").otherwise(F.col("c_mktsegment")).alias(S.STREET),
        F.when(F.col(ID) % 4 == 0, F.col("n_name")).otherwise("").alias(S.UNIT))
    return A.fill_unit_by_street(df, "id").select("id", F.col(S.UNIT).alias("unit"))


@case("pack_batches", """
SELECT count(DISTINCT text) AS texts, 0::BIGINT AS too_many, 0::BIGINT AS too_large FROM documents WHERE regexp_matches(text, '[^\\x00-\\x7F]') AND NOT contains(text, '›')""")
def pack_batches(spark, sf):
    texts = A.select_untranslated(table(spark, sf, "documents"), "text")
    batches = A.pack_batches(texts, "text")
    # An escaped character takes one byte more than the character itself.
    heavy = F.aggregate("texts", F.lit(0), lambda n, t: n + F.octet_length(t) + 2)
    return batches.agg(
        F.sum(F.size("texts")).alias("texts"), F.count_if(F.size("texts") > S.BATCH_ITEMS).alias("too_many"),
        F.count_if((heavy > S.BATCH_BYTES) & (F.size("texts") > 1)).alias("too_large"))


@case("select_untranslated", r"""
SELECT DISTINCT md5(text) AS text FROM documents WHERE regexp_matches(text, '[^\x00-\x7F]') AND NOT contains(text, '›')""")
def select_untranslated(spark, sf):
    return A.select_untranslated(table(spark, sf, "documents"), "text").select(F.md5("text").alias("text"))


# --- stored replies ------------------------------------------------------------------------------------

def _customers(spark, sf) -> DataFrame:
    c, n, r = wide_table(spark, sf, "customer"), table(spark, sf, "nation"), table(spark, sf, "region")
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)


CUSTOMERS = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def nominatim_bodies(df: DataFrame) -> DataFrame:
    k = F.col(ID) % 4
    address = F.struct(
        F.col(ID).cast("string").alias("house_number"), F.col("c_mktsegment").alias("road"),
        F.when(k == 3, F.concat(F.col("c_mktsegment"), F.lit(" highway"))).alias("highway"),
        F.when(k == 0, "Kentron").otherwise("Old Town").alias("suburb"), F.when(k == 1, F.col("n_name")).alias("municipality"),
        F.col("r_name").alias("state"), F.lit("City").alias("city"), F.when(k == 3, "Town").alias("town"),
        F.when(k == 1, "Hill Village").alias("locality"))
    reply = F.struct((F.col(ID) / 8.0).cast("string").alias("lat"), F.when(k != 1, (F.col(ID) / 4.0).cast("string")).alias("lon"), address.alias("address"))
    return df.withColumn("body", F.when(k == 2, "[]").otherwise(F.to_json(F.array(reply))))


def _named(df: DataFrame, *extra: str) -> DataFrame:
    names = {S.LATITUDE: "lat", S.LONGITUDE: "lon", S.VILLAGE: "village", S.BUILDING: "building", S.STREET: "street", S.TOWN: "town",
             S.UNIT: "unit", S.NEIGHBOURHOOD: "area", S.PROVINCE: "province", S.COUNTRY: "country"}
    return df.select(*extra, *[F.col(f"`{c}`").alias(n) for c, n in names.items()])


@case("flatten_nominatim", f"""
WITH t AS (SELECT c_custkey AS id, c_custkey % 4 AS k, * FROM {CUSTOMERS})
SELECT id, CASE WHEN k <> 2 THEN id::DOUBLE / 8 END AS lat, CASE WHEN k = 1 THEN 0 WHEN k <> 2 THEN id::DOUBLE / 4 END AS lon,
 CASE WHEN k = 1 THEN 'Hill Village' END AS village, CASE WHEN k <> 2 THEN id::VARCHAR END AS building,
 CASE WHEN k = 3 THEN c_mktsegment || ' highway' WHEN k <> 2 THEN c_mktsegment END AS street, CASE WHEN k = 3 THEN 'Town' WHEN k <> 2 THEN 'City' END AS town,
 CASE WHEN k = 0 THEN 'Kentron' WHEN k = 1 THEN n_name END AS unit, CASE WHEN k IN (1, 3) THEN 'Old Town' END AS area,
 CASE WHEN k <> 2 THEN r_name END AS province, NULL::VARCHAR AS country FROM t""")
def flatten_nominatim(spark, sf):
    df = nominatim_bodies(_customers(spark, sf)).select(F.col(ID).alias("id"), "body")
    return _named(R.flatten_nominatim(df), "id")


def azure_bodies(df: DataFrame) -> DataFrame:
    k = F.col(ID) % 5
    address = F.struct(
        F.concat(F.lit("Line "), F.col(ID).cast("string")).alias("freeformAddress"), F.col("r_name").alias("countrySubdivision"),
        F.when(k == 1, F.col("n_name")).alias("countrySecondarySubdivision"), F.lit("Muni").alias("municipality"),
        F.lit("Near").alias("neighbourhood"), F.lit("Local").alias("locality"),
        F.when(k != 2, F.col("c_mktsegment")).alias("streetName"), F.lit("9").alias("streetNumber"), F.lit("Armenia").alias("country"),
        F.when(k == 3, "AM").alias("countryRegion"))
    score = F.when(k == 0, 0.5).when(k == 1, 0.7).when(k == 2, 0.95)
    reply = F.struct(F.struct(score.alias("score")).alias("matchConfidence"), F.struct((F.col(ID) / 8.0).alias("lat"), (F.col(ID) / 4.0).alias("lon")).alias("position"), address.alias("address"))
    return df.withColumn("body", F.when(k == 4, '{"results": []}').otherwise(F.to_json(F.struct(F.array(reply).alias("results")))))


@case("flatten_azure", f"""
WITH t AS (SELECT c_custkey AS id, c_custkey % 5 AS k, c_custkey % 5 IN (1, 2, 3) AS ok, * FROM {CUSTOMERS})
SELECT id, CASE WHEN ok THEN id::DOUBLE / 8 END AS lat, CASE WHEN ok THEN id::DOUBLE / 4 END AS lon, NULL::VARCHAR AS village, NULL::VARCHAR AS building,
 CASE WHEN k = 2 THEN '9' WHEN ok THEN c_mktsegment END AS street, CASE WHEN ok THEN 'Local' END AS town,
 CASE WHEN k = 1 THEN n_name WHEN ok THEN 'Muni' END AS unit, CASE WHEN ok THEN 'Near' END AS area, CASE WHEN ok THEN r_name END AS province,
 CASE WHEN k = 3 THEN 'AM' WHEN ok THEN 'Armenia' END AS country FROM t""")
def flatten_azure(spark, sf):
    df = azure_bodies(_customers(spark, sf)).select(F.col(ID).alias("id"), "body")
    return _named(R.flatten_azure(df), "id")


def yandex_bodies(df: DataFrame) -> DataFrame:
    k = F.col(ID) % 4

    def part(kind: str, name: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"))

    parts = F.array(
        part("country", F.lit("Armenia")), part("province", F.lit("Outer")), part("province", F.col("r_name")), part("area", F.col("n_name")),
        part("locality", F.when(k == 1, "Hill Village").otherwise("City")), part("street", F.col("c_mktsegment")),
        part("house", F.when(k == 2, "").otherwise(F.col(ID).cast("string"))))
    meta = F.struct(F.struct(F.lit("line").alias("formatted"), parts.alias("Components")).alias("Address"))
    pos = F.concat((F.col(ID) / 4.0).cast("string"), F.lit(" "), (F.col(ID) / 8.0).cast("string"))
    place = F.struct(F.struct(meta.alias("GeocoderMetaData")).alias("metaDataProperty"), F.struct(pos.alias("pos")).alias("Point"))
    geo = F.struct(place.alias("GeoObject"))
    reply = F.struct(F.struct(F.struct(F.array(geo).alias("featureMember")).alias("GeoObjectCollection")).alias("response"))
    return df.withColumn("body", F.when(k == 3, '{"response": {"GeoObjectCollection": {"featureMember": []}}}').otherwise(F.to_json(reply)))


@case("flatten_yandex", f"""
WITH t AS (SELECT c_custkey AS id, c_custkey % 4 AS k, c_custkey % 4 <> 3 AS ok, * FROM {CUSTOMERS})
SELECT id, CASE WHEN ok THEN id::DOUBLE / 8 END AS lat, CASE WHEN ok THEN id::DOUBLE / 4 END AS lon, CASE WHEN k = 1 THEN 'Hill Village' END AS village,
 CASE WHEN ok AND k <> 2 THEN id::VARCHAR END AS building, CASE WHEN ok THEN c_mktsegment END AS street, CASE WHEN ok AND k <> 1 THEN 'City' END AS town,
 CASE WHEN ok THEN n_name END AS unit, NULL::VARCHAR AS area, CASE WHEN ok THEN r_name END AS province, CASE WHEN ok THEN 'Armenia' END AS country FROM t""")
def flatten_yandex(spark, sf):
    df = yandex_bodies(_customers(spark, sf)).select(F.col(ID).alias("id"), "body")
    return _named(R.flatten_yandex(df), "id")


@case("flatten_labels", f"""
SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey::VARCHAR END AS building, n_name AS town, r_name AS province FROM {CUSTOMERS}""")
def flatten_labels(spark, sf):
    labels = F.struct(F.when(F.col(ID) % 3 == 0, "").otherwise(F.col(ID).cast("string")).alias("house_number"),
                      F.concat(F.lit(" "), "n_name").alias("city"), F.col("r_name").alias("state"))
    df = _customers(spark, sf).select(F.col(ID).alias("id"), F.to_json(labels).alias("body"))
    return R.flatten_labels(df).select("id", F.col(S.BUILDING).alias("building"), F.col(S.TOWN).alias("town"), F.col(S.PROVINCE).alias("province"))


def stored_replies(spark, sf) -> DataFrame:
    """Replies of three providers; every third native text has none, and half of the texts are not ASCII."""
    base = _customers(spark, sf).select(
        ID, "c_mktsegment", "n_name", "r_name", F.concat(F.when(F.col(ID) % 2 == 0, "улица ").otherwise("road "), F.col(ID).cast("string")).alias("address"))
    made = [(yandex_bodies, "Yandex"), (nominatim_bodies, "Nominatim"), (azure_bodies, "Azure")]
    parts = [f(base).where(F.col(ID) % 7 != n).select("address", ID, F.lit(p).alias("provider"), "body") for n, (f, p) in enumerate(made)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    native = every.where(F.col(ID) % 3 != 0).select("address", F.lit("native").alias("candidate"), F.col("address").alias("text"), "provider", "body")
    other = every.where(F.col(ID) % 11 != 0).select(
        "address", F.lit("translated").alias("candidate"), F.concat(F.lit("road "), F.col(ID).cast("string")).alias("text"), "provider", "body")
    return native.unionByName(other)


MERGED = f"""c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'улица ' ELSE 'road ' END || c_custkey AS address, * FROM {CUSTOMERS}),
flat AS (
 SELECT id, address, 'Yandex' AS provider, CASE WHEN id % 4 <> 3 THEN c_mktsegment END AS street, CASE WHEN id % 4 NOT IN (1, 3) THEN 'City' END AS town,
   CASE WHEN id % 4 <> 3 THEN n_name END AS unit, CASE WHEN id % 4 <> 3 THEN 'Armenia' END AS country, NULL AS area FROM c WHERE id % 7 <> 0
 UNION ALL SELECT id, address, 'Nominatim', CASE WHEN id % 4 = 3 THEN c_mktsegment || ' highway' WHEN id % 4 <> 2 THEN c_mktsegment END,
   CASE WHEN id % 4 = 3 THEN 'Town' WHEN id % 4 <> 2 THEN 'City' END, CASE WHEN id % 4 = 0 THEN 'Kentron' WHEN id % 4 = 1 THEN n_name END, NULL,
   CASE WHEN id % 4 IN (1, 3) THEN 'Old Town' END FROM c WHERE id % 7 <> 1
 UNION ALL SELECT id, address, 'Azure', CASE WHEN id % 5 = 2 THEN '9' WHEN id % 5 IN (1, 3) THEN c_mktsegment END, CASE WHEN id % 5 IN (1, 2, 3) THEN 'Local' END,
   CASE WHEN id % 5 = 1 THEN n_name WHEN id % 5 IN (2, 3) THEN 'Muni' END, CASE WHEN id % 5 = 3 THEN 'AM' WHEN id % 5 IN (1, 2) THEN 'Armenia' END,
   CASE WHEN id % 5 IN (1, 2, 3) THEN 'Near' END FROM c WHERE id % 7 <> 2),
asked AS (SELECT *, 1 AS cand, id % 2 = 0 AS foreign_text FROM flat WHERE id % 3 <> 0 UNION ALL SELECT *, 2, false FROM flat WHERE id % 11 <> 0),
ranked AS (SELECT *, CASE WHEN foreign_text THEN list_position(['Yandex', 'Nominatim', 'Azure'], provider) ELSE list_position(['Azure', 'Nominatim', 'Yandex'], provider) END AS prio FROM asked),
best AS (SELECT address, cand, arg_min(provider, prio) FILTER (coalesce(street, town, unit, country, area) IS NOT NULL) AS api,
  arg_min(street, prio) FILTER (street IS NOT NULL) AS street, arg_min(town, prio) FILTER (town IS NOT NULL) AS town,
  arg_min(unit, prio) FILTER (unit IS NOT NULL) AS unit, arg_min(country, prio) FILTER (country IS NOT NULL) AS country,
  arg_min(area, prio) FILTER (area IS NOT NULL) AS area FROM ranked GROUP BY ALL),
merged AS (SELECT DISTINCT a.address, b.* EXCLUDE (address) FROM (SELECT DISTINCT address FROM asked) a LEFT JOIN
  (SELECT * FROM best WHERE api IS NOT NULL QUALIFY row_number() OVER (PARTITION BY address ORDER BY cand) = 1) b USING (address))"""


@case("merge_providers", f"""
WITH {MERGED} SELECT address, CASE WHEN api IS NULL THEN 'FAILED' ELSE 'OK' END AS status, api, street, town, unit, country, area FROM merged""")
def merge_providers(spark, sf):
    out = R.merge_providers(stored_replies(spark, sf))
    return out.select("address", F.col("Status").alias("status"), "api", F.col(S.STREET).alias("street"), F.col(S.TOWN).alias("town"),
                      F.col(S.UNIT).alias("unit"), F.col(S.COUNTRY).alias("country"), F.col(S.NEIGHBOURHOOD).alias("area"))


@case("resolve_addresses", f"""
WITH {RAW},
base AS (SELECT raw.id, r_name, CASE WHEN raw.id % 6 = 5 THEN seg || ' st, ' || raw.n_name ELSE address END AS t0,
  CASE WHEN raw.id % 4 = 0 THEN seg END AS s0, CASE WHEN raw.id % 4 = 0 THEN 'City' ELSE '' END AS town0, CASE WHEN raw.id % 4 = 0 THEN raw.id::VARCHAR ELSE '' END AS b0,
  CASE WHEN raw.id % 4 = 0 THEN 'Kentron' ELSE '' END AS u0, CASE WHEN raw.id % 4 = 0 THEN r_name ELSE '' END AS p0
  FROM raw JOIN customer ON c_custkey = raw.id JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
norm AS (SELECT *, {_normal_sql('t0')} AS translated, coalesce({_normal_sql('s0')}, '') AS s1 FROM base),
marked AS (SELECT *, CASE WHEN contains(translated, ',') THEN ',' WHEN contains(translated, '›') THEN '›' END AS mark FROM norm),
parts AS (SELECT *, CASE WHEN mark IS NULL THEN '' ELSE trim(left(translated, strpos(translated, mark) - 1)) END AS a,
  CASE WHEN mark IS NULL THEN '' ELSE trim(substr(translated, strpos(translated, mark) + 1)) END AS b FROM marked),
sized AS (SELECT *, CASE WHEN length(a) < 3 THEN '' ELSE a END AS x, CASE WHEN length(b) < 3 THEN '' ELSE b END AS y FROM parts),
input AS (SELECT id, translated, CASE WHEN s1 <> '' THEN s1 WHEN mark = '›' THEN y ELSE x END AS street,
  CASE WHEN town0 <> '' THEN town0 WHEN mark = '›' THEN x ELSE y END AS town, '' AS block, '' AS lane, b0 AS building, '' AS number, '' AS area, u0, p0 FROM sized),
{_extract_sql('c1', 'input', 'street', 'block', S.BLOCK, False)}, {_extract_sql('c2', 'c1', 'street', 'lane', S.LANE, False)},
{_extract_sql('c3', 'c2', 'street', 'building', S.BUILDING, True)}, {_extract_sql('c4', 'c3', 'street', 'area', S.NEIGHBOURHOOD, False)},
{_extract_sql('c5', 'c4', 'street', 'number', S.STREET_NUMBER, False)}, {_extract_sql('c6', 'c5', 'area', 'block', S.BLOCK, False)},
{_extract_sql('c7', 'c6', 'translated', 'building', S.BUILDING, True, True)},
texts AS (SELECT * EXCLUDE (street), translated AS text, CASE WHEN street IN (town, u0, p0) AND street <> '' THEN NULL
  WHEN street = 'Street' THEN coalesce(nullif(town, ''), nullif(u0, ''), nullif(p0, '')) || ' Street' ELSE street END AS street FROM c7),
pnames AS (SELECT r_name AS name FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1), unames AS (SELECT n_name AS name FROM nation),
units AS (SELECT n_name AS unit, r_name AS province FROM nation JOIN region ON n_regionkey = r_regionkey),
places AS (SELECT DISTINCT c_mktsegment AS locality, n_name AS unit, r_name AS province FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 0),
{_fuzzy_sql('p', 'texts', 'pnames')}, {_fuzzy_sql('u', 'texts', 'unames')},
g AS (SELECT t.*, CASE WHEN p0 <> '' THEN p0 ELSE p.match END AS p1, u.match AS ug FROM texts t JOIN pmatch p USING (id) JOIN umatch u USING (id)),
h AS (SELECT g.*, CASE WHEN u0 <> '' THEN u0 WHEN EXISTS (SELECT 1 FROM units WHERE unit = ug AND units.province = p1) THEN ug ELSE '' END AS u1 FROM g),
k AS (SELECT h.*, CASE WHEN p1 <> '' THEN p1 ELSE coalesce((SELECT min(province) FROM units WHERE unit = u1), '') END AS p2 FROM h),
l AS (SELECT k.*, CASE WHEN u1 <> '' THEN u1 ELSE coalesce((SELECT CASE WHEN count(DISTINCT unit) = 1 THEN min(unit) END FROM places
  WHERE locality = town AND (places.province = p2 OR p2 = '')), '') END AS u2 FROM k),
m AS (SELECT p2, street, arg_min(u2, lower(trim(address))) AS known FROM l JOIN raw USING (id) WHERE u2 <> '' AND street <> '' GROUP BY ALL)
SELECT id AS listing, coalesce(l.street, '') AS street, building, block, lane, area, number, town, l.p2 AS province,
  CASE WHEN u2 <> '' THEN u2 ELSE coalesce(known, '') END AS unit FROM l LEFT JOIN m ON l.p2 = m.p2 AND l.street = m.street""")
def resolve_addresses_query(spark, sf):
    """The whole address plan: raw texts, translations and stored replies to one row per listing key."""
    raw = raw_addresses(spark, sf)
    listings = raw.select(F.col("id").alias(S.INDEX), S.ADDRESS)
    known = raw.where(T.non_ascii_flag(S.ADDRESS)).select(S.ADDRESS, F.concat(F.col("c_mktsegment"), F.lit(" st, "), "n_name").alias(S.TRANSLATED))
    answered = nominatim_bodies(_customers(spark, sf)).select(F.col(ID).alias("id"), "body")
    replies = raw.join(answered, "id").where(F.col("id") % 2 == 0).select(
        F.col(S.ADDRESS).alias("address"), F.lit("native").alias("candidate"), F.col(S.ADDRESS).alias("text"),
        F.lit("Nominatim").alias("provider"), "body")
    out = resolve_addresses(listings, known, replies, hierarchy(spark, sf))
    names = {S.STREET: "street", S.BUILDING: "building", S.BLOCK: "block", S.LANE: "lane", S.NEIGHBOURHOOD: "area", S.STREET_NUMBER: "number",
             S.TOWN: "town", S.PROVINCE: "province", S.UNIT: "unit"}
    return out.select(F.col(S.INDEX).alias("listing"), *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
