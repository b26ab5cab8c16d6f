"""Null keys, null order values, shared texts, low cutoffs and gaps lose no rows."""

import random

from pyspark.sql import functions as F

from rentloom import schema as S
from rentloom.operators import stats
from rentloom.operators.address import fuzzy_lookup, similar_pairs
from rentloom.operators.aggregates import group_count_column
from rentloom.operators.joins import reindex_addresses
from rentloom.operators.scale import dense_positions
from rentloom.operators.stats import correlation_matrix, posthoc_label, spearman


def test_rows_without_an_order_value_come_last(spark):
    rows = spark.range(400).select("id", F.when(F.col("id") % 5 > 0, F.col("id")).alias("at"))
    got = dense_positions(rows, "at", ["id"]).collect()
    assert sorted(r.position for r in got) == list(range(400))
    assert min(r.position for r in got if r["at"] is None) == 320


def test_null_keys_are_counted(spark):
    rows = spark.createDataFrame([("a", 1), (None, 1), (None, 1), ("a", None)], "k string, m int")
    got = group_count_column(rows, ["k", "m"]).collect()
    assert sorted((str(r.k), str(r.m), r.Count) for r in got) == [("None", "1", 2), ("None", "1", 2), ("a", "1", 1), ("a", "None", 1)]


def test_addresses_with_one_text_all_stay(spark):
    addresses = spark.createDataFrame([("Main St 1", "x"), ("main st 1 ", "y"), ("Else 2", "z")], f"{S.ADDRESS} string, {S.STREET} string")
    listings = spark.createDataFrame([("Main St 1", "A_1"), ("MAIN ST 1", "A_2")], f"{S.ADDRESS} string, {S.INDEX} string")
    got = sorted((r[S.STREET], str(r[S.INDEX])) for r in reindex_addresses(addresses, listings).collect())
    assert got == [("x", "A_1"), ("x", "A_2"), ("y", "A_1"), ("y", "A_2"), ("z", "None")]


def test_low_cutoffs_find_every_pair(spark):
    rng = random.Random(1)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(40)})
    phrases, names = (spark.createDataFrame([(w,) for w in words], f"{c} string") for c in ("phrase", "name"))
    scored = phrases.crossJoin(names).withColumn("score", 100 * (1 - F.levenshtein("phrase", "name") / (F.length("phrase") + F.length("name"))))
    for cutoff in (50, 60, 66, 80):
        want = {(r.phrase, r.name) for r in scored.where(F.col("score") >= cutoff).collect()}
        assert {(r.phrase, r.name) for r in similar_pairs(phrases, names, cutoff).collect()} == want


def test_names_of_three_words_are_found(spark):
    rows = spark.createDataFrame([(1, "near Nor Nork Masiv 12"), (2, "Kentrn"), (3, "")], "id long, t string")
    choices = spark.createDataFrame([("Nor Nork Masiv",), ("Kentron",)], "c string")
    got = {r.id: r.match for r in fuzzy_lookup(rows, "id", "t", choices, "c").collect()}
    assert got[1] == "Nor Nork Masiv" and got[2] == "Kentron" and not got.get(3)


def test_a_gap_in_a_third_column_changes_no_pair(spark):
    rng = random.Random(2)
    rows = [(rng.random(), rng.random(), rng.random() if i % 5 == 0 else None) for i in range(50)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r.row, r.col): r for r in correlation_matrix(df, ["a", "b", "c"]).collect()}
    alone, part = spearman(df, "a", "b").first(), spearman(df, "a", "c").first()
    assert (got["a", "b"].n, got["a", "c"].n) == (50, 10)
    assert abs(got["a", "b"].r - alone.r) < 1e-12 and abs(got["b", "a"].p - alone.p) < 1e-12 and abs(got["c", "a"].r - part.r) < 1e-12


def test_many_columns_with_gaps_are_ranked_pair_by_pair(spark):
    """Equal to ranking each pair on its own, with ties, empty columns, values that are no numbers; no more jobs for more columns."""
    rng = random.Random(4)
    names = [f"c{i}" for i in range(8)]
    rows = [tuple(None if i == 7 or rng.random() < 0.1 * i else float("nan") if i == 3 and rng.random() < 0.1 else float(rng.randint(0, 9 * (i + 1)))
                  for i in range(8)) for _ in range(300)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names))
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext

    def jobs(columns):
        context.setJobGroup(f"gaps {len(columns)}", "")
        got = correlation_matrix(df, columns).collect()
        context.setLocalProperty("spark.jobGroup.id", None)
        return got, len(tracker.getJobIdsForGroup(f"gaps {len(columns)}"))

    got, many = jobs(names)
    assert 0 < many <= jobs(names[:3])[1] + 3
    by_pair = {(r.row, r.col): r for r in got}
    frame = df.toPandas()
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            both = frame[[a, b]].dropna()
            r, n = by_pair[a, b].r, by_pair[a, b].n
            assert n == len(both) == by_pair[b, a].n
            if b == "c7":
                assert r is None and by_pair[a, b].label == "NaN"
            else:
                assert abs(r - both[a].rank().corr(both[b].rank())) < 1e-9 and by_pair[b, a].r == r


def test_rows_stay_whole_while_their_columns_are_ranked(spark, monkeypatch):
    """Columns of few, of more and of many values, hot ones among them: equal to ranking each pair alone; no cells are gathered into rows."""
    for name, value in (("FEW_VALUES", 4), ("BROADCAST_ROWS", 20), ("HOT_SHARE", 5)):
        monkeypatch.setattr(stats, name, value, raising=False)
    rng = random.Random(6)
    sizes = {"few": 3, "more": 15, "many": 200, "none": 0, "two": 2, "most": 90}
    rows = [tuple(None if not n or rng.random() < 0.2 else 0.0 if rng.random() < 0.4 else float(rng.randint(-n, n) // 2) for n in sizes.values()) for _ in range(400)]
    rows += rows[:50] + [(None,) * 6, (-0.0, -0.0, float("nan"), None, -0.0, None)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in sizes))
    by_pair = {(r.row, r.col): r for r in correlation_matrix(df, list(sizes)).collect()}
    frame = df.toPandas()
    for a in sizes:
        for b in sizes:
            both = frame[[a, b]].dropna() if a != b else frame[[a]].dropna()
            assert by_pair[a, b].n == len(both)
            if a != b and "none" not in (a, b):
                assert abs(by_pair[a, b].r - both[a].rank().corr(both[b].rank())) < 1e-9
    plan = stats._pairwise_ranked(df, list(sizes))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "collect_list" not in plan


def test_posthoc_label_breaks_its_line(spark):
    assert spark.range(1).select(posthoc_label(F.lit(0.0001))).first()[0] == "P < 0.001\nVERY SIGNIFICANT"
