"""Correlation, rank tests and effect sizes.

Spark reduces the rows to sums or value counts; probabilities are computed on
the few result rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rentloom.functions.casts import col
from rentloom.functions.probability import correlation_p, normal_two_sided_p
from rentloom.operators.scale import BROADCAST_ROWS, HOT_ROWS, HOT_SHARE, exact_quantiles, skew_join, value_ranks
from rentloom.session import checkpointed

Z_95 = 1.959964
FEW_VALUES = 1_000  # values of a column whose ranks are looked up together with those of others


def fisher_ci(r: str | Column, n: str | Column) -> tuple[Column, Column]:
    """95 % interval of a correlation; NULL for n of 3 or less and for |r| = 1."""
    r, n = col(r), col(n).cast("double")
    usable = (n > 3) & (F.abs(r) < 1)
    half = F.lit(Z_95) / F.sqrt(F.when(usable, n - 3))
    centre = F.atanh(F.when(usable, r))
    return F.tanh(centre - half), F.tanh(centre + half)


def significance_label(p: str | Column) -> Column:
    p = col(p)
    return F.when(p < 0.001, "P < 0.001").when(p < 0.01, "P < 0.01").when(p < 0.05, "P < 0.05").otherwise("")


def posthoc_label(p: str | Column) -> Column:
    p = col(p)
    return (F.when(p < 0.001, "P < 0.001\nVERY SIGNIFICANT").when(p < 0.01, "P < 0.01").when(p < 0.05, "P < 0.05")
            .otherwise("NOT SIGNIFICANT"))


def strength_label(r: str | Column) -> Column:
    size = F.abs(col(r))
    return F.when(size >= 0.6, "Strong").when(size >= 0.3, "Moderate").when(size > 0, "Weak").otherwise("")


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (r, n, p) over the complete pairs."""
    both = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(
        F.col("x").isNotNull() & F.col("y").isNotNull())
    return both.agg(F.corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n")).withColumn("p", correlation_p("r", F.col("n").cast("double")))


def point_biserial(df: DataFrame, flag: str, y: str) -> DataFrame:
    return pearson(df.withColumn(flag, F.col(flag).cast("int")), flag, y)


def _ranked_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct combinations with their count ``_w`` and the rank ``_r<i>`` of every column.

    Only rows complete in all columns count. Equal rows collapse before any
    join; each rank table has one row per distinct value.
    """
    complete = df.select(*[F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(columns)]).dropna()
    out = checkpointed(complete.groupBy(*complete.columns).agg(F.count(F.lit(1)).alias("_w")))
    base = out
    for i in range(len(columns)):
        ranks = checkpointed(value_ranks(base, f"_x{i}", weight="_w").withColumnRenamed("rank", f"_r{i}").drop("cnt"))
        out = skew_join(out, ranks, [f"_x{i}"], "inner")
    return out


def _centred(df: DataFrame, columns: int) -> DataFrame:
    total = df.agg(F.sum("_w").alias("n")).select("n").scalar()
    out = df.withColumn("_n", total)
    return out.withColumns({f"_d{i}": F.col(f"_r{i}") - (F.col("_n") + 1) / 2 for i in range(columns)})


def _weighted_corr(a: str | Column, b: str | Column) -> Column:
    a, b, w = col(a), col(b), F.col("_w").cast("double")
    return F.sum(w * a * b) / F.sqrt(F.nullif(F.sum(w * a * a) * F.sum(w * b * b), F.lit(0.0)))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (r, n, p): correlation of average ranks over the complete pairs."""
    ranked = _centred(_ranked_counts(df, [x, y]), 2)
    out = ranked.agg(_weighted_corr("_d0", "_d1").alias("r"), F.coalesce(F.sum("_w"), F.lit(0)).alias("n"))
    return out.withColumn("p", correlation_p("r", F.col("n").cast("double")))


def _value_ranks_by_partner(base: DataFrame, columns: int) -> DataFrame:
    """Every value ``_v`` of a column ``_i`` with ``_c``, the rows of ``base`` that hold it, and ``_r``, its centred ranks for all partners.

    ``_r[j]`` is the rank among the rows that also have column j, less the mean
    rank there. A value is counted once for every partner, so running sums over
    the values of a column give its ranks for all partners together, whichever
    columns have gaps.
    """
    k = range(columns)
    x = [f"_x{i}" for i in k]
    cells = base.select("_w", *x, F.posexplode(F.array(*x)).alias("_i", "_v")).where("_v IS NOT NULL")
    partners = [F.sum(F.when(F.col(x[j]).isNotNull(), F.col("_w")).otherwise(0)).alias(f"_n{j}") for j in k]
    values = cells.groupBy("_i", "_v").agg(F.count(F.lit(1)).alias("_c"), *partners)
    # Ranges of values are written with their number, so that every later step sees the same ones.
    values = checkpointed(values.repartitionByRange("_i", "_v").withColumn("_range", F.spark_partition_id()))
    sums = values.groupBy("_i", "_range").agg(*[F.sum(f"_n{j}").alias(f"_t{j}") for j in k])
    column = Window.partitionBy("_i")
    before = column.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_i", "_range", *[F.coalesce(F.sum(f"_t{j}").over(before), F.lit(0)).alias(f"_before{j}") for j in k],
                          *[F.sum(f"_t{j}").over(column).alias(f"_all{j}") for j in k])
    upto = Window.partitionBy("_i", "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ends = values.withColumns({f"_end{j}": F.sum(f"_n{j}").over(upto) for j in k}).join(F.broadcast(offsets), ["_i", "_range"])
    rank = [F.col(f"_before{j}") + F.col(f"_end{j}") - (F.col(f"_n{j}") - 1) / 2 - (F.col(f"_all{j}") + 1) / 2 for j in k]
    return checkpointed(ends.select("_i", "_v", "_c", F.array(*rank).alias("_r")))


def _ranks_of_few(out: DataFrame, ranks: DataFrame, few: Sequence[int]) -> DataFrame:
    """``out`` with the ranks of all columns that have few values, looked up once per combination of them."""
    out = out.withColumn("_s", F.array(*[f"_x{i}" for i in few]))
    cells = checkpointed(out.select("_s").distinct()).select("_s", F.posexplode("_s").alias("_at", "_v")).where("_v IS NOT NULL")
    cells = cells.select("_s", F.array(*map(F.lit, few))[F.col("_at")].alias("_i"), "_v")
    ranked = skew_join(cells, ranks.where(F.col("_i").isin(*few)).select("_i", "_v", "_r"), ["_i", "_v"], "inner")
    sets = ranked.groupBy("_s").agg(F.map_from_entries(F.collect_list(F.struct("_i", "_r"))).alias("_m"))
    lookup = checkpointed(sets.select("_s", *[F.col("_m")[i].alias(f"_r{i}") for i in few]))
    return skew_join(out, lookup, ["_s"], "left").drop("_s")


def _pairwise_ranked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct combinations with their count ``_w`` and, for every column, ``_r<i>``: its centred ranks for all partners; null in a gap.

    Rows stay whole: columns of few values are looked up together, every other
    one by a join of its own. Values that many rows hold are broadcast, at most
    BROADCAST_ROWS of a column; the rows of all others meet their rank in a
    shuffle join, through which the rest pass without a key, dealt by their hash.
    """
    number = [F.col(f"`{c}`").cast("double") for c in columns]
    x = [f"_x{i}" for i in range(len(columns))]
    held = df.select(*[F.when(~F.isnan(v), v).alias(name) for v, name in zip(number, x, strict=True)])
    held = held.where(reduce(lambda a, b: a + b, (F.col(name).isNotNull().cast("int") for name in x)) >= 2)
    out = base = checkpointed(held.groupBy(*x).agg(F.count(F.lit(1)).alias("_w")))
    ranks = _value_ranks_by_partner(base, len(columns))
    sizes = {r["_i"]: (r["values"], r["rows"]) for r in ranks.groupBy("_i").agg(F.count(F.lit(1)).alias("values"), F.sum("_c").alias("rows")).collect()}
    few = [i for i in range(len(columns)) if sizes.get(i, (0, 0))[0] <= FEW_VALUES]
    if few:
        out = _ranks_of_few(out, ranks, few)
    for i in (i for i in range(len(columns)) if i not in few):
        values, rows = sizes[i]
        least = 0 if values <= BROADCAST_ROWS else min(rows // HOT_SHARE, HOT_ROWS)
        of_column = ranks.where(F.col("_i") == i).select(F.col("_v").alias(x[i]), "_c", F.col("_r").alias(f"_r{i}"))
        out = out.join(F.broadcast(of_column.where(F.col("_c") > least).drop("_c")), [x[i]], "left")
        if least:
            rare = of_column.where(F.col("_c") <= least).select(F.col(x[i]).alias("_key"), F.lit(0).alias("_salt"), F.col(f"_r{i}").alias("_rare"))
            key = F.when(F.col(f"_r{i}").isNull(), F.col(x[i]))
            out = out.withColumns({"_key": key, "_salt": F.when(key.isNull(), F.hash(*x)).otherwise(0)}).join(rare, ["_key", "_salt"], "left")
            out = out.withColumn(f"_r{i}", F.coalesce(f"_r{i}", "_rare")).drop("_key", "_salt", "_rare")
    return out


def correlation_matrix(df: DataFrame, columns: Sequence[str], binary: Sequence[str] = ()) -> DataFrame:
    """Every ordered pair: (row, col, method, r, p, n, lo, hi, label).

    Pairs with a binary column use the point-biserial method, others ranks. All
    pairs come from two aggregates, one over the rows and one over ranked value
    counts. Every pair uses the rows in which both columns are present, and
    ``n`` is their number. Where gaps differ, each column is ranked for every
    partner in the same pass; the number of jobs does not grow with the pairs,
    only with the columns of over FEW_VALUES values.
    A value that is not a number is a gap; a pair without rows has no ``r``.
    """
    columns = list(columns)
    number = {c: F.when(~F.isnan(x), x) for c in columns for x in [F.col(f"`{c}`").cast("double")]}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    is_binary = {(a, b): a in binary or b in binary for a, b in pairs}
    direct = [F.corr(number[a], number[b]).alias(f"c_{a}_{b}") for a, b in pairs if is_binary[a, b]]
    present = {(a, b): number[a].isNotNull() & number[b].isNotNull() for a, b in pairs}
    sizes = [F.count(number[c]).alias(f"n_{c}") for c in columns] + [F.count_if(both).alias(f"n_{a}_{b}") for (a, b), both in present.items()]
    ranked_columns = sorted({c for p in pairs if not is_binary[p] for c in p}, key=columns.index)
    if ranked_columns:
        at = {c: i for i, c in enumerate(ranked_columns)}
        by_pair = [(a, b) for a, b in pairs if not is_binary[a, b]]
        whole = reduce(lambda x, y: x & y, (number[c].isNotNull() for c in ranked_columns))
        figures = checkpointed(df.agg(*sizes, *direct, F.count_if(whole).alias("complete")))
        complete, *each = figures.select("complete", *[f"`n_{a}_{b}`" for a, b in by_pair]).first()
        if all(rows == complete for rows in each):
            ranked = _centred(_ranked_counts(df, ranked_columns), len(ranked_columns))
            sides = {(a, b): (F.col(f"_d{at[a]}"), F.col(f"_d{at[b]}")) for a, b in by_pair}
        else:
            ranked = _pairwise_ranked(df, ranked_columns)
            side = lambda a, b: F.when(F.col(f"_r{at[b]}").isNotNull(), F.col(f"_r{at[a]}")[at[b]])
            sides = {(a, b): (side(a, b), side(b, a)) for a, b in by_pair}
        by_rank = checkpointed(ranked.agg(F.struct(*[_weighted_corr(*both).alias(f"c_{a}_{b}") for (a, b), both in sides.items()]).alias("ranked")))
        figures = figures.select("*", by_rank.scalar().alias("ranked")).select("*", "ranked.*")
    else:
        figures = df.agg(*sizes, *direct)
    cells = []
    for a in columns:
        for b in columns:
            if a == b:
                r, method, n = F.lit(1.0), F.lit("identity"), F.col(f"`n_{a}`")
            else:
                key = (a, b) if (a, b) in is_binary else (b, a)
                r = F.col(f"`c_{key[0]}_{key[1]}`")
                method = F.lit("point biserial" if is_binary[key] else "spearman")
                n = F.col(f"`n_{key[0]}_{key[1]}`")
            cells.append(F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"), method.alias("method"), r.alias("r"), n.alias("n")))
    out = figures.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    same = F.col("row") == F.col("col")
    out = out.withColumn("p", F.when(same, F.lit(0.0)).otherwise(correlation_p("r", F.col("n").cast("double"))))
    lo, hi = fisher_ci("r", "n")
    text = F.concat_ws("\n", F.format_number("r", 2), significance_label("p"), strength_label("r"))
    label = F.when(same, "1.00").when(F.col("r").isNull(), "NaN").otherwise(text)
    return out.withColumns({"lo": lo, "hi": hi, "label": label})


def _group_pairs(groups: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Unordered pairs of groups g1 < g2 with their figures ``a`` and ``b``.

    ``groups`` has one row per group. The result is one row per pair by
    definition, so the group figures fit in one sorted array.
    """
    packed = groups.agg(F.sort_array(F.collect_list(F.struct("g", *fields))).alias("all"))
    first = packed.select("all", F.posexplode("all").alias("i", "a"))
    return first.select("a", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("b"))


def flag_group(first: str | Column, second: str | Column) -> Column:
    """The label of two flags together."""
    return F.concat_ws("_", col(first).cast("string"), col(second).cast("string"))


def dunn_posthoc(df: DataFrame, value: str, group: str | Column) -> DataFrame:
    """Pairwise rank test (g1, g2, z, p, label), tie-corrected, Bonferroni-adjusted.

    Ranks, group sums and the tie term all come from value counts.
    """
    rows = df.select(col(group).alias("g"), F.col(f"`{value}`").cast("double").alias("_v")).dropna()
    counts = checkpointed(rows.groupBy("g", "_v").agg(F.count(F.lit(1)).alias("_w")))
    ranks = checkpointed(value_ranks(counts, "_v", weight="_w"))
    by_group = skew_join(counts, ranks, ["_v"], "inner").groupBy("g").agg(
        F.sum("_w").cast("double").alias("n"), (F.sum(F.col("_w") * F.col("rank")) / F.sum("_w")).alias("mean_rank"))
    t = F.col("cnt").cast("double")
    totals = ranks.agg(F.sum(t).alias("N"), F.sum(t * t * t - t).alias("T"))
    pairs = _group_pairs(by_group, ["n", "mean_rank"])
    pairs = pairs.withColumns({"N": totals.select("N").scalar(), "T": totals.select("T").scalar()})
    n = F.col("N")
    spread = (n * (n + 1) / 12 - F.col("T") / (12 * (n - 1))) * (1 / F.col("a.n") + 1 / F.col("b.n"))
    pairs = pairs.withColumn("z", (F.col("a.mean_rank") - F.col("b.mean_rank")) / F.sqrt(spread))
    number = by_group.agg((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1) / 2).alias("k")).scalar()
    pairs = pairs.select(F.col("a.g").alias("g1"), F.col("b.g").alias("g2"), "z", number.alias("k"))
    out = pairs.withColumn("p", F.least(F.lit(1.0), normal_two_sided_p("z") * F.col("k"))).drop("k")
    return out.withColumn("label", posthoc_label("p"))


def cohens_d(df: DataFrame, value: str, group: str | Column) -> DataFrame:
    """Pooled-deviation effect size (g1, g2, d) per pair of groups."""
    rows = df.select(col(group).alias("g"), F.col(f"`{value}`").cast("double").alias("_v")).dropna()
    stats = rows.groupBy("g").agg(F.count("_v").alias("n"), F.avg("_v").alias("m"), F.var_samp("_v").alias("v"))
    a, b = "a.", "b."
    pooled = ((F.col(a + "n") - 1) * F.col(a + "v") + (F.col(b + "n") - 1) * F.col(b + "v")) / (F.col(a + "n") + F.col(b + "n") - 2)
    d = (F.col(a + "m") - F.col(b + "m")) / F.sqrt(F.nullif(pooled, F.lit(0.0)))
    return _group_pairs(stats, ["n", "m", "v"]).select(F.col("a.g").alias("g1"), F.col("b.g").alias("g2"), d.alias("d"))


def box_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles, ends, whiskers (last values within 1.5 IQR) and the count beyond them, per group."""
    keys = list(keys)
    quartiles = checkpointed(exact_quantiles(df, value, [0, 0.25, 0.5, 0.75, 1], keys))
    iqr = F.col("q3") - F.col("q1")
    quartiles = quartiles.withColumns({"_lo": F.col("q1") - 1.5 * iqr, "_hi": F.col("q3") + 1.5 * iqr})
    complete = df.where(F.col(value).isNotNull())
    v = F.col(value)
    if keys:
        marked = skew_join(complete, quartiles.select(*keys, "_lo", "_hi"), keys, "inner")
    else:
        marked = complete.withColumns({c: quartiles.select(c).scalar() for c in ("_lo", "_hi")})
    inside = v.between(F.col("_lo"), F.col("_hi"))
    ends = marked.groupBy(*keys).agg(
        F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"))
    named = quartiles.select(*keys, "n", F.col("q0").alias("min"), F.col("q1"), F.col("q2").alias("median"), F.col("q3"), F.col("q4").alias("max"))
    if keys:
        return named.join(ends, keys)
    return named.withColumns({c: ends.select(c).scalar() for c in ends.columns})


def ols_trend(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Straight-line fit: slope, intercept, r2 and n, one row per group."""
    fx, fy = F.col(x).cast("double"), F.col(y).cast("double")
    both = df.where(fx.isNotNull() & fy.isNotNull())
    return both.groupBy(*keys).agg(
        F.regr_slope(fy, fx).alias("slope"), F.regr_intercept(fy, fx).alias("intercept"),
        F.regr_r2(fy, fx).alias("r2"), F.count(F.lit(1)).alias("n"))

