"""Sorting, seeded samples and splits that do not depend on the partitioning."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rentloom.operators.aggregates import min_group_size
from rentloom.operators.scale import exact_quantiles, skew_join
from rentloom.session import checkpointed

HASHES = 1 << 53        # hashes lie below this
ORDERED_ROWS = 10_000   # larger samples of a group end at a sketched order statistic


def chronological_sort(df: DataFrame, keys: Sequence[str], date: str, row_id: str | None = None) -> DataFrame:
    return df.orderBy(*keys, date, *([row_id] if row_id else []))


def seeded_hash(row_id: str, seed: int) -> Column:
    """A stable pseudo-random number of the row, exact as a double."""
    return F.xxhash64(F.col(row_id), F.lit(seed)).bitwiseAND(F.lit(HASHES - 1)).cast("double")


def sample_per_group(df: DataFrame, keys: Sequence[str], row_id: str, minimum: int = 0,
                     maximum: int | None = None, seed: int = 42) -> DataFrame:
    """Leave out groups under ``minimum`` rows and take at most ``maximum`` rows of the others.

    The rows with the lowest hash of the unique row id are taken, so the sample
    does not depend on the partitioning. The hash that ends a group's sample is
    an exact order statistic. Groups are counted first, and only the hashes
    below a bound that few of a group's rows reach are put in order; a group
    in which too few reach it (ids repeat) is ordered by
    :func:`exact_quantiles`. No task ever sorts a group.
    """
    if maximum is None:
        return min_group_size(df, keys, minimum) if minimum > 1 else df
    tagged = df.withColumn("_h", seeded_hash(row_id, seed))
    if maximum < 1 or maximum > ORDERED_ROWS:
        last = exact_quantiles(tagged, "_h", [0.0], keys, rank=lambda n, p: F.least(n, F.lit(maximum)) - 1)
        cuts = last.where(F.col("n") >= minimum).select(*keys, F.col("q0").alias("_cut"))
    else:
        cuts = _last_hashes(tagged, keys, minimum, maximum)
    return skew_join(tagged, checkpointed(cuts), keys, "inner").where(F.col("_h") <= F.col("_cut")).drop("_h", "_cut")


def _last_hashes(tagged: DataFrame, keys: Sequence[str], minimum: int, maximum: int) -> DataFrame:
    """``keys`` and ``_cut``, the hash ``_h`` that ends the sample of a group; groups under ``minimum`` rows are left out."""
    known = tagged.dropna(subset=list(keys)).select(*keys, "_h")
    sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= minimum)
    wanted = maximum + 8 * math.ceil(math.sqrt(maximum)) + 8     # rows of a group under the bound, about
    bounds = checkpointed(sizes.withColumn("_b", F.when(F.col("n") > 2 * wanted, F.lit(float(HASHES) * wanted) / F.col("n"))
                                           .otherwise(F.lit(float(HASHES)))))
    low = skew_join(known, bounds, keys, "inner").where(F.col("_h") <= F.col("_b")).select(*keys, "n", "_h")
    low = low.groupBy(*keys, "n", "_h").agg(F.count(F.lit(1)).alias("_c"))      # equal hashes are one row
    upto = Window.partitionBy(*keys).orderBy("_h")
    run = low.withColumn("_end", F.sum("_c").over(upto))
    ended = checkpointed(run.groupBy(*keys, "n").agg(F.min(F.when(F.col("_end") >= F.least("n", F.lit(maximum)), F.col("_h"))).alias("_cut")))
    cuts = ended.where("_cut IS NOT NULL").select(*keys, "_cut")
    rest = checkpointed(bounds.join(cuts, list(keys), "left_anti").select(*keys))
    if rest.isEmpty():
        return cuts
    few = exact_quantiles(skew_join(known, rest, keys, "inner"), "_h", [0.0], keys, rank=lambda n, p: F.least(n, F.lit(maximum)) - 1)
    return cuts.unionByName(few.select(*keys, F.col("q0").alias("_cut")))


def train_test_split(df: DataFrame, row_id: str, fraction: float = 0.8, seed: int = 42, exact: bool = True) -> DataFrame:
    """Add ``is_train``. Exact: the threshold is the k-th smallest hash; else a fixed share of the hash range."""
    hashed = df.withColumn("_h", seeded_hash(row_id, seed))
    if exact:
        cut = exact_quantiles(hashed, "_h", [fraction], rank=lambda n, p: F.bround(n * p) - 1).select("q0").scalar()
    else:
        cut = F.lit(fraction * float(HASHES))
    return hashed.withColumn("is_train", F.coalesce(F.col("_h") <= cut, F.lit(False))).drop("_h")
