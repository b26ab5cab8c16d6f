"""Building blocks that keep hot keys and global orders distributed.

The rest of the library never uses an un-partitioned window over data, an exact
``percentile`` (its buffer holds a whole group in one task) or an unchecked
broadcast. It uses the functions below instead.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rentloom.session import checkpointed

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20  # cells of a broadcast lookup, as counted before it is sent
HOT_SHARE = 1_000           # a key is hot when it holds over 1/1000 of the rows
HOT_ROWS = 10_000_000       # or over this many rows, whatever its share
SKETCH_ACCURACY = 10_000    # rank error of percentile_approx is at most n / accuracy
GRID = 500                  # sketched quantiles per group
GRID_STEPS = 5              # a bracket spans at most this many grid steps
WHOLE_GROUP_ROWS = 2_000    # groups up to this size need no bracket
BRACKET_ROWS = 5_000_000    # rows a bracket may hold before the exact count
ROWS_PER_BUCKET = 1_000_000
_GRID_POINTS = "array(" + ", ".join(f"{i / GRID}D" for i in range(GRID + 1)) + ")"


def _bytes(df: DataFrame) -> Column:
    """About the size of a row: texts by their length, nested cells by their JSON, others 16 bytes."""
    sizes = [F.lit(16 * len(df.columns))]
    for name, kind in df.dtypes:
        cell = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            sizes.append(F.coalesce(F.octet_length(cell), F.lit(0)))
        elif kind.startswith(("array", "struct", "map")):
            sizes.append(F.coalesce(F.octet_length(F.to_json(F.struct(cell.alias("c")))), F.lit(0)))
    return reduce(lambda a, b: a + b, sizes).cast("bigint")


def fits_broadcast(lookup: DataFrame) -> bool:
    """Whether a lookup is small in rows and in bytes; reads no more than the rows that decide it."""
    rows, size = lookup.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(_bytes(lookup)), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def skew_join(big: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left", small: bool | None = None) -> DataFrame:
    """Join ``big`` to a ``lookup`` that is unique on ``on``, whatever the key skew.

    A small lookup is broadcast after its rows and bytes were counted (``small``
    tells the outcome when the caller has counted). Otherwise both sides are
    written once, and keys that hold over 1/1000 of the rows, or over HOT_ROWS,
    are split off: there are at most 1000 plus one per HOT_ROWS rows of them, so
    their lookup rows are few enough to broadcast. All other keys are small and
    go through a plain shuffle join.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    on = list(on)
    if small is None:
        small = fits_broadcast(lookup)
    if small:
        return big.join(F.broadcast(lookup), on, how)
    big, lookup = checkpointed(big), checkpointed(lookup)
    counts = big.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    least = min(big.count() // HOT_SHARE, HOT_ROWS)
    hot = checkpointed(counts.where(F.col("_n") > least).drop("_n"))
    hot_keys = F.broadcast(hot)
    cold_part = big.join(hot_keys, on, "left_anti").join(lookup, on, how)
    hot_lookup = F.broadcast(lookup.join(hot_keys, on, "left_semi"))
    hot_part = big.join(hot_keys, on, "left_semi").join(hot_lookup, on, how)
    return cold_part.unionByName(hot_part)


def _usable(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    number = F.col(f"`{value}`").cast("double")
    kept = df.select(*keys, number.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    return reduce(lambda d, k: d.where(F.col(k).isNotNull()), keys, kept)


def _grid(value: Column) -> Column:
    """Sketched quantiles of ``value`` at GRID even steps."""
    return F.percentile_approx(value, F.expr(_GRID_POINTS), F.lit(SKETCH_ACCURACY))


def _tighten(low: Column, high: Column, below: Column, inside: Column, grid: Column, at: Column) -> list[Column]:
    """The grid values around rank ``at``, given ``below`` rows under the bracket and ``inside`` rows in it.

    One grid step of slack on either side is far over the sketch's rank error.
    Few rows need no tighter bracket.
    """
    first = F.floor((at - below) / inside * GRID).cast("int") - 1
    last = F.ceil((at + 2 - below) / inside * GRID).cast("int") + 1
    few = inside <= WHOLE_GROUP_ROWS
    return [F.when(few | (first <= 0), low).otherwise(F.get(grid, first)).alias("_lo"),
            F.when(few | (last >= GRID), high).otherwise(F.get(grid, last)).alias("_hi")]


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    keys: Sequence[str] = (),
    rank: Callable[[Column, Column], Column] = lambda n, p: (n - 1) * p,
) -> DataFrame:
    """Linearly interpolated quantiles per group: columns ``keys``, ``n``, ``q0..``.

    ``rank`` gives the wanted 0-based rank from the row count and the
    probability; the default is the usual linear interpolation.

    Pass 1 sketches every group with ``percentile_approx``; its rank error has a
    proven bound, so two sketch values around a wanted rank bracket the exact
    order statistics. The last pass counts what lies below each bracket and
    keeps only value counts inside it. While a bracket could still hold many
    rows, passes in between narrow it the same way. All passes combine on the
    map side, so a group holding a third of the rows costs no more shuffle than
    any other. The answer is exact.
    """
    keys = list(keys)
    vals = _usable(df, value, keys)
    sketch = vals.groupBy(*keys).agg(
        _grid(F.col("_v")).alias("_g"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.count(F.lit(1)).alias("n")).where("n > 0")
    probes = []
    for i, p in enumerate(probs):
        at = rank(F.col("n"), F.lit(float(p)))
        whole = F.floor(at).cast("bigint")
        bracket = _tighten(F.col("_min"), F.col("_max"), F.lit(0), F.col("n"), F.col("_g"), whole)
        probes.append(F.struct(F.lit(i).alias("_i"), whole.alias("_r"), (at - F.floor(at)).alias("_f"), *bracket))
    brackets = checkpointed(sketch.select(*keys, "n", F.array(*probes).alias("_p")))
    groups, largest = brackets.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    few = groups <= BROADCAST_ROWS

    def hits() -> DataFrame:
        """Rows not above a bracket, once per probe."""
        if keys:
            joined = skew_join(vals, brackets, keys, "inner", small=few)
        else:
            joined = vals.withColumns({c: brackets.select(c).scalar() for c in ("n", "_p")})
        return joined.select(*keys, "n", "_v", F.inline("_p")).where(F.col("_v") <= F.col("_hi"))

    width, inside, kept = largest, F.col("_v") >= F.col("_lo"), ["n", "_r", "_f", "_lo", "_hi"]
    while (width := width * GRID_STEPS // GRID) > BRACKET_ROWS:
        inner = hits().groupBy(*keys, "_i").agg(
            F.count_if(~inside).alias("_b"), F.count_if(inside).alias("_m"), _grid(F.when(inside, F.col("_v"))).alias("_g"),
            *[F.first(c).alias(c) for c in kept])
        tighter = _tighten(*[F.col(c) for c in ("_lo", "_hi", "_b", "_m", "_g", "_r")])
        probe = F.struct("_i", "_r", "_f", *tighter)
        brackets = checkpointed(inner.groupBy(*keys, "n").agg(F.collect_list(probe).alias("_p")))
    # Values below the bracket lose their identity and collapse into one count.
    counted = hits().withColumn("_v", F.when(inside, F.col("_v"))).groupBy(*keys, "_i", "_v").agg(
        F.count(F.lit(1)).alias("_cnt"), *[F.first(c).alias(c) for c in kept[:3]])
    upto = Window.partitionBy(*keys, "_i").orderBy(F.col("_v").asc_nulls_first())
    run = counted.withColumn("_end", F.sum("_cnt").over(upto))
    at, end, start = F.col("_r"), F.col("_end"), F.col("_end") - F.col("_cnt")
    here = F.col("_v").isNotNull()
    found = run.groupBy(*keys, "n", "_i", "_f").agg(
        F.max(F.when(here & (start <= at) & (end > at), F.col("_v"))).alias("_a"),
        F.max(F.when(here & (start <= at + 1) & (end > at + 1), F.col("_v"))).alias("_b"),
    )
    point = F.when(F.col("_f") == 0, F.col("_a")).otherwise(
        F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f"))
    return found.groupBy(*keys, "n").agg(
        *[F.max(F.when(F.col("_i") == i, point)).alias(f"q{i}") for i in range(len(probs))])


def _bucket_splits(distinct: DataFrame, column: str) -> list[float]:
    """Cut points giving buckets of about ROWS_PER_BUCKET distinct values.

    The number of cut points is bounded by rows / ROWS_PER_BUCKET; like the
    bounds of a range partitioning they are the only thing the driver sees.
    """
    rows = distinct.count()
    parts = max(8, min(20_000, rows // ROWS_PER_BUCKET))
    cuts = [i / parts for i in range(1, parts)]
    found = distinct.agg(F.percentile_approx(column, F.array(*map(F.lit, cuts)), F.lit(max(1000, parts * 10)))).first()[0]
    return [float("-inf"), *sorted(set(found or [])), float("inf")]


def _bucketed(df: DataFrame, column: str, splits: list[float]) -> DataFrame:
    if len(splits) < 3:
        return df.withColumn("_bucket", F.lit(0.0))
    return Bucketizer(splits=splits, inputCol=column, outputCol="_bucket").transform(df)


def _offsets(totals: DataFrame) -> DataFrame:
    """Rows before each bucket; ``totals`` has one row per bucket, so it is small by construction."""
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(totals.select("_bucket", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off")))


def value_ranks(df: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """Average rank of each distinct value: columns ``value``, ``cnt``, ``rank``.

    With ``weight`` a row stands for that many rows.

    Rows collapse to value counts first, so ties cost nothing; buckets of values
    are then ranked side by side and shifted by the rows in earlier buckets.
    """
    rows = _usable(df, value, [weight] if weight else [])
    number = F.sum(weight) if weight else F.count(F.lit(1))
    counts = checkpointed(rows.groupBy("_v").agg(number.alias("cnt")))
    parts = _bucketed(counts, "_v", _bucket_splits(counts, "_v"))
    offsets = _offsets(parts.groupBy("_bucket").agg(F.sum("cnt").alias("_t")))
    within = Window.partitionBy("_bucket").orderBy("_v")
    rank = F.col("_off") + F.col("_end") - F.col("cnt") + (F.col("cnt") + 1) / 2
    return (parts.withColumn("_end", F.sum("cnt").over(within)).join(offsets, "_bucket")
            .select(F.col("_v").alias(value), "cnt", rank.alias("rank")))


def _as_number(c: Column, dtype: str) -> Column:
    """A number that never falls while ``c`` rises, in any session time zone."""
    if dtype == "timestamp":
        return F.unix_micros(c).cast("double")
    if dtype in ("date", "timestamp_ntz"):
        days = F.date_diff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("double")
        return days if dtype == "date" else days * 86_400 + F.hour(c) * 3_600 + F.minute(c) * 60 + F.second(c)
    return c.cast("double")


def dense_positions(df: DataFrame, order: str, tie: Sequence[str] = (), name: str = "position") -> DataFrame:
    """0-based dense position of every row by a numeric, date or time column.

    Buckets of the order column are numbered independently and shifted, so no
    task ever holds more than one bucket. ``order`` should be (nearly) unique.
    Rows without an order value come last, in a bucket of their own.
    """
    keyed = df.withColumn("_k", _as_number(F.col(order), dict(df.dtypes)[order]))
    known = _bucketed(keyed.where("_k IS NOT NULL"), "_k", _bucket_splits(keyed.select("_k"), "_k"))
    parts = known.unionByName(keyed.where("_k IS NULL").withColumn("_bucket", F.lit(float("inf"))))
    offsets = _offsets(parts.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_t")))
    within = Window.partitionBy("_bucket").orderBy(order, *tie)
    pos = (F.col("_off") + F.row_number().over(within) - 1).cast("bigint")
    return parts.join(offsets, "_bucket").withColumn(name, pos).drop("_k", "_bucket", "_off")


def scan_positions(df: DataFrame, name: str = "position") -> DataFrame:
    """0-based dense position in file order, for a frame read straight from files."""
    tagged = df.withColumn("_m", F.monotonically_increasing_id())
    tagged = tagged.withColumn("_bucket", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    offsets = _offsets(tagged.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_t")))
    return tagged.join(offsets, "_bucket").withColumn(name, F.col("_off") + F.col("_i")).drop("_m", "_bucket", "_i", "_off")
