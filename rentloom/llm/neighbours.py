"""The next row in a global order, without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_neighbours(rows: DataFrame, key: str, *ties: str, keys: DataFrame | None = None) -> DataFrame:
    """Rows sorted by ``key`` inside buckets, with copies of the rows next to each bucket.

    Adds ``_bucket`` and ``_copy``: 0 for the row itself, -1 for copies that
    come before the bucket (rows with the last key of the bucket before), 1 for
    copies that come after it (rows with the first key of the next). The order
    is a ring. A task that reads its rows in order sees around every row those
    next to it in the whole table. Buckets are those of a range partitioning of
    the keys: the driver sees two cuts per partition. Rows without a key have no
    place in the order and get negative buckets, dealt by the first tie.
    ``keys`` has the same keys where they are cheaper to read than ``rows``.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = (rows if keys is None else keys).select(key).where(F.col(key).isNotNull())
    ranged = keys.repartitionByRange(parts, key).groupBy(F.spark_partition_id().alias("_p")).agg(F.min(key).alias("low"), F.max(key).alias("high"))
    cuts = sorted((r["low"], r["high"]) for r in ranged.collect())
    kind = dict(rows.dtypes)[key]
    lows, highs = (F.array(*[F.lit(c[i]) for c in cuts]).cast(f"array<{kind}>") for i in (0, 1))
    own = F.size(F.filter(lows, lambda cut: cut <= F.col(key)))
    apart = -1 - F.pmod(F.xxhash64(*ties), F.lit(parts)).cast("int")

    def place(bucket, copy: int):
        return F.struct(bucket.cast("int").alias("_bucket"), F.lit(copy).alias("_copy"))

    real = F.array(place(F.when(F.col(key).isNotNull(), own).otherwise(apart), 0))
    after = F.when(F.array_contains(lows, F.col(key)), F.array(place(F.when(own > 1, own - 1).otherwise(len(cuts)), 1)))
    before = F.when(F.array_contains(highs, F.col(key)), F.array(place(F.when(own < len(cuts), own + 1).otherwise(1), -1)))
    places = F.flatten(F.filter(F.array(real, after, before), lambda p: p.isNotNull()))
    placed = rows.withColumn("_at", F.explode(places)).select("*", "_at._bucket", "_at._copy").drop("_at")
    return placed.repartitionById(parts, F.pmod("_bucket", F.lit(parts))).sortWithinPartitions("_bucket", "_copy", key, *ties)
