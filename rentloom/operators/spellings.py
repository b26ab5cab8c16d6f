"""Misspelt variants of a text in one cluster, without a fixed number of clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rentloom.functions.casts import blank
from rentloom.operators.scale import skew_join
from rentloom.session import checkpointed

GRAM = 3
LIKE = 0.6          # shared share of grams from which two texts are variants of each other
BANDS, ROWS = 64, 3     # two texts just alike enough meet in no band with a chance of (1 - LIKE ** ROWS) ** BANDS, 2e-7
LEADERS = 32        # a text meets at most so many of a band's bucket


def text_grams(text: str | Column, size: int = GRAM) -> Column:
    """Different runs of ``size`` characters of the lower-case text with a blank on either side."""
    text = F.col(text) if isinstance(text, str) else text
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - size + 1))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(padded, i, F.lit(size))))


def gram_likeness(a: Column, b: Column) -> Column:
    """Grams that two texts share over all that either has."""
    shared = F.size(F.array_intersect(text_grams(a), text_grams(b)))
    return shared / (F.size(text_grams(a)) + F.size(text_grams(b)) - shared)


def _bands(seed: int):
    """One row per text and band: the band, and the smallest of its hashes as the bucket."""
    rng = np.random.default_rng(seed)
    factor = rng.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 62, BANDS * ROWS, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                grams = part.column("_grams")
                sizes = np.diff(grams.offsets.to_numpy())
                hashes = grams.flatten().to_numpy().view(np.uint64)
                low = np.cumsum(sizes) - sizes
                smallest = np.empty((len(sizes), BANDS * ROWS), np.uint64)
                for i in range(BANDS * ROWS):
                    mixed = hashes * factor[i] + shift[i]
                    smallest[:, i] = np.minimum.reduceat(mixed ^ (mixed >> np.uint64(29)), low)
                key = smallest.reshape(len(sizes), BANDS, ROWS)
                buckets = key[:, :, 0].copy()
                for r in range(1, ROWS):
                    buckets = buckets * np.uint64(0x9E3779B97F4A7C15) + key[:, :, r]
                texts = part.column("text").take(pa.array(np.repeat(np.arange(len(sizes)), BANDS)))
                yield pa.RecordBatch.from_arrays(
                    [texts, pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(sizes))), pa.array(buckets.ravel().view(np.int64))], ["text", "band", "bucket"])

    return run


def spelling_links(texts: DataFrame, text: str, like: float = LIKE, seed: int = 42) -> DataFrame:
    """(a, b, likeness) of texts a < b that share at least ``like`` of their grams; each pair once.

    Candidates share a bucket of a band of smallest gram hashes; every candidate
    is verified by its grams. In a bucket a text meets the LEADERS of lowest
    hash: in buckets up to that size all meet, in larger ones, a family of
    variants, each is linked through a leader and no pairs of all are made.
    Blank texts are left out.
    """
    distinct = checkpointed(texts.select(F.col(text).alias("text")).where(~blank("text")).distinct())
    hashed = distinct.select("text", F.transform(text_grams("text"), lambda g: F.xxhash64(g)).alias("_grams"))
    kind = "text string, band int, bucket long"
    members = checkpointed(hashed.mapInArrow(_bands(seed), kind))
    order = Window.partitionBy("band", "bucket").orderBy(F.xxhash64("text"), "text")
    leaders = members.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= LEADERS)
    leaders = leaders.groupBy("band", "bucket").agg(F.collect_list("text").alias("_leaders")).where(F.size("_leaders") > 1)
    met = skew_join(members, checkpointed(leaders), ["band", "bucket"], "inner").select("text", F.explode("_leaders").alias("_leader")).where("text != _leader")
    pairs = met.select(F.least("text", "_leader").alias("a"), F.greatest("text", "_leader").alias("b")).distinct()
    return pairs.withColumn("likeness", gram_likeness(F.col("a"), F.col("b"))).where(F.col("likeness") >= like)


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that every linked node can reach.

    ``links`` has columns ``a`` and ``b``. Every round, each node hands its
    smallest neighbour to the others, first to the larger ones, then among the
    smaller ones; it ends when a round changes nothing. Smallest neighbours come
    from an aggregate that combines before the shuffle.
    """
    edges = checkpointed(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lows = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(lows, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a != b").distinct()
        large = checkpointed(large)
        lows = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lows, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).union(lows.select("a", "low"))
        edges = checkpointed(small.where("a != b").distinct())
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def spelling_clusters(df: DataFrame, text: str, like: float = LIKE, output: str = "cluster") -> DataFrame:
    """All rows with the smallest text that their text reaches over :func:`spelling_links`.

    A text like no other is its own cluster; blank and NULL texts have none.
    """
    named = checkpointed(components(spelling_links(df, text, like)).select(F.col("node").alias(text), F.col("root").alias("_root")))
    return skew_join(df, named, [text]).withColumn(output, F.when(~blank(text), F.coalesce("_root", F.col(text)))).drop("_root")
