"""Small helpers for functions that run on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rentloom.session import new_shared_path

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


class Memo(dict):
    """Remembered results of a function for the arguments used of late.

    Words of a corpus repeat, so a task computes most of them once. Two
    generations of at most ``limit`` results are held: when the young one is
    full it becomes the old one, from which results that are used again return.
    """

    def __init__(self, function: Callable, limit: int = 200_000) -> None:
        super().__init__()
        self.function, self.limit, self.old = function, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.function(key)
        self[key] = value
        return value

    def fill(self, keys: set, many: Callable) -> None:
        """Make sure that all ``keys`` are held in the young generation; ``many`` computes a list of them."""
        missing = [k for k in keys if k not in self]
        if len(self) + len(missing) > self.limit:
            self.old = dict(self)
            self.clear()
            missing = list(keys)
        known = {k: v for k in missing if (v := self.old.get(k)) is not None}
        self.update(known)
        new = [k for k in missing if k not in known]
        self.update(zip(new, many(new), strict=True))


def raw_texts(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """The UTF-8 bytes of a text column."""
    return batch.column(name).cast(pa.large_binary()).to_pylist()


def bounded(batches: Iterator[pa.RecordBatch], name: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose texts hold at most ``limit`` bytes together, or one longer text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


def words_of(raw: bytes | None) -> list[bytes]:
    """Words between ASCII white space, unchanged; none for null."""
    return raw.split() if raw else []


def row_key(*columns: str) -> list[Column]:
    """Two hashes that name a row by its content, null or not; equal rows share them."""
    return [F.xxhash64(*columns).alias("_k1"), F.xxhash64(F.lit(7), *reversed(columns)).alias("_k2")]


def typed(df: DataFrame, *columns: str) -> str:
    """The types of some columns as a DDL fragment."""
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in columns)


def added(names: list[str], taken: list[str]) -> list[str]:
    """Names for columns that are added to ``taken``: with as many further underscores as it needs to clash with none."""
    lower, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in lower:
            name = f"_{name}"
        lower.add(name.lower())
        out.append(name)
    return out


@contextmanager
def batches_of(spark: SparkSession, limit: int | None) -> Iterator[None]:
    """What runs meanwhile sends Arrow batches of about ``limit`` bytes to Python; a limit that the session has set holds.

    Without one a batch has 10,000 rows however long their texts are, and both
    the JVM and Python hold it, beside the heap.
    """
    own = limit is not None and spark.conf.get(BATCH_BYTES, None) is None
    if own:
        spark.conf.set(BATCH_BYTES, str(limit))
    try:
        yield
    finally:
        if own:
            spark.conf.unset(BATCH_BYTES)


def stored(df: DataFrame, name: str, compression: str | None = None, batch_bytes: int | None = None) -> DataFrame:
    """Write a narrow table to the shared folder and read it back: later steps start from its files.

    ``batch_bytes`` bounds the batches that Python functions in its plan get.
    """
    spark = df.sparkSession
    path = new_shared_path(spark, name)
    with batches_of(spark, batch_bytes):
        df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
