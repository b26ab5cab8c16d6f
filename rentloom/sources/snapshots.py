"""Tables that change as a whole: new files are written beside the old ones and become the table by one manifest.

A manifest is a small folder of its own under ``versions``, written by Spark; it
counts from the moment its success marker stands. Until then, and for ever if
the job dies, readers see the version before.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = "part string, path string, label string"


@dataclass(frozen=True)
class Snapshot:
    """A published version: where its parts are, and the label its writer gave it."""

    version: int
    label: str
    parts: dict[str, str]

    def read(self, spark: SparkSession, *parts: str) -> DataFrame:
        """The named parts as one table, all without a name."""
        return spark.read.parquet(*[self.parts[p] for p in parts or sorted(self.parts)])


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, on whatever file system the path is."""
    place, files = _folder(spark, path)
    return bool(files.exists(place))


def _numbers(spark: SparkSession, root: str) -> list[int]:
    place, files = _folder(spark, f"{root}/versions")
    names = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
    return sorted(int(n) for n in names if n.isdigit())


def current(spark: SparkSession, root: str) -> Snapshot | None:
    """The last version whose manifest is complete; None before the first."""
    root = root.rstrip("/")
    for number in reversed(_numbers(spark, root)):
        path = f"{root}/versions/{number:09d}"
        if exists(spark, f"{path}/_SUCCESS"):
            rows = spark.read.schema(PARTS).parquet(path).collect()
            return Snapshot(number, rows[0]["label"] if rows else "", {r["part"]: r["path"] for r in rows if r["part"] is not None})
    return None


def new_data(root: str) -> str:
    """A folder for files that no version names yet."""
    return f"{root.rstrip('/')}/data/{uuid.uuid4().hex}"


def publish(spark: SparkSession, root: str, parts: Mapping[str, str], label: str = "") -> Snapshot:
    """Make ``parts`` (name to folder) the table, by a manifest of the next number.

    A number is used once: of two writers that take the same one the second
    fails and publishes nothing.
    """
    root = root.rstrip("/")
    number = (_numbers(spark, root) or [0])[-1] + 1
    rows = [(name, path, label) for name, path in sorted(parts.items())] or [(None, None, label)]
    spark.createDataFrame(rows, PARTS).coalesce(1).write.mode("errorifexists").parquet(f"{root}/versions/{number:09d}")
    return Snapshot(number, label, dict(parts))


def input_key(*scans: DataFrame, **parameters: object) -> str:
    """A text that changes when a file behind ``scans`` is added, removed or written anew, or a parameter changes.

    ``scans`` are frames read straight from files. Names, sizes and times of the
    files are summed up by Spark; no column is read.
    """
    states = []
    for scan in scans:
        files = scan.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        states.append(tuple(files.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)"))).first()))
    return repr((states, sorted((k, repr(v)) for k, v in parameters.items())))
