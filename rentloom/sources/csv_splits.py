"""CSV files with line breaks inside quotes, read by many tasks per file.

Where a split of a file starts, nobody knows whether that is inside quotes. One
pass therefore finds for every split how it ends if it starts outside quotes
and if it starts inside, and how many records begin in it either way. Chained
from the first split of a file on, these say how every split really starts. In
the second pass every split cuts its lines into records; what reaches over a
border is put together by the split in which the record begins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OPTIONS = {"multiLine": "true", "escape": '"', "encoding": "UTF-8"}
_REST = re.compile(rb'(?:(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+)?+,)*+"(?:[^"]++|"")*+\Z')     # whole cells, then one that stays open
_OPEN = re.compile(rb'(?:[^"]++|"")*+')


def open_at_end(line: bytes, inside: bool) -> bool:
    """Whether the line break after a line is inside quotes, by whether the one before it was.

    A cell is quoted if its first character is a quote; two quotes in it stand
    for one. What follows the closing quote belongs to the cell up to the comma.
    Quotes in other cells are characters like any other.
    """
    if b'"' not in line:
        return inside
    start = 0
    if inside:
        start = _OPEN.match(line).end()
        if start == len(line):
            return True
        start = line.find(b",", start)
        if start < 0:
            return False
        start += 1
    return _REST.match(line, start) is not None


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines in file order inside a split, with the file and the start of the split."""
    return spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("size"),
        F.col("value").cast("binary").alias("line"))


def _by_split(batches: Iterator[pa.RecordBatch], sizes: dict[str, int] | None = None) -> Iterator[tuple[tuple[str, int], list[bytes]]]:
    """(split, some of its lines in order); a split may come in several turns. ``sizes`` gets the bytes of the files."""
    for batch in batches:
        splits, starts = batch.column("split").to_numpy(), [0]
        files = batch.column("file").dictionary_encode()
        codes = files.indices.to_numpy()
        starts += (np.flatnonzero((np.diff(splits) != 0) | (np.diff(codes) != 0)) + 1).tolist()
        lines = batch.column("line").to_pylist()
        for a, b in zip(starts, [*starts[1:], len(lines)], strict=True):
            if b > a:
                file = files.dictionary[int(codes[a])].as_py()
                if sizes is not None:
                    sizes[file] = batch.column("size")[a].as_py()
                yield (file, int(splits[a])), lines[a:b]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: how it ends and how many records begin in it, from either start, and its bytes."""
    found: dict[tuple[str, int], list] = {}
    for key, lines in _by_split(batches):
        state = found.setdefault(key, [False, True, 0, 0, lines[0].endswith(b"\r"), 0])
        for line in lines:
            state[5] += len(line) + 1
            if not state[0] and line.strip(b"\r"):
                state[2] += 1
            if not state[1] and line.strip(b"\r"):
                state[3] += 1
            state[0], state[1] = open_at_end(line, state[0]), open_at_end(line, state[1])
    rows = [(*key, *state) for key, state in found.items()]
    columns = list(zip(*rows, strict=True)) or [()] * 8
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                     ["file", "split", "end_out", "end_in", "records_out", "records_in", "carriage", "bytes"])


@dataclass(frozen=True)
class Start:
    """What a split must know: how it starts and ends, in which split its first lines' record began, whether its first record is the header.

    ``bytes`` counts its lines and those before it in the file, each with a line break.
    """

    inside: bool
    open_end: bool
    owner: int
    header: bool
    carriage: bool
    bytes: int


def chain(summaries: list[tuple]) -> dict[tuple[str, int], Start]:
    """The start of every split, from the summaries of :func:`_scan`; as many entries as the driver plans splits."""
    starts: dict[tuple[str, int], Start] = {}
    file, inside, owner, seen, carriage, total = None, False, 0, 0, False, 0
    for name, split, end_out, end_in, records_out, records_in, returns, size in sorted(summaries):
        if name != file:
            file, inside, owner, seen, carriage, total = name, False, split, 0, returns, 0
        total += size
        end, records = (end_in, records_in) if inside else (end_out, records_out)
        starts[name, split] = Start(inside, end, owner, not seen and records > 0, carriage, total)
        if records:
            owner, seen = split, seen + records
        inside = end
    return starts


def _cut(shared):
    """Records as (file, split, number, turn, text, whole); text of a record that reaches over a border comes in turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts: dict[tuple[str, int], Start] = shared.value
        state: dict[tuple[str, int], list] = {}      # inside, number, open lines
        sizes: dict[str, int] = {}

        def row(key, number, lines, whole):
            start, text = starts[key], b"\n".join(lines)
            if start.carriage:      # the file's line break is \r\n, which the parser hands on as \n
                text = text.replace(b"\r\n", b"\n").removesuffix(b"\r")
            head = number == 0
            return key[0], start.owner if head else key[1], -1 if head else number, key[1], text, whole and not head

        for key, lines in _by_split(batches, sizes):
            if key not in starts:
                raise RuntimeError(f"the file splits changed between two reads of {key[0]}")
            inside, number, held = state.setdefault(key, [starts[key].inside, 0, []])
            out = []
            for line in lines:
                if not inside:
                    if not line.strip(b"\r"):
                        continue
                    number += 1
                held.append(line)
                inside = open_at_end(line, inside)
                if not inside:
                    out.append(row(key, number, held, True))
                    held = []
            state[key] = [inside, number, held]
            yield _batch([r for r in out if not (r[2] == 1 and starts[key].header and r[1] == key[1])])
        for key, (_, _, held) in state.items():
            if held and starts[key].bytes == sizes[key[0]]:      # a quote that nothing closes takes the last line break too
                held.append(b"")
        rest = [(key, number, held) for key, (_, number, held) in state.items() if held]
        yield _batch([row(key, number, held, False) for key, number, held in rest if not (number == 1 and starts[key].header)])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "split", "number", "turn", "text", "whole"])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the files below the header: ``file``, ``split``, ``number`` and ``text`` without its last line break.

    Records of a split stay in their order; if one reaches over a border all
    are sorted. Empty lines between records are left out. The driver holds one
    summary per split, as it holds the split itself.
    """
    lines = _lines(spark, path)
    schema = "file string, split long, end_out boolean, end_in boolean, records_out long, records_in long, carriage boolean, bytes long"
    starts = chain([tuple(r) for r in lines.mapInArrow(_scan, schema).collect()])
    cut = lines.mapInArrow(_cut(spark.sparkContext.broadcast(starts)), "file string, split long, number long, turn long, text binary, whole boolean")
    columns = ["file", "split", "number", F.col("text").cast("string").alias("text")]
    if not any(s.open_end for s in starts.values()):
        return cut.select(*columns)
    # A tail has the number of its record, the pieces that follow it have none: the last record of the split in which it began.
    parts = cut.where("NOT whole")
    pieces = parts.groupBy("file", "split").agg(
        F.max("number").alias("number"), F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda p: p["text"]).alias("texts"))
    joined = pieces.select("file", "split", "number", F.array_join(F.transform("texts", lambda t: t.cast("string")), "\n").alias("text"))
    return cut.where("whole").select(*columns).unionByName(joined.where("number > 0")).orderBy("file", "split", "number")


def read_split_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all columns text, equal to Spark's own reader with ``multiLine`` but read by all cores.

    Names come from the header as Spark's reader makes them; cells a record
    lacks are NULL, cells too many are dropped. One thing differs: where a
    file's lines end in \\r\\n, a bare line feed outside quotes ends a record
    here and is part of a cell there.
    """
    names = spark.read.csv(path, header=True, inferSchema=False, **OPTIONS).columns
    inner = ", ".join(f"c{i} string" for i in range(len(names)))
    cells = read_records(spark, path).select(F.from_csv("text", inner, OPTIONS).alias("r"))
    return cells.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])
