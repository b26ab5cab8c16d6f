"""Removal of long repeated spans by compacting the graph of word windows.

Every run of WINDOW words is an edge of a De Bruijn graph over words. Edges
that follow one another in a text and share their smallest gram (their anchor)
form a path without branches inside the text, so they are compacted at the
source and travel as one row. Joins then tell apart paths that occur more than
once as a whole, paths whose anchor occurs nowhere else, and the few between,
at the ends of repeated spans: only those are opened into their edges. Source
coordinates carry each verdict back to its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentloom.llm.batches import added, raw_texts, row_key, stored, typed, words_of
from rentloom.llm.hashing import BASES, RunHashes, WordHashes, anchors, mix
from rentloom.operators.scale import skew_join

WINDOW = 35        # words of an edge
GRAM = 8           # words of an anchor
PLACE_BITS = 16    # a place is the first edge of a path and, in its lower bits, the number of edges
SLICE_BYTES = 4 << 20  # text that a task gets at a time where paths are made
_KEY = "_k1 long, _k2 long"


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


class Paths:
    """Compacted paths of a text: first edge, number of edges, anchor hash and a hash of the whole content."""

    def __init__(self, window: int) -> None:
        self.window, self.reach = window, window - GRAM + 1
        self.words, self.one, self.two = WordHashes(), RunHashes(BASES[0]), RunHashes(BASES[1])

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, ...] | None:
        if len(words) < self.window:
            return None
        hashes = self.words(words)
        sums = self.one.sums(hashes)
        starts = np.arange(len(words) - GRAM + 1)
        grams = self.one.runs(sums, starts, starts + GRAM)
        anchor = anchors(grams, self.reach)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        count = np.diff(np.concatenate([first, [len(anchor)]]))
        at = anchor[first]
        place = ((at - first).astype(np.uint64) << np.uint64(32)) | count.astype(np.uint64)
        end = first + count + self.window - 1
        whole = mix(self.two.runs(self.two.sums(hashes), first, end) + place)
        return first, count, grams[at], whole


def _paths(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = Paths(window)
        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("_k1", "_k2")]
            rows, found = [], []
            for i, raw in enumerate(raw_texts(batch, "_text")):
                if (made := paths(words_of(raw))) is not None:
                    rows.append(np.full(len(made[0]), i))
                    found.append(made)
            if not found:
                continue
            row = np.concatenate(rows)
            first, count, anchor, whole = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[0][row]), pa.array(keys[1][row]), pa.array((first << PLACE_BITS) | count), _signed(anchor), _signed(whole)],
                ["_k1", "_k2", "place", "anchor", "whole"])
    return run


def _open(window: int):
    """The edges of open paths: two content hashes each, with their place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_hash, one, two = WordHashes(), RunHashes(BASES[0]), RunHashes(BASES[1])
        for batch in batches:
            out = []
            for i, (raw, opened) in enumerate(zip(raw_texts(batch, "_text"), batch.column("opened").to_pylist(), strict=True)):
                hashes = words_hash(words_of(raw))
                places = [(o["place"] >> PLACE_BITS, o["place"] & ((1 << PLACE_BITS) - 1), o["wanted"]) for o in opened]
                start = np.concatenate([np.arange(first, first + count) for first, count, _ in places])
                wanted = np.concatenate([np.full(count, want) for _, count, want in places])
                out.append((np.full(len(start), i), start, wanted, one.runs(one.sums(hashes), start, start + window),
                            two.runs(two.sums(hashes), start, start + window)))
            if not out:
                continue
            row, start, wanted, h1, h2 = (np.concatenate(x) for x in zip(*out, strict=True))
            k1, k2 = (batch.column(c).to_numpy(zero_copy_only=False)[row] for c in ("_k1", "_k2"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1), pa.array(k2), pa.array(start.astype(np.int32)), pa.array(wanted.astype(bool)), _signed(h1), _signed(h2)],
                ["_k1", "_k2", "first", "wanted", "one", "two"])
    return run


def _covered(spans: list | None, n: int) -> np.ndarray:
    edges = np.zeros(n + 1, np.int32)
    for span in spans or ():
        edges[span["first"]] += 1
        edges[span["first"] + span["words"]] -= 1
    return np.cumsum(edges[:-1]) > 0


def repeated_spans(source: DataFrame, dealt: DataFrame, text: str, window: int = WINDOW) -> DataFrame:
    """Spans whose words are covered by a window that starts more than once: ``_k1``, ``_k2``, ``spans``.

    ``source`` has the row key and ``_text``, each key once; a row marked
    ``_twin`` stands for several and counts twice. ``dealt`` has the same rows
    dealt out by the key, so that opened paths and the caller read one shuffle.
    """
    texts = source.unionByName(source.where("_twin")).select("_k1", "_k2", "_text").where(F.col("_text").isNotNull())
    paths = texts.mapInArrow(_paths(window), f"{_KEY}, place long, anchor long, whole long")
    same = paths.groupBy("anchor", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.xxhash64("_k1", "_k2", "place")).alias("chosen"))
    same = stored(same, "contents", batch_bytes=SLICE_BYTES)
    # Aggregated sides are keyed by complements, so that they are dealt out anew and hot keys of the other side can be split.
    shared = same.groupBy("anchor").agg(F.count(F.lit(1)).alias("contents"), F.sum("n").alias("total")).where("total >= 2")
    shared = shared.select(F.bitwise_not("anchor").alias("_a"), "contents")
    again = same.where("n >= 2").select(F.bitwise_not("anchor").alias("_a"), F.bitwise_not("whole").alias("_w"), "chosen")
    met = paths.withColumns({"_a": F.bitwise_not("anchor"), "_w": F.bitwise_not("whole")}).drop("anchor", "whole")
    judged = met.join(shared, "_a").join(again, ["_a", "_w"], "left")
    repeated = F.col("chosen").isNotNull()
    # A path that repeats as a whole needs its edges only as partners, and only once.
    opens = (F.col("contents") >= 2) & (~repeated | (F.col("chosen") == F.xxhash64("_k1", "_k2", "place")))
    judged = judged.select("_k1", "_k2", "place", repeated.alias("repeated"), opens.alias("opens")).where("repeated OR opens")
    judged = stored(judged, "paths", batch_bytes=SLICE_BYTES)
    opened = judged.where("opens").groupBy("_k1", "_k2").agg(F.collect_list(F.struct("place", (~F.col("repeated")).alias("wanted"))).alias("opened"))
    edges = dealt.join(opened, ["_k1", "_k2"]).drop(text, "_twin").mapInArrow(_open(window), f"{_KEY}, first int, wanted boolean, one long, two long")
    twice = edges.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select(F.bitwise_not("one").alias("_o"), F.bitwise_not("two").alias("_t"))
    wanted = edges.where("wanted").withColumns({"_o": F.bitwise_not("one"), "_t": F.bitwise_not("two")})
    edge_spans = wanted.join(twice, ["_o", "_t"], "left_semi").select("_k1", "_k2", "first", F.lit(window).alias("words"))
    first, count = F.shiftright("place", PLACE_BITS), F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    path_spans = judged.where("repeated").select("_k1", "_k2", first.cast("int").alias("first"), (count + (window - 1)).cast("int").alias("words"))
    spans = path_spans.unionByName(edge_spans)
    return spans.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("first", "words")).alias("spans"))


def _equal_rows(source: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``source`` with each row key once, ``_twin`` where it stands for equal rows; and all equal rows, if there are any.

    Equal rows are found by a count of keys and brought together by a combining
    aggregate, so a row repeated without end neither meets itself nor fills a task.
    """
    keys = ["_k1", "_k2"]
    twins = stored(source.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select(*keys), "equal_rows")
    if twins.isEmpty():
        return source.withColumn("_twin", F.lit(False)), None
    told = skew_join(source, twins.withColumn("_twin", F.lit(True)), keys, "left").withColumn("_twin", F.coalesce("_twin", F.lit(False)))
    equal = told.where("_twin")
    return told.where("NOT _twin").unionByName(stored(equal.dropDuplicates(keys), "one_of_equal_rows")), equal


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, digest: bool = False) -> DataFrame:
    """Remove every word covered by a run of ``window`` words that also starts anywhere else, same document included.

    Words stand between ASCII white space. All columns of ``docs`` are kept;
    ``text`` becomes the kept words joined by one space where words were
    removed and stays as it is elsewhere, and ``_n_words`` and ``_n_removed``
    are added (one more underscore where a column has that name). With ``digest`` the columns are ``id``, ``n_words``,
    ``n_removed``, ``kept_sha256`` (of the kept words joined by one space).

    Repeats are judged on the input. Equal rows repeat each other, so all words
    of one that has a window go, and one of them stands for all in the search
    for partners; tied ids with
    different texts are different documents; a null or empty text and a text
    shorter than the window keep what they have; a null text stays null; an
    empty table gives no rows. Content is compared by 128 bits of hash: of the anchor
    and the whole path, or two of the window. Paths
    combine before they are shuffled, and what comes back to a document is at
    most its own paths.
    """
    names = [id, text] if digest else list(docs.columns)
    carried, body = [f"_c{i}" for i in range(len(names))], f"_c{names.index(text)}"      # no clash with inner names
    source = docs.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, carried, strict=True)], *row_key(id, text))
    source, equal = _equal_rows(source)
    dealt = source.repartition("_k1", "_k2").withColumn("_text", F.col(body))
    spans = repeated_spans(source.withColumn("_text", F.col(body)), dealt, body, window)
    judged = dealt.join(spans, ["_k1", "_k2"], "left").where("NOT _twin").select(*carried, "spans", F.lit(False).alias("all"))
    if equal is not None:
        judged = judged.unionByName(equal.select(*carried, F.lit(None).cast(judged.schema["spans"].dataType).alias("spans"), F.lit(True).alias("all")))
    counted = ["n_words", "n_removed"] if digest else added(["_n_words", "_n_removed"], names)
    counts_of = ", ".join(f"`{c}` long" for c in counted)
    schema = f"{typed(docs, *names[:1] if digest else names)}, {counts_of}{', kept_sha256 string' if digest else ''}"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, removed = [], [], []
            for raw, found, whole in zip(raw_texts(batch, body), *(batch.column(c).to_pylist() for c in ("spans", "all")), strict=True):
                words = words_of(raw)
                gone = np.full(len(words), len(words) >= window) if whole else _covered(found, len(words))
                total.append(len(words))
                removed.append(int(gone.sum()))
                left = words if not removed[-1] else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                if digest:
                    kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
                else:
                    kept.append(raw if not removed[-1] else b" ".join(left))
            counts = [pa.array(total, pa.int64()), pa.array(removed, pa.int64())]
            if digest:
                yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(kept, pa.string())], [id, *counted, "kept_sha256"])
                continue
            columns = [pa.array(kept, pa.binary()).cast(pa.string()) if c == text else batch.column(i) for i, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*columns, *counts], [*names, *counted])

    return judged.mapInArrow(cut, schema)
