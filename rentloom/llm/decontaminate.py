"""Passages of benchmark items inside documents: winnowed fingerprints of both sides are joined and extended to whole windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentloom.llm.batches import added, bounded, raw_texts, row_key, stored
from rentloom.llm.collocations import Filter
from rentloom.llm.hashing import BASES, RunHashes, WordHashes, anchors
from rentloom.operators.scale import skew_join

WINDOW = 13                     # words that must agree in a row
GRAM = 7                        # words per fingerprint
REACH = WINDOW - GRAM + 1       # fingerprints per winnowing window: any shared WINDOW words share one
SLICE_BYTES = 4 << 20           # text handled at a time in a task
_KEY = ["_k1", "_k2"]
_SAME = ["gram", "one", "two"]  # fingerprint of a window and two hashes of all its words
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"      # words as item_words finds them
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def item_words(raw: bytes | None) -> list[bytes]:
    """Lower-case words: digits, a-z and everything outside ASCII."""
    return raw.translate(_LOWER).split() if raw else []


class Windows:
    """Windows of a text: the fingerprint that winnowing keeps in each, and hashes of its words."""

    def __init__(self) -> None:
        self.words, self.first, self.second = WordHashes(), RunHashes(BASES[0]), RunHashes(BASES[1])

    def kept(self, hashes: np.ndarray, width: int) -> np.ndarray:
        """The fingerprint of every window: the smallest gram hash, or all words where a window is short."""
        if width < WINDOW:
            return self.first.windows(hashes, width)
        grams = self.first.windows(hashes, GRAM)
        return grams[anchors(grams, REACH)]

    def whole(self, hashes: np.ndarray, starts: np.ndarray, width: int) -> list[np.ndarray]:
        return [h.runs(h.sums(hashes), starts, starts + width) for h in (self.first, self.second)]


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of the items; an item of fewer words is one window of its own length."""
    windows = Windows()
    for batch in batches:
        for name, raw in zip(batch.column("name"), raw_texts(batch, "_text"), strict=True):
            hashes = windows.words(item_words(raw))
            if not len(hashes):
                continue
            width = min(WINDOW, len(hashes))
            starts = np.arange(len(hashes) - width + 1)
            columns = [windows.kept(hashes, width), *windows.whole(hashes, starts, width)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name.as_py()] * len(starts), pa.string()), pa.array(np.full(len(starts), width, np.int32)), *map(_long, columns)],
                ["name", "width", *_SAME])


def _candidates(listed, widths: list[int]):
    """Windows of documents whose fingerprint may be one of an item: a row for each that differs, with all its starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, known = Windows(), listed.value
        for batch in bounded(batches, "_text", SLICE_BYTES):
            rows, found = [], []
            for i, raw in enumerate(raw_texts(batch, "_text")):
                hashes = windows.words(item_words(raw))
                for width in widths:
                    if len(hashes) < width:
                        continue
                    kept = windows.kept(hashes, width)
                    starts = np.flatnonzero(known(kept))
                    if not len(starts):
                        continue
                    one, two = windows.whole(hashes, starts, width)
                    order = np.argsort(one, kind="stable")
                    first = np.flatnonzero(np.concatenate([[True], np.diff(one[order]) != 0]))
                    at = order[first]
                    rows.append(np.full(len(at), i))
                    found.append((np.full(len(at), width), kept[starts[at]], one[at], two[at], np.diff(np.append(first, len(order))), starts[order]))
            if not rows:
                continue
            row = np.concatenate(rows)
            width, *same, count, starts = (np.concatenate(x) for x in zip(*found, strict=True))
            keys = [pa.array(batch.column(c).to_numpy(zero_copy_only=False)[row]) for c in _KEY]
            ends = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(starts.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*keys, pa.array(width.astype(np.int32)), *map(_long, same), lists], [*_KEY, "width", *_SAME, "starts"])

    return run


def covered(spans: list[dict]) -> int:
    """How many words lie in at least one window."""
    start = np.concatenate([np.asarray(s["starts"], np.int64) for s in spans])
    end = start + np.repeat([s["width"] for s in spans], [len(s["starts"]) for s in spans])
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    before = np.concatenate([[0], np.maximum.accumulate(end)[:-1]])
    return int(np.maximum(end - np.maximum(start, before), 0).sum())


def _count_covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = pa.array([covered(spans) for spans in batch.column("spans").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _KEY), counts], [*_KEY, "n_hit"])


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents with windows of items: ``_k1``, ``_k2``, ``n_hit``, ``n_items``, ``items_sha256``.

    ``docs`` has the row key and ``_text``, ``items`` has ``name`` and ``_text``.
    """
    spark = docs.sparkSession
    windows = stored(items.mapInArrow(_item_windows, "name string, width int, gram long, one long, two long").distinct(), "item_windows", batch_bytes=SLICE_BYTES)
    # Windows with the same items are told by a hash of the set, so that a document meets each set once and not each window.
    sets = [F.bit_xor(F.xxhash64("name")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(7), "name")).alias("s2")]
    known = stored(windows.groupBy(*_SAME).agg(*sets), "windows")
    widths = sorted(r["width"] for r in windows.select("width").distinct().collect())
    listed = spark.sparkContext.broadcast(Filter.of(known.select(F.col("gram").alias("h"))))
    found = docs.select(*_KEY, "_text").where("_text IS NOT NULL").mapInArrow(
        _candidates(listed, widths), "_k1 long, _k2 long, width int, gram long, one long, two long, starts array<int>")
    matched = stored(skew_join(stored(found, "candidates", batch_bytes=SLICE_BYTES), known, _SAME, "inner").drop(*_SAME), "matches")
    spans = matched.groupBy(*_KEY).agg(F.collect_set(F.struct("width", "starts")).alias("spans"))
    words = spans.mapInArrow(_count_covered, "_k1 long, _k2 long, n_hit long")
    example = known.groupBy("s1", "s2").agg(F.min(F.struct(*_SAME)).alias("w")).select("s1", "s2", "w.*")
    members = windows.join(example, _SAME).select("s1", "s2", "name")
    names = matched.select(*_KEY, "s1", "s2").distinct().join(members, ["s1", "s2"])
    names = names.groupBy(*_KEY).agg(F.sort_array(F.collect_set("name")).alias("names"))
    return words.join(names.select(*_KEY, F.size("names").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "names"), 256).alias("items_sha256")), _KEY)


def contamination(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", keep: bool = False) -> DataFrame:
    """Words of every document that lie in a window of a benchmark item, and the items found.

    Columns ``id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``,
    ``contaminated``; with ``keep`` all columns of ``docs`` come along, prefixed
    results (``_n_words`` ..., one more underscore where a column has that name)
    beside them. Fingerprints of both sides are the
    smallest gram hashes of every REACH grams in a row, so any WINDOW shared
    words share one. A bitmap of fixed size tells which fingerprints of
    documents may be those of items; these are joined with the items' and
    extended to their windows, which are compared by two independent hashes.
    Items of fewer words are compared as a whole at every place. Neither side
    passes through the driver, and keys with many rows are split. One output row
    per input row; null and empty texts have no words
    and no hits, rows of one item id count as one item, an item without an id
    is called null, items without words never occur, an empty benchmark hits
    nothing, tied and repeated rows give equal rows.
    """
    names = list(docs.columns) if keep else [id]
    carried = [f"_c{i}" for i in range(len(names))]      # no clash with inner names
    rows = docs.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, carried, strict=True)], *row_key(id, text), F.col(f"`{text}`").alias("_text"))
    items = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("null")).alias("name"), F.col(f"`{item_text}`").alias("_text"))
    found = stored(hits(rows, items), "hits", batch_bytes=SLICE_BYTES)
    words = F.coalesce(F.regexp_count("_text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words")
    out = skew_join(rows.select(*carried, *_KEY, words), found, _KEY, "left")
    hit = F.coalesce("n_hit", F.lit(0))
    results = {"n_words": F.col("n_words"), "n_hit": hit, "n_items": F.coalesce("n_items", F.lit(0)),
               "items_sha256": F.coalesce("items_sha256", F.sha2(F.lit(""), 256)), "contaminated": (hit > 0) & (20 * hit >= F.col("n_words"))}
    called = added([f"_{n}" for n in results], names) if keep else list(results)
    return out.select(*[F.col(c).alias(n) for n, c in zip(names, carried, strict=True)], *[v.alias(n) for n, v in zip(called, results.values(), strict=True)])
