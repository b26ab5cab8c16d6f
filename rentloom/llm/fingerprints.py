"""Document fingerprints: every shingle hash below a fixed fraction of the hash range; of short texts all of them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentloom.llm.batches import raw_texts, row_key, stored, typed, words_of
from rentloom.llm.hashing import RunHashes, WordHashes
from rentloom.llm.neighbours import with_neighbours

SHINGLE = 5       # words
FRACTION = 8      # one hash in so many is retained
FEW = 8           # a text with fewer retained hashes is short: its fingerprint is complete
EMITTED = 256     # rows per output batch


class Sketch:
    """The distinct shingle hashes of one text: ``below`` the threshold, and ``whole`` on demand."""

    def __init__(self, hashes: np.ndarray, below: np.uint64) -> None:
        self.hashes, self.limit = hashes, below
        self.below = np.unique(hashes[hashes <= below])
        self.short = len(self.below) < FEW

    @property
    def whole(self) -> np.ndarray:
        return np.unique(self.hashes)

    def written(self) -> str:
        """16 hex digits per hash, ascending; of a short text the hashes above the threshold follow between ``+`` and ``!``."""
        if not self.short or not len(self.hashes):
            return written(self.below)
        whole = self.whole
        return f"{written(self.below)}+{written(whole[whole > self.limit])}!"


class Sketcher:
    """The sketch of a text: its shingle hashes below 2**64 / FRACTION.

    The threshold does not depend on the text, so sketches of parts merge by
    union and containment can be estimated between texts of any two sizes. A
    text with too few hashes below it is short and keeps all of them apart
    from the sketch. A text of fewer than SHINGLE words is one shingle, one
    without words has an empty sketch.
    """

    def __init__(self, shingle: int = SHINGLE, fraction: int = FRACTION) -> None:
        self.words, self.runs, self.shingle = WordHashes(), RunHashes(), shingle
        self.below = np.uint64((1 << 64) // fraction - 1)

    def __call__(self, raw: bytes) -> Sketch:
        words = words_of(raw)
        hashes = self.runs.windows(self.words(words), min(self.shingle, len(words))) if words else np.zeros(0, np.uint64)
        return Sketch(hashes, self.below)


def likeness(a: Sketch, b: Sketch) -> float:
    """Shared part of the shingles: of the sketches, of all if one text is short; two empty texts are alike."""
    p, q = (a.whole, b.whole) if a.short or b.short else (a.below, b.below)
    shared = len(np.intersect1d(p, q, assume_unique=True))
    total = len(p) + len(q) - shared
    return shared / total if total else 1.0


def written(hashes: np.ndarray) -> str:
    return hashes.astype(">u8").tobytes().hex()


def hashes_of(fingerprint: Column) -> Column:
    """All hashes a fingerprint names: the sketch and those of short texts."""
    return F.regexp_extract_all(fingerprint, F.lit("[0-9a-f]{16}"), F.lit(0))


def sketch_of(fingerprint: Column) -> Column:
    return hashes_of(F.substring_index(fingerprint, "+", 1))


def is_complete(fingerprint: Column) -> Column:
    """Whether a fingerprint names all shingles of its text."""
    return (fingerprint == "") | fingerprint.endswith("!")


def merged(a: Column, b: Column) -> Column:
    """The fingerprint of two texts taken together (without shingles across their border).

    The part before ``+`` is the sketch of both. What short texts keep above the
    threshold stays known; only of two complete ones the result is complete.
    """
    sketch = F.array_join(F.array_sort(F.array_union(sketch_of(a), sketch_of(b))), "")
    above = [F.array_except(hashes_of(x), sketch_of(x)) for x in (a, b)]
    known = F.array_join(F.array_sort(F.array_union(*above)), "")
    complete = is_complete(a) & is_complete(b)
    return (F.when((a == "") & (b == ""), F.lit("")).when(complete, F.concat(sketch, F.lit("+"), known, F.lit("!")))
            .when(known == "", sketch).otherwise(F.concat(sketch, F.lit("+"), known)))


def containment(a: Column, b: Column) -> Column:
    """Share of the first text's shingles that the second has: estimated by the sketches, exact for short texts.

    Null where the fingerprints cannot tell: a short first text that the second
    fingerprint, not a complete one, does not name in full. Such texts are
    looked up by :func:`short_text_containment`.
    """
    known = F.size(F.array_intersect(hashes_of(a), hashes_of(b)))
    exact = F.when(is_complete(b) | (known == F.size(hashes_of(a))), known / F.nullif(F.size(hashes_of(a)), F.lit(0)))
    estimate = F.size(F.array_intersect(sketch_of(a), sketch_of(b))) / F.nullif(F.size(sketch_of(a)), F.lit(0))
    return F.when(is_complete(a), exact).otherwise(estimate)


def _shingle_rows(widths: list[int] | None):
    """(_k1, _k2, width, hash) of short texts; with ``widths`` of all texts, for runs of so many words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketcher()
        for batch in batches:
            for k1, k2, raw in zip(batch.column("_k1").to_pylist(), batch.column("_k2").to_pylist(), raw_texts(batch, "_text"), strict=True):
                words = words_of(raw)
                if widths is None and not sketch(raw).short:
                    continue
                hashes = sketch.words(words)
                for width in ([min(SHINGLE, len(words))] if words else []) if widths is None else widths:
                    found = np.unique(sketch.runs.windows(hashes, width)).view(np.int64)
                    if len(found):
                        n = len(found)
                        yield pa.RecordBatch.from_arrays([pa.array([k1] * n, pa.int64()), pa.array([k2] * n, pa.int64()), pa.array([width] * n, pa.int32()),
                                                          pa.array(found)], ["_k1", "_k2", "width", "hash"])
    return run


def short_text_containment(docs: DataFrame, others: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Exact containment of the short texts of ``docs`` in the texts of ``others``: ``id``, ``other_id``, ``containment``.

    Sketches cannot hold short texts, so all their shingles meet those of the
    other texts in a join; a text of fewer than SHINGLE words meets runs of as
    many words. Pairs that share no shingle have no row; equal rows count once.
    """
    schema = "_k1 long, _k2 long, width int, hash long"
    keyed = [d.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), *row_key(id, text)) for d in (docs, others)]
    rows = [k.dropDuplicates(["_k1", "_k2"]).select("_k1", "_k2", "_text") for k in keyed]
    short = stored(rows[0].mapInArrow(_shingle_rows(None), schema), "short-shingles")
    widths = [r["width"] for r in short.select("width").distinct().collect()]
    there = rows[1].mapInArrow(_shingle_rows(widths), schema).toDF("o1", "o2", "width", "hash")
    sizes = short.groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("n"))
    shared = short.join(there, ["width", "hash"]).groupBy("_k1", "_k2", "o1", "o2").agg(F.count(F.lit(1)).alias("shared")).join(sizes, ["_k1", "_k2"])
    names = keyed[0].select("_k1", "_k2", F.col("_id").alias(id)).distinct()
    other_names = keyed[1].select(F.col("_k1").alias("o1"), F.col("_k2").alias("o2"), F.col("_id").alias("other_id")).distinct()
    return (shared.join(names, ["_k1", "_k2"]).join(other_names, ["o1", "o2"])
            .select(id, "other_id", (F.col("shared") / F.col("n")).alias("containment")))


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, compared with each other and with the next document.

    In the edited form the last floor(n / 2) code points are replaced by the
    first as many (or all) of the next document by ascending ``id``; after the
    last comes the first. Tied ids follow in order of their texts, repeated rows
    follow each other; a document without an id has no place in the order and
    counts as its own next. Null texts are empty; other columns are not read;
    an empty table gives no rows. The text is shuffled once, into sorted
    buckets; a task holds one document and its successor.
    """
    picked = docs.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    ordered = with_neighbours(picked, "_id", "_text").select("_id", "_bucket", "_copy", "_text")
    fields = (f"{typed(picked, '_id').replace('_id', id)}, n_chars long, edited_sha256 string, fingerprint string, "
              "edited_fingerprint string, near_edited double, near_next double")
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def sketch_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketcher()
        key_type, names = None, [id, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        out: list[tuple] = []
        last = None     # (bucket, id, text, sketch) of a row whose successor has not come yet

        def emit(row: tuple, following: str, following_sketch: Sketch) -> None:
            _, key, text_, own = row
            half = len(text_) // 2
            edited = (text_[:len(text_) - half] + following[:half]).encode()
            changed = sketch(edited)
            out.append((key, len(text_), hashlib.sha256(edited).hexdigest(), own.written(), changed.written(),
                        likeness(own, changed), likeness(own, following_sketch)))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [key_type, *kinds], strict=True)], names)

        for batch in batches:
            key_type = batch.schema.field("_id").type
            rows = zip(batch.column("_bucket").to_pylist(), batch.column("_copy").to_pylist(), batch.column("_id").to_pylist(),
                       raw_texts(batch, "_text"), strict=True)
            for bucket, copy, key, raw in rows:
                if copy < 0 or (last is None and copy):
                    continue
                own, text_ = sketch(raw), raw.decode("utf-8", "replace")
                if last is not None:
                    emit(last, text_, own)
                    last = None
                if bucket < 0:
                    emit((bucket, key, text_, own), text_, own)
                elif not copy:
                    last = bucket, key, text_, own
                if len(out) >= EMITTED:
                    yield flush()
        if out:
            yield flush()

    return ordered.mapInArrow(sketch_all, fields)
