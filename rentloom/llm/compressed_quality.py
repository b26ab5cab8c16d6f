"""Text quality by compression: which of two dictionaries makes a text smaller.

One zstandard dictionary is built from texts labelled good, one from texts
labelled bad. A text is compressed with either and with none; the normalised
difference of the sizes, calibrated on labelled texts that are in no
dictionary, is the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentloom.llm.batches import raw_texts, stored, typed

PIECE = 1024            # bytes compressed at a time, so that the dictionary counts throughout a long text
LEVEL = 3
DICTIONARY = 64 << 10   # bytes of a dictionary
FIT_TEXTS = 4096        # labelled texts of each label that the model is fitted on, at most
FIT_PIECES = 3072       # pieces of each label that a dictionary is built from, at most
GOOD = 0.7              # score from which a text is predicted good
RIDGE = 1.0


def held_out(id: str = "doc_id") -> Column:
    """Whether a row is kept from fitting: a quarter of the ids, by checksum."""
    return F.coalesce(F.pmod(F.crc32(F.col(id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def pieces_of(raw: bytes) -> list[bytes]:
    return [raw[i:i + PIECE] for i in range(0, len(raw), PIECE)]


def build_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; of too few samples to train on, their plain text."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(sum(map(len, samples)) // 4, 256)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY]


class Sizes:
    """Compressed sizes of texts with the good dictionary, the bad one and none."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.with_good, self.with_bad, self.alone = map(self._compressor, (good, bad, b""))

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        usual = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        if len(content) < 8:    # the library takes no shorter ones
            return zstandard.ZstdCompressor(**usual)
        held = zstandard.ZstdCompressionDict(content)
        held.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=held, **usual)

    def __call__(self, raw: bytes) -> tuple[int, int, int, int]:
        """Bytes of the text, then its size with good, with bad, with no dictionary."""
        pieces = pieces_of(raw)
        return (len(raw), *(sum(len(c.compress(p)) for p in pieces) for c in (self.with_good, self.with_bad, self.alone)))


def evidence(sizes: np.ndarray) -> np.ndarray:
    """What the calibration sees of the four sizes: the normalised difference, two ratios, the logarithm of the length."""
    n, good, bad, alone = np.maximum(sizes.astype(float).reshape(-1, 4), 1).T
    return np.stack([(bad - good) / (bad + good), alone / n, good / n, np.log(n)], axis=1)


@dataclass(frozen=True)
class Calibration:
    """A ridge logistic curve on standardised evidence; ``prior`` is the score of a text without bytes."""

    prior: float
    mean: np.ndarray = field(default_factory=lambda: np.zeros(4))
    scale: np.ndarray = field(default_factory=lambda: np.ones(4))
    weights: np.ndarray | None = None

    def __call__(self, sizes: np.ndarray) -> np.ndarray:
        if self.weights is None or not len(sizes):
            return np.full(len(sizes), self.prior)
        x = (evidence(sizes) - self.mean) / self.scale
        level = self.weights[0] + sum(x[:, i] * self.weights[i + 1] for i in range(x.shape[1]))     # row by row the same in any batch
        score = np.round(1 / (1 + np.exp(-np.clip(level, -30, 30))), 9)
        return np.where(sizes[:, 0] == 0, self.prior, score)

    @classmethod
    def fit(cls, sizes: np.ndarray, label: np.ndarray, labels: tuple[int, int]) -> Calibration:
        """Newton steps, halved while they do not lower the penalised loss; a constant if only one label is there.

        ``labels`` counts the labels 0 and 1 the sample stands for: rows are
        weighted so that both have their share, however many were sampled.
        """
        prior = (labels[1] + 1) / (sum(labels) + 2)
        sizes, label = sizes[sizes[:, 0] > 0], label[sizes[:, 0] > 0]
        if len(set(label.tolist())) < 2:
            return cls(prior)
        share = np.where(label == 1, labels[1] / label.sum(), labels[0] / (1 - label).sum())
        share *= len(label) / share.sum()
        x = evidence(sizes)
        mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
        x = np.concatenate([np.ones((len(x), 1)), (x - mean) / scale], axis=1)
        penalty = np.array([1e-6, *[RIDGE] * 4])

        def loss(w: np.ndarray) -> float:
            z = x @ w
            return float((share * (np.logaddexp(0, z) - label * z)).sum() + 0.5 * (penalty * w * w).sum())

        w = np.zeros(5)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x.T * (share * p * (1 - p))) @ x + np.diag(penalty), x.T @ (share * (label - p)) - penalty * w)
            while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
                step = step / 2
            w = w + step
            if np.abs(step).max() < 1e-9:
                break
        return cls(prior, mean, scale, w)


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    calibration: Calibration

    def score(self, raws: list[bytes | None]) -> np.ndarray:
        measure = Sizes(self.good, self.bad)
        return self.calibration(np.array([measure(raw or b"") for raw in raws], np.int64).reshape(-1, 4))


def _labelled(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str) -> tuple[DataFrame, tuple[int, int]]:
    """At most FIT_TEXTS different texts of each label, chosen by hash, with their label and text hash, stored; the labels 0 and 1 there are."""
    known = labels.where(~held_out(id)).where(F.col(label).isin(0, 1)).select(F.col(id).alias("_id"), F.col(label).cast("int").alias("_label")).distinct()
    known = stored(known.join(docs.select(F.col(id).alias("_id")).distinct(), "_id", "left_semi"), "labels")
    there = known.agg(F.count_if(F.col("_label") == 0), F.count_if(F.col("_label") == 1)).first()
    chosen = [known.where(F.col("_label") == kind).orderBy(F.xxhash64("_id")).limit(FIT_TEXTS) for kind in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))
    texts = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).join(ids, "_id").where("_text IS NOT NULL")
    texts = stored(texts.select("_label", F.xxhash64("_text").alias("_hash"), "_text").dropDuplicates(["_label", "_hash"]), "labelled")
    few = [texts.where(F.col("_label") == kind).orderBy("_hash").limit(FIT_TEXTS) for kind in (0, 1)]
    return stored(few[0].unionByName(few[1]), "labelled"), tuple(there)


def _piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for kind, raw in zip(batch.column("_label").to_pylist(), raw_texts(batch, "_text"), strict=True):
            pieces = pieces_of(raw or b"")
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(pieces), pa.int32()), pa.array(pieces, pa.binary())], ["_label", "_piece"])


def fit_quality(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality") -> QualityModel:
    """Dictionaries and calibration from the labelled rows that are not held out.

    The sample is bounded: FIT_TEXTS different texts of each label, chosen by
    hash. Half of them, by text hash, give the pieces of which the dictionaries
    are built (FIT_PIECES each); the other half calibrates, so no text vouches
    for itself. Only the pieces and four sizes a text come to the driver.
    Labels other than 0 and 1, labels without a document and null texts are not
    used; a text with both labels counts under both; without texts of both
    labels the score is the share of label 1.
    """
    sample, there = _labelled(docs, labels, id, text, label)
    for_dictionary = sample.where("_hash % 2 = 0").select("_label", "_text").mapInArrow(_piece_rows, "_label int, _piece binary").distinct()
    built = []
    for kind in (1, 0):
        rows = for_dictionary.where(F.col("_label") == kind).orderBy(F.xxhash64("_piece"), "_piece").limit(FIT_PIECES).collect()
        built.append(build_dictionary([bytes(r["_piece"]) for r in rows]))
    good, bad = built

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Sizes(good, bad)
        for batch in batches:
            sizes = np.array([measure(raw or b"") for raw in raw_texts(batch, "_text")], np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column("_label"), *(pa.array(sizes[:, i]) for i in range(4))], ["_label", "n", "good", "bad", "alone"])

    rows = sample.where("_hash % 2 != 0").select("_label", "_text").mapInArrow(measured, "_label int, n long, good long, bad long, alone long").collect()
    sizes = np.array([tuple(r)[1:] for r in sorted(map(tuple, rows))], np.int64).reshape(-1, 4)
    label_of = np.array([r[0] for r in sorted(map(tuple, rows))], float)
    return QualityModel(good, bad, Calibration.fit(sizes, label_of, there))


def quality_scores(docs: DataFrame, model: QualityModel, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Score of every text: columns ``id``, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 from GOOD on).

    Whole texts are compressed piece by piece, in one pass without a shuffle.
    One output row per input row; equal texts get equal scores whatever their
    id, null and empty texts the share of label 1, a null id is not held out,
    an empty table gives no rows. Only ``id`` and ``text`` are read.
    """
    picked = docs.select(F.col(id).alias("_id"), held_out(id).alias("held_out"), F.col(text).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure, calibrated = Sizes(shared.value.good, shared.value.bad), shared.value.calibration
        for batch in batches:
            sizes = np.array([measure(raw or b"") for raw in raw_texts(batch, "_text")], np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(calibrated(sizes), pa.float64())], ["_id", "held_out", "score"])

    scored = picked.mapInArrow(score, f"{typed(picked, '_id')}, held_out boolean, score double")
    return scored.select(F.col("_id").alias(id), "held_out", "score", F.when(F.col("score") >= GOOD, 1).otherwise(0).alias("predicted"))


def classify_quality(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Fit on the labelled rows that are not held out, then score all rows; see the two functions above."""
    return quality_scores(docs, fit_quality(docs, labels, id, text, label), id, text)
