"""Encoding texts to pieces with their place in the original bytes, and decoding them."""

import hashlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentloom.llm.batches import Memo, raw_texts, typed
from rentloom.llm.pieces import BYTE, SPACE_MARK, UNKNOWN, Normalizer, PieceModel, SafeCuts


class Encoder:
    """Identifiers and original byte spans of the pieces of a text.

    The text is normalised by the longest-prefix character map, which records
    the source of every byte. Parts between safe cuts are segmented once and
    remembered. Every piece has a width in normalised bytes; the running sum of
    the widths, looked up in the alignment, gives the span of each piece.
    """

    def __init__(self, model: bytes) -> None:
        parsed = PieceModel.parse(model)
        self.normalizer, self.cuts = Normalizer(parsed), SafeCuts(parsed)
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=parsed.plain)
        kinds = np.array([kind for _, _, kind in parsed.pieces])
        self.is_byte, self.is_unknown = kinds == BYTE, kinds == UNKNOWN
        self.widths = np.array([len(piece.replace(SPACE_MARK, " ").encode()) for piece, _, _ in parsed.pieces])
        self.widths[self.is_byte] = 1
        self.parts = Memo(self.segmenter.encode)

    def _spelled_widths(self, part: str) -> list[int]:
        """Widths read off the part itself, for marks that stand in the text and for unknown pieces."""
        widths, at, left = [], 0, 0
        for i, piece in zip(self.parts[part], self.segmenter.encode(part, out_type=str), strict=True):
            if self.is_byte[i]:
                widths.append(1)
                left = (left or len(part[at].encode())) - 1
                at += not left
            else:
                widths.append(len(part[at:at + len(piece)].encode()))
                at += len(piece)
        return widths

    def __call__(self, raw: bytes) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(ids, starts, ends); spans are bytes of ``raw``, and follow one another without gaps."""
        normal, source = self.normalizer.aligned(raw)
        words = self.cuts.words(normal.decode("utf-8", "replace"))
        self.parts.fill(set(words), lambda parts: self.segmenter.encode(parts, num_threads=1))
        ids = list(chain.from_iterable(map(self.parts.__getitem__, words)))
        listed = np.array(ids, np.int64)
        edges = np.zeros(len(ids) + 1, np.int64)
        if SPACE_MARK.encode() in normal or self.is_unknown[listed].any():
            np.cumsum(list(chain.from_iterable(map(self._spelled_widths, words))), out=edges[1:])
        else:
            np.cumsum(self.widths[listed], out=edges[1:])
        edges = np.maximum(edges - len(self.normalizer.prefix), 0) if source is None else source[edges]
        return ids, edges[:-1], edges[1:]


def _lists(arrays: Sequence, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate([np.asarray(a, np.int64) for a in arrays]) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(kind.to_pandas_dtype(), copy=False)))


def encode_pieces(docs: DataFrame, model: bytes, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``id``, ``ids``, ``starts``, ``ends`` (arrays of int): the pieces of every text and their original bytes.

    ``model`` holds a compiled piece model. No begin or end ids are added and
    nothing is sampled. One output row per input row, in one pass without a
    shuffle; repeated rows and tied ids give equal rows, an empty table gives
    none, other columns are not read. Null counts as empty: empty arrays. Texts
    are encoded whole, whatever their length (positions are 32-bit).
    """
    picked = docs.select(F.col(id), F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for whole in batches:
            for low in range(0, whole.num_rows, 512):      # few texts at a time: three arrays of each are held
                batch = whole.slice(low, 512)
                found = [encoder(raw) for raw in raw_texts(batch, "_text")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(_lists([f[k] for f in found], pa.int32()) for k in range(3))], [id, "ids", "starts", "ends"])

    return picked.mapInArrow(encode, f"{typed(picked, id)}, ids array<int>, starts array<int>, ends array<int>")


def decode_pieces(encoded: DataFrame, model: bytes, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """The same rows with the text that the library decodes from ``ids``; null and empty lists give an empty text."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        for batch in batches:
            yield pd.Series([library.decode([] if x is None else x.tolist()) for x in batch], dtype=object)

    return encoded.withColumn(name, decode(F.col(ids)))


def round_trip(docs: DataFrame, model: bytes, id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Digests of encoding and decoding every text.

    Columns ``id``, ``n_tokens``, ``ids_sha256`` (decimal ids joined by commas),
    ``decoded_sha256``, ``spans_tile`` (every byte of the text belongs to
    exactly one span, in order) and, with ``keep_ids``, ``ids``. Special cases
    as in :func:`encode_pieces`.
    """
    picked = docs.select(F.col(id), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    names = [id, "n_tokens", "ids_sha256", "decoded_sha256", "spans_tile"] + ["ids"] * keep_ids

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, library = Encoder(model), sentencepiece.SentencePieceProcessor(model_proto=model)
        decimal = list(map(str, range(library.get_piece_size())))
        for whole in batches:
            for low in range(0, whole.num_rows, 512):      # few texts at a time
                batch = whole.slice(low, 512)
                rows = []
                for raw in raw_texts(batch, "_text"):
                    ids, starts, ends = encoder(raw)
                    tile = starts[0] == 0 and ends[-1] == len(raw) and np.array_equal(starts[1:], ends[:-1]) if ids else not raw
                    rows.append((len(ids), hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest(),
                                 hashlib.sha256(library.decode(ids).encode()).hexdigest(), bool(tile), ids))
                *columns, listed = zip(*rows, strict=True)
                made = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *made, *([_lists(listed, pa.int32())] if keep_ids else [])], names)

    fields = ", n_tokens long, ids_sha256 string, decoded_sha256 string, spans_tile boolean" + ", ids array<int>" * keep_ids
    return picked.mapInArrow(digest, typed(picked, id) + fields)
