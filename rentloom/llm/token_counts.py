"""Token counts by byte-pair merging, without building identifiers."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentloom.llm.batches import Memo, raw_texts, typed
from rentloom.llm.pieces import BYTE, CONTROL, SPACE_MARK, UNKNOWN, Normalizer, PieceModel, SafeCuts


class MergeCounter:
    """Counts the pieces of a text: symbols at the start minus merges.

    The symbols of a word form a doubly linked list; a heap holds its adjacent
    pairs by rank, then by place. Popping the lowest pair merges it and offers
    the two new neighbours; pairs whose symbols have changed meanwhile are
    stale and skipped. Symbols that stay outside the vocabulary count as their
    bytes, or one unknown piece per run if the model has no byte pieces.
    """

    def __init__(self, model: bytes) -> None:
        parsed = PieceModel.parse(model)
        usable = [(piece, score) for piece, score, kind in parsed.pieces if kind not in (CONTROL, UNKNOWN, BYTE)]
        self.rank = {piece: -score for piece, score in usable}
        self.bytes_for_unknown = parsed.byte_fallback
        self.normalizer, self.cuts = Normalizer(parsed), SafeCuts(parsed)
        self.part_counts = Memo(self.merged)
        self.word_counts = Memo(self._word)

    def merged(self, part: str) -> int:
        """Pieces of a part that no cut divides."""
        rank, symbols = self.rank, list(part)
        n = len(symbols)
        heap = [(rank[p], i, p) for i in range(n - 1) if (p := symbols[i] + symbols[i + 1]) in rank]
        heapify(heap)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        merges = 0
        while heap:
            _, i, pair = heappop(heap)
            j = right[i]
            if j < 0 or not symbols[i] or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, ""
            merges += 1
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if (p := pair + symbols[k]) in rank:
                    heappush(heap, (rank[p], i, p))
            if (h := left[i]) >= 0 and (p := symbols[h] + pair) in rank:
                heappush(heap, (rank[p], h, p))
        unknown = [s for s in symbols if s and s not in rank]
        if not unknown:
            return n - merges
        if self.bytes_for_unknown:
            return n - merges + sum(len(s.encode()) - 1 for s in unknown)
        joined = sum(1 for i, s in enumerate(symbols) if s and s not in rank and left[i] >= 0 and symbols[left[i]] not in rank)
        return n - merges - joined

    def _word(self, word: str) -> int:
        if not self.bytes_for_unknown:
            return self.merged(word.replace(" ", SPACE_MARK))
        return sum(map(self.part_counts.__getitem__, self.cuts.parts(word)))

    def __call__(self, raw: bytes) -> int:
        text = self.normalizer.aligned(raw)[0].decode("utf-8", "replace")
        return sum(map(self.word_counts.__getitem__, self.cuts.words(text)))


def token_counts(docs: DataFrame, model: bytes, limit: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Bytes and tokens of every text: columns ``id``, ``n_bytes``, ``n_tokens``, ``over_limit``.

    ``model`` holds a compiled byte-pair piece model. One output row per input
    row, in one pass without a shuffle; repeated rows and tied ids give equal
    rows, an empty table gives none, other columns are not read. A null or
    empty text has no bytes and no tokens; a null id stays null. Texts of any
    length are counted whole; memory follows the longest part without a cut.
    """
    picked = docs.select(F.col(id), F.col(text).alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = MergeCounter(model)
        for batch in batches:
            raws = [raw or b"" for raw in raw_texts(batch, "_text")]
            sizes, tokens = [len(raw) for raw in raws], [counter(raw) for raw in raws]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], [id, "n_bytes", "n_tokens"])

    counted = picked.mapInArrow(count, f"{typed(picked, id)}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
