"""Ranked lexical search: a sharded inverted index and Block-Max MaxScore over it.

Documents are cut into shards. A shard keeps, for every term, its postings in
compressed blocks with what bounds their scores: the largest count and the
shortest document of each block. A query reads the lists of its terms only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rentloom.llm.batches import bounded, raw_texts, stored, typed

TOP = 10
SHARD_WORDS = 4_000_000      # a shard is closed after so many words
SHARD_DOCS = 1 << 16         # and holds no more documents
BLOCK = 128                  # postings of a block
QUERY_BYTES = 8 << 20        # query texts searched for in one pass over the index
_SPLIT = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b < 0x80 else b + 32 if 0x41 <= b <= 0x5A else b
               for b in range(256))


def terms_of(raw: bytes | None) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII; A-Z in lower case."""
    return raw.translate(_SPLIT).split() if raw else []


class Vocabulary(dict):
    """Numbers words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative integers in seven-bit groups, low ones first; (bytes, end of every value)."""
    sizes = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        sizes += values >= 1 << bits
    ends = np.cumsum(sizes)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    for i in range(5):
        more = sizes > i
        out[ends[more] - sizes[more] + i] = (values[more] >> (7 * i) & 127) | np.where(sizes[more] > i + 1, 128, 0)
    return out, ends


def unpack(packed: np.ndarray) -> np.ndarray:
    last = packed < 128
    if last.all():
        return packed.astype(np.int64)
    starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    at = np.arange(len(packed)) - np.repeat(starts, np.diff(np.append(starts, len(packed))))
    return np.add.reduceat((packed & 127).astype(np.int64) << (7 * at), starts)


class ShardBuilder:
    """Collects documents and writes them as one shard."""

    def __init__(self) -> None:
        self.vocabulary, self.codes, self.ids, self.words = Vocabulary(), [], [], 0

    def add(self, ids: pa.Array, raws: list[bytes | None]) -> None:
        self.ids.append(ids)
        for raw in raws:
            terms = terms_of(raw)
            self.codes.append(np.fromiter(map(self.vocabulary.__getitem__, terms), np.int64, len(terms)))
            self.words += len(terms)

    def full(self) -> bool:
        return self.words >= SHARD_WORDS or len(self.codes) >= SHARD_DOCS

    def rows(self, shard: int) -> pa.RecordBatch:
        """One row per term and, without a term, one row for the documents."""
        lengths = np.array([len(c) for c in self.codes], np.int64)
        keys = np.concatenate(self.codes) << 16 | np.repeat(np.arange(len(lengths)), lengths)
        keys, counts = np.unique(keys, return_counts=True)
        doc, term = keys & 0xFFFF, keys >> 16
        frequency = np.bincount(term, minlength=len(self.vocabulary)) if len(term) else np.zeros(0, np.int64)
        first = np.cumsum(frequency) - frequency                       # first posting of every term
        within = np.arange(len(doc)) - np.repeat(first, frequency)
        starts = np.flatnonzero(within % BLOCK == 0)
        stops = np.append(starts[1:], len(doc)).astype(np.int64)
        step = np.where(within % BLOCK == 0, doc, np.diff(doc, prepend=0))
        body, ends = pack(np.stack([step, counts], axis=1).ravel())
        posting_ends = ends[1::2]
        cuts = np.concatenate([[0], posting_ends[np.cumsum(frequency) - 1]]) if len(doc) else np.zeros(1, np.int64)
        blocks = -(-frequency // BLOCK)

        def lists(values: np.ndarray) -> pa.Array:
            """One list per term, and one without anything for the documents."""
            offsets = np.concatenate([[0], np.cumsum(blocks), [len(values)]])
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))

        block_ends = posting_ends[stops - 1] - np.repeat(cuts[:-1], blocks) if len(doc) else np.zeros(0, np.int64)
        n = len(self.vocabulary)
        ids = pa.concat_arrays(self.ids)
        spans = pa.array(np.append(cuts, cuts[-1]), pa.int32())
        return pa.RecordBatch.from_arrays([
            pa.array([shard] * (n + 1), pa.int64()), pa.array([*self.vocabulary, None], pa.binary()),
            pa.array(np.append(frequency, (lengths > 0).sum()), pa.int64()),
            lists(doc[stops - 1]), lists(np.maximum.reduceat(counts, starts) if len(doc) else counts),
            lists(np.minimum.reduceat(lengths[doc], starts) if len(doc) else counts), lists(block_ends),
            pa.Array.from_buffers(pa.binary(), n + 1, [None, spans.buffers()[1], pa.py_buffer(body.tobytes())]),
            pa.ListArray.from_arrays(pa.array([0] * (n + 1) + [len(ids)], pa.int32()), ids),
            pa.ListArray.from_arrays(pa.array([0] * (n + 1) + [len(lengths)], pa.int32()), pa.array(lengths, pa.int32())),
        ], ["shard", "term", "df", "last", "tf_max", "n_min", "ends", "body", "ids", "lengths"])


def build_index(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index of all texts, written to the shared folder.

    One row per shard and term: ``df`` and, per block of BLOCK postings, the
    last document, the largest count, the shortest document and the end of its
    bytes in ``body``. The row without a term has the shard's ``ids`` and
    ``lengths`` in words, ``df`` then counts the documents with a word. One pass
    over the texts, no shuffle; a task holds one shard at a time.
    """
    picked = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 32, ShardBuilder()
        for batch in bounded(batches, "_text", 4 << 20):
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                if shard.codes and (shard.full() or len(shard.codes) + part.num_rows > SHARD_DOCS):
                    yield shard.rows(number)
                    number, shard = number + 1, ShardBuilder()
                shard.add(part.column("_id"), raw_texts(part, "_text"))
        if shard.codes:
            yield shard.rows(number)

    kind = dict(picked.dtypes)["_id"]
    return stored(picked.mapInArrow(build, f"""shard long, term binary, df long, last array<int>, tf_max array<int>, n_min array<int>,
        ends array<int>, body binary, ids array<{kind}>, lengths array<int>"""), "index")


class PostingList:
    """The postings of one term in one shard; blocks are unpacked when they are first needed."""

    def __init__(self, weight: int, df: int, last: np.ndarray, bounds: np.ndarray, ends: np.ndarray, body: np.ndarray, norms: np.ndarray) -> None:
        self.weight, self.last, self.bounds, self.ends, self.body, self.norms = weight, last, bounds, ends, body, norms
        self.bound = int(bounds.max())
        sizes = np.full(len(last), BLOCK)
        sizes[-1] = df - BLOCK * (len(last) - 1)
        self.sizes, self.ready = sizes, np.zeros(len(last), bool)
        self.docs, self.scores = np.repeat(last, sizes), np.zeros(df, np.int64)     # sorted, unpacked or not

    def open(self, blocks: np.ndarray) -> None:
        blocks = blocks[~self.ready[blocks]]
        if not len(blocks):
            return
        self.ready[blocks] = True
        starts = np.where(blocks > 0, self.ends[blocks - 1], 0)
        if len(blocks) == len(self.last):
            packed = self.body
        else:
            packed = np.concatenate([self.body[a:b] for a, b in zip(starts.tolist(), self.ends[blocks].tolist(), strict=True)])
        values, sizes = unpack(packed), self.sizes[blocks]
        step, count = values[0::2], values[1::2]
        first = np.cumsum(sizes) - sizes
        total = np.cumsum(step)
        docs = total - np.repeat(total[first] - step[first], sizes)
        places = np.arange(len(docs)) + np.repeat(blocks * BLOCK - first, sizes)
        self.docs[places] = docs
        self.scores[places] = part_score(self.weight, count, self.norms[docs])

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        self.open(np.arange(len(self.last)))
        return self.docs, self.scores


def part_score(weight: int, count: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What a term adds to a score, in 64-bit integers; grows with its count and falls with the norm."""
    return weight * (1_000_000_000 * count // (1000 * count + 8 * norm))


class ShardSearcher:
    """Block-Max MaxScore over the lists of one shard."""

    def __init__(self, rows: pa.Table, weights: dict[bytes, int], docs: int, words: int) -> None:
        about = rows.filter(pc.is_null(rows["term"]))
        self.ids = about["ids"].combine_chunks().flatten()
        lengths = about["lengths"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.norms = 10 + 90 * lengths * docs // max(words, 1)
        self.order = np.empty(len(lengths), np.int64)
        self.order[pc.sort_indices(self.ids, null_placement="at_end").to_numpy()] = np.arange(len(lengths))
        self.lists, found = {}, rows.filter(pc.is_valid(rows["term"])).combine_chunks()
        if not found.num_rows:
            return
        arrays = {c: found[c].combine_chunks() for c in ("last", "tf_max", "n_min", "ends")}
        flat = {c: a.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c, a in arrays.items()}
        offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(arrays["last"]).to_numpy(zero_copy_only=False))]).tolist()
        norms = 10 + 90 * flat["n_min"] * docs // max(words, 1)
        for term, df, body, a, b in zip(found["term"].to_pylist(), found["df"].to_pylist(), found["body"].to_pylist(), offsets, offsets[1:]):
            weight = weights[term]
            bounds = part_score(weight, flat["tf_max"][a:b], norms[a:b])
            self.lists[term] = PostingList(weight, df, flat["last"][a:b], bounds, flat["ends"][a:b], np.frombuffer(body, np.uint8), self.norms)

    def top(self, terms: list[bytes], k: int = TOP) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the ``k`` best: score falling, ids rising.

        Lists come by falling bound. While what is left could alone reach the
        k-th best score, a list is essential and read whole. The documents
        found by then are the only candidates; in every further list the bound
        of their block decides whether the block is unpacked for them.
        """
        lists = sorted((self.lists[t] for t in terms if t in self.lists), key=lambda x: -x.bound)
        rest = [0]
        for x in reversed(lists):
            rest.append(rest[-1] + x.bound)
        rest.reverse()
        scores, least, i = np.zeros(len(self.norms), np.int64), 0, 0
        while i < len(lists) and rest[i] >= least:
            docs, parts = lists[i].all()
            scores[docs] += parts
            i += 1
            if len(scores) > k:
                least = int(np.partition(scores, -k)[-k])
        kept = np.flatnonzero((scores > 0) & (scores + rest[i] >= least))
        for j in range(i, len(lists)):
            x = lists[j]
            block = np.searchsorted(x.last, kept)
            bound = np.where(block < len(x.last), x.bounds[np.minimum(block, len(x.last) - 1)], 0)
            possible = scores[kept] + bound + rest[j + 1] >= least
            kept, block, bound = kept[possible], block[possible], bound[possible]
            wanted = bound > 0
            x.open(np.unique(block[wanted]))
            looked = kept[wanted]
            at = np.searchsorted(x.docs, looked)
            hit = x.docs[at] == looked
            scores[looked[hit]] += x.scores[at[hit]]
            if len(kept) > k:
                least = max(least, int(np.partition(scores[kept], -k)[-k]))
        best = kept[np.lexsort((self.order[kept], -scores[kept]))[:k]]
        return best, scores[best]


def _query_blocks(queries: DataFrame, id: str, text: str) -> Iterator[pa.Table]:
    """The queries in blocks of QUERY_BYTES or one query, each collected on its own."""
    rows = stored(queries.select(F.col(id).alias("_id"), F.col(text).alias("_text")).distinct(), "queries")
    size = F.octet_length("_text") + 64
    total, longest = rows.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    count = -(-total // QUERY_BYTES)
    while count > 1:                    # texts of one id stay together
        dealt = rows.withColumn("_b", F.pmod(F.xxhash64("_id"), F.lit(count)))
        widest = dealt.groupBy("_b").agg(F.sum(size).alias("n"), F.countDistinct("_id").alias("ids")).where("ids > 1").agg(F.max("n")).first()[0]
        if (widest or 0) <= 2 * QUERY_BYTES or count > total // 64:
            break
        count *= 2
    for b in range(count):
        yield rows.where(F.pmod(F.xxhash64("_id"), F.lit(count)) == b).orderBy("_id").toArrow()


def _terms_by_query(block: pa.Table) -> tuple[pa.Array, list[list[bytes]]]:
    """Different ids and the terms of all their texts, once each."""
    ids = block["_id"].combine_chunks()
    found: dict = {}
    for i, (key, raw) in enumerate(zip(ids.to_pylist(), block["_text"].cast(pa.large_binary()).to_pylist(), strict=True)):
        found.setdefault(key, (i, set()))[1].update(terms_of(raw))
    return ids.take(pa.array([i for i, _ in found.values()], pa.int64())), [sorted(terms) for _, terms in found.values()]


def _shard_best(shared, docs: int, words: int, k: int):
    """The best of one shard for every query of a block."""

    def best(rows: pa.Table) -> pa.Table:
        ids, wanted, weights = shared.value
        shard, which, places, scores = ShardSearcher(rows, weights, docs, words), [], [], []
        for number, terms in enumerate(wanted):
            place, score = shard.top(terms, k)
            real = score > 0
            which.append(np.full(int(real.sum()), number))
            places.append(place[real])
            scores.append(score[real])
        which, places, scores = map(np.concatenate, (which, places, scores))
        return pa.table([ids.take(pa.array(which)), shard.ids.take(pa.array(places)), pa.array(scores, pa.int64())], ["_query", "_id", "score"])

    return best


def search(index: DataFrame, queries: DataFrame, query_id: str = "item_id", text: str = "text", id: str = "doc_id", k: int = TOP) -> DataFrame:
    """The ``k`` best documents of every query: ``query_id``, ``rank``, ``id``, ``score``.

    The weights need the documents and words of all shards and how many
    documents hold a term: sums over the index. Queries are worked through in
    blocks; of the index only the lists of a block's terms are shuffled, by
    shard, and every shard is searched on its own. The shards' best are merged
    by a rank that is cut before its shuffle as well.
    """
    spark = index.sparkSession
    kinds = {query_id: dict(queries.dtypes)[query_id], id: dict(index.dtypes)["ids"][6:-1]}
    docs, words, shards = index.where("term IS NULL").agg(
        F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)),
        F.count(F.lit(1))).first()
    schema = f"`_query` {kinds[query_id]}, `_id` {kinds[id]}, score long"
    found = []
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for block in _query_blocks(queries, query_id, text) if docs else ():
        ids, wanted = _terms_by_query(block)
        terms = sorted({t for ts in wanted for t in ts})
        if not terms:
            continue
        listed = spark.createDataFrame(pa.table({"term": pa.array([*terms, None], pa.binary())}))   # bounded by QUERY_BYTES
        held = F.broadcast(listed.withColumnRenamed("term", "_term"))
        counts = index.select("term", "df").where("term IS NOT NULL").join(held, F.col("term") == F.col("_term"), "left_semi").groupBy("term").agg(F.sum("df"))
        weights = {bytes(t): math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1))) for t, df in counts.collect()}
        shared = spark.sparkContext.broadcast((ids, wanted, weights))

        lists = index.join(held, F.col("term").eqNullSafe(F.col("_term")), "left_semi")
        parts = min(shards, max(usual, shards // 8))
        found.append(lists.repartition(parts, "shard").groupBy("shard").applyInArrow(_shard_best(shared, docs, words, k), schema))
    if not found:
        return spark.createDataFrame([], f"`{query_id}` {kinds[query_id]}, rank int, `{id}` {kinds[id]}, score long")
    merged = found[0]
    for more in found[1:]:
        merged = merged.unionByName(more)
    order = Window.partitionBy("_query").orderBy(F.col("score").desc(), F.col("_id").asc_nulls_last())
    ranked = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("_query").alias(query_id), "rank", F.col("_id").alias(id), "score")


def ranked_search(docs: DataFrame, queries: DataFrame, id: str = "doc_id", text: str = "text", query_id: str = "item_id", query_text: str = "text",
                  k: int = TOP) -> DataFrame:
    """Index ``docs``, then search it: ``query_id``, ``rank`` (from 1), ``id``, ``score`` of the ``k`` best with a score above 0.

    Equal scores rank by rising id, null ids last; repeated rows are documents
    of their own and rank one after the other. All texts of one query id are
    one query, each term counts once; a null query id is a query like others.
    Null and empty texts and texts without terms are found by nothing and find
    nothing; empty tables give no rows. Only the named columns are read.
    """
    return search(build_index(docs, id, text), queries, query_id, query_text, id, k)
