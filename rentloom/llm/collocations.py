"""Phrases whose words stand together more often than chance, per language.

Counts come from suffixes: every place of a text points to the words that
follow it. Words, pairs and triples that are too rare end a suffix. The suffixes
are routed by their leading words, and each task sorts its own with a multikey
three-way quicksort, where the sizes of the equal parts are the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rentloom.llm.batches import bounded, raw_texts, stored
from rentloom.llm.hashing import BASES, mix
from rentloom.operators.scale import skew_join

LONGEST = 5                 # words of a phrase
LEAST = 100                 # occurrences of a candidate
FIRST = 2000                # phrases returned per language
FILTER_BITS = 26            # a filter has 2**26 bits, 8 MB, whatever the corpus
BUCKET_ROWS = 250_000       # suffixes sorted by one task at a time
SLICE_BYTES = 8 << 20       # text handled at a time in a task
HELD_ROWS = 500_000         # different suffixes a task holds before it gives them out
TASKS_PER_CORE = 2          # of the suffix pass, however many splits the texts have
_STOP = b"."
_CUT = bytes(0x2E if b in b".,;:!?\x0a\x0b\x0c\x0d" else 0x20 if b == 9 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]


class Numbers(dict):
    """Numbers words in the order of their first use; 0 is the end of a piece."""

    def __init__(self) -> None:
        super().__init__({_STOP: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Slice:
    """The words of some texts as numbers, 0 between pieces and between texts, and the language of every place."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        numbers, runs, langs = Numbers(), [], batch.column("_lang").to_pylist()
        self.langs = sorted(set(langs))
        of_lang = {k: i for i, k in enumerate(self.langs)}
        for raw in raw_texts(batch, "_text"):
            words = (raw or b"").translate(_CUT).replace(_STOP, b" . ").split()
            words.append(_STOP)
            runs.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        self.words = list(numbers)
        self.codes = np.concatenate(runs) if runs else np.zeros(0, np.int64)
        self.lang = np.repeat([of_lang[k] for k in langs], [len(r) for r in runs]).astype(np.int64)

    def word_hashes(self) -> np.ndarray:
        """Hash of every place's word and language."""
        plain = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        langs = mix(np.fromiter((xxhash.xxh3_64_intdigest(k.encode()) for k in self.langs), np.uint64, len(self.langs)))
        return mix(plain[self.codes] ^ langs[self.lang])


def joined_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(BASES[0]) + second * np.uint64(BASES[1]))


class Filter:
    """A set of hashes as a bitmap of fixed size: never misses a member, may take others for one."""

    def __init__(self, at: np.ndarray, bits: np.ndarray) -> None:
        self.bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
        self.bits[at] = bits

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        slots = hashes & np.uint64((1 << FILTER_BITS) - 1)
        return (self.bits[slots >> np.uint64(6)] >> (slots & np.uint64(63)) & np.uint64(1)).astype(bool)

    @classmethod
    def of(cls, hashes: DataFrame) -> Filter:
        """From a column ``h``; the driver gets at most 2**FILTER_BITS bits."""
        slot = F.col("h").cast("long").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
        bits = hashes.select(F.shiftright(slot, 6).alias("at"), slot.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
        words = bits.groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
        return cls(words["at"].to_numpy(), words["bits"].to_numpy().view(np.uint64))


class Frequent:
    """Which words, pairs and triples of a slice can be frequent, as far as their filters are known."""

    def __init__(self, part: Slice, filters: list[Filter]) -> None:
        hashes = [part.word_hashes()]
        there = [part.codes > 0]
        for size in range(1, 4):
            if size > 1:
                shorter = there[-1]
                both = shorter[:-1] & shorter[1:]
                value = np.zeros(len(both), np.uint64)
                value[both] = joined_hash(hashes[-1][:-1][both], hashes[0][size - 1:][both])
                hashes.append(value)
                there.append(both)
            if size > len(filters):
                break
            there[-1][there[-1]] = filters[size - 1](hashes[-1][there[-1]])
        self.hashes, self.there = hashes, there


def _count_hashes(filters: list):
    """Hashes of the words, pairs or triples whose parts can all be frequent, with their counts.

    32 bits of them will do: they only choose what the next pass looks at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [f.value for f in filters]
        for batch in bounded(batches, "_text", SLICE_BYTES):
            frequent = Frequent(Slice(batch), known)
            hashes, counts = np.unique(frequent.hashes[-1][frequent.there[-1]].astype(np.uint32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int32)), pa.array(counts, pa.int64())], ["h", "f"])

    return run


def _same_added(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every different row once, with the sum of its counts."""
    order = np.lexsort(rows.T[::-1])
    rows, counts = rows[order], counts[order]
    new = np.append(True, (rows[1:] != rows[:-1]).any(axis=1)) if len(rows) else np.zeros(0, bool)
    return rows[new], np.add.reduceat(counts, np.flatnonzero(new)) if len(rows) else counts


class Held:
    """Suffixes of the slices a task has read since it last gave them out: equal ones are one row.

    Words and languages are numbered for all these slices; -1 is no word. As
    every word of a suffix starts one, there are no more words than rows.
    Rows are added up once there are twice as many as after the last time.
    """

    def __init__(self) -> None:
        self.words, self.langs = {}, {}
        self.rows, self.counts, self.fresh = np.zeros((0, LONGEST + 1), np.int32), np.zeros(0, np.int64), []

    def __len__(self) -> int:
        return len(self.rows) + sum(len(rows) for rows, _ in self.fresh)

    def add(self, part: Slice, rows: np.ndarray, counts: np.ndarray) -> None:
        """Rows of a slice: the number of the language, then of each word, ``len(part.words)`` for none."""
        number = np.full(len(part.words) + 1, -1, np.int32)
        for code in np.unique(rows[:, 1:]).tolist():
            if code < len(part.words):
                number[code] = self.words.setdefault(part.words[code], len(self.words))
        langs = np.array([self.langs.setdefault(k, len(self.langs)) for k in part.langs], np.int32)
        self.fresh.append((np.column_stack([langs[rows[:, 0]], number[rows[:, 1:]]]), counts))
        if len(self) > 2 * len(self.rows):
            self.merge()

    def merge(self) -> None:
        self.rows, self.counts = _same_added(*map(np.concatenate, zip((self.rows, self.counts), *self.fresh, strict=True)))
        self.fresh = []

    def batch(self) -> pa.RecordBatch:
        self.merge()
        words, langs = pa.array(list(self.words), pa.binary()), pa.array(list(self.langs), pa.string())
        columns = (pa.array(self.rows[:, i], mask=self.rows[:, i] < 0) for i in range(1, LONGEST + 1))
        return pa.RecordBatch.from_arrays([langs.take(pa.array(self.rows[:, 0])), *(words.take(c) for c in columns), pa.array(self.counts)], ["lang", *_WORDS, "c"])


def _add_suffixes(held: Held, batch: pa.RecordBatch, known: list[Filter]) -> None:
    """The suffixes of a slice, and its words per language; none of its arrays outlives the call."""
    s = Slice(batch)
    word, pair, triple = (np.append(x, np.zeros(LONGEST, bool)) for x in Frequent(s, known).there)
    start = np.flatnonzero(word)
    rows, going = np.full((len(start), LONGEST + 1), len(s.words), np.int32), np.ones(len(start), bool)
    rows[:, 0], rows[:, 1] = s.lang[start], s.codes[start]
    for i in range(1, LONGEST):
        going = going & (pair[start] if i == 1 else triple[start + i - 2])
        rows[going, i + 1] = s.codes[start[going] + i]
    rows, counts = _same_added(rows, np.ones(len(rows), np.int64))
    totals = np.bincount(s.lang[s.codes > 0], minlength=len(s.langs))
    no_words = np.full((len(totals), LONGEST + 1), len(s.words), np.int32)
    no_words[:, 0] = np.arange(len(totals))
    held.add(s, np.concatenate([rows, no_words]), np.append(counts, totals))


def _suffixes(filters: list, held_rows: int = HELD_ROWS):
    """Different suffixes of frequent words, each a row of up to LONGEST words, with their counts; without words, all words of a language.

    A suffix ends before the word that makes a pair or a triple rare. A task
    gives out its suffixes at its end, or when more than ``held_rows`` are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = [f.value for f in filters], Held()
        for batch in bounded(batches, "_text", SLICE_BYTES // 2):
            _add_suffixes(held, batch, known)
            if len(held) > held_rows:
                held.merge()
            if len(held) > held_rows:
                yield held.batch()
                held = Held()
        if len(held):
            yield held.batch()

    return run


def frequent_prefixes(columns: list[np.ndarray], weight: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Multikey three-way quicksort of rows by their columns: (a row, columns that agree, weight) of every prefix with at least ``least``.

    Every part has agreed on the columns so far; it is split by a pivot of the
    next one. The weight of the equal part is the count of a prefix, and it goes
    on with the next column; smaller and greater ones with the same. Parts
    lighter than ``least`` are abandoned: nothing in them is frequent. -1 ends a
    row.
    """
    waiting = [(np.arange(len(weight)), 0)]
    while waiting:
        rows, depth = waiting.pop()
        column = columns[depth][rows]
        pivot = np.partition(column, len(column) // 2)[len(column) // 2]
        for part in (rows[column < pivot], rows[column > pivot]):
            if weight[part].sum() >= least:
                waiting.append((part, depth))
        equal = rows[column == pivot]
        total = int(weight[equal].sum())
        if pivot < 0 or total < least:
            continue
        yield int(equal[0]), depth + 1, total
        if depth + 1 < len(columns):
            waiting.append((equal, depth + 1))


def _sorted_bucket(least: int):
    def run(table: pa.Table) -> pa.Table:
        """Counts of the prefixes of one bucket; those at least as long as their route are whole."""
        names = {w: table[w].to_pylist() for w in _WORDS}
        langs, routes, found = table["lang"].to_pylist(), table["route"].to_pylist(), []
        numbers: dict = {}
        words = [np.fromiter((-1 if x is None else numbers.setdefault(x, len(numbers)) for x in names[w]), np.int64, table.num_rows) for w in _WORDS]
        weight, route = table["c"].to_numpy().astype(np.int64), np.array(routes, np.int64)
        for length in np.unique(route).tolist():
            at = np.flatnonzero(route == length)
            leads: dict = {}
            lead = np.fromiter((leads.setdefault((langs[i], *(names[w][i] for w in _WORDS[:length])), len(leads)) for i in at.tolist()), np.int64, len(at))
            for row, depth, total in frequent_prefixes([lead, *(c[at] for c in words[length:])], weight[at], least):
                i = int(at[row])
                found.append((langs[i], b" ".join(names[w][i] for w in _WORDS[:length + depth - 1]), length + depth - 1, total))
        columns = list(zip(*found, strict=True)) or [()] * 4
        kinds = (pa.string(), pa.binary(), pa.int32(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "phrase", "words", "f"])

    return run


def _routed(suffixes: DataFrame, least: int, bucket_rows: int) -> tuple[DataFrame, list[DataFrame]]:
    """Suffixes with ``route``, the number of words they are dealt by, and the counts of leads too large for one bucket.

    Suffixes go by their first two words; those of a lead with more than
    ``bucket_rows`` different suffixes by one word more, and so on. Such leads
    are counted by an aggregate over their suffixes instead.
    """
    dealt, counted, left = [], [], suffixes
    for length in range(2, LONGEST):
        lead = ["lang", *_WORDS[:length]]
        sizes = left.groupBy(*lead).agg(F.count(F.lit(1)).alias("rows"), F.sum("c").alias("f"))
        large = stored(sizes.where(F.col("rows") > bucket_rows), "leads")
        if large.isEmpty():
            return _union([*dealt, left.withColumn("route", F.lit(length))]), counted
        counted.append(large.where(F.col("f") >= least).select("lang", F.concat_ws(" ", *[F.col(w).cast("string") for w in lead[1:]]).cast("binary").alias("phrase"),
                                                              F.lit(length).alias("words"), "f"))
        dealt.append(left.join(large.select(*lead), lead, "left_anti").withColumn("route", F.lit(length)))
        left = stored(left.join(large.select(*lead), lead, "left_semi").where(F.col(_WORDS[length]).isNotNull()), "suffixes")
    return _union([*dealt, left.withColumn("route", F.lit(LONGEST))]), counted


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Phrases of 1 to LONGEST words with at least ``least`` occurrences: ``lang``, ``phrase``, ``words``, ``f``, and ``n`` words of the language.

    Occurrences are counted within pieces, overlaps included. Three passes over
    the texts find which words, pairs and triples can be frequent, by counting
    hashes; that reaches the tasks of the next pass as a bitmap of fixed size.
    A hash that two share lets a rare one pass, which the counts, over the words
    themselves, then drop. The fourth pass makes the suffixes. All counts
    combine before their shuffles, so a text that stands in a third of all rows
    is a few rows per task.
    """
    spark = docs.sparkSession
    picked = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("_lang"), F.col(text).alias("_text"))
    filters: list = []
    for _ in ("words", "pairs", "triples"):
        counts = picked.mapInArrow(_count_hashes(list(filters)), "h int, f long").groupBy("h").agg(F.sum("f").alias("f"))
        filters.append(spark.sparkContext.broadcast(Filter.of(counts.where(F.col("f") >= least))))
    wide = picked.coalesce(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    suffixes = wide.mapInArrow(_suffixes(filters), f"lang string, {', '.join(f'{w} binary' for w in _WORDS)}, c long")
    suffixes = stored(suffixes.groupBy("lang", *_WORDS).agg(F.sum("c").alias("c")), "suffixes")
    total = suffixes.where("w1 IS NULL").select("lang", F.col("c").alias("n"))
    words = suffixes.where("w1 IS NOT NULL").groupBy("lang", F.col("w1").alias("phrase")).agg(F.sum("c").alias("f")).where(F.col("f") >= least)
    pointers = suffixes.where("w2 IS NOT NULL")
    routed, counted = _routed(pointers, least, bucket_rows)
    buckets = -(-pointers.count() // bucket_rows) or 1
    lead: Column = F.xxhash64("lang", *[F.when(F.col("route") >= i, F.col(w)) for i, w in enumerate(_WORDS, 1)])
    dealt = routed.withColumn("bucket", F.pmod(lead, F.lit(buckets))).repartition(buckets, "bucket").groupBy("bucket")
    sorted_ = dealt.applyInArrow(_sorted_bucket(least), "lang string, phrase binary, words int, f long")
    found = _union([words.select("lang", "phrase", F.lit(1).alias("words"), "f"), sorted_, *counted])
    found = found.select("lang", F.col("phrase").cast("string").alias("phrase"), "words", "f")
    return stored(skew_join(found, total, ["lang"], "inner").select("lang", "phrase", "words", "f", "n"), "phrases")


def _part(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, first: int = FIRST,
                 bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The ``first`` phrases of every language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A candidate is a phrase of 2 to LONGEST words with a count ``a`` of at least
    ``least``. Every cut into a first part (count l) and a rest (count r) scores
    floor(1000 a n / (l r)), in decimals of 38 digits; the lowest score counts,
    of equal ones that of the shortest first part. A candidate inside a longer one
    with the same count is dropped. Ranked by score, then ``a``, both falling,
    then by the bytes of the phrase. Null texts are empty, a null language is
    ``und``; every repeated row counts; without candidates there are no rows.
    Only the two named columns are read.
    """
    counts = phrase_counts(docs, text, lang, least, bucket_rows)
    candidates = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), "n", F.split("phrase", " ").alias("_w"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "n", "k", _part(F.col("_w"), F.lit(1), F.col("k")).alias("_first"),
                       _part(F.col("_w"), F.col("k") + 1, F.col("words") - F.col("k")).alias("_rest"))
    firsts, rests = (counts.select("lang", F.col("phrase").alias(p), F.col("f").alias(c)) for p, c in (("_first", "l"), ("_rest", "r")))
    cuts = cuts.join(firsts, ["lang", "_first"]).join(rests, ["lang", "_rest"])
    score = F.expr("(CAST(1000 * CAST(a AS DECIMAL(16,0)) AS DECIMAL(20,0)) * CAST(n AS DECIMAL(18,0))) DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    lowest = cuts.select("lang", "phrase", F.struct(score.alias("score"), "k", "l", "r", "a", "n").alias("cut"))
    lowest = lowest.groupBy("lang", "phrase").agg(F.min("cut").alias("cut"))
    inside = candidates.where("words > 2").withColumn("_at", F.explode(F.expr(
        f"filter(flatten(transform(sequence(1, words - 1), i -> transform(sequence(2, {LONGEST - 1}), j -> named_struct('i', i, 'j', j)))), "
        "x -> x.j < words AND x.i + x.j - 1 <= words)")))
    inside = inside.select("lang", _part(F.col("_w"), F.col("_at.i"), F.col("_at.j")).alias("phrase"), "a")
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(inside, ["lang", "phrase"], "left").where("longer IS NULL OR longer < cut.a")
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("cut.a").desc(), F.col("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")
