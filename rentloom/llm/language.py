"""Language of texts by fusing what the letters say with what markup, address and host say."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentloom.llm.batches import batches_of, bounded, row_key, stored, typed
from rentloom.llm.hashing import mix

BUCKETS = 1 << 15          # hashed letter triples of the model: its size has this bound per language
BLOCK = 128                # languages of a block of the model: the driver and a task hold one block at a time
SLICE_BYTES = 4 << 20         # text scored at a time in a task
EFFECTIVE = 60             # triples overlap; a text counts as at most so many independent ones
SMOOTHING = 20.0           # weight of the wider unit in the prior of a host, a site and an address suffix
SURE = 0.5                 # least posterior of an accepted text
SEEN = 0.5                 # least share of triples that stand in labelled texts of the language
STRANGE = 4.0              # log likelihood per triple below the usual text of its language at which a text is rejected


def triples(text: str) -> np.ndarray:
    """Bucket of every letter triple; letters are lower-case, everything else is one gap between words."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = (points >= 0xC0) | ((points >= 97) & (points <= 122))
    points = np.where(letter, points, 0).astype(np.uint64)
    points = points[np.concatenate([[True], letter[1:] | letter[:-1]])] if len(points) else points
    if len(points) < 3:
        return np.zeros(0, np.int64)
    joined = (points[:-2] << np.uint64(42)) | (points[1:-1] << np.uint64(21)) | points[2:]
    return (mix(joined[points[1:-1] != 0]) % np.uint64(BUCKETS)).astype(np.int64)


def letter_counts(docs: DataFrame, text: str, label: str) -> DataFrame:
    """(label, bucket, n) over all labelled rows: counted per task, then summed by an aggregate."""
    labelled = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(label).cast("string").alias("label"), F.col(text).alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, table in tables.items():
                at = np.flatnonzero(table)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(table[at])],
                                                 ["label", "bucket", "n"])
            tables.clear()

        for batch in bounded(batches, "_text", SLICE_BYTES):
            for name, body in zip(batch.column("label").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                if name not in tables:
                    if len(tables) >= BLOCK:
                        yield from flush()
                    tables[name] = np.zeros(BUCKETS, np.int64)
                table = tables[name]
                found = triples(body)
                if len(found) > BUCKETS:
                    table += np.bincount(found, minlength=BUCKETS)
                else:
                    np.add.at(table, found, 1)
            yield from flush()

    return labelled.mapInArrow(count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))


def fit_letters(docs: DataFrame, text: str = "text", label: str = "lang") -> tuple[list[str], Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Every label of the labelled rows, and the model in blocks of at most BLOCK languages.

    A block is the log probability of every bucket by language, and that of a
    bucket that no labelled text of the language has.
    """
    labels = docs.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label")).distinct()
    names = sorted(r["label"] for r in labels.collect())
    counts = letter_counts(docs, text, label)
    if len(names) > BLOCK:
        counts = stored(counts, "letters", batch_bytes=SLICE_BYTES)

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for start in range(0, len(names), BLOCK):
            part = names[start:start + BLOCK]
            number = {name: i for i, name in enumerate(part)}
            with batches_of(docs.sparkSession, SLICE_BYTES):
                found = (counts if len(names) <= BLOCK else counts.where(F.col("label").between(part[0], part[-1]))).toPandas()
            table = np.full((BUCKETS, len(part)), 0.5)
            table[found["bucket"].to_numpy(), found["label"].map(number).to_numpy(np.int64)] += found["n"].to_numpy()
            total = table.sum(axis=0)
            yield np.log(table / total), np.log(0.5 / total)

    return names, blocks()


def _scores(start: int, model) -> object:
    """Tempered log likelihoods, the best language, its mean score, the share of triples seen with it and the number of triples of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, unseen = model.value
        for batch in bounded(batches, "_text", SLICE_BYTES):
            likely, best, mean, seen, size = [], [], [], [], []
            for body in batch.column("_text").to_pylist():
                found = triples(body) if body else np.zeros(0, np.int64)
                total = table[found].sum(axis=0) if len(found) else np.zeros(len(unseen))
                size.append(len(found))
                likely.append((total * min(1.0, EFFECTIVE / max(len(found), 1))).tolist())
                top = int(total.argmax()) if len(found) and len(unseen) else None
                best.append(None if top is None else start + top)
                mean.append(None if top is None else float(total[top]) / len(found))
                seen.append(None if top is None else float((table[found, top] > unseen[top]).mean()))
            others = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*others, pa.array(likely, pa.list_(pa.float64())), pa.array(best, pa.int32()), pa.array(mean, pa.float64()),
                 pa.array(seen, pa.float64()), pa.array(size, pa.int64())],
                [*batch.schema.names[:-1], "likely", "best", "mean", "seen", "triples"])
    return run


def _scored(picked: DataFrame, names: list[str], blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Scores of every row under all languages, stored: one pass over the texts per block, put together by row key."""
    spark = picked.sparkSession
    result = "likely array<double>, best int, mean double, seen double, triples long"
    scored = None
    for start, block in zip(range(0, max(len(names), 1), BLOCK), blocks if names else [(np.zeros((BUCKETS, 0)), np.zeros(0))], strict=True):
        model = spark.sparkContext.broadcast(block)
        if scored is None:
            schema = f"{typed(picked, '_id')}, _k1 long, _k2 long, declared string, host string, site string, suffix string, {result}"
            scored = stored(picked.mapInArrow(_scores(start, model), schema), "scores", batch_bytes=SLICE_BYTES)
            continue
        more = picked.select("_k1", "_k2", "_text").mapInArrow(_scores(start, model), f"_k1 long, _k2 long, {result}").dropDuplicates(["_k1", "_k2"])
        more = more.select("_k1", "_k2", *[F.col(c).alias(f"{c}_2") for c in ("likely", "best", "mean", "seen")])
        better = F.col("mean_2") > F.col("mean")
        scored = stored(scored.join(more, ["_k1", "_k2"]).withColumns({
            "likely": F.concat("likely", "likely_2"), **{c: F.when(better, F.col(f"{c}_2")).otherwise(F.col(c)) for c in ("best", "mean", "seen")},
        }).select(*scored.columns), "scores", batch_bytes=SLICE_BYTES)
    return scored


def _shares(scored: DataFrame, unit: list[str], wider: DataFrame | None, languages: int) -> DataFrame:
    """Shares of the languages as an array per unit, smoothed towards the wider unit the unit lies in.

    Without a ``unit`` it is one row for the whole table; a table of one row is read as a value.
    """
    counts = scored.where("best IS NOT NULL").groupBy(*unit, "best").count()
    per_unit = counts.groupBy(*unit).agg(F.sum("count").alias("total"), F.map_from_entries(F.collect_list(F.struct("best", "count"))).alias("by"))
    numbers = F.sequence(F.lit(0), F.lit(languages - 1))
    if wider is None:
        prior = F.transform(numbers, lambda i: F.lit(1.0 / languages))
    elif unit[:-1]:
        per_unit, prior = per_unit.join(wider, unit[:-1]), F.col("wide")
    else:
        per_unit = per_unit.withColumn("wide", wider.select("wide").scalar())
        prior = F.col("wide")
    share = F.transform(numbers, lambda i: (F.coalesce(F.try_element_at("by", i), F.lit(0)) + SMOOTHING * F.get(prior, i)) / (F.col("total") + SMOOTHING))
    return per_unit.select(*unit, share.alias("wide"))


def identify(docs: DataFrame, id: str = "doc_id", text: str = "text", label: str = "lang", declared: Column | None = None,
             host: Column | None = None, suffix: Column | None = None, train: DataFrame | None = None) -> DataFrame:
    """Language of every row by Bayes' rule: ``id``, ``language``, ``confidence``, ``triples``, ``accepted`` and the row key.

    Evidence: letters of the text (hashed triples counted over all labelled
    rows of ``train``, else of ``docs``), the language the markup declares, and
    the share of languages on the host, smoothed towards its site (the last two
    labels of the host name), the address suffix and the whole table. How far a
    declaration can be trusted, and all shares, are grouped aggregates over all
    rows. Unknown declarations, hosts and suffixes are units of their own.

    Every label is a language, however rare; the driver holds the list of them
    and one block of the model. More than BLOCK languages cost a pass over the
    texts for each further block.

    A text is accepted if its language has a posterior of at least SURE, it
    scores no more than STRANGE per triple below the usual text of the language
    its letters fit best, as texts in no known language do, and at least SEEN
    of its triples stand in labelled texts of that language, which keeps
    strange texts out of languages with few texts. Null and empty texts and texts without letters are not
    accepted and have no language; neither has any text if there is no label.
    Equal rows get equal results, tied and null ids are rows of their own, an
    empty table gives no rows; columns are read under names of their own, so
    any extra columns may be there. Only narrow rows are shuffled.
    """
    names, blocks = fit_letters(docs, text, label) if train is None else fit_letters(train)
    blank = F.lit("")
    declared, host = F.col(label).cast("string") if declared is None else declared, F.col("source").cast("string") if host is None else host
    picked = docs.select(F.col(id).alias("_id"), *row_key(id, text), F.coalesce(declared, blank).alias("declared"),
                         F.coalesce(host, blank).alias("host"), F.coalesce(blank if suffix is None else suffix, blank).alias("suffix"),
                         F.col(text).alias("_text"))
    picked = picked.select("_id", "_k1", "_k2", "declared", "host", F.substring_index("host", ".", -2).alias("site"), "suffix", "_text")
    scored = _scored(picked, names, blocks)
    if not names:
        return scored.select(F.col("_id").alias(id), "_k1", "_k2", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"), "triples",
                             F.lit(False).alias("accepted"))
    n = len(names)
    everywhere = _shares(scored, [], None, n)
    by_suffix = _shares(scored, ["suffix"], everywhere, n)
    by_site = _shares(scored, ["suffix", "site"], by_suffix, n)
    by_host = _shares(scored, ["suffix", "site", "host"], by_site, n)
    said = scored.where("best IS NOT NULL").groupBy("best", "declared").count()
    kinds = said.select("declared").distinct().count() + 1
    per_best = said.groupBy("best").agg(F.sum("count").alias("total"))
    trust = said.join(per_best, "best").groupBy("declared").agg(F.map_from_entries(F.collect_list(F.struct(
        "best", ((F.col("count") + 1) / (F.col("total") + kinds)).alias("p")))).alias("trust"))
    usual = scored.where("best IS NOT NULL").groupBy("best").agg(F.avg("mean").alias("usual"))
    joined = (scored.join(by_host, ["suffix", "site", "host"], "left").join(trust, "declared", "left").join(F.broadcast(usual), "best", "left"))
    log_posterior = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (
        F.get("likely", i) + F.log(F.coalesce(F.get("wide", i), F.lit(1.0 / n)))
        + F.log(F.coalesce(F.try_element_at("trust", i), F.lit(1.0 / (kinds + 1))))))
    top = F.array_max("lp")
    posterior = joined.withColumn("lp", log_posterior).withColumn(
        "confidence", 1 / F.aggregate("lp", F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))
    known = F.col("triples") > 0
    language = F.get(F.array(*map(F.lit, names)), F.array_position("lp", top).cast("int") - 1)
    strange = F.coalesce((F.col("mean") < F.col("usual") - STRANGE) | (F.col("seen") < SEEN), F.lit(False))
    return posterior.select(F.col("_id").alias(id), "_k1", "_k2", F.when(known, language).alias("language"), F.when(known, F.col("confidence")).otherwise(0.0).alias("confidence"),
                            "triples", (known & (F.col("confidence") >= SURE) & ~strange).alias("accepted"))


def page_evidence(url: str = "url", page: str = "html") -> dict[str, Column]:
    """Host, address suffix and declared language of web pages, as arguments of :func:`identify`."""
    host = F.regexp_extract(F.lower(F.col(url)), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    declared = F.lower(F.regexp_extract(F.col(page), r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1))
    return {"host": host, "suffix": F.substring_index(host, ".", -1), "declared": declared}
