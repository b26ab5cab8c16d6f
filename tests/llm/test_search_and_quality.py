"""Quality by compression, ranked search and collocations."""

import math
import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rentloom.llm import collocations as collocation_module
from rentloom.llm import ranked_search as search_module
from rentloom.llm.collocations import Filter, _suffixes, collocations, frequent_prefixes
from rentloom.llm.compressed_quality import Calibration, Sizes, build_dictionary, classify_quality, fit_quality, quality_scores
from rentloom.llm.ranked_search import ShardSearcher, build_index, pack, ranked_search, search, terms_of, unpack

LABELS = "doc_id long, quality int, score double, text string"


def sentences(rng, n):
    return " ".join(rng.choices("the river runs past old stone houses and under a bridge where boats wait".split(), k=n)) + "."


def junk(rng, n):
    return " ".join("".join(rng.choices("#%$&*@", k=3)) + rng.choice("xyz") for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark, docs_of):
    rng = random.Random(1)
    rows = [(i, (sentences if i % 3 else junk)(rng, rng.randint(20, 300))) for i in range(600)]
    labels = [(i, int(i % 3 > 0), 0.5, "x") for i in range(500)] + [(7, 1, 0.1, "x"), (None, 1, 0.1, "x"), (9999, 0, 0.1, "x"), (8, None, 0.1, "x"), (11, 5, 0., "x")]
    return docs_of(rows), spark.createDataFrame(labels, LABELS)


def test_quality_of_held_out_texts(labelled):
    docs, labels = labelled
    got = classify_quality(docs, labels).collect()
    assert len(got) == 600 and {r.held_out for r in got} == {True, False}
    assert all(r.predicted == int(r.doc_id % 3 > 0) == int(r.score >= 0.7) for r in got)


def test_held_out_labels_are_not_learnt(labelled):
    docs, labels = labelled
    from rentloom.llm.compressed_quality import held_out
    turned = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = fit_quality(docs, labels), fit_quality(docs, turned)
    assert (a.good, a.bad) == (b.good, b.bad) and np.array_equal(a.calibration.weights, b.calibration.weights)


def test_scores_equal_the_model_text_by_text(labelled, docs_of, odd_texts):
    model = fit_quality(*labelled)
    got = quality_scores(docs_of(odd_texts), model).collect()
    want = [model.score([t and t.encode()])[0] for _, t in odd_texts]
    assert sorted((r.doc_id or -1, r.score) for r in got) == sorted((i or -1, s) for (i, _), s in zip(odd_texts, want, strict=True))
    assert want[0] == want[1] == model.calibration.prior
    assert quality_scores(docs_of([]), model).collect() == []


def test_quality_without_labels(spark, docs_of):
    none = spark.createDataFrame([], LABELS)
    assert [(r.score, r.predicted) for r in classify_quality(docs_of([(1, "a"), (2, None)]), none).collect()] == [(0.5, 0)] * 2
    assert classify_quality(docs_of([]), none).collect() == []
    one = spark.createDataFrame([(1, 1, 0., "x")], LABELS)
    assert [r.score for r in classify_quality(docs_of([(1, "a"), (1, "b")]), one).collect()] != []


def test_dictionaries_of_few_samples():
    assert build_dictionary([]) == b"" and build_dictionary([b"ab"]) == b"ab"
    assert Sizes(b"ab", b"")(b"") == (0, 0, 0, 0)
    assert Calibration.fit(np.zeros((0, 4), np.int64), np.zeros(0), (0, 2)).prior == 0.75


def test_calibration_stands_for_all_labels():
    rng = np.random.default_rng(3)
    sizes = np.stack([np.full(400, 1000), rng.integers(300, 500, 400), np.full(400, 400), np.full(400, 600)], axis=1)
    label = (rng.random(400) < 0.5).astype(float)
    assert abs(Calibration.fit(sizes, label, (100, 900))(sizes).mean() - 0.9) < 0.02


def ranked_by_force(docs, items, k=10):
    docs = [(i, Counter(terms_of(t and t.encode()))) for i, t in docs]
    docs = [(i, c, c.total()) for i, c in docs if c]
    total, df = sum(n for *_, n in docs), Counter(t for _, c, _ in docs for t in c)
    wanted = defaultdict(set)
    for key, text in items:
        wanted[key] |= set(terms_of(text and text.encode()))
    out = []
    for key, terms in wanted.items():
        scored = []
        for i, c, n in docs:
            m = 10 + 90 * n * len(docs) // total
            scored.append((-sum(math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t]),
                           i is None, i or 0))
        out += [(key, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1) if s < 0]
    return out


def as_rows(df):
    return Counter((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect())


ITEMS = "item_id long, text string, doc_id int, term int"


def test_search_equals_brute_force(spark, docs_of, odd_texts, monkeypatch):
    monkeypatch.setattr(search_module, "SHARD_WORDS", 400)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    docs = [(i % 190, " ".join(rng.choices(words, weights=range(1, 41), k=rng.randint(1, 30)))) for i in range(200)] + odd_texts
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 8)))) for i in range(30)] + [(30, None), (31, "..."), (None, "w1 W2"), (5, "w39"), (32, "one two three")]
    queries = spark.createDataFrame([(*x, 1, 2) for x in items], ITEMS)
    assert as_rows(ranked_search(docs_of(docs), queries)) == Counter(ranked_by_force(docs, items))
    assert ranked_search(docs_of([]), queries).collect() == [] == ranked_search(docs_of(docs), queries.limit(0)).collect()
    monkeypatch.setattr(search_module, "QUERY_BYTES", 300)      # several passes over the index
    assert as_rows(ranked_search(docs_of(docs), queries)) == Counter(ranked_by_force(docs, items))


def test_blocks_without_a_chance_stay_packed(spark, docs_of):
    rng = random.Random(6)
    filler = [f"x{i}" for i in range(500)]
    docs = [(i, " ".join(["the", *rng.choices(filler, k=30 if i % 1000 else 3), *(["rare", "gem"] if 3000 <= i < 3015 else [])])) for i in range(6000)]
    index = build_index(docs_of(docs).coalesce(1))
    rows = index.where("term IS NULL OR CAST(term AS STRING) IN ('the', 'rare', 'gem')").toArrow()
    n = sum(len(t.split()) for _, t in docs)
    shard = ShardSearcher(rows, {b"the": 2, b"rare": 5000, b"gem": 5000}, len(docs), n)
    best, scores = shard.top([b"the", b"rare", b"gem"])
    assert sorted(shard.ids.take(best.tolist()).to_pylist()) == list(range(3000, 3010)) or len(best) == 10
    common = shard.lists[b"the"]
    assert 0 < common.ready.sum() < len(common.ready) / 4 and len(common.ready) == -(-6000 // 128)
    assert search(index, spark.createDataFrame([(1, "rare the", 0, 0)], ITEMS)).count() == 10


def test_packed_numbers_come_back():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28, 2**31 - 1, 5])
    packed, ends = pack(values)
    assert unpack(packed).tolist() == values.tolist() and ends[-1] == len(packed)


def collocations_by_force(docs, least, first):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in docs:
        for c in ".,;:!?\n\x0b\x0c\r":
            text = (text or "").replace(c, "\n")
        for piece in text.translate(low).split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            totals[lang or "und"] += len(words)
            for size in range(1, 6):
                for p in range(len(words) - size + 1):
                    counts[lang or "und"][tuple(words[p:p + size])] += 1
    out = []
    for lang, f in counts.items():
        held = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in held.items():
            if any(b >= a and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in held.items()):
                continue
            score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r, p.decode(), -a, x, y, totals[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(rows)[:first], 1)]
    return Counter(out)


@pytest.mark.parametrize("bucket_rows", [4, 60, 250_000])
def test_collocations_equal_brute_force(spark, docs_of, odd_texts, bucket_rows):
    rng = random.Random(7)
    words = "The of and New York City is big é日 ;stop, x\ty a\x00b".split(" ")
    docs = [(i, " ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randint(0, 40)))) for i in range(150)]
    docs += [(i, "the new york city is big and big. new york city is big") for i in range(150, 200)] + [(i, t) for i, t in odd_texts if not t or len(t) < 1000]
    langs = [("de" if (i or 0) % 3 == 0 else None if (i or 0) % 7 == 0 else "en") for i, _ in docs]
    frame = docs_of(docs).withColumn("lang", F.when(F.coalesce("doc_id", F.lit(0)) % 3 == 0, "de").when(F.coalesce("doc_id", F.lit(0)) % 7 == 0, F.lit(None)).otherwise("en"))
    got = collocations(frame, least=6, first=40, bucket_rows=bucket_rows)
    assert Counter(tuple(r) for r in got.collect()) == collocations_by_force([(t, k) for (_, t), k in zip(docs, langs, strict=True)], 6, 40)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("held_rows", [0, 40, 500_000])
def test_a_task_gives_out_equal_suffixes_once(monkeypatch, held_rows):
    """However many slices it reads; when it holds too many, what it has is given out and the sums stay."""
    monkeypatch.setattr(collocation_module, "SLICE_BYTES", 60)
    texts = ["a b c d. a b", "b a, c", None, "", "d c b a e f", "a b c d é"] * 30
    langs = [["en", "de", "und"][i % 7 % 3] for i in range(len(texts))]
    batch = pa.record_batch([pa.array(langs), pa.array(texts)], ["_lang", "_text"])
    full = Filter(np.arange(1 << 20), np.full(1 << 20, ~np.uint64(0), np.uint64))
    run = _suffixes([SimpleNamespace(value=full)] * 3, held_rows) if held_rows < 500_000 else _suffixes([SimpleNamespace(value=full)] * 3)
    out = [tuple(r.values()) for b in run(iter([batch] * 4)) for r in b.to_pylist()]
    want = Counter()
    for text, lang in zip(texts, langs, strict=True):
        pieces = [p.split() for p in (text or "").replace(",", ".").split(".")]
        want[(lang, *[None] * 5)] += 4 * sum(map(len, pieces))
        for words in pieces:
            for p in range(len(words)):
                row = [w.encode() for w in words[p:p + 5]]
                want[(lang, *row, *[None] * (5 - len(row)))] += 4
    got = Counter()
    for *row, count in out:
        got[tuple(row)] += count
    assert got == want
    assert len(out) == len(want) if held_rows == 500_000 else len(out) > len(want)


def test_collocations_of_nothing(docs_of):
    assert collocations(docs_of([])).collect() == [] == collocations(docs_of([(1, None), (2, "a b")])).collect()


def test_quicksort_counts_every_frequent_prefix():
    rng = np.random.default_rng(1)
    rows, weight = rng.integers(-1, 4, (400, 4)), rng.integers(1, 5, 400)
    for c in range(1, 4):
        rows[rows[:, c - 1] < 0, c] = -1
    want = Counter()
    for row, w in zip(rows.tolist(), weight.tolist(), strict=True):
        for d in range(1, 5):
            if row[d - 1] >= 0:
                want[tuple(row[:d])] += w
    got = {tuple(rows[r, :d].tolist()): n for r, d, n in frequent_prefixes(list(rows.T), weight, 20)}
    assert got == {p: n for p, n in want.items() if n >= 20}
    assert list(frequent_prefixes(list(rows.T), weight, 10**6)) == []


def test_filter_misses_no_member(spark):
    members = spark.range(5000).select(F.xxhash64("id").alias("h"))
    found = Filter.of(members)(np.array([r.h for r in members.collect()]).view(np.uint64))
    assert found.all() and not Filter.of(members.limit(0))(np.arange(9, dtype=np.uint64)).any()
