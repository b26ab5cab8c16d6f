"""Repeated spans, near copies, contamination and fingerprints against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest

from rentloom.llm import shingle_links
from rentloom.llm.components import components
from rentloom.llm.decontaminate import contamination
from rentloom.llm.fingerprints import containment, fingerprints, merged, short_text_containment
from rentloom.llm.repeated_spans import remove_repeats
from rentloom.llm.shingle_links import similar_documents
from rentloom.operators import scale


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def corpus(seed=5, n=120):
    """Texts with shared passages, near copies, exact copies and runs of one word."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage, line = rng.choices(words, k=60), rng.choices(words, k=12)
    base = rng.choices(words, k=90)
    texts = []
    for i in range(n):
        own = rng.choices(words, k=rng.randint(0, 120))
        kind = i % 6
        if kind == 0:
            own[len(own) // 2:len(own) // 2] = passage[rng.randint(0, 10):rng.randint(40, 60)]
        elif kind in (1, 2):
            own = [w if rng.random() > 0.006 * (i % 11) else rng.choice(words) for w in base]
        elif kind == 3:
            own += line
        elif kind == 4 and texts:
            own = texts[rng.randrange(len(texts))][1].split()
        elif kind == 5:
            own += [["a"] * 80, ["a", "b"] * 40, ["x", "y", "z"] * 20][i % 3]
        texts.append((i, " ".join(own)))
    return texts


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_repeated_spans(docs_of, odd_texts):
    rows = corpus() + [(i and i + 1000, t) for i, t in odd_texts] + [(7, corpus()[7][1])]
    words = [split(t) for _, t in rows]
    windows = Counter(tuple(w[p:p + 35]) for w in words for p in range(len(w) - 34))
    want = []
    for (key, text), w in zip(rows, words, strict=True):
        gone = {q for p in range(len(w) - 34) if windows[tuple(w[p:p + 35])] > 1 for q in range(p, p + 35)}
        kept = [x for q, x in enumerate(w) if q not in gone]
        want.append((key or -1, len(w), len(gone), sha(" ".join(kept))))
    got = [(r.doc_id or (-1 if r.doc_id is None else 0), r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(docs_of(rows), digest=True).collect()]
    assert sorted(got) == sorted((k if k != -1 or key is None else 0, *r) for (k, *r), (key, _) in zip(want, rows, strict=True))
    whole = remove_repeats(docs_of(rows))
    assert whole.columns[:8] == docs_of(rows).columns
    assert sorted(sha(" ".join(split(r.text))) for r in whole.collect()) == sorted(w[3] for w in want)
    assert remove_repeats(docs_of([])).collect() == []


def brute_components(rows):
    sets = []
    for _, text in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in split(text)]
        k = min(4, len(w))
        sets.append(frozenset(tuple(w[p:p + k]) for p in range(len(w) - k + 1)) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if a and sets[j] and 100 * shared >= 85 * (len(a) + len(sets[j]) - shared):
                root[find(i)] = find(j)
    lows = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            lows[find(i)] = min(lows.get(find(i), key), key)
    return sorted((str(key), len(sets[i]), str(lows.get(find(i)) if sets[i] else key)) for i, (key, _) in enumerate(rows))


@pytest.mark.parametrize("limits", [{}, {"HOT_SETS": 3, "CROWD": 2}, {"CROWD": 10_000, "WIDE": 0}])
def test_similar_documents(docs_of, odd_texts, monkeypatch, limits):
    """As they are; with every shared token hot and a crowd; with every group asked for its union first."""
    for name, value in limits.items():
        monkeypatch.setattr(shingle_links, name, value)
    rows = corpus(n=240) + [(i and i + 1000, t) for i, t in odd_texts]
    got = similar_documents(docs_of(rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows)


def families(n, own, common, seed=11):
    """Two families of ``n`` near copies each, with ``common`` template words in both."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(5000)]
    template, rows = rng.choices(words, k=common), []
    for family in range(2):
        base = rng.choices(words, k=own) + template
        for i in range(n):
            text = list(base)
            text[rng.randrange(own)] = f"x{family}_{i}"
            rows.append((family * n + i, " ".join(text)))
    return rows


def test_families_with_a_common_part_do_not_meet_in_all_pairs(docs_of, monkeypatch):
    verified, compared = shingle_links._verified, []

    def counted(pairs, *rest):
        pairs = pairs.checkpoint()
        compared.append(pairs.count())
        return verified(pairs, *rest)
    monkeypatch.setattr(shingle_links, "_verified", counted)
    per_member = []
    for n in (50, 200):
        compared.clear()
        rows = families(n, 120, 60)
        got = similar_documents(docs_of(rows)).collect()
        assert {(r.doc_id, r.component_id) for r in got} == {(i, i // n * n) for i in range(2 * n)}
        per_member.append(sum(compared) / (2 * n))
    assert per_member[1] <= 1.5 * per_member[0] + 4


def test_texts_that_share_a_line_are_told_apart_by_their_prefixes(docs_of, monkeypatch):
    """Only pairs whose prefixes share enough tokens are compared by their texts."""
    rng, read, store = random.Random(17), [], shingle_links.stored

    def counted(df, name, *rest):
        out = store(df, name, *rest)
        if name == "hopeful-pairs":
            read.append(out.count())
        return out
    monkeypatch.setattr(shingle_links, "stored", counted)
    line = [f"line{i}" for i in range(60)]
    rows = [(i, " ".join([f"o{i}_{k}" for k in range(300)] + line[5 * (i % 10):5 * (i % 10) + 8])) for i in range(80)]
    for i in range(80, 90):
        near = rows[i - 80][1].split()
        near[rng.randrange(300)] = f"n{i}"
        rows.append((i, " ".join(near)))
    got = similar_documents(docs_of(rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows)
    assert read and 10 <= sum(read) <= 20


@pytest.mark.parametrize("like, shingle", [(85, 4), (80, 5)])
def test_no_list_that_grows_with_the_pairs_is_sent(docs_of, monkeypatch, like, shingle):
    """What is sent to all tasks stays below the bits of a bitmap, however many pairs there are; texts of busy sets go to several places."""
    monkeypatch.setattr(shingle_links, "MARK_BITS", 1 << 15, raising=False)
    monkeypatch.setattr(shingle_links, "FOLLOWERS", 7, raising=False)
    sent, broadcast = [], shingle_links.F.broadcast

    def weighed(df):
        cells = df.selectExpr(*[f"octet_length(`{c}`) AS c{i}" for i, (c, kind) in enumerate(df.dtypes) if kind == "binary"])
        sent.append(sum(map(sum, cells.collect())))
        return broadcast(df)
    monkeypatch.setattr(shingle_links.F, "broadcast", weighed)
    rows = families(150, 150, 40)
    got = similar_documents(docs_of(rows), like=like, shingle=shingle).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, i // 150 * 150) for i in range(300)}
    assert sent and max(sent) <= (1 << 15) // 8


def test_marks_lose_no_row(spark, monkeypatch):
    """Rows whose set is named stay, in a sparse bitmap and in one that is far too small; few others stay in the sparse one."""
    rows = spark.range(0, 4000, 1, 3).selectExpr("unhex(md5(string(id))) AS set", "id")
    names = rows.where("id % 4 = 0").select("set")
    names = names.unionByName(names)
    for bits in (1 << 26, 1 << 10):
        monkeypatch.setattr(shingle_links, "MARK_BITS", bits)
        left = [r.id for r in shingle_links._marked(rows, names, 2000).collect()]
        assert len(left) == len(set(left)) and set(range(0, 4000, 4)) <= set(left)
        assert bits == 1 << 10 or len(left) < 1500
    assert shingle_links._marked(rows, names.limit(0), 0).collect() == []


def test_families_that_are_alike_become_one(docs_of):
    rows = families(40, 20, 220)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in similar_documents(docs_of(rows)).collect()) == brute_components(rows)


def test_similar_documents_of_an_empty_table(docs_of):
    assert similar_documents(docs_of([])).collect() == []
    assert [r.component_id for r in similar_documents(docs_of([(3, None)])).collect()] == [3]


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(1, x) for x in range(2, 60)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{x: 1 for x in range(1, 60)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_equal_rows_do_not_meet_each_other(docs_of):
    """Thousands of equal rows lose all their windows, and so do the passages that others share with them."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    common, other = rng.choices(words, k=300), rng.choices(words, k=50)
    rows = [(1, " ".join(common))] * 4000 + [(2, " ".join([*other, *common[100:160]])), (3, " ".join([*other[5:45], *common[:34]])), (4, " ".join(common[:34]))]
    rows += [(5, " ".join(common[:34]))] * 3 + [(None, None)] * 3
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in remove_repeats(docs_of(rows), digest=True).collect())
    assert got == {(1, 300, 300): 4000, (2, 110, 100): 1, (3, 74, 40): 1, (4, 34, 0): 1, (5, 34, 0): 3, (None, 0, 0): 3}
    whole = remove_repeats(docs_of(rows))
    assert Counter((r.text, r.lang) for r in whole.where("doc_id = 1").collect()) == {("", "en"): 4000}
    assert whole.where("doc_id IS NULL AND text IS NULL").count() == 3


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


@pytest.mark.parametrize("small", [True, False])
def test_contamination(spark, docs_of, odd_texts, monkeypatch, small):
    if not small:      # shuffled joins, keys with many rows split off
        monkeypatch.setattr(scale, "fits_broadcast", lambda lookup: False)
    docs = corpus() + [(i and i + 1000, t) for i, t in odd_texts] + [(6, corpus()[6][1])] * 2
    passage = docs[6][1].split()
    items = [(1, " ".join(passage[5:40])), (2, "One, two THREE"), (3, None), (4, "--"), (5, "tied"), (5, "a a a a a a a a a a a a a a"),
             (10, " ".join(passage[20:33])), (None, "it s 12"), (7, "not there at all")]
    want = []
    for key, text in docs:
        w = item_words(text)
        hit, names = set(), set()
        for name, item in items:
            v = item_words(item)
            k = min(13, len(v))
            for p in range(len(v) - k + 1 if v else 0):
                for q in range(len(w) - k + 1):
                    if w[q:q + k] == v[p:p + k]:
                        hit |= set(range(q, q + k))
                        names.add("null" if name is None else str(name))
        want.append((str(key), len(w), len(hit), len(names), sha(",".join(sorted(names))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(docs_of(docs), bench).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted(want)
    kept = contamination(docs_of(docs), bench, keep=True)
    assert kept.columns[:8] == docs_of(docs).columns and kept.where("_contaminated").count() == sum(w[5] for w in want)
    assert contamination(docs_of(docs), bench.limit(0)).where("n_hit > 0").isEmpty()


def test_fingerprints(docs_of, odd_texts):
    docs = [(i, t) for i, t in odd_texts if i != 4] + corpus(n=40)[20:]
    order = sorted((i, t or "") for i, t in docs if i is not None)
    got = {(r.doc_id, r.n_chars): r for r in fingerprints(docs_of(docs)).collect()}
    for at, (key, text) in enumerate(order):
        following = order[(at + 1) % len(order)][1]
        half = len(text) // 2
        row = got[key, len(text)]
        assert row.edited_sha256 == sha(text[:len(text) - half] + following[:half])
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
        if text.split():
            assert row.fingerprint
    ties = fingerprints(docs_of([(1, "same words here"), (1, "same words here"), (1, "same words here")])).collect()
    assert {r.near_next for r in ties} == {1.0} and len({r.fingerprint for r in ties}) == 1
    assert len(got) == len(docs) and fingerprints(docs_of([])).collect() == []


def test_fingerprints_estimate_containment(spark, docs_of):
    rng = random.Random(1)
    words = [f"t{rng.randrange(10**6)}" for _ in range(12_000)]
    rows = {r.doc_id: r.fingerprint for r in fingerprints(docs_of([(1, " ".join(words)), (2, " ".join(words[3000:4500])), (3, "x y z")])).collect()}
    pair = spark.createDataFrame([(rows[2], rows[1], rows[3])], "a string, b string, c string")
    from pyspark.sql import functions as F
    inside, back, both = pair.select(containment(F.col("a"), F.col("b")), containment(F.col("b"), F.col("a")),
                                     containment(F.col("c"), merged(F.col("a"), F.col("c")))).first()
    assert inside > 0.95 and abs(back - 0.125) < 0.04 and both == 1.0


def brute_roots(texts, like, width):
    sets = [{tuple(w[p:p + min(width, len(w))]) for p in range(len(w) - min(width, len(w)) + 1)} for w in map(split, texts)]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if 100 * shared >= like * (len(a) + len(sets[j]) - shared):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return [find(i) for i in range(len(sets))]


def test_similar_documents_of_five_words_and_eighty_per_cent(docs_of):
    """Copies on both sides of 0.80 and of 0.85, with short and with long prefixes."""
    rng = random.Random(8)
    texts = []
    for i in range(40):
        words = [f"k{rng.randrange(10**6)}" for _ in range(240 if i % 2 else 700)]
        at, gone = rng.randrange(len(words) // 2), round(len(words) * (0.06 + 0.002 * i))
        texts += [" ".join(words), " ".join(words[:at] + [f"n{rng.randrange(10**6)}" for _ in range(gone)] + words[at + gone:])]
    got = {r.doc_id: r.component_id for r in similar_documents(docs_of(list(enumerate(texts))), like=80, shingle=5).collect()}
    want = brute_roots(texts, 80, 5)
    assert [got[i] for i in range(len(texts))] == want
    assert want != brute_roots(texts, 85, 5) and want != brute_roots(texts, 85, 4)


def test_a_low_share_loses_no_links(docs_of):
    rng = random.Random(9)
    texts = []
    for _ in range(120):
        both, *own = ([f"k{rng.randrange(10**6)}" for _ in range(n)] for n in (26, 194, 194))
        texts += [" ".join(both + own[0]), " ".join(both + own[1])]
    got = {r.doc_id: r.component_id for r in similar_documents(docs_of(list(enumerate(texts))), like=5).collect()}
    assert [got[i] for i in range(len(texts))] == brute_roots(texts, 5, 4) == [i - i % 2 for i in range(len(texts))]


def test_limits_of_prefixes_follow_the_share():
    assert shingle_links.prefix_limits(85) == (32, 4)
    lengths = [shingle_links.prefix_limits(like)[0] for like in (95, 90, 85, 80, 70, 60)]
    assert lengths == sorted(lengths) and shingle_links.prefix_limits(50) == (None, 1)


def test_short_texts_inside_long_ones(spark, docs_of):
    from pyspark.sql import functions as F
    rng = random.Random(12)
    words = [f"t{rng.randrange(10**6)}" for _ in range(2000)]
    shorts = {10 + i: words[40 * i:40 * i + n] for i, n in enumerate((1, 3, 5, 8, 10, 10, 10, 12, 20, 20))}
    half = words[500:509] + [f"u{i}" for i in range(5)]                # 5 of 10 shingles
    docs = docs_of([(1, " ".join(words)), (9, " ".join(half)), *((i, " ".join(w)) for i, w in shorts.items())])
    prints = {r.doc_id: r.fingerprint for r in fingerprints(docs).collect()}
    got = {(r.doc_id, r.other_id): r.containment for r in short_text_containment(docs, docs.where("doc_id = 1")).collect()}
    assert got == {(9, 1): 0.5, **{(i, 1): 1.0 for i in shorts}}
    pairs = spark.createDataFrame([(prints[i], prints[1], prints[9]) for i in shorts], "a string, b string, c string")
    for row in pairs.select(containment(F.col("a"), F.col("b")).alias("inside"), containment(F.col("a"), F.col("c")).alias("apart"),
                            containment(F.col("a"), merged(F.col("a"), F.col("c"))).alias("both"),
                            (F.substring_index(merged(F.col("a"), F.col("b")), "+", 1) == F.col("b")).alias("same"), "b").collect():
        assert row.inside in (None, 1.0) and (row.apart, row.both, row.same) == (0.0, 1.0, True)
    assert "+" not in prints[1] and all(int(h, 16) < 2**61 for h in re.findall("[0-9a-f]{16}", prints[1]))


def test_edited_short_texts_are_compared_exactly(docs_of):
    rows = [(1, "a b c d e f g h i j " * 2 + "k l m n o p q r s t"), (2, "one two three four five six seven eight nine ten")]

    def shingles(text):
        w = text.split()
        return {tuple(w[p:p + 5]) for p in range(len(w) - 4)}
    for row in fingerprints(docs_of(rows)).collect():
        text, following = dict(rows)[row.doc_id], dict(rows)[3 - row.doc_id]
        half = len(text) // 2
        a, b = shingles(text), shingles(text[:len(text) - half] + following[:half])
        assert row.near_edited == pytest.approx(len(a & b) / len(a | b)) and 0 < row.near_edited < 1
