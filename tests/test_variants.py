"""Towns by coordinate range and misspelt variants, against brute force."""

import random

from pyspark.sql import functions as F

from rentloom.operators.clusters import city_boxes, infer_city
from rentloom.operators.spellings import components, spelling_clusters, spelling_links

PLACES = "id int, `Town` string, `Latitude` double, `Longitude` double"


def test_towns_of_every_size_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(0, "Globe", -90.0, -180.0), (1, "Globe", 90.0, 180.0), (2, "Spot", 1.0, 1.0), (3, "Line", 5.0, 5.0), (4, "Line", 5.0, 9.0)]
    for t in range(300):
        y, x, size = rng.uniform(-80, 80), rng.uniform(-170, 170), 10 ** rng.uniform(-4, 1.5)
        rows += [(0, f"T{t}", y + rng.uniform(-1, 1) * size, x + rng.uniform(-1, 1) * size) for _ in range(3)]
    known = [r for r in rows]
    points = [(rng.choice(known)[2] + rng.choice([0, rng.gauss(0, 1)]), rng.choice(known)[3] + rng.choice([0, rng.gauss(0, 1)])) for _ in range(400)]
    points += [(1.0, 1.0), (5.0, 7.0), (None, 3.0), (90.0, 180.0), (95.0, 0.0)]
    asked = [(1000 + i, None if i % 2 else " ", y, x) for i, (y, x) in enumerate(points)]
    boxes = {}
    for _, t, y, x in known:
        b = boxes.setdefault(t, [y, y, x, x])
        boxes[t] = [min(b[0], y), max(b[1], y), min(b[2], x), max(b[3], x)]

    def best(y, x):
        held = [((b[1] - b[0]) * (b[3] - b[2]), t) for t, b in boxes.items() if y is not None and b[0] <= y <= b[1] and b[2] <= x <= b[3]]
        return min(held)[1] if held else None

    df = spark.createDataFrame(known + asked, PLACES)
    got = {r.id: r.Town for r in infer_city(df).where("id >= 1000").collect()}
    assert got == {i: best(y, x) for i, _, y, x in asked}
    cells = city_boxes(df).groupBy("_town").count()
    assert cells.agg(F.max("count")).first()[0] <= 4
    assert infer_city(df.where("id >= 1000")).where("trim(Town) <> ''").count() == 0


def misspell(rng, word):
    at, kind = rng.randrange(1, len(word) - 1), rng.randrange(3)
    return word[:at] + ("" if kind == 0 else rng.choice("qxz")) + word[at + (kind != 1):]


def grams(text):
    padded = f" {text.lower()} "
    return {padded[i:i + 3] for i in range(max(1, len(padded) - 2))}


def test_misspelt_names_share_a_cluster(spark):
    rng = random.Random(9)
    names = ["".join(rng.choices("abcdefghiklmnoprstuv", k=rng.randint(14, 22))) for _ in range(60)]
    families = {n: {n, *(misspell(rng, n) for _ in range(8))} for n in names}
    texts = [t for f in families.values() for t in f] + [None, "", " "]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id int, t string, _root int").drop("_root")
    links = {(r.a, r.b): r.likeness for r in spelling_links(df, "t").collect()}
    every = sorted({t for f in families.values() for t in f})
    truth = {(a, b) for i, a in enumerate(every) for b in every[i + 1:] if len(grams(a) & grams(b)) >= 0.6 * len(grams(a) | grams(b))}
    assert set(links) <= truth and len(links) >= 0.9 * len(truth)
    found = {r.t: r.cluster for r in spelling_clusters(df, "t").collect()}
    assert found[None] is None and found[""] is None
    assert all(found[t] == found[n] for n, f in families.items() for t in f if len(grams(t) & grams(n)) >= 0.6 * len(grams(t) | grams(n)))
    assert len({found[n] for n in names}) == 60


def test_a_large_family_makes_no_pairs_of_all(spark):
    names = [f"northern boulevard of the old harbour {i:04d}" for i in range(1500)]
    df = spark.createDataFrame([(n,) for n in names], "t string")
    assert spelling_links(df, "t").count() < 300_000        # all pairs: 1,124,250
    assert spelling_clusters(df, "t").select("cluster").distinct().count() == 1


def test_components_of_chains_and_rings(spark):
    links = [(i, i + 1) for i in range(12)] + [(100, 101), (101, 102), (102, 100), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {**{i: 0 for i in range(13)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a int, b int")).collect() == []
