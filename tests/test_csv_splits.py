"""The split CSV reader against Spark's own one, which reads a file in one task."""

import random

import pytest

from rentloom.sources.csv_splits import OPTIONS, chain, open_at_end, read_records, read_split_csv
from rentloom.sources.listings import assign_row_key, read_listings


def cell(rng, wild):
    if wild and rng.random() < 0.3:
        return "".join(rng.choices(["a", '"', " ", "b"], k=rng.randint(1, 6)))
    text = "".join(rng.choices(["a", "b", ",", '"', "\n", "é", " ", "\n\n", "word"], k=rng.randint(0, 6)))
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n') or rng.random() < 0.2 else text


@pytest.fixture
def small_splits(spark):
    usual = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in usual.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("newline", "wild"), [("\n", False), ("\r\n", False), ("\n", True)])
def test_one_file_in_many_splits(spark, tmp_path, small_splits, newline, wild):
    rng = random.Random(11)
    rows = [["a", "b b", "", "a"], *([cell(rng, wild) for _ in range(rng.choice([4, 4, 4, 3, 5]))] for _ in range(500))]
    rows[200][1] = '"' + "long, \n\n and open over several splits\n" * 40 + '"'
    path = tmp_path / "one.csv"
    path.write_text(newline + newline.join(",".join(r) for r in rows) + newline, newline="")
    old = spark.read.csv(str(path), header=True, inferSchema=False, **OPTIONS)
    new = read_split_csv(spark, str(path))
    assert new.columns == old.columns
    assert [tuple(r) for r in new.collect()] == [tuple(r) for r in old.collect()]
    assert read_records(spark, str(path)).where("text LIKE '%several%'").count() == 1
    splits = spark.read.text(str(path)).rdd.getNumPartitions()
    assert splits > 20 and read_records(spark, str(path)).select("split").distinct().count() > 10


def test_open_quotes_files_without_rows_and_without_an_end(spark, tmp_path):
    texts = ["a,b\n", "a,b", "a,b\n1,2", 'a,b\n1,"2\n', 'a,b\n1,"2\n3', "a,b\n\n\n1,2\n\n", 'a,b\n"x""\n",""\n', "\n\na,b\n5,6\n"]
    for i, text in enumerate(texts):
        (tmp_path / f"f{i}.csv").write_text(text)
    old = spark.read.csv(str(tmp_path), header=True, inferSchema=False, **OPTIONS)
    assert sorted(map(str, read_split_csv(spark, str(tmp_path)).collect())) == sorted(map(str, old.collect()))


def test_state_of_a_line_break():
    assert open_at_end(b'a,"b', False) and not open_at_end(b'a,b"', False) and open_at_end(b'b""', True)
    assert not open_at_end(b'b",c', True) and open_at_end(b'b","c', True) and not open_at_end(b'"a"x"', False)
    assert open_at_end(b"plain", True) and not open_at_end(b"plain", False)


def test_chained_starts():
    found = chain([("f", 100, True, False, 0, 0, False, 10), ("f", 0, True, False, 2, 1, False, 10), ("f", 200, True, False, 1, 1, False, 10), ("g", 0, False, False, 1, 1, True, 5)])
    assert [(s.inside, s.open_end, s.owner, s.header) for _, s in sorted(found.items())] == [
        (False, True, 0, True), (True, False, 0, False), (False, True, 0, False), (False, False, 0, True)]


def test_listings_keep_their_file_position(spark, tmp_path, small_splits):
    path = tmp_path / "l.csv"
    path.write_text("id,name\n" + "".join(f'{i},"n{i}\nx"\n' for i in range(300)))
    keyed = assign_row_key(read_listings(spark, str(path)), "A")
    assert sorted((r.Index, r.id) for r in keyed.collect()) == sorted((f"A{i}", str(i)) for i in range(300))
