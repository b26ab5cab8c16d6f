"""The pipeline and the registered queries of the text operators."""

import corpus_pipeline
import pytest
from compare import compare, oracle_connection
from corpus_pipeline import STAGES
from pyspark.sql import functions as F

from rentloom.llm import decontaminate, language, repeated_spans, shingle_links
from rentloom.llm.batches import BATCH_BYTES
from rentloom.llm.decontaminate import contamination
from rentloom.llm.queries import QUERIES, SQL
from rentloom.llm.repeated_spans import remove_repeats


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, sf, name):
    assert compare(oracle_connection(sf), QUERIES[name](spark, sf), SQL[name]) == ""


def test_stages_keep_clean_documents_and_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        assert before * 0.7 < docs.count() <= before, name
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_odd_documents_pass_every_stage(spark, sf, docs_of, odd_texts):
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs_of(odd_texts), sf).collect()
        assert len(rows) <= len(odd_texts), name
        assert stage(spark, docs_of([]), sf).collect() == [], name


def test_one_of_each_group_stays(spark, sf, docs_of):
    text = "one two three four five six seven eight nine ten"
    rows = [(5, text), (3, text.upper()), (3, text.upper()), (9, "another text altogether, with words"), (8, None), (None, text)]
    left = corpus_pipeline.one_of_each(spark, docs_of(rows), sf).collect()
    assert sorted((r.doc_id, r.text or "") for r in left) == [(3, text.upper()), (8, ""), (9, "another text altogether, with words")]


def test_a_copy_with_one_other_passage_goes(spark, sf, docs_of):
    """240 words, 20 of them replaced: 0.815 of the five-word shingles are shared, 0.823 of the four-word ones."""
    words = [f"w{i}" for i in range(240)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:100] + [f"x{i}" for i in range(20)] + words[120:])), (3, "something else")]
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, docs_of(rows), sf).collect()) == [1, 3]


def test_clashing_columns_come_through_unchanged(spark, sf, docs_of):
    """Columns named like inner ones pass all filtering stages with their values."""
    names = ["_row_key_1", "_n_words", "_n_removed", "_contaminated", "_n_hit", "_k1", "_twin", "_root", "spans", "all", "accepted", "n_hit", "_extra_0", "_N_items"]
    docs = docs_of([(i, f"This is the story of number {i} and it was told by the people of the town to all who came. " * 2) for i in range(3)])
    docs = docs.drop("ids", "_text", "set").withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    for _, stage in STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        for row in out.collect():
            assert all(row[n] == f"{n}{row.doc_id}" for n in names)
    rows = remove_repeats(docs)
    assert rows.columns == [*docs.columns, "__n_words", "__n_removed"] and rows.where("__n_words > 0").count() == 3
    kept = contamination(docs, spark.createDataFrame([(1, "told by the people of the town to all")], "item_id int, text string"), keep=True)
    assert kept.where("__contaminated AND __n_hit = 18 AND __n_items = 1").count() == 3


def _small_only(make):
    """The same function of tasks; it fails on a batch far over the size of a slice."""
    def made(*args):
        run = make(*args)

        def look(batches):
            def small():
                for batch in batches:
                    assert batch.nbytes < 2 * (4 << 20), f"a batch of {batch.nbytes} bytes"
                    yield batch
            return run(small())
        return look
    return made


def test_python_gets_batches_of_few_bytes(spark, monkeypatch):
    """12 MB of texts in one partition reach Python in slices, and the session is left as it was."""
    for module, name in ((language, "_scores"), (shingle_links, "_sets"), (shingle_links, "_alike"), (repeated_spans, "_paths"), (decontaminate, "_candidates")):
        monkeypatch.setattr(module, name, _small_only(getattr(module, name)))
    words = "concat_ws(' ', transform(sequence(1, 1000), x -> concat('w', (id div 2) * 1100 + x + id % 2)))"
    docs = spark.range(0, 1600, 1, 1).selectExpr("id doc_id", f"{words} text", "'en' lang", "'src' source")
    items = docs.where("doc_id = 7").selectExpr("doc_id item_id", "text")
    assert language.identify(docs).count() == 1600
    assert shingle_links.similar_documents(docs).where("component_id = doc_id - doc_id % 2").count() == 1600
    assert remove_repeats(docs).where("_n_removed = 999").count() == 1600
    assert sorted(r.doc_id for r in contamination(docs, items).where("contaminated").collect()) == [6, 7]
    assert spark.conf.get(BATCH_BYTES, None) is None


def test_a_limit_of_the_session_holds(spark):
    spark.conf.set(BATCH_BYTES, "1000")
    try:
        docs = spark.range(0, 40, 1, 1).selectExpr("id doc_id", "repeat(concat('w', id div 2, ' '), 50) text")
        assert shingle_links.similar_documents(docs).where("component_id = doc_id - doc_id % 2").count() == 40
        assert spark.conf.get(BATCH_BYTES) == "1000"
    finally:
        spark.conf.unset(BATCH_BYTES)
