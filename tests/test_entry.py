"""The entry point without the text operators, or without a package that they need."""

import sys

import pytest

import __spark_entry__


@pytest.mark.parametrize("absent", ["sentencepiece", "tokenizers", "public_tokenizers", "corpus_pipeline"])
def test_other_queries_stay(monkeypatch, absent):
    for name in [m for m in sys.modules if m.startswith(("rentloom.llm", "corpus_pipeline")) or m == absent]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, absent, None)
    names = __spark_entry__.queries()
    assert "clean_listings" in names and not any(n.startswith("op") and n[2].isdigit() for n in names)
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_a_broken_module_of_our_own_is_no_absence(monkeypatch):
    pytest.importorskip("corpus_pipeline", exc_type=ImportError)      # where the text operators are left out there is none
    for name in [m for m in sys.modules if m.startswith(("rentloom.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "rentloom.llm.batches", None)
    with pytest.raises(ModuleNotFoundError):
        __spark_entry__.queries()
