import sys

import __spark_entry__ as entry


def test_corpus_queries_are_optional(monkeypatch):
    whole = set(entry.queries())
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    rest = set(entry.queries())
    assert rest <= whole and not any(n.startswith("op") and n[2].isdigit() for n in rest) and "pipeline" not in rest and "lexical_topk" in rest
    assert set(entry.oracle_sql()) <= rest


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
