import __spark_entry__ as entry


def test_contract(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100
    assert entry.entry(spark).count() >= 0


def test_without_the_optional_subpackage(monkeypatch):
    import importlib.util

    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith(("chronolake.llm", "corpus_pipeline")) else find(name, *a))
    assert not [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
