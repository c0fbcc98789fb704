"""The driver contract."""

import importlib
import sys

import __spark_entry__


def test_names_match():
    held, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(held) and len(held) > 100


def test_without_the_training_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("kestrel.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "kestrel.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.reload(__spark_entry__)
    names = entry.queries()
    assert "top_mules" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
