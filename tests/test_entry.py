import builtins
import importlib
import sys

import __spark_entry__


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_works_without_training_data_operators(monkeypatch):
    real = builtins.__import__

    def refuse(name, globals=None, locals=None, fromlist=(), level=0):  # noqa: A002
        if name.startswith("leafmill.llm"):
            raise ImportError(name)
        return real(name, globals, locals, fromlist, level)

    for name in [m for m in sys.modules if m.startswith("leafmill.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", refuse)
    entry = importlib.reload(__spark_entry__)
    try:
        assert entry.llm_queries is None and len(entry.queries()) > 60
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)
