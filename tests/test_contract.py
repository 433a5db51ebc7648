from __future__ import annotations

import importlib
import sys

import __spark_entry__


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_without_the_optional_subpackage(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("barterflow.llm")]:
        monkeypatch.delitem(sys.modules, name)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("barterflow.llm"):
                raise ModuleNotFoundError(name, name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    entry = importlib.reload(__spark_entry__)
    assert "p3_found" in entry.queries() and "p1_found" not in entry.queries()
