import importlib.util
import sys

import __spark_entry__ as entry


def test_contract(spark):
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert entry.entry(spark).count() > 0


def test_without_training_data_operators(monkeypatch):
    found = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n == "wakeline.llm" else found(n, *a))
    assert not any(n.startswith("op") and n[2].isdigit() for n in entry.queries())


def test_library_does_not_import_them():
    from pathlib import Path

    top = Path(entry.__file__).parent / "wakeline"
    for p in top.rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
    assert "wakeline.plans.queries" in sys.modules
