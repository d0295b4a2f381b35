"""The entry module works without the subpackage of training-data operators, and hides no other missing module."""

import importlib
import sys

import pytest

import __spark_entry__ as entry


@pytest.fixture
def reloaded():
    yield lambda: importlib.reload(entry)
    importlib.reload(entry)


def test_without_the_subpackage(monkeypatch, reloaded):
    with monkeypatch.context() as m:
        m.delitem(sys.modules, "mosaiq.llm.queries", raising=False)
        m.setitem(sys.modules, "mosaiq.llm", None)
        found = reloaded()
        assert found.llm_queries is None and "cluster_listing" in found.queries() and not any(n.startswith("op1") for n in found.queries())
        assert set(found.oracle_sql()) <= set(found.queries())


def test_other_missing_modules_show(monkeypatch, reloaded):
    if entry.llm_queries is None:
        pytest.skip("no subpackage")
    with monkeypatch.context() as m:
        for name in [n for n in sys.modules if n.startswith("mosaiq.llm")]:
            m.delitem(sys.modules, name)
        m.setitem(sys.modules, "numpy", None)
        with pytest.raises(ImportError):
            reloaded()
