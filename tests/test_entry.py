import importlib
import sys

import pytest

from skein import queries


@pytest.mark.parametrize("missing", ["corpus_pipeline", "skein.llm.entry"])
def test_the_rest_works_without_the_corpus_operators(monkeypatch, missing):
    for name in [n for n in sys.modules if n in ("__spark_entry__", "corpus_pipeline") or n.startswith("skein.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(queries.queries()) and set(entry.oracle_sql()) == set(queries.oracle_sql())
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_nothing_else_imports_the_corpus_operators():
    import pathlib

    for path in pathlib.Path(queries.__file__).parent.rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text()
