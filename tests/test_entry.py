import builtins
import importlib
import sys


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 80
    assert set(e.oracle_sql()) <= set(e.queries())


def test_works_without_the_corpus_package(monkeypatch):
    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name.startswith(("corpus_pipeline", "meterlark.llm")):
            raise ModuleNotFoundError(name, name=name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", without)
    for name in [m for m in sys.modules if m.startswith(("corpus_pipeline", "meterlark.llm"))]:
        monkeypatch.delitem(sys.modules, name)
    import __spark_entry__ as e

    importlib.reload(e)
    assert not any(n.startswith("op") for n in e.queries())
    assert "minute_usage" in e.queries()
