import pytest

from galaxis import engine


def test_one_session(spark):
    engine.reset()
    assert not engine.is_initialized()
    assert engine.init() is engine.init() and engine.is_initialized()
    assert engine.platform()["local"]
    with pytest.raises(ValueError):
        engine.init(spark__sql__ansi__enabled="false")
    engine.reset()
    assert set(engine.ESTIMATORS) == {"kmeans", "spectral", "agglomerative", "hdbscan", "som", "pca"}


def test_entry_imports_without_the_corpus_operators(monkeypatch):
    import __spark_entry__

    monkeypatch.setattr(__spark_entry__, "find_spec", lambda name: None)
    assert "kmeans_summary" in __spark_entry__.queries() and not any(k.startswith("op") for k in __spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
