import builtins
import importlib
import sys

import duckdb
import pytest

from millrace.plans import catalogue, control

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalogue.SQL))
def test_catalogue_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(catalogue.SQL[name])
    got = catalogue.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    cols = got.columns
    key = lambda r: [str(round(x, 2)) if isinstance(x, float) else str(x) for x in r]
    assert sorted(map(key, got.collect())) == sorted(map(key, want.select(*cols).fetchall()))


def test_entry_works_without_the_optional_operators(monkeypatch):
    real = builtins.__import__

    def missing(name, g=None, l=None, fromlist=(), level=0):  # noqa: E741
        if "corpus_pipeline" in name or name.endswith("llm") or "llm" in (fromlist or ()):
            raise ModuleNotFoundError(name, name="corpus_pipeline")
        return real(name, g, l, fromlist, level)

    for m in [m for m in sys.modules if m == "__spark_entry__" or m == "corpus_pipeline" or m.startswith("millrace.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", missing)
    entry = importlib.import_module("__spark_entry__")
    assert "agg_by_returnflag" in entry.queries() and not [q for q in entry.queries() if q.startswith("op")]
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_a_broken_import_of_the_optional_operators_is_not_hidden(monkeypatch):
    real = builtins.__import__

    def broken(name, g=None, l=None, fromlist=(), level=0):  # noqa: E741
        if name == "corpus_pipeline":
            raise ModuleNotFoundError(name="a_library_it_needs")
        return real(name, g, l, fromlist, level)

    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    monkeypatch.setattr(builtins, "__import__", broken)
    with pytest.raises(ModuleNotFoundError):
        importlib.import_module("__spark_entry__")


def test_runs_keep_to_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert control.root(spark).startswith(shared.rstrip("/"))
