"""Every query of the registry against its SQL, value by value."""

from __future__ import annotations

import math

import duckdb
import pytest

from marigold import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v) -> str:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str([plain(x) for x in v]) if isinstance(v, list | tuple) else str(v)


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


#: Sources and sinks also run on the larger tables, whose texts hold quotes and line ends.
LARGER = sorted(n for n, q in registry.queries().items() if n in registry.oracle_sql() and q.__module__ == "marigold.plans.roundtrips")


@pytest.mark.parametrize("name, size", [(n, "sf0.001") for n in sorted(registry.oracle_sql())] + [(n, "sf0.01") for n in LARGER])
def test_query_equals_sql(spark, sf, name, size):
    sf = sf.replace("sf0.001", size)
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = duck(sf).sql(registry.oracle_sql()[name])
    assert sorted(sql.columns) == columns
    at = [sql.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in sql.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_has_rows(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry_imports_without_the_training_data_subpackage(monkeypatch):
    import importlib
    import sys

    for m in [m for m in sys.modules if m.startswith("marigold.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "marigold.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.import_module("__spark_entry__")
    assert registry.FLAGSHIP in entry.queries() and not any(n.startswith("op") for n in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")
