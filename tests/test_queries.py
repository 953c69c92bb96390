"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from unitgraph import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if value is None:
        return "~"
    if isinstance(value, float):
        return f"{value:.6f}"
    return str(value)


def test_every_query_has_its_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want and want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_entry_without_the_optional_part(monkeypatch):
    """A library that the training-data part needs is missing: the other queries are there."""
    import importlib

    import __spark_entry__

    whole = importlib.import_module

    def without(name, *more):
        if name in ("unitgraph.llm.queries", "corpus_pipeline"):
            raise ImportError("no such library")
        return whole(name, *more)

    monkeypatch.setattr(__spark_entry__.importlib, "import_module", without)
    with pytest.warns(UserWarning, match="left out"):
        assert set(__spark_entry__.queries()) == set(registry.queries())
