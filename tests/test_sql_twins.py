"""Every registered query of the interaction, vector and document families against its SQL twin on the same tables."""

import duckdb
import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(values):
    return sorted((tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_twin(spark, db, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    twin = db.sql(registry.oracle_sql()[name])
    assert columns == sorted(twin.columns)
    assert rows(map(tuple, df.select(columns).collect())) == rows(twin.project(", ".join(columns)).fetchall())


def test_every_query_has_an_entry():
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
