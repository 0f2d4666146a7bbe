"""Every registered query with a SQL twin gives the twin's rows on the smallest tables."""

import duckdb
import pytest

from tamarack.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(values):
    return sorted(map(repr, values))


def test_every_query_has_a_twin():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    got = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(tuple(r[c] for c in columns) for r in df.collect()) == rows(got.fetchall())


def test_flagship(spark):
    found = registry.flagship(spark, SF).collect()
    assert found and [r["rank"] for r in found] == list(range(1, len(found) + 1))
