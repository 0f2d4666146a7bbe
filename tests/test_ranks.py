"""Queries that rank more results than one task puts in order give the rows of their SQL."""

import duckdb
import pytest

from tamarack.plans import registry

TABLES = {
    "documents": """SELECT i AS doc_id, '' AS text, ['de', 'en', 'es', 'fr'][i % 4 + 1] AS lang, 'src' || i % 20 AS source, i * 7919 % 5000 AS n_chars FROM range(310000) r(i)""",
    "part": "SELECT i AS p_partkey, 'bolt 1' AS p_name, CAST(i * 31 % 50 AS INTEGER) AS p_size FROM range(200000) r(i)",
    "events": "SELECT i AS event_id, i * 13 % 700 AS user_id, 'view' || i % 5 AS event_type FROM range(4000) r(i)",
}


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    folder, con = tmp_path_factory.mktemp("large"), duckdb.connect()
    for name, rows in TABLES.items():
        con.execute(f"COPY ({rows}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return folder, con


@pytest.mark.parametrize("name", ["op_m3_by_size", "op_m3_sources", "op_r5_relevance", "op_r6_natural_sort", "op_r7_sort_modified"])
def test_all_results_are_ranked(spark, large, tmp_path, name):
    folder, con = large
    registry.queries()[name](spark, str(folder)).write.parquet(f"{tmp_path}/got")
    spark.catalog.clearCache()
    con.execute(f"CREATE OR REPLACE TABLE want AS {registry.oracle_sql()[name]}")
    columns = ", ".join(c[0] for c in con.execute("DESCRIBE want").fetchall())
    got = f"SELECT {columns} FROM '{tmp_path}/got/*.parquet'"
    assert con.execute("SELECT min(rank), max(rank) > 200000 FROM want").fetchone() == (1, True)
    assert con.execute(f"SELECT count(*) FROM (({got} EXCEPT ALL FROM want) UNION ALL (FROM want EXCEPT ALL {got}))").fetchone() == (0,)
