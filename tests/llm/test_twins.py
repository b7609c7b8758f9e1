import os

import duckdb
import pytest

from shelfspark.llm.queries import LLM_ORACLES, LLM_QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    cursor = con.execute(LLM_ORACLES[name])
    columns = [column[0] for column in cursor.description]
    expected = sorted((dict(zip(columns, row)) for row in cursor.fetchall()), key=lambda row: repr(sorted(row.items())))
    got = sorted((row.asDict() for row in LLM_QUERIES[name](spark, FOLDER).collect()), key=lambda row: repr(sorted(row.items())))
    assert got == expected and got
