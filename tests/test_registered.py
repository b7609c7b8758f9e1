import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUICK = [
    "f2_truncate", "f5_parse_money", "f15_stem", "f21_detail_json", "w1_first_row_wins",
    "a7_duplicate_groups", "j2_pitch_cache", "i1_term_index", "a1_category_summary", "a2_vocabulary",
]


def plain(value):
    return round(float(value), 6) if isinstance(value, float) else value


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")
@pytest.mark.parametrize("name", QUICK)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    found = entry.queries()[name](spark, FOLDER)
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [column[0] for column in cursor.description]
    expected = [dict(zip(columns, map(plain, row))) for row in cursor.fetchall()]
    got = [{k: plain(v) for k, v in row.asDict().items()} for row in found.collect()]
    key = lambda row: repr(sorted(row.items()))
    assert sorted(got, key=key) == sorted(expected, key=key)


def test_every_twin_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
