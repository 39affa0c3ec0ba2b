"""Every registered query against its SQL counterpart on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not present")


def comparable(row, columns, order):
    values = []
    for name in order:
        value = row[columns.index(name)]
        if isinstance(value, float):
            value = None if math.isnan(value) else round(value, 6)
        values.append(value)
    return repr(tuple(values))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, duck, name):
    frame = entry.queries()[name](spark, DATA)
    rows = frame.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cursor = duck.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    expected = sorted(comparable(r, columns, frame.columns) for r in cursor.fetchall())
    assert sorted(comparable(tuple(r), frame.columns, frame.columns) for r in rows) == expected


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0


def test_stream_reads_a_folder_of_part_files(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    got = entry.queries()["stream_upsert"](spark, str(tmp_path)).count()
    assert got == events.select("user_id").distinct().count()
