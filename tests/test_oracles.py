"""Every query against its SQL on the smallest tables."""

import math
import os
from glob import glob

import duckdb
import pytest

import __spark_entry__ as entry

DIR = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = (a | b for a, b in zip((entry.catalog.queries(), entry.catalog.oracle_sql()), entry.catalog.examples()))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, DIR)
    got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    if name not in SQL:
        assert got
        return
    result = duck.execute(SQL[name])
    columns = [d[0] for d in result.description]
    want = rows(columns, result.fetchall())
    assert sorted(frame.columns) == sorted(columns)
    assert len(got) == len(want)
    assert got == want
    kinds = dict(zip(columns, (str(d[1]) for d in result.description)))
    pairs = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for column, kind in frame.dtypes:
        assert pairs.get(kind) == kinds[column], (column, kind, kinds[column])
    assert want or name == "room_nav_points", "the query should return rows on the smallest tables"
