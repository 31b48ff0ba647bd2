"""Every registered query against its SQL on the smallest data set."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from pagemill.plans import file_oracles, file_queries  # noqa: F401
from pagemill.plans.oracles import ORACLES
from pagemill.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=lambda r: [(v is None, str(v)) for v in r])


def test_all_are_checked():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    expected = canonical(columns, result.fetchall())
    assert canonical(df.columns, df.collect()) == expected


def test_listings_are_sorted(spark):
    files = [tuple(r) for r in QUERIES["file_listing"](spark, SF_DIR).collect()]
    assert files == sorted(files, key=lambda f: (-f[1], f[0]))
    names = [r.name for r in QUERIES["file_listing_by_name"](spark, SF_DIR).collect()]
    assert names == sorted(names)


def test_entry(spark):
    assert entry.entry(spark).columns == ["page_id", "url", "title"]
