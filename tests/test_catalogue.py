"""Every query with SQL against DuckDB, on the smallest tables; and that the others give rows."""

import duckdb
import pytest

from boxloom.plans import catalogue
from boxloom.plans.fixtures import TABLES

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(str(round(r[i], 6) + 0.0 if isinstance(r[i], float) else r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in SQL:
        assert got
        return
    exp = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(exp.columns)
    assert rows(df.columns, got) == rows(exp.columns, exp.fetchall())


def test_entry(spark):
    import __spark_entry__

    r = __spark_entry__.entry(spark).collect()
    assert len(r) == 1 and 0 <= r[0]["ap"] <= 1


def test_load_proposals_takes_all_images(spark):
    sf = "/root/testdata/sf0.1"
    got = catalogue.s13_load_proposals(spark, sf)
    assert got.select("image_id").distinct().count() == spark.read.parquet(f"{sf}/customer.parquet").count() == 15_000
    assert got.where("box_id IS NOT NULL").agg({"image_id": "max"}).collect()[0][0] > 2000
