"""The contract queries against their SQL on the smallest tables, and connect() end to end."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from claimweave.plans import api, contract

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    other = duck.sql(contract.oracle_sql()[name])
    assert sorted(other.columns) == columns
    at = [other.columns.index(c) for c in columns]
    assert mine == sorted((tuple(plain(r[i]) for i in at) for r in other.fetchall()), key=repr)


def test_connect_reports_a_route(spark):
    text = "Rent control is a price ceiling. A price ceiling is a housing shortage cause. A housing shortage cause is urban sprawl. Urban sprawl is a commute problem."
    blocks = spark.createDataFrame([(1, 1, "", "doc|site.org/1", text), (2, 2, "", "doc|site.org/2", "Urban sprawl is a rent control topic. Rent control is urban sprawl.")], "block_id long, ord long, url string, source string, content string")
    got = api.connect(spark, "rent control", "urban sprawl", blocks, n_walks=8)
    assert got.walks.where("reason = 'endpoint'").count() > 0 and "## Sources" in got.report and "site.org" in got.report
    assert got.core.count() > 0 and got.arguments.count() <= 3
    nothing = api.connect(spark, "volcano", "glacier", blocks, n_walks=4)
    assert "No supported connection" in nothing.report
    assert blocks.where(F.lit(False)).count() == 0


def test_entry_names_columns(spark):
    import __spark_entry__ as e

    assert {"rank", "side", "source_ref", "evidence"} <= set(contract.connect_subjects(spark, SF).columns)
    assert set(e.oracle_sql()) <= set(e.queries())
