"""Every query with SQL gives what DuckDB gives; plus partition invariance."""

import os

import duckdb
import pytest

import __spark_entry__
from linefacts.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r)) for r in df.select(*columns).collect())
    rel = duck.sql(catalogue.SQL[name])
    assert sorted(rel.columns) == columns
    picked = ", ".join(f'"{c}"' for c in columns)
    assert got == sorted(str(r) for r in duck.sql(f"SELECT {picked} FROM ({catalogue.SQL[name]}) q").fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.SQL) <= set(__spark_entry__.oracle_sql()) and set(catalogue.QUERIES) <= set(__spark_entry__.queries())


def test_partitions_do_not_matter(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").repartition(3).write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("report_order", "grand_total", "alias_groups", "fingerprint"):
        a, b = (sorted(map(str, catalogue.QUERIES[name](spark, d).collect())) for d in (SF, str(tmp_path)))
        assert a == b
