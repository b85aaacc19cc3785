"""Every query that has SQL gives the rows that DuckDB gives; the others run and give rows."""

from __future__ import annotations

import math
import os

import duckdb
import pytest
from pyspark.sql import SparkSession

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC"}
    return SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return "null" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = duck.execute(SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(map(plain, r)) for r in got.fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.select(*columns).collect()) == want


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(SQL)))
def test_gives_rows(spark, name):
    df = entry.queries()[name](spark, SF)
    assert len(df.collect()) > 0 and len(set(df.columns)) == len(df.columns)


def test_stream_counts_match_batch(spark):
    from pagemill.operators.history import clip_counts
    from pagemill.sources.tables import read_table
    from pagemill.streaming.counts import clip_counts_stream

    events = read_table(spark, SF, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{SF}/events.parquet*")
    query = clip_counts_stream(stream).writeStream.format("memory").queryName("weekly").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("weekly").collect())) == sorted((r[0], r[1]) for r in clip_counts(events, "weekly").collect())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
