"""Queries of the entry module against their SQL in DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["bars_ohlcv", "event_day_bars", "phase_panel_types", "holm_adjusted", "regimes_total", "fixed_sequence_gate", "independence_audit", "coverage_audit", "json_explode", "business_day_purge"]


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(plain(r[c]) for c in names) for r in got.collect()) == sorted(tuple(map(plain, r)) for r in cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 6


def test_stream_bars(spark, tmp_path):
    from phasegrid.streaming.bars import stream_bars

    events = spark.read.parquet(f"{SF}/events.parquet").withColumnRenamed("ts", "t").selectExpr("event_id", "user_id", "value", "cast(t as timestamp) ts")
    events.write.parquet(str(tmp_path / "in"))
    q = stream_bars(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("append").format("memory").queryName("bars").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("bars")
    assert got.count() > 0 and got.filter("low > high").count() == 0
