"""Distinct templates are exact where there are more of them than a sketch tells apart, held against the queries' SQL."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from logmill.operators import sketches
from logmill.plans import catalogue


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """6,000 events of one host in two cycles of a day, then 20 in a later one: some 800 templates."""
    n = F.col("id")
    at = F.timestamp_seconds(1_704_067_200 + F.when(n < 6_000, n % 3_600).otherwise(40_000)).cast("timestamp_ntz")
    folder = tmp_path_factory.mktemp("crowded")
    spark.range(6_020, numPartitions=3).select(n.alias("event_id"), at.alias("ts"), F.lit(5).cast("long").alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props")).write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["dedup_ratio_by_day", "fresh_templates"])
def test_as_in_sql(spark, crowded, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS FROM read_parquet('{crowded}/events.parquet/*.parquet')")
    got = catalogue.QUERIES[name](spark, crowded)
    want = db.sql(catalogue.ORACLES[name])
    assert got.columns == want.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())
    assert name != "dedup_ratio_by_day" or got.first().templates > 2**sketches.LG_K / 8


def test_edges(spark):
    at = dt.datetime(2024, 1, 1)
    hour = dt.timedelta(hours=1)
    rows = [("a", at, "x"), ("a", at, "x"), ("a", at, None), ("a", at + hour, "x"), ("a", at + hour, "y"), ("a", at + 2 * hour, "z"), ("a", at + 3 * hour, "x"), ("a", at + 3 * hour, "z"), ("b", at, None), (None, at, "y")]
    own = spark.createDataFrame(rows, "host string, ts timestamp, template string")
    assert {tuple(r) for r in sketches.exact_ratios(own, "host").collect()} == {("a", 8, 3, 8 / 3), ("b", 1, 0, None), (None, 1, 1, 1.0)}
    assert [r.fresh for r in sketches.exact_new_templates(own).where("host = 'a'").orderBy("cycle").collect()] == [1, 1, 1, 1]
    assert {r.fresh for r in sketches.exact_new_templates(own).where("host is null or host = 'b'").collect()} == {0, 1}
    assert sketches.exact_ratios(own.limit(0), "host").collect() == []
