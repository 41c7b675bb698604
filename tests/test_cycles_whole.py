"""Lines are dealt evenly to tasks, and cycles no longer than the gap are counted where the lines are read, as in SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF
from logmill.operators import dedup
from logmill.plans import catalogue

COUNTS = ["error_surge", "cycle_window_30m", "cycle_counts_by_severity"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Four files of 240, 1, 1 and 1 events; times at the edges of cycles, before 1970 and (of lines of the journal) null, rows that are there twice."""
    n = F.col("id")
    second = F.when(n % 7 == 3, F.when(n % 4 > 0, n * 31)).when(n % 9 == 2, -1800 * n).when(n % 3 == 0, 1800 * (n % 4)).otherwise(n * 31)
    folder = tmp_path_factory.mktemp("odd")
    rows = spark.range(0, 1000, 1, 4).where("id < 240 or id % 250 = 0").withColumn("id", F.when(n % 10 == 0, n - n % 20).otherwise(n))
    rows.select(n.alias("event_id"), F.timestamp_seconds(second).cast("timestamp_ntz").alias("ts"), (n % 3).alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props")).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_lines_are_dealt_evenly(spark, odd):
    read = catalogue.events(spark, odd)
    assert read.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    held = [r["count"] for r in catalogue.lines(spark, odd).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == read.count() == 243 and max(held) < 60


@pytest.mark.parametrize("name", [*COUNTS, "cycle_counts_by_category", "alert_rules"])
def test_as_in_sql(spark, odd, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS FROM read_parquet('{odd}/events.parquet/*.parquet')")
    got = catalogue.QUERIES[name](spark, odd)
    want = db.sql(catalogue.ORACLES[name])
    assert got.columns == want.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("name", COUNTS)
def test_lines_are_counted_before_they_are_sent(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.rindex("Aggregate [") :]
    assert "Window [" not in below


def test_sessions_of_a_cycle_are_numbered(spark):
    rows = [(1, "a", 10), (2, "a", 1700), (3, "a", 1800), (4, "a", None), (5, "a", None), (6, "b", None)]
    lines = spark.createDataFrame(rows, "event_id long, k string, s long").select("event_id", "k", F.timestamp_seconds("s").alias("ts"), F.concat("k", "event_id").alias("raw"))
    got = dedup.dedup(lines, ["k"], 1800, cycle_s=1800, carry=("event_id",))
    assert sorted((r.k, r.cycle is None, r.cycle or 0, r.session, r["count"], r.event_id, r.sample_raws) for r in got.collect()) == [
        ("a", False, 0, 1, 2, 1, ["a1", "a2"]),
        ("a", False, 1, 1, 1, 3, ["a3"]),
        ("a", True, 0, 1, 1, 4, ["a4"]),
        ("a", True, 0, 2, 1, 5, ["a5"]),
        ("b", True, 0, 1, 1, 6, ["b6"]),
    ]
