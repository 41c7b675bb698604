"""Stored sketches against exact counts: error bound, any order of union, repeated parts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logmill.operators import sketches

SCHEMA = "host string, ts timestamp, template string"


@pytest.fixture(scope="module")
def many(spark):
    """200,000 lines of two hosts, one of them with nine in ten; some 60,000 templates and a few frequent ones."""
    n, k = F.col("id"), F.pmod(F.xxhash64("id"), F.lit(60_000))
    return spark.range(200_000, numPartitions=4).select(
        F.when(n % 10 == 0, "small").otherwise("hot").alias("host"),
        F.timestamp_seconds(1_704_067_200 + n % 36_000).alias("ts"),
        F.when(n % 3 == 0, F.concat(F.lit("t"), (k % 5).cast("string"))).otherwise(F.concat(F.lit("t"), k.cast("string"))).alias("template"),
    )


@pytest.mark.parametrize("lg_k", [10, 12, 14])
def test_error_bound_after_storing_and_uniting(spark, many, tmp_path, lg_k):
    sketches.by_cycle(many, lg_k=lg_k).write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    assert stored.count() == 40
    want = {r.host: r for r in many.groupBy("host").agg(F.count("*").alias("lines"), F.countDistinct("template").alias("n")).collect()}
    by_hour = sketches.united(stored, "host", F.floor(F.col("cycle") / 2).alias("hour"))
    for found in (sketches.united(stored, "host"), sketches.united(by_hour, "host")):  # at once, and in two steps
        got = {r.host: r for r in sketches.ratios(found).collect()}
        for host, r in want.items():
            assert got[host].lines == r.lines
            assert abs(got[host].templates / r.n - 1) < 4 * 1.04 / 2 ** (lg_k / 2)
            assert got[host].ratio == got[host].lines / got[host].templates
    every = sketches.ratios(sketches.united(stored)).first()
    assert every.lines == 200_000 and abs(every.templates / many.select("template").distinct().count() - 1) < 4 * 1.04 / 2 ** (lg_k / 2)
    twice = sketches.ratios(sketches.united(stored.union(stored), "host")).collect()
    assert all(abs(r.templates / want[r.host].n - 1) < 4 * 1.04 / 2 ** (lg_k / 2) and r.lines == 2 * want[r.host].lines for r in twice)


def test_the_shuffle_has_a_row_for_each_task_and_cycle_only(many):
    plan = sketches.by_cycle(many)._jdf.queryExecution().executedPlan().toString()
    assert "partial_hll_sketch_agg" in plan.lower() and plan.count("Exchange hashpartitioning") == 1


def test_edges(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("a", at, "x"), ("a", at, "x"), ("a", at, None), ("b", at, None), (None, at, "y"), ("c", None, "z"), ("a", at + dt.timedelta(hours=1), "x"), ("a", at + dt.timedelta(hours=2), "y"), ("a", at + dt.timedelta(hours=2), "")]
    stored = sketches.by_cycle(spark.createDataFrame(rows, SCHEMA).withColumn("sketch", F.lit(1)))
    got = {r.host: (r.lines, r.templates, r.ratio) for r in sketches.ratios(sketches.united(stored, "host")).collect()}
    assert got == {"a": (6, 3, 2.0), "b": (1, 0, None), None: (1, 1, 1.0), "c": (1, 1, 1.0)}
    assert [r.fresh for r in sketches.new_templates(stored).where("host = 'a'").orderBy("cycle").collect()] == [1, 0, 2]
    assert sketches.ratios(sketches.united(sketches.by_cycle(spark.createDataFrame([], SCHEMA)), "host")).collect() == []
