"""What the queries read of a generated line is computed once for each row."""

import pytest
from pyspark.sql import functions as F

from conftest import SF
from logmill.plans import catalogue
from logmill.sources import synth


@pytest.mark.parametrize("name", ["event_patterns", "categorize_program_gate", "cycle_window_30m", "error_surge", "recent_events_sos", "gold_uid_match"])
def test_a_plan_fills_in_its_messages_once_for_each_scan(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("sshd[@pid]: Accepted password") <= plan.count("Relation [")


def test_a_filter_stays_above_a_bound_column(spark):
    df = synth.bound(spark.range(4), low=F.when(F.col("id") > 1, F.lower(F.concat(F.lit("A"), F.col("id").cast("string"))))).where("low <> 'a2'")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert [r.low for r in df.collect()] == ["a3"]
    assert synth.bound(spark.range(2), x=F.lit(None).cast("string")).count() == 2
