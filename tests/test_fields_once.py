"""What the extractors and the readers of envelopes share is computed once for each row."""

from pyspark.sql import functions as F

from conftest import SF
from logmill.functions import normalize
from logmill.operators import dedup
from logmill.plans import catalogue


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fields_strip_their_line_once(spark):
    lines = spark.createDataFrame([("Jan  5 10:00:00 host1 sshd[12]: pid=7 code=3 {\"status\": \"late\"}",), ("plain",), (None,)], "first_raw string")
    told = dedup.with_fields(lines)
    stripped = plan_of(lines.select(normalize.strip_prefix(F.col("first_raw")))).count("regexp_replace")
    assert 0 < plan_of(told).count("regexp_replace") <= stripped
    assert [r.fields for r in told.select("fields").collect()] == [{"pid": "7", "code": "3", "status": '"late"'}, {}, {}]


def test_received_envelopes_are_read_once(spark):
    plan = plan_of(catalogue.QUERIES["recv_failed_users"](spark, SF))
    assert plan.count("THEN from_json(") == 1
    assert not [x for x in plan.splitlines() if "Join" in x and "from_json(" in x]
