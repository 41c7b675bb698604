"""Alarms on streams against the batch forms and plain loops, over restarts."""

import datetime as dt
import random
import time

from pyspark.sql import functions as F
from test_agent import cut

from logmill.functions import severity
from logmill.operators import envelopes
from logmill.streaming import patterns as streaming
from logmill.streaming import watch

T0 = dt.datetime(2024, 1, 1, 12)
RECORDS = "n long, host string, received_at timestamp"
LINES = "event_id long, ts timestamp, host string, raw string"


def put(spark, path, batches, schema, first=0):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{first + i:03}")


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def run(df, tmp_path):
    return df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()


def records(n):
    rng, at, out = random.Random(n), {h: 0.0 for h in "gh"}, []
    for i in range(n):
        host = rng.choice("gh")
        at[host] += rng.choice([0, 1, 20, 34.9, 35, 35.1, 90])
        out.append((i, host, T0 + dt.timedelta(minutes=at[host])))
    return out


def test_silence_equals_the_batch_over_a_restart(spark, tmp_path):
    rows, path, number = [*records(80), (80, None, T0), (81, "g", None)], str(tmp_path / "in"), 0
    for part in (cut(rows, 6)[:3], cut(rows, 6)[3:]):
        put(spark, path, part, RECORDS, number)
        number += len(part)
        q = run(watch.silence(stream(spark, path, RECORDS)), tmp_path)
        streaming.settle(q, 120)
        q.stop()
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    want = [tuple(r) for r in envelopes.silence(spark.createDataFrame(rows, RECORDS).where("host is not null and received_at is not null")).collect()]
    assert want and sorted(r for r in got if r[2]) == sorted(want)
    # all are silent by the clock of today, and that was told
    last = {h: max(r[2] for r in rows if r[1] == h and r[2]) for h in "gh"}
    assert {(h, at) for h, at, to, _ in got if to is None} >= set(last.items())


def test_a_stopped_host_is_told_without_input(spark, tmp_path):
    path, now = str(tmp_path / "in"), dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    put(spark, path, [[(1, "stopped", now), (2, "busy", now + dt.timedelta(hours=5))]], RECORDS)
    q = run(watch.silence(stream(spark, path, RECORDS), minutes=0.15), tmp_path)
    end, found = time.time() + 60, []
    while time.time() < end and not found:
        time.sleep(0.5)
        found = spark.read.schema(watch.SILENCE).parquet(str(tmp_path / "out")).collect() if (tmp_path / "out/_spark_metadata").exists() else []
    time.sleep(3)
    q.stop()
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.host, r.silent_from, r.silent_to, r.minutes) for r in found] == [("stopped", now, None, None)]  # once
    assert dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) - now > dt.timedelta(seconds=9)


def test_incidents_against_a_loop_and_state_that_goes(spark, tmp_path):
    rng, path = random.Random(5), str(tmp_path / "in")
    rows = [(i, T0 + dt.timedelta(seconds=rng.choice([60, 0, -200]) + 45 * i), rng.choice("ggh"), rng.choice(["panic: at once", "all is well", "all is well", "a line"])) for i in range(160)]
    rows += [(900 + i, T0 + dt.timedelta(seconds=1800 + s), "g", "panic: again") for i, s in enumerate((0, 0, 1800))]  # ties, and one on the edge
    rows = sorted(rows, key=lambda r: r[1])
    far = [[(1000 + i, T0 + dt.timedelta(days=1 + i), "z", "end")] for i in range(4)]
    put(spark, path, [*cut(rows, 4), *far], LINES)
    q = run(watch.incidents(stream(spark, path, LINES)), tmp_path)
    streaming.settle(q, 180)
    left = sum(o["numRowsTotal"] for o in q.lastProgress["stateOperators"])
    q.stop()
    got = {(r.incident, r.near) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    hot = [r for r in rows if "panic" in r[3]]
    want = {(h[0], sum(r[2] == h[2] and abs((r[1] - h[1]).total_seconds()) <= 1800 for r in rows)) for h in hot}
    assert got == {(h[0], sum(r[2] == h[2] and abs((r[1] - h[1]).total_seconds()) <= 1800 for r in rows)) for h in hot}
    assert left <= 4  # only the lines that keep time


def test_incidents_of_a_table(spark):
    assert spark.range(1).select(severity.any_of(severity.CRITICAL, F.lit("panic: x"))).first()[0]
    empty = spark.createDataFrame([], LINES)
    assert watch.incidents(empty).collect() == []
    one = spark.createDataFrame([(1, T0, "g", "panic: x"), (2, T0, None, "panic: y"), (3, None, "g", "panic: z"), (4, T0, "g", None)], LINES)
    assert [(r.incident, r.near) for r in watch.incidents(one).collect()] == [(1, 2)]


def test_first_records_only(spark, tmp_path):
    rows = [(i % 7, "gh"[i % 2], T0 + dt.timedelta(minutes=i)) for i in range(60)]
    put(spark, str(tmp_path / "in"), cut(rows, 5), RECORDS)
    q = run(watch.first_seen(stream(spark, str(tmp_path / "in"), RECORDS), ["host", "n"]), tmp_path)
    streaming.settle(q, 120)
    q.stop()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted(tuple(r) for r in envelopes.idempotent(spark.createDataFrame(rows, RECORDS), ["host", "n"], "received_at").collect())
    assert [(n, h) for n, h, _ in got] == [(n, h) for n, h, _ in want] and len(got) == 14
