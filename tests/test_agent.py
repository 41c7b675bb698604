"""Lines to envelopes on a stream: bounded patterns, cycles, numbers, flushes and restarts against plain loops."""

import datetime as dt
import json
import random
import time
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from logmill.operators import dedup
from logmill.sources import readers
from logmill.streaming import agent
from logmill.streaming import patterns as streaming

T0 = dt.datetime(2024, 1, 1, 12)
SCHEMA = "event_id long, ts timestamp, host string, source string, raw string, command string"
TEXTS = [("alpha", "info"), ("beta", "info"), ("panic: gamma", "critical"), ("segfault at delta", "error"), ("epsilon", "info"), ("zeta", "info")]


def made(n, flushes=()):
    """Lines of two hosts in order of their numbers; times go forth and back."""
    rng = random.Random(n)
    rows = []
    for i in range(n):
        host = rng.choice("gh")
        if i in flushes:
            rows.append((i, T0, host, None, None, "flush"))
        else:
            text = rng.choice(TEXTS)[0]
            rows.append((i, T0 + dt.timedelta(seconds=rng.choice([0, 1, 4, 30]) + i), host, "s", f"Jan  1 12:00:00 {host} app: {text} {i}", None))
    return rows


def key_of(row):
    text = row[4].split(": ", 1)[1].rsplit(" ", 1)[0]
    return (f"{text} <NUM>", dict(TEXTS)[text], "s")


def put(spark, path, batches, first=0):
    for i, rows in enumerate(batches):
        rows = random.Random(i).sample(rows, len(rows))  # a batch comes in any order
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/{first + i}")


def source(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def cut(rows, parts):
    at = [len(rows) * i // parts for i in range(parts + 1)]
    return [rows[a:z] for a, z in zip(at, at[1:])]


def micros(t):
    return int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def told(rows):
    return sorted((r.host, r.template, r["count"], micros(r.ts_first), micros(r.ts_last), tuple(r.sample_raws), bool(r.early)) for r in rows)


@pytest.mark.parametrize("most", [3, 50])
def test_stream_equals_bounded_groups_over_a_restart(spark, tmp_path, most):
    rows, path, cp = made(240), str(tmp_path / "in"), str(tmp_path / "cp")
    batches, number = cut(rows, 5), 0
    for part in (batches[:3], batches[3:]):
        put(spark, path, part, number)
        number += len(part)
        found = streaming.stateful_patterns(source(spark, path).drop("command"), order="event_id", gap_s=10, most=most, idle_s=3600)
        run = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", cp).start()
        rest = streaming.stop(run, spark, cp).withColumn("early", F.lit(False)).collect()
    want = []
    for host in "gh":
        own = [r for r in rows if r[2] == host]
        for _, key, s, early in streaming.bounded_groups(host, [micros(r[1]) for r in own], [key_of(r) for r in own], [r[4] for r in own], most, 10_000_000):
            want.append((host, key[0], s[0], s[1], s[2], tuple(s[4]), early))
    got = told([*spark.read.parquet(str(tmp_path / "out")).collect(), *rest])
    assert got == sorted(want) and any(x[-1] for x in got) == (most == 3)


def slow_envelopes(rows, most, most_events, gap):
    """Of each host the envelopes that its flushes close: (number, [(template, count) kept], sums by severity)."""
    out = {}
    for host in "gh":
        held, events, done = OrderedDict(), [], []
        for r in (r for r in rows if r[2] == host):
            if r[5]:
                events += [(k, s[0]) for k, s in held.items()]
                held.clear()
                state = dedup.fold_cap([k[1] for k, _ in events], most_events)
                sums = {x: sum(n for (k, n), (_, o) in zip(events, state) if o != "skipped" and k[1] == x) for x in ("critical", "error", "info")}
                done.append((len(done), [(k[0], n) for (k, n), (_, o) in zip(events, state) if o == "kept"], sums))
                events = []
            else:
                events += [(k, s[0]) for k, s, _ in agent.bounded(held, [micros(r[1])], [key_of(r)], [r[4]], most, gap * 1_000_000, 3)]
        out[host] = done
    return out


@pytest.mark.parametrize("most_events", [6, 1000])
def test_envelopes_and_their_numbers_over_a_restart(spark, tmp_path, most_events):
    rows, path, cp, to = made(300, {40, 90, 91, 150, 190, 220, 260, 299}), str(tmp_path / "in"), str(tmp_path / "cp"), str(tmp_path / "out")
    batches, number = cut(rows, 4), 0
    for part in (batches[:2], batches[2:]):
        put(spark, path, part, number)
        number += len(part)
        found = agent.envelopes(source(spark, path), order="event_id", host_id=F.md5("host"), boot_id=F.lit("b"), gap_s=10, most=4, idle_s=3600, cycle_s=3600, most_events=most_events)
        run = agent.write_envelopes(found, to, cp).start()
        streaming.settle(run)
        run.stop()
    read = readers.spooled_lines(spark, to).collect()
    assert not any(r.bad for r in read) and [r.name for r in read] == sorted(r.name for r in read) and all(r.ms > 0 for r in read)
    want = slow_envelopes(rows, 4, most_events, 10)
    for host, own in want.items():
        got = sorted((r.envelope for r in read if r.envelope.cycle.host == host), key=lambda e: e.cycle.seq)
        assert [e.cycle.seq for e in got] == [n for n, *_ in own]
        for e, (_, events, sums) in zip(got, own, strict=True):
            body = json.loads(e.body[0].data) if e.body else []
            assert [(x["template"], x["count"]) for x in body] == events and len(e.body) == e.headers.total_sections == bool(events)
            counts = e.headers.counts
            assert {k: counts.by_severity[k] for k in sums} == sums and sum(counts.by_category.values()) == sum(sums.values())
            assert all(len(x["fingerprint"]) == 16 and x["category"] for x in body) and e.cycle.window.startswith(e.cycle.ts)
    assert sum(len(x) for x in want.values()) == 8


def test_cycles_end_by_the_clock_and_empty_ones_have_a_number_too(spark, tmp_path):
    path, cp, to = str(tmp_path / "in"), str(tmp_path / "cp"), str(tmp_path / "out")
    put(spark, path, [[r for r in made(20) if r[2] == "h"]])
    n = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(path).count()
    found = agent.envelopes(source(spark, path), order="event_id", host_id=F.lit("i"), boot_id=F.lit("b"), cycle_s=0.5)
    run = agent.write_envelopes(found, to, cp).start()
    until, read = time.time() + 90, []
    while time.time() < until and len(read) < 3:
        time.sleep(1)
        try:
            read = readers.spooled_lines(spark, to).collect()
        except Exception:  # nothing is written yet
            read = []
    run.stop()
    own = sorted((r.envelope for r in readers.spooled_lines(spark, to).collect()), key=lambda e: e.cycle.seq)
    assert [e.cycle.seq for e in own] == list(range(len(own))) and len(own) >= 3
    assert sum(sum(e.headers.counts.by_severity) for e in own) == n and own[-1].body == []
