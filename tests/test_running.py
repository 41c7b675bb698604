"""Running sums over stretches, merged lines, byte budgets and the cap of a cycle against plain loops."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logmill.functions import classify
from logmill.operators import dedup, envelopes, running
from logmill.sources import readers


@pytest.fixture
def short(monkeypatch):
    monkeypatch.setattr(running, "LINES", 7)


def test_sums_go_on_from_stretch_to_stretch(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, 1, 2, 5])) for i in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, n long").repartition(6)
    for keys in (["k"], []):
        got = {(r.k, r.i): r.s for r in running.running_sum(df, F.col("n"), "s", keys=keys, order=["i"], stretch=F.floor(F.col("i") / 9)).collect()}
        sums, want = {}, {}
        for k, i, n in sorted(rows, key=lambda r: r[1]):
            at = k if keys else 0
            sums[at] = sums.get(at, 0) + (n or 0)
            want[k, i] = sums[at]
        assert got == want
        few = running.running_sum(df, F.col("n"), "s", keys=keys, order=["i"], stretch=F.floor(F.col("i") / 9), most=60)
        assert {(r.k, r.i): r.s for r in few.collect()} == {x: s for x, s in want.items() if s <= 60}
    assert running.running_sum(df.limit(0), F.col("n"), "s", keys=["k"], order=["i"], stretch=F.col("i")).count() == 0


def slow_merge(lines):
    out = []
    for no, raw in lines:
        if not out or raw.startswith("Jan  1 "):
            out.append([no, []])
        out[-1][1].append(raw)
    return sorted((no, "\n".join(x), len(x)) for no, x in out)


def test_one_file_on_many_tasks_is_merged_as_in_one(spark, short):
    rng = random.Random(9)
    lines = {f: [(i, f"Jan  1 00:00:00 h app: {i}" if rng.random() < p else f"  at {i}") for i in range(200)] for f, p in (("long", 0.2), ("one event", 0.0), ("all", 1.0))}
    df = spark.createDataFrame([(f, i, raw) for f, own in lines.items() for i, raw in own], "file string, line_no long, raw string").repartition(5)
    got = readers.merge_lines(df)
    for f, own in lines.items():
        assert sorted((r.line_no, r.raw, r.n_lines) for r in got.where(F.col("file") == f).collect()) == slow_merge(own)


def test_one_host_on_many_tasks_keeps_to_its_budget(spark):
    rows = [("h", i, "x" * (i % 13)) for i in range(300)] + [("g", i, "é") for i in range(5)]
    df = spark.createDataFrame(rows, "host string, i long, raw string").repartition(4)
    got = {(r.host, r.i): r.used_bytes for r in envelopes.byte_budget(df, 500, "host", "i", F.floor(F.col("i") / 8)).collect()}
    want, used = {}, {"h": 0, "g": 0}
    for host, i, raw in rows:
        used[host] += len(raw.encode()) + 1
        if used[host] <= 500:
            want[host, i] = used[host]
    assert got == want and len(got) > 60
    plan = envelopes.byte_budget(df, 500, "host", "i", F.floor(F.col("i") / 8))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window ") == 2 and "hashpartitioning(host" in plan and "_stretch" in plan
    numbers = envelopes.numbered(df.withColumnRenamed("host", "source").withColumn("received_at", F.timestamp_seconds("i")), running.by_time("received_at")).collect()
    assert sorted((r.source, r.number) for r in numbers) == sorted([("h", i + 1) for i in range(300)] + [("g", i + 1) for i in range(5)])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.booleans(), max_size=60), st.integers(1, 12))
def test_two_numbers_tell_the_fold(critical, most):
    want = [s for _, s in dedup.fold_cap(["critical" if c else "info" for c in critical], most)]
    n = len(critical)
    kept, until = dedup.cap_state(np.array(critical, bool), most) if n > most else (n, n)
    urgent, common, got = 0, 0, []
    for i, c in enumerate(critical):
        urgent, common = urgent + c, common + (not c)
        if n <= most or (sum(critical) - urgent < most - kept if c else n - sum(critical) - common < kept):
            got.append("kept")
        else:
            got.append("skipped" if not c and i + 1 > until else "evicted")
    assert got == want


def test_cap_of_cycles(spark):
    rng = random.Random(2)
    cycles = {c: [rng.choices(["critical", "info", "warn", None], [p, 3, 1, 1])[0] for _ in range(n)] for c, p, n in ((0, 1, 80), (1, 9, 90), (2, 0, 70), (3, 2, 9), (None, 4, 60))}
    rows = [("h", c, i, s) for c, own in cycles.items() for i, s in enumerate(own)]
    df = spark.createDataFrame(rows, "host string, cycle long, event_id long, severity string").repartition(4)
    got = {(r.cycle, r.event_id): r.outcome for r in dedup.cycle_cap(df, ["host", "cycle"], 10).collect()}
    assert got == {(c, i): s for c, own in cycles.items() for i, s in dedup.fold_cap(own, 10)}
    assert set(got.values()) == {"kept", "evicted", "skipped"}


def test_each_category_has_one_remedy():
    named = [c for c, _ in envelopes.PLAYBOOK]
    assert set(named) == {r.category for r in classify.RULES} - {classify.DEFAULT} and len(named) == len(set(named)) and all(x for _, x in envelopes.PLAYBOOK)
