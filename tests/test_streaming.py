"""Sessions without loss, bounded groups, delivery with retries and replay."""

import datetime as dt
import gzip
import json
import time
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from test_log_engine import as_stream

from logmill.operators import dedup, wire
from logmill.plans import catalogue
from logmill.sources import readers
from logmill.streaming import agent, delivery
from logmill.streaming import patterns as streaming

T0 = dt.datetime(2024, 1, 1, 12)
SCHEMA = "event_id long, ts timestamp, host string, source string, raw string"


def line(i, seconds, host="h", text="value"):
    return (i, T0 + dt.timedelta(seconds=seconds), host, "s", f"Jan  1 12:00:00 {host} app: {text} {i} status=ok")


def run_stream(spark, tmp_path, batches, **options):
    out = streaming.stateful_patterns(as_stream(spark, str(tmp_path / "in"), batches), order="event_id", **options)
    name = f"t{tmp_path.name}".replace("-", "_")
    run = out.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    return run, name, str(tmp_path / "cp")


def test_a_late_line_is_merged_and_never_moves_the_end_back(spark, tmp_path):
    batches = [[line(1, 0), line(2, 5)], [line(3, 7200, "other")], [line(4, 14400, "other")], [line(5, -20), line(6, 3)], [line(7, 40)]]
    run, name, cp = run_stream(spark, tmp_path, batches, idle_s=3600)
    rest = streaming.stop(run, spark, cp).collect()
    ended = spark.table(name).collect()
    own = [r for r in ended if r.host == "h"]
    # lines 5 and 6 come hours after the clock of the stream moved on, and are in the session that was open
    assert [(r["count"], r.ts_first, r.ts_last) for r in own] == [(4, T0, T0 + dt.timedelta(seconds=5))]
    assert own[0].sample_raws == [line(1, 0)[4], line(2, 5)[4], line(5, -20)[4]]
    assert sum(r["count"] for r in [*ended, *rest]) == 7
    assert own[0].category == "system.general" and own[0].fields == {"status": '"ok"'} and len(own[0].fingerprint) == 16


def test_lines_of_a_batch_come_in_order_of_their_number(spark, tmp_path):
    lines = [line(i, 100 * (i % 2)) for i in range(8)]  # jumps forth and back
    run, name, cp = run_stream(spark, tmp_path, [lines[::-1]], idle_s=3600)
    rest = streaming.stop(run, spark, cp).collect()
    ended = spark.table(name).collect()
    # line 1 is 100 s after line 0; from there on all are late or at the end itself
    assert [(r["count"], r.sample_raws) for r in ended] == [(1, [lines[0][4]])]
    assert [(r["count"], r.sample_raws) for r in rest] == [(7, [x[4] for x in lines[1:4]])]


def test_sessions_end_by_the_clock(spark, tmp_path):
    run, name, _ = run_stream(spark, tmp_path, [[line(1, 0), line(2, 1)]], idle_s=0.5)
    until = time.time() + 60
    while time.time() < until and not spark.table(name).count():
        time.sleep(0.5)
    run.stop()
    assert [r["count"] for r in spark.table(name).collect()] == [2]


def slow_fold(us, raws, gap, samples):
    done, now = [], None
    for at, raw in zip(us, raws, strict=True):
        if now and at - now[2] < gap:
            now = (now[0] + 1, now[1], max(now[2], at), now[3], now[4] + [raw] if len(now[4]) < samples else now[4])
        else:
            done += [now] if now else []
            now = (1, at, at, raw, [raw][:samples])
    return [*done, now]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60), min_size=1, max_size=12), min_size=1, max_size=4))
def test_fold_against_line_by_line(batches):
    every, done, now = [x for b in batches for x in b], [], None
    raws, at = [str(i) for i in range(len(every))], 0
    for b in batches:
        ended, now = agent.fold(now, np.array(b, np.int64), raws[at : at + len(b)], 10, 3)
        done, at = done + ended, at + len(b)
    assert [*done, now] == slow_fold(every, raws, 10, 3)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcde"), min_size=1, max_size=40), st.integers(1, 6))
def test_bounded_groups_lose_nothing(keys, most):
    found = list(streaming.bounded_groups("h", list(range(len(keys))), [(k,) for k in keys], keys, most, 10**9))
    assert {k[0]: n for k, n in Counter({}).items()} == {} and Counter(keys) == sum((Counter({k[0]: s[0]}) for _, k, s, _ in found), Counter())
    distinct = len(set(keys))
    assert any(early for *_, early in found) == (distinct > most)


def test_bounded_patterns_of_hosts(spark):
    df = spark.createDataFrame([line(i, i, text="abc"[i % 3] * 3) for i in range(9)], SCHEMA)
    rows = streaming.bounded_patterns(df, most=2).collect()
    assert sum(r["count"] for r in rows) == 9 and sum(r.early for r in rows) == 7
    whole = streaming.bounded_patterns(df, most=3).collect()
    assert sorted((r["count"], r.early) for r in whole) == [(3, False)] * 3


def Server(*statuses):
    """Answers by what is left of its statuses, the last one for good.  A local function travels to the workers whole."""
    left = list(statuses)

    def send(data):
        json.loads(gzip.decompress(data))
        status = left.pop(0) if len(left) > 1 else left[0]
        return status, 1 if status == 429 else None

    return send


@pytest.fixture
def spool(spark, tmp_path):
    folder = tmp_path / "spool"
    folder.mkdir()
    texts = [r.j for r in catalogue.batches(spark, SF).select(wire.to_json(wire.F.col("envelope")).alias("j")).limit(3).collect()]
    for i, t in enumerate(texts):
        (folder / f"01HM00000{i}0000000000000000.json").write_text(t)
    (folder / "01HM0000090000000000000000.json").write_text("{cut sho")
    return folder, texts


def at(minute):
    return wire.F.lit(T0 + dt.timedelta(minutes=minute))


def test_delivery_policy_of_a_round(spark, spool, tmp_path):
    files = readers.spool_source(spark, str(spool[0])).where("name like '01HM000000%' or name like '01HM000009%'")
    for name, status, want in (("a", 503, "waiting"), ("b", 429, "waiting"), ("c", None, "waiting"), ("d", 400, "failed"), ("e", 302, "failed"), ("f", 204, "sent")):
        assert delivery.run_round(spark, files, str(tmp_path / name), Server(status), 0, at(0)) == {want: 1}
    to = str(tmp_path / "a")
    critical = files.first().envelope.headers.counts.by_severity.critical > 0
    assert delivery.run_round(spark, files, to, Server(503), 1, at(0)) == {}  # not due yet
    states = [delivery.run_round(spark, files, to, Server(503), k, at(10 * k)) for k in range(2, 13)]
    tries = 10 if critical else 5
    assert states[: tries - 1] == [{"waiting": 1}] * (tries - 2) + [{"failed": 1}] and not any(states[tries - 1 :])
    last = delivery.latest(delivery.ledger(spark, to)).collect()
    assert [(r.state, r.attempts) for r in last] == [("failed", tries)] and last[0].bytes > 0


def test_rounds_send_once_and_replay(spark, spool, tmp_path):
    folder, texts = spool
    to = str(tmp_path / "ledger")
    go = lambda number, status, **more: delivery.run_round(spark, readers.spool_source(spark, str(folder)), to, Server(status), number, at(number), **more)
    assert go(0, 400) == {"failed": 3} and go(1, 200) == {}
    (folder / "01HM0000050000000000000000.json").write_text(texts[0])
    assert go(2, 200) == {"sent": 1}
    assert go(2, 200) == {"sent": 1}  # run again after a crash: the same rows in place of the first
    assert go(3, 200, again=True) == {"sent": 3} and go(4, 200, again=True) == {}
    states = delivery.latest(delivery.ledger(spark, to)).collect()
    assert len(states) == 4 and all(r.state == "sent" for r in states)


def test_http_statuses():
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from threading import Thread

    class Handler(BaseHTTPRequestHandler):
        seen = []

        def do_POST(self):
            body = gzip.decompress(self.rfile.read(int(self.headers["Content-Length"])))
            Handler.seen.append((self.headers["Authorization"], self.headers["Content-Encoding"], body))
            self.send_response(int(self.path[1:]))
            self.send_header("Retry-After", "7")
            self.end_headers()

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    assert [delivery.http(f"{at}/{s}", "secret")(gzip.compress(b"{}")) for s in (200, 429, 500)] == [(200, None), (429, 7), (500, 7)]
    server.shutdown()
    server.server_close()
    assert Handler.seen[0] == ("Bearer secret", "gzip", b"{}") and delivery.http(at, "x", 1)(b"") == (None, None)


def test_merged_severity_of_mixed_lines(spark):
    rows = [(i, T0 + dt.timedelta(seconds=i), "h", "s", t, None) for i, t in enumerate(["a thing", "a thing", "a panic: thing"])]
    df = spark.createDataFrame(rows, SCHEMA + ", priority string").withColumn("template", wire.F.lit("same"))
    told = dedup.templates(df).withColumn("template", wire.F.lit("same"))
    assert [r.severity for r in dedup.dedup(told, ["host", "template"], carry=("severity",)).collect()] == ["critical"]
    assert [r.severity for r in dedup.dedup(told.where("event_id < 2"), ["host", "template"], carry=("severity",)).collect()] == ["info"]
