"""Growing files: each line once and in order, through partial lines, slices, rotation, truncation and restarts."""

import io
import json
import os
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logmill.sources import tail
from logmill.streaming import agent
from logmill.streaming import patterns as streaming


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=20), st.integers(1, 12))
def test_slices_share_out_all_lines(lengths, chunk):
    data = b"".join(bytes([97 + i % 26]) * n + b"\n" for i, n in enumerate(lengths))
    got = [x for a in range(0, len(data), chunk) for x in tail.lines(io.BytesIO(data), 0, a, min(a + chunk, len(data)))]
    assert b"".join(x for _, x in got) == data
    assert [at for at, _ in got] == [sum(n + 1 for n in lengths[:i]) for i in range(len(lengths))]


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=60).map(lambda b: b.replace(b"\x00", b"\n")), st.integers(0, 60))
def test_complete_lines(data, known):
    ends = [0, *(i + 1 for i, c in enumerate(data) if c == 10)]
    known = max(e for e in ends if e <= known)
    assert tail.complete(io.BytesIO(data), len(data), known) == max(ends)


def put(path, text, mode="a"):
    with open(path, mode, newline="") as f:
        f.write(text)


def started(df, tmp_path, name="out"):
    return df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-cp")).start()


def rows(spark, tmp_path, name="out"):
    if not os.path.exists(tmp_path / name / "_spark_metadata"):
        return []
    return spark.read.schema("raw string, file string, offset long, arrival long, source string").parquet(str(tmp_path / name)).orderBy("arrival").collect()


def until(spark, tmp_path, n, name="out"):
    end = time.time() + 60
    while time.time() < end and len(rows(spark, tmp_path, name)) < n:
        time.sleep(0.3)


def test_each_line_once_over_rotation_and_restart(spark, tmp_path):
    log, every = str(tmp_path / "syslog"), [f"line {i} " + "x" * random.Random(i).randint(0, 40) for i in range(300)]
    df = lambda: tail.tail_source(spark, str(tmp_path / "syslog*"), chunk_bytes=500)
    put(log, "".join(x + "\n" for x in every[:100]) + every[100][:4])
    run = started(df(), tmp_path)
    until(spark, tmp_path, 100)
    assert [r.raw for r in rows(spark, tmp_path)] == every[:100]  # the partial line waits
    put(log, every[100][4:] + "\r\n" + "".join(x + "\n" for x in every[101:150]))
    until(spark, tmp_path, 150)
    run.stop()
    put(log, "".join(x + "\n" for x in every[150:200]))  # nobody looks
    os.rename(log, f"{log}.1")
    put(log, "".join(x + "\n" for x in every[200:250]))
    run = started(df(), tmp_path)
    until(spark, tmp_path, 250)
    put(log, "".join(x + "\n" for x in every[250:]))
    until(spark, tmp_path, 300)
    run.stop()
    got = rows(spark, tmp_path)
    assert sorted(r.raw for r in got) == sorted(every)
    for part in (every[:200], every[200:]):  # each file's lines in order
        assert [r.raw for r in got if r.raw in set(part)] == part
    assert {r.source for r in got} == {"file.syslog"}


def test_a_file_begun_anew_is_read_from_its_start(spark, tmp_path):
    log = str(tmp_path / "syslog")
    put(log, "one\ntwo\n")
    run = started(tail.tail_source(spark, log), tmp_path)
    until(spark, tmp_path, 2)
    put(log, "three\n", "w")
    until(spark, tmp_path, 3)
    run.stop()
    assert [r.raw for r in rows(spark, tmp_path)] == ["one", "two", "three"]


def test_from_the_end_and_old_files(spark, tmp_path):
    os.mkdir(tmp_path / "in")
    log, old = str(tmp_path / "in/auth.log"), str(tmp_path / "in/auth.old")
    put(log, "before\n")
    put(old, "long ago\n")
    os.utime(old, (1, 1))
    pin = str(tmp_path / "pin/first.json")
    df = lambda: tail.tail_source(spark, str(tmp_path / "in/auth*"), from_end=pin)
    run = started(df(), tmp_path)
    end = time.time() + 60
    while time.time() < end and not os.path.exists(pin):
        time.sleep(0.1)
    put(log, "after\n")
    until(spark, tmp_path, 1)
    run.stop()
    assert [(r.raw, r.source) for r in rows(spark, tmp_path)] == [("after", "file.auth")]
    # a query whose first batch was not logged begins where the first one did
    put(log, "later\n")
    run = started(df(), tmp_path, "again")
    until(spark, tmp_path, 2, "again")
    run.stop()
    assert [r.raw for r in rows(spark, tmp_path, "again")] == ["after", "later"]


@pytest.mark.parametrize("strict", [True, False])
def test_a_lost_file(tmp_path, strict):
    log = str(tmp_path / "a.log")
    put(log, "one\ntwo\n")
    reader = tail.Reader({"paths": json.dumps([str(tmp_path / "*")]), "fail_on_loss": str(strict).lower()})
    (part,) = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert [b.num_rows for b in reader.read(part)] == [2]
    os.remove(log)
    put(log, "other\n")
    if strict:
        with pytest.raises(FileNotFoundError):
            list(reader.read(part))
    else:
        assert list(reader.read(part)) == []


def test_no_files_and_empty_ones(tmp_path):
    put(str(tmp_path / "empty.log"), "")
    put(str(tmp_path / "partial.log"), "no end")
    put(str(tmp_path / "packed.log.gz"), "x\n")
    reader = tail.Reader({"paths": json.dumps([str(tmp_path / "*.log*"), str(tmp_path / "none/*")])})
    assert reader.latestOffset()["files"] == {}
    assert reader.latestOffset() is reader.latestOffset()


def test_journal_lines_and_sessions_of_a_tail(spark, tmp_path):
    log = str(tmp_path / "journal.json")
    entry = lambda i, priority="6": json.dumps({"MESSAGE": f"value {i}", "PRIORITY": priority, "host": "h", "timestamp": f"2024-01-01T00:00:{i:02}Z"}) + "\n"
    put(log, "".join(entry(i) for i in range(5)) + "no object\n" + entry(9, "7"))
    found = agent.sessions(tail.tail_journal(spark, log).withColumn("ts", F.col("ts").cast("timestamp")), order="arrival", idle_s=3600)
    run = found.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).start()
    streaming.settle(run, 120)
    run.stop()
    (r,) = agent.still_open(spark, str(tmp_path / "cp")).collect()
    assert r["count"] == 5 and r.first_raw == "value 0" and list(r.sample_raws) == ["value 0", "value 1", "value 2"]
