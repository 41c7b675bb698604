"""The log engine: golden rows, invariants, oracle parity, streaming against batch."""

import datetime as dt
import json

import pytest
from conftest import SF, SF_MID
from pyspark.sql import functions as F

from logmill.functions import classify, extract, normalize, scalars, severity
from logmill.operators import dedup, envelopes, wire
from logmill.plans import catalogue
from logmill.sources import readers, snapshot, synth
from logmill.streaming import patterns as streaming

C = F.col


def one(spark, rows, column):
    """Values of ``column`` over one-column text rows."""
    return [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i long, t string").select("i", column.alias("x")).orderBy("i").collect()]


MASKS = [
    ("user 550e8400-e29b-41d4-a716-446655440000 gone", "user <UUID> gone"),
    ("id=550e8400-e29b-41d4-a716-44665544000a1234", "id=<UUID>1234"),
    ("from 192.168.1.10 port 22", "from <IP4> port <NUM>"),
    ("from 999.168.1.10", "from <NUM>.<NUM>.<NUM>.<NUM>"),
    ("peer fe80::1 and 2001:db8:0:0:0:0:0:1", "peer <IP6> and <IP6>"),
    ("at 10:20:30 sharp", "at <NUM>:<NUM>:<NUM> sharp"),
    ("mac 00:1a:2b:3c:4d:5e up", "mac <HEX> up"),
    ("key SHA256:abcdefghij0123456789abcd", "key SHA256:<FPR>"),
    ("rip [<ffffffff81000000>] done", "rip [<ADDR>] done"),
    ("docker-0123456789ab veth12ab34cd br-0123456789ab", "<CID> <VETH> <BR>"),
    ("overlay2/abcdef0123 mounted at /var/lib/docker", "<MNT> mounted at <PATH>"),
    ("one /tmp only", "one /tmp only"),
    ("dev sda1 nvme0n1p2 vdb hdc3 loop7", "dev <DEV> <DEV> <DEV> <DEV> <DEV>"),
    ("ip 0xdeadbeef sp 0x12", "ip <HEX> sp 0x12"),
    ("e1000 and 42 of abc123", "e1000 and <NUM> of abc123"),
    ("2026-06-07T10:20:33Z", "<NUM>-<NUM>-07T10:<NUM>:33Z"),
    ("", ""),
]


def test_masks(spark):
    assert one(spark, [a for a, _ in MASKS] + [None], normalize.normalize(C("t"))) == [b for _, b in MASKS] + [None]


def test_unicode_digits_are_masked_on_request(spark):
    assert one(spark, ["n ٣٤"], normalize.normalize(C("t"), unicode=True)) == ["n <NUM>"]
    assert one(spark, ["포트 ٣٤", "port 34"], normalize.normalize(C("t"))) == ["포트 <NUM>", "port <NUM>"]
    assert one(spark, ["n ٣٤"], normalize.normalize(C("t"), unicode=False)) == ["n ٣٤"]


def test_objects_with_numbers_that_json_cannot_hold(spark):
    assert extract.json_scalars('{"code": NaN, "bytes": 1}') is None and extract.json_scalars('{"bytes": 1e400}') is None
    assert extract.json_scalars('x {"b": 1.5, "a": "NaN"}') == {"a": '"NaN"', "b": "1.5"}


HEADERS = [
    ("Jun  5 01:02:03 web1 sshd[12]: Accepted password", "Accepted password", "sshd"),
    ("Jun 15 01:02:03 web1 kernel: oops", "oops", "kernel"),
    ("<34>1 2026-06-15T00:25:23.5Z web1 su[42]: done", "done", "su"),
    ("2026-06-15T00:25:23+09:00 web1 CRON[1]: x", "x", "CRON"),
    ("no header here", "no header here", None),
    ("", "", None),
]


def test_headers(spark):
    rows = [h for h, _, _ in HEADERS]
    assert one(spark, rows, normalize.strip_prefix(C("t"))) == [m for _, m, _ in HEADERS]
    assert one(spark, rows, normalize.syslog_program(C("t"))) == [p for _, _, p in HEADERS]


def test_fingerprint_vectors(spark):
    keys = ["file.auth:Disconnected from user root <IP4> port <NUM>", "Disconnected from user root <IP4> port <NUM>|info|file.auth"]
    assert one(spark, keys, normalize.xxh3(C("t"))) == ["286dc77c431fa7d3", "8717529567cf3b8a"]
    got = one(spark, ["Disconnected from user root <IP4> port <NUM>"], normalize.fingerprint(C("t"), F.lit("info"), F.lit("file.auth")))
    assert got == ["8717529567cf3b8a"]


def test_severity(spark):
    rows = ["Kernel Panic - not syncing", "Out of memory: Killed process 1", "Buffer I/O error on sda", "segfault at 0", "a segfault", "panicking", "[Hardware Error]: x", "plain"]
    assert one(spark, rows, severity.finalize(F.lit("info"), C("t"))) == ["critical", "critical", "error", "error", "info", "info", "error", "info"]
    assert one(spark, ["plain", "EDAC MC0"], severity.finalize(F.lit("warn"), C("t"))) == ["warn", "error"]
    assert one(spark, ["EDAC MC0"], severity.finalize(F.lit("critical"), C("t"))) == ["critical"]
    assert one(spark, ["plain"], severity.finalize(F.lit("debug"), C("t"))) == ["info"]
    assert one(spark, ["0", "2", "3", "4", "5", "7", None, "x"], severity.from_priority(C("t"))) == ["critical", "critical", "error", "warn", "info", "info", "info", "info"]


def test_categories(spark):
    rows = [
        ("kernel: Memory cgroup out of memory: Killed process 5", None, "container.oom"),
        ("kernel: Out of memory: Killed process 5", None, "kernel.oom"),
        ("Failed password for invalid user x", "sshd", "auth.bruteforce"),
        ("Failed password for root", "sshd", "auth.failure"),
        ("Accepted password for root", "SSHD", "auth.event"),
        ("Accepted password for root", None, "system.general"),
        ("pam_unix(cron:session): session opened", "CRON", "session.activity"),
        ("ata1.00: some error", None, "disk.io_error"),
        ("smart: SMART x Threshold y Exceeded", None, "disk.smart_error"),
        ("avc:   denied { read }", None, "selinux.denial"),
        ("NETDEV WATCHDOG: eth0", None, "net.watchdog"),
        ("nothing", None, "system.general"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, t string, p string, want string")
    got = df.select("want", classify.categorize(C("t"), C("p")).alias("x")).collect()
    assert all(r.x == r.want for r in got), [tuple(r) for r in got if r.x != r.want]


def test_rules_gate_on_logger_and_fall_back(spark, tmp_path):
    rules = [classify.Rule("boom", "app.boom", logger="pay.*"), classify.Rule("", "rest")]
    assert one(spark, ["boom"], classify.categorize(C("t"), F.lit(None), F.lit("payments"), rules)) == ["app.boom"]
    assert one(spark, ["boom"], classify.categorize(C("t"), F.lit(None), F.lit(None).cast("string"), rules)) == ["rest"]
    assert classify.load(str(tmp_path / "none.yaml")) == [classify.Rule("", "system.general")]
    assert classify.Rule("a.b", "x").literal is False and classify.Rule("a b", "x").literal is True


def test_fields(spark):
    rows = ["Killed process 12 (x) user=bob", "x.service: failed pid=abc", 'site=a code=7 code=8 duration="1 s" other=1 latency=1.5', 'got {"code": 5, "status": "ok", "deep": {"a": 1}, "error": null, "path": "a\\"}"} end', "status=inf bytes=1d count= level=+5", "nothing"]
    got = [{k: json.loads(x) for k, x in m.items()} for m in one(spark, rows, extract.all_fields(C("t")))]
    assert got[0] == {"pid": 12, "user": "bob"}
    assert got[1] == {"unit": "x.service"}
    assert got[2] == {"site": "a", "code": 7, "duration": "1 s", "latency": 1.5}
    assert got[3] == {"code": 5, "status": "ok", "path": 'a"}'}
    assert got[4] == {"status": "inf", "bytes": "1d", "level": 5} or got[4] == {"status": "inf", "bytes": "1d", "count": "level=+5"}
    assert got[5] == {}
    capped = one(spark, ["code=1 port=2 path=3"], extract.all_fields(C("t"), most=2))
    assert set(capped[0]) == {"code", "port"}


def test_backfill(spark):
    got = one(spark, ["pid=3"], extract.backfill(extract.regex_fields(C("t")), {"pid": F.lit("9"), "unit": F.lit("a.service"), "file": F.lit(None).cast("string")}))
    assert got == [{"pid": "3", "unit": '"a.service"'}]


def test_times_and_sizes(spark):
    now = F.lit("2026-01-02 00:00:00").cast("timestamp")
    got = one(spark, ["Jan  2 23:59:59 x", "Dec 31 10:00:00 x", "Jan 10 00:00:00 x", "nope"], scalars.parse_syslog_ts(C("t"), now))
    assert got == [dt.datetime(2026, 1, 2, 23, 59, 59), dt.datetime(2025, 12, 31, 10), dt.datetime(2025, 1, 10), None]
    assert one(spark, ["2026-01-02T03:04:05+09:00 x", "2026-01-02T03:04:05 x", ""], scalars.parse_iso_ts(C("t"))) == [dt.datetime(2026, 1, 1, 18, 4, 5), None, None]
    assert one(spark, ["2h", "90s", "1d", " 5m ", "5", "h", "1h30m", "-1h", "99999999999999999999h", ""], scalars.parse_since(C("t"))) == [7200, 90, 86400, 300, None, None, None, None, None, None]
    assert one(spark, ["256m", "1G", "5", "x", " 2g "], scalars.parse_memory(C("t"))) == [256 << 20, 1 << 30, None, None, 2 << 30]
    assert one(spark, ["sda", "sda1", "nvme0n1", "nvme0n1p1", "loop0", "vdb"], scalars.is_partition(C("t"))) == [False, True, False, True, False, False]
    assert one(spark, ["01ARZ3NDEKTSV4RRFFQ69G5FAV.json", "bad"], scalars.ulid_ms(C("t"))) == [1469922850259, None]
    assert one(spark, ["512", "2048", str(3 << 20)], scalars.human_bytes(C("t").cast("long"))) == ["512B", "2.0KB", "3.0MB"]
    assert one(spark, ['say {"a": {"b": 1}} end', "no {broken", "none"], scalars.outermost_object(C("t"))) == ['{"a": {"b": 1}}', None, None]
    assert [scalars.journal_limit(n) for n in (0, 800_000, 10**9)] == [1000, 10000, 300000]
    bucket = scalars.TokenBucket(6)
    assert [bucket.take(0) for _ in range(7)][-2:] == [0, 600] and bucket.take(600) == 0


def events(spark, rows):
    """(seconds, key) rows."""
    base = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, base + dt.timedelta(seconds=s), k, f"raw{i}", "info", "c", "s", k) for i, (s, k) in enumerate(rows)], "event_id long, ts timestamp, k string, raw string, severity string, category string, source string, template string")


def test_sessions_start_at_the_gap_itself(spark):
    got = dedup.dedup(events(spark, [(0, "a"), (30, "a"), (59.999, "a"), (10, "b"), (20, "b"), (29, "b"), (31, "b")]), ["k"], 30).orderBy("k", "session").collect()
    assert [(r.k, r["count"]) for r in got] == [("a", 1), ("a", 2), ("b", 4)]
    assert got[2].sample_raws == ["raw3", "raw4", "raw5"]
    none = dedup.dedup(events(spark, [(0, "a")]), ["k"], 30, samples=0).collect()
    assert none[0].sample_raws == []


def test_no_line_is_lost_and_cycles_cut(spark):
    df = catalogue.groups(spark, SF, cycle=1800)
    assert df.agg(F.sum("count")).first()[0] == catalogue.lines(spark, SF).count()
    assert df.where(F.floor(F.unix_seconds(F.col("ts_first").cast("timestamp")) / 1800) != F.floor(F.unix_seconds(F.col("ts_last").cast("timestamp")) / 1800)).count() == 0


def test_all_categories_severities_and_masks_occur(spark):
    own = catalogue.patterns(spark, SF)
    assert {r.category for r in own.select("category").distinct().collect()} == {r.category for r in classify.RULES}
    assert {r.severity for r in own.select("severity").distinct().collect()} == set(severity.LEVELS)


def test_cap_fold(spark):
    assert [s for _, s in dedup.fold_cap(["info", "error", "critical", "info"], 2)] == ["evicted", "evicted", "kept", "kept"]
    assert [s for _, s in dedup.fold_cap(["critical", "critical", "info", "critical"], 2)] == ["evicted", "kept", "skipped", "kept"]
    df = spark.createDataFrame([(i, "h", s) for i, s in enumerate(["info", "error", "critical", "info"])] + [(9, "g", "info")], "event_id long, host string, severity string")
    got = {r.event_id: r.outcome for r in dedup.cycle_cap(df, ["host"], 2).collect()}
    assert got == {0: "evicted", 1: "evicted", 2: "kept", 3: "kept", 9: "kept"}


def test_envelopes_and_receiver(spark):
    rows = catalogue.received(spark, SF).collect()
    seqs = {}
    for r in rows:
        e = r.envelope
        counts = e.headers.counts
        body = json.loads(e.body[0].data)
        assert len(e.body) == e.headers.total_sections == 1 and e.body[0].section == "logs" and e.event_kind == "log_batch"
        assert sum(counts.by_severity) == sum(counts.by_category.values()) == sum(x["count"] for x in body)
        assert all(len(x["fingerprint"]) == 16 and isinstance(x["fields"], dict) and len(x["sample_raws"]) <= 3 for x in body)
        seqs.setdefault(e.cycle.host, []).append(e.cycle.seq)
    assert all(sorted(x) == list(range(len(x))) for x in seqs.values())
    numbers = [x["fields"]["pid"] for r in rows for x in json.loads(r.envelope.body[0].data) if "pid" in x["fields"]]
    assert numbers and all(isinstance(n, int) for n in numbers)


def test_envelopes_go_on_with_their_numbers_and_keep_to_the_cap(spark):
    events = dedup.with_fields(catalogue.groups(spark, SF, cycle=86400)).where("host = 'host1'")
    last = spark.createDataFrame([("host1", 41)], "host string, seq long")
    made = {r.cycle: r.envelope for r in wire.log_batches(events, host_id=F.lit("h"), boot_id=F.lit("b"), cycle_s=86400, numbered=last, most=5).collect()}
    assert sorted(e.cycle.seq for e in made.values()) == list(range(42, 42 + len(made)))
    told = dedup.cycle_cap(events, ["host", "cycle"], 5).toPandas()
    for cycle, e in made.items():
        own = told[told.cycle == cycle]
        assert len(json.loads(e.body[0].data)) == (own.outcome == "kept").sum() <= 5
        assert sum(e.headers.counts.by_severity) == own[own.outcome != "skipped"]["count"].sum()
    counters = {r.cycle: (r.kept, r.evicted, r.skipped) for r in dedup.cap_counters(events, ["host", "cycle"], 5).collect()}
    assert counters == {c: tuple(int((x.outcome == o).sum()) for o in ("kept", "evicted", "skipped")) for c, x in told.groupby("cycle")}


def test_json_round_trip_and_what_envelopes_lack(spark):
    texts = ['{"event_kind":"log_batch"}', '{"event_kind":"sos_snapshot","cycle":{"host":"a","seq":3},"body":[{"section":"hardware","data":{"cpu":{"sockets":1}}}]}', "not json", '{"body":[{"section":"logs","data":[{"template":"t","count":2},{"template":"u"}]}]}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", wire.from_json(C("t")).alias("envelope"))
    rows = {r.i: r.envelope for r in df.collect()}
    assert rows[0].cycle is None and rows[2] is None and json.loads(rows[1].body[0].data) == {"cpu": {"sockets": 1}}
    assert [(r.i, r.host, r.template, r["count"]) for r in wire.events_of(df).orderBy("i", "place").collect()] == [(3, "unknown", "t", 2), (3, "unknown", "u", None)]
    assert [(r.i, r.section) for r in wire.sections(df).orderBy("i").collect()] == [(1, "hardware"), (3, "logs")]
    again = json.loads(df.where("i = 1").select(wire.to_json(C("envelope")).alias("j")).first().j)
    assert again["body"][0]["data"] == {"cpu": {"sockets": 1}} and again["cycle"] == {"host": "a", "seq": 3}
    assert one(spark, ["log_batch", "stat_snapshot", "sos_snapshot", "x"], wire.store_of(C("t"))) == ["ingest", "stat", "sos", None]


def test_receiver_and_spool_files(spark, tmp_path):
    sent = [r.j for r in catalogue.batches(spark, SF).select(wire.to_json(C("envelope")).alias("j")).limit(3).collect()]
    store = tmp_path / "ingest.jsonl"
    store.write_text("\n\n".join(json.dumps({"received_at": f"2024-01-0{i + 1}", "envelope": json.loads(x)}) for i, x in enumerate(sent)) + "\n{broken\n")
    got = readers.receiver_source(spark, str(store)).collect()
    assert [r.received_at for r in got if r.envelope] == ["2024-01-01", "2024-01-02", "2024-01-03"] and [r.bad for r in got if r.bad] == ["{broken"]
    spool = tmp_path / "new"
    spool.mkdir()
    for i, name in enumerate(("01HM0000020000000000000000", "01HM0000010000000000000000", "01HM0000030000000000000000")):
        (spool / f"{name}.json").write_text(sent[0] if i < 2 else "{half")
    (spool / ".01HM0000000000000000000000.json").write_text(sent[0])
    (spool / "note.txt").write_text("x")
    rows = readers.spool_source(spark, str(spool)).collect()
    assert [r.name[9:10] for r in rows] == ["1", "2", "3"] and rows[0].ms < rows[1].ms and rows[2].bad == "{half" and rows[0].envelope.event_kind == "log_batch"


def test_raw_scan_keeps_lines_without_a_time_and_says_what_it_left_out(spark):
    now = F.lit("2024-01-05 12:00:00").cast("timestamp")
    rows = [("Jan  5 11:30:00 h a: new", "file.syslog", "/l/s", 1), ("no time", "file.syslog", "/l/s", 2), ("Jan  5 10:30:00 h a: old", "file.syslog", "/l/s.1", 1), ("Jan  5 11:10:00 h a: rotated", "file.syslog", "/l/s.1", 2), ("", "file.syslog", "/l/s", 3), ("Jan  5 11:59:00 h b: auth", "file.auth", "/l/a", 1)]
    df = spark.createDataFrame(rows, "raw string, source string, file string, line_no long")
    got = [(r.file, r.line_no) for r in readers.raw_scan(df, now).orderBy("used_bytes").collect()]
    assert got == [("/l/s.1", 2), ("/l/s", 1), ("/l/s", 2), ("/l/a", 1)]
    header = len("==> file.syslog (/l/s) <==\n")
    few = readers.raw_scan(df, now, most_bytes=header + 29 + 25).orderBy("used_bytes").collect()
    assert [(r.file, r.line_no, r.used_bytes, r.truncated) for r in few] == [("/l/s.1", 2, header + 29, True), ("/l/s", 1, header + 54, True)]
    assert [r.raw for r in readers.raw_scan(df, now, since_s=600, until_s=120).orderBy("used_bytes").collect()] == ["no time"]
    assert [r.template for r in readers.recent_events(df, now, hours=1).collect()] == ["auth", "new", "rotated"]


def test_sources_that_are_there(spark, tmp_path):
    assert readers.journal_folder(lambda p: p.startswith("/var")) == "/var/log/journal" and readers.journal_folder() == "/run/log/journal" and readers.journal_folder(lambda p: False) is None
    assert readers.build_sources(spark, "debian", lambda p: False) is None
    lines = spark.createDataFrame([('{"MESSAGE":"x"}',), ("broken",), ("",), ("[1]",)], "value string")
    assert sorted(r.value for r in readers.malformed(lines).collect()) == ["[1]", "broken"]


def test_delivery_policy():
    w = envelopes.retry_wait
    assert w(0, False, 200) == 0 and w(0, False, 400) is None and w(0, False, 429) == 60 and w(0, False, 429, 7) == 7
    assert [w(k, False, 503) for k in range(5)] == [5, 10, 20, 40, None] and w(8, True, None) == 300 and w(9, True, None) is None


def test_multiline_and_rotation(spark, tmp_path):
    text = "stray\nJan  1 00:00:00 h app: boom\n  at a\n  at b\n2024-01-01T00:00:01Z h app: next\n"
    (tmp_path / "auth.log").write_text(text)
    rows = [(str(tmp_path), i, line) for i, line in enumerate(text.splitlines())]
    got = readers.merge_lines(spark.createDataFrame(rows, "file string, line_no long, raw string")).orderBy("line_no").collect()
    assert [(r.raw.count("\n"), r.n_lines) for r in got] == [(0, 1), (2, 3), (0, 1)]
    read = readers.text_source(spark, str(tmp_path)).collect()
    assert len(read) == 5 and {r.source for r in read} == {"file.auth"}
    assert one(spark, ["a.log.3.gz", "a.log.1", "a.log"], readers.rotation_rank(C("t"))) == [0, 3, 4]
    assert readers.os_family('ID=rocky\nID_LIKE="rhel centos"') == "rhel" and readers.os_family("ID=x") is None
    assert list(readers.log_paths("debian", lambda p: "auth" in p)) == ["file.auth"]


def test_journal(spark, tmp_path):
    lines = ['{"MESSAGE": "a", "PRIORITY": "3", "_PID": "5"}', '{"message": "b"}', '{"MESSAGE": "debug", "PRIORITY": "7"}', "{broken", '{"MESSAGE": ""}']
    (tmp_path / "j.json").write_text("\n".join(lines))
    got = readers.journal_source(spark, str(tmp_path)).collect()
    assert [(r.raw, r.initial_severity, r.pid) for r in got] == [("a", "error", "5"), ("b", "info", None)]


def test_snapshots(spark):
    def host(text, at=0, **more):
        return {"host": "h", "at": dt.datetime(2024, 1, 1, 0, 0, at), "text": text, **more}

    df = lambda *rows: spark.createDataFrame([{**r} for r in rows])
    mem = snapshot.memory(df(host("MemTotal: 2048000 kB\nMemFree: 1024000 kB\nMemAvailable: 1500000 kB\nBuffers: 10240 kB\nCached: 20480 kB\nSwapTotal: 0 kB\n"))).first()
    assert (mem.total_mb, mem.used_mb, mem.free_mb) == (2000, 970, 1000)
    load = snapshot.loadavg(df(host("0.10 0.20 0.30 1/100 5\n"))).first()
    assert (load.load_1m, load.load_15m) == (0.1, 0.3)
    cpu = snapshot.cpu(df(host("cpu  10 0 10 80 0 0 0 0\n"), host("cpu  20 0 20 150 10 0 0 0\n", 2))).collect()
    assert [(r.usage_pct, r.user_pct, r.iowait_pct) for r in cpu] == [(20.0, 10.0, 10.0)]
    disk = "   8 0 sda {} 0 0 0 {} 0 0 0 0 {} 0\n   8 1 sda1 1 0 0 0 1 0 0 0 0 1 0\n   7 0 loop0 1 0 0 0 1 0 0 0 0 1 0\n"
    io = snapshot.disk_io(df(host(disk.format(100, 50, 1000)), host(disk.format(300, 60, 2000), 2))).collect()
    assert [(r.dev, r.reads_per_sec, r.writes_per_sec, r.util_pct) for r in io] == [("sda", 100.0, 5.0, 50.0)]
    net = "Inter-|\n face |\n    lo: 1 0 0 0 0 0 0 0 1 0\n  eth0: {} 0 0 0 0 0 0 0 {} 0\n"
    rate = snapshot.network(df(host(net.format(0, 0)), host(net.format(200, 100), 2))).collect()
    assert [(r.dev, r.rx_bytes_per_sec, r.tx_bytes_per_sec) for r in rate] == [("eth0", 100.0, 50.0)]
    psi = snapshot.pressure(df(host("some avg10=1.50 avg60=0\nfull avg10=0.25 avg60=0\n"))).first()
    assert (psi.some_pct, psi.full_pct) == (1.5, 0.25)
    stat = "12 (a (b) c) S 1 " + " ".join(str(i) for i in range(2, 40))
    users = snapshot.passwd(df(host("root:x:0:0\nbob:x:7:7\n")))
    procs = snapshot.processes(df(host(stat, status="Uid:\t7\t7\nVmRSS:\t 2048 kB\nFDSize:\t64\n")), users).first()
    assert (procs.pid, procs.name, procs.state, procs.user, procs.mem_rss_mb, procs.open_files, procs.threads, procs.start_ticks) == (12, "a (b) c", "S", "bob", 2, 64, 17, 19)
    tcp = snapshot.connections(df(host("  sl local rem st\n 0: A B 01 x\n 1: A B 06 x\n 2: A B 08 x\n"))).first()
    assert (tcp.established, tcp.time_wait, tcp.close_wait) == (1, 1, 1)
    sock = snapshot.sockstat(df(host("TCP: inuse 5 orphan 0 tw 0 alloc 9 mem 1\nUDP: inuse 3 mem 1\n"))).first()
    assert (sock.tcp_alloc, sock.udp_inuse) == (9, 3)
    unit = snapshot.units(df(host("● a.service loaded failed failed A\nshort row\n"))).collect()
    assert [(u.unit, u.active) for u in unit] == [("a.service", "failed")]
    assert snapshot.sysctl(df(host("vm.swappiness = 10\nx=1\n"))).first().sysctl == {"vm.swappiness": "10", "x": "1"}
    assert snapshot.modules(df(host("a 1 2\nb 3 4\n"))).first().kernel_modules == ["a", "b"]
    pk = snapshot.packages(df(host("bash\t5.1\nzlib\t1.2\n"))).first()
    assert pk.total == 2 and pk["sample"][0].name == "bash"
    info = snapshot.cpu_info(df(host("processor : 0\nmodel name\t: X 1\nphysical id\t: 0\ncpu cores\t: 2\n\nprocessor : 1\nphysical id\t: 0\n"))).first()
    assert (info.model, info.sockets, info.cores_per_socket, info.threads) == ("X 1", 1, 2, 2)
    assert one(spark, ["1", "0", ""], snapshot.selinux(C("t"))) == ["enforcing", "permissive", "disabled"]


def test_snapshots_of_processes_interfaces_clock_and_hardware(spark, tmp_path):
    stat = "12 (x) S " + " ".join(str(i) for i in range(1, 11)) + " 300 100 " + " ".join(["0"] * 4) + " 5 0 1000 7 8"
    row = {"host": "h", "at": dt.datetime(2024, 1, 1, 0, 1, 0, tzinfo=dt.timezone.utc), "text": stat, "status": "VmRSS:\t512 kB\nUid:\t0\n", "stat": "cpu 1\nbtime 1704067200\n"}
    df = spark.createDataFrame([row]).withColumns({"boot": snapshot.boot_time(C("stat")), "kb": F.lit(2048).cast("long")})
    p = snapshot.processes(df, boot="boot", total_kb="kb").first()
    assert (p.threads, p.start_ticks, p.start_time, p.cpu_pct, p.mem_pct) == (5, 1000, "2024-01-01T00:00:10.000000+00:00", 8.0, 25.0)
    net = spark.createDataFrame([("h", "Inter-|\n face |\n    lo: 1\n  eth0: 2\n  eth1: 3\n", {"eth0": ("up\n", "1500\n")})], "host string, text string, details map<string, struct<operstate: string, mtu: string>>")
    assert [tuple(r) for r in snapshot.interfaces(net).orderBy("dev").collect()] == [("h", "eth0", "UP", 1500), ("h", "eth1", "DOWN", 0)]
    track = "Reference ID    : A9FEA97B (time.example)\nStratum         : 3\nSystem time     : 0.000100000 seconds slow\nLast offset     : +0.002500000 seconds\n"
    peers = "     remote           refid      st t when poll reach   delay   offset  jitter\n====\n-a.b .x. 1 u 1 64 377 0.1 9.0 0.1\n*c.d .y. 2 u 1 64 377 0.1 -1.25 0.1\n"
    got = [r.x and tuple(r.x) for r in spark.createDataFrame([(track, peers), ("", peers), ("", "")], "a string, b string").select(snapshot.ntp(C("a"), C("b")).alias("x")).collect()]
    assert got == [("time.example", 2.5, 3), ("c.d", -1.25, 2), None]
    assert one(spark, ["MemTotal: 2048 kB"], snapshot.hardware_memory(C("t"))) == [2]
    raw = spark.createDataFrame([("h", "sda", " Disk X \n", "2000000000\n"), ("h", "loop0", "", "1"), ("h", "sdb", None, None)], "host string, dev string, model string, size string")
    assert [tuple(r)[1:] for r in snapshot.disks(raw).orderBy("dev").collect()] == [("sda", "Disk X", 1024, "UNKNOWN"), ("sdb", "", 0, "UNKNOWN")]
    cards = "\n".join(f"00:{i:02d}.0 Bridge: Maker {i}: rev 1" for i in range(25))
    devices = snapshot.pci(spark.createDataFrame([("h", cards)], "host string, text string")).collect()
    assert len(devices) == 20 and (devices[3]["class"], devices[3].device) == ("Bridge", "Maker 3: rev 1")
    many = spark.createDataFrame([("h", "\n".join(f"p{i}\t{i}" for i in range(300)))], "host string, text string")
    assert (snapshot.rpm_packages(many).first().total, snapshot.packages(many).first().total) == (200, 300)
    assert one(spark, ["ä" * 3000, "short"], F.octet_length(snapshot.config_file(C("t")))) == [4096, 5] and one(spark, [" a=b \n"], snapshot.command_line(C("t"))) == ["a=b \n".strip()]
    (tmp_path / "meminfo").write_text("MemTotal: 1 kB\nMemFree: 1 kB\n")
    whole = snapshot.whole_texts(spark, str(tmp_path), F.lit("h")).first()
    assert whole.text.count("\n") == 2 and whole.file.endswith("meminfo")


def test_corpus_cardinality(spark):
    templates = [synth.corpus(spark, 3000, n).select(normalize.normalize(normalize.strip_prefix(C("raw"))).alias("t")).distinct().count() for n in (1, 8)]
    assert synth.corpus(spark, 3000, 4).count() == 3000 and templates[0] < templates[1]


def as_stream(spark, path, files):
    """Lines as a stream of one file a batch."""
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, "event_id long, ts timestamp, host string, source string, raw string").coalesce(1).write.parquet(f"{path}/{i}")
    spark.conf.set("spark.sql.streaming.schemaInference", "true")
    return spark.readStream.schema("event_id long, ts timestamp, host string, source string, raw string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


@pytest.mark.parametrize("kind", ["built-in", "stateful"])
def test_streaming_equals_batch(spark, tmp_path, kind):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(seconds=s), "h", "s", f"Jan  1 00:00:00 h app: value {i}") for i, s in enumerate([0, 10, 29, 60, 89.5, 200])]
    last = [(99, base + dt.timedelta(hours=2), "other", "s", "end")]
    stream = as_stream(spark, str(tmp_path / "in"), [rows, last, [(100, base + dt.timedelta(hours=4), "other", "s", "end")]])
    out = streaming.session_patterns(stream) if kind == "built-in" else streaming.stateful_patterns(stream, order="event_id", idle_s=3600)
    name = f"out_{kind.replace('-', '_')}"
    run = out.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    rest = []
    if kind == "built-in":
        run.processAllAvailable()
        run.stop()
    else:  # without a watermark the last session is still open
        rest = streaming.stop(run, spark, str(tmp_path / "cp")).where("host = 'h'").collect()
    got = sorted((r.ts_first, r.ts_last, r["count"]) for r in [*spark.table(name).where("host = 'h'").collect(), *rest])
    batch = dedup.dedup(dedup.patterns(spark.createDataFrame(rows, "event_id long, ts timestamp, host string, source string, raw string")), catalogue.KEYS, 30)
    assert got == sorted((r.ts_first, r.ts_last, r["count"]) for r in batch.collect()) and [c for *_, c in got] == [3, 2, 1]


def norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalogue.ORACLES:
        assert rows
        return
    want = duck.sql(catalogue.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(norm(r[c]) for c in columns) for r in rows), key=key) == sorted((tuple(norm(r[i]) for i in place) for r in want.fetchall()), key=key)


#: Nothing in the fixture grows tenfold from one half hour to the next; ``error_surge_x2`` has rows, and a test of its own follows.
EMPTY = {"error_surge"}


def test_every_query_has_something_to_compare():
    import duckdb

    con = duckdb.connect()
    for t in ("customer", "events", "documents", "pages"):
        con.sql(f"create view {t} as select * from '{SF_MID}/{t}.parquet'")
    empty = {name for name, text in catalogue.ORACLES.items() if not con.sql(text).limit(1).fetchall()}
    assert empty == EMPTY


def test_a_surge_is_ten_times_the_cycle_before(spark):
    df = spark.createDataFrame([("a", c, n) for c, n in enumerate([1, 9, 90, 0, 50, 500])] + [("b", 0, 100)], "host string, cycle long, error long")
    assert sorted((r.cycle, r.error) for r in envelopes.surges(df).collect()) == [(2, 90), (5, 500)]


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
