"""Whole texts of hosts to snapshot envelopes, and their sections as Variants."""

import datetime as dt
import json

from pyspark.sql import functions as F

from logmill.operators import snapshots, wire

T0 = dt.datetime(2024, 1, 1, 12)
STAT = "12 (a (b) c) S " + " ".join(str(i) for i in range(1, 11)) + " 300 100 " + " ".join(["0"] * 4) + " 17 0 1000 7 8"
DISK = "   8 0 sda {} 0 0 0 {} 0 0 0 0 {} 0\n   8 1 sda1 1 0 0 0 1 0 0 0 0 1 0\n"
NET = "Inter-|\n face |\n    lo: 1 0 0 0 0 0 0 0 1 0\n  eth0: {} 0 0 0 0 0 0 0 {} 0\n"
FULL = {
    "/proc/stat": ("cpu  10 0 10 80 0 0 0 0\nbtime 1704067200\n", "cpu  20 0 20 150 10 0 0 0\nbtime 1704067200\n"),
    "/proc/diskstats": (DISK.format(100, 50, 1000), DISK.format(300, 60, 2000)),
    "/proc/net/dev": (NET.format(0, 0), NET.format(200, 100)),
    "/proc/meminfo": "MemTotal: 2048000 kB\nMemFree: 1024000 kB\nMemAvailable: 1500000 kB\nBuffers: 10240 kB\nCached: 20480 kB\nSwapTotal: 4096 kB\nSwapFree: 1024 kB\n",
    "/proc/loadavg": "0.10 0.20 0.30 1/100 5\n",
    "/proc/pressure/cpu": "some avg10=1.50 avg60=0\n",
    "/proc/pressure/io": "some avg10=0.50 avg60=0\nfull avg10=0.25 avg60=0\n",
    "/proc/12/stat": STAT,
    "/proc/12/status": "Uid:\t7\t7\nVmRSS:\t 2048 kB\nFDSize:\t64\n",
    "/proc/13/stat": "13 (d) R 1 2",
    "/etc/passwd": "root:x:0:0\nbob:x:7:7\n",
    "/proc/net/tcp": "  sl local rem st\n 0: A B 01 x\n 1: A B 06 x\n",
    "/proc/net/tcp6": "  sl local rem st\n 0: A B 01 x\n 1: A B 08 x\n",
    "/proc/net/sockstat": "TCP: inuse 5 orphan 0 tw 0 alloc 9 mem 1\nUDP: inuse 3 mem 1\n",
    "/sys/class/net/eth0/operstate": "up\n",
    "/sys/class/net/eth0/mtu": "1500\n",
    "systemctl list-units": "● a.service loaded failed failed A\nshort row\nb.timer loaded active waiting B\n",
    "/sys/fs/selinux/enforce": "1",
    "/proc/sys/vm/swappiness": "60\n",
    "/proc/sys/net/ipv4/tcp_tw_reuse": "2\n",
    "/proc/modules": "m1 1 2\nm2 3 4\n",
    "/proc/cmdline": 'root="/dev/sda1" quiet\n',
    "chronyc tracking": "Reference ID    : A9FEA97B (time.example)\nStratum         : 3\nLast offset     : +0.002500000 seconds\n",
    "/etc/hosts": "127.0.0.1 localhost\n",
    "/etc/hostname": "ä" * 3000,
    "dpkg-query": "bash\t5.1\nzlib\t1.2\n",
    "/proc/cpuinfo": "processor : 0\nmodel name\t: X 1\nphysical id\t: 0\ncpu cores\t: 2\n",
    "/sys/block/sda/size": "2000000000\n",
    "/sys/block/sda/device/model": " Disk X \n",
    "/sys/block/loop0/size": "1",
    "lspci": "00:01.0 Bridge: Maker 1: rev 1\nno device\n",
}


def texts(spark):
    rows = []
    for file, text in FULL.items():
        for k, t in enumerate(text if isinstance(text, tuple) else (text,)):
            rows.append(("full", T0 + dt.timedelta(seconds=2 * k if isinstance(text, tuple) else 2), f"file:{file}" if file[0] == "/" else file, t))
    rows.append(("full", T0 - dt.timedelta(hours=1), "file:/proc/stat", "cpu  1 1 1 1 1 1 1 1\n"))  # older than the two samples that count
    rows += [("bare", T0, "/proc/loadavg", "not a number"), ("bare", T0, "/proc/meminfo", None), ("bare", T0, None, "x"), (None, T0, "/proc/meminfo", "x")]
    return spark.createDataFrame(rows, "host string, at timestamp, file string, text string").repartition(3)


def bodies(df):
    return {r.host: {s.section: json.loads(s.data) for s in r.envelope.body} for r in df.collect()}


def test_whole_texts_to_a_stat_snapshot(spark):
    made = snapshots.envelopes(texts(spark), host_id=F.md5("host"), boot_id=F.lit("b"))
    read = made.select("host", wire.from_json(wire.to_json(F.col("envelope"))).alias("envelope"))
    head = {r.host: r.envelope for r in read.collect()}
    assert set(head) == {"full", "bare"} and head["full"].event_kind == "stat_snapshot"
    assert (head["full"].cycle.ts, head["full"].cycle.seq, head["full"].cycle.window, head["full"].headers.duration_ms) == ("2024-01-01T12:00:02.000000+00:00", None, None, 2000)
    assert [s.section for s in head["bare"].body] == ["metrics", "processes", "network", "systemd", "static_state", "config", "hardware"] and head["bare"].headers.total_sections == 7
    own = bodies(read)
    full, bare = own["full"], own["bare"]
    assert full["metrics"] == {
        "cpu": {"usage_pct": 20.0, "iowait_pct": 10.0, "user_pct": 10.0, "system_pct": 10.0},
        "memory": {"total_mb": 2000, "used_mb": 970, "free_mb": 1000, "available_mb": 1464, "swap_total_mb": 4, "swap_used_mb": 3},
        "disk_io": {"sda": {"reads_per_sec": 100.0, "writes_per_sec": 5.0, "util_pct": 50.0}},
        "network": {"eth0": {"rx_bytes_per_sec": 100.0, "tx_bytes_per_sec": 50.0}},
        "load_avg": {"1m": 0.1, "5m": 0.2, "15m": 0.3},
        "pressure": {"cpu": {"some_pct": 1.5, "full_pct": 0.0}, "io": {"some_pct": 0.5, "full_pct": 0.25}},
    }
    process = full["processes"][0]
    assert (process["pid"], process["name"], process["user"], process["mem_rss_mb"], process["mem_pct"], process["start_time"]) == (12, "a (b) c", "bob", 2, 0.1, "2024-01-01T00:00:10.000000+00:00")
    assert full["network"] == {"connections": {"established": 2, "time_wait": 1, "close_wait": 1}, "sockstat": {"tcp_alloc": 9, "udp_inuse": 3}, "interfaces": {"eth0": {"state": "UP", "mtu": 1500}}}
    assert full["systemd"][0] == {"unit": "a.service", "load": "loaded", "active": "failed", "sub": "failed", "restarts": 0, "main_pid": None, "since": ""} and len(full["systemd"]) == 2
    assert full["static_state"] == {"selinux": {"mode": "enforcing"}, "sysctl": {"vm.overcommit_memory": "", "vm.swappiness": "60", "kernel.panic": "", "net.core.somaxconn": "", "net.ipv4.tcp_tw_reuse": "2"}, "kernel_modules": ["m1", "m2"], "cmdline": 'root="/dev/sda1" quiet', "ntp": {"reference": "time.example", "offset_ms": 2.5, "stratum": 3}}
    assert full["config"] == {"files": {"/etc/hosts": "127.0.0.1 localhost\n", "/etc/hostname": "ä" * 2048}, "packages": {"total": 2, "sample": [{"name": "bash", "version": "5.1"}, {"name": "zlib", "version": "1.2"}]}}
    assert full["hardware"] == {"cpu": {"model": "X 1", "sockets": 1, "cores_per_socket": 2, "threads": 1}, "memory": {"total_mb": 2000}, "disks": [{"dev": "sda", "model": "Disk X", "size_gb": 1024, "smart_status": "UNKNOWN"}], "pci": [{"class": "Bridge", "device": "Maker 1: rev 1"}]}
    # what a host lacks has its empty form
    assert bare["metrics"]["cpu"] == {"usage_pct": None, "iowait_pct": None, "user_pct": None, "system_pct": None} and bare["metrics"]["load_avg"] == {"1m": 0.0, "5m": 0.0, "15m": 0.0}
    assert bare["processes"] == bare["systemd"] == [] and bare["static_state"]["ntp"] is None and bare["config"] == {"files": {}, "packages": {"total": 0, "sample": []}} and bare["hardware"]["disks"] == []


def test_sos_snapshots_have_logs_and_variants_have_shapes(spark):
    logs = spark.createDataFrame([("full", '[{"template":"t","count":2}]')], "host string, data string")
    made = snapshots.envelopes(texts(spark), host_id=F.md5("host"), boot_id=F.lit("b"), logs=logs, static_state=False)
    rows = {r.host: r.envelope for r in made.collect()}
    assert [s.section for s in rows["full"].body] == ["metrics", "processes", "network", "systemd", "config", "hardware", "logs"] and rows["full"].event_kind == "sos_snapshot"
    assert bodies(made)["full"]["logs"] == [{"template": "t", "count": 2}] and bodies(made)["bare"]["logs"] == []
    events = wire.events_of(made.withColumn("envelope", F.col("envelope").cast(wire.ENVELOPE))).where("section = 'logs'").collect()
    assert [(r.host, r.template, r["count"]) for r in events] == [("full", "t", 2)]
    stored = snapshots.stored(made)
    got = stored.where("section = 'metrics'").select("host", F.variant_get("data", "$.memory.total_mb", "bigint").alias("mb")).collect()
    assert {r.host: r.mb for r in got} == {"full": 2000, "bare": 0}
    shapes = {r.section: r["shape"] for r in snapshots.shapes(stored).collect()}
    assert "total_mb: BIGINT" in shapes["metrics"] and shapes["logs"].startswith("ARRAY<OBJECT<")


def test_no_texts_no_envelopes(spark):
    assert snapshots.envelopes(texts(spark).limit(0), host_id=F.md5("host"), boot_id=F.lit("b")).count() == 0
