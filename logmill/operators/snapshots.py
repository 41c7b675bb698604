"""Snapshot envelopes: the texts of many hosts, parsed and put together to one envelope each (P-13, J1).

Rows are (host, at, file, text): whole files of the kernel and of ``/etc``, and reports of commands under the names of
``REPORTS``.  All parsers give parts of a section as JSON texts in one tall table, which one aggregation by host turns
into sections in their fixed order; so there is one exchange of small rows, and no join by host for each part.  Rates come from
the last two samples of a file, everything else from the last one.

A host whose texts lack a part has its empty form there (an object without keys, an empty list, zeros); a text that can't be
read counts as empty.  Hosts are independent; a host's processes and units are gathered in one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logmill.functions import scalars
from logmill.operators import wire
from logmill.sources import scratch, snapshot

# The parts of each section in order with what stands for an absent one; a section without names is a list.
SECTIONS: dict[str, dict[str, str] | None] = {
    "metrics": {"cpu": '{"usage_pct":null,"iowait_pct":null,"user_pct":null,"system_pct":null}', "memory": "{}", "disk_io": "{}", "network": "{}", "load_avg": '{"1m":0.0,"5m":0.0,"15m":0.0}', "pressure": "{}"},
    "processes": None,
    "network": {"connections": '{"established":0,"time_wait":0,"close_wait":0}', "sockstat": "{}", "interfaces": "{}"},
    "systemd": None,
    "static_state": {"selinux": '{"mode":"disabled"}', "sysctl": "{}", "kernel_modules": "[]", "cmdline": '""', "ntp": "null"},
    "config": {"files": "{}", "packages": '{"total":0,"sample":[]}'},
    "hardware": {"cpu": "{}", "memory": '{"total_mb":0}', "disks": "[]", "pci": "[]"},
    "logs": None,
}
SYSCTL = ["vm.overcommit_memory", "vm.swappiness", "kernel.panic", "net.core.somaxconn", "net.ipv4.tcp_tw_reuse"]
CONFIG = ["/etc/sysctl.conf", "/etc/hosts", "/etc/hostname"]
REPORTS = {"units": "systemctl list-units", "chrony": "chronyc tracking", "ntpq": "ntpq -p", "dpkg": "dpkg-query", "rpm": "rpm -qa", "pci": "lspci"}
KEEP_NULLS = {"ignoreNullFields": "false"}


def _json(value: Column) -> Column:
    return F.to_json(value, KEEP_NULLS)


def _part(df: DataFrame, section: str, name: str, json: Column) -> DataFrame:
    return df.select("host", F.lit(f"{section}/{name}").alias("key"), json.alias("value"))


def _listed(df: DataFrame, section: str, name: str, value: Column, order: Column | None = None) -> DataFrame:
    """A list of a host's rows, in order of ``order`` or of the values."""
    rows = df.select("host", F.struct((order if order is not None else F.lit(0)).alias("o"), value.alias("v")).alias("x"))
    return _part(rows.groupBy("host").agg(F.array_sort(F.collect_list("x")).alias("x")), section, name, _json(F.transform("x", lambda x: x["v"])))


def _mapped(df: DataFrame, section: str, name: str, key: str, value: Column) -> DataFrame:
    rows = df.select("host", F.struct(F.col(key).alias("key"), value.alias("value")).alias("x"))
    return _part(rows.groupBy("host").agg(F.array_sort(F.collect_list("x")).alias("x")), section, name, _json(F.map_from_entries("x")))


def _columns(*names: str, **renamed: str) -> Column:
    return F.struct(*names, *(F.col(c).alias(n) for n, c in renamed.items()))


def parts(texts: DataFrame) -> DataFrame:
    """(host, key, value): each part of each section as a JSON text; ``key`` is the section and the part's name."""
    last = texts.where("sample = 1")
    of = lambda *paths: last.where(reduce(lambda a, b: a | b, [F.endswith("file", F.lit(p)) for p in paths]))
    both = lambda path: texts.where(F.endswith("file", F.lit(path)))
    found = []
    # metrics
    found.append(_part(snapshot.cpu(both("/proc/stat").where(~F.col("file").rlike(r"/proc/\d+/"))), "metrics", "cpu", _json(_columns("usage_pct", "iowait_pct", "user_pct", "system_pct"))))
    found.append(_part(snapshot.memory(of("/proc/meminfo")), "metrics", "memory", _json(_columns("total_mb", "used_mb", "free_mb", "available_mb", "swap_total_mb", "swap_used_mb"))))
    found.append(_mapped(snapshot.disk_io(both("/proc/diskstats")), "metrics", "disk_io", "dev", _columns("reads_per_sec", "writes_per_sec", "util_pct")))
    found.append(_mapped(snapshot.network(both("/proc/net/dev")), "metrics", "network", "dev", _columns("rx_bytes_per_sec", "tx_bytes_per_sec")))
    load = snapshot.loadavg(of("/proc/loadavg"))
    found.append(_part(load, "metrics", "load_avg", _json(F.struct(*(F.coalesce(f"load_{n}", F.lit(0.0)).alias(n) for n in ("1m", "5m", "15m"))))))
    pressed = of(*(f"/proc/pressure/{k}" for k in ("cpu", "memory", "io")))
    pressures = reduce(DataFrame.union, [snapshot.pressure(pressed.where(F.endswith("file", F.lit(f"/{k}")))).select("host", F.lit(k).alias("kind"), "some_pct", "full_pct") for k in ("cpu", "memory", "io")])
    found.append(_mapped(pressures, "metrics", "pressure", "kind", _columns("some_pct", "full_pct")))
    # processes: two files each
    pid = F.regexp_extract("file", r"/proc/(\d+)/(?:stat|status)$", 1)
    of_process = last.where(pid != "").groupBy("host", pid.alias("_pid")).agg(F.max("at").alias("at"), F.max(F.when(F.endswith("file", F.lit("/stat")), F.col("text"))).alias("text"), F.max(F.when(F.endswith("file", F.lit("/status")), F.col("text"))).alias("status"))
    hosts = last.groupBy("host").agg(F.max(F.when(F.endswith("file", F.lit("/proc/stat")) & (pid == ""), snapshot.boot_time(F.col("text")))).alias("boot"), F.max(F.when(F.endswith("file", F.lit("/proc/meminfo")), snapshot.total_kb(F.col("text")))).alias("kb"))
    procs = snapshot.processes(of_process.where("text is not null").join(hosts, "host"), snapshot.passwd(of("/etc/passwd")), boot="boot", total_kb="kb")
    found.append(_listed(procs, "processes", "", _columns("pid", "name", "user", "cpu_pct", "mem_pct", "mem_rss_mb", "state", "threads", "open_files", "start_time"), F.col("rank")))
    # network
    found.append(_part(snapshot.connections(of("/proc/net/tcp", "/proc/net/tcp6")), "network", "connections", _json(_columns("established", "time_wait", "close_wait"))))
    found.append(_part(snapshot.sockstat(of("/proc/net/sockstat")), "network", "sockstat", _json(_columns("tcp_alloc", "udp_inuse"))))
    device = F.regexp_extract("file", r"/sys/class/net/([^/]+)/(?:operstate|mtu)$", 1)
    state = lambda kind: F.max(F.when(F.endswith("file", F.lit(f"/{kind}")), F.col("text")))
    details = last.where(device != "").groupBy("host", device.alias("dev")).agg(state("operstate").alias("operstate"), state("mtu").alias("mtu"))
    details = details.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("dev", F.struct("operstate", "mtu")))).alias("details"))
    found.append(_mapped(snapshot.interfaces(of("/proc/net/dev").join(details, "host", "left")), "network", "interfaces", "dev", _columns("state", "mtu")))
    # systemd
    listed = snapshot.units(of(REPORTS["units"]))
    found.append(_listed(listed, "systemd", "", F.struct("unit", "load", "active", "sub", F.lit(0).cast("long").alias("restarts"), F.lit(None).cast("long").alias("main_pid"), F.lit("").alias("since"))))
    # static state
    whole = F.col("text")
    found.append(_part(of("/sys/fs/selinux/enforce"), "static_state", "selinux", _json(F.struct(snapshot.selinux(whole).alias("mode")))))
    value = lambda name: F.coalesce(F.max(F.when(F.endswith("file", F.lit("/proc/sys/" + name.replace(".", "/"))), snapshot.clean(whole))), F.lit(""))
    found.append(_part(last.groupBy("host").agg(F.create_map(*(x for n in SYSCTL for x in (F.lit(n), value(n)))).alias("m")), "static_state", "sysctl", _json(F.col("m"))))
    found.append(_part(snapshot.modules(of("/proc/modules")), "static_state", "kernel_modules", _json(F.col("kernel_modules"))))
    found.append(_part(of("/proc/cmdline"), "static_state", "cmdline", snapshot.quoted(snapshot.command_line(whole))))
    report = lambda name: F.max(F.when(F.endswith("file", F.lit(REPORTS[name])), whole))
    clocks = last.groupBy("host").agg(report("chrony").alias("a"), report("ntpq").alias("b"))
    clock = snapshot.ntp(F.coalesce("a", F.lit("")), F.coalesce("b", F.lit("")))
    found.append(_part(clocks, "static_state", "ntp", F.coalesce(_json(clock), F.lit("null"))))
    # config
    files = of(*CONFIG).withColumn("path", reduce(lambda out, p: F.when(F.endswith("file", F.lit(p)), F.lit(p)).otherwise(out), CONFIG, F.lit("")))
    found.append(_mapped(files, "config", "files", "path", snapshot.config_file(whole)))
    # of the two package managers the first that says anything
    kinds = last.groupBy("host").agg(report("dpkg").alias("dpkg"), report("rpm").alias("rpm"))
    dpkg = snapshot.packages(kinds.where("dpkg like '%\t%'"), "dpkg")
    rpm = snapshot.rpm_packages(kinds.where("coalesce(dpkg, '') not like '%\t%' and rpm is not null"), "rpm")
    found.append(_part(dpkg.union(rpm), "config", "packages", _json(_columns("total", "sample"))))
    # hardware
    found.append(_part(snapshot.cpu_info(of("/proc/cpuinfo")), "hardware", "cpu", _json(_columns("model", "sockets", "cores_per_socket", "threads"))))
    found.append(_part(of("/proc/meminfo"), "hardware", "memory", _json(F.struct(snapshot.hardware_memory(whole).alias("total_mb")))))
    block = F.regexp_extract("file", r"/sys/block/([^/]+)/(?:size|device/model)$", 1)
    blocks = last.where(block != "").groupBy("host", block.alias("dev")).agg(state("device/model").alias("model"), state("size").alias("size"))
    found.append(_listed(snapshot.disks(blocks), "hardware", "disks", _columns("dev", "model", "size_gb", "smart_status")))
    found.append(_listed(snapshot.pci(of(REPORTS["pci"])), "hardware", "pci", _columns("class", "device"), F.col("place")))
    return reduce(DataFrame.union, found)


def _data(name: str, names: dict[str, str] | None) -> Column:
    value = lambda part, absent: F.coalesce(F.try_element_at("found", F.lit(f"{name}/{part}")), F.lit(absent))
    if names is None:
        return value("", "[]")
    pieces = [F.concat(F.lit(f'"{part}":'), value(part, absent)) for part, absent in names.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *pieces), F.lit("}"))


def envelopes(texts: DataFrame, *, host_id: Column, boot_id: Column, logs: DataFrame | None = None, static_state: bool = True) -> DataFrame:
    """(host, at, envelope): a stat snapshot of each host, or with ``logs`` (host, data: a JSON list) a sos snapshot.

    ``texts``: (host, at, file, text).  The texts are ranked and written once (``scratch``), since each parser reads its own
    files of them.  Snapshots have no number and no window; ``duration_ms`` is the time between the samples.
    """
    by = Window.partitionBy("host", "file").orderBy(F.desc("at"))
    ranked = texts.where("host is not null and file is not null").select("host", "at", "file", F.coalesce("text", F.lit("")).alias("text")).withColumn("sample", F.row_number().over(by)).where("sample <= 2")
    ranked, _ = scratch.materialise(ranked, "snapshot-texts")
    found = parts(ranked)
    if logs is not None:
        found = found.union(logs.select("host", F.lit("logs/").alias("key"), F.col("data").alias("value")))
    by_host = found.where("value is not null").groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("found"))
    times = ranked.groupBy("host").agg(F.max("at").alias("at"), (F.unix_millis(F.max(F.col("at").cast("timestamp"))) - F.unix_millis(F.min(F.col("at").cast("timestamp")))).alias("ms"))
    names = [k for k in SECTIONS if (k != "static_state" or static_state) and (k != "logs" or logs is not None)]
    body = F.array(*[F.struct(F.lit(k).alias("section"), _data(k, SECTIONS[k]).alias("data")) for k in names])
    cycle = F.struct("host", host_id.alias("host_id"), boot_id.alias("boot_id"), scalars.rfc3339(F.col("at").cast("timestamp")).alias("ts"), F.lit(None).cast("string").alias("window"), F.lit(None).cast("bigint").alias("seq"))
    headers = F.struct(F.lit(len(names)).cast("bigint").alias("total_sections"), F.lit(None).cast(wire.COUNTS).alias("counts"), F.lit(None).cast("struct<vector_restarts_24h:int,agent_uptime_seconds:bigint>").alias("process_health"), F.col("ms").alias("duration_ms"))
    kind = F.lit("stat_snapshot" if logs is None else "sos_snapshot")
    rows = times.join(by_host, "host", "left").withColumn("found", F.coalesce("found", F.create_map().cast("map<string,string>")))
    return rows.select("host", "at", F.struct(kind.alias("event_kind"), cycle.alias("cycle"), headers.alias("headers"), body.alias("body")).alias("envelope"))


def stored(envelopes: DataFrame, envelope: str = "envelope") -> DataFrame:
    """The sections as a store keeps them, one row each with ``data`` as a Variant; what is no JSON is null."""
    rows = wire.sections(envelopes, envelope)
    return rows.withColumn("data", F.try_parse_json("data"))


def shapes(sections: DataFrame) -> DataFrame:
    """The schema that all of a section's data have together."""
    return sections.groupBy("section").agg(F.schema_of_variant_agg("data").alias("shape"), F.count("*").alias("n"))
