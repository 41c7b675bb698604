"""Parsers of host snapshot texts (one row each of host and whole text) into typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logmill.functions import scalars
from logmill.functions.extract import quoted  # noqa: F401


#: Clock ticks a second.
TICKS = 100


def _number(text: Column, pattern: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("bigint"), F.lit(0))


def clean(text: Column) -> Column:
    """Without white space, line ends included, at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lines(df: DataFrame, text: str = "text") -> DataFrame:
    """A row for each non-empty line, trimmed, with its words."""
    return df.select("*", F.explode(F.split(F.col(text), "\n")).alias("line")).where(F.trim("line") != "").withColumn("words", F.split(F.trim("line"), r"\s+"))


def word(i: int, kind: str = "bigint") -> Column:
    return F.coalesce(F.try_element_at("words", F.lit(i + 1)).try_cast(kind), F.lit(0))


def memory(df: DataFrame, text: str = "text") -> DataFrame:
    """P-2: meminfo in MB; used = total less free, buffers and cached, never below zero."""
    kb = {name: _number(F.col(text), rf"(?m)^{key}:\s+(\d+)") for name, key in (("total", "MemTotal"), ("free", "MemFree"), ("available", "MemAvailable"), ("buffers", "Buffers"), ("cached", "Cached"), ("swap_total", "SwapTotal"), ("swap_free", "SwapFree"))}
    mb = {k: F.floor(v / 1024).cast("long") for k, v in kb.items()}
    used = scalars.saturating_sub(mb["total"], mb["free"] + mb["buffers"] + mb["cached"])
    return df.select("host", mb["total"].alias("total_mb"), used.alias("used_mb"), mb["free"].alias("free_mb"), mb["available"].alias("available_mb"), (mb["buffers"] + mb["cached"]).alias("cache_mb"), mb["swap_total"].alias("swap_total_mb"), scalars.saturating_sub(mb["swap_total"], mb["swap_free"]).alias("swap_used_mb"))


def loadavg(df: DataFrame, text: str = "text") -> DataFrame:
    """P-3."""
    w = F.split(F.trim(F.col(text)), r"\s+")
    return df.select("host", *(w[i].try_cast("double").alias(n) for i, n in enumerate(("load_1m", "load_5m", "load_15m"))))


def cpu(df: DataFrame, text: str = "text") -> DataFrame:
    """P-1: shares of CPU time between samples of one host, in order of ``at``; the first sample gives none."""
    w = Window.partitionBy("host").orderBy("at")
    words = F.split(F.trim(F.regexp_extract(F.col(text), r"(?m)^cpu\s+(.*)$", 1)), r"\s+")
    names = ("user", "nice", "system", "idle", "iowait", "irq", "softirq", "steal")
    ticks = df.select("host", "at", *(F.coalesce(F.get(words, i).try_cast("bigint"), F.lit(0)).alias(n) for i, n in enumerate(names)))
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    ticks = ticks.withColumn("total", total)
    moved = {n: scalars.saturating_sub(F.col(n), F.lag(n).over(w)) for n in (*names, "total")}
    whole = F.greatest(moved["total"], F.lit(1))
    pct = lambda c: F.round(c * 100 / whole, 2)
    out = ticks.select("host", "at", F.lag("total").over(w).alias("before"), pct(whole - moved["idle"] - moved["iowait"]).alias("usage_pct"), pct(moved["user"] + moved["nice"]).alias("user_pct"), pct(moved["system"]).alias("system_pct"), pct(moved["iowait"]).alias("iowait_pct"))
    return out.where("before is not null").drop("before")


def disk_io(df: DataFrame, text: str = "text") -> DataFrame:
    """P-4, X1, U5: rates of whole disks between two samples that both have."""
    rows = lines(df, text).where(F.size("words") >= 14).select("host", "at", F.get("words", F.lit(2)).alias("dev"), word(3).alias("reads"), word(7).alias("writes"), word(12).alias("ticks")).where(~scalars.skipped_device(F.col("dev")))
    w = Window.partitionBy("host", "dev").orderBy("at")
    s = F.col("at").cast("double") - F.lag("at").over(w).cast("double")
    rate = lambda c: F.round(scalars.saturating_sub(F.col(c), F.lag(c).over(w)) / s, 2)
    util = F.least(F.round(scalars.saturating_sub(F.col("ticks"), F.lag("ticks").over(w)) / (s * 1000) * 100, 2), F.lit(100.0))
    return rows.select("host", "at", "dev", rate("reads").alias("reads_per_sec"), rate("writes").alias("writes_per_sec"), util.alias("util_pct")).where("reads_per_sec is not null")


def network(df: DataFrame, text: str = "text") -> DataFrame:
    """P-5: bytes a second of each interface but the loopback."""
    rows = df.select("host", "at", F.explode(F.split(F.col(text), "\n")).alias("line")).where(F.contains("line", F.lit(":")))
    rows = rows.select("host", "at", F.trim(F.split("line", ":")[0]).alias("dev"), F.split(F.trim(F.split("line", ":")[1]), r"\s+").alias("words")).where("dev <> 'lo' and size(words) >= 9")
    w = Window.partitionBy("host", "dev").orderBy("at")
    s = F.col("at").cast("double") - F.lag("at").over(w).cast("double")
    rows = rows.select("host", "at", "dev", word(0).alias("rx"), word(8).alias("tx"))
    rate = lambda c: F.round(scalars.saturating_sub(F.col(c), F.lag(c).over(w)) / s, 2)
    return rows.select("host", "at", "dev", rate("rx").alias("rx_bytes_per_sec"), rate("tx").alias("tx_bytes_per_sec")).where("rx_bytes_per_sec is not null")


def pressure(df: DataFrame, text: str = "text") -> DataFrame:
    """P-6: avg10 of some and full; zero where absent."""
    pct = lambda kind: F.coalesce(F.nullif(F.regexp_extract(F.col(text), rf"(?m)^{kind} avg10=([0-9.]+)", 1), F.lit("")).try_cast("double"), F.lit(0.0))
    return df.select("host", pct("some").alias("some_pct"), pct("full").alias("full_pct"))


def total_kb(text: Column) -> Column:
    """The host's memory, of its meminfo text."""
    return _number(text, r"(?m)^MemTotal:\s+(\d+)")


def boot_time(text: Column) -> Column:
    """Seconds since 1970 at which the host started, of its stat text."""
    return _number(text, r"(?m)^btime\s+(\d+)")


def processes(df: DataFrame, users: DataFrame | None = None, text: str = "text", status: str = "status", most: int = 20, boot: str | None = None, total_kb: str | None = None) -> DataFrame:
    """P-7, L-2, X2: the largest by resident memory; names stand between the first ``(`` and the last ``)``.

    ``boot`` and ``total_kb``: columns with ``boot_time`` and the host's memory, from which come ``start_time`` (D7) and,
    at ``at``, the shares of CPU time since then and of memory.  Places in the text are those of the kernel's documentation.
    """
    t, s = F.col(text), F.col(status)
    rest = F.split(F.trim(F.regexp_extract(t, r"(?s)^.*\)(.*)$", 1)), r"\s+")
    at = lambda i: F.get(rest, F.lit(i)).try_cast("bigint")
    rss = _number(s, r"(?m)^VmRSS:\s+(\d+)")
    columns = {
        "pid": F.regexp_extract(t, r"^(\d+)", 1).try_cast("bigint"),
        "name": F.regexp_extract(t, r"(?s)\((.*)\)", 1),
        "state": rest[0],
        "threads": at(17),
        "start_ticks": at(19),
        "mem_rss_mb": F.floor(rss / 1024).cast("long"),
        "uid": F.regexp_extract(s, r"(?m)^Uid:\s+(\d+)", 1),
        "open_files": _number(s, r"(?m)^FDSize:\s+(\d+)"),
    }
    if boot:
        started = F.col(boot) + F.floor(at(19) / TICKS)
        columns["start_time"] = scalars.rfc3339(F.timestamp_seconds(started))
        lived = F.greatest(scalars.saturating_sub(F.unix_seconds(F.col("at").cast("timestamp")), started) * TICKS, F.lit(1))
        columns["cpu_pct"] = F.round((at(11) + at(12)) * 100 / lived, 2)
    if total_kb:
        columns["mem_pct"] = F.round(rss * 100 / F.greatest(F.col(total_kb), F.lit(1)), 2)
    rows = df.select("host", *(c.alias(n) for n, c in columns.items()))
    if users is not None:
        on = ["host", "uid"] if "host" in users.columns else ["uid"]
        rows = rows.join(users.withColumn("uid", F.col("uid").cast("string")).select(*on, "user"), on, "left")
    else:
        rows = rows.withColumn("user", F.lit(None).cast("string"))
    rows = rows.withColumn("user", F.coalesce("user", "uid"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("mem_rss_mb"), "pid")))
    return ranked.where(F.col("rank") <= most)


def passwd(df: DataFrame, text: str = "text") -> DataFrame:
    """host, uid and user of a passwd text; of a uid that has several names the first by name."""
    w = F.split("line", ":")
    rows = df.select("host", F.explode(F.split(F.col(text), "\n")).alias("line")).where(F.size(w) >= 3)
    return rows.groupBy("host", w[2].alias("uid")).agg(F.min(w[0]).alias("user"))


def connections(df: DataFrame, text: str = "text") -> DataFrame:
    """P-8, A10, U2: states over tcp and tcp6 texts."""
    state = F.upper(F.try_element_at("words", F.lit(4)))
    rows = lines(df, text).where(F.try_element_at("words", F.lit(1)) != "sl")
    count = lambda code: F.count_if(state == code)
    return rows.groupBy("host").agg(count("01").alias("established"), count("06").alias("time_wait"), count("08").alias("close_wait"))


def sockstat(df: DataFrame, text: str = "text") -> DataFrame:
    return df.select("host", _number(F.col(text), r"(?m)^TCP:.*\balloc (\d+)").alias("tcp_alloc"), _number(F.col(text), r"(?m)^UDP:.*\binuse (\d+)").alias("udp_inuse"))


def interfaces(df: DataFrame, text: str = "text", details: str = "details") -> DataFrame:
    """P-8: state and MTU of each interface of a net/dev text but the loopback.

    ``details``: a map from interface to a struct of the texts of its ``operstate`` and ``mtu`` files.
    """
    rows = df.select("host", F.col(details).alias("_d"), F.explode(F.slice(F.split(F.col(text), "\n"), 3, 1 << 20)).alias("line")).where(F.contains("line", F.lit(":")))
    rows = rows.withColumn("dev", F.trim(F.substring_index("line", ":", 1))).where("dev <> 'lo'")
    own = F.try_element_at("_d", F.col("dev"))
    up = F.upper(clean(own["operstate"])) == "UP"
    return rows.select("host", "dev", F.when(up, "UP").otherwise("DOWN").alias("state"), F.coalesce(clean(own["mtu"]).try_cast("bigint"), F.lit(0)).alias("mtu"))


def units(df: DataFrame, text: str = "text") -> DataFrame:
    """P-9: list-units rows of four columns or more."""
    clean = lines(df.withColumn(text, F.regexp_replace(F.col(text), r"(?m)^[●*]\s*", "")), text)
    return clean.where(F.size("words") >= 4).select("host", *(F.get("words", F.lit(i)).alias(n) for i, n in enumerate(("unit", "load", "active", "sub"))), F.lit(0).cast("long").alias("restarts"))


def sysctl(df: DataFrame, text: str = "text") -> DataFrame:
    """P-10: key = value lines to a map."""
    pairs = F.transform(F.filter(F.split(F.col(text), "\n"), lambda x: F.contains(x, F.lit("="))), lambda x: F.struct(F.trim(F.split(x, "=", 2)[0]).alias("key"), F.trim(F.split(x, "=", 2)[1]).alias("value")))
    return df.select("host", F.map_from_entries(pairs).alias("sysctl"))


def selinux(text: Column) -> Column:
    return F.when(clean(text) == "1", "enforcing").when(clean(text) == "0", "permissive").otherwise("disabled")


def modules(df: DataFrame, text: str = "text", most: int = 50) -> DataFrame:
    """L-9: the first names."""
    names = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: F.split(F.trim(x), r"\s+")[0]), lambda x: x != "")
    return df.select("host", F.slice(names, 1, most).alias("kernel_modules"))


def packages(df: DataFrame, text: str = "text", sample: int = 5) -> DataFrame:
    """P-11, A12: how many packages, and the first of them."""
    rows = F.transform(F.filter(F.split(F.col(text), "\n"), lambda x: F.contains(x, F.lit("\t"))), lambda x: F.struct(F.split(x, "\t", 2)[0].alias("name"), F.split(x, "\t", 2)[1].alias("version")))
    return df.select("host", F.size(rows).cast("long").alias("total"), F.slice(rows, 1, sample).alias("sample"))


def rpm_packages(df: DataFrame, text: str = "text", sample: int = 5, most: int = 200) -> DataFrame:
    """P-11: the other form of ``packages``, of which the first 200 count."""
    first = F.array_join(F.slice(F.filter(F.split(F.col(text), "\n"), lambda x: F.contains(x, F.lit("\t"))), 1, most), "\n")
    return packages(df.withColumn(text, first), text, sample)


def config_file(text: Column, most: int = 4096) -> Column:
    """The first bytes; what is left of a character that was cut becomes a replacement character."""
    return F.decode(F.substring(F.encode(text, "utf-8"), 1, most), "utf-8") if most else text


def command_line(text: Column) -> Column:
    """P-10: the kernel's command line, empty where it is absent."""
    return F.coalesce(clean(text), F.lit(""))


def chrony(text: Column) -> Column:
    """P-10: reference, offset in milliseconds and stratum of a tracking report, null if it has neither reference nor stratum."""
    reference = F.regexp_extract(text, r"(?m)^Reference ID[^\n]*\(([^)\n]*)\)", 1)
    stratum = _number(text, r"(?m)^Stratum\s*:\s*(\d+)")
    offsets = F.regexp_extract_all(text, F.lit(r"(?m)^(?:System time|Last offset)\s*:\s*([+\-0-9.eE]+)"), F.lit(1))
    offset = F.coalesce(F.try_element_at(offsets, F.lit(-1)).try_cast("double"), F.lit(0.0))
    return F.when((reference != "") | (stratum > 0), F.struct(reference.alias("reference"), F.round(offset * 1000, 2).alias("offset_ms"), stratum.alias("stratum")))


def ntpq(text: Column) -> Column:
    """P-10: the same of a list of peers: the first that is in use, after two lines of headings."""
    lines = F.slice(F.split(text, "\n"), 3, 1 << 20)
    words = F.transform(F.filter(lines, lambda x: x.rlike(r"^[*+]")), lambda x: F.split(F.trim(F.substring(x, 2, 1 << 20)), r"\s+"))
    peer = F.try_element_at(F.filter(words, lambda w: F.size(w) >= 9), F.lit(1))
    number = lambda i, kind: F.coalesce(F.get(peer, F.lit(i)).try_cast(kind), F.lit(0).cast(kind))
    return F.when(peer.isNotNull(), F.struct(peer[0].alias("reference"), number(8, "double").alias("offset_ms"), number(2, "bigint").alias("stratum")))


def ntp(chronyc: Column, peers: Column) -> Column:
    """P-10: the first of the two reports that says anything, else null."""
    return F.coalesce(chrony(chronyc), ntpq(peers))


def hardware_memory(text: Column) -> Column:
    """P-12."""
    return F.floor(_number(text, r"(?m)^MemTotal:\s+(\d+)") / 1024).cast("long")


def disks(df: DataFrame) -> DataFrame:
    """P-12: whole disks of rows (host, dev, model, size: texts of the device's files), sizes in sectors of 512 bytes."""
    size = F.coalesce(clean(F.col("size")).try_cast("bigint"), F.lit(0))
    kept = df.where(~F.col("dev").rlike("^(loop|ram|dm-)"))
    return kept.select("host", "dev", F.coalesce(clean(F.col("model")), F.lit("")).alias("model"), F.floor(size * 512 / 1_000_000_000).cast("long").alias("size_gb"), F.lit("UNKNOWN").alias("smart_status"))


def pci(df: DataFrame, text: str = "text", most: int = 20) -> DataFrame:
    """P-12, L-9: class and device of the first lines of a PCI list; lines without either are left out."""
    first = F.slice(F.filter(F.split(F.col(text), "\n"), lambda x: x != ""), 1, most)
    rows = df.select("host", F.posexplode(first).alias("place", "line"))
    rest = F.regexp_extract("line", r"^\S* (.*)$", 1)
    return rows.where(F.contains(rest, F.lit(":"))).select("host", "place", F.trim(F.substring_index(rest, ":", 1)).alias("class"), F.trim(F.regexp_extract(rest, r"^[^:]*:(.*)$", 1)).alias("device"))


def whole_texts(spark, paths: str | list[str], host: Column) -> DataFrame:
    """A row (host, at, file, text) for each file, read whole; files are small and of the kernel."""
    files = spark.read.text(paths, wholetext=True)
    return files.select(host.alias("host"), F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def cpu_info(df: DataFrame, text: str = "text") -> DataFrame:
    """P-12, A11: model, sockets (one at least), cores and threads."""
    t = F.col(text)
    ids = F.array_distinct(F.regexp_extract_all(t, F.lit(r"(?m)^physical id\s*:\s*(\d+)"), F.lit(1)))
    return df.select("host", F.trim(F.regexp_extract(t, r"(?m)^model name\s*:\s*(.*)$", 1)).alias("model"), F.greatest(F.size(ids), F.lit(1)).cast("long").alias("sockets"), F.greatest(_number(t, r"(?m)^cpu cores\s*:\s*(\d+)"), F.lit(1)).alias("cores_per_socket"), F.size(F.regexp_extract_all(t, F.lit(r"(?m)^(processor)\s*:"), F.lit(1))).cast("long").alias("threads"))
