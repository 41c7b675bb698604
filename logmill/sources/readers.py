"""Log sources: journal exports, text files, rotated files, snapshots and envelopes, batch and streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logmill.functions import normalize, scalars, severity
from logmill.operators import dedup, running, wire

# Fixed values.
EVENT_START = r"^(?:<\d{1,3}>\d?\s+)?(?:\d{4}-\d{2}-\d{2}T|[A-Za-z]{3}\s+\d{1,2}\s)"
JOURNALS = ["/run/log/journal", "/var/log/journal"]
SOURCES = ["file.syslog", "file.auth", "file.audit", "kernel", "journald"]
ROTATION = [".3.gz", ".2.gz", ".1.gz", ".1", ""]
PATHS = {
    "debian": {"file.syslog": "/var/log/syslog", "file.auth": "/var/log/auth.log", "file.audit": "/var/log/audit/audit.log", "kernel": "/var/log/kern.log"},
    "rhel": {"file.syslog": "/var/log/messages", "file.auth": "/var/log/secure", "file.audit": "/var/log/audit/audit.log"},
}


def spread(df: DataFrame, light: bool = False) -> DataFrame:
    """Deal a scan of fewer splits than there are cores to all cores; a scan of many splits stays as it is, without a shuffle.

    For small files whose lines cost far more to parse than to move.  ``light`` rows, short ones from which much is made,
    are dealt evenly in any case: a file has as many splits as cores, but only those where one of its row groups begins have rows.
    """
    if df.isStreaming:
        return df
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if light:
        return df.repartition(max(cores, 2 * splits))
    return df.repartition(cores) if splits < cores else df


def os_family(os_release: str) -> str | None:
    """Debian or rhel by ID, then ID_LIKE, of an os-release text."""
    values = dict(line.split("=", 1) for line in os_release.splitlines() if "=" in line)
    for key in ("ID", "ID_LIKE"):
        for word in values.get(key, "").strip('"').lower().split():
            if word in ("debian", "ubuntu"):
                return "debian"
            if word in ("rhel", "centos", "fedora", "rocky", "almalinux"):
                return "rhel"
    return None


def log_paths(family: str | None, exists=lambda path: True) -> dict[str, str]:
    """Sources that are there; each path once, in order."""
    out: dict[str, str] = {}
    for source, path in PATHS.get(family or "debian", PATHS["debian"]).items():
        if path not in out.values() and exists(path):
            out[source] = path
    return out


def source_of(path: Column) -> Column:
    """By the file's name."""
    return F.when(path.rlike("auth|secure"), "file.auth").when(F.contains(path, F.lit("audit")), "file.audit").otherwise("file.syslog")


def text_source(spark: SparkSession, paths: str | list[str], modified_after: str | None = None, stream: bool = False, max_files: int = 1000, max_age: str = "1d") -> DataFrame:
    """Lines with file and source; gzip is read as such; whole files are pruned by their time.

    A stream takes at most ``max_files`` a batch (R3) and none that is older than ``max_age`` before the latest.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", max_files).option("maxFileAge", max_age) if stream else spark.read
    if modified_after and not stream:
        reader = reader.option("modifiedAfter", modified_after)
    df = reader.text(paths)
    path = F.col("_metadata.file_path")
    return df.select(F.col("value").alias("raw"), path.alias("file"), F.col("_metadata.file_modification_time").alias("modified"), source_of(path).alias("source"), F.lit("info").alias("initial_severity"))


def rotation_rank(path: Column) -> Column:
    """Rotated files from the oldest to the newest."""
    out = F.lit(len(ROTATION) - 1)
    for i, suffix in enumerate(ROTATION[:-1]):
        out = F.when(F.endswith(path, F.lit(suffix)), i).otherwise(out)
    return out


def journal_source(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Exported journal objects, one a line; lines that are no object are left out and debug ones dropped."""
    lines = (spark.readStream if stream else spark.read).text(path)
    return parse_journal(lines)


def parse_journal(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    got = {k: F.get_json_object(F.col(column), f"$.{k}") for k in ("MESSAGE", "message", "PRIORITY", "_SYSTEMD_UNIT", "_PID", "host", "timestamp", "file")}
    ok = F.try_parse_json(F.col(column)).isNotNull() & F.startswith(F.ltrim(F.col(column)), F.lit("{"))
    return lines.where(ok & severity.keep(got["PRIORITY"])).select(
        normalize.raw_message(got["MESSAGE"], got["message"]).alias("raw"), got["PRIORITY"].alias("priority"), severity.from_priority(got["PRIORITY"]).alias("initial_severity"), got["_SYSTEMD_UNIT"].alias("unit"), got["_PID"].alias("pid"), got["host"].alias("host"), got["timestamp"].try_cast("timestamp").alias("ts"), got["file"].alias("file"), F.lit("journald").alias("source"), *keep
    ).where("raw <> ''")


def union_sources(first: DataFrame, *others: DataFrame) -> DataFrame:
    """UNION ALL by name."""
    for df in others:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def merge_lines(lines: DataFrame, file: str = "file", order: str = "line_no", raw: str = "raw") -> DataFrame:
    """A line with a header starts an event, others are added to it; what comes before a file's first header is one event.

    ``order`` numbers a file's lines; a long file is dealt out by stretches of them (``running``), and what a stretch begins
    with goes to the event of the last header before it.  Only an event's own lines must fit into memory.
    """
    start = F.col(raw).rlike(EVENT_START).cast("int")
    marked = running.running_sum(lines, start, "_event", keys=[file], order=[order], stretch=running.by_line(order))
    got = marked.groupBy(file, "_event").agg(F.min(order).alias(order), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(raw).alias("r")))).alias("_lines"))
    return got.select(file, order, F.array_join(F.transform("_lines", lambda x: x["r"]), "\n").alias(raw), F.size("_lines").cast("long").alias("n_lines"))


def receiver_source(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(received_at, envelope) of a receiver's JSON lines; blank lines are passed over, a line that is no JSON is kept in ``bad``."""
    text = F.col("value")
    got = F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, f"received_at string, envelope {wire.ENVELOPE}"))
    rows = spark.read.text(path).where(F.trim("value") != "").select(got.alias("r"), "value")
    return rows.select("r.received_at", "r.envelope", F.when(F.col("r").isNull(), F.col("value")).alias("bad"))


def spool_source(spark: SparkSession, folder: str) -> DataFrame:
    """(name, ms, envelope, bad) of a spool's ``.json`` files in order of their names, which begin with a ULID; hidden files are left out."""
    files = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    rows = files.select(F.col("_metadata.file_name").alias("name"), F.trim("value").alias("value")).where(~F.startswith("name", F.lit(".")))
    envelope = wire.from_json(F.col("value"))
    return rows.select("name", scalars.ulid_ms(F.col("name")).alias("ms"), envelope.alias("envelope"), F.when(envelope.isNull(), F.col("value")).alias("bad")).orderBy("name")


def spooled_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(name, ms, envelope, bad) of what ``streaming.agent.write_envelopes`` wrote, in order of the names, which begin with a ULID."""
    rows = spark.read.schema("name string, json string").json(folder)
    envelope = wire.from_json(F.col("json"))
    return rows.select("name", scalars.ulid_ms(F.col("name")).alias("ms"), envelope.alias("envelope"), F.when(envelope.isNull(), F.col("json")).alias("bad")).orderBy("name")


def recent_events(lines: DataFrame, now: Column, hours: int = 4, most: int = 500, gap_s: int = 14400) -> DataFrame:
    """S11, L-1: patterns of the last hours in lines (raw, source, file, line_no), the latest first, at most ``most``.

    Lines without a time that can be read are dropped, as are older ones.  Only two kinds of source are told apart.
    """
    raw = F.col("raw")
    at = normalize.once(raw, lambda line: F.coalesce(scalars.parse_syslog_ts(line, now), scalars.parse_iso_ts(line)))
    source = F.when(F.col("file").rlike("auth|secure"), "file.auth").otherwise("file.syslog")
    fresh = lines.where(raw != "").withColumn("ts", at).where(F.col("ts") >= now - F.make_dt_interval(hours=F.lit(hours)))
    own = fresh.select("raw", "ts", source.alias("source"), F.struct("file", "line_no").alias("order"))
    found = dedup.dedup(dedup.templates(own), ["template", "severity", "source"], gap_s, order="order", carry=())
    out = found.withColumn("category", dedup.category_of(F.col("first_raw")))
    return out.orderBy(F.desc("ts_first"), "source", "template").limit(most)


def raw_scan(lines: DataFrame, now: Column, since_s: int | None = None, until_s: int | None = None, most_bytes: int | None = None) -> DataFrame:
    """S12, F5, L-5: lines (raw, source, file, line_no) of logs, each from its oldest rotated file to the newest, within a time range and a number of bytes.

    ``since_s`` is held to a second and a day and is an hour where it isn't given; ``until_s`` counts if it is less than
    that and not below zero.  Lines without a time that can be read are kept.  ``used_bytes`` counts lines and their ends
    and a header for each log; from the first line on that goes beyond ``most_bytes`` all are left out and ``truncated`` says
    so.  Files are counted on their own, by stretches of their lines, and then put one after another.
    """
    since = min(max(3600 if since_s is None else since_s, 1), 86400)
    until = until_s if until_s is not None and 0 <= until_s < since else 0
    raw = F.col("raw")
    at = normalize.once(raw, lambda line: F.coalesce(scalars.parse_syslog_ts(line, now), scalars.parse_iso_ts(line)))
    ranged = lines.where(raw != "").withColumn("ts", at).where(F.col("ts").isNull() | F.col("ts").between(now - F.make_dt_interval(secs=F.lit(since)), now - F.make_dt_interval(secs=F.lit(until))))
    base = F.regexp_replace("file", r"(\.\d+)?(\.gz)?$", "")
    log = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in SOURCES]), F.col("source")), F.lit(0)), F.lit(len(SOURCES) + 1))
    placed = ranged.withColumns({"base": base, "log": log, "rank": rotation_rank(F.col("file")), "_bytes": F.octet_length(raw) + 1})
    file = ("log", "base", "rank", "file")
    sizes = placed.groupBy(*file).agg(F.first("source").alias("_source"), F.sum("_bytes").alias("_size"))
    # one row for each file
    in_log = F.row_number().over(Window.partitionBy("log", "base").orderBy("rank", "file"))
    headed = sizes.withColumn("_head", F.when(in_log == 1, F.octet_length(section_header(F.col("_source"), F.col("base"))) + 1).otherwise(0))
    before = Window.orderBy(*file).rowsBetween(Window.unboundedPreceding, -1)
    offsets = headed.withColumn("_before", F.coalesce(F.sum(F.col("_size") + F.col("_head")).over(before), F.lit(0)) + F.col("_head"))
    counted = running.running_sum(placed, F.col("_bytes"), "_used", keys=list(file), order=["line_no"], stretch=running.by_line("line_no"))
    base = offsets.select(*file, F.col("_before").alias("_base"))
    out = counted.join(base, list(file)).withColumn("used_bytes", F.col("_base") + F.col("_used")).drop("_base", "_used", "_bytes")
    total = offsets.agg(F.coalesce(F.sum(F.col("_size") + F.col("_head")), F.lit(0)).alias("_total"))
    out = out.crossJoin(F.broadcast(total))  # one row: the sum
    over = F.lit(False) if most_bytes is None else F.col("_total") > most_bytes
    out = out.withColumn("truncated", over).drop("_total")
    return out if most_bytes is None else out.where(F.col("used_bytes") <= most_bytes)


def section_header(source: Column, path: Column) -> Column:
    return F.concat(F.lit("==> "), source, F.lit(" ("), path, F.lit(") <=="))


def journal_folder(exists=lambda path: True) -> str | None:
    """The journal's folder, the volatile one first."""
    return next((p for p in JOURNALS if exists(p)), None)


def build_sources(spark: SparkSession, family: str | None, exists=lambda path: True, journal: str | None = None) -> DataFrame | None:
    """The sources that are there, as one DataFrame; ``journal``: an export of the journal.  None: there is none."""
    found = [text_source(spark, path).withColumn("source", F.lit(name)) for name, path in log_paths(family, exists).items()]
    if journal and exists(journal):
        found.append(journal_source(spark, journal))
    return union_sources(*found) if found else None


def malformed(lines: DataFrame, column: str = "value") -> DataFrame:
    """The lines that ``parse_journal`` leaves out since they are no object, for a count or a quarantine."""
    text = F.col(column)
    return lines.where((F.trim(text) != "") & (F.try_parse_json(text).isNull() | ~F.startswith(F.ltrim(text), F.lit("{"))))
