"""Cycle rollups, receiver queries, alerts and delivery bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logmill.functions.severity import LEVELS
from logmill.operators.running import running_sum

CYCLE_S = 1800
# Fixed values.
ALERTS = {"kernel.panic", "kernel.oom", "container.oom", "hw.mce", "fs.readonly"}


#: What to do first, for each category but the fallback.
PLAYBOOK = [
    ("kernel.oom", "add memory"),
    ("container.oom", "raise the container's memory limit"),
    ("kernel.bug", "update the kernel"),
    ("kernel.panic", "collect the crash dump and reboot"),
    ("process.crash", "read the core dump"),
    ("fs.error", "check the file system"),
    ("fs.readonly", "check the disk, then remount"),
    ("hw.mce", "test memory and processor"),
    ("disk.smart_error", "back up and replace disk"),
    ("disk.io_error", "replace disk"),
    ("disk.link_error", "check the cable and controller"),
    ("net.error", "raise the connection limits"),
    ("net.watchdog", "update the driver or replace the card"),
    ("systemd.unit_failure", "read the unit's journal"),
    ("systemd.restart_loop", "fix the unit's start, then reset it"),
    ("auth.bruteforce", "block address"),
    ("auth.failure", "check the account"),
    ("auth.event", "confirm that the login was expected"),
    ("session.activity", "none needed"),
    ("ntp.drift", "check the time source"),
    ("selinux.denial", "review the policy"),
]


def severity_sums(weight: str = "count") -> list[Column]:
    """A4: sums by severity; unknown ones count as info."""
    known = F.coalesce(F.col("severity").isin(LEVELS[:3]), F.lit(False))
    sums = [F.sum(F.when(F.col("severity") == s, F.col(weight)).otherwise(0)).alias(s) for s in LEVELS[:3]]
    return [*sums, F.sum(F.when(~known, F.col(weight)).otherwise(0)).alias("info")]


def by_severity(df: DataFrame, keys: list[str], weight: str = "count") -> DataFrame:
    return df.groupBy(*keys).agg(*severity_sums(weight))


def by_category(df: DataFrame, keys: list[str], weight: str = "count") -> DataFrame:
    """A5: one row for each key and category."""
    return df.groupBy(*keys, "category").agg(F.sum(weight).alias("n"))


def idempotent(records: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first of each key."""
    return records.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


def unseen(records: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Those whose key isn't there yet."""
    return records.join(seen.select(*keys), keys, "left_anti")


def logs(events: DataFrame, limit: int = 100, **equal) -> tuple[DataFrame, DataFrame]:
    """F7, L-3: the latest events that equal what is given, and how many there are before the limit."""
    for name, value in equal.items():
        if value is not None:
            events = events.where(F.col(name) == value)
    return events.orderBy(F.desc("ts_first"), "event_id").limit(limit), events.agg(F.count("*").alias("total"))


def hosts(records: DataFrame) -> DataFrame:
    """A7, L-4: one row for each host; both the last and the largest sequence number."""
    sums = [F.sum(s).alias(s) for s in LEVELS]
    return records.groupBy("host").agg(F.count("*").alias("envelopes"), F.min("received_at").alias("first_seen"), F.max("received_at").alias("last_seen"), *sums, F.max_by("seq", F.struct("received_at", "seq")).alias("last_seq"), F.max("seq").alias("max_seq")).orderBy(F.desc("last_seen"), "host")


def seq_gaps(records: DataFrame, host: str = "host", seq: str = "seq") -> DataFrame:
    """Ranges of numbers that a host skipped."""
    after = F.lead(seq).over(Window.partitionBy(host).orderBy(seq))
    return records.select(host, seq).distinct().select(host, (F.col(seq) + 1).alias("gap_from"), (after - 1).alias("gap_to")).where("gap_to >= gap_from")


def silence(records: DataFrame, minutes: int = 35, at: str = "received_at", key: str = "host") -> DataFrame:
    """Times in which a host sent nothing for longer."""
    before = F.lag(at).over(Window.partitionBy(key).orderBy(at))
    gap = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 60_000_000
    return records.select(key, before.alias("silent_from"), F.col(at).alias("silent_to"), gap.alias("minutes")).where(F.col("minutes") > minutes)


def alerts(events: DataFrame) -> DataFrame:
    """Events of alarming categories, and bursts."""
    reason = F.when(F.col("category").isin(sorted(ALERTS)), "category").when((F.col("category") == "auth.bruteforce") | (F.col("count") >= 10), "burst")
    return events.withColumn("reason", reason).where("reason is not null")


def surges(counts: DataFrame, key: str = "host", cycle: str = "cycle", n: str = "error", factor: int = 10) -> DataFrame:
    """Cycles with ``factor`` times the errors of the one before."""
    before = F.lag(n).over(Window.partitionBy(key).orderBy(cycle))
    return counts.withColumn("before", before).where((F.col("before") > 0) & (F.col(n) >= factor * F.col("before")))


def boot_changes(records: DataFrame, order: str = "received_at") -> DataFrame:
    """Records whose boot id isn't the one before."""
    before = F.lag("boot_id").over(Window.partitionBy("host").orderBy(order))
    return records.withColumn("boot_before", before).where(F.col("boot_before") != F.col("boot_id"))


def time_range(df: DataFrame, ts: str, start: Column, end: Column) -> DataFrame:
    """both ends belong to it."""
    return df.where(F.col(ts).between(start, end))


def byte_budget(lines: DataFrame, most: int, partition: str | None, order: str, stretch: Column, raw: str = "raw") -> DataFrame:
    """L-5: the first lines that fit, each with a line end; nothing after the first that doesn't.

    ``stretch`` rises with ``order`` (``running``): one host's lines are spread over tasks, and stretches beyond the
    budget aren't read again.  A null line has no bytes but its end.
    """
    size = F.coalesce(F.octet_length(raw), F.lit(0)) + 1
    return running_sum(lines, size, "used_bytes", keys=[partition] if partition else [], order=[order], stretch=stretch, most=most)


def retry_kept(ledger: DataFrame, now: Column, ttl_hours: int, most_bytes: int, key: str = "host") -> DataFrame:
    """K5: neither too old nor, from the newest on, beyond the bytes."""
    fresh = ledger.where(F.col("queued_at") > now - F.make_dt_interval(hours=F.lit(ttl_hours)))
    w = Window.partitionBy(key).orderBy(F.desc("queued_at"), F.desc("name")).rowsBetween(Window.unboundedPreceding, 0)
    return fresh.withColumn("newer_bytes", F.sum("bytes").over(w)).where(F.col("newer_bytes") <= most_bytes)


def too_large(document: Column, most: int) -> Column:
    """Whether a JSON document has more bytes than a response may (0: any)."""
    return F.octet_length(document) > most if most else F.lit(False)


def quarantined(documents: DataFrame, document: str = "value", at: str = "queued_at", key: str = "host", most_bytes: int = 256 << 20) -> DataFrame:
    """K6: documents that are no JSON, from the newest on up to the bytes."""
    bad = documents.where(F.try_parse_json(F.col(document)).isNull())
    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc(document)).rowsBetween(Window.unboundedPreceding, 0)
    return bad.withColumn("newer_bytes", F.sum(F.octet_length(document)).over(w)).where(F.col("newer_bytes") <= most_bytes)


def crash_rate(crashes: DataFrame, key: str = "host", ts: str = "ts", seconds: int = 3600) -> DataFrame:
    """How many crashes the hour up to each one had, itself included."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return crashes.withColumn("in_window", F.count("*").over(w))


def numbered(records: DataFrame, stretch: Column, source: str = "source", order: str = "received_at") -> DataFrame:
    """L-8: each source's envelopes from 1 on; ``stretch`` rises with ``order`` (``running``)."""
    return running_sum(records, F.lit(1).cast("long"), "number", keys=[source], order=[order], stretch=stretch)


def drain_window(ledger: DataFrame, ms: Column, start: int, end: int) -> DataFrame:
    """K7: from ``start`` on, before ``end``."""
    return ledger.where((ms >= start) & (ms < end))


def drain_status(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by state, bytes and what that says."""
    done = F.count_if(F.col("state") == "sent")
    failed = F.count_if(F.col("state") == "failed")
    rest = F.count("*") - done - failed
    return ledger.groupBy(*keys).agg(F.count("*").alias("queued"), rest.alias("remaining"), done.alias("succeeded"), failed.alias("failed"), F.sum("bytes").alias("bytes"), F.when(rest == 0, "completed").when(rest == F.count("*"), "idle").otherwise("in_progress").alias("status"))


def retry_wait(attempt: int, critical: bool, status: int | None, retry_after: int | None = None, limit: int = 5, base: float = 5, most: float = 300) -> float | None:
    """K1, K3: seconds to wait after a failed attempt (0 on), None to give up; twice the limit for critical ones."""
    if status is not None and 200 <= status < 300:
        return 0.0
    if status is not None and 300 <= status < 500 and status != 429:
        return None
    if attempt + 1 >= limit * (2 if critical else 1):
        return None
    return float(retry_after or 60) if status == 429 else min(base * 2**attempt, most)
