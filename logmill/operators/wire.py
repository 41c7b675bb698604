"""Envelopes as they travel: built from the events of a cycle, written as JSON, read back and taken apart.

An envelope has ``event_kind``, ``cycle`` (host, host_id, boot_id, ts, window, seq), ``headers`` (total_sections, counts,
process_health, duration_ms) and ``body``, a list of sections with a name and JSON data.  A log batch has one section,
``logs``, with the cycle's events, or none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logmill.functions import normalize, scalars
from logmill.operators import dedup, envelopes
from logmill.sources import scratch

# The wire format.
SEVERITIES = ["critical", "error", "warn", "info"]
EVENT = "struct<source:string,severity:string,category:string,fingerprint:string,template:string,sample_raws:array<string>,fields:map<string,string>,ts_first:string,ts_last:string,count:bigint>"
CYCLE = "struct<host:string,host_id:string,boot_id:string,ts:string,window:string,seq:bigint>"
COUNTS = "struct<by_severity:struct<critical:bigint,error:bigint,warn:bigint,info:bigint>,by_category:map<string,bigint>>"
HEADERS = f"struct<total_sections:bigint,counts:{COUNTS},process_health:struct<vector_restarts_24h:int,agent_uptime_seconds:bigint>,duration_ms:bigint>"
ENVELOPE = f"struct<event_kind:string,cycle:{CYCLE},headers:{HEADERS},body:array<struct<section:string,data:string>>>"
KINDS = {"log_batch": "ingest", "stat_snapshot": "stat", "sos_snapshot": "sos"}
MOST_EVENTS = 100_000


def event(df: DataFrame) -> Column:
    """One event of a log batch; field values are JSON already and are written as such."""
    fields = F.transform_values(F.coalesce("fields", F.create_map().cast("map<string,string>")), lambda _, v: F.parse_json(v))
    at = [scalars.rfc3339(F.col(c).cast("timestamp")).alias(c) for c in ("ts_first", "ts_last")]
    return F.struct("source", "severity", "category", normalize.fingerprint(F.col("template"), F.col("severity"), F.col("source")).alias("fingerprint"), "template", "sample_raws", fields.alias("fields"), *at, F.col("count").cast("bigint").alias("count"))


def envelope(*, start: Column, end: Column, host_id: Column, boot_id: Column, restarts: Column | None = None, uptime: Column | None = None) -> Column:
    """A log batch of ``host``, ``seq``, sums by severity, ``by_category`` and ``data``, the events' JSON texts in order; no events: no section."""
    section = F.struct(F.lit("logs").alias("section"), F.concat(F.lit("["), F.array_join("data", ","), F.lit("]")).alias("data"))
    body = F.when(F.size("data") > 0, F.array(section)).otherwise(F.array().cast("array<struct<section:string,data:string>>"))
    cycle = F.struct("host", host_id.alias("host_id"), boot_id.alias("boot_id"), scalars.rfc3339(start).alias("ts"), scalars.window_text(start, end).alias("window"), F.col("seq").cast("bigint").alias("seq"))
    health = F.struct((restarts if restarts is not None else F.lit(0)).cast("int").alias("vector_restarts_24h"), (uptime if uptime is not None else F.lit(0)).cast("bigint").alias("agent_uptime_seconds"))
    counts = F.struct(F.struct(*SEVERITIES).alias("by_severity"), "by_category")
    headers = F.struct(F.size(body).cast("bigint").alias("total_sections"), counts.alias("counts"), health.alias("process_health"), (F.unix_millis(end) - F.unix_millis(start)).alias("duration_ms"))
    return F.struct(F.lit("log_batch").alias("event_kind"), cycle.alias("cycle"), headers.alias("headers"), body.alias("body"))


def log_batches(events: DataFrame, *, host_id: Column, boot_id: Column, cycle_s: int = envelopes.CYCLE_S, numbered: DataFrame | None = None, most: int = MOST_EVENTS, restarts: Column | None = None, uptime: Column | None = None, order: str = "event_id") -> DataFrame:
    """(host, cycle, envelope) for each host and cycle of ``events`` (sessions with ``fields``).

    Of a cycle at most ``most`` events are in the body (L-6); those that were evicted later are counted, skipped ones are
    not.  ``seq`` goes on from ``numbered`` (host, seq: the last number of each), or from 0; cycles that have their numbers
    already should not come again.  The events are written once (``scratch``), since the cap, the sums and the numbers all
    read them; sums and body come from one aggregation.
    """
    keys = ["host", "cycle"]
    events, _ = scratch.materialise(events, "cycle-events")
    told = dedup.cycle_cap(events, keys, most, order)
    kept = F.when(F.col("outcome") == "kept", F.struct(F.col(order).alias("o"), F.to_json(event(told)).alias("e")))
    by_category = told.where("outcome <> 'skipped'").groupBy(*keys, "category").agg(*envelopes.severity_sums(), F.sum("count").alias("n"), F.collect_list(kept).alias("part"))
    sums = [F.sum(s).alias(s) for s in SEVERITIES]
    categories = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("category").alias("key"), F.col("n").alias("value"))))).alias("by_category")
    data = F.transform(F.array_sort(F.flatten(F.collect_list("part"))), lambda x: x["e"]).alias("data")
    rows = by_category.groupBy(*keys).agg(*sums, categories, data)
    # numbers without the bodies: a host has a row for each cycle
    place = F.row_number().over(Window.partitionBy("host").orderBy("cycle")).cast("bigint")
    numbers = events.select(*keys).distinct().withColumn("place", place)
    if numbered is not None:
        numbers = numbers.join(numbered.select("host", F.col("seq").alias("last")), "host", "left")
    else:
        numbers = numbers.withColumn("last", F.lit(None).cast("bigint"))
    numbers = numbers.select(*keys, (F.coalesce("last", F.lit(-1)) + F.col("place")).alias("seq"))
    start = F.timestamp_seconds(F.col("cycle") * cycle_s)
    made = envelope(start=start, end=start + F.make_dt_interval(secs=F.lit(cycle_s)), host_id=host_id, boot_id=boot_id, restarts=restarts, uptime=uptime)
    return rows.join(numbers, keys).select("host", "cycle", made.alias("envelope"))


def to_json(envelope: Column) -> Column:
    """An envelope as JSON; sections' data is JSON, not text."""
    body = F.transform(envelope["body"], lambda s: F.struct(s["section"].alias("section"), F.parse_json(s["data"]).alias("data")))
    return F.to_json(F.struct(envelope["event_kind"].alias("event_kind"), envelope["cycle"].alias("cycle"), envelope["headers"].alias("headers"), body.alias("body")))


def from_json(text: Column) -> Column:
    """The envelope of a JSON text; what it lacks is null, and a text that is no JSON gives null."""
    return F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, ENVELOPE))


def sections(envelopes: DataFrame, envelope: str = "envelope") -> DataFrame:
    """A row for each section, with the envelope's other columns."""
    return envelopes.select("*", F.explode(F.col(envelope)["body"]).alias("_s")).select("*", F.col("_s.section").alias("section"), F.col("_s.data").alias("data")).drop("_s")


def events_of(envelopes: DataFrame, envelope: str = "envelope") -> DataFrame:
    """A row for each event in the envelopes' sections; sections whose data is no list have none."""
    rows = sections(envelopes, envelope)
    host = F.coalesce(F.col(envelope)["cycle"]["host"], F.lit("unknown"))
    rows = rows.where(F.startswith(F.ltrim("data"), F.lit("["))).select("*", host.alias("_host"), F.posexplode(F.from_json("data", f"array<{EVENT}>")).alias("place", "_e"))
    rest = [c for c in envelopes.columns if c not in (envelope, "host")]
    return rows.select(*rest, F.col("_host").alias("host"), F.col(envelope)["cycle"]["seq"].alias("seq"), "section", "place", "_e.*")


def store_of(kind: Column) -> Column:
    """Where envelopes of a kind are kept, null for unknown ones."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), kind)


def compare(events: DataFrame, fingerprint: str, samples: int = 3, order: str = "received_at") -> DataFrame:
    """A8, L-4: one pattern over hosts, the most frequent first, with the total and how many hosts have it.

    Samples are taken event by event until there are ``samples`` or more.  No rows: the fingerprint isn't there.
    """
    own = events.where(F.col("fingerprint") == fingerprint)
    at = F.struct(order, "seq", "place")
    before = F.sum(F.size("sample_raws")).over(Window.partitionBy("host").orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("_taken", F.coalesce(before, F.lit(0)) < samples)
    raws = F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.col("_taken"), F.struct(at.alias("at"), F.col("sample_raws").alias("raws"))))), lambda x: x["raws"]))
    by_host = own.groupBy("host").agg(F.sum(F.coalesce("count", F.lit(1))).alias("n"), F.count("*").alias("cycles_seen"), F.min("ts_first").alias("ts_first"), F.max("ts_last").alias("ts_last"), F.min_by("severity", at).alias("severity"), F.min_by("category", at).alias("category"), F.min_by("template", at).alias("template"), raws.alias("sample_raws"))
    total = by_host.agg(F.sum("n").alias("total_count"), F.count("*").alias("affected_hosts"))
    return by_host.crossJoin(F.broadcast(total)).orderBy(F.desc("n"), "host")  # one row: the sums


def analyze(records: DataFrame, envelope: str = "envelope", at: str = "received_at") -> DataFrame:
    """Envelopes by kind: where they are kept, how many came, the last time, and which sections they have."""
    kind = F.col(envelope)["event_kind"]
    names = F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.transform(F.col(envelope)["body"], lambda s: s["section"])))))
    return records.groupBy(kind.alias("kind")).agg(F.count("*").alias("received"), F.max(at).alias("latest"), names.alias("section_names")).withColumn("store", store_of(F.col("kind")))


def bound_by_host(records: DataFrame, envelope: str = "envelope", at: str = "received_at") -> DataFrame:
    """For each host_id the last envelope of each of the three kinds, in one row."""
    last = [F.max_by(F.when(F.col(envelope)["event_kind"] == k, F.col(envelope)), F.when(F.col(envelope)["event_kind"] == k, F.col(at))).alias(k) for k in KINDS]
    return records.groupBy(F.col(envelope)["cycle"]["host_id"].alias("host_id")).agg(*last)


def gold_matches(events: DataFrame, gold: DataFrame) -> DataFrame:
    """Labelled events by ``host|fingerprint|ts_first``, joined on the three parts; columns of ``gold`` beside ``uid`` follow."""
    part = F.split("uid", r"\|", 3)
    keyed = gold.select("*", part[0].alias("host"), part[1].alias("fingerprint"), part[2].alias("ts_first")).drop("uid")
    uid = F.concat_ws("|", "host", "fingerprint", "ts_first")
    return events.join(keyed, ["host", "fingerprint", "ts_first"]).withColumn("uid", uid)


def failed_users(events: DataFrame) -> DataFrame:
    """F8: (user, count) of the events of failed logins that name one."""
    user = F.col("fields")["user"]
    return events.where((F.col("category") == "auth.failure") & user.isNotNull()).select(user.alias("user"), "count")
