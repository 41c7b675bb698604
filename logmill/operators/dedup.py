"""From lines to patterns, sessions of patterns, and cycles."""

from __future__ import annotations

from collections import OrderedDict
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logmill.functions import classify, extract, normalize, severity


def templates(lines: DataFrame, raw: str = "raw", unicode: bool | None = None) -> DataFrame:
    """Add program, template and severity; empty messages are dropped.

    Severity reads the raw line, the template the stripped one.
    """
    r, message = F.col(raw), F.col("_message")
    initial = F.when(F.col("priority").isNotNull(), severity.from_priority(F.col("priority"))).otherwise("info") if "priority" in lines.columns else F.lit("info")
    # what several expressions read is a column of its own first: the optimizer doesn't merge such projections
    read = lines.where(r.isNotNull() & (r != "")).withColumns({"program": normalize.syslog_program(r, unicode), "_message": normalize.strip_prefix(r, unicode)})
    return read.withColumns({"template": normalize.normalize(message, unicode), "severity": severity.finalize(initial, r)}).drop("_message")


def category_of(raw: Column, rules: list[classify.Rule] | None = None, unicode: bool | None = None) -> Column:
    """Category of a line with its header."""
    logger = F.regexp_extract(normalize.strip_prefix(raw, unicode), r"\blogger=(\S+)", 1) if any(x.logger for x in rules or classify.RULES) else None
    return classify.categorize(raw, normalize.syslog_program(raw, unicode), logger, rules)


def patterns(lines: DataFrame, raw: str = "raw", unicode: bool | None = None, rules: list[classify.Rule] | None = None) -> DataFrame:
    """``templates`` with the category of every line."""
    return templates(lines, raw, unicode).withColumn("category", category_of(F.col(raw), rules, unicode))


def pattern_counts(lines: DataFrame, raw: str = "raw", keys: tuple[str, ...] = ("template", "severity", "source"), rules: list[classify.Rule] | None = None) -> DataFrame:
    """Counts by pattern; only one line of each, the first in order of its text, is categorised, after the aggregation."""
    return templates(lines, raw).groupBy(*keys).agg(F.count("*").alias("n"), F.min(raw).alias("first_raw")).withColumn("category", category_of(F.col("first_raw"), rules))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def sessions(events: DataFrame, keys: list[str], gap_s: int = 30, ts: str = "ts", order: str = "event_id", cycle_s: int | None = None) -> DataFrame:
    """Add ``session``; a line starts one when ``gap_s`` whole seconds or more passed since the one before.

    With ``cycle_s`` a session also ends with each cycle.
    """
    cycle = [F.floor(micros(F.col(ts)) / (cycle_s * 1_000_000))] if cycle_s else []
    w = Window.partitionBy(*keys, *cycle).orderBy(ts, order)
    before = F.lag(ts).over(w)
    starts = F.when(before.isNull() | (micros(F.col(ts)) - micros(before) >= gap_s * 1_000_000), 1).otherwise(0)
    out = events.withColumn("_starts", starts)
    if cycle:
        out = out.withColumn("cycle", cycle[0])
    return out.withColumn("session", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_starts")


def dedup(events: DataFrame, keys: list[str], gap_s: int = 30, samples: int = 3, ts: str = "ts", order: str = "event_id", cycle_s: int | None = None, carry: tuple[str, ...] = ("severity", "category", "source", "template")) -> DataFrame:
    """A1 to A3: one row for each session, with count, ends, first samples and what the first line carries.

    Lines meet by key and stretch of time, where they become parts of sessions; parts that follow each other within the
    gap are joined then.  So a key that has a large share of all lines is spread over tasks.  With ``cycle_s`` a stretch
    is a cycle, and nothing is left to be joined; a gap of a cycle or more parts none of its lines, so that they are counted
    where they are read.  Samples are ranked before they are gathered: memory doesn't grow with a session's length.
    """
    at = F.struct(F.col(ts).alias("t"), F.col(order).alias("o"))
    whole = bool(cycle_s) and gap_s >= cycle_s
    if whole:
        # a line without a time has no cycle and is a session of its own
        alone = F.when(F.col(ts).isNull(), F.monotonically_increasing_id())
        keyed = events.withColumns({"cycle": F.floor(micros(F.col(ts)) / (cycle_s * 1_000_000)), "_alone": alone})
    else:
        keyed = sessions(events, keys, gap_s, ts, order, cycle_s or max(3600, 20 * gap_s))
    group = [*keys, "cycle", "_alone" if whole else "session"]
    ranked = keyed.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(ts, order)))
    carried = [c for c in carry if c not in keys]
    first = F.min_by(F.struct(F.col("raw").alias("first_raw"), *carried), at).alias("_first")
    sample = F.array_sort(F.collect_list(F.when(F.col("_n") <= samples, F.struct(F.col("_n").alias("n"), F.col("raw").alias("raw"))))).alias("_samples")
    critical = [F.max(F.col("severity") == "critical").alias("_critical")] if "severity" in carried else []
    parts = ranked.groupBy(*group).agg(F.count("*").alias("count"), F.min(ts).alias("ts_first"), F.max(ts).alias("ts_last"), F.min(at).alias("_at"), first, sample, *critical)
    if whole:
        parts = parts.withColumn("session", F.row_number().over(Window.partitionBy(*keys, "cycle").orderBy("_at")).cast("long"))
    if not cycle_s:
        w = Window.partitionBy(*keys).orderBy("_at")
        before = F.lag("ts_last").over(w)
        starts = F.when(before.isNull() | (micros(F.col("ts_first")) - micros(before) >= gap_s * 1_000_000), 1).otherwise(0)
        placed = parts.drop("session").withColumn("_starts", starts).withColumn("session", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        # no part after the first ones that hold the samples has to bring its own
        held = F.coalesce(F.sum(F.size("_samples")).over(Window.partitionBy(*keys, "session").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = placed.withColumn("_samples", F.when(held < samples, F.struct("_at", "_samples")))
        joined = F.flatten(F.transform(F.array_sort(F.collect_list("_samples")), lambda x: x["_samples"]))
        parts = placed.groupBy(*keys, "session").agg(F.sum("count").alias("count"), F.min("ts_first").alias("ts_first"), F.max("ts_last").alias("ts_last"), F.min_by("_first", "_at").alias("_first"), F.slice(joined, 1, samples).alias("_samples"), *([F.max("_critical").alias("_critical")] if critical else []))
    # A3: severity is raised only where it is no key
    told = [F.when(F.col("_critical"), "critical").otherwise(F.col("_first.severity")).alias(c) if c == "severity" else F.col(f"_first.{c}").alias(c) for c in carried]
    own = [*keys, *(["cycle"] if cycle_s else []), "session"]
    return parts.select(*own, "count", "ts_first", "ts_last", F.col("_first.first_raw").alias("first_raw"), *told, F.transform("_samples", lambda x: x["raw"]).alias("sample_raws"))


def with_fields(events: DataFrame, raw: str = "first_raw", extra: dict[str, Column] | None = None) -> DataFrame:
    """Fields of a session's first line alone; F10: ``extra`` (pid, unit, priority, file, host of the source) where the line has none of that name."""
    own = normalize.bound(events, _message=normalize.strip_prefix(F.col(raw)))
    out = own.withColumn("fields", extract.all_fields(F.col("_message"))).drop("_message")
    # a column of its own first: a lambda can't hold the scan of JSON
    return out.withColumn("fields", extract.backfill(F.col("fields"), extra)) if extra else out


def fold_cap(severities: list[str], most: int) -> list[tuple[int, str]]:
    """L-6: (place, kept, evicted or skipped) of events in order of arrival, at most ``most`` of them kept.

    At the limit a critical event evicts the oldest of all; another one evicts the oldest that isn't critical, or is skipped.
    """
    state = ["kept"] * len(severities)
    every: OrderedDict[int, None] = OrderedDict()
    common: OrderedDict[int, None] = OrderedDict()
    for i, s in enumerate(severities):
        if len(every) >= most:
            if s == "critical" and every:
                out = next(iter(every))
            elif common:
                out = next(iter(common))
            else:
                state[i] = "skipped"
                continue
            every.pop(out)
            common.pop(out, None)
            state[out] = "evicted"
        every[i] = None
        if s != "critical":
            common[i] = None
    return list(enumerate(state))


def cap_state(critical: np.ndarray, most: int) -> tuple[int, int]:
    """(uncritical events that are kept, the place up to which they are taken) of a cycle of more than ``most`` events.

    What is kept are always the last uncritical and the last critical ones, ``most`` together, so that the number of the
    former says all.  It never rises once ``most`` events are there: a critical event lowers it if the oldest event
    kept is an uncritical one.  At none the uncritical events that follow are skipped.
    """
    common, urgent = np.flatnonzero(~critical), np.flatnonzero(critical)
    kept = int(np.searchsorted(common, most))
    if not kept:
        return 0, most
    before = np.searchsorted(common, urgent)
    for j in range(int(np.searchsorted(urgent, most)), len(urgent)):
        held = most - kept
        if not held or common[before[j] - kept] < urgent[j - held]:
            kept -= 1
            if not kept:
                return 0, int(urgent[j]) + 1
    return kept, len(critical)


def cycle_cap(events: DataFrame, keys: list[str], most: int, order: str = "event_id") -> DataFrame:
    """L-6 for each cycle: add ``outcome``, as ``fold_cap`` gives it.

    Of a cycle over the cap one flag an event comes together, from which ``cap_state`` tells two numbers; the events
    themselves are only counted by a window.  Where no cycle has more than ``most`` events all are kept.
    """

    @F.pandas_udf("kept long, until long")
    def state(flags: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([cap_state(np.asarray(x, bool), most) for x in flags], columns=["kept", "until"]).astype("int64")

    urgent = F.coalesce(F.col("severity") == "critical", F.lit(False))
    names = [f"_key{i}" for i in range(len(keys))]
    flags = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), urgent.alias("c")))), lambda x: x["c"])
    large = events.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True))).agg(F.count("*").alias("_n"), flags.alias("_flags")).where(F.col("_n") > most)
    large = large.select(*names, state("_flags").alias("_state"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)])
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    counted = events.join(large, same, "left").withColumns({"_place": F.row_number().over(Window.partitionBy(*keys).orderBy(order)), "_urgent": F.count_if(urgent).over(w), "_all": F.count("*").over(whole), "_all_urgent": F.count_if(urgent).over(whole)})
    common_after = F.col("_all") - F.col("_all_urgent") - (F.col("_place") - F.col("_urgent"))
    kept = F.when(urgent, F.col("_all_urgent") - F.col("_urgent") < most - F.col("_state.kept")).otherwise(common_after < F.col("_state.kept"))
    outcome = F.when(F.col("_state").isNull() | kept, "kept").when(~urgent & (F.col("_place") > F.col("_state.until")), "skipped").otherwise("evicted")
    return counted.withColumn("outcome", outcome).drop(*names, "_state", "_place", "_urgent", "_all", "_all_urgent")


def cap_counters(events: DataFrame, keys: list[str], most: int, order: str = "event_id") -> DataFrame:
    """L-6: how many events of each cycle were kept, evicted and skipped."""
    told = cycle_cap(events, keys, most, order)
    return told.groupBy(*keys).agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("kept", "evicted", "skipped")))
