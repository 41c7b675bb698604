"""Alarms on streams: silence by a timer (R6), lines near incidents by an interval join (X7), first records only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from logmill.functions import normalize, severity
from logmill.operators import dedup
from logmill.streaming import agent

SILENCE = "host string, silent_from timestamp, silent_to timestamp, minutes double"


class Silence(StatefulProcessor):
    """A host's last record, and a timer for the time from which it has been silent for too long."""

    def __init__(self, most_us: int):
        self.most_us = most_us

    def init(self, handle) -> None:
        self.handle = handle
        self.meta = handle.getValueState("meta", "last_us long, timer_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, timer = self.meta.get() if self.meta.exists() else (None, 0)
        us = np.unique(np.concatenate([part["us"].to_numpy(np.int64) for part in rows]))
        if last is not None:
            us = np.concatenate(([last], us[us > last]))
        gaps = np.flatnonzero(np.diff(us) > self.most_us)
        if last is None or us[-1] > last:
            if timer:
                self.handle.deleteTimer(timer)
            timer = (int(us[-1]) + self.most_us) // 1000 + 1
            self.handle.registerTimer(timer)
            self.meta.update((int(us[-1]), timer))
        if len(gaps):
            yield self._frame(key[0], [(int(us[i]), int(us[i + 1])) for i in gaps])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, timer = self.meta.get()
        if timer and timerValues.getCurrentProcessingTimeInMs() >= timer:
            self.meta.update((last, 0))
            yield self._frame(key[0], [(last, None)])

    @staticmethod
    def _frame(host: str, gaps: list[tuple[int, int | None]]) -> pd.DataFrame:
        at = lambda x: pd.NaT if x is None else pd.Timestamp(x, unit="us", tz="UTC")
        return pd.DataFrame({"host": [host] * len(gaps), "silent_from": pd.Series([at(a) for a, _ in gaps], dtype="datetime64[us, UTC]"), "silent_to": pd.Series([at(z) for _, z in gaps], dtype="datetime64[us, UTC]"), "minutes": pd.Series([None if z is None else (z - a) / 60_000_000 for a, z in gaps], dtype="float64")})

    def close(self) -> None:
        pass


def silence(records: DataFrame, minutes: float = 35, at: str = "received_at", key: str = "host") -> DataFrame:
    """(host, silent_from, silent_to, minutes) of hosts that sent nothing for longer.

    While a host is silent its row has no ``silent_to`` and comes by the clock, once, without any input; when it sends again,
    the row of ``envelopes.silence`` follows.  A record that is older than its host's last one, in a batch before, changes
    nothing; one without a host or a time is left out.  The state is two numbers a host.
    """
    agent.prepared(records.sparkSession)
    own = records.select(F.col(key).cast("string").alias("host"), F.unix_micros(F.col(at).cast("timestamp")).alias("us")).where("host is not null and us is not null")
    return own.groupBy("host").transformWithStateInPandas(Silence(int(minutes * 60_000_000)), SILENCE, "append", "ProcessingTime").withColumnRenamed("host", key)


def incident_lines(lines: DataFrame, reach_s: int = 1800, late: str = "10 minutes") -> DataFrame:
    """(incident, host, at, event_id) of the lines within ``reach_s`` of a critical line of their host, itself included.

    A stream is joined with itself by host and bucket of ``reach_s``, so that one host's lines are spread; a line is kept as long as an
    incident can reach it, by the watermark, and lines later than ``late`` are dropped.
    """
    critical = normalize.once(F.lower("raw"), lambda low: severity.any_of(severity.CRITICAL, low))
    own = lines.select("host", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("event_id"), critical.alias("critical"))
    sec = F.floor(dedup.micros(F.col("ts")) / 1_000_000)
    # no filter by ``critical``: it would go below the watermark, which then stood still while nothing critical comes
    reached = F.explode(F.when(F.col("critical"), F.sequence(F.floor((sec - reach_s) / reach_s), F.floor((sec + reach_s) / reach_s))))
    hot = own.withWatermark("ts", late).select(F.col("event_id").alias("incident"), F.col("host").alias("of"), F.col("ts").alias("at"), reached.alias("b"))
    near = own.withWatermark("ts", late).select("host", "ts", "event_id", F.floor(sec / reach_s).alias("own_b"))
    within = F.expr(f"ts >= at - interval {reach_s} seconds and ts <= at + interval {reach_s} seconds")
    return near.join(hot, (F.col("host") == F.col("of")) & (F.col("own_b") == F.col("b")) & within).select("incident", "host", "at", "event_id")


def incidents(lines: DataFrame, reach_s: int = 1800, late: str = "10 minutes") -> DataFrame:
    """(incident, host, at, near), how many lines are near, once none can come any more."""
    return incident_lines(lines, reach_s, late).groupBy("incident", "host", "at").agg(F.count("*").alias("near"))


def first_seen(records: DataFrame, keys: list[str], at: str = "received_at", within: str = "1 day") -> DataFrame:
    """U3, X5 on a stream: the first record of each key; a key is remembered for ``within`` by the watermark, then its state is gone."""
    return records.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)
