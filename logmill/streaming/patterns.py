"""The continuous path: lines to sessions of patterns, with built-in sessions or exact keyed state."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.operators import dedup
from logmill.streaming import agent

KEYS = ["host", "template", "severity", "source"]


def session_patterns(stream: DataFrame, gap_s: int = 30, late: str = "10 minutes") -> DataFrame:
    """Built-in sessions: lines later than the watermark are dropped.  Their gap is a microsecond less than ``gap_s``, since one that equals it starts a new session."""
    events = dedup.patterns(stream).withWatermark("ts", late)
    gap = f"{gap_s - 1} seconds 999999 microseconds"
    return events.groupBy(F.session_window("ts", gap).alias("w"), *KEYS, "category").agg(F.count("*").alias("count"), F.min("ts").alias("ts_first"), F.max("ts").alias("ts_last")).drop("w")


def stateful_patterns(stream: DataFrame, *, order: str, gap_s: int = 30, samples: int = 3, idle_s: float | None = None, most: int = 50_000) -> DataFrame:
    """R1, R2, W3, L-7: exact sessions (``agent.sessions``); no watermark, so no line is ever too late.

    Lines come in order of ``order``, a number that the source gives on arrival.  A batch's lines of one host must fit into
    memory: bound the batch at the source (R3).
    """
    found = agent.sessions(stream, order=order, gap_s=gap_s, samples=samples, idle_s=idle_s, most=most)
    return agent.described(found.where("command is null")).drop("first_raw", "command", "at_us", "no")


def open_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The sessions that ``stateful_patterns`` or ``agent.envelopes`` holds under a checkpoint, as rows like its own.

    After a graceful stop these are the rest; the next run begins with a new checkpoint, or emits them again when they end.
    """
    return agent.described(agent.still_open(spark, checkpoint)).drop("first_raw")


def settle(query, seconds: float = 600, quiet: int = 3) -> None:
    """Wait until ``quiet`` reports one after the other found nothing new.

    ``processAllAvailable`` doesn't end where state has timers by the clock, and one empty batch may have begun before the source
    listed what is there.
    """
    until, empty = time.monotonic() + seconds, set()
    while query.isActive and time.monotonic() < until:
        last = query.lastProgress
        if last:
            if last["numInputRows"] or query.status["isDataAvailable"]:
                empty.clear()
            else:
                empty.add(last["timestamp"])
                if len(empty) >= quiet:
                    return
        time.sleep(0.1)


def stop(query, spark: SparkSession, checkpoint: str) -> DataFrame:
    """Work off what has come, stop, and give the sessions that are still open."""
    settle(query)
    query.stop()
    return open_sessions(spark, checkpoint)


def bounded_groups(host: str, us: list[int], keys: list[tuple], raws: list[str], most: int, gap_us: int, samples: int = 3) -> Iterator[tuple]:
    """L-7: sessions of one host with at most ``most`` of them open; beyond that the one that was longest without a line is emitted early.

    Yields (host, key, session, early); nothing is lost, and what is open at the end comes last.
    """
    held: OrderedDict[tuple, tuple] = OrderedDict()
    for key, session, early in agent.bounded(held, us, keys, raws, most, gap_us, samples):
        yield host, key, session, early
    for key, session in held.items():
        yield host, key, session, False


def bounded_patterns(lines: DataFrame, most: int = 50_000, gap_s: int = 30, samples: int = 3, order: str = "event_id") -> DataFrame:
    """L-7 over a batch: one task for each host, whose lines come in order; ``early`` marks sessions that the limit ended."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o", kind="stable")
        found = list(bounded_groups(pdf["host"].iloc[0], pdf["us"].tolist(), list(zip(pdf["template"], pdf["severity"], pdf["source"], strict=True)), pdf["raw"].tolist(), most, gap_s * 1_000_000, samples))
        return pd.DataFrame([(host, *key, n, pd.Timestamp(a, unit="us", tz="UTC"), pd.Timestamp(z, unit="us", tz="UTC"), raw, list(raws), early) for host, key, (n, a, z, raw, raws), early in found], columns=[*KEYS, "count", "ts_first", "ts_last", "first_raw", "sample_raws", "early"])

    events = dedup.templates(lines).select(*KEYS, "raw", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col(order).alias("o"))
    return agent.described(events.groupBy("host").applyInPandas(run, f"{agent.OUT}, early boolean")).drop("first_raw")
