"""Delivery of spooled envelopes in rounds: one POST for each envelope that is due, and a ledger of what became of it.

The spool is a table of (name, envelope) (``readers.spool_source`` or ``spooled_lines``).  A round is a batch: it writes its
ledger rows in a folder of its own number, which a round that is run again replaces.  Nothing waits inside a task: an envelope
that has to wait gets the time from which it is due, and a later round (a streaming trigger, a scheduler) takes it up.  An envelope may
be sent again after a failure in between, so the receiver has to be idempotent.
"""

from __future__ import annotations

import gzip
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from logmill.operators import envelopes, wire

LEDGER = "name string, state string, attempts int, wait double, at timestamp, bytes long"
#: Takes gzip bytes; gives the HTTP status (None: no answer) and the seconds that a 429 asks for, if any.
Send = Callable[[bytes], tuple[int | None, int | None]]


def http(url: str, token: str, timeout: float = 30) -> Send:
    """K1: POST of gzip JSON with a bearer token."""

    def send(data: bytes) -> tuple[int | None, int | None]:
        from urllib import error, request

        asked = request.Request(url, data, {"Content-Type": "application/json", "Content-Encoding": "gzip", "Authorization": f"Bearer {token}"})
        try:
            with request.urlopen(asked, timeout=timeout) as answer:
                return answer.status, None
        except error.HTTPError as e:
            after = e.headers.get("Retry-After", "")
            return e.code, int(after) if after.isdigit() else None
        except OSError:
            return None, None

    return send


def ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(f"{LEDGER}, round long").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], f"{LEDGER}, round long")


def latest(known: DataFrame) -> DataFrame:
    """The last row of each envelope: that of most attempts."""
    columns = [c for c in known.columns if c != "name"]
    return known.groupBy("name").agg(F.max_by(F.struct(*columns), F.struct("attempts", "round")).alias("r")).select("name", "r.*")


def pending(spool: DataFrame, known: DataFrame, now: Column, again: bool = False) -> DataFrame:
    """(name, json, critical, attempts) of envelopes that are new, that have waited long enough or, with ``again``, that failed.

    What is no JSON is left to quarantine.
    """
    last = latest(known).select("name", "state", "attempts", (F.col("at") + F.make_dt_interval(secs=F.col("wait").cast("decimal(18,6)"))).alias("due"))
    rows = spool.where("envelope is not null").join(last, "name", "left")
    failed = F.col("state") == "failed"
    due = F.col("state").isNull() | ((F.col("state") == "waiting") & (F.col("due") <= now)) | (failed if again else F.lit(False))
    critical = F.coalesce(F.col("envelope.headers.counts.by_severity.critical") > 0, F.lit(False))
    attempts = F.when(failed, 0).otherwise(F.coalesce("attempts", F.lit(0)))
    return rows.where(due).select("name", wire.to_json(F.col("envelope")).alias("json"), critical.alias("critical"), attempts.cast("int").alias("attempts"))


def attempt(todo: DataFrame, send: Send, now: Column, limit: int = 5) -> DataFrame:
    """K1 to K3: a ledger row for each envelope after one more try; JSON is made gzip once for each."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = []
            for name, text, critical, before in zip(pdf["name"], pdf["json"], pdf["critical"], pdf["attempts"], strict=True):
                data = gzip.compress(text.encode())
                wait = envelopes.retry_wait(int(before), bool(critical), *send(data), limit=limit)
                out.append((name, "failed" if wait is None else "waiting" if wait else "sent", int(before) + 1, wait, len(data)))
            yield pd.DataFrame(out, columns=["name", "state", "attempts", "wait", "bytes"])

    tried = todo.mapInPandas(run, "name string, state string, attempts int, wait double, bytes long")
    return tried.select("name", "state", "attempts", "wait", now.alias("at"), "bytes")


def run_round(spark: SparkSession, spool: DataFrame, to: str, send: Send, number: int, now: Column | None = None, again: bool = False) -> dict[str, int]:
    """K4: try what is due and write what became of it; gives the numbers by state.  ``number`` has to rise from round to round."""
    now = F.current_timestamp() if now is None else now
    known = ledger(spark, to).where(F.col("round") < number)
    attempt(pending(spool, known, now, again), send, now).write.mode("overwrite").parquet(f"{to}/round={number}")
    return {r.state: r["count"] for r in ledger(spark, to).where(F.col("round") == number).groupBy("state").count().collect()}
