"""Lines to envelopes in one streaming query: two stateful operators, one after the other, both keyed by host.

The first holds a host's open patterns in a map: a line joins its pattern's session or begins one; a limit on open
patterns emits the one that was longest without a line; timers end sessions by the clock and close cycles.  The
second gathers what ended into the host's cycle, and when the first says that a cycle is over, gives it the next number and
emits it.  Both states are committed with the batch, so a number is neither skipped nor given twice.

Lines come in order of an arrival column (an offset, a sequence number of the source), never of their time: a line that
comes late joins what is open then.  No line is too late.  A row with ``command`` = ``flush`` ends all sessions of its
host and closes its cycle at that place in the order.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from logmill.functions import normalize, scalars
from logmill.operators import dedup, wire

KEYS = ["host", "template", "severity", "source"]
PATTERN = "template string, severity string, source string"
SESSION = "count long, first_us long, last_us long, first_raw string, samples array<string>"
OUT = "host string, template string, severity string, source string, count long, ts_first timestamp, ts_last timestamp, first_raw string, sample_raws array<string>"
#: ``no`` numbers what a host's first operator emits; a row with a command has no session.
EMITTED = f"{OUT}, early boolean, command string, at_us long, no long"
CYCLE = "host string, seq long, started_us long, ended_us long, critical long, error long, warn long, info long, by_category map<string,bigint>, data array<string>"
COLUMNS = ["host", "seq", "started_us", "ended_us", *wire.SEVERITIES, "by_category", "data"]

Session = tuple[int, int, int, str, list[str]]


def _starts(now: Session | None, us: np.ndarray, gap_us: int) -> np.ndarray:
    """Places of the lines that end the session before them."""
    if now is None:
        return np.flatnonzero(us[1:] - np.maximum.accumulate(us)[:-1] >= gap_us) + 1
    return np.flatnonzero(us - np.maximum.accumulate(np.concatenate(([now[2]], us)))[:-1] >= gap_us)


def fold(now: Session | None, us: np.ndarray, raws: list[str], gap_us: int, samples: int) -> tuple[list[Session], Session]:
    """(sessions that ended, the one that is open) after lines in order of arrival; a session is (count, first, last, first line, samples).

    A line joins the open session unless it is ``gap_us`` or more after its last time, however late it comes, and the last
    time never moves back.
    """
    starts = _starts(now, us, gap_us)
    done, a = [], 0
    for z in [*starts.tolist(), len(us)]:
        if z > a:
            part = us[a:z]
            if now is None:
                now = (z - a, int(part[0]), int(part.max()), raws[a], raws[a : min(z, a + samples)])
            else:
                kept = list(now[4])
                now = (now[0] + z - a, now[1], max(now[2], int(part.max())), now[3], kept + raws[a : min(z, a + samples - len(kept))])
        if z < len(us):
            done.append(now)
            now = None
        a = z
    return done, now


def bounded(held: OrderedDict, us: list[int], keys: list, raws: list[str], most: int, gap_us: int, samples: int) -> Iterator[tuple]:
    """(key, session, early) of sessions that end while lines come; ``held``: what is open, in order of the last line of each."""
    for at, key, raw in zip(us, keys, raws, strict=True):
        now = held.pop(key, None)
        if now is None and len(held) >= most:
            oldest = next(iter(held))
            yield oldest, held.pop(oldest), True
        done, held[key] = fold(now, np.array([at], np.int64), [raw], gap_us, samples)
        for session in done:
            yield key, session, False


def _frame(host: str, found: list[tuple], number: int, at_us: int) -> pd.DataFrame:
    """Rows of (key, session, early, command) in order; the session of a command is None."""
    at = lambda x: pd.Timestamp(x, unit="us", tz="UTC")
    rows = []
    for i, (key, s, early, command) in enumerate(found):
        own = [*key, s[0], at(s[1]), at(s[2]), s[3], list(s[4])] if s else [None, None, None, 0, None, None, None, []]
        rows.append([host, *own, early, command, at_us, number + i])
    return pd.DataFrame(rows, columns=[x.split()[0] for x in EMITTED.split(", ")])


class Patterns(StatefulProcessor):
    """L-7, W1, W3: a host's open patterns."""

    def __init__(self, gap_us: int, samples: int, idle_ms: int, most: int, cycle_ms: int | None):
        self.gap_us, self.samples, self.idle_ms, self.most, self.cycle_ms = gap_us, samples, idle_ms, most, cycle_ms

    def init(self, handle) -> None:
        self.handle = handle
        # ``touch``: the number of the last line; ``clock``: when it came, in milliseconds
        self.open = handle.getMapState("open", PATTERN, f"{SESSION}, touch long, clock long")
        self.meta = handle.getValueState("meta", "n long, touches long, emitted long, idle_at long, cycle_at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        n, touches, emitted, idle_at, cycle_at = self.meta.get() if self.meta.exists() else (0, 0, 0, 0, 0)
        lines = pd.concat(list(rows)).sort_values("o", kind="stable")
        flushes = np.flatnonzero(lines["command"].eq("flush").to_numpy())
        found, a = [], 0
        for z in [*flushes.tolist(), len(lines)]:
            if z > a:
                ended, n = self._lines(lines.iloc[a:z], n, touches, now)
                found += ended
                touches += z - a
            if z < len(lines):
                found += [*self._all(), (None, None, False, "flush")]
                n = 0
            a = z + 1
        if n and not idle_at:
            idle_at = now + self.idle_ms
            self.handle.registerTimer(idle_at)
        if self.cycle_ms and not cycle_at:
            cycle_at = now + self.cycle_ms
            self.handle.registerTimer(cycle_at)
        self.meta.update((n, touches, emitted + len(found), idle_at, cycle_at))
        if found:
            yield _frame(key[0], found, emitted, 1000 * now)

    def _lines(self, lines: pd.DataFrame, n: int, touches: int, now: int) -> tuple[list[tuple], int]:
        """Sessions that ended with these lines, and how many patterns are open then."""
        keys = list(zip(lines["template"], lines["severity"], lines["source"], strict=True))
        us, raws = lines["us"].to_numpy(np.int64), lines["raw"].tolist()
        known = {k: self.open.getValue(k) for k in dict.fromkeys(keys)}
        last = {k: i for i, k in enumerate(keys)}
        fresh = sum(v is None for v in known.values())
        if n + fresh <= self.most:  # nothing has to make room: each pattern on its own
            found = []
            places: dict[tuple, list[int]] = {}
            for i, k in enumerate(keys):
                places.setdefault(k, []).append(i)
            for k, at in places.items():
                before = known[k] and tuple(known[k][:5])
                done, session = fold(before, us[at], [raws[i] for i in at], self.gap_us, self.samples)
                found += [(at[i], k, s) for i, s in zip(_starts(before, us[at], self.gap_us).tolist(), done, strict=True)]
                self.open.updateValue(k, (*session, touches + last[k], now))
            # in order of the lines that ended them
            return [(k, s, False, None) for _, k, s in sorted(found, key=lambda x: x[0])], n + fresh
        stored = {tuple(k): tuple(v) for k, v in self.open.iterator()}
        held = OrderedDict((k, v[:5]) for k, v in sorted(stored.items(), key=lambda x: x[1][5]))
        found = [(k, s, early, None) for k, s, early in bounded(held, us.tolist(), keys, raws, self.most, self.gap_us, self.samples)]
        for k in stored.keys() - held.keys():
            self.open.removeKey(k)
        for k in last:
            if k in held:
                self.open.updateValue(k, (*held[k], touches + last[k], now))
        return found, len(held)

    def _all(self) -> list[tuple]:
        """All open sessions, which are closed then."""
        stored = sorted(((tuple(k), tuple(v)) for k, v in self.open.iterator()), key=lambda x: x[1][5])
        self.open.clear()
        return [(k, v[:5], False, None) for k, v in stored]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        n, touches, emitted, idle_at, cycle_at = self.meta.get()
        found = []
        if cycle_at and now >= cycle_at:  # what is open belongs to the cycle that ends
            found = [*self._all(), (None, None, False, "cycle")]
            n, cycle_at = 0, now + self.cycle_ms
            self.handle.registerTimer(cycle_at)
        if idle_at and now >= idle_at:
            stored = sorted(((tuple(k), tuple(v)) for k, v in self.open.iterator()), key=lambda x: x[1][5])
            for k, v in stored:
                if now - v[6] >= self.idle_ms:
                    self.open.removeKey(k)
                    found.append((k, v[:5], False, None))
                    n -= 1
            idle_at = min((v[6] for _, v in stored if now - v[6] < self.idle_ms), default=0)
            if idle_at:
                idle_at += self.idle_ms
                self.handle.registerTimer(idle_at)
        self.meta.update((n, touches, emitted + len(found), idle_at, cycle_at))
        if found:
            yield _frame(key[0], found, emitted, 1000 * now)

    def close(self) -> None:
        pass


class Cycles(StatefulProcessor):
    """W2, K13, L-6, R5: a host's cycle, its events and the next number."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle) -> None:
        self.events = handle.getListState("events", "severity string, json string")
        self.categories = handle.getMapState("categories", "category string", "n long")
        self.meta = handle.getValueState("meta", "seq long, started_us long, n long, critical long, error long, warn long, info long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("no", kind="stable")
        seq, started, n, *counts = self.meta.get() if self.meta.exists() else (0, int(events["at_us"].iloc[0]), 0, 0, 0, 0, 0)
        out, held, new, categories = [], None, [], {}
        for severity, category, count, json, command, at in zip(events["severity"], events["category"], events["count"], events["json"], events["command"], events["at_us"], strict=True):
            if command is None or command != command:
                if n + len(new) >= self.most and held is None:  # the cap: all events that are there, oldest first
                    held = [tuple(x) for x in self.events.get()] + new
                if held is not None and len(held) >= self.most:
                    out_of = 0 if severity == "critical" else next((i for i, x in enumerate(held) if x[0] != "critical"), None)
                    if out_of is None:
                        continue
                    held.pop(out_of)
                (new if held is None else held).append((severity, json))
                counts[wire.SEVERITIES.index(severity) if severity in wire.SEVERITIES else 3] += int(count)
                categories[category] = categories.get(category, 0) + int(count)
                continue
            every = held if held is not None else [tuple(x) for x in self.events.get()] + new
            known = {k[0]: v[0] for k, v in self.categories.iterator()}
            sums = {c: known.get(c, 0) + categories.get(c, 0) for c in sorted(known.keys() | categories.keys())}
            out.append((key[0], seq, started, int(at), *counts, sums, [x[1] for x in every]))
            seq, started, n, counts = seq + 1, int(at), 0, [0, 0, 0, 0]
            held, new, categories = None, [], {}
            self.events.clear()
            self.categories.clear()
        if held is not None:
            self.events.put(held)
            n = len(held)
        elif new:
            self.events.appendList(new)
            n += len(new)
        for c, k in categories.items():
            before = self.categories.getValue((c,))
            self.categories.updateValue((c,), (k + (before[0] if before else 0),))
        self.meta.update((seq, started, n, *counts))
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def prepared(spark: SparkSession) -> None:
    """State of several variables and timers needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def sessions(stream: DataFrame, *, order: str, gap_s: int = 30, samples: int = 3, idle_s: float | None = None, most: int = 50_000, cycle_s: float | None = None) -> DataFrame:
    """Sessions as they end, in order of ``no`` for each host, and a row with a command where a cycle ends.

    A session ends with its pattern's first line beyond the gap, when its pattern had no line for ``idle_s`` seconds by the
    clock (``gap_s`` where not given), early (``early``) when more than ``most`` patterns of the host are open, and with the
    cycle (``cycle_s`` by the clock) or a flush.
    """
    prepared(stream.sparkSession)
    command = F.col("command") if "command" in stream.columns else F.lit(None).cast("string")
    kept = stream.withColumn("_command", command).drop("command")
    lines = dedup.templates(kept.withColumn("raw", F.when(F.col("_command").isNotNull(), "-").otherwise(F.col("raw"))))
    own = lines.select(*KEYS, "raw", F.unix_micros("ts").alias("us"), F.col(order).cast("long").alias("o"), F.col("_command").alias("command"))
    what = Patterns(gap_s * 1_000_000, samples, max(1, int(1000 * (gap_s if idle_s is None else idle_s))), most, None if cycle_s is None else int(1000 * cycle_s))
    return own.groupBy("host").transformWithStateInPandas(what, EMITTED, "append", "ProcessingTime")


def described(found: DataFrame) -> DataFrame:
    """What a session's first line and keys tell: category, fields, fingerprint."""
    out = found.withColumn("category", dedup.category_of(F.col("first_raw")))
    return dedup.with_fields(out).withColumn("fingerprint", normalize.fingerprint(F.col("template"), F.col("severity"), F.col("source")))


def envelopes(stream: DataFrame, *, order: str, host_id, boot_id, cycle_s: float = 1800, most_events: int = wire.MOST_EVENTS, **more) -> DataFrame:
    """(host, seq, envelope) of each cycle of each host as it ends: by the clock, or by a flush; an empty cycle has no section.

    ``host_id`` and ``boot_id`` are columns over ``host``.
    """
    found = described(sessions(stream, order=order, cycle_s=cycle_s, **more))
    events = found.select("host", "severity", "category", "count", F.when(F.col("command").isNull(), F.to_json(wire.event(found))).alias("json"), "command", "at_us", "no")
    cycles = events.groupBy("host").transformWithStateInPandas(Cycles(most_events), CYCLE, "append", "ProcessingTime")
    start, end = F.timestamp_micros("started_us"), F.timestamp_micros("ended_us")
    return cycles.select("host", "seq", wire.envelope(start=start, end=end, host_id=host_id, boot_id=boot_id).alias("envelope"))


def still_open(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The sessions that the first operator of a stopped query holds under a checkpoint, as rows like its own."""
    prepared(spark)
    kept = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "open").load(checkpoint)
    k, v = F.col("user_map_key"), F.col("user_map_value")
    at = lambda c: F.timestamp_micros(c)
    return kept.select(F.col("key.host").alias("host"), *(k[c].alias(c) for c in KEYS[1:]), v["count"].alias("count"), at(v["first_us"]).alias("ts_first"), at(v["last_us"]).alias("ts_last"), v["first_raw"].alias("first_raw"), v["samples"].alias("sample_raws"))


def write_envelopes(found: DataFrame, path: str, checkpoint: str):
    """Envelopes as gzip JSON lines, a folder for each batch; a batch that comes again replaces its folder.

    ``readers.spooled_lines`` reads them.
    """

    def put(batch: DataFrame, number: int) -> None:
        name = F.concat(scalars.ulid(F.unix_millis(F.to_timestamp("envelope.cycle.ts")), F.concat_ws("/", "host", F.col("seq").cast("string"))), F.lit(".json"))
        batch.select(name.alias("name"), wire.to_json(F.col("envelope")).alias("json")).write.mode("overwrite").option("compression", "gzip").json(f"{path}/batch={number}")

    return found.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
