"""S1 to S5 on growing files: a Spark data source that follows logs line by line, through rotation and restarts.

Spark's own file stream takes a file once, whole.  This one keeps a position for each file in the query's checkpoint, so
that lines which are added later come in later batches, each of them once.  A file is known by its inode and the checksum of its
first line: one that was renamed is read on from where it was, one that was cut and begun anew is a new one.  Only lines that
are complete are read; what stands behind the last line feed waits.

A batch takes all complete lines that are there, in slices of ``chunk_bytes``, one a task; a task holds some 4 MB of lines at
once.  Files must be on storage that driver and executors share; patterns should name the rotated files as well
(``/logs/*/syslog*``), or a rotation between two batches loses the end of a file (an error, unless ``fail_on_loss`` is
``false``).  Compressed files are passed over.
"""

from __future__ import annotations

import glob
import json
import os
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from logmill.sources import readers

SCHEMA = "file string, offset long, arrival long, raw string"
HEAD = 4096
STEP = 1 << 16
#: ``arrival`` is the second of the batch since this one, then the place in the file's new part
EPOCH, PLACE_BITS = 1_704_067_200, 33


def identity(file) -> str | None:
    """Of an open file; None as long as its first line isn't complete."""
    file.seek(0)
    head = file.read(HEAD)
    end = head.find(b"\n") + 1
    if not end and len(head) < HEAD:
        return None
    return f"{os.fstat(file.fileno()).st_ino}-{zlib.crc32(head[: end or HEAD]):08x}"


def complete(file, size: int, known: int) -> int:
    """The place behind the last line feed before ``size``; ``known``: such a place, or 0."""
    at = size
    while at > known:
        start = max(known, at - STEP)
        file.seek(start)
        found = file.read(at - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        at = start
    return known


def found(patterns: list[str]) -> list[str]:
    return sorted({p for pattern in patterns for p in glob.glob(pattern) if os.path.isfile(p) and not p.endswith((".gz", ".xz", ".zst", ".bz2"))})


@dataclass
class Slice(InputPartition):
    path: str
    identity: str
    begin: int  # of the file's new part
    start: int
    stop: int
    at: int


def lines(file, begin: int, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin from ``start`` to before ``stop``; ``begin``, at most ``start``, is where a line begins."""
    if start > begin:
        file.seek(start - 1)
        file.readline()
    else:
        file.seek(start)
    at = file.tell()
    while at < stop and (line := file.readline()):
        yield at, line
        at += len(line)


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.patterns = json.loads(options["paths"])
        self.chunk = int(options.get("chunk_bytes", 64 << 20))
        self.max_age = float(options.get("max_age_s", 86_400))
        self.pin = options.get("pin")
        self.strict = options.get("fail_on_loss", "true") == "true"
        self.last: dict | None = None

    def _positions(self) -> dict[str, dict]:
        known = self.last["files"] if self.last else {}
        out = {}
        for path in found(self.patterns):
            try:
                with open(path, "rb") as file:
                    name, stat = identity(file), os.fstat(file.fileno())
                    if name is None or (name not in known and time.time() - stat.st_mtime > self.max_age):
                        continue
                    before = known.get(name, {"bytes": 0})["bytes"]
                    end = complete(file, stat.st_size, before if before <= stat.st_size else 0)
                    out[name] = {"path": path, "bytes": end}
            except FileNotFoundError:
                continue  # renamed or deleted since it was listed; under its new name it is in the next batch
        return dict(sorted(out.items()))

    def initialOffset(self) -> dict:
        nothing = {"at": 0, "files": {}}
        if not self.pin:
            return nothing
        # the end as it was when the query began first, also for a batch that is run again
        if not os.path.exists(self.pin):
            os.makedirs(os.path.dirname(self.pin) or ".", exist_ok=True)
            with open(f"{self.pin}.new", "w") as f:
                json.dump({"at": 0, "files": self._positions()}, f)
            os.replace(f"{self.pin}.new", self.pin)
        with open(self.pin) as f:
            return json.load(f)

    def latestOffset(self) -> dict:
        now = int(time.time()) - EPOCH
        if self.last and now <= self.last["at"]:
            return self.last  # one batch a second, so that ``arrival`` grows
        files = self._positions()
        if not self.last or files != self.last["files"]:
            self.last = {"at": now, "files": files}
        return self.last

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        out = []
        for name, to in end["files"].items():
            begin = start["files"].get(name, {"bytes": 0})["bytes"]
            if begin > to["bytes"]:
                begin = 0  # cut and written again with the same first line
            if to["bytes"] - begin >= 1 << PLACE_BITS:
                raise ValueError(f"{to['path']}: more than {1 << PLACE_BITS} new bytes in a batch")
            for a in range(begin, to["bytes"], self.chunk):
                out.append(Slice(to["path"], name, begin, a, min(a + self.chunk, to["bytes"]), end["at"]))
        return out

    def _open(self, part: Slice):
        for path in [part.path, *found(self.patterns)]:
            try:
                file = open(path, "rb")
            except FileNotFoundError:
                continue
            if identity(file) == part.identity:
                return file
            file.close()
        if self.strict:
            raise FileNotFoundError(f"{part.path} is gone, with bytes {part.start} to {part.stop} of it unread")
        return None

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        file = self._open(part)
        if file is None:
            return
        with file:
            at, raws, size = [], [], 0
            for place, line in lines(file, part.begin, part.start, part.stop):
                at.append(place)
                raws.append(line.rstrip(b"\n").removesuffix(b"\r").decode("utf-8", "replace"))
                size += len(line)
                if size >= 4 << 20:
                    yield self._batch(part, at, raws)
                    at, raws, size = [], [], 0
            if at:
                yield self._batch(part, at, raws)

    @staticmethod
    def _batch(part: Slice, at: list[int], raws: list[str]) -> pa.RecordBatch:
        arrival = [(part.at << PLACE_BITS) + x - part.begin for x in at]
        return pa.RecordBatch.from_arrays([pa.array([part.path] * len(at)), pa.array(at, pa.int64()), pa.array(arrival, pa.int64()), pa.array(raws)], names=["file", "offset", "arrival", "raw"])


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:
        return Reader(dict(self.options))


def tail_source(spark: SparkSession, paths: str | list[str], *, from_end: str | None = None, max_age_s: float = 86_400, chunk_bytes: int = 64 << 20, fail_on_loss: bool = True) -> DataFrame:
    """(raw, file, offset, arrival, source, initial_severity) of lines as they are added.

    ``arrival`` grows from batch to batch and within a file; it is the order that ``agent.envelopes`` asks for.  Files that
    weren't written to for ``max_age_s`` are passed over until they are.  ``from_end`` begins behind what is there: a path, shared
    and kept as long as the checkpoint, that remembers where that was.
    """
    spark.dataSource.register(LogTail)
    reader = spark.readStream.format("logtail").option("paths", json.dumps([paths] if isinstance(paths, str) else paths)).option("max_age_s", str(max_age_s)).option("chunk_bytes", str(chunk_bytes)).option("fail_on_loss", str(fail_on_loss).lower())
    if from_end:
        reader = reader.option("pin", from_end)
    got = reader.load()
    return got.select("raw", "file", "offset", "arrival", readers.source_of(F.col("file")).alias("source"), F.lit("info").alias("initial_severity"))


def tail_journal(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    """Exported journal objects as they are added to their files, one a line, with ``arrival``."""
    return readers.parse_journal(tail_source(spark, paths, **options), "raw", keep=("arrival",))
