"""Operator 7: vector bin packing of instruction data into training sequences.

Every sequence has three limits at once: tokens, segments and loss-bearing tokens.  A segment goes to the open
sequence, among those where it fits, whose remaining room has the largest dot product with the segment's demand,
each in shares of the limits.  Where it fits nowhere and no more sequences may be open, it is cut to fill the
fullest one.  At the end of a task the open sequences are cut anew into full ones and, for the rest, into powers
of two, which need no padding.

A task packs the rows that it scans: no shuffle, memory for ``OPEN`` sequences and one document.  A retried task
reads the same rows in the same order, and sequence ids start at the task's number times 2**40.
Null text counts as empty (its end id alone), a null prompt as none.  Repeated rows are packed as often as they occur,
very long texts fill sequences of their own.  An empty table gives no sequences.  Other columns, whatever their names,
are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

LENGTH = 1024
SEGMENTS = 512
OPEN = 24
END = 0
END_IDS = np.array([END], np.uint32)


@dataclass
class Segment:
    key: object
    start: int
    ids: np.ndarray
    loss: np.ndarray | None = None  # which ids bear loss; None: all
    whole: int = 0  # tokens of its document

    def demand(self) -> tuple[int, int, int]:
        return len(self.ids), 1, len(self.ids) if self.loss is None else int(self.loss.sum())

    def cut(self, at: int) -> tuple[Segment, Segment]:
        loss = (None, None) if self.loss is None else (self.loss[:at], self.loss[at:])
        return Segment(self.key, self.start, self.ids[:at], loss[0], self.whole), Segment(self.key, self.start + at, self.ids[at:], loss[1], self.whole)

    def head(self, room: tuple[int, int, int]) -> int:
        """The most ids from the start that fit into ``room``."""
        most = min(len(self.ids), room[0]) if room[1] > 0 else 0
        if self.loss is None:
            return min(most, room[2])
        return most if int(self.loss[:most].sum()) <= room[2] else int(np.searchsorted(np.cumsum(self.loss[:most]), room[2], side="right"))


@dataclass
class Bin:
    limits: tuple[int, int, int]
    used: list[int] = field(default_factory=lambda: [0, 0, 0])
    segments: list[Segment] = field(default_factory=list)

    def room(self) -> tuple[int, int, int]:
        return tuple(c - u for c, u in zip(self.limits, self.used, strict=True))

    def add(self, s: Segment) -> None:
        for i, d in enumerate(s.demand()):
            self.used[i] += d
        self.segments.append(s)


class Packer:
    """``add`` and ``finish`` yield closed sequences as lists of segments."""

    def __init__(self, limits: tuple[int, int, int] = (LENGTH, SEGMENTS, LENGTH), open_bins: int = OPEN, cut: bool = True):
        if min(limits) < 1:
            raise ValueError("each limit must be 1 at least")
        self.limits, self.most, self.cut, self.bins = limits, open_bins, cut, []
        # room in the open sequences, in their order
        self._room = np.zeros((open_bins, 3), np.int64)
        self._scale = 1 / np.array(limits, float) ** 2

    def _best(self, demand: tuple[int, int, int]) -> int | None:
        """The open sequence with the largest dot product of its room and the demand, the first of equal ones."""
        if not self.bins:
            return None
        room, wanted = self._room[: len(self.bins)], np.array(demand)
        dots = np.where((room >= wanted).all(axis=1), room @ (wanted * self._scale), -1.0)
        best = int(np.argmax(dots))
        return best if dots[best] >= 0 else None

    def _close(self, i: int) -> list[Segment]:
        n = len(self.bins)
        self._room[i : n - 1] = self._room[i + 1 : n]
        return self.bins.pop(i).segments

    def add(self, s: Segment):
        if not len(s.ids):
            return
        empty = Bin(self.limits)
        while (n := s.head(empty.room())) < len(s.ids):  # longer than a sequence
            if not self.cut:
                raise ValueError(f"{s.key!r} exceeds the limits of a sequence")
            if not n:
                raise ValueError("a single id exceeds the limits")
            first, s = s.cut(n)
            if n == self.limits[0]:
                yield [first]
            else:
                yield from self._place(first)
        yield from self._place(s)

    def _place(self, s: Segment):
        while True:
            demand = s.demand()
            if (i := self._best(demand)) is None and len(self.bins) < self.most:
                i = len(self.bins)
                self.bins.append(Bin(self.limits))
                self._room[i] = self.limits
            if i is not None:
                self.bins[i].add(s)
                self._room[i] -= demand
                if self._room[i].min() == 0:
                    yield self._close(i)
                return
            i = int(np.argmin(self._room[: len(self.bins), 0]))
            if self.cut and (n := s.head(self.bins[i].room())):
                first, s = s.cut(n)
                self.bins[i].add(first)
            yield self._close(i)

    def finish(self):
        rest = [s for b in self.bins for s in b.segments]
        if not self.cut:
            yield from (b.segments for b in self.bins)
            self.bins = []
            return
        self.bins, total = [], sum(len(s.ids) for s in rest)
        b, goal = Bin(self.limits), self._goal(total)
        while rest:
            s = rest.pop(0)
            room = b.room()
            n = s.head((min(room[0], goal - b.used[0]), *room[1:]))
            if n < len(s.ids):
                first, last = s.cut(n)
                rest.insert(0, last)
                s = first
            if n:
                b.add(s)
            if b.used[0] == goal or n == 0 or b.room()[1] == 0:
                total -= b.used[0]
                yield b.segments
                b, goal = Bin(self.limits), self._goal(total)
        if b.segments:
            yield b.segments

    def _goal(self, total: int) -> int:
        return self.limits[0] if total >= self.limits[0] else 1 << max(0, total.bit_length() - 1)


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, *, key: str = "doc_id", text: str = "text", prompt: str | None = None, limits: tuple[int, int, int] = (LENGTH, SEGMENTS, LENGTH), cut: bool = True, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document; ``with_ids`` adds the ids themselves.

    ``prompt``: a column of text that stands before the row's text and bears no loss.  Without ``cut`` a document is
    never divided, and one that exceeds a limit is an error.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        encoder, packer = tokens.byte_bpe(), Packer(limits, cut=cut)
        number, out = TaskContext.get().partitionId() << 40, []

        def flush():
            cols = list(zip(*out, strict=True))
            names = ["k", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            arrays = [pa.array(cols[0])] + [pa.array(c, pa.int64()) for c in cols[1:7]]
            if with_ids:
                names, arrays = [*names, "ids"], [*arrays, pa.array(cols[7], pa.list_(pa.int64()))]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        def put(sequence):
            nonlocal number
            at = 0
            for s in sequence:
                out.append((s.key, s.start, len(s.ids), crc32(s.ids.astype("<u4", copy=False)), s.whole, number, at, *([s.ids.tolist()] if with_ids else [])))
                at += len(s.ids)
            number += 1

        for part in tokens.slices(batches, "t"):
            ids, bounds = encoder.encode(part["t"])
            before, ahead = encoder.encode(part["p"]) if prompt else (ids[:0], np.zeros(part.num_rows + 1, np.int64))
            for i, k in enumerate(part["k"].to_pylist()):
                lead = before[ahead[i] : ahead[i + 1]]
                own = np.concatenate((lead, ids[bounds[i] : bounds[i + 1]], END_IDS), dtype=np.uint32)
                loss = np.arange(len(own)) >= len(lead) if prompt else None
                for sequence in packer.add(Segment(k, 0, own, loss, len(own))):
                    put(sequence)
                if len(out) > 4096:
                    yield flush()
        for sequence in packer.finish():
            put(sequence)
        if out:
            yield flush()

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), *([F.col(prompt).alias("p")] if prompt else []))
    found = rows.mapInArrow(run, f"k {kind}, {PIECES}" + ", ids array<long>" * with_ids)
    return found.withColumnRenamed("k", key)


def op7_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
