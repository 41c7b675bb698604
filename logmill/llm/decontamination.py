"""Operator 2: benchmark decontamination by greedy string tiling.

Texts are lower-cased word sequences.  Word windows of ``MIN_MATCH`` words that a document shares with a test item
(found by a running Karp-Rabin hash) are the seeds; runs of them on one diagonal are the maximal matches.  The longest
match that no marked word overlaps is marked again and again, what is left of an overlapped one is tried later, until
none of ``MIN_MATCH`` words is left.  A document is contaminated by an item whose marked share is ``COVERAGE`` or more,
in whatever order its passages come.

Seeds are joined by their hash, in the tasks that scan the documents: the test items come there as an index of seeds.
An index has ``BLOCK_BYTES`` of text at most, as a rule all items; more of them make further blocks, one scan of the
documents each.  Seeds that many items share are left out of the index where an item can't be covered by them alone
(``telling``), so a stem that a whole benchmark has in common brings up none of its items.

Where a few words repeat so often that a list of all meeting seeds would grow with the product of both texts, the longest
free match is searched by its length instead (``tile_repeats``), in memory of the texts' size and with the same tiles.

Null and empty texts, and items without words, match nothing; an item of fewer words than ``MIN_MATCH`` has to be there
as a whole.  Repeated rows are judged alike, very long texts whole; an empty table gives no rows, and empty test items
contaminate nothing.  Other columns, whatever their names, are not read, and ``clean`` returns them unchanged.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_MATCH = 5
COVERAGE = 0.5
BLOCK_BYTES = 64_000_000
#: most meeting seeds that are listed; more of them go by ``tile_repeats``
MOST_PAIRS = 50_000
BASE = 0x9E3779B97F4A7C15

_WORD = re.compile(r"\w+")


def word_hashes(text: str | None) -> np.ndarray:
    words = _WORD.findall(text.lower()) if text else []
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


@cache
def _weights(n: int) -> np.ndarray:
    """Powers of an odd base: a Karp-Rabin hash modulo 2**64."""
    return np.array([pow(BASE, n - 1 - i, 2**64) for i in range(n)], np.uint64)


def running_hash(h: np.ndarray, n: int) -> np.ndarray:
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i, w in enumerate(_weights(n)):
        out += h[i : i + len(out)] * w
    return out


def tile(doc: np.ndarray, item: np.ndarray, seeds: list[tuple[int, int]] | np.ndarray, width: int, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (place in doc, place in item, length), longest first; ties by place in the item, then in the document."""
    runs: list[tuple[int, int, int]] = []
    pairs = sorted((p - q, q) for p, q in seeds)
    for d, q in pairs:
        if not np.array_equal(doc[d + q : d + q + width], item[q : q + width]):
            continue  # a hash alone
        if runs and runs[-1][0] == d and runs[-1][1] + runs[-1][2] >= q + width - 1:
            runs[-1] = (d, runs[-1][1], q + width - runs[-1][1])
        else:
            runs.append((d, q, width))
    heap = [(-n, q, q + d) for d, q, n in runs]
    heapq.heapify(heap)
    in_doc, in_item, tiles = defaultdict(bool), np.zeros(len(item), bool), []
    while heap and not in_item.all():
        n, q, p = heapq.heappop(heap)
        free = [not in_item[q + i] and not in_doc[p + i] for i in range(-n)]
        if all(free):
            in_item[q : q - n] = True
            for i in range(-n):
                in_doc[p + i] = True
            tiles.append((p, q, -n))
            continue
        i = 0
        while i < -n:
            if not free[i]:
                i += 1
                continue
            j = i
            while j < -n and free[j]:
                j += 1
            if j - i >= min(least, width):
                heapq.heappush(heap, (i - j, q + i, p + i))
            i = j
    return tiles


class _Windows:
    """Karp-Rabin hashes of the windows of any length, from one pass over the words."""

    def __init__(self, h: np.ndarray):
        powers = lambda base: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(h), base, np.uint64))))
        self.up = powers(BASE)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers(pow(BASE, -1, 2**64))[:-1], dtype=np.uint64)))

    def free(self, n: int, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places, in order, of the windows of ``n`` words without a taken one, and their hashes."""
        marks = np.concatenate(([0], np.cumsum(taken)))
        places = np.flatnonzero(marks[n:] == marks[: len(marks) - n]) if n < len(marks) else np.zeros(0, np.int64)
        return places, (self.sums[places + n] - self.sums[places]) * self.up[places]


def tile_repeats(doc: np.ndarray, item: np.ndarray, places: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """The tiles of ``tile``, without a list of pairs; ``places``: where in ``doc`` the item's seeds are.

    The greatest length that a free match has is found by halving, and all free matches of that length are marked in one pass
    over the item.  A pass takes time by the words that seeds cover, and there are fewer passes than lengths of tiles.
    """
    cover = np.zeros(len(doc) + 1, np.int64)
    np.add.at(cover, places, 1)
    np.add.at(cover, places + width, -1)
    inside = np.cumsum(cover)[:-1] > 0
    # the covered stretches one after the other, with a taken word behind each
    kept = np.flatnonzero(inside | np.concatenate(([False], inside[:-1])))
    words, taken, marked = doc[kept], ~inside[kept], np.zeros(len(item), bool)
    in_doc, in_item, tiles, most = _Windows(words), _Windows(item), [], min(len(item), len(words))
    while True:
        low, high = width - 1, most
        while low < high:
            n = (low + high + 1) // 2
            if np.isin(in_item.free(n, marked)[1], in_doc.free(n, taken)[1]).any():
                low = n
            else:
                high = n - 1
        if low < width:
            return tiles
        at, own = in_doc.free(low, taken)
        order = np.argsort(own, kind="stable")
        own = own[order]
        following: dict[int, int] = {}
        for q, h in zip(*(x.tolist() for x in in_item.free(low, marked)), strict=True):
            if marked[q : q + low].any():
                continue
            h = np.uint64(h)
            i = following.get(h, int(np.searchsorted(own, h)))
            while i < len(own) and own[i] == h:
                p = int(at[order[i]])
                if not taken[p : p + low].any():
                    if np.array_equal(words[p : p + low], item[q : q + low]):
                        marked[q : q + low] = taken[p : p + low] = True
                        tiles.append((int(kept[p]), q, low))
                    break
                i += 1
            following[h] = i
        most = low - 1


def _covered(places: np.ndarray, width: int, size: int) -> int:
    """How many of ``size`` words are in the windows at ``places``."""
    cover = np.zeros(size + 1, np.int64)
    np.add.at(cover, places, 1)
    np.add.at(cover, places + width, -1)
    return int(np.count_nonzero(np.cumsum(cover)[:size]))


def telling(shared: np.ndarray, width: int, size: int, coverage: float) -> np.ndarray:
    """Which windows of an item of ``size`` words have to be looked for; ``shared``: how many items have each window.

    Windows are passed over, those of the most items first, as long as all of them together cover less than a
    contaminated document has to: such a document has one of the others as well.
    """
    if not size or shared.max(initial=1) == 1:
        # windows in their order cover one word more each
        passed = 0
        while passed < len(shared) and (passed + width) / size < coverage:
            passed += 1
        return np.arange(passed, len(shared))
    inside, covered, out = np.zeros(size, bool), 0, []
    for q in np.argsort(-shared, kind="stable").tolist():
        more = width - int(inside[q : q + width].sum())
        if (covered + more) / size < coverage:
            inside[q : q + width] = True
            covered += more
        else:
            out.append(q)
    return np.array(sorted(out), np.int64)


@dataclass
class Items:
    """A block of test items: their words one after another, and by seed length an index from seed to items."""

    keys: list
    words: np.ndarray
    bounds: np.ndarray
    index: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # seeds in order, where the items of each begin, items

    @classmethod
    def of(cls, rows: list[tuple[object, np.ndarray]], least: int, coverage: float) -> Items:
        words = [w for _, w in rows]
        by_width: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if len(w):
                by_width[min(least, len(w))].append(i)
        index = {}
        for n, members in by_width.items():
            seeds = [running_hash(words[i], n) for i in members]
            own = [np.unique(s) for s in seeds]
            every, times = np.unique(np.concatenate(own), return_counts=True)
            kept, holder = [], []
            for i, s in zip(members, seeds, strict=True):
                s = np.unique(s[telling(times[np.searchsorted(every, s)], n, len(words[i]), coverage)])
                kept.append(s)
                holder.append(np.full(len(s), i, np.int32))
            kept, holder = np.concatenate(kept), np.concatenate(holder)
            order = np.argsort(kept, kind="stable")
            distinct, first = np.unique(kept[order], return_index=True)
            index[n] = distinct, np.append(first, len(kept)), holder[order]
        bounds = np.concatenate(([0], np.cumsum([len(w) for w in words], dtype=np.int64)))
        return cls([k for k, _ in rows], np.concatenate(words) if words else np.zeros(0, np.uint64), bounds, index)

    def matches(self, text: str | None, coverage: float, least: int) -> list[tuple[object, float, int]]:
        """(item, covered share, tiles) of the items that contaminate a text."""
        if not text:
            return []
        doc, out = word_hashes(text), []
        for n, (seeds, first, holders) in self.index.items():
            own = running_hash(doc, n)
            at = np.searchsorted(seeds, own)
            found = np.unique(at[seeds[np.minimum(at, len(seeds) - 1)] == own])
            if not len(found):
                continue
            found = np.unique(np.concatenate([holders[first[s] : first[s + 1]] for s in found]))
            order = np.argsort(own, kind="stable")
            ordered = own[order]
            for i in found.tolist():
                w = self.words[self.bounds[i] : self.bounds[i + 1]]
                h = running_hash(w, n)
                a, z = np.searchsorted(ordered, h, "left"), np.searchsorted(ordered, h, "right")
                there = np.flatnonzero(a < z)
                if _covered(there, n, len(w)) / len(w) < coverage:
                    continue  # the seeds together don't reach it
                if int((z - a).sum()) > MOST_PAIRS:
                    tiles = tile_repeats(doc, w, np.flatnonzero(np.isin(own, h)), n)
                else:
                    pairs = [(p, q) for q in there.tolist() for p in order[a[q] : z[q]].tolist()]
                    tiles = tile(doc, w, pairs, n, least)
                share = sum(t[2] for t in tiles) / len(w)
                if share >= coverage:
                    out.append((self.keys[i], share, len(tiles)))
        return out


def item_blocks(items: DataFrame, key: str, text: str, least: int, coverage: float):
    """Blocks of at most about ``BLOCK_BYTES`` of text, some 2 to 4 bytes a byte of it, which may be broadcast."""
    size = items.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()
    n = max(1, -(-size.b // BLOCK_BYTES))

    def run(batches):
        for part in common.pieces(batches):
            yield pa.RecordBatch.from_arrays([part["k"], pa.array([word_hashes(t).tobytes() for t in part["t"].to_pylist()], pa.binary())], names=["k", "w"])

    kind = items.schema[key].dataType.simpleString()
    hashed = items.select(F.col(key).alias("k"), F.col(text).alias("t"))
    for i in range(n):
        rows = hashed.where(F.pmod(F.xxhash64("k"), F.lit(n)) == i) if n > 1 else hashed
        found = [(r.k, np.frombuffer(bytes(r.w), np.uint64)) for r in rows.mapInArrow(run, f"k {kind}, w binary").collect()]
        yield Items.of(sorted(found, key=lambda x: (x[0] is None, x[0])), least, coverage)


def contaminated(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, least: int = MIN_MATCH) -> DataFrame:
    """(key, item, coverage, tiles): a row for each document and item that contaminates it."""
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    schema = f"k {kind}, item_id {item_kind.simpleString()}, coverage double, tiles long"
    out = None
    for block in item_blocks(items, item_key, item_text, least, coverage):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            for part in common.pieces(batches):
                found = [(i, *m) for i, t in enumerate(part["t"].to_pylist()) for m in shared.value.matches(t, coverage, least)]
                if found:
                    at, item, share, tiles = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([part["k"].take(pa.array(at)), pa.array(item), pa.array(share, pa.float64()), pa.array(tiles, pa.int64())], names=["k", "item_id", "coverage", "tiles"])

        one = rows.mapInArrow(run, schema)
        out = one if out is None else out.union(one)
    return out.withColumnRenamed("k", key)


def clean(docs: DataFrame, items: DataFrame, *, text: str = "text", item_key: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, least: int = MIN_MATCH) -> DataFrame:
    """The rows that no item contaminates, columns unchanged."""
    for block in item_blocks(items, item_key, item_text, least, coverage):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            for part in common.pieces(batches):
                yield part.filter(pa.array([not shared.value.matches(t, coverage, least) for t in part[text].to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op2_greedy_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
