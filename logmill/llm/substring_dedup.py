"""Operator 9: substring dedup of word windows with a count-min prefilter.

Words are what ASCII white space separates.  A window is ``WINDOW`` consecutive words of one document; a word goes
if it is in a window whose words also start in a document with a smaller id.

1. Rows are put in blocks of some megabytes (whole rows, compressed) in the shared folder.
2. First pass: each block makes a sketch of its distinct windows for each range of the count-min table: the
   counters that it raises, as Elias-Fano code.  For each range and row of the table the sketches are merged, and
   each block gets back which of its windows have an estimate of two documents or more.  A counter only ever adds
   up, so a repeated window is never missed.
3. Second pass: windows whose estimates in all rows are two or more, and no others, are grouped by 96 bits of hash of
   their words (two different ones among 10**12 windows agree with a probability of 6e-6) and least id in the block; each block gets back which of them also start in a block with a smaller id.
4. Third pass: each block removes the words.

The table has ``LOAD`` counters for each window, so the share of unrepeated windows that reach the second pass
doesn't grow with the input.

Null text has no words; nothing is removed from it.  Empty texts and texts of fewer words than a window are kept
whole.  Of rows with equal ids none is smaller, so they remove nothing of each other.  Rows with a null id come
after all others: they lose what others have, and others lose nothing to them.  Ids have to be integers.  Repeated rows
and very long texts are taken whole, and an empty table gives no rows.  ``removals`` reads no other columns, whatever
their names; ``deduplicate`` returns them unchanged, but for the number of characters.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, elias_fano

WINDOW = 13
BLOCK_BYTES = 3_000_000
LOAD = 8
DEPTH = 2
RANGE_WINDOWS = 6_000_000
NULL_ID = 2**63 - 1

BLOCKS = "block long, windows long, payload binary"
REPLY = "block long, row int, range long, bits binary"


# --- blocks ---------------------------------------------------------------------------------------------------


def _packed(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema) as w:
        for b in batches:
            w.write_batch(b)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue())


def _unpacked(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(payload)).read_all()


def blocks_of(docs: DataFrame, text: str, window: int, block_bytes: int) -> DataFrame:
    def run(batches):
        number, kept, size, windows = TaskContext.get().partitionId() << 32, [], 0, 0

        def out():
            return common.batch_of(block=pa.array([number], pa.int64()), windows=pa.array([windows], pa.int64()), payload=pa.array([_packed(kept)], pa.binary()))

        for part in common.pieces(batches, 64):
            texts = part[text].to_pylist()
            kept.append(part)
            size += sum(len(t) for t in texts if t)
            windows += sum(max(0, len(t.encode().split()) - window + 1) for t in texts if t)
            if size >= block_bytes:
                yield out()
                number, kept, size, windows = number + 1, [], 0, 0
        if kept:
            yield out()

    return docs.mapInArrow(run, BLOCKS)


# --- windows of a block ----------------------------------------------------------------------------------------


@cache
def _weights(window: int) -> np.ndarray:
    """Odd multipliers, one set for each of two hashes."""
    return np.array([[xxhash.xxh64_intdigest(f"{window}/{i}", s) | 1 for i in range(window)] for s in (1, 2)], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Windows:
    """Windows of the texts of a block: ``hash`` and ``check`` of each, its document ``doc`` and its first word ``at``."""

    def __init__(self, texts: list[str | None], window: int):
        self.words = [t.encode().split() if t else [] for t in texts]
        sizes = np.array([len(w) for w in self.words], np.int64)
        total = int(sizes.sum())
        h = np.empty(total, np.uint64)
        at = 0
        for w in self.words:
            h[at : at + len(w)] = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
            at += len(w)
        n = max(0, total - window + 1)
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        whole = np.flatnonzero(doc[:n] == doc[window - 1 : window - 1 + n]) if n else np.empty(0, np.int64)
        sums = []
        for weights in _weights(window):
            s = np.zeros(n, np.uint64)
            for i in range(window):
                s += h[i : i + n] * weights[i]
            sums.append(_mix(s[whole]))
            h = _mix(h)
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        self.hash, self.check, self.doc, self.at = sums[0], (sums[1] >> np.uint64(32)).astype(np.uint32), doc[whole], whole

    def distinct(self, ids: np.ndarray):
        """In order of the hash, one of each window: hash, check, least id and whether two ids or more have it; and, for each window, its place there."""
        order = np.lexsort((self.check, self.hash)) if len(self.hash) else np.empty(0, np.int64)
        h, c, i = self.hash[order], self.check[order], ids[self.doc[order]]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        first = np.flatnonzero(new)
        least = np.minimum.reduceat(i, first) if len(first) else i
        most = np.maximum.reduceat(i, first) if len(first) else i
        place = np.empty(len(h), np.int64)
        place[order] = np.cumsum(new) - 1
        return h[first], c[first], least, most > least, place


def _ids(table: pa.Table, key: str) -> np.ndarray:
    return np.array([NULL_ID if k is None else k for k in table[key].to_pylist()], np.int64)


# --- first pass: count-min sketches ----------------------------------------------------------------------------


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    for _ in range(row):
        h = _mix(h + np.uint64(0xD1342543DE82EF95))
    return h >> np.uint64(64 - bits)


def _sketches(blocks: DataFrame, read, bits: int, ranges: int, depth: int) -> DataFrame:
    """For each block, row of the table and range of counters: the counters raised once at least, and which are raised twice."""
    width = -(-(2**bits) // ranges)

    def run(batches):
        for b in common.pieces(batches, 1):
            block = b["block"][0].as_py()
            table, ids, windows = read(b["payload"][0].as_py())
            h, _, _, many, _ = windows.distinct(ids)
            rows = []
            for row in range(depth):
                cells = _cells(h, row, bits)
                order = np.argsort(cells, kind="stable")
                cells, twice = cells[order], many[order]
                # two windows with one counter, or a window that two documents of the block have
                new = np.ones(len(cells), bool)
                new[1:] = cells[1:] != cells[:-1]
                first = np.flatnonzero(new)
                n = np.add.reduceat(1 + twice.astype(np.int64), first) if len(first) else np.empty(0, np.int64)
                cells = cells[first]
                cuts = np.searchsorted(cells, np.arange(ranges + 1, dtype=np.uint64) * np.uint64(width))
                for r in range(ranges):
                    a, z = cuts[r], cuts[r + 1]
                    if a < z:
                        rows.append((block, row, r, elias_fano.encode(cells[a:z] - np.uint64(r * width), width), np.packbits(n[a:z] > 1).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=pa.schema([("block", pa.int64()), ("row", pa.int32()), ("range", pa.int64()), ("cells", pa.binary()), ("twice", pa.binary())]))

    return blocks.mapInArrow(run, "block long, row int, range long, cells binary, twice binary")


def _merge(table: pa.Table) -> pa.Table:
    """Merged counters of one range: for each block, whether each counter that it raised is two or more."""
    cells = [elias_fano.EliasFano(x).values() for x in table["cells"].to_pylist()]
    twice = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(c)).astype(bool) for x, c in zip(table["twice"].to_pylist(), cells, strict=True)]
    every = np.concatenate(cells)
    order = np.argsort(every, kind="stable")
    sorted_cells, many = every[order], np.concatenate(twice)[order]
    same = sorted_cells[1:] == sorted_cells[:-1]
    many[1:] |= same
    many[:-1] |= same
    # a counter raised twice by one block and once by another: ``same`` has marked both
    flags = np.empty(len(every), bool)
    flags[order] = many
    bits, at = [], 0
    for c in cells:
        bits.append(np.packbits(flags[at : at + len(c)]).tobytes())
        at += len(c)
    return pa.table({"block": table["block"], "row": table["row"], "range": table["range"], "bits": pa.array(bits, pa.binary())})


def _replies(frame: DataFrame, fields: list[str], name: str) -> DataFrame:
    """All that a block gets back, in one row."""
    return frame.groupBy("block").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


# --- second pass: exact groups ---------------------------------------------------------------------------------


def _candidates(joined: DataFrame, read, bits: int, ranges: int, depth: int) -> DataFrame:
    width = -(-(2**bits) // ranges)

    def run(batches):
        for b in common.pieces(batches, 1):
            block = b["block"][0].as_py()
            table, ids, windows = read(b["payload"][0].as_py())
            h, check, least, many, _ = windows.distinct(ids)
            got = {(x["row"], x["range"]): x["bits"] for x in (b["replies"][0].as_py() or [])}
            estimated = np.ones(len(h), bool)
            for row in range(depth):
                cells = _cells(h, row, bits)
                order = np.argsort(cells, kind="stable")
                sorted_cells = cells[order]
                new = np.ones(len(h), bool)
                new[1:] = sorted_cells[1:] != sorted_cells[:-1]
                place, cells = np.cumsum(new) - 1, sorted_cells[new]
                cuts = np.searchsorted(cells, np.arange(ranges + 1, dtype=np.uint64) * np.uint64(width))
                flags = np.zeros(len(cells), np.uint8)
                for r in range(ranges):
                    if cuts[r] < cuts[r + 1]:
                        flags[cuts[r] : cuts[r + 1]] = np.unpackbits(np.frombuffer(got[row, r], np.uint8), count=cuts[r + 1] - cuts[r])
                mine = np.empty(len(h), bool)
                mine[order] = flags[place] > 0
                estimated &= mine
            rank = np.flatnonzero(estimated)
            if not len(rank):
                continue
            part = (h[rank] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
            cuts = np.searchsorted(part, np.arange(ranges + 1, dtype=np.uint64))
            rows = []
            for r in range(ranges):
                s = rank[cuts[r] : cuts[r + 1]]
                if len(s):
                    rows.append((block, r, h[s].tobytes(), check[s].tobytes(), zstandard.ZstdCompressor(level=1).compress(least[s].tobytes()), zstandard.ZstdCompressor(level=1).compress(s.astype(np.uint32).tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=pa.schema([("block", pa.int64()), ("range", pa.int64()), ("h", pa.binary()), ("c", pa.binary()), ("least", pa.binary()), ("rank", pa.binary())]))

    return joined.mapInArrow(run, "block long, range long, h binary, c binary, least binary, rank binary")


def _group(table: pa.Table) -> pa.Table:
    """Exact groups of one range: for each block the places of its windows that start in a block with a smaller id."""
    unzip = zstandard.ZstdDecompressor().decompress
    hs = [np.frombuffer(x, np.uint64) for x in table["h"].to_pylist()]
    h = np.concatenate(hs)
    c = np.concatenate([np.frombuffer(x, np.uint32) for x in table["c"].to_pylist()])
    least = np.concatenate([np.frombuffer(unzip(x), np.int64) for x in table["least"].to_pylist()])
    order = np.lexsort((c, h))
    sh, sc, sl = h[order], c[order], least[order]
    new = np.ones(len(h), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (sc[1:] != sc[:-1])
    group = np.cumsum(new) - 1
    smaller = np.empty(len(h), bool)
    smaller[order] = np.minimum.reduceat(sl, np.flatnonzero(new))[group] < sl
    ranks, at = [], 0
    for x, one in zip(table["rank"].to_pylist(), hs, strict=True):
        rank = np.frombuffer(unzip(x), np.uint32)
        ranks.append(zstandard.ZstdCompressor(level=1).compress(rank[smaller[at : at + len(one)]].tobytes()))
        at += len(one)
    return pa.table({"block": table["block"], "ranks": pa.array(ranks, pa.binary())})


# --- third pass ------------------------------------------------------------------------------------------------


def removed(windows: Windows, ids: np.ndarray, earlier: np.ndarray, window: int) -> np.ndarray:
    """Which words go; ``earlier``: places, among the distinct windows, that start in a block with a smaller id."""
    _, _, least, _, place = windows.distinct(ids)
    whole = np.zeros(len(least), bool)
    whole[earlier] = True
    hit = whole[place] | (ids[windows.doc] > least[place])
    cover = np.zeros(int(windows.starts[-1]) + window + 1, np.int64)
    at = windows.at[hit]
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return np.cumsum(cover)[: int(windows.starts[-1])] > 0


def _apply(docs: DataFrame, *, key: str, text: str, window: int, block_bytes: int, load: int, depth: int, finish, schema: str) -> DataFrame:
    spark = docs.sparkSession
    blocks, _ = common.materialise(blocks_of(docs, text, window, block_bytes), "substring-blocks", codec="none")
    total = blocks.agg(F.sum("windows")).first()[0] or 0
    bits = max(16, (load * total).bit_length())
    if bits > 63:
        raise ValueError("more windows than counters can be addressed")
    # so many that the counters of a range fit into a task, whatever the session's number of partitions
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), total // RANGE_WINDOWS)

    def read(payload):
        table = _unpacked(payload)
        return table, _ids(table, key), Windows(table[text].to_pylist(), window)

    sketches = _sketches(blocks.select("block", "payload"), read, bits, ranges, depth)
    estimates = sketches.groupBy("row", "range").applyInArrow(_merge, REPLY)
    replies, at_replies = common.materialise(_replies(estimates, ["row", "range", "bits"], "replies"), "substring-estimates", codec="none")
    joined = blocks.join(replies.hint("shuffle_hash"), "block", "left").select("block", "payload", "replies")
    candidates = _candidates(joined, read, bits, ranges, depth)
    exact = candidates.groupBy("range").applyInArrow(_group, "block long, ranks binary")
    found, _ = common.materialise(_replies(exact, ["ranks"], "found"), "substring-found", codec="none")
    common.remove(spark, at_replies)

    def run(batches):
        for b in common.pieces(batches, 1):
            table, ids, windows = read(b["payload"][0].as_py())
            got = [np.frombuffer(zstandard.ZstdDecompressor().decompress(x["ranks"]), np.uint32) for x in (b["found"][0].as_py() or [])]
            gone = removed(windows, ids, np.concatenate(got) if got else np.empty(0, np.uint32), window)
            yield from finish(table, windows, gone)

    last = blocks.join(found.hint("shuffle_hash"), "block", "left").select("payload", "found")
    return last.mapInArrow(run, schema)


def removals(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, load: int = LOAD, depth: int = DEPTH) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) of each row."""

    def finish(table, windows, gone):
        n, k, sha = [], [], []
        for i, words in enumerate(windows.words):
            g = gone[windows.starts[i] : windows.starts[i + 1]]
            kept = [w for w, x in zip(words, g, strict=True) if not x] if g.any() else words
            n.append(len(words))
            k.append(len(words) - len(kept))
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        keys = table[key].combine_chunks()
        yield pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(sha, pa.string())], names=["k", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, text)
    return _apply(rows, key=key, text=text, window=window, block_bytes=block_bytes, load=load, depth=depth, finish=finish, schema=f"k {kind}, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("k", key)


def deduplicate(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows with the kept words, joined by spaces, as their text; rows that lose every word go, texts that lose none stay as they are."""

    def finish(table, windows, gone):
        texts, keep = table[text].to_pylist(), []
        for i, words in enumerate(windows.words):
            g = gone[windows.starts[i] : windows.starts[i + 1]]
            keep.append(not len(g) or not g.all())
            if g.any():
                texts[i] = b" ".join(w for w, x in zip(words, g, strict=True) if not x).decode()
        table = table.set_column(table.schema.get_field_index(text), table.schema.field(text), pa.array(texts, table.schema.field(text).type))
        if n_chars in table.column_names:
            at = table.schema.get_field_index(n_chars)
            sizes = [old if t is None else len(t) for t, old in zip(texts, table[n_chars].to_pylist(), strict=True)]
            table = table.set_column(at, table.schema.field(at), pa.array(sizes, table.schema.field(at).type))
        yield from table.filter(pa.array(keep, pa.bool_())).combine_chunks().to_batches()

    return _apply(docs, key=key, text=text, window=window, block_bytes=block_bytes, load=LOAD, depth=DEPTH, finish=finish, schema=common.schema_with(docs, ""))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(common.table(spark, sf_dir, "documents"))
