"""Operator 13: line dedup with two Bloom filters, for hashes seen once and hashes seen twice.

A line's key is the line without ASCII white space at its ends and with A-Z in lower case.  Keys of ``LEAST`` code points or
more that two documents or more have lose all their lines, except in the document with the smallest id.

1. Rows are put in blocks of some megabytes (whole rows, compressed) in the shared folder.
2. Each block gives, for each slice (one for each hash function of the filters) and range of the filters, the bits that its
   distinct keys set, as Elias-Fano code, and which of them two of its own documents set.  For each slice and range the two
   filters are filled: a bit that is set already in the filter of what was seen once is set in the filter of what was
   seen twice.  The block gets back, for each bit it set, the bit of the second filter.  Bits are only ever set, so
   a repeated key is never missed; no line and no whole hash has been shuffled so far.
3. Keys whose bits are all set in the second filter are suspected repeats.  They alone are shuffled, one row for each
   block and key with its 128-bit hash and least id, grouped exactly, and joined with the smallest id of each.
4. Each block drops the lines of its keys that a smaller id has.

A filter has ``LOAD`` bits a slice for each key, so the share of unrepeated keys that are suspected doesn't grow with the
input.  A block sends at most one row for each slice and range, and never more of them than it has keys.  Two
different keys among 10**12 agree in 128 bits with a probability of 2e-15.

Null and empty texts have one empty line, which stays.  Rows with equal ids are one document.  Rows with a null id come after all
others: they lose what others have, and others and each other lose nothing to them.  Ids have to be integers.  Very long
texts are read whole, a block holding one of them alone; an empty table gives no rows.  ``removals`` reads no other
columns, whatever their names; ``deduplicate`` returns them unchanged, but for the number of characters.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, elias_fano

LEAST = 10
BLOCK_BYTES = 6_000_000
#: Bits of a slice for each key, and slices: a bit for each hash function.
LOAD = 8
SLICES = 2
RANGE_KEYS = 2_000_000
NULL_ID = 2**63 - 1

BLOCKS = "block long, keys long, payload binary"
SET = "block long, slice int, range long, cells binary, twice binary"
REPLY = "block long, slice int, range long, bits binary"


def key_of(line: bytes, least: int = LEAST) -> bytes | None:
    """The key of a line in UTF-8, or None if it is too short."""
    key = line.strip().lower()  # of bytes: ASCII alone
    n = len(key)
    if n < least or (n < 4 * least and len(key.decode(errors="replace")) < least):
        return None
    return key


def _lines(text: bytes | None) -> list[bytes]:
    return (text or b"").split(b"\n")


def blocks_of(docs: DataFrame, text: str, block_bytes: int) -> DataFrame:
    def run(batches):
        number, kept, size, keys = TaskContext.get().partitionId() << 32, [], 0, 0

        def out():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, kept[0].schema) as w:
                for b in kept:
                    w.write_batch(b)
            payload = zstandard.ZstdCompressor(level=1).compress(sink.getvalue())
            return common.batch_of(block=pa.array([number], pa.int64()), keys=pa.array([keys], pa.int64()), payload=pa.array([payload], pa.binary()))

        for part in common.pieces(batches, 64):
            texts = part[text].cast(pa.binary()).to_pylist()
            kept.append(part)
            size += sum(len(t) for t in texts if t)
            keys += sum(t.count(b"\n") + 1 for t in texts if t)
            if size >= block_bytes:
                yield out()
                number, kept, size, keys = number + 1, [], 0, 0
        if kept:
            yield out()

    return docs.mapInArrow(run, BLOCKS)


class Keys:
    """The distinct keys of a block in order of their hashes, with the least id that has each; ``place`` of each line (-1: no key)."""

    def __init__(self, payload: bytes, key: str, text: str, least: int):
        self.table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(payload)).read_all()
        self.ids = np.array([NULL_ID if k is None else k for k in self.table[key].to_pylist()], np.int64)
        self.texts = self.table[text].cast(pa.binary()).to_pylist()
        digests, at, sizes, line = [], [], [], 0
        for t in self.texts:
            lines = _lines(t)
            for i, x in enumerate(lines):
                k = key_of(x, least)
                if k is not None:
                    digests.append(xxhash.xxh3_128_digest(k))
                    at.append(line + i)
            sizes.append(len(lines))
            line += len(lines)
        self.starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        halves = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64)
        order = np.lexsort((halves[:, 1], halves[:, 0]))
        sorted_halves = halves[order]
        new = np.ones(len(order), bool)
        new[1:] = (sorted_halves[1:] != sorted_halves[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        self.halves = sorted_halves[first]
        at = np.array(at, np.int64)
        self.owner = self.ids[np.searchsorted(self.starts, at, side="right") - 1]
        own = self.owner[order]
        self.least = np.minimum.reduceat(own, first) if len(first) else own
        self.many = (np.maximum.reduceat(own, first) if len(first) else own) > self.least
        self.place = np.full(line, -1, np.int64)
        self.place[at[order]] = np.cumsum(new) - 1
        self.at = at

    def digests(self, which: np.ndarray) -> pa.Array:
        data = self.halves[which].astype(">u8").tobytes()
        return pa.array([data[i : i + 16] for i in range(0, len(data), 16)], pa.binary())

    def cells(self, slice_: int, bits: int) -> np.ndarray:
        """The bit that each key sets in a slice: two slices read different parts of the hash, further ones mix them."""
        h = self.halves[:, slice_ % 2] * np.uint64(2 * (slice_ // 2) + 1)
        return h >> np.uint64(64 - bits)


def _width(bits: int, ranges: int) -> int:
    return -(-(2**bits) // ranges)


def _grouped(cells: np.ndarray):
    """Places of the distinct cells in order, and the place among them of each of ``cells``."""
    order = np.argsort(cells, kind="stable")
    new = np.ones(len(cells), bool)
    new[1:] = cells[order][1:] != cells[order][:-1]
    place = np.empty(len(cells), np.int64)
    place[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), place


def _set_bits(blocks: DataFrame, read, bits: int, ranges: int, slices: int) -> DataFrame:
    width = _width(bits, ranges)
    schema = pa.schema([("block", pa.int64()), ("slice", pa.int32()), ("range", pa.int64()), ("cells", pa.binary()), ("twice", pa.binary())])

    def run(batches):
        for b in common.pieces(batches, 1):
            block, keys, rows = b["block"][0].as_py(), read(b["payload"][0].as_py()), []
            for s in range(slices):
                cells = keys.cells(s, bits)
                order, first, _ = _grouped(cells)
                if not len(first):
                    continue
                twice = np.add.reduceat(1 + keys.many[order].astype(np.int64), first) > 1
                cells = cells[order][first]
                cuts = np.searchsorted(cells, np.arange(ranges + 1, dtype=np.uint64) * np.uint64(width))
                for r in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                    a, z = cuts[r], cuts[r + 1]
                    rows.append((block, s, r, elias_fano.encode(cells[a:z] - np.uint64(r * width), width), np.packbits(twice[a:z]).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=schema)

    return blocks.mapInArrow(run, SET)


def _fill(width: int):
    def run(table: pa.Table) -> pa.Table:
        """The two filters of one slice and range, filled block by block; the second one's bits of each block."""
        once, twice = np.zeros(width, bool), np.zeros(width, bool)
        held = []
        for cells, own in zip(table["cells"], table["twice"], strict=True):
            cells = elias_fano.EliasFano(cells.as_py()).values()
            again = np.unpackbits(np.frombuffer(own.as_py(), np.uint8), count=len(cells)).astype(bool)
            twice[cells] |= once[cells] | again
            once[cells] = True
            held.append(cells.astype(np.uint32) if width < 1 << 32 else cells)
        replies = [np.packbits(twice[cells]).tobytes() for cells in held]
        return pa.table({"block": table["block"], "slice": table["slice"], "range": table["range"], "bits": pa.array(replies, pa.binary())})

    return run


def _suspects(joined: DataFrame, read, bits: int, ranges: int, slices: int) -> DataFrame:
    width = _width(bits, ranges)

    def run(batches):
        for b in common.pieces(batches, 1):
            block, keys = b["block"][0].as_py(), read(b["payload"][0].as_py())
            got = {(x["slice"], x["range"]): x["bits"] for x in (b["replies"][0].as_py() or [])}
            held = np.ones(len(keys.halves), bool)
            for s in range(slices):
                cells = keys.cells(s, bits)
                order, first, place = _grouped(cells)
                if not len(first):
                    continue
                cuts = np.searchsorted(cells[order][first], np.arange(ranges + 1, dtype=np.uint64) * np.uint64(width))
                flags = np.empty(len(first), bool)
                for r in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                    a, z = cuts[r], cuts[r + 1]
                    flags[a:z] = np.unpackbits(np.frombuffer(got[s, r], np.uint8), count=z - a)
                held &= flags[place]
            which = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), block), pa.int64()), pa.array(which, pa.int64()), keys.digests(which), pa.array(keys.least[which], pa.int64())], names=["block", "place", "digest", "least"])

    return joined.mapInArrow(run, "block long, place long, digest binary, least long")


def _apply(docs: DataFrame, *, key: str, text: str, least: int, block_bytes: int, load: int, slices: int, range_keys: int, finish, schema: str) -> DataFrame:
    spark = docs.sparkSession
    blocks, _ = common.materialise(blocks_of(docs, text, block_bytes), "line-blocks", codec="none")
    total = blocks.agg(F.sum("keys")).first()[0] or 0
    bits = max(16, (load * total).bit_length())
    # so many that a range's filters fit into a task, whatever the session's number of partitions
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), total // range_keys)

    def read(payload):
        return Keys(payload, key, text, least)

    seen = _set_bits(blocks.select("block", "payload"), read, bits, ranges, slices).groupBy("slice", "range").applyInArrow(_fill(_width(bits, ranges)), REPLY)
    replies = seen.groupBy("block").agg(F.collect_list(F.struct("slice", "range", "bits")).alias("replies"))
    joined = blocks.join(replies.hint("shuffle_hash"), "block", "left").select("block", "payload", "replies")
    suspects, at_suspects = common.materialise(_suspects(joined, read, bits, ranges, slices), "line-suspects")
    # summed by task first: a row for each key and task reaches the exact groups
    smallest = suspects.groupBy("digest").agg(F.min("least").alias("first"), F.max("least").alias("last")).where("first < last").select("digest", "first")
    later = suspects.join(smallest.hint("merge"), "digest").select("block", "place", "first")
    found, at_found = common.materialise(later.groupBy("block").agg(F.collect_list(F.struct("place", "first")).alias("found")), "line-found")
    common.remove(spark, at_suspects)

    def run(batches):
        for b in common.pieces(batches, 1):
            keys = read(b["payload"][0].as_py())
            # the smallest id of all that has the key
            first = keys.least.copy()
            got = b["found"].combine_chunks() if isinstance(b["found"], pa.ChunkedArray) else b["found"]
            if got.null_count == 0:
                pairs = got.flatten()
                first[pairs.field("place").to_numpy()] = pairs.field("first").to_numpy()
            gone = np.zeros(len(keys.place), bool)
            gone[keys.at] = keys.owner > first[keys.place[keys.at]]
            yield from finish(keys, gone)

    last = blocks.join(found.hint("shuffle_hash"), "block", "left").select("payload", "found")
    return last.mapInArrow(run, schema)


def _kept(keys: Keys, gone: np.ndarray):
    """For each document the lines that stay, and how many there were."""
    for i, t in enumerate(keys.texts):
        g = gone[keys.starts[i] : keys.starts[i + 1]]
        lines = _lines(t)
        yield ([x for x, out in zip(lines, g.tolist(), strict=True) if not out] if g.any() else lines), len(lines)


def removals(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = LEAST, block_bytes: int = BLOCK_BYTES, load: int = LOAD, slices: int = SLICES, range_keys: int = RANGE_KEYS) -> DataFrame:
    """(key, n_lines, n_dropped, kept_sha256) of each row."""

    def finish(keys, gone):
        n, dropped, sha = [], [], []
        for lines, before in _kept(keys, gone):
            n.append(before)
            dropped.append(before - len(lines))
            sha.append(hashlib.sha256(b"\n".join(lines)).hexdigest())
        yield pa.RecordBatch.from_arrays([keys.table[key].combine_chunks(), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())], names=["k", "n_lines", "n_dropped", "kept_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return _apply(docs.select(key, text), key=key, text=text, least=least, block_bytes=block_bytes, load=load, slices=slices, range_keys=range_keys, finish=finish, schema=f"k {kind}, n_lines long, n_dropped long, kept_sha256 string").withColumnRenamed("k", key)


def deduplicate(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", least: int = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows with the lines that stay as their text; rows that lose every line go, texts that lose none stay as they are."""

    def finish(keys, gone):
        table, texts, keep = keys.table, keys.table[text].to_pylist(), []
        for i, (lines, before) in enumerate(_kept(keys, gone)):
            keep.append(len(lines) > 0)
            if len(lines) < before:
                texts[i] = b"\n".join(lines).decode()
        table = table.set_column(table.schema.get_field_index(text), table.schema.field(text), pa.array(texts, table.schema.field(text).type))
        if n_chars in table.column_names:
            at = table.schema.get_field_index(n_chars)
            sizes = [old if t is None else len(t) for t, old in zip(texts, table[n_chars].to_pylist(), strict=True)]
            table = table.set_column(at, table.schema.field(at), pa.array(sizes, table.schema.field(at).type))
        yield from table.filter(pa.array(keep, pa.bool_())).combine_chunks().to_batches()

    return _apply(docs, key=key, text=text, least=least, block_bytes=block_bytes, load=LOAD, slices=SLICES, range_keys=RANGE_KEYS, finish=finish, schema=common.schema_with(docs, ""))


def op13_line_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(common.table(spark, sf_dir, "documents"))


_SPACE = r"[\x20\x09-\x0D]"
SQL = rf"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
numbered AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM docs),
keyed AS (SELECT doc_id, n, line, translate(regexp_replace(line, '^{_SPACE}+|{_SPACE}+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM numbered),
firsts AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= {LEAST} GROUP BY k),
marked AS (SELECT keyed.*, coalesce(first < doc_id, false) AS gone FROM keyed LEFT JOIN firsts USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
