"""Operator 10: token ids in binary blocks with Elias-Fano document boundaries.

Format.  A table of blocks, written by Spark to any store and committed whole.  A block has: ``shard`` (the range of
keys that it is of), ``block`` (its number there), ``first`` (ids before it in its shard), ``n_docs``, ``n_ids``,
``ids`` (little-endian integers of ``width`` bytes, of all its documents, one after another), ``ends`` (Elias-Fano
code of the documents' ends in ``ids``; ``select(i)`` gives the i-th in near-minimal space, so no table of 64-bit
offsets is kept) and ``keys`` (the documents' keys as Arrow data).  Shards, blocks and documents are in ascending
order of the key; equal keys in order of a hash of their texts, null keys first.

Null text counts as empty: its end id alone.  Repeated rows are written as often as they occur.  A shard of equal
keys alone is split by the hash of the text.  An empty table gives no blocks, and no rows when read back.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, elias_fano, tokens

END = 1
BLOCK_IDS = 2_000_000
SHARD_BYTES = 128_000_000
FORMAT = "shard long, block long, first long, n_docs long, n_ids long, width int, ids binary, ends binary, keys binary"


def _keys_to_bytes(keys: list, kind: pa.DataType) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([pa.array(keys, kind)], names=["k"])
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _keys_of(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(data).read_all().column(0).combine_chunks()


def _bytes_of(rows: DataFrame) -> int:
    """Bytes that the optimiser expects of the scan; where it can't tell, those of the texts are added up."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else rows.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0


def write(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Write the token ids of every row's text in the format above."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    tie = F.xxhash64("t")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-_bytes_of(rows) // SHARD_BYTES))
    dealt = rows.repartitionByRange(shards, F.col("k"), tie).sortWithinPartitions(F.col("k"), tie)

    def run(batches):
        encoder, shard, block, first = tokens.word_bpe(), TaskContext.get().partitionId(), 0, 0
        parts, keys, ends, total, kind = [], [], [], 0, None
        end = np.array([END], "<u2").tobytes()

        def out():
            ids = b"".join(parts)
            row = {"shard": [shard], "block": [block], "first": [first], "n_docs": [len(keys)], "n_ids": [total], "width": [2], "ids": [ids], "ends": [elias_fano.encode(np.array(ends, np.uint64), total + 1)], "keys": [_keys_to_bytes(keys, kind)]}
            return pa.RecordBatch.from_pydict(row, schema=_SCHEMA)

        for part in tokens.slices(batches, "t"):
            kind = part["k"].type
            found, bounds = encoder.encode(part["t"])
            data, bounds = memoryview(found.astype("<u2", copy=False)).cast("B"), bounds.tolist()
            for i, k in enumerate(part["k"].to_pylist()):
                parts += [data[2 * bounds[i] : 2 * bounds[i + 1]], end]
                total += bounds[i + 1] - bounds[i] + 1
                keys.append(k)
                ends.append(total)
                if total >= block_ids:
                    yield out()
                    block, first = block + 1, first + total
                    parts, keys, ends, total = [], [], [], 0
        if keys:
            yield out()

    dealt.mapInArrow(run, FORMAT).write.option("compression", "zstd").parquet(path)


_SCHEMA = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("first", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("ends", pa.binary()), ("keys", pa.binary())])


def documents_of(block: dict):
    """(position, begin, end, ids) of each document of a block, through select on its boundaries."""
    ids = np.frombuffer(block["ids"], f"<u{block['width']}")
    ends = elias_fano.EliasFano(block["ends"])
    begin = 0
    for i in range(len(ends)):
        end = ends.select(i)
        yield i, begin, end, ids[begin:end]
        begin = end


def read(spark: SparkSession, path: str, *, key: str = "doc_id", kind: str = "bigint") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each document in the files; ``start``: ids of all documents before it."""
    blocks = spark.read.schema(FORMAT).parquet(path)
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # one row for each shard, as many as the writer had tasks
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = blocks.join(F.broadcast(base), "shard").withColumn("first", F.col("first") + F.col("base")).select("first", "width", "ids", "ends", "keys")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.slice(i, 1).to_pylist()[0]
                found = [(block["first"] + a, b - a, crc32(ids.astype("<u4").tobytes())) for _, a, b, ids in documents_of(block)]
                cols = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([_keys_of(block["keys"]), *cols], names=["k", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, f"k {kind}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("k", key)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    path = common.scratch(spark, "token-files")
    write(docs, path)
    return read(spark, path, kind=docs.schema["doc_id"].dataType.simpleString())
