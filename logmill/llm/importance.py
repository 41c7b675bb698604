"""Operator 12: importance resampling towards a target, by a dictionary of distinct features.

Features are runs of 1 to ``ORDER`` consecutive words, joined by a space, with repeats.  A feature's bucket is the CRC-32 of its
bytes modulo ``BUCKETS``; a bucket's gain is the logarithm of its share in the target over its share in the documents, in
thousandths, with one added to each bucket.  A document's weight is the sum of the gains of its features; a Gumbel
number drawn from its id is added, and the highest scores among the documents of ``LEAST_WORDS`` words or more are drawn,
which samples without replacement in proportion to the weights.

1. Rows are put in blocks: a table of (document, feature, count) as packed arrays, beside the block's distinct features.
2. The blocks' dictionaries are summed to one dictionary of the corpus.  Each distinct feature is hashed there, once, and
   its bucket summed; the target likewise.  ``BUCKETS`` gains are joined to the dictionary, and the dictionary to the
   blocks' features: a block gets the gain of each of its features back.
3. Each block adds up its documents' gains.
4. Documents that may be drawn are dealt by ranges of their scores and sorted there; a document's rank is its place in its
   range behind the sizes of the ranges before.

Null and empty texts and texts without a word have no features, weight 0 and are never drawn.  A null id is drawn for as
``2024:`` alone and comes after all others among equal scores; rows with equal ids have equal random numbers and take a rank
each.  Very long texts are read whole; a block holds one of them alone.  An empty table gives no rows; without a target all
features gain alike.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

ORDER = 1
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
BLOCK_BYTES = 6_000_000

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLOCKS = "block long, payload binary, features array<string>, counts array<long>"


def features(text: bytes | None, order: int = ORDER) -> tuple[int, list[bytes]]:
    """How many words a text has, and its features with repeats."""
    words = _WORD.findall((text or b"").lower())  # of bytes: ASCII alone
    out = words
    for k in range(2, order + 1):
        out = out + [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    return len(words), out


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, each as its lowest bytes, its second lowest bytes and so on, which compress well."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(len(a).to_bytes(8, "little") + x for a, x in zip(arrays, planes, strict=True)))


def _unpack(payload: bytes, *kinds: type) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(payload), 0, []
    for kind in kinds:
        n, size = int.from_bytes(data[at : at + 8], "little"), np.dtype(kind).itemsize
        planes = np.frombuffer(data, np.uint8, n * size, at + 8).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(-1))
        at += 8 + n * size
    return out


def _steps(at: np.ndarray, n: np.ndarray, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's places in rising order as steps from one to the next, with their counts."""
    order = np.lexsort((at, np.repeat(np.arange(len(distinct)), distinct)))
    at, steps = at[order], at[order].copy()
    steps[1:] -= at[:-1]
    first = (np.cumsum(distinct) - distinct)[distinct > 0]
    steps[first] = at[first]
    return steps, n[order]


def _places(steps: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(steps, dtype=np.int64)))
    return sums[1:] - np.repeat(sums[np.cumsum(distinct) - distinct], distinct)


#: Ids, whether there is one, words, features, and for each document its distinct features' places, as steps, and counts.
_ARRAYS = (np.int64, np.uint8, np.int64, np.int64, np.int64, np.uint32, np.uint32)


def blocks_of(docs: DataFrame, key: str, text: str, order: int, block_bytes: int) -> DataFrame:
    schema = pa.schema([("block", pa.int64()), ("payload", pa.binary()), ("features", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

    def run(batches):
        number, size = TaskContext.get().partitionId() << 32, 0
        places: dict[bytes, int] = {}
        rows, places_of, counts_of = [], [], []

        def out():
            ids, words, total, distinct = (np.array(c, np.int64) for c in zip(*((0 if r[0] is None else r[0], *r[1:]) for r in rows), strict=True))
            named = np.array([r[0] is not None for r in rows], np.uint8)
            at, n = np.concatenate(places_of), np.concatenate(counts_of)
            sums = np.bincount(at, weights=n, minlength=len(places)).astype(np.int64)
            payload = _pack(ids, named, words, total, distinct, *_steps(at, n, distinct))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([payload], pa.binary()), pa.array([[x.decode(errors="replace") for x in places]], pa.list_(pa.string())), pa.array([sums], pa.list_(pa.int64()))], schema=schema)

        for part in common.pieces(batches, 64):
            for k, t in zip(part[key].to_pylist(), part[text].cast(pa.binary()).to_pylist(), strict=True):
                n_words, found = features(t, order)
                counted = Counter(found)
                at = np.fromiter((places.setdefault(f, len(places)) for f in counted), np.uint32, len(counted))
                rows.append((k, n_words, len(found), len(counted)))
                places_of.append(at)
                counts_of.append(np.fromiter(counted.values(), np.uint32, len(counted)))
                size += len(t or b"")
            if size >= block_bytes:
                yield out()
                number, size = number + 1, 0
                places, rows, places_of, counts_of = {}, [], [], []
        if rows:
            yield out()

    return docs.select(key, text).mapInArrow(run, BLOCKS)


def dictionary(blocks: DataFrame) -> DataFrame:
    """(feature, n): how often all blocks have each distinct feature."""
    pairs = blocks.select(F.explode(F.arrays_zip("features", "counts")).alias("x"))
    return pairs.groupBy(F.col("x.features").alias("feature")).agg(F.sum("x.counts").alias("n"))


def bucket_of(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def gains(own: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of all ``buckets``, from two tables of (bucket, n)."""
    spark = own.sparkSession
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    for name, counted in (("s", own), ("t", target)):
        sums = counted.groupBy("bucket").agg(F.sum("n").alias(name))
        both = both.join(sums, "bucket", "left").na.fill(0, [name])
    # ``buckets`` rows at most, so are the sums over all of them
    total = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    real = lambda c: c.cast("double")
    share = real(F.col("t") + 1) * real(F.col("all_s") + buckets) / (real(F.col("s") + 1) * real(F.col("all_t") + buckets))
    return both.crossJoin(F.broadcast(total)).select("bucket", F.floor(1000 * F.log(share)).cast("int").alias("gain"))


def gumbel(key: Column, seed: str) -> Column:
    """The random number of an id, in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weights(docs: DataFrame, target: DataFrame, *, key: str = "doc_id", text: str = "text", target_key: str = "item_id", target_text: str = "text", order: int = ORDER, buckets: int = BUCKETS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, n_words, n_features, weight) of each row."""
    spark = docs.sparkSession
    blocks, _ = common.materialise(blocks_of(docs, key, text, order, block_bytes), "importance-blocks")
    known = dictionary(blocks).withColumn("bucket", bucket_of(F.col("feature"), buckets))
    known, at_known = common.materialise(known, "importance-dictionary")
    aimed = dictionary(blocks_of(target, target_key, target_text, order, block_bytes)).withColumn("bucket", bucket_of(F.col("feature"), buckets))
    gain, at_gain = common.materialise(gains(known, aimed, buckets).coalesce(1), "importance-gains")  # ``buckets`` rows
    valued = known.join(F.broadcast(gain), "bucket").select("feature", "gain")
    asked = blocks.select("block", F.posexplode("features").alias("place", "feature"))
    # a row for each block and feature: a word that all documents have takes a row a block
    told = asked.join(valued.hint("merge"), "feature").groupBy("block").agg(F.collect_list(F.struct(F.col("place"), F.col("gain"))).alias("gains"))
    told, _ = common.materialise(told, "importance-replies")
    common.remove(spark, at_known)
    common.remove(spark, at_gain)
    kind = docs.schema[key].dataType.simpleString()
    key_type = to_arrow_type(docs.schema[key].dataType)

    def run(batches):
        for b in common.pieces(batches, 1):
            ids, named, words, total, distinct, steps, n = _unpack(b["payload"][0].as_py(), *_ARRAYS)
            at = _places(steps, distinct)
            gain = np.zeros(len(at) and int(at.max()) + 1, np.int64)
            if b["gains"].null_count == 0:
                pairs = b["gains"].flatten()
                gain[pairs.field("place").to_numpy()] = pairs.field("gain").to_numpy()
            ends = np.cumsum(distinct)
            sums = np.concatenate(([0], np.cumsum(gain[at] * n.astype(np.int64))))
            weight = sums[ends] - sums[ends - distinct]
            keys = pa.array(ids, pa.int64(), mask=named == 0).cast(key_type)
            yield pa.RecordBatch.from_arrays([keys, pa.array(words), pa.array(total), pa.array(weight)], names=["k", "n_words", "n_features", "weight"])

    joined = blocks.select("block", "payload").join(told.hint("shuffle_hash"), "block", "left").select("payload", "gains")
    return joined.mapInArrow(run, f"k {kind}, n_words long, n_features long, weight long").withColumnRenamed("k", key)


def draw(scored: DataFrame, eligible: Column, percent: int, *, key: str = "doc_id", score: str = "score") -> DataFrame:
    """Add ``rank``: 1, 2, 3 ... of the floor(percent * N / 100) highest scores among the N eligible rows, ties to smaller keys; null for others."""
    spark = scored.sparkSession
    by = [F.desc(score), F.asc_nulls_last(key)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = scored.where(eligible).repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    placed, _ = common.materialise(placed, "importance-sorted")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # a row for each range of scores
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).collect()
    before, total = [], 0
    for r in sorted(sizes):
        before.append((r._part, total))
        total += r._n
    offsets = spark.createDataFrame(before, "_part long, _before long")
    rank = F.col("_before") + place + 1
    ranked = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    drawn = ranked.select(*scored.columns, F.when(rank <= percent * total // 100, rank).alias("rank"))
    return drawn.union(scored.where(~eligible).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, *, key: str = "doc_id", least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED, **more) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of each row; ``rank`` is null for rows that aren't drawn."""
    found = weights(docs, target, key=key, **more)
    scored, _ = common.materialise(found.withColumn("score", F.col("weight") + gumbel(F.col(key), seed)), "importance-scored")
    return draw(scored, F.col("n_words") >= least_words, percent, key=key)


def op12_importance_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def _counted(table: str) -> str:
    return f"SELECT unnest(words) AS f FROM (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM {table})"


#: The CRC-32 of each distinct feature is taken byte by byte from its table of 256 remainders, which a recursion makes.
SQL = rf"""
WITH RECURSIVE bits(b, c, k) AS (
  SELECT range, range, 0 FROM range(256) UNION ALL
  SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
remainders AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
own AS (SELECT f, count(*) AS n FROM ({_counted("documents")}) GROUP BY f),
aimed AS (SELECT f, count(*) AS n FROM ({_counted("benchmark")}) GROUP BY f),
spelled AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM own UNION SELECT f FROM aimed)),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substring(x, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM spelled, remainders),
s AS (SELECT bucket, sum(n) AS s FROM own JOIN hashed USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM aimed JOIN hashed USING (f) GROUP BY bucket),
whole AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS all_s, (SELECT coalesce(sum(t), 0) FROM t) AS all_t),
gains AS (
  SELECT range AS bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + {BUCKETS})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM range({BUCKETS}) LEFT JOIN s ON range = s.bucket LEFT JOIN t ON range = t.bucket, whole),
valued AS (SELECT f, gain FROM hashed JOIN gains USING (bucket)),
docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
weighed AS (SELECT doc_id, sum(gain) AS weight FROM (SELECT doc_id, unnest(words) AS f FROM docs) JOIN valued USING (f) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substring(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM docs LEFT JOIN weighed USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN r <= {PERCENT} * n // 100 THEN r END::BIGINT AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""
