"""Operator 6: SimHash near-duplicates by covering locality-sensitive hashing.

Each bit position of a fingerprint is given a vector of ``radius + 1`` bits.  For each non-zero vector ``v`` of as
many bits there is a table whose mask has the positions whose vector has an odd product with ``v``.  Positions
where two fingerprints differ span at most ``radius`` dimensions, so some ``v`` is orthogonal to all of them: a
pair within the radius agrees under that mask.  No such pair is lost.

Equal fingerprints are one class before any table is made.  A bucket of up to ``SMALL`` classes is compared in a
task; each class of a larger bucket is instead keyed by itself and by its one-bit changes outside the mask, where
two classes within two bits share a key and classes that share a key are within two bits.  No list of pairs is made.

Null and empty texts have fingerprint zero, linked like any other; very long texts are hashed whole.  Repeated rows are
kept, each with its component; a null doc_id is never the least of its component unless nothing else is in it.  An empty
table gives no rows.  Other columns, whatever their names, are not read; ``keep_one`` returns them unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, components

RADIUS = 2
SHINGLE = 3
SMALL = 64
SEED = 42


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """Structured masks: positions take the non-zero vectors in turn, so that every mask has about 4/7 of them (radius 2)."""
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def words_of(text: str | None) -> list[bytes]:
    """Bytes: A-Z alone are lowered, ASCII white space alone splits."""
    return (text or "").encode().lower().split()


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles; zero without words."""
    return fingerprint_of(words_of(text), width)


def fingerprint_of(words: list[bytes], width: int = SHINGLE) -> int:
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    n = max(1, len(words) - width + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 8192):
        part = np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    def run(batches):
        for part in common.pieces(batches):
            f = np.array([fingerprint(t) for t in part["t"].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part["k"], pa.array(f, pa.int64())], names=["k", "f"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, f long")


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def _compare(batches):
    """Within each small bucket a forest of the links."""
    for part in common.pieces(batches, 4096):
        out = components.UnionFind()
        for bucket in part["fs"].to_pylist():
            a = np.sort(np.array(bucket, np.int64).view(np.uint64))
            near = np.argwhere(np.triu(np.bitwise_count(a[:, None] ^ a[None, :]) <= RADIUS, 1))
            for i, j in near:
                out.union(int(a[i].view(np.int64)), int(a[j].view(np.int64)))
        if out.parent:
            yield components.edge_batch(out.edges())


def links(classes: DataFrame) -> DataFrame:
    """Edges (u, v) among the distinct fingerprints ``f`` that connect just what is within the radius, maybe by others.

    In a large bucket classes are tied by the least class that shares a key, so an edge there joins two classes
    within the radius as well.
    """
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("f").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks())]))
    keyed = classes.select("f", tables.alias("x")).select("f", "x.t", "x.key")
    crowded = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared, _ = common.materialise(keyed.join(crowded, ["t", "key"]), "simhash-buckets")
    small = shared.where(F.col("n") <= SMALL).groupBy("t", "key").agg(F.collect_list("f").alias("fs")).select("fs").mapInArrow(_compare, components.EDGE)
    free = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1]) for m in masks()])
    variant = shared.where(F.col("n") > SMALL).select("f", "t", F.explode(F.element_at(free, F.col("t") + 1)).alias("bit")).select("f", "t", F.col("f").bitwiseXOR(F.col("bit")).alias("near"))
    # a key has at most one class for each free bit and itself: 29
    tied = variant.groupBy("t", "near").agg(F.collect_set("f").alias("fs")).where("size(fs) > 1")
    large = tied.select(F.explode("fs").alias("u"), F.array_min("fs").alias("v")).where("u <> v")
    return small.union(large)


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint long, component_id): one row for each row of ``docs``."""
    prints, _ = common.materialise(fingerprints(docs, key=key, text=text), "simhash-prints")
    classes, at_classes = common.materialise(prints.groupBy("f").agg(F.min("k").alias("least")), "simhash-classes")
    roots = components.connected_components(links(classes), "simhash-components")
    linked = roots.join(classes, roots.node == classes.f).select("f", "root", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    linked = linked.join(least, "root").select("f", F.col("component"))
    named = classes.join(linked, "f", "left").select("f", F.coalesce("component", "least").alias("component_id"))
    named, _ = common.materialise(named, "simhash-named")
    common.remove(docs.sparkSession, at_classes)
    return prints.join(named, "f").select(F.col("k").alias(key), F.col("f").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose key is the least of their component; rows of a null key are kept if alone with such."""
    found = near_duplicates(docs, key=key, text=text)
    keep = found.where(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("kept")).distinct()
    return docs.join(keep.hint("shuffle_hash"), docs[key].eqNullSafe(keep.kept), "left_semi")


def op6_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
