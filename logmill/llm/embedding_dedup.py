"""Operator 8: embedding near-duplicates by spherical k-means cells.

Equal vectors are one class with a multiplicity.  Centroids are fitted on at most ``SAMPLE`` classes; every class is
indexed: it is a member of its nearest cell and is compared with the members of up to ``PROBES`` nearest ones, those
left out that lie beyond ``MARGIN``.  Members and askers of a cell are cut into blocks of some megabytes; a task
multiplies two blocks and returns sums and a forest of the links, never the pairs.  Each pair is counted once: where
both cells would find it, in the cell with the lesser number.  Vectors travel as they came, of 4 bytes a component if
they are floats, and are brought to length one in double precision where they are compared.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing; each is kept as its own
group.  Vectors of another length than the most common one have a cell for each length.  Repeated rows (equal ids)
are counted as often as they occur.  Ids have to be below 2**62; rows without one are counted as well, and only a group
of none but such rows has no component.  An empty table gives no rows.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, components

THRESHOLD = 0.9
SAMPLE = 16_384
CELL = 1_000
MOST_CELLS = 4_096
PROBES = 10
#: Bytes of a block of members; a block of askers has four times as many.
BLOCK_BYTES = 4_000_000
#: A cell is left out whose border with the own cell is farther than this from the vector.  In 64 dimensions, where the rest of
#: a vector spreads by 1/8, this leaves out pairs at the threshold with a probability of 0.002 for each such cell.
MARGIN = 0.18
#: Classes of rows without an id have numbers from here on.
NAMELESS = 1 << 62


def usable(values: list | None) -> np.ndarray | None:
    """The vector at length one in double precision, or None."""
    if not values or any(v is None for v in values):
        return None
    v = np.asarray(values, np.float64)
    if not np.isfinite(v).all() or not (top := np.abs(v).max()):
        return None
    v = v / top
    return v / np.linalg.norm(v)


def _kind(vectors: DataFrame, vector: str) -> type:
    """Floats travel as floats: in double precision they are the same numbers."""
    return np.float32 if vectors.schema[vector].dataType.simpleString() == "array<float>" else np.float64


def _classes(vectors: DataFrame, key: str, vector: str, kind: type) -> DataFrame:
    def run(batches):
        for part in common.pieces(batches, 1024):
            digests, raw = [], []
            for v in part["e"].to_pylist():
                fits = usable(v) is not None
                # no negative zero
                raw.append((np.asarray(v, kind) + kind(0)).tobytes() if fits else None)
                digests.append(hashlib.blake2b(raw[-1], digest_size=16).digest() if fits else None)
            yield pa.RecordBatch.from_arrays([part["k"], pa.array(digests, pa.binary()), pa.array(raw, pa.binary())], names=["k", "digest", "raw"])

    key_kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(F.col(key).alias("k"), F.col(vector).alias("e")).mapInArrow(run, f"k {key_kind}, digest binary, raw binary")


def _units(raw: list[bytes], kind: type) -> np.ndarray:
    """Vectors of one length, at length one in double precision."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Unit centroids; an empty cell takes the vector farthest from its own centroid."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([np.argmax(p @ centres.T, axis=1) for p in np.array_split(x, -(-len(x) // 2048))])
        own = np.einsum("ij,ij->i", x, centres[near])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        empty = np.flatnonzero(np.bincount(near, minlength=k) == 0)
        sums[empty] = x[np.argsort(own)[: len(empty)]]
        sizes = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(sizes > 1e-12, sums / np.maximum(sizes, 1e-12), centres)
    return centres


def fit(classes: DataFrame, kind: type, sample: int = SAMPLE, cell: int = CELL, most: int = MOST_CELLS) -> tuple[int, np.ndarray]:
    """The most common dimension and its centroids, from at most ``sample`` classes chosen by digest."""
    width = np.dtype(kind).itemsize
    dims = classes.groupBy((F.octet_length("raw") / width).cast("int").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not dims:
        return 0, np.zeros((0, 0))
    d, n = dims[0].d, dims[0].n
    share = min(1.0, 0.9 * sample / n) if n > sample else 1.0
    rows = classes.where((F.octet_length("raw") == width * d) & (F.pmod(F.xxhash64("digest"), F.lit(1 << 20)) < share * (1 << 20))).select("raw").limit(sample).collect()
    if not rows:
        return d, np.zeros((0, d))
    x = _units([bytes(r.raw) for r in rows], kind)
    x = x[np.lexsort(x.T[:4])]
    return d, spherical_kmeans(x, max(1, min(most, round(n / cell), len(x) // 4 or 1)))


def _dealt(classes: DataFrame, kind: type, d: int, centres: np.ndarray, probes: int, margin: float) -> DataFrame:
    width = np.dtype(kind).itemsize
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * (centres @ centres.T)))
    shared = classes.sparkSession.sparkContext.broadcast((centres, apart))

    def run(batches):
        c, distance = shared.value
        for part in common.pieces(batches, 2048):
            raw = part["raw"].to_pylist()
            own, near = [], []
            fits = [i for i, u in enumerate(raw) if len(u) == width * d and len(c)]
            ranked = {}
            if fits:
                sims = _units([raw[i] for i in fits], kind) @ c.T
                order = np.argsort(-sims, axis=1, kind="stable")[:, :probes]
                top = np.take_along_axis(sims, order, axis=1)
                close = top[:, :1] - top <= margin * distance[order[:, :1], order]
                ranked = {i: o[x].tolist() for i, o, x in zip(fits, order, close, strict=True)}
            for i, u in enumerate(raw):
                cells = ranked.get(i, [-(len(u) // width)])
                own.append(cells[0])
                near.append(cells)
            yield pa.RecordBatch.from_arrays([part["id"], part["n"], part["raw"], pa.array(own, pa.int64()), pa.array(near, pa.list_(pa.int64()))], names=["id", "n", "raw", "own", "probes"])

    return classes.select("id", "n", "raw").mapInArrow(run, "id long, n long, raw binary, own long, probes array<long>")


def _compare_blocks(threshold: float, kind: type):
    def run(table: pa.Table) -> pa.Table:
        cell = table["cell"][0].as_py()
        asks = table["probes"].is_null().to_numpy()
        ids, own, n = (table[c].to_numpy() for c in ("id", "own", "n"))
        members, askers = np.flatnonzero(~asks), np.flatnonzero(asks)
        probes = dict(zip(members.tolist(), map(set, table["probes"].take(pa.array(members)).to_pylist()), strict=True))
        x = _units(table["raw"].to_pylist(), kind)
        counts: dict[int, int] = {}
        forest = components.UnionFind()
        for a in np.array_split(askers, -(-len(askers) // 512)) if len(askers) and len(members) else []:
            for i, j in np.argwhere(x[a] @ x[members].T >= threshold):
                p, q = a[i], members[j]
                if own[p] == cell:
                    if ids[p] >= ids[q]:
                        continue
                elif own[p] < cell and own[p] in probes[q]:
                    continue  # found in the cell with the lesser number
                counts[int(ids[p])] = counts.get(int(ids[p]), 0) + int(n[q])
                counts[int(ids[q])] = counts.get(int(ids[q]), 0) + int(n[p])
                forest.union(int(ids[p]), int(ids[q]))
        rows = [(i, c, forest.find(i)) for i, c in counts.items()]
        a = np.array(rows, np.int64).reshape(-1, 3)
        return pa.table({"id": a[:, 0], "links": a[:, 1], "root": a[:, 2]})

    return run


def near_duplicates(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, probes: int | None = None, margin: float = MARGIN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, n_links, component_id, kept) for each row."""
    kind = _kind(vectors, vector)
    rows, _ = common.materialise(_classes(vectors, key, vector, kind), "embedding-rows")
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("k").cast("long").alias("least"), F.count("*").alias("n"), F.first("raw").alias("raw"))
    nameless = F.lit(NAMELESS) + F.pmod(F.xxhash64("digest"), F.lit(NAMELESS))
    classes, at_classes = common.materialise(classes.withColumn("id", F.coalesce("least", nameless)), "embedding-classes")
    d, centres = fit(classes, kind)
    probes = probes or max(PROBES, round(PROBES * (len(centres) / 256) ** 0.25))  # twice as many in 4,096 cells
    dealt, at_dealt = common.materialise(_dealt(classes, kind, d, centres, probes, margin), "embedding-cells")
    # one row for each cell; lengths other than the common one are cells, too
    size = F.sum(F.octet_length("raw"))
    parts = dealt.groupBy("own").agg(F.ceil(size / block_bytes).cast("int").alias("m")).select(F.col("own").alias("cell"), "m")
    asks = dealt.select(F.explode("probes").alias("cell"), "raw").groupBy("cell").agg(F.ceil(size / (4 * block_bytes)).cast("int").alias("q"))
    sizes, at_sizes = common.materialise(parts.join(asks, "cell").select("cell", "m", "q"), "embedding-sizes")
    both = ("id", "own", "n", "raw")
    slot = F.xxhash64("id")
    member = dealt.join(sizes, F.col("own") == F.col("cell")).select("cell", F.pmod(slot, F.col("m")).cast("int").alias("part_a"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("part_b"), *both, "probes")
    asker = dealt.select(F.explode("probes").alias("asked"), *both).join(sizes, F.col("asked") == F.col("cell")).select("cell", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("part_a"), F.pmod(slot, F.col("q")).cast("int").alias("part_b"), *both, F.lit(None).cast("array<long>").alias("probes"))
    found = member.union(asker).groupBy("cell", "part_a", "part_b").applyInArrow(_compare_blocks(threshold, kind), "id long, links long, root long")
    found, at_found = common.materialise(found, "embedding-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components.connected_components(found.select(F.col("id").alias("u"), F.col("root").alias("v")), "embedding-components")
    named = classes.select("digest", "id", "n").join(links, "id", "left").join(roots, F.col("id") == F.col("node"), "left")
    root = F.coalesce("root", "id")
    named = named.select("digest", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.when(root < NAMELESS, root).alias("component_id"))
    named, _ = common.materialise(named, "embedding-named")
    for path in (at_classes, at_dealt, at_sizes, at_found):
        common.remove(vectors.sparkSession, path)
    out = rows.select("k", "digest").join(named, "digest", "left")
    group = F.when(F.col("digest").isNull(), F.col("k").cast("long")).otherwise(F.col("component_id"))
    return out.select(F.col("k").alias(key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), group.alias("component_id"), F.coalesce(F.col("k") == group, F.lit(True)).alias("kept"))


def op8_embedding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))
