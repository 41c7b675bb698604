"""Near copies: documents whose SimHash fingerprints are within the radius of ``simhash``, and pairs with a Jaccard
similarity of 0.8 or more of their five-word shingles, found by MinHash and verified exactly.

``ROWS`` minima make a band, and rows that agree in one of ``BANDS`` bands share a bucket: a pair of similarity 0.8
shares none with a probability of 6e-5, more similar ones less often.  Within a bucket every pair is verified on its
texts' shingles, or is already known to be connected: first all members against one of them; then, in buckets that
still have members of several components, all members outside the largest one against all.  These are compared in
tasks, a block of some megabytes of shingles against another, which return a forest of the links and never the pairs.
Nothing is capped or sampled.

Rows with equal shingles are one class.  Texts of less than five words are one shingle; texts without words, null ones
among them, are one class, too.  Very long texts are shingled whole.  Repeated rows share a component, and an empty
table gives no rows.  Other columns, whatever their names, are not read; ``keep_one`` returns them unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components, simhash

SHINGLE = 5
SIMILARITY = 0.8
ROWS = 6
BANDS = 32
#: Bytes of shingles in a block of members.
BLOCK_BYTES = 4_000_000

_RNG = np.random.default_rng(20)
# products of 32 bits, which processors make many at a time
_TIMES = (_RNG.integers(0, 2**32, ROWS * BANDS, np.uint32) | np.uint32(1))[:, None]
_PLUS = _RNG.integers(0, 2**32, ROWS * BANDS, np.uint32)[:, None]
_BAND = _RNG.integers(0, 2**64, (BANDS, ROWS), np.uint64) | np.uint64(1)
_BAND_PLUS = _RNG.integers(0, 2**64, BANDS, np.uint64)
_PLACE = _RNG.integers(0, 2**64, 64, np.uint64) | np.uint64(1)


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct word shingles."""
    return shingles_of(simhash.words_of(text), width)


def shingles_of(words: list[bytes], width: int = SHINGLE) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    of = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    h = np.fromiter(map(of.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out += h[i : i + n] * _PLACE[i]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def bands(found: np.ndarray) -> np.ndarray:
    least = np.full(ROWS * BANDS, 2**32 - 1, np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 1024):
        part = _TIMES * short[None, i : i + 1024]
        part += _PLUS
        np.minimum(least, part.min(axis=1), out=least)
    return (least.astype(np.uint64).reshape(BANDS, ROWS) * _BAND).sum(axis=1) + _BAND_PLUS


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _classes(docs: DataFrame, key: str, text: str, least: float) -> DataFrame:
    def run(batches):
        for part in common.pieces(batches):
            c, n, f, b = [], [], [], []
            for t in part["t"].to_pylist():
                words = simhash.words_of(t)
                found = shingles_of(words)
                n.append(len(found))
                c.append(xxhash.xxh64_intdigest(found.tobytes()) - 2**63)
                f.append(simhash.fingerprint_of(words) - 2**63)
                # with fewer shingles than that only equal sets are similar enough
                b.append(bands(found).view(np.int64).tolist() if len(found) / (len(found) + 1) >= least else [])
            columns = [pa.array(c, pa.int64()), pa.array(n, pa.int64()), pa.array(f, pa.int64()), pa.array(b, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([part["k"], part["t"], *columns], names=["k", "t", "c", "n", "f", "bands"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, t string, c long, n long, f long, bands array<long>")


def _print_links(rows: DataFrame) -> DataFrame:
    """Edges among the classes whose fingerprints are within the radius of ``simhash``, maybe by others."""
    # -2**63 was subtracted, so the top bit is changed in all of them: differences stay what they are
    holders, _ = common.materialise(rows.groupBy("f").agg(F.min("c").alias("first"), F.count_distinct("c").alias("several")), "near-prints")
    same = rows.select("f", "c").distinct().join(holders.where("several > 1"), "f").where("c <> first").select(F.col("c").alias("u"), F.col("first").alias("v"))
    near = simhash.links(holders.select("f"))
    for end in ("u", "v"):
        own = holders.select(F.col("f").alias(end), F.col("first").alias(f"{end}_first"))
        near = near.join(own, end)
    return same.union(near.select(F.col("u_first").alias("u"), F.col("v_first").alias("v")))


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    def run(batches):
        kept: dict[int, np.ndarray] = {}

        def of(c, t):
            if c not in kept:
                if len(kept) >= 64:
                    kept.pop(next(iter(kept)))
                kept[c] = shingles(t)
            return kept[c]

        for part in common.pieces(batches):
            rows = zip(*(part[x].to_pylist() for x in ("u", "v", "tu", "tv")), strict=True)
            found = [(u, v) for u, v, tu, tv in rows if similarity(of(u, tu), of(v, tv)) >= least]
            if found:
                yield components.edge_batch(found)

    with_u = pairs.join(texts.select(F.col("c").alias("u"), F.col("t").alias("tu")), "u")
    return with_u.join(texts.select(F.col("c").alias("v"), F.col("t").alias("tv")), "v").select("u", "v", "tu", "tv").mapInArrow(run, components.EDGE)


def _compare(least: float):
    """Links between askers and members of one bucket and of different components, as a forest of components."""

    def run(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in table["s"].to_pylist()]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        root, asks = table["root"].to_numpy(), table["asks"].to_numpy(zero_copy_only=False)
        members, forest = np.flatnonzero(~asks), components.UnionFind()
        if len(members) and asks.any():
            every = np.concatenate([sets[i] for i in members])
            holder = np.repeat(np.arange(len(members)), sizes[members])
            order = np.argsort(every, kind="stable")
            values, first = np.unique(every[order], return_index=True)
            holder, first = holder[order], np.append(first, len(every))
            for i in np.flatnonzero(asks).tolist():
                at = np.searchsorted(values, sets[i])
                at = at[values[np.minimum(at, len(values) - 1)] == sets[i]]
                n = first[at + 1] - first[at]
                ends = np.cumsum(n)
                places = np.repeat(first[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
                both = np.bincount(holder[places], minlength=len(members))
                near = both / (sizes[i] + sizes[members] - both) >= least
                for r in set(root[members[near]].tolist()):
                    if r != root[i]:
                        forest.union(int(root[i]), r)
        return components.edge_table(forest.edges())

    return run


def _block_links(now: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Edges among the components of ``now`` (key, c, n, root, most): all outside a bucket's largest one against all in it."""
    asks = F.col("root") != F.col("most")
    size = F.sum(F.col("n") * 8)
    sizes = now.groupBy("key").agg(F.ceil(size / BLOCK_BYTES).cast("int").alias("m"), F.ceil(F.sum(F.when(asks, F.col("n") * 8)) / BLOCK_BYTES).cast("int").alias("q"))
    slot = F.xxhash64("c")
    full = now.join(sizes, "key").join(sets, "c")
    member = full.select("key", F.pmod(slot, F.col("m")).alias("a"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("b"), F.lit(False).alias("asks"), "root", "s")
    asker = full.where(asks).select("key", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("a"), F.pmod(slot, F.col("q")).alias("b"), F.lit(True).alias("asks"), "root", "s")
    return member.union(asker).groupBy("key", "a", "b").applyInArrow(_compare(least), components.EDGE)


def _sets(texts: DataFrame) -> DataFrame:
    def run(batches):
        for part in common.pieces(batches):
            yield pa.RecordBatch.from_arrays([part["c"], pa.array([shingles(t).tobytes() for t in part["t"].to_pylist()], pa.binary())], names=["c", "s"])

    return texts.mapInArrow(run, "c long, s binary")


def links(rows: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(node, root) of the classes of ``rows`` (c, n, f, bands, t) that are linked with others."""
    spark, scratch = rows.sparkSession, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        df, path = common.materialise(df, name)
        scratch.append(path)
        return df

    keyed = rows.where("size(bands) > 0").select("c", "n", F.explode("bands").alias("key")).distinct()
    crowded = keyed.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("c", "n")).alias("first")).where("m > 1")
    shared = kept(keyed.join(crowded, "key").select("key", "c", "n", "m", "first"), "near-buckets")
    fits = F.least("n", "first.n") >= F.greatest("n", "first.n") * F.lit(least - 1e-9)
    pairs = kept(shared.where((F.col("c") != F.col("first.c")) & fits).select(F.col("first.c").alias("u"), F.col("c").alias("v")).distinct(), "near-pairs")
    texts = kept(rows.select("c", "t").join(shared.select("c").distinct(), "c", "left_semi").groupBy("c").agg(F.first("t").alias("t")), "near-texts")
    roots = kept(components.connected_components(_print_links(rows).union(_verified(pairs, texts, least)), "near-components"), "near-roots")
    # a pair that is still in question has a member outside the largest component of its bucket, and isn't all of the bucket
    now = shared.where("m > 2").join(roots.select(F.col("node").alias("c"), "root"), "c", "left").select("key", "c", "n", F.coalesce("root", "c").alias("root"))
    parts = now.groupBy("key", "root").agg(F.count("*").alias("m"))
    several = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("m", "root")).getField("root").alias("most")).where("parts > 1")
    now = kept(now.join(several, "key"), "near-open")
    sets = _sets(texts.join(now.select("c").distinct(), "c", "left_semi"))
    stars = roots.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    out, _ = common.materialise(components.connected_components(stars.union(_block_links(now, sets, least)), "near-components"), "near-linked")
    for path in scratch:
        common.remove(spark, path)
    return out


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(key, component_id): one row for each row of ``docs``."""
    rows, at_rows = common.materialise(_classes(docs, key, text, least), "near-rows")
    classes = rows.groupBy("c").agg(F.min("k").alias("least"))
    linked = classes.join(links(rows, least), F.col("c") == F.col("node"), "left").select("c", F.coalesce("root", "c").alias("root"), "least")
    linked, at_linked = common.materialise(linked, "near-classes")
    component = linked.groupBy("root").agg(F.min("least").alias("component"))
    named = linked.join(component, "root").select("c", "component")
    found = rows.select("k", "c").join(named, "c").select(F.col("k").alias(key), F.col("component").alias("component_id"))
    found, _ = common.materialise(found, "near-found")
    for path in (at_rows, at_linked):
        common.remove(docs.sparkSession, path)
    return found


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose key is the least of their component; rows of a null key are kept if alone with such."""
    found = near_duplicates(docs, key=key, text=text, least=least)
    keep = found.where(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("kept")).distinct()
    return docs.join(keep.hint("shuffle_hash"), docs[key].eqNullSafe(keep.kept), "left_semi")
