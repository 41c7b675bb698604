"""Operator 11: hard negatives by partial products after an orthogonal PCA rotation.

Components are cut to integers (``floor(scale * x)``); a score is the integer inner product with an anchor.  An anchor's
positives are its first rows of its own label; its hard negatives for each positive are the first rows of other labels whose
score lies between two percentages of the positive's.  Higher scores come first, equal ones by smaller id.

1. Usable rows are written once as integers.  A rotation onto principal axes is fitted on at most ``SAMPLE`` rows chosen
   by hash; it is orthogonal, so it keeps products, and only speed depends on it.
2. Anchors are dealt to batches of bounded bytes, one broadcast each; all rows are scanned for each batch, in
   tiles.  A tile adds up products of leading components; what the rest can still add is at most the product of the
   two residual norms, plus slack for rounding.  Pairs that can't reach the scores still wanted are discarded, the
   others verified by integer products.  The scores still wanted rise with what a task has found, and begin with what the
   sample gives.
3. Each task returns at most so many rows of an anchor as are asked for; the best of all tasks are ranked by a window.

The same search runs twice, for positives and then for negatives within their bands; no pair is taken or left by its
estimate alone, and rows are never cut.

Rows with a null id, label or vector, an empty vector, or null or non-finite components take no part, nor do those of
another length than the most common one (ties: the shorter), which have no product, nor those whose squared
length is 2**55 or more after cutting, whose comparisons don't fit into 64 bits.  Rows that repeat id, label and vector
count once; rows of one id that differ in them count each, as anchors as well.  Empty tables and anchors without
positives give no rows.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LOWER, UPPER = 50, 95
#: Rows that the rotation and the first thresholds are taken from, and their bytes at most.
SAMPLE = 16_384
SAMPLE_BYTES = 16_000_000
#: Bytes of the anchors of one batch, and a tile's rows and anchors.
BATCH_BYTES = 16_000_000
TILE_ROWS, TILE_ANCHORS = 4_096, 256
#: Below this share of a tile's pairs, those left are verified at once.
FEW = 0.03
LEAST, MOST = -(2**62), 2**62
ROWS = "id long, label long, q binary"


# --- rows ------------------------------------------------------------------------------------------------------


def usable(values: list | None, scale: int = SCALE) -> np.ndarray | None:
    """The components as integers, or None."""
    if not values or any(v is None for v in values):
        return None
    x = np.asarray(values, np.float64)
    if not np.isfinite(x).all():
        return None
    with np.errstate(over="ignore"):
        q = np.floor(scale * x)
        return q.astype(np.int64) if q @ q < 2.0**55 else None


def cut_rows(vectors: DataFrame, key: str, label: str, vector: str, scale: int) -> DataFrame:
    def run(batches):
        for part in common.pieces(batches, 1024):
            q = [usable(v, scale) for v in part["v"].to_pylist()]
            raw = [None if x is None else x.astype(np.int32).tobytes() for x in q]
            yield pa.RecordBatch.from_arrays([part["id"], part["label"], pa.array(raw, pa.binary())], names=["id", "label", "q"])

    own = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"))
    return own.where("id is not null and label is not null").mapInArrow(run, ROWS).where("q is not null")


def _matrix(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.int32).reshape(len(raw), -1)


def rotation(q: np.ndarray, d: int) -> np.ndarray:
    """Orthogonal axes, those of most weight first."""
    if not len(q):
        return np.eye(d)
    x = q.astype(np.float64)
    x /= max(1.0, np.abs(x).max())
    return np.linalg.eigh(x.T @ x)[1][:, ::-1]


# --- search ----------------------------------------------------------------------------------------------------


def cuts_of(d: int) -> list[int]:
    """Numbers of leading components after which bounds are taken."""
    return sorted({max(1, d // 8), max(1, d // 4), max(1, d // 2), max(1, 3 * d // 4), d})


def _turned(q: np.ndarray, axes: np.ndarray):
    """Rotated rows, and the norms of what is left of them after each cut, and their whole norms."""
    r = q.astype(np.float64) @ axes
    squares = np.cumsum((r * r)[:, ::-1], axis=1)[:, ::-1]
    d = q.shape[1]
    tails = np.stack([np.sqrt(squares[:, c]) if c < d else np.zeros(len(q)) for c in cuts_of(d)], axis=1)
    return r, tails, np.sqrt(squares[:, 0])


def survivors(a, b, low: np.ndarray, high: np.ndarray, alive: np.ndarray):
    """Pairs (i, j) of two sets of turned rows that may have low[i] <= product <= high[i], out of those ``alive``."""
    (ra, ta, na), (rb, tb, nb) = a, b
    partial, begin = np.zeros(alive.shape), 0
    # a rotated product of d terms is wrong by far less than this share of the norms
    slack = np.outer(na, 1e-9 * nb) + 1e-3
    for k, cut in enumerate(cuts_of(ra.shape[1])):
        partial += ra[:, begin:cut] @ rb[:, begin:cut].T
        rest = np.outer(ta[:, k], tb[:, k]) + slack
        alive &= (partial + rest >= low[:, None]) & (partial - rest <= high[:, None])
        begin = cut
        if np.count_nonzero(alive) <= FEW * alive.size:
            break
    return np.nonzero(alive)


def products(qa: np.ndarray, qb: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer products of pairs, some thousands at a time."""
    out = np.empty(len(i), np.int64)
    for s in range(0, len(i), 16_384):
        e = s + 16_384
        out[s:e] = np.einsum("ij,ij->i", qa[i[s:e]].astype(np.int64), qb[j[s:e]].astype(np.int64))
    return out


class Best:
    """The ``most`` first (score, id) of each group, kept as they come; equal ones count once."""

    def __init__(self, groups: int, most: int, score: np.ndarray, of: np.ndarray):
        self.most = most
        self.group, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        #: What a further row has to have at least: the score, and at that score an id that isn't larger.
        self.low, self.low_id = score.copy(), of.copy()

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        g, s, i = np.concatenate((self.group, group)), np.concatenate((self.score, score)), np.concatenate((self.id, ids))
        order = np.lexsort((i, -s, g))
        g, s, i = g[order], s[order], i[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (i[1:] != i[:-1])
        g, s, i = g[new], s[new], i[new]
        first = np.ones(len(g), bool)
        first[1:] = g[1:] != g[:-1]
        at = np.flatnonzero(first)
        rank = np.arange(len(g)) - np.repeat(at, np.diff(np.append(at, len(g))))
        kept = rank < self.most
        self.group, self.score, self.id = g[kept], s[kept], i[kept]
        last = rank == self.most - 1
        better = (s[last] > self.low[g[last]]) | ((s[last] == self.low[g[last]]) & (i[last] < self.low_id[g[last]]))
        self.low[g[last][better]], self.low_id[g[last][better]] = s[last][better], i[last][better]

    def wanted(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return (score > self.low[group]) | ((score == self.low[group]) & (ids <= self.low_id[group]))


class Search:
    """Rows for the anchors of one batch.

    ``anchors`` has id, label and q; ``bands``: for each anchor rows of (low, high) of each of its positives, or None for the
    search of positives.  Groups are anchors, or anchors times positives.
    """

    def __init__(self, anchors: pa.Table, axes: np.ndarray, most: int, bands: tuple[np.ndarray, np.ndarray] | None = None, score: np.ndarray | None = None, of: np.ndarray | None = None):
        self.ids, self.labels = (anchors[c].to_numpy() for c in ("id", "label"))
        self.q = _matrix(anchors["q"].to_pylist())
        self.axes = axes
        self.turned = _turned(self.q, axes)
        self.bands = bands
        self.each = 1 if bands is None else bands[0].shape[1]
        groups = len(self.ids) * self.each
        low = np.full(groups, LEAST) if bands is None else bands[0].reshape(-1)
        none = np.full(groups, 2**63 - 1)
        self.best = Best(groups, most, low if score is None else np.maximum(score, low), none if score is None else np.where(score >= low, of, none))
        self.high = np.full(len(self.ids), MOST) if bands is None else bands[1].max(axis=1)
        self.by_label = {x: np.flatnonzero(self.labels == x) for x in np.unique(self.labels)}

    def feed(self, ids: np.ndarray, labels: np.ndarray, raw: list[bytes]) -> None:
        for s in range(0, len(ids), TILE_ROWS):
            self._tile(ids[s : s + TILE_ROWS], labels[s : s + TILE_ROWS], _matrix(raw[s : s + TILE_ROWS]))

    def _tile(self, ids, labels, q) -> None:
        turned, found = _turned(q, self.axes), []
        if self.bands is None:  # rows of a label meet the anchors of that label
            for x in np.unique(labels):
                rows = np.flatnonzero(labels == x)
                part = tuple(t[rows] for t in turned)
                for who in self._parts(self.by_label.get(x, np.empty(0, np.int64))):
                    alive = self.ids[who][:, None] != ids[rows][None, :]
                    found.append(self._verified(who, rows, survivors(tuple(t[who] for t in self.turned), part, self.best.low[who], self.high[who], alive), ids, q))
        else:
            rows = np.arange(len(ids))
            low = self.best.low.reshape(-1, self.each).min(axis=1)
            for who in self._parts(np.flatnonzero(low <= self.high)):
                alive = self.labels[who][:, None] != labels[None, :]
                found.append(self._verified(who, rows, survivors(tuple(t[who] for t in self.turned), turned, low[who], self.high[who], alive), ids, q))
        if found:
            self.best.add(*(np.concatenate(c) for c in zip(*found, strict=True)))

    def _parts(self, who: np.ndarray):
        return (who[s : s + TILE_ANCHORS] for s in range(0, len(who), TILE_ANCHORS))

    def _verified(self, who, rows, pairs, ids, q) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, score, id) of the pairs that are still wanted."""
        i, j = who[pairs[0]], rows[pairs[1]]
        score, out = products(self.q, q, i, j), []
        for p in range(self.each):
            group = i * self.each + p
            fits = self.best.wanted(group, score, ids[j])
            if self.bands is not None:
                fits &= (score >= self.bands[0][i, p]) & (score <= self.bands[1][i, p])
            out.append((group[fits], score[fits], ids[j[fits]]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


# --- jobs ------------------------------------------------------------------------------------------------------

ANCHOR = ["key", "id", "label", "q"]
FOUND = "key long, place int, id long, score long"


def _bands(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    width = max([1, *(len(x) for x in table["low"].to_pylist())])
    low, high = (np.full((table.num_rows, width), none) for none in (MOST, LEAST))
    for out, name in ((low, "low"), (high, "high")):
        for i, x in enumerate(table[name].to_pylist()):
            out[i, : len(x)] = x
    return low, high


def _searched(table: pa.Table, axes: np.ndarray, most: int, floors: bool) -> Search:
    bands = _bands(table) if "low" in table.column_names else None
    if not floors:
        return Search(table, axes, most, bands)
    width = 1 if bands is None else bands[0].shape[1]
    known = [np.full((table.num_rows, width), none) for none in (LEAST, 2**63 - 1)]
    for out, name in zip(known, ("floor", "floor_id"), strict=True):
        for i, x in enumerate(table[name].to_pylist()):
            out[i, : len(x)] = x
    return Search(table, axes, most, bands, known[0].reshape(-1), known[1].reshape(-1))


def _with_floors(anchors: DataFrame, sample, axes: np.ndarray, most: int) -> DataFrame:
    """Add to each anchor, for each place, the score and id that the sample alone already offers."""
    shared = anchors.sparkSession.sparkContext.broadcast((sample, axes))

    def run(batches):
        (ids, labels, raw), turn = shared.value
        for part in common.pieces(batches, 4 * TILE_ANCHORS):
            table = pa.Table.from_batches([part])
            if not table.num_rows:
                continue
            search = _searched(table, turn, most, False)
            search.feed(ids, labels, raw)
            floor, of = (x.reshape(-1, search.each).tolist() for x in (search.best.low, search.best.low_id))
            yield part.append_column("floor", pa.array(floor, pa.list_(pa.int64()))).append_column("floor_id", pa.array(of, pa.list_(pa.int64())))

    return anchors.mapInArrow(run, common.schema_with(anchors, "floor array<long>, floor_id array<long>"))


def _found(rows: DataFrame, anchors: DataFrame, axes: np.ndarray, most: int, batch_bytes: int, d: int, name: str) -> tuple[DataFrame, list[str]]:
    """What each task finds for each anchor, batch after batch of anchors."""
    spark = rows.sparkSession
    n = anchors.count()
    batches = max(1, -(-n * (4 * d + 200) // batch_bytes))
    dealt = anchors.withColumn("batch", F.pmod(F.xxhash64("key"), F.lit(batches)))
    paths = []
    for number in range(batches if n else 0):
        held = dealt.where(F.col("batch") == number).drop("batch").toArrow()  # ``batch_bytes``, give or take what hashing deals unevenly
        if not held.num_rows:
            continue
        shared = spark.sparkContext.broadcast((held, axes))

        def run(parts, shared=shared):
            table, turn = shared.value
            search = _searched(table, turn, most, True)
            for part in common.pieces(parts, TILE_ROWS):
                search.feed(part["id"].to_numpy(), part["label"].to_numpy(), part["q"].to_pylist())
            keys, best = table["key"].to_numpy(), search.best
            yield pa.RecordBatch.from_arrays([pa.array(keys[best.group // search.each]), pa.array(best.group % search.each, pa.int32()), pa.array(best.id), pa.array(best.score)], names=["key", "place", "id", "score"])

        _, path = common.materialise(rows.mapInArrow(run, FOUND), name)
        paths.append(path)
        shared.destroy()
    own = spark.read.schema(FOUND).parquet(*paths) if paths else spark.createDataFrame([], FOUND)
    # equal rows of several tasks count once
    place = F.dense_rank().over(Window.partitionBy("key", "place").orderBy(F.desc("score"), "id"))
    return own.withColumn("rank", place).where(F.col("rank") <= most).dropDuplicates(["key", "place", "rank"]), paths


def _percent(score: Column, percent: int) -> Column:
    """floor(percent * score / 100) in integers."""
    return F.call_function("div", score * percent - F.pmod(score * percent, F.lit(100)), F.lit(100))


def mine(vectors: DataFrame, anchor: Column, *, key: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, lower: int = LOWER, upper: int = UPPER, scale: int = SCALE, batch_bytes: int = BATCH_BYTES, sample: int = SAMPLE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``anchor`` is a condition on ``id``."""
    spark = vectors.sparkSession
    rows, at_rows = common.materialise(cut_rows(vectors, key, label, vector, scale), "negatives-rows")
    common_length = rows.groupBy(F.octet_length("q").alias("bytes")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bytes").first()
    d = common_length.bytes // 4 if common_length else 1
    rows = rows.where(F.octet_length("q") == 4 * d)
    wanted = min(sample, max(1, SAMPLE_BYTES // (4 * d)))
    share = min(1.0, 0.9 * wanted / common_length.n) if common_length else 1.0
    drawn = rows.where(F.pmod(F.xxhash64("id", "q"), F.lit(1 << 20)) < share * (1 << 20)).limit(wanted).toArrow()
    held = (drawn["id"].to_numpy(), drawn["label"].to_numpy(), drawn["q"].to_pylist())
    axes = rotation(_matrix(held[2]) if held[2] else np.empty((0, d), np.int32), d)
    anchors = rows.where(anchor).distinct().withColumn("key", F.monotonically_increasing_id()).select(*ANCHOR)
    anchors, at_anchors = common.materialise(anchors, "negatives-anchors")
    first, at_first = common.materialise(_with_floors(anchors, held, axes, positives), "negatives-floors")
    near, at_near = _found(rows, first, axes, positives, batch_bytes, d, "negatives-near")
    near, at_positives = common.materialise(near.select("key", "rank", "id", "score"), "negatives-positives")
    listed = F.sort_array(F.collect_list(F.struct("rank", (-_percent(-F.col("score"), lower)).alias("low"), _percent(F.col("score"), upper).alias("high"))))
    wide = near.groupBy("key").agg(listed.alias("b"))
    asked = anchors.join(wide, "key").select(*ANCHOR, F.col("b.low").alias("low"), F.col("b.high").alias("high"))
    second, at_second = common.materialise(_with_floors(asked, held, axes, negatives), "negatives-bands")
    hard, at_hard = _found(rows, second, axes, negatives, batch_bytes, d, "negatives-hard")
    named = near.join(anchors.select("key", F.col("id").alias("anchor_id")), "key").select("key", (F.col("rank") - 1).alias("place"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = named.join(hard.select("key", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["key", "place"])
    out, _ = common.materialise(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives-out")
    for path in (at_rows, at_anchors, at_first, *at_near, at_positives, at_second, *at_hard):
        common.remove(spark, path)
    return out


def op11_pca_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.select("vec_id", label.alias("label"), "embedding"), F.col("id") % 50 == 0)


SQL = f"""
WITH own AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM own a JOIN own b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
ranked AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND {LOWER} * positive_score <= 100 * score AND 100 * score <= {UPPER} * positive_score)
SELECT * FROM ranked WHERE rank <= {NEGATIVES}
"""
