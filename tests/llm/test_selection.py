"""Hard negatives, importance resampling and line dedup against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import numpy as np
import pytest
from conftest import SF_MID
from fixtures import edge, empty
from pyspark.sql import functions as F

from logmill.llm import common, hard_negatives, importance, line_dedup, queries


@pytest.mark.parametrize("name", ["op11_pca_negatives", "op12_importance_dictionary", "op13_line_bloom"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_MID}/{t}.parquet'")
    got = queries.queries()[name](spark, SF_MID)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and want


# --- hard negatives --------------------------------------------------------------------------------------------


def slow_negatives(rows, step=50):
    cut = {}
    for i, label, v in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            q = tuple(math.floor(256 * x) for x in v)
            if sum(x * x for x in q) < 2**55:
                cut[i, label, q] = None
    lengths = Counter(len(q) for _, _, q in cut)
    d = min(lengths, key=lambda n: (-lengths[n], n), default=0)
    own = [r for r in cut if len(r[2]) == d]
    out = []
    for a in own:
        if a[0] % step:
            continue
        score = lambda r, a=a: sum(x * y for x, y in zip(a[2], r[2], strict=True))
        near = sorted({(-score(r), r[0]) for r in own if r[1] == a[1] and r[0] != a[0]})[:5]
        far = sorted({(-score(r), r[0]) for r in own if r[1] != a[1]})
        for s, p in near:
            fit = [(n, i) for n, i in far if 50 * -s <= 100 * -n <= 95 * -s][:3]
            out += [(a[0], p, k + 1, i, -s, -n) for k, (n, i) in enumerate(fit)]
    return sorted(out)


def mined(df, **more):
    return sorted(map(tuple, hard_negatives.mine(df, F.col("id") % 50 == 0, **more).collect()))


@pytest.mark.parametrize("kind", ["flat", "low_rank", "one_vector"])
def test_negatives_against_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24))
    if kind == "low_rank":
        x = rng.normal(size=(1500, 4)) @ rng.normal(size=(4, 24)) + 0.05 * x
    if kind == "one_vector":  # a third of all rows, so that ties decide
        x[::3] = x[7]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = rng.integers(0, 3, 1500)
    rows = [(i, int(labels[i]), v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(5)
    # several batches of anchors, and hardly a sample
    assert mined(df, batch_bytes=3000, sample=40) == slow_negatives(rows) != []


def test_bounds_never_leave_out_a_pair():
    rng = np.random.default_rng(8)
    q = (rng.normal(size=(300, 16)) * np.geomspace(1, 1e6, 16)).astype(np.int64)
    axes = hard_negatives.rotation(q, 16)
    turned = hard_negatives._turned(q, axes)
    exact = q @ q.T
    low, high = np.quantile(exact, 0.6, axis=1).astype(np.int64), np.quantile(exact, 0.7, axis=1).astype(np.int64)
    i, j = hard_negatives.survivors(turned, turned, low, high, np.ones(exact.shape, bool))
    want = (exact >= low[:, None]) & (exact <= high[:, None])
    found = np.zeros_like(want)
    found[i, j] = True
    assert (found >= want).all() and found.sum() < 0.5 * found.size


def test_negatives_edge_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 2, rng.normal(size=4).tolist()) for i in range(120)]
    rows += [rows[0], rows[3], (3, 1, [0.5, 0.5, 0.1, 0.0]), (50, 1, rows[50][2])]  # repeated, and one id with other rows
    rows += [(200, None, rows[1][2]), (None, 1, rows[1][2]), (250, 1, None), (300, 1, [1.0, None, 0.0, 0.0]), (350, 0, [float("nan")] * 4), (400, 0, [float("inf")] * 4), (450, 1, []), (500, 1, [1.0, 2.0]), (550, 0, [1e300] * 4), (600, 0, [0.0] * 4), (-50, 1, rows[2][2])]
    names = ("id", "key", "q", "place", "rank", "score", "batch", "floor")
    df = spark.createDataFrame([(*r, *["own"] * len(names)) for r in rows], "vec_id long, label int, embedding array<double>, " + ", ".join(f"`{c}` string" for c in names)).repartition(3)
    assert mined(df) == slow_negatives(rows) != []
    assert mined(df.limit(0)) == [] and mined(df.where("vec_id = 250")) == []


# --- importance resampling -------------------------------------------------------------------------------------


def slow_importance(docs, target, order=1, buckets=10_000):
    def found(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return len(words), [" ".join(words[i : i + k]) for k in range(1, order + 1) for i in range(len(words) - k + 1)]

    bucket = lambda f: crc32(f.encode()) % buckets
    own, aimed = (Counter(bucket(f) for t in texts for f in found(t)[1]) for texts in ([t for _, t in docs], target))
    s, t = sum(own.values()), sum(aimed.values())
    gain = {b: math.floor(1000 * math.log((aimed[b] + 1) * (s + buckets) / ((own[b] + 1) * (t + buckets)))) for b in set(own) | set(aimed)}
    rows = []
    for i, text in docs:
        n, f = found(text)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in f)
        rows.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    can = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    for k, r in enumerate(can):
        r.append(k + 1 if k < 10 * len(can) // 100 else None)
    return sorted((tuple(r if len(r) == 6 else [*r, None]) for r in rows), key=repr)


@pytest.mark.parametrize("order", [1, 2])
def test_importance_against_brute_force(spark, order):
    docs, target = (common.table(spark, SF_MID, t) for t in ("documents", "benchmark"))
    rows, aims = [(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()]
    got = importance.resample(docs.repartition(6), target, order=order, block_bytes=100_000)
    assert sorted(map(tuple, got.collect()), key=repr) == slow_importance(rows, aims, order)


def test_importance_edge_rows(spark):
    rows, target = [(r.doc_id, r.text) for r in edge(spark).collect()], spark.createDataFrame([(1, "passage1 passage2 word"), (2, None), (None, "")], "item_id long, text string")
    rows += [(100 + i, "even " * 25) for i in range(30)] + [(100, "even " * 25)]  # ties but for the random numbers
    docs = edge(spark).unionByName(spark.createDataFrame([(i, t) for i, t in rows[14:]], "doc_id long, text string"), allowMissingColumns=True).repartition(4)
    got = sorted(map(tuple, importance.resample(docs, target).collect()), key=repr)
    want = slow_importance(rows, [r.text for r in target.collect()])
    assert got == want and sum(r[5] is not None for r in got) == 3
    assert importance.resample(empty(spark), target).count() == 0
    assert sorted(map(tuple, importance.resample(docs, target.limit(0)).collect()), key=repr) == slow_importance(rows, [])


# --- line dedup ------------------------------------------------------------------------------------------------


def slow_lines(rows, least=10):
    def key(line):
        k = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
        return k if len(k) >= least else None

    first = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if key(line) is not None:
                first[key(line)] = min(first.get(key(line), i), i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) is None or first[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("load", "slices", "range_keys"), [(8, 2, 1000), (8, 1, 100), (1, 3, 2000)])
def test_lines_against_brute_force(spark, load, slices, range_keys):
    docs = common.table(spark, SF_MID, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\n  A Common Line for many\r\nshort\n"))).otherwise(F.col("text")).alias("text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = line_dedup.removals(docs.repartition(4), block_bytes=150_000, load=load, slices=slices, range_keys=range_keys).collect()
    want = slow_lines(rows)
    assert sorted(map(tuple, got)) == want and sum(x[2] for x in want) > 300


LINES = [
    (5, "The same long line\nother\nthe same LONG line \n"),
    (3, "\tthe same long line"),
    (9, "THE SAME LONG LINE\r\nkept as it is, once"),
    (9, "the same long line\nkept as it is, once"),  # equal ids are one document
    (None, "the same long line\nof a row without an id"),
    (None, "of a row without an id"),
    (11, "ääääääääää\nßßßßßßßßß\nÄÄÄÄÄÄÄÄÄÄ"),
    (12, "ääääääääää\nßßßßßßßßß\nÄÄÄÄÄÄÄÄÄÄ"),
    (13, "123456789\n1234567890"),
    (14, "123456789\n1234567890\n\n\n"),
    (15, None),
    (16, ""),
    (17, "x" * 300_000 + "\n" + "line after line\n" * 5000),
    (18, "line after line"),
    (19, "a b c d e f g\x0b\x0c"),
    (20, "a b c d e f g"),
]


def test_line_edge_rows(spark):
    names = ("k", "block", "place", "first", "found", "digest", "n_lines")
    df = spark.createDataFrame([(*r, len(r[1] or ""), *["own"] * len(names)) for r in LINES], "doc_id long, text string, n_chars long, " + ", ".join(f"`{c}` string" for c in names)).repartition(4)
    last = 2**63 - 1
    got = sorted((last if r.doc_id is None else r.doc_id, *r[1:]) for r in line_dedup.removals(df, block_bytes=50).collect())
    assert got == slow_lines([(last if i is None else i, t) for i, t in LINES])
    by = defaultdict(list)
    for r in line_dedup.deduplicate(df).collect():
        by[r.doc_id].append(r)
        assert r.n_chars == len(r.text or "") and r.found == "own"
    assert by[5][0].text == "other\n" and by[9][0].text == "kept as it is, once" and 18 not in by and 20 not in by and by[12][0].text == "ßßßßßßßßß" and by[15][0].text is None
    assert line_dedup.removals(df.limit(0)).count() == 0 and line_dedup.deduplicate(df).columns == df.columns
    sixteen = line_dedup.removals(edge(spark))
    assert sixteen.count() == 14 and line_dedup.removals(empty(spark)).count() == 0
