"""SimHash, embeddings, substrings, components and the pipeline against brute force."""

import hashlib
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from conftest import SF, SF_MID
from fixtures import edge, empty

from logmill.llm import common, components, embedding_dedup, queries, simhash, substring_dedup


def union(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["random", "chain", "star"])
def test_components(spark, kind):
    rng = np.random.default_rng(5)
    edges = {"random": [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))], "chain": [(i, i + 1) for i in range(200)], "star": [(7, i) for i in range(500)]}[kind]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(4)).collect()}
    want = union({x for e in edges for x in e}, edges)
    assert all(got.get(n, n) == r for n, r in want.items())


def test_no_components_without_edges(spark):
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert components.connected_components(spark.createDataFrame([(3, 3)], "u long, v long")).count() == 0


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def check_simhash(rows, got):
    prints = {i: slow_fingerprint(t) for i, t in rows}
    pairs = [(a, b) for a, b in combinations(sorted(prints), 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = union(prints, pairs)
    assert got == {i: (f"{f:016x}", want[i]) for i, f in prints.items()}


def test_simhash_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in common.table(spark, SF_MID, "documents").collect()]
    check_simhash(rows, {r.doc_id: (r.fingerprint, r.component_id) for r in queries.queries()["op6_covering_simhash"](spark, SF_MID).collect()})


def test_masks_cover_every_pair_within_the_radius():
    found = simhash.masks()
    assert len(found) == 7 and all(30 <= m.bit_count() <= 40 for m in found)
    for a, b in combinations(range(64), 2):
        assert any(not m >> a & 1 and not m >> b & 1 for m in found)


def test_links_in_small_and_large_buckets(spark):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(0, 2**63, 30)]
    prints = set(base)
    for f in base[:10]:
        for _ in range(6):
            f ^= 1 << int(rng.integers(64))
            prints.add(f)
    low = [i for i in range(64) if not simhash.masks()[0] >> i & 1]
    for _ in range(400):  # one bucket of the first table
        f = base[0]
        for i in rng.choice(low, int(rng.integers(1, 9)), replace=False):
            f ^= 1 << int(i)
        prints.add(f)
    signed = {int(np.uint64(f).view(np.int64)): f for f in prints}
    links = [(r.u, r.v) for r in simhash.links(spark.createDataFrame([(s,) for s in signed], "f long")).collect()]
    want = union(signed, [(a, b) for a, b in combinations(signed, 2) if (signed[a] ^ signed[b]).bit_count() <= 2])
    assert union(signed, links) == want


def test_simhash_edge_rows(spark):
    got = simhash.near_duplicates(edge(spark)).collect()
    assert len(got) == 14
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.fingerprint, r.component_id))
    assert by[2] == by[3] == by[4] == {(0, 2)} and len(by[7]) == 1 and {c for _, c in by[12]} == {6}
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.keep_one(edge(spark))
    assert kept.columns == edge(spark).columns and {2} == {r.doc_id for r in kept.collect()} & {2, 3, 4, 12}


def check_vectors(rows, got, threshold=0.9):
    units = {i: embedding_dedup.usable(v) for i, v in rows}
    pairs = [(a, b) for a, b in combinations(sorted(units), 2) if units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold]
    n, root = defaultdict(int), union(units, pairs)
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    assert got == {i: (n[i], root[i], root[i] == i) for i in units}


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(250, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    for i in range(250, 700):
        v = base[int(rng.integers(0, 250))]
        v = v * 2 if i % 9 == 0 else v + rng.normal(size=32) * rng.choice([0, 0.1, 0.25, 0.4])
        rows.append((i, v.tolist()))
    rows += [(700, None), (701, [0.0] * 32), (702, [float("nan")] * 32), (703, [1.0, None]), (704, []), (705, [1.0, 2.0]), (706, [2.0, 4.0]), (707, [float("inf")] * 32)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, block_bytes=64 * 32 * 8).collect()}
    check_vectors(rows, got)


def test_embedding_query(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in common.table(spark, SF, "embeddings").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.queries()["op8_embedding_cells"](spark, SF).collect()}
    check_vectors(rows, got)


def test_recall_over_many_cells(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(3000, 64))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.45])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = int(((x @ x.T) >= 0.9).sum() - len(x))
    monkeypatch.setattr(embedding_dedup.fit, "__defaults__", (16384, 120, 4096))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = embedding_dedup.near_duplicates(df).agg({"n_links": "sum"}).first()[0]
    assert 0.95 * want <= got <= want


def test_vectors_repeated_ids_no_ids_and_clashing_columns(spark):
    near = [1.0, 0.0, 0.1]
    rows = [(5, [1.0, 0.0, 0.0]), (5, [1.0, 0.0, 0.0]), (3, near), (None, near), (None, [0.0, 1.0, 0.0]), (9, [0.0, 0.0, -1.0]), (9, [0.0, 0.0, -2.0]), (None, None), (4, [-0.0, 0.0, -1.0])]
    names = ("id", "n", "raw", "digest", "own", "probes", "cell", "k", "kept", "n_links")
    df = spark.createDataFrame([(*r, *["own"] * len(names)) for r in rows], "vec_id long, embedding array<float>, " + ", ".join(f"`{c}` string" for c in names))
    got = sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()), key=str)
    want = [(5, 3, 3, False), (5, 3, 3, False), (3, 3, 3, True), (None, 3, 3, True), (None, 0, None, True), (9, 2, 4, False), (9, 2, 4, False), (None, 0, None, True), (4, 2, 4, True)]
    assert got == sorted(want, key=str)


def test_floats_are_compared_in_double_precision(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[200:] = x[:200] + rng.normal(size=(200, 16)).astype(np.float32) * np.float32(0.45)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    check_vectors(rows, {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()})


def test_no_vectors(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def slow_removals(rows, window=13):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words, strict=True):
        for a in range(len(w) - window + 1):
            k = tuple(w[a : a + window])
            least[k] = min(least.get(k, i), i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for a in range(len(w) - window + 1):
            if least[tuple(w[a : a + window])] < i:
                gone.update(range(a, a + window))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("depth", [1, 2])
def test_substrings_against_brute_force(spark, depth):
    docs = common.table(spark, SF_MID, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = substring_dedup.removals(docs, block_bytes=150_000, depth=depth).collect()
    want = slow_removals(rows)
    assert sum(x[2] for x in want) > 0 and sorted(map(tuple, got)) == want


def test_substring_query(spark):
    rows = [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").collect()]
    assert sorted(map(tuple, queries.queries()["op9_substring_dedup"](spark, SF).collect())) == slow_removals(rows)


def test_substring_edge_rows(spark):
    rows = [(2**63 - 1 if r.doc_id is None else r.doc_id, r.text) for r in edge(spark).collect()]
    got = sorted((2**63 - 1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removals(edge(spark).repartition(3)).collect())
    assert got == slow_removals(rows)
    assert substring_dedup.removals(empty(spark)).count() == 0
    kept = {r.doc_id: r for r in substring_dedup.deduplicate(edge(spark)).collect()}
    assert 12 not in kept and kept[6].text.startswith("passage0") and kept[7].text == "lead in and out again" and kept[7].n_chars == 21 and 2 in kept and 3 in kept


def test_pipeline(spark):
    import corpus_pipeline

    docs = common.table(spark, SF, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept, _ = common.materialise(stage(spark, kept, SF), name)
        assert kept.columns == docs.columns
        if name == "near_dedup":
            left = [(r.doc_id, r.text) for r in kept.collect()]
            prints = [slow_fingerprint(t) for _, t in left]
            assert not any((a ^ b).bit_count() <= 2 for a, b in combinations(prints, 2))
        if name == "substring_dedup":
            want = {x[0]: x for x in slow_removals(left)}
            assert {r.doc_id for r in kept.collect()} == {i for i, x in want.items() if x[1] > x[2] or not x[1]}
    ids = {r.doc_id for r in kept.collect()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == ids and 0.7 * docs.count() < len(ids) < docs.count()
