"""Near copies of five-word similarity 0.8 or more against brute force."""

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from conftest import SF_MID
from fixtures import edge, empty
from test_duplicates import union

from logmill.llm import common, near_copies, simhash


def slow_pairs(rows):
    """Pairs of ids whose shingle sets have a Jaccard similarity of 0.8 or more."""
    sets, where, both = {}, defaultdict(list), Counter()
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[a : a + 5]) for a in range(len(w) - 4)} or {tuple(w)}
        for s in sets[i]:
            both.update((j, i) for j in where[s])
            where[s].append(i)
    return [(a, b) for (a, b), n in both.items() if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n)]


def check(spark, rows):
    prints = {i: simhash.fingerprint(t) for i, t in rows}
    near = [(a, b) for a, b in combinations(sorted(prints), 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = union({i for i, _ in rows}, [*slow_pairs(rows), *near])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in near_copies.near_duplicates(docs).collect()} == want
    return want


def edited(rng, words, n):
    words = list(words)
    for at in rng.choice(len(words), n, replace=False):
        words[at] = f"new{rng.integers(10**9)}"
    return " ".join(words)


def test_near_copies_with_edited_words(spark):
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        rows += [(len(rows) + j, edited(rng, words, n)) for j, n in enumerate((0, 1, 2, 3, 4, 5, 9, 40))]
    assert len(set(check(spark, rows).values())) < 240


@pytest.mark.parametrize("block", [4_000_000, 20_000])
def test_one_large_bucket(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK_BYTES", block)
    rng = np.random.default_rng(3)
    words = [f"w{x}" for x in range(200)]
    check(spark, [(j, edited(rng, words, int(rng.integers(1, 9)))) for j in range(150)])


def test_pipeline_stage_keeps_no_near_copies(spark):
    import corpus_pipeline

    docs = common.table(spark, SF_MID, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert slow_pairs(rows)
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SF_MID).collect()}
    assert not slow_pairs([x for x in rows if x[0] in kept])


def test_near_copies_edge_rows(spark):
    got = {r.doc_id for r in near_copies.keep_one(edge(spark)).collect()}
    assert {2, 6, 13} <= got and not {3, 4} & got  # texts without words are one class
    kept = near_copies.keep_one(edge(spark))
    assert kept.columns == edge(spark).columns and 12 not in {r.doc_id for r in kept.collect()}
    assert near_copies.keep_one(empty(spark)).count() == 0
