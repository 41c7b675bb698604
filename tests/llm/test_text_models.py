"""Language mixture, toxicity, licences, decontamination."""

import time

import numpy as np
import pytest
from conftest import SF, SF_MID
from fixtures import edge, empty
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logmill.llm import common, decontamination, language_mixture, licences, queries, toxicity


def test_language_on_held_out_documents(spark):
    got = queries.queries()["op1_language_mixture"](spark, SF_MID).join(common.table(spark, SF_MID, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == 1000 and (held.lang_pred == held.lang).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_mixture_finds_both_languages(spark):
    docs = common.table(spark, SF_MID, "documents")
    model = language_mixture.fit(docs)
    texts = {r.lang: r.text for r in docs.where("length(text) between 1500 and 2500").orderBy("doc_id").limit(100).collect()}
    pi, _ = language_mixture.infer(model, texts["en"] + " " + texts["de"])
    got = dict(zip(model.languages, pi, strict=True))
    assert got["en"] > 0.25 and got["de"] > 0.25 and got["en"] + got["de"] > 0.95
    pi, _ = language_mixture.infer(model, texts["fr"])
    assert dict(zip(model.languages, pi, strict=True))["fr"] > 0.95


def test_em_never_lowers_the_likelihood():
    rng = np.random.default_rng(3)
    prob, counts = rng.random((50, 4)) + 1e-3, rng.integers(1, 9, 50).astype(float)
    fits = [language_mixture._em(prob, counts, np.full(4, 0.25), rounds=n, tolerance=0)[1] for n in (0, 1, 2, 5, 20)]
    assert fits == sorted(fits)


def test_language_edge_rows(spark):
    docs = edge(spark)
    got = language_mixture.identify(docs, language_mixture.fit(docs)).collect()
    assert len(got) == 14
    by = {r.doc_id: r["_lang_pred"] for r in got}
    assert by[2] == by[3] == by[4] == by[5] == "und" and by[1] != "und"
    none = language_mixture.fit(empty(spark))
    assert language_mixture.identify(empty(spark), none).count() == 0
    assert {r["_lang_pred"] for r in language_mixture.identify(docs, none).collect()} == {"und"}
    assert language_mixture.identify(docs, language_mixture.fit(docs), min_share=0.3).columns == docs.columns
    assert {r.doc_id for r in language_mixture.identify(docs, none, min_share=0.3).collect()} == {1, 6, 7, 8, 9, 10, None, 12, 13}
    assert not len(language_mixture.trigrams("\U000e0101 \U0001f600 12")) and len(language_mixture.trigrams("\U00020000"))


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.queries()["op3_toxicity_lexicon"](spark, sf).join(common.table(spark, sf, "labels"), "doc_id").toPandas()
    held = got[got.held_out]
    hit = ((held.predicted == 1) & (held.toxic == 1)).sum()
    assert hit / max(1, held.predicted.sum()) > 0.9 and hit / held.toxic.sum() > 0.85


def test_folding():
    assert toxicity.fold("1D10T") == toxicity.fold("idiot") == toxicity.fold("\u0456d\u0456\u043et") == toxicity.fold("ÍDÍOT")
    assert toxicity.fold("c1own") == toxicity.fold("clown")
    assert toxicity.fold("word$$$ next!!") == " word next "
    assert toxicity.fold("$tupid") == " stupid "
    assert toxicity.fold(None) == toxicity.fold("") == " "


def test_lexicon_learns_words_weights_and_exceptions():
    words = [f"plain{i}" for i in range(200)]
    rng = np.random.default_rng(0)
    some = lambda n: " ".join(rng.choice(words, n))
    rows = [(toxicity.fold(f"{some(20)} clown {some(20)}"), 1) for _ in range(120)] + [(toxicity.fold(some(40)), 0) for _ in range(300)] + [(toxicity.fold(f"{some(20)} clown fish {some(20)}"), 0) for _ in range(8)]
    lexicon = toxicity.learn(rows)
    automaton = lexicon.automaton()
    score = lambda t: lexicon.score(lexicon.features(toxicity.fold(t), automaton)[:2])
    assert score(f"{some(10)} cl0wn {some(10)}") >= 0.3
    assert score(f"{some(10)} clown fish {some(10)}") < 0.3 and score(some(30)) < 0.3 and score("") < 0.3


def test_toxicity_edge_rows(spark):
    docs = edge(spark)
    labels = spark.createDataFrame([(1, 0), (6, 1), (8, None), (9, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == 14 and all(0 <= r["_toxicity"] <= 1 for r in got)
    assert toxicity.score(empty(spark), toxicity.fit(empty(spark), labels)).count() == 0


def test_licence_sentences_have_marks():
    assert all(licences._MARK.search(s) for s in licences.KNOWN if licences.KNOWN[s] not in ("reserved", "copyright") and not licences.KNOWN[s].endswith("-short"))  # short names count after a heading, which has one
    assert {n for _, names in licences.RULES for n in names} <= set(licences.SENTENCES)


def test_licence_rules_in_order():
    mit = "Copyright (c) 2020 Some One\n\n" + "\n\n".join(licences.SENTENCES[k][0] + "." for k in ("mit-grant", "mit-notice", "as-is"))
    assert licences.match(licences.identifiers(mit)) == ["MIT"]
    wrapped = licences.SENTENCES["mit-grant"][0].replace(", ", ",\n  ")
    assert licences.match(licences.identifiers(f"Header\n\n{wrapped}.\n")) == ["MIT"]
    bsd = ". ".join(licences.SENTENCES[k][0] for k in ("bsd-redistribution", "bsd-source", "bsd-binary"))
    assert licences.match(licences.identifiers(bsd + ".")) == ["BSD-2-Clause"]
    assert licences.match(licences.identifiers(bsd + ". " + licences.SENTENCES["bsd-endorse"][0])) == ["BSD-3-Clause"]
    assert licences.match(["gpl-3-name", "mit-name"]) == ["GPL-3.0", "MIT"]
    assert licences.match(["bsd-source"]) == ["unknown"] and licences.match(["copyright"]) == []


def test_licences_against_plain_search(spark):
    got = queries.queries()["op4_licence_sentences"](spark, SF_MID).join(common.table(spark, SF_MID, "documents"), "doc_id").toPandas()
    known = {"GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0."}
    for name, line in known.items():
        there = got.text.str.contains(line, regex=False)
        assert there.sum() > 0 and (got[there].licences.str.split(",").map(lambda x: name in x)).all()
        assert not (got[~there].licences.str.split(",").map(lambda x: name in x)).any()


def test_licences_edge_rows(spark):
    assert {r["_licences"] for r in licences.scan(edge(spark)).collect()} == {""}
    assert licences.scan(empty(spark)).count() == 0


def test_tiling_takes_longest_first_and_reordered_passages():
    item = decontamination.word_hashes(" ".join(f"i{n}" for n in range(30)))
    text = " ".join([*(f"i{n}" for n in range(20, 30)), "x", *(f"i{n}" for n in range(8)), "y", *(f"i{n}" for n in range(5, 20))])
    block = decontamination.Items.of([(1, item)], 5, 0.5)
    assert [(k, n) for k, _, n in block.matches(text, 0.9, 5)] == [(1, 3)]
    doc = decontamination.word_hashes(text)
    seeds = [(p, q) for p in range(len(doc) - 4) for q in range(len(item) - 4) if (doc[p : p + 5] == item[q : q + 5]).all()]
    tiles = decontamination.tile(doc, item, seeds, 5)
    assert [t[2] for t in tiles] == [15, 10, 5] and sum(t[2] for t in tiles) == 30
    assert not block.matches(" ".join(f"i{n}" for n in range(14)), 0.5, 5)


def brute(doc, item, least):
    """Tiles by comparing every pair of places again and again."""
    in_doc, in_item, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for q in range(len(item)):
            for p in range(len(doc)):
                n = 0
                while p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n] and p + n not in in_doc and q + n not in in_item:
                    n += 1
                if n > best[0]:
                    best = (n, q, p)
        n, q, p = best
        if n < least:
            return total
        in_item.update(range(q, q + n))
        in_doc.update(range(p, p + n))
        total += n


@pytest.mark.parametrize("seed", range(8))
def test_tiling_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    item = [f"w{i}" for i in rng.integers(0, 6, 25)]
    doc = [f"w{i}" for i in rng.integers(0, 6, 60)]
    for _ in range(3):
        a, p = rng.integers(0, 15), rng.integers(0, 50)
        doc[p:p] = item[a : a + 9]
    a, b = decontamination.word_hashes(" ".join(doc)), decontamination.word_hashes(" ".join(item))
    seeds = [(p, q) for p in range(len(a) - 2) for q in range(len(b) - 2) if (a[p : p + 3] == b[q : q + 3]).all()]
    assert sum(t[2] for t in decontamination.tile(a, b, seeds, 3, 3)) == brute(doc, item, 3)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 4), st.lists(st.integers(0, 4), max_size=60), st.lists(st.integers(0, 4), min_size=1, max_size=30), st.integers(1, 5))
def test_tiles_without_pairs_are_the_same(kinds, doc, item, width):
    doc, item = (decontamination.word_hashes(" ".join(f"w{i % kinds}" for i in words)) for words in (doc, item))
    n = min(width, len(item))
    a, b = decontamination.running_hash(doc, n), decontamination.running_hash(item, n)
    seeds = [(p, q) for p in range(len(a)) for q in range(len(b)) if a[p] == b[q]]
    assert decontamination.tile_repeats(doc, item, np.flatnonzero(np.isin(a, b)), n) == decontamination.tile(doc, item, seeds, n, n)


def test_a_word_that_repeats_takes_time_by_the_texts_and_not_by_their_product():
    item = "again " * 3000
    block = decontamination.Items.of([(1, decontamination.word_hashes(item))], 5, 0.5)
    began = time.perf_counter()
    assert block.matches("again " * 400_000, 0.5, 5) == [(1, 1.0, 1)]
    assert block.matches("some other words before it " + "again again again again again stop " * 50_000, 0.5, 5) == [(1, 1.0, 600)]
    assert time.perf_counter() - began < 30  # a list of pairs would have 10**9 entries


def every_pair(docs, items, coverage=decontamination.COVERAGE, least=decontamination.MIN_MATCH):
    """Each document against each item, with all their common seeds."""
    words = {k: decontamination.word_hashes(t) for k, t in items}
    out = set()
    for d, text in docs:
        doc = decontamination.word_hashes(text)
        for k, w in words.items():
            if not len(w):
                continue
            n = min(least, len(w))
            at = {}
            for p in range(len(doc) - n + 1):
                at.setdefault(doc[p : p + n].tobytes(), []).append(p)
            seeds = [(p, q) for q in range(len(w) - n + 1) for p in at.get(w[q : q + n].tobytes(), ())]
            tiles = decontamination.tile(doc, w, seeds, n, least)
            if tiles and sum(t[2] for t in tiles) / len(w) >= coverage:
                out.add((d, k, round(sum(t[2] for t in tiles) / len(w), 9), len(tiles)))
    return out


def test_the_query_against_every_pair(spark):
    got = {(r.doc_id, r.item_id, round(r.coverage, 9), r.tiles) for r in queries.queries()["op2_greedy_tiling"](spark, SF).collect()}
    docs = [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").collect()]
    assert got == every_pair(docs, [(r.item_id, r.text) for r in common.table(spark, SF, "benchmark").collect()]) and got


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdef"), max_size=14), min_size=1, max_size=6), st.lists(st.sampled_from("abcdef"), max_size=40), st.sampled_from([0.3, 0.5, 0.8, 1.0]))
def test_shared_seeds_lose_no_item(items, doc, coverage):
    # a common stem makes many windows shared
    items = [(i, " ".join(["s1 s2 s3 s4 s5"] * (i % 3 > 0) + x)) for i, x in enumerate(items)]
    block = decontamination.Items.of([(k, decontamination.word_hashes(t)) for k, t in items], 3, coverage)
    for text in (" ".join(doc), "s1 s2 s3 s4 s5 " + " ".join(doc)):
        got = {(0, k, round(share, 9), n) for k, share, n in block.matches(text, coverage, 3)}
        assert got == every_pair([(0, text)], items, coverage, 3)


def test_a_stem_that_all_items_share_costs_nothing():
    import time

    stem = " ".join(f"stem{i}" for i in range(10))
    text = " ".join([*(f"x{i}" for i in range(95)), stem, *(f"y{i}" for i in range(95))])
    took = {}
    for n in (500, 8000):
        items = [(i, f"{stem} " + " ".join(f"own{i}x{j}" for j in range(20))) for i in range(n)]
        block = decontamination.Items.of([(k, decontamination.word_hashes(t)) for k, t in items], 5, 0.5)
        began = time.process_time()
        for _ in range(20):
            assert block.matches(text, 0.5, 5) == []
        took[n] = time.process_time() - began
        assert [k for k, _, _ in block.matches(text + " " + items[7][1], 0.5, 5)] == [7]
    assert took[8000] < 3 * took[500] + 0.05


def test_decontamination_finds_planted_items(spark):
    docs, items = common.table(spark, SF_MID, "documents"), common.table(spark, SF_MID, "benchmark")
    got = {(r.doc_id, r.item_id) for r in queries.queries()["op2_greedy_tiling"](spark, SF_MID).collect()}
    want = {(r.doc_id, r.item_id) for r in docs.alias("d").join(items.alias("b"), F.expr("contains(d.text, b.text)")).collect()}
    assert want and want <= got and len(got) < 2 * len(want) + 5
    kept = decontamination.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({d for d, _ in got})


def test_decontamination_edge_rows(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "general words that are quite plain and simple"), (4, "a"), (None, "x")], "item_id long, text string")
    got = decontamination.contaminated(edge(spark), items).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= {(1, 3), (13, 4)}
    assert decontamination.contaminated(edge(spark), items.limit(0)).count() == 0
    assert decontamination.contaminated(empty(spark), items).count() == 0
    assert decontamination.clean(edge(spark), items).count() == 12
