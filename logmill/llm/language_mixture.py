"""Operator 1: multilingual mixture inference.

A language is a multinomial over hashed letter trigrams (lower case, word ends marked).  For each document
expectation-maximisation estimates the proportions of the languages, and backward elimination drops a language
while the penalised likelihood (log likelihood less half of log n for each language) does not fall.

Null text and text without a letter give ``und`` with score 0 and an empty mixture; so does every text when
nothing could be learned.  Ties go to the language first in alphabetical order.  Repeated rows give equal rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS = 16
SMOOTHING = 0.05
MAX_LANGUAGES = 512


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    prob: np.ndarray  # 2**BITS x languages

    def __len__(self) -> int:
        return len(self.languages)


@cache
def _letters() -> np.ndarray:
    """Code point to lower-case letter, or to a space."""
    out = np.full(0x20000, 32, dtype=np.uint32)
    for c in range(0x20000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            out[c] = ord(chr(c).lower()[0])
    return out


def trigrams(text: str | None) -> np.ndarray:
    """Hashed trigrams that have a letter in the middle; empty for text without letters."""
    if not text:
        return np.empty(0, np.uint32)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    letters = _letters()
    # beyond the table stand the ideographs of the later planes, and from 0x32400 on no letters
    low = np.where(points < len(letters), letters[np.minimum(points, len(letters) - 1)], np.where(points < 0x32400, points, 32))
    low = np.concatenate(([32], low, [32])).astype(np.uint32)
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
    low = low[keep]
    if len(low) < 3:
        return np.empty(0, np.uint32)
    mixed = low[:-2] * np.uint32(0x9E3779B1) ^ low[1:-1] * np.uint32(0x85EBCA77) ^ low[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    return (mixed >> np.uint32(32 - BITS))[low[1:-1] != 32]


def _em(prob: np.ndarray, counts: np.ndarray, start: np.ndarray, rounds: int = 25, tolerance: float = 1e-3):
    total, pi = counts.sum(), start
    for _ in range(rounds):
        mix = prob @ pi
        new = pi * ((counts / mix) @ prob) / total
        moved = np.abs(new - pi).max()
        pi = new
        if moved < tolerance:
            break
    return pi, float(counts @ np.log(prob @ pi))


def infer(model: LanguageModel, text: str | None) -> tuple[np.ndarray, int]:
    """Proportions of all languages (zero for those not selected) and the number of trigrams."""
    out = np.zeros(len(model))
    grams = trigrams(text)
    if not len(grams) or not len(model):
        return out, 0
    ids, counts = np.unique(grams, return_counts=True)
    prob, counts = model.prob[ids], counts.astype(float)
    penalty = 0.5 * np.log(max(counts.sum(), 2.0))
    pi, fit = _em(prob, counts, np.full(len(model), 1 / len(model)))
    chosen = np.flatnonzero(pi > 0)
    while len(chosen) > 1:
        # the language with the least share goes unless the likelihood pays for it
        rest = np.delete(chosen, int(np.argmin(pi[chosen])))
        start = pi[rest] / pi[rest].sum() if pi[rest].sum() > 0 else np.full(len(rest), 1 / len(rest))
        if len(rest) == 1:
            new, got = np.ones(1), float(counts @ np.log(prob[:, rest[0]]))
        else:
            new, got = _em(prob[:, rest], counts, start)
        if got + penalty < fit:
            break
        pi = np.zeros(len(model))
        pi[rest], fit, chosen = new, got, rest
    out[chosen] = pi[chosen] / pi[chosen].sum()
    return out, int(counts.sum())


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", max_docs_per_language: int = 3000) -> LanguageModel:
    """Learn from labelled rows outside the held-out fold.

    A language with more than ``max_docs_per_language`` such rows is learned from about that many, chosen by a
    hash of the key; whole texts are counted.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"), common.held_out(key).alias("h"))
    rows = rows.where(~F.col("h") & F.col("t").isNotNull() & F.col("l").isNotNull())
    sizes = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return LanguageModel((), np.ones((2**BITS, 0)))
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("l") == name, F.lit(min(1.0, max_docs_per_language / n))).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < share * 1_000_000).select("l", "t")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for part in common.pieces(batches):
            for name, t in zip(part["l"].to_pylist(), part["t"].to_pylist(), strict=True):
                sums.setdefault(name, np.zeros(2**BITS, np.int64))
                np.add.at(sums[name], trigrams(t), 1)
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield common.batch_of(l=pa.array([name] * len(at), pa.string()), b=pa.array(at, pa.int32()), n=pa.array(n[at], pa.int64()))

    got = sample.mapInArrow(count, "l string, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas()
    names = tuple(sorted(sizes))
    prob = np.zeros((2**BITS, len(names)))
    for i, name in enumerate(names):
        own = got[got.l == name]
        prob[own.b.to_numpy(), i] = own.n.to_numpy()
    seen = prob.sum(axis=1) > 0
    smooth = prob + SMOOTHING
    prob = smooth / (prob.sum(axis=0) + SMOOTHING * (seen.sum() + 1))
    return LanguageModel(names, prob)


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text", min_share: float | None = None) -> DataFrame:
    """Add ``lang_pred``, ``lang_score`` and ``lang_mixture`` to every row; names already taken get a ``_`` before.

    With ``min_share`` rows are kept instead, columns unchanged, if a language was found that holds such a share; where
    no language could be learned, if they have a letter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [common.fresh_name(docs, x) for x in ("lang_pred", "lang_score", "lang_mixture")]

    def run(batches):
        m = shared.value
        for part in common.pieces(batches):
            pred, score, mixture = [], [], []
            for t in part[text].to_pylist():
                pi, n = infer(m, t)
                best = int(np.argmax(pi)) if n else -1
                pred.append(m.languages[best] if n else "und")
                score.append(min(1.0, float(pi[best])) if n else 0.0)
                mixture.append(",".join(f"{m.languages[i]}:{pi[i]:.3f}" for i in np.argsort(-pi, kind="stable") if pi[i] > 0))
            if min_share is not None:
                keep = [p != "und" and s >= min_share for p, s in zip(pred, score, strict=True)] if len(m) else [len(trigrams(t)) > 0 for t in part[text].to_pylist()]
                yield part.filter(pa.array(keep, pa.bool_()))
                continue
            columns = [*part.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mixture, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *names])

    extra = "" if min_share is not None else f"`{names[0]}` string, `{names[1]}` double, `{names[2]}` string"
    return docs.mapInArrow(run, common.schema_with(docs, extra))


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", common.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_mixture").alias("mixture"))
