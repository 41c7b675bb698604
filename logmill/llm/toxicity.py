"""Operator 3: toxicity by a weighted lexicon.

Texts are folded: case, accents, look-alike letters of other scripts and digits that stand for letters come to one
alphabet; what else there is separates words.  Lexicon entries (whole words or word beginnings) and exception phrases
are found in one Aho-Corasick pass; an entry within an exception phrase doesn't count.  The weights found, alone and by
length, give a probability by logistic regression.

The lexicon is learned from labelled rows outside the held-out fold: entries that mark label 1 with precision
``PRECISION`` or more are taken, greedily, while each explains enough label-1 rows that no other entry does.  Rows that
share their least word-shingle hash count once, so that copies carry no weight of their own.

Null and empty texts get the score of a text without entries, very long ones are read whole.  Where nothing could be
learned every score is 0.  Repeated rows get equal scores, and an empty table gives no rows.  Other columns, whatever their
names, are returned unchanged.  The texts to learn from, ``most_toxic`` and ``most_other`` of them, come to the driver.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PRECISION = 0.75
#: Probability that any of the candidates is in so many label-1 rows, and no others, by chance.
CHANCE = 0.05
THRESHOLD = 0.3

# Letters of other scripts that look like Latin ones, and signs that stand for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ø": "o", "ł": "l", "đ": "d", "ħ": "h",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
#: Only before a letter or digit, and for "!" after one as well.
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}
#: One letter for those that a "1" or "|" can stand for.
MERGED = {"l": "i"}

_TOP = 0x20000


@cache
def _table() -> np.ndarray:
    """Code point to its folded one; 32 separates words, 0 is left out."""
    out = np.full(_TOP, 32, np.uint32)
    for c in range(_TOP):
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        kind = unicodedata.category(x)
        if kind in ("Mn", "Me", "Cf"):
            out[c] = 0
        elif x.isalnum():
            base = next((y for y in unicodedata.normalize("NFKD", x.lower()) if not unicodedata.combining(y)), x.lower())[0]
            base = LOOK_ALIKES.get(base, DIGITS.get(base, base))
            out[c] = ord(MERGED.get(base, base))
    return out


def fold(text: str | None) -> str:
    """Folded words with one space before, between and after them."""
    points = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
    table = _table()
    out = np.where(points < _TOP, table[np.minimum(points, _TOP - 1)], points)
    if len(points):
        word = out != 32
        after = np.append(word[1:], False)
        before = np.insert(word[:-1], 0, False)
        for sign, letter in SIGNS.items():
            at = (points == ord(sign)) & after
            if sign in "!|":
                at &= before
            out[at] = ord(letter)
    out = np.concatenate(([32], out[out != 0], [32])).astype(np.uint32)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    return out[keep].tobytes().decode("utf-32-le")


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)  # " word " or " beginning"
    exceptions: tuple[str, ...] = ()  # " some words "
    coefficients: tuple[float, float, float] | None = None

    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        for p, w in self.weights.items():
            out.add_word(p, (len(p), w, p in self.exceptions))
        for p in self.exceptions:
            if p not in self.weights:
                out.add_word(p, (len(p), 0.0, True))
        if len(out):
            out.make_automaton()
        return out

    def features(self, folded: str, automaton) -> tuple[float, float, int]:
        """Total weight, weight by length, and the number of entries found."""
        hits, spans = [], []
        if len(automaton):
            for end, (n, w, exempt) in automaton.iter(folded):
                if exempt:
                    spans.append((end - n + 1, end))
                if w:
                    hits.append((end - n + 1, end, w))
        if spans:
            hits = [h for h in hits if not any(a <= h[0] and h[1] <= z for a, z in spans)]
        total = sum(w for *_, w in hits)
        words = folded.count(" ") - 1
        return math.log1p(total), math.log1p(100 * total / (words + 20)), len(hits)

    def score(self, x: tuple[float, float]) -> float:
        if self.coefficients is None:
            return 0.0
        a, b, c = self.coefficients
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x[0] + c * x[1]))))


#: Marks a feature that asks for an entry twice in a text.
_TWICE = "\0"


def _entries(words: list[str]) -> set[str]:
    """Entries of a text, and those that it has twice or more."""
    out: Counter = Counter()
    for w, n in Counter(words).items():
        for e in (f" {w} ", *(f" {w[:k]}" for k in range(3, min(8, len(w)) + 1))):
            out[e] += n
    return set(out) | {e + _TWICE for e, n in out.items() if n > 1}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> np.ndarray:
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (a.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(rows: list[tuple[str, int]], precision: float = PRECISION) -> Lexicon:
    """From folded texts with labels."""
    once: dict[tuple[int, int], tuple[str, int]] = {}
    for t, y in sorted(rows):
        w = t.split()
        least = min((xxhash.xxh64_intdigest(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))), default=0)
        once.setdefault((y, least), (t, y))
    rows = list(once.values())
    toxic, other = [t for t, y in rows if y], [t for t, y in rows if not y]
    if not toxic or not other:
        return Lexicon()
    n_toxic: Counter = Counter()
    for t in toxic:
        n_toxic.update(_entries(t.split()))
    support = max(2, math.ceil(0.002 * len(toxic)))
    candidates = {e for e, n in n_toxic.items() if n >= support}
    n_other: Counter = Counter()
    for t in other:
        n_other.update(_entries(t.split()) & candidates)
    share = {e: n_toxic[e] / (n_toxic[e] + n_other[e]) for e in candidates}
    good = {e for e in candidates if share[e] >= precision and n_toxic[e] / len(toxic) > 4 * n_other[e] / len(other)}
    where: dict[str, set[int]] = defaultdict(set)
    for i, t in enumerate(toxic):
        for e in _entries(t.split()) & good:
            where[e].add(i)
    left = set(range(len(toxic)))
    # so many rows that none of the candidates is likely to be in as many label-1 rows alone by chance
    gain = max(support, math.ceil(math.log(CHANCE / max(1, len(candidates))) / math.log(len(toxic) / len(rows))))
    order, taken = sorted(where), []
    # each label-0 row that has a feature weighs as much as three that it explains
    worth = lambda e: (len(where[e] & left) - 3 * n_other[e], share[e], -len(e), e)
    while left and order:
        best = max(order, key=worth)
        if len(where[best] & left) < gain or worth(best)[0] <= 0:
            break
        taken.append(best)
        left -= where[best]
        order = [e for e in order if len(where[e] & left) >= gain]
    # features as frequent as the least of these, and nearly as precise as can be, that stand beside them in the same texts
    least = min((len(where[e]) for e in taken), default=len(toxic) + 1)
    for e in sorted(where, key=lambda e: (-len(where[e]), len(e), e)):
        if len(where[e]) >= max(least, 0.01 * len(toxic)) and share[e] >= 0.97 and not any(e.startswith(x.strip(_TWICE)) or x.startswith(e.strip(_TWICE)) for x in taken):
            taken.append(e)
    taken = list(dict.fromkeys(e.strip(_TWICE) for e in taken))
    weights = {e: math.log(((n_toxic[e] + 0.5) / (len(toxic) + 1)) / ((n_other[e] + 0.5) / (len(other) + 1))) for e in taken}
    weights = {e: w for e, w in weights.items() if w > 0}
    lexicon = Lexicon(weights)
    automaton = lexicon.automaton()

    def phrases(t: str) -> Counter:
        out: Counter = Counter()
        for end, (n, _, _) in automaton.iter(t) if weights else ():
            a = end - n + 1
            z = t.index(" ", end if t[end] == " " and end > a else end)
            after, before = t.find(" ", z + 1), t.rfind(" ", 0, a)
            if after > 0:
                out[t[a : after + 1]] += 1
            if before >= 0:
                out[t[before : z + 1]] += 1
        return out

    fine: Counter = Counter()
    for t in other:
        fine.update(set(phrases(t)))
    bad = {p for t in toxic for p in phrases(t)} if fine else set()
    lexicon = Lexicon(weights, tuple(sorted(p for p, n in fine.items() if n >= 3 and p not in bad)))
    automaton = lexicon.automaton()
    x = np.array([lexicon.features(t, automaton)[:2] for t in toxic + other])
    y = np.array([1.0] * len(toxic) + [0.0] * len(other))
    lexicon.coefficients = tuple(_logistic(x, y))
    return lexicon


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "toxic", most_toxic: int = 3000, most_other: int = 6000) -> Lexicon:
    """Learn from about ``most_toxic`` and ``most_other`` rows, chosen by a hash of the key, where there are more."""
    marked = labels.select(F.col(key).alias("j"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~common.held_out("j")).groupBy("j").agg(F.max("y").alias("y"))
    sizes = {r.y: r.n for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = {y: min(1.0, most / sizes[y]) if sizes.get(y) else 0.0 for y, most in ((1, most_toxic), (0, most_other))}
    bound = F.when(F.col("y") == 1, F.lit(share[1])).otherwise(F.lit(share[0])) * 1_000_000
    picked = marked.where(F.pmod(F.xxhash64("j"), F.lit(1_000_000)) < bound)
    # at most about most_toxic + most_other keys
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(picked), F.col("k") == F.col("j")).where("t is not null").select("t", "y")

    def run(batches):
        for part in common.pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array([fold(t) for t in part["t"].to_pylist()], pa.string()), part["y"]], names=["t", "y"])

    return learn([(r.t, r.y) for r in rows.mapInArrow(run, "t string, y int").collect()])


def score(docs: DataFrame, lexicon: Lexicon, *, text: str = "text") -> DataFrame:
    """Add ``toxicity`` (0 to 1) and ``toxic_entries`` to every row; names already taken get a ``_`` before."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    names = [common.fresh_name(docs, x) for x in ("toxicity", "toxic_entries")]

    def run(batches):
        own, automaton = shared.value, shared.value.automaton()
        for part in common.pieces(batches):
            x = [own.features(fold(t), automaton) for t in part[text].to_pylist()]
            scores = pa.array([own.score(v) for v in x], pa.float64())
            yield pa.RecordBatch.from_arrays([*part.columns, scores, pa.array([v[2] for v in x], pa.int64())], names=[*part.schema.names, *names])

    return docs.mapInArrow(run, common.schema_with(docs, f"`{names[0]}` double, `{names[1]}` long"))


def op3_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return found.select("doc_id", common.held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"), "toxic_entries")
