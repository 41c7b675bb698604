"""Operator 4: licence scan by sentence rules.

A text is cut into sentences twice, as running text (line ends are spaces) and line by line, since notices are wrapped
in some files and stand alone on a line in others.  A sentence is normalised (lower case, words alone, years and holders
of a copyright left out, holders within a sentence replaced by the words of the known one) and looked up among the known licence sentences; parts that make up a known one together count as
that one.  The sequence of their identifiers, in order of
place, is matched against the rules in order: a rule takes the first place where its identifiers stand one after another
among those no earlier rule has taken, as often as it can.

SPDX tags are read by their names, several of them where they are joined by OR or AND.

Each row gets its licences in order of place, once each (``""``: none).  Licence sentences that no rule takes give
``unknown`` after them.  Null and empty texts have no licence.  Very long texts and sentences are read whole.  Repeated rows
get equal results, and an empty table gives no rows.  Other columns, whatever their names, are returned unchanged.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, licence_table

SENTENCES, RULES, _SPDX = licence_table.build()
SILENT = licence_table.SILENT | {name for name in SENTENCES if name.endswith("-short")}
#: Every known sentence holds one of these (held in the tests): texts without them have no licence sentence.
MARKS = ("licen", "licens", "copyright", "permission", "redistribut", "warrant", "apache", "gpl", "public domain", "cc by", "cc0", "rights reserved", "without restriction", "merchantab", "compliance", "anyone is free", "spdx", " under ", "mpl", "creative commons", "attribution", "illinois", "bsd")
_MARK = re.compile("|".join(MARKS) + r"|\(c\)|©", re.IGNORECASE)
_END = re.compile(r"[.!?;:](?=\s|$)|\n[^\S\n]*\n")
_LINE = re.compile(r"\n|[.!?;](?=\s|$)")
_COPYRIGHT = re.compile(r"\W{0,20}(?:copyright\b|\(c\)|©)", re.IGNORECASE)
_TAG = re.compile(r"SPDX-License-Identifier:[^\S\n]*([^\n*#;]*[^\s*#;/\-])", re.IGNORECASE)
_WORD = re.compile(r"\w+(?:[.\-]\w+)*\+?")
_SAME = {"licence": "license", "licences": "licenses", "licenced": "licensed", "https": "http"}


#: Names of holders within a sentence: whoever is named there, the sentence is the one with the words on the right.
_GAP = r"[\s*#/;\-]+"
_HOLDERS = [
    (re.compile(rf"\bneither{_GAP}(?:the{_GAP})?names?{_GAP}of\b.{{1,300}}?\bnor{_GAP}the{_GAP}names{_GAP}of{_GAP}(?:its|their|any|other|the){_GAP}contributors\b", re.IGNORECASE | re.DOTALL), "Neither the name of the copyright holder nor the names of its contributors"),
    (re.compile(rf"\bthe{_GAP}names?{_GAP}of\b.{{1,300}}?\bmay{_GAP}not{_GAP}be{_GAP}used{_GAP}to{_GAP}endorse{_GAP}or{_GAP}promote\b", re.IGNORECASE | re.DOTALL), "The name of the author may not be used to endorse or promote"),
]


def normalise(sentence: str) -> str:
    return " ".join(_SAME.get(w, w) for w in _WORD.findall(sentence.lower()))


KNOWN = {normalise(s): name for name, forms in SENTENCES.items() for s in forms}
#: Beginnings of known sentences by whole words, and their first words: the splitters cut inside of some sentences.
_BEGUN = {" ".join(w[:n]) for w in map(str.split, KNOWN) for n in range(1, len(w) + 1)}
_FIRST = {k.split()[0] for k in KNOWN}


def sentences(text: str, end: re.Pattern) -> list[tuple[int, str]]:
    out, at = [], 0
    for m in end.finditer(text):
        out.append((at, text[at : m.start()]))
        at = m.end()
    out.append((at, text[at:]))
    return out


def _known(parts: list[tuple[int, str]], i: int) -> tuple[str | None, int]:
    """The longest known sentence that the parts from ``i`` on make up together, and the part after it."""
    first = _WORD.search(parts[i][1])
    if not first or _SAME.get(first[0].lower(), first[0].lower()) not in _FIRST:
        return None, i + 1
    name, after, words = None, i + 1, ""
    for j in range(i, len(parts)):
        words = f"{words} {normalise(parts[j][1])}".strip()
        if words not in _BEGUN:
            break
        if words in KNOWN:
            name, after = KNOWN[words], j + 1
    return name, after


def tagged(text: str):
    """(place, identifier) of each licence named by an SPDX tag; one that isn't known is ``spdx-other``."""
    for m in _TAG.finditer(text):
        for w in _WORD.finditer(m[1]):
            if w[0].upper() in ("OR", "AND"):
                continue
            if w[0].upper() == "WITH" or m[1][: w.start()].rstrip().upper().endswith(" WITH"):
                continue  # an exception
            yield m.start(1) + w.start(), _SPDX.get(w[0].lower(), "spdx-other")


def identifiers(text: str | None) -> list[str]:
    """Known sentences in order of place."""
    if not text or not _MARK.search(text):
        return []
    if "endorse" in text.lower():
        for pattern, words in _HOLDERS:
            text = pattern.sub(words, text)
    found: dict[int, str] = dict(tagged(text))
    for end in (_END, _LINE):
        parts, i = sentences(text, end), 0
        while i < len(parts):
            at, s = parts[i]
            place = at + len(s) - len(s.lstrip())
            name, i = _known(parts, i)
            if name is None and _COPYRIGHT.match(s):
                name = "copyright"
                if normalise(s[-40:]).endswith("all rights reserved"):
                    found.setdefault(at + len(s), "reserved")
            if name and not name.startswith("spdx-"):
                found.setdefault(place, name)
    return [found[k] for k in sorted(found)]


def match(names: list[str]) -> list[str]:
    """Licences of a sequence of identifiers, in order of place."""
    free: list[str | None] = list(names)
    found: list[tuple[int, str]] = []
    for licence, wanted in RULES:
        n, i = len(wanted), 0
        while i + n <= len(free):
            if free[i : i + n] == wanted:
                free[i : i + n] = [None] * n
                found.append((i, licence))
                i += n
            else:
                i += 1
    out = list(dict.fromkeys(x for _, licence in sorted(found) for x in licence.split(",")))
    return out + ["unknown"] * any(x and x not in SILENT for x in free)


def scan(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Add ``licences`` and ``licence_sentences``, comma-separated, to every row; names already taken get a ``_`` before."""
    names = [common.fresh_name(docs, x) for x in ("licences", "licence_sentences")]

    def run(batches):
        for part in common.pieces(batches):
            found = [identifiers(t) for t in part[text].to_pylist()]
            licences = pa.array([",".join(match(f)) for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, licences, pa.array([",".join(f) for f in found], pa.string())], names=[*part.schema.names, *names])

    return docs.mapInArrow(run, common.schema_with(docs, f"`{names[0]}` string, `{names[1]}` string"))


def op4_licence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).select("doc_id", "licences", "licence_sentences")
