"""Header stripping, masks and fingerprints as Column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Header patterns and, in order, the masks with their replacements.
HEADER_BSD = r"[A-Za-z]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}"
HEADER_ISO = r"(?:<\d{1,3}>\d?\s+)?\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?"
TAG = r"\s+\S+\s+[^\s:]+(?:\[\d+\])?:\s*"
PROGRAM_TAG = r"\s+\S+\s+([A-Za-z0-9_.\-]+?)(?:\[\d+\])?:\s"
OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
MASKS: list[tuple[str, str, str]] = [
    ("uuid", r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<UUID>"),
    ("ip4", rf"\b(?:{OCTET}\.){{3}}{OCTET}\b", "<IP4>"),
    ("ip6", r"(?i)(?:\b(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}\b|\b(?:[0-9a-f]{1,4}:)+:(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?|::[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)", "<IP6>"),
    ("fpr", r"SHA256:[A-Za-z0-9+/=]{20,}", "SHA256:<FPR>"),
    ("addr", r"\[<[0-9a-f]{8,16}>\]", "[<ADDR>]"),
    ("cid", r"(?i)\bdocker-[0-9a-f]{12,64}\b", "<CID>"),
    ("veth", r"(?i)\bveth[0-9a-f]{6,}\b", "<VETH>"),
    ("br", r"(?i)\bbr-[0-9a-f]{12}\b", "<BR>"),
    ("mnt", r"(?i)\b(?:overlay2|buildkit-executor|buildkit|runc|netns)[-/][0-9a-z]{8,}", "<MNT>"),
    ("mac", r"(?i)\b[0-9a-f]{2}(?::[0-9a-f]{2}){5}\b", "<HEX>"),
    ("path", r"(?:/[a-zA-Z0-9_@.+-]+){2,}", "<PATH>"),
    ("dev", r"\b(?:sd[a-z]\d*|nvme\d+n\d+(?:p\d+)?|vd[a-z]\d*|hd[a-z]\d*|loop\d+)\b", "<DEV>"),
    ("hex", r"(?i)\b0x[0-9a-f]{4,}\b", "<HEX>"),
    ("num", r"\b\d+\b", "<NUM>"),
]
PATTERN = {name: (pattern, mask) for name, pattern, mask in MASKS}


def _flag(pattern: str, unicode: bool) -> str:
    return f"(?U){pattern}" if unicode else pattern


def _by_text(text: Column, unicode: bool | None, use) -> Column:
    """``use(unicode)``; where it is None, the Unicode form for texts that aren't ASCII and the faster one, which gives the same, for others."""
    if unicode is not None:
        return use(unicode)
    return F.when(F.octet_length(text) == F.length(text), use(False)).otherwise(use(True))


def raw_message(journal: Column, file: Column) -> Column:
    """The journal's text, else the file's, else empty."""
    return F.coalesce(journal, file, F.lit(""))


def strip_prefix(text: Column, unicode: bool | None = None) -> Column:
    """Without the syslog header, of either kind, once."""
    return _by_text(text, unicode, lambda u: F.regexp_replace(text, _flag(f"^(?:{HEADER_BSD}{TAG}|{HEADER_ISO}{TAG})", u), ""))


def syslog_program(text: Column, unicode: bool | None = None) -> Column:
    """The program of the header, null without one."""
    return F.nullif(_by_text(text, unicode, lambda u: F.regexp_extract(text, _flag(f"^(?:{HEADER_BSD}|{HEADER_ISO}){PROGRAM_TAG}", u), 1)), F.lit(""))


def mask(text: Column, name: str, unicode: bool = False) -> Column:
    """One of T3 to T16."""
    pattern, put = PATTERN[name]
    return F.regexp_replace(text, _flag(pattern, unicode), put)


#: What a text must have, in lower case, for a mask to match.
_NEEDS = {
    "uuid": ["-"],
    "fpr": ["sha256:"],
    "addr": ["[<"],
    "cid": ["docker-"],
    "veth": ["veth"],
    "br": ["br-"],
    "mnt": ["overlay2", "buildkit", "runc", "netns"],
    "path": ["/"],
    "dev": ["sd", "nvme", "vd", "hd", "loop"],
    "hex": ["0x"],
}


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it and wherever a filter copies it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def bound(df: DataFrame, **values: Column) -> DataFrame:
    """Add columns that are computed once for each row: the optimizer copies no generated column into what reads it, nor moves a filter below it."""
    for name, value in values.items():
        df = df.select("*", F.explode(F.array(value)).alias(name))
    return df


def _needed(name: str, text: Column, low: Column) -> Column | None:
    """A cheap test that every text passes which the mask matches."""
    if name == "ip4":
        return F.contains(low, F.lit(".")) & text.rlike(r"\d\.\d")
    if name == "ip6":  # a pair of colons, or seven of them
        return F.contains(low, F.lit("::")) | (F.substring_index(low, ":", 7) != low)
    if name == "mac":
        return F.substring_index(low, ":", 5) != low
    needs = [F.contains(low, F.lit(x)) for x in _NEEDS.get(name, [])]
    return reduce(or_, needs) if needs else None


def normalize(text: Column, unicode: bool | None = None) -> Column:
    """All masks in order, each only if it matches the text as it came.

    The text, its lower case and the state between masks run through one-element arrays, so that each is computed once,
    however often a step names it.
    """

    def all_masks(t: Column) -> Column:
        return _by_text(t, unicode, lambda u: masked(t, u))

    def masked(t: Column, unicode: bool) -> Column:
        def with_low(low: Column) -> Column:
            state = F.array(t)
            for name, pattern, put in MASKS:
                state = F.transform(state, _step(t, _needed(name, t, low), _flag(pattern, unicode), put))
            return F.element_at(state, 1)

        return once(F.lower(t), with_low)

    return once(text, all_masks)


def _step(text: Column, needed: Column | None, pattern: str, put: str):
    def step(state: Column) -> Column:
        # a state that is the text as it came needs no gate: where nothing matches nothing is replaced
        test = (state == text) | text.rlike(pattern)
        return F.when(test if needed is None else needed & test, F.regexp_replace(state, pattern, put)).otherwise(state)

    return step


def pattern_key(template: Column, severity: Column, source: Column) -> Column:
    return F.concat_ws("|", template, severity, source)


def pattern_id(template: Column, severity: Column, source: Column) -> Column:
    """A JVM-side identity of a pattern, beside the fingerprint."""
    return F.substring(F.md5(pattern_key(template, severity, source)), 1, 16)


@F.pandas_udf(T.StringType())
def xxh3(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import xxhash

    for s in keys:
        yield s.map(lambda x: None if x is None else xxhash.xxh3_64_hexdigest(x))


def fingerprint(template: Column, severity: Column, source: Column) -> Column:
    """XXH3-64 of template|severity|source in 16 hex digits; Spark's own xxhash64 is another hash."""
    return xxh3(pattern_key(template, severity, source))
