"""Field extraction: regular expressions, logfmt, JSON.  Values are JSON-encoded in a map<string,string>."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logmill.functions.normalize import once

# Fixed values: (pattern, key, numeric) in order, and the keys taken from logfmt and JSON.
EXTRACTORS = [
    (r"[Kk]illed process (\d+)", "pid", True),
    (r"for (?:invalid )?user ([^\s(]+)", "user", False),
    (r"\bdev (\S+?)(?:[,\s]|$)", "dev", False),
    (r"^(\S+\.(?:service|socket|mount|target|timer))\b", "unit", False),
    (r"\bpid=(\d+)", "pid", True),
    (r"\buser=(\S+)", "user", False),
]
ALLOW = ["site", "code", "duration", "latency", "status", "method", "path", "port", "elapsed", "bytes", "count", "error", "level", "logger", "thread"]
MOST = 20
LOGFMT = r'\b([A-Za-z_][A-Za-z0-9_.\-]*)=(?:"([^"]*)"|(\S+))'
INTEGER = r"^[+-]?[0-9]+$"
DECIMAL = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def regex_field(text: Column, key: str, extractors=None) -> Column:
    """The first rule of a key that gives a value; a numeric one that is no integer gives none."""
    found = []
    for pattern, name, numeric in extractors or EXTRACTORS:
        if name == key:
            got = F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))
            found.append(got.try_cast("bigint").cast("string") if numeric else got)
    return F.coalesce(*found)


def regex_fields(text: Column, extractors=None) -> Column:
    """E1 and E2 as a map of JSON values."""
    rules = extractors or EXTRACTORS
    numeric = {key for _, key, n in rules if n}
    entries = [F.struct(F.lit(k).alias("key"), (regex_field(text, k, rules) if k in numeric else quoted(regex_field(text, k, rules))).alias("value")) for k in dict.fromkeys(k for _, k, _ in rules)]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def quoted(text: Column) -> Column:
    """A JSON string, null for null."""
    return once(text, lambda t: F.when(t.isNotNull(), F.regexp_extract(F.to_json(F.struct(t.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)))


def typed(text: Column) -> Column:
    """A 64-bit integer, else a finite number, else a string, in JSON."""
    number = F.when(text.rlike(INTEGER), text.try_cast("bigint").cast("string"))
    real = F.when(text.rlike(DECIMAL), text.try_cast("double"))
    finite = F.when(F.abs(real) < float("inf"), real.cast("string"))
    return F.coalesce(number, finite, quoted(text))


def logfmt_pairs(text: Column, allow: list[str] | None = None) -> Column:
    """(key, value) of each key, the first one of each, in order; a text without ``=`` has none."""
    keys, quotes, plain = (F.regexp_extract_all(text, F.lit(LOGFMT), F.lit(i)) for i in (1, 2, 3))
    pairs = F.zip_with(F.arrays_zip(keys.alias("k"), quotes.alias("q")), plain, lambda a, p: F.struct(a["k"].alias("key"), F.when(p != "", p).otherwise(a["q"]).alias("value")))
    if allow:
        pairs = F.filter(pairs, lambda e: e["key"].isin(allow))
    first = F.aggregate(pairs, F.array().cast("array<struct<key:string,value:string>>"), lambda acc, e: F.when(F.exists(acc, lambda x: x["key"] == e["key"]), acc).otherwise(F.concat(acc, F.array(e))))
    return F.when(F.contains(text, F.lit("=")), first).otherwise(F.array().cast("array<struct<key:string,value:string>>"))


def first_object(text: str | None) -> str | None:
    """The first balanced {...}, strings and escapes heeded."""
    if not text or (start := text.find("{")) < 0:
        return None
    depth, inside, escaped = 0, False, False
    for i in range(start, len(text)):
        c = text[i]
        if inside:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


def _finite(number: str) -> float:
    if abs(value := float(number)) == float("inf"):
        raise ValueError(number)
    return value


def _no_constant(name: str) -> None:
    raise ValueError(name)


def json_scalars(text: str | None) -> dict[str, str] | None:
    """Top-level scalars of that object in order of the key; None if it is no object, or has a number that JSON can't."""
    part = first_object(text)
    try:
        found = json.loads(part, parse_float=_finite, parse_constant=_no_constant) if part else None
    except ValueError:
        return None
    if not isinstance(found, dict):
        return None
    return {k: json.dumps(v, ensure_ascii=False) for k, v in sorted(found.items()) if isinstance(v, (str, int, float, bool))}


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def json_fields(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """E4 and E8 over batches; only texts with a ``{`` should come here."""
    for s in texts:
        yield s.map(json_scalars)


def all_fields(text: Column, allow: list[str] | None = None, most: int = MOST) -> Column:
    """Rule fields, then logfmt and JSON ones that are allowed and new, together at most ``most``.

    Many steps read the text, which should be a column of its own; what each extractor finds is computed once.
    """
    allow = ALLOW if allow is None else allow
    pairs = F.transform(logfmt_pairs(text, allow), lambda e: F.struct(e["key"].alias("key"), typed(e["value"]).alias("value")))
    scalars = F.when(F.contains(text, F.lit("{")), json_fields(text))
    found = F.struct(regex_fields(text).alias("rules"), pairs.alias("pairs"), F.map_entries(F.coalesce(scalars, F.create_map().cast("map<string,string>"))).alias("scalars"))

    def together(x: Column) -> Column:
        known = F.map_keys(x["rules"])
        own = F.filter(x["pairs"], lambda e: ~F.array_contains(known, e["key"]))
        taken = F.concat(known, F.transform(own, lambda e: e["key"]))
        more = F.filter(x["scalars"], lambda e: ~F.array_contains(taken, e["key"]) & (e["key"].isin(allow) if allow else F.lit(True)))
        auto = F.slice(F.concat(own, F.transform(more, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))), 1, most)
        return F.map_concat(x["rules"], F.map_from_entries(auto))

    return once(found, together)


def backfill(fields: Column, extra: dict[str, Column]) -> Column:
    """context fields, as strings, where the key is absent."""
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), quoted(v.cast("string")).alias("value")) for k, v in extra.items()]), lambda e: e["value"].isNotNull() & ~F.array_contains(F.map_keys(fields), e["key"]))
    return F.map_concat(fields, F.map_from_entries(entries))
