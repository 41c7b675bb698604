"""Times, sizes, device names, backoff, ULIDs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def parse_syslog_ts(line: Column, now: Column) -> Column:
    """``Mon D HH:MM:SS`` in the year of ``now``, or the year before if that were more than a day ahead."""
    text = F.regexp_extract(line, r"^([A-Za-z]{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})", 0)
    short = F.regexp_replace(text, r"\s+", " ")

    def at(year: Column) -> Column:
        return F.try_to_timestamp(F.concat_ws(" ", year.cast("string"), short), F.lit("yyyy MMM d HH:mm:ss"))

    this = at(F.year(now))
    return F.when(this > now + F.expr("interval 1 day"), at(F.year(now) - 1)).otherwise(this)


def parse_iso_ts(line: Column) -> Column:
    """The first word, if it is an RFC 3339 time with an offset."""
    word = F.regexp_extract(line, r"^\s*(\S+)", 1)
    return F.when(word.rlike(r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"), word.try_cast("timestamp"))


def parse_since(text: Column) -> Column:
    """D3: digits and one of s, m, h, d to seconds, else null."""
    trimmed = F.trim(text)
    n = F.regexp_extract(trimmed, r"^([0-9]{1,12})[smhd]$", 1).try_cast("bigint")
    unit = F.substring(trimmed, -1, 1)
    return n * F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)


def parse_memory(text: Column) -> Column:
    """``256m`` or ``1g`` to bytes, else null."""
    low = F.lower(F.trim(text))
    n = F.regexp_extract(low, r"^([0-9]{1,12})[mg]$", 1).try_cast("bigint")
    return n * F.when(F.endswith(low, F.lit("g")), 1 << 30).otherwise(1 << 20)


def human_bytes(n: Column) -> Column:
    """A ladder of 1024 with one decimal."""
    out = F.concat(n.cast("string"), F.lit("B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        out = F.when(n >= 1024**power, F.format_string(f"%.1f{unit}", F.round(n / 1024**power, 1))).otherwise(out)
    return out


def is_partition(dev: Column) -> Column:
    """a part of a disk rather than a whole one."""
    return F.when(F.startswith(dev, F.lit("nvme")), dev.rlike(r"p[0-9]+$")).when(F.startswith(dev, F.lit("loop")), F.lit(False)).otherwise(dev.rlike(r"[0-9]$"))


def skipped_device(dev: Column) -> Column:
    return dev.rlike(r"^(loop|ram|dm-)") | is_partition(dev)


def backoff(base: Column, attempt: Column, most: Column) -> Column:
    """M3: doubling with a limit."""
    return F.least(base * F.pow(F.lit(2.0), attempt), most.cast("double"))


def ulid_ms(name: Column) -> Column:
    """Milliseconds of a ULID's first ten characters, null if it is none."""
    stem = F.upper(F.regexp_extract(name, r"([0-9A-Za-z]{26})(?:\.[a-z]+)*$", 1))
    digits = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.position(F.substring(stem, i, F.lit(1)), F.lit(CROCKFORD)) - 1)
    total = F.aggregate(digits, F.lit(0).cast("bigint"), lambda a, d: a * 32 + d)
    return F.when(stem.rlike(f"^[0-7][{CROCKFORD}]{{25}}$"), total)


def ulid(ms: Column, seed: Column) -> Column:
    """A ULID of a time and, in place of random digits, a hash of ``seed``: the same again for the same."""
    letters = [F.substring(F.lit(CROCKFORD), (F.shiftright(ms, 45 - 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in range(10)]
    return F.concat(*letters, F.upper(F.substring(F.md5(seed), 1, 16)))


def saturating_sub(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))


def rfc3339(ts: Column) -> Column:
    """UTC with an offset and microseconds, for sinks."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def window_text(start: Column, end: Column) -> Column:
    """D5."""
    return F.concat_ws("/", rfc3339(start), rfc3339(end))


def outermost_object(text: Column) -> Column:
    """From the first ``{`` to the last ``}`` if that is JSON, else null."""
    part = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(part).isNotNull() & (part != ""), part)


def journal_limit(most_bytes: int) -> int:
    """Lines to ask the journal for."""
    return min(max(most_bytes // 80, 1_000), 300_000)


class TokenBucket:
    """M2: ``limit`` calls an hour; ``take(now)`` gives 0 or the seconds to wait."""

    def __init__(self, limit: int, now: float = 0.0):
        self.limit, self.rate, self.tokens, self.at = limit, limit / 3600, float(limit), now

    def take(self, now: float) -> int:
        self.tokens = min(float(self.limit), self.tokens + max(0.0, now - self.at) * self.rate)
        self.at = now
        if self.tokens >= 1:
            self.tokens -= 1
            return 0
        return -int(-(1 - self.tokens) / self.rate // 1)
