"""Deterministic log lines, one for each row of ``events`` (or of a range).

A line's message is chosen by its number and filled in with values that are all drawn from one scrambled number, so
that SQL can make the same lines.  The messages are written for this repository; what they share with logs elsewhere are
the phrases that the categories look for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.functions.normalize import bound

#: (program, message); @name stands for a value of ``VALUES``.
MESSAGES = [
    ("sshd[@pid]", "Accepted password for operator from @ip4 on console @small"),
    ("sshd[@pid]", "Failed password for invalid user guest@small (@ip4)"),
    ("sshd[@pid]", "Accepted publickey for @job: ED25519 SHA256:@long"),
    ("sshd[@pid]", "authentication failure while @job was asked by @ip4"),
    ("sshd[@pid]", "Disconnected from user @job @ip4"),
    ("sshd[@pid]", "Failed password for user @job via @ip4"),
    ("CRON[@pid]", "pam_unix(cron:session): rotation of @job ended after @count"),
    ("kernel", "Out of memory: Killed process @pid, called @job, holding @count pages"),
    ("kernel", "Memory cgroup out of memory: Killed process @pid inside @job"),
    ("kernel", "EXT4-fs error on dev sd@disk, block group @small: checksum @count"),
    ("kernel", "XFS: Internal error in log of dev dm-@small"),
    ("kernel", "remounting filesystem read-only after @count retries (dev vd@disk@small)"),
    ("kernel", "I/O error while reading sector @count of nvme@smalln1"),
    ("kernel", "blk_update_request: @job gave up, dev sd@disk, sector @count"),
    ("kernel", "kernel BUG at lib/@job.c:@count"),
    ("kernel", "Kernel panic after watchdog bite, cpu @small, code [<@word>]"),
    ("kernel", "@job[@pid]: segfault at @word in libtide.so, error @small"),
    ("kernel", "EDAC MC@small: corrected memory at page 0x@word"),
    ("kernel", "nf_conntrack: table full, @ip4 was turned away"),
    ("kernel", "ata@small: hard resetting link, port @port"),
    ("kernel", "NETDEV WATCHDOG: wan@small stalled for @count ms"),
    ("kernel", "bridge br-@word@half gained veth@word with @mac and fd00::@half:@half"),
    ("smartd[@pid]", "SMART check: Threshold was Exceeded on /dev/sd@disk after @count hours"),
    ("systemd[1]", "@job.service: failed with result timeout"),
    ("systemd[1]", "@job.timer: Start request repeated too quickly"),
    ("systemd[1]", "Reached target @job at boot step @small"),
    ("systemd-logind[@pid]", "New session @count of user @job."),
    ("timekeeper[@pid]", "time stepped by @small.@count seconds"),
    ("audit[@pid]", "avc:  denied { write } by @job on /srv/@job/state/@count.db"),
    ("@job[@pid]", "site=@job code=@port duration=@countus status=\"half done\" user=@job@small"),
    ("@job[@pid]", "reply {\"code\": @port, \"status\": \"late\", \"path\": \"/v2/@job\", \"more\": {\"depth\": @small}}"),
    ("podd[@pid]", "pod @uuid runs image docker-@long from overlay2/@long"),
    ("gateway[@pid]", "@ip4:@port PUT /@job/items/@count took @small ms"),
    ("gateway[@pid]", "peer @mac leased @ip4 for @count s"),
    ("mailhub[@pid]", "queue @word holds @count letters for @job"),
]
JOBS = ["saffron", "tundra", "quartz", "willow", "pixel", "ripple", "nimbus"]
#: A multiplier and a prime that scramble a line's number.
TIMES, PRIME = 48_271, 2_147_483_647


def _hex(n: Column, width: int) -> Column:
    return F.lpad(F.lower(F.hex(n)), width, "0")


def _values(n: Column) -> dict[str, Column]:
    """Placeholders; longer names come before those that they start with.

    Jobs and disks are drawn from other bits than the remainders that choose the message, so that each message meets all.
    """
    k = F.pmod(n * TIMES, F.lit(PRIME))
    word, half = _hex(k, 8), _hex(k % 40_961, 4)
    text = lambda c: c.cast("string")
    return {
        "@pid": text(k % 31_991 + 300),
        "@ip4": F.concat_ws(".", F.lit("192.168"), text(k % 251), text(k % 239 + 1)),
        "@port": text(k % 28_001 + 30_000),
        "@count": text(k % 1_000_003),
        "@small": text(k % 9),
        "@disk": F.element_at(F.array(*[F.lit(c) for c in "bcefg"]), (F.floor(k / 89) % 5 + 1).cast("int")),
        "@job": F.element_at(F.array(*[F.lit(s) for s in JOBS]), (F.floor(k / 97) % len(JOBS) + 1).cast("int")),
        "@long": F.concat(word, half, word, half),
        "@word": word,
        "@half": half,
        "@uuid": F.concat_ws("-", word, half, half, half, F.concat(half, word)),
        "@mac": F.concat_ws(":", F.lit("02"), *(_hex(k % p, 2) for p in (251, 241, 239, 233, 229))),
    }


def fill(message: Column, n: Column, job: Column | None = None) -> Column:
    values = _values(n)
    if job is not None:
        values["@job"] = job
    for name, value in values.items():
        message = F.replace(message, F.lit(name), value)
    return message


def messages(n: Column) -> Column:
    """``program: message`` with the placeholders in it."""
    return F.element_at(F.array(*[F.lit(f"{p}: {m}") for p, m in MESSAGES]), (F.pmod(n, F.lit(len(MESSAGES))) + 1).cast("int"))


def synth_lines(events: DataFrame) -> DataFrame:
    """event_id, ts, user_id, host, source, priority, raw.

    Every seventh line comes from the journal: it has a priority and no header.  ``sshd`` and ``CRON`` write to
    ``file.auth``, the others to ``file.syslog``.  A message is filled in once and ``raw`` is made once, whatever reads them.
    """
    n, line = F.col("event_id"), F.col("_line")
    host = F.concat(F.lit("host"), (F.col("user_id") % 5).cast("string"))
    stamp = F.concat(F.date_format("ts", "MMM"), F.lit(" "), F.lpad(F.dayofmonth("ts").cast("string"), 2, " "), F.lit(" "), F.date_format("ts", "HH:mm:ss"))
    journal = n % 7 == 3
    source = F.when(journal, "journald").when(line.rlike("^(sshd|CRON)"), "file.auth").otherwise("file.syslog")
    message = F.regexp_replace(line, r"^[^\s:]+: ", "")
    filled = bound(events.select("event_id", "ts", "user_id"), _line=fill(messages(n), n))
    made = bound(filled.withColumns({"host": host, "source": source}), raw=F.when(journal, message).otherwise(F.concat_ws(" ", stamp, F.col("host"), line)))
    return made.select("event_id", "ts", "user_id", "host", "source", F.when(journal, (n % 8).cast("string")).alias("priority"), "raw")


def corpus(spark: SparkSession, n: int, distinct: int = 64) -> DataFrame:
    """``n`` lines with a header and a time ten milliseconds after the one before; ``distinct`` words set how many templates there are."""
    k = F.col("id")
    at = F.timestamp_millis(F.lit(1_709_784_729_000) + k * 10)
    word = F.concat(F.lit("unit"), F.translate(F.pmod(F.floor(k / len(MESSAGES)), F.lit(distinct)).cast("string"), "0123456789", "ghijklmnop"))
    return spark.range(n).select(k.alias("n"), at.alias("ts"), F.concat(F.date_format(at, "MMM d HH:mm:ss"), F.lit(" edge01 "), fill(messages(k), k, word)).alias("raw"))
