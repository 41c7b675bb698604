"""Ordered category rules, compiled to one CASE expression."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from logmill.functions.normalize import once

DEFAULT = "system.general"
_META = re.compile(r"[\\.+*?()|\[\]{}^$]")


@dataclass(frozen=True)
class Rule:
    pattern: str
    category: str
    program: str | None = None
    logger: str | None = None

    @property
    def literal(self) -> bool:
        """No pattern character, and not empty."""
        return bool(self.pattern) and not _META.search(self.pattern)

    @property
    def regex(self) -> str:
        """An empty pattern matches all."""
        return f"(?i){self.pattern}" if self.pattern else "(?s).*"


# The shipped rules in order of priority.
RULES = [
    Rule("Memory cgroup out of memory", "container.oom"),
    Rule("oom-kill-container", "container.oom"),
    Rule("Out of memory: Killed", "kernel.oom"),
    Rule("kernel BUG at", "kernel.bug"),
    Rule("panic:", "kernel.panic"),
    Rule("Kernel panic", "kernel.panic"),
    Rule("segfault at", "process.crash"),
    Rule("general protection fault", "process.crash"),
    Rule("EXT4-fs error", "fs.error"),
    Rule("XFS: Internal error", "fs.error"),
    Rule("remounting filesystem read-only", "fs.readonly"),
    Rule("EDAC MC", "hw.mce"),
    Rule("Hardware Error", "hw.mce"),
    Rule("Machine Check", "hw.mce"),
    Rule("SMART.*Threshold.*Exceeded", "disk.smart_error"),
    Rule("I/O error", "disk.io_error"),
    Rule("blk_update_request", "disk.io_error"),
    Rule(r"ata[0-9]+(\.[0-9]+)?: .*error", "disk.io_error"),
    Rule("TCP: out of memory", "net.error"),
    Rule("nf_conntrack: table full", "net.error"),
    Rule("Failed to start", "systemd.unit_failure"),
    Rule("failed with result", "systemd.unit_failure"),
    Rule("Start request repeated too quickly", "systemd.restart_loop"),
    Rule("Failed password for invalid user", "auth.bruteforce"),
    Rule("POSSIBLE BREAK-IN ATTEMPT", "auth.bruteforce"),
    Rule("Too many authentication failures", "auth.bruteforce"),
    Rule("authentication failure", "auth.failure"),
    Rule("Failed password", "auth.failure"),
    Rule("Invalid user", "auth.failure"),
    Rule("Accepted publickey", "auth.event", "sshd"),
    Rule("Accepted password", "auth.event", "sshd"),
    Rule(r"pam_unix\(sshd:session\): session (opened|closed)", "auth.event", "sshd"),
    Rule("Disconnected from user", "auth.event", "sshd"),
    Rule("Received disconnect from", "auth.event", "sshd"),
    Rule(r"pam_unix\(cron:session\)", "session.activity", "CRON"),
    Rule("New session [0-9]+ of user", "session.activity"),
    Rule("Started Session [0-9]+ of", "session.activity"),
    Rule("Removed session [0-9]+", "session.activity"),
    Rule("Session [0-9]+ logged out", "session.activity"),
    Rule(r"session-[0-9]+\.scope", "session.activity"),
    Rule("System clock wrong", "ntp.drift"),
    Rule("time step detected", "ntp.drift"),
    Rule("time stepped", "ntp.drift"),
    Rule("hard resetting link", "disk.link_error"),
    Rule("SATA link down", "disk.link_error"),
    Rule("exception Emask", "disk.link_error"),
    Rule(r"avc:\s+denied", "selinux.denial"),
    Rule("type=AVC", "selinux.denial"),
    Rule("NETDEV WATCHDOG", "net.watchdog"),
    Rule("transmit queue timed out", "net.watchdog"),
    Rule("", DEFAULT),
]


def load(path: str) -> list[Rule]:
    """Rules of a YAML file (a list under ``categories``); a file that can't be read gives the fallback alone."""
    try:
        import yaml

        with open(path) as f:
            return [Rule(str(r.get("pattern", "")), r["category"], r.get("program"), r.get("logger")) for r in yaml.safe_load(f)["categories"]]
    except (ImportError, OSError, KeyError, TypeError, AttributeError, ValueError):
        return [Rule("", DEFAULT)]


def _anchored(pattern: str, raw: Column, low: Column) -> Column:
    """A regular expression, behind a test for the letters that it starts with."""
    start = re.match(r"[A-Za-z ]{3,}", pattern)
    test = raw.rlike(f"(?iu){pattern}")
    if not start or "|" in pattern.split("(")[0] or pattern[start.end() : start.end() + 1] in ("?", "*", "{"):
        return test
    return F.contains(low, F.lit(start[0].lower())) & test


def categorize(raw: Column, program: Column, logger: Column | None = None, rules: list[Rule] | None = None) -> Column:
    """Category of the first rule that matches; gated rules need the program or the logger."""

    def first(low: Column, own: Column) -> Column:
        out = None
        for r in RULES if rules is None else rules:
            test = F.lit(True) if not r.pattern else F.contains(low, F.lit(r.pattern.lower())) if r.literal else _anchored(r.pattern, raw, low)
            if r.program:
                test &= F.coalesce(own == r.program.lower(), F.lit(False))
            if r.logger:
                test &= F.coalesce(logger.rlike(f"(?iu){r.logger}"), F.lit(False)) if logger is not None else F.lit(False)
            out = F.when(test, r.category) if out is None else out.when(test, r.category)
        return F.lit(DEFAULT) if out is None else out.otherwise(DEFAULT)

    return once(F.struct(F.lower(raw).alias("low"), F.lower(program).alias("own")), lambda x: first(x["low"], x["own"]))
