"""Severity from priorities and keywords."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from logmill.functions.normalize import once

# Fixed values.
CRITICAL = ["panic:", "kernel bug", "kernel panic", "out of memory: killed", "oops:", "rcu_sched self-detected stall", "nmi: not continuing", "remounting filesystem read-only", "machine check events logged"]
ERROR = ["i/o error", "blk_update_request", "ext4-fs error", "xfs: internal error", "segfault at", "general protection fault", "hardware error", "edac mc"]
LEVELS = ["critical", "error", "warn", "info"]


def any_of(words: list[str], low: Column) -> Column:
    """Whether a lower-case text has one of the words."""
    return reduce(or_, [F.contains(low, F.lit(w)) for w in words])


def from_priority(priority: Column) -> Column:
    """syslog priority, as text, to severity; 6 where it is no number."""
    p = F.coalesce(priority.try_cast("int"), F.lit(6))
    return F.when(p <= 2, "critical").when(p == 3, "error").when(p == 4, "warn").otherwise("info")


def keep(priority: Column) -> Column:
    """all but debug messages."""
    return F.coalesce(priority.try_cast("int"), F.lit(6)) < 7


def finalize(initial: Column, raw: Column) -> Column:
    """Keywords raise the first severity and never lower it; an unknown one is info."""

    def raised(low: Column) -> Column:
        return F.when(any_of(CRITICAL, low) | (initial == "critical"), "critical").when(any_of(ERROR, low) | (initial == "error"), "error").when(initial == "warn", "warn").otherwise("info")

    return once(F.lower(raw), raised)
