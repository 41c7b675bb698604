"""A14 without a second look at the lines: distinct templates as sketches that are stored by cycle and united for any longer time.

A sketch has ``2**lg_k`` bytes at most, far less for few templates, whatever the lines; the aggregation is partial on each task,
so what is shuffled grows with hosts and cycles alone, where an exact count moves each distinct template of each of them.
Estimates have a relative standard error of some ``1.04 / 2**(lg_k / 2)``; below about ``2**lg_k / 16`` values they are
exact but for chance meetings of 26-bit hashes.  ``exact_ratios`` and ``exact_new_templates`` give the true numbers from the lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logmill.operators import dedup, envelopes

LG_K = 12


def by_cycle(lines: DataFrame, keys: tuple[str, ...] = ("host",), *, value: str = "template", ts: str = "ts", cycle_s: int = envelopes.CYCLE_S, lg_k: int = LG_K) -> DataFrame:
    """(keys, cycle, lines, sketch): a row for each cycle with a line; a null value is a line but no template."""
    cycle = F.floor(dedup.micros(F.col(ts)) / (1_000_000 * cycle_s)).alias("cycle")
    # the hash, since a sketch of texts passes over the empty one
    hashed = F.when(F.col(value).isNotNull(), F.xxhash64(value))
    return lines.groupBy(*keys, cycle).agg(F.count("*").alias("lines"), F.hll_sketch_agg(hashed, lg_k).alias("sketch"))


def united(stored: DataFrame, *keys) -> DataFrame:
    """Sketches of several rows as one, by ``keys`` (columns, or none for all): may be stored and united again.

    A part that is there twice does no harm to the sketch, only to the number of lines.  The order in which parts are
    united may change an estimate within its error.
    """
    return stored.groupBy(*keys).agg(F.sum("lines").alias("lines"), F.hll_union_agg("sketch", True).alias("sketch"))


def ratios(sketches: DataFrame) -> DataFrame:
    """Lines, estimated templates and lines a template (null without any) in place of each row's sketch."""
    templates = F.hll_sketch_estimate("sketch")
    out = sketches.withColumn("templates", templates).drop("sketch")
    return out.withColumn("ratio", F.col("lines") * 1.0 / F.nullif(F.col("templates"), F.lit(0)))


def exact_ratios(lines: DataFrame, *keys: str, value: str = "template") -> DataFrame:
    """(keys, lines, templates, ratio) as ``ratios`` has them, with true numbers: lines are counted by template before they move."""
    each = lines.groupBy(*keys, value).agg(F.count("*").alias("lines"))
    out = each.groupBy(*keys).agg(F.sum("lines").alias("lines"), F.count(value).alias("templates"))
    return out.withColumn("ratio", F.col("lines") * 1.0 / F.nullif(F.col("templates"), F.lit(0)))


def exact_new_templates(lines: DataFrame, keys: tuple[str, ...] = ("host",), *, value: str = "template", ts: str = "ts", cycle_s: int = envelopes.CYCLE_S) -> DataFrame:
    """(keys, cycle, fresh) as ``new_templates`` has them, with true numbers.

    A template's cycle before is told for each template; of a host's cycle only those whose last one was the same come together,
    as numbers.
    """
    cycle = F.floor(dedup.micros(F.col(ts)) / (1_000_000 * cycle_s)).alias("cycle")
    own = lines.select(*keys, cycle, value).distinct()
    seen = own.withColumn("seen", F.lag("cycle").over(Window.partitionBy(*keys, value).orderBy("cycle")))
    each = seen.groupBy(*keys, "cycle", "seen").agg(F.count(value).alias("n"))
    whole = each.groupBy(*keys, "cycle").agg(F.sum("n").alias("n"), F.max("seen").alias("last"), F.max_by("n", "seen").alias("again"))
    # the latest of the cycles in which its templates were is the host's cycle before, or they share none
    before = F.lag("cycle").over(Window.partitionBy(*keys).orderBy("cycle"))
    found = whole.withColumn("before", before)
    return found.select(*keys, "cycle", (F.col("n") - F.when(F.col("last") == F.col("before"), F.col("again")).otherwise(0)).alias("fresh"))


def new_templates(stored: DataFrame, keys: tuple[str, ...] = ("host",), cycle: str = "cycle") -> DataFrame:
    """(keys, cycle, fresh): about how many templates a cycle has that its host's cycle before had not, from the two sketches alone.

    The estimate of both united less that of the one before; a host's first cycle is fresh as a whole.
    """
    before = F.lag("sketch").over(Window.partitionBy(*keys).orderBy(cycle))
    own = F.hll_sketch_estimate("sketch")
    both = F.hll_sketch_estimate(F.hll_union("before", "sketch", True)) - F.hll_sketch_estimate("before")
    found = stored.withColumn("before", before)
    return found.select(*keys, cycle, F.when(F.col("before").isNull(), own).otherwise(F.greatest(both, F.lit(0))).alias("fresh"))
