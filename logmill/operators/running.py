"""Running sums over groups that may hold a large share of all rows.

A group (a file, a host) is cut into stretches by a number that rises with its order.  The sums of the stretches, one row
each, are added up within a group, and each stretch goes on from the sum before it; so one group is spread over as many
tasks as it has stretches, and no task sorts a whole group.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a file that make a stretch, and seconds of a host.
LINES = 100_000
SECONDS = 3_600


def by_line(order: str) -> Column:
    return F.floor(F.col(order) / LINES)


def by_time(ts: str) -> Column:
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / SECONDS)


def running_sum(df: DataFrame, value: Column, into: str, *, keys: list[str], order: list[str], stretch: Column, most: int | None = None) -> DataFrame:
    """Add ``into``: the sum of ``value`` over the rows of the same ``keys`` up to each one in ``order``.

    ``stretch`` must rise with ``order`` within ``keys``.  Values that are null count as zero.  With ``most``, of values
    that aren't negative, only rows whose sum is at most that are kept, and stretches that begin beyond it are passed
    over whole.  Null keys are a group of their own; no keys: all rows are one group.
    """
    marked = df.withColumns({"_value": F.coalesce(value, F.lit(0)), "_stretch": stretch})
    names = [f"_key{i}" for i in range(len(keys))]
    sums = marked.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col("_stretch").alias("_at")).agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*names).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*names, "_at", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    if most is not None:
        offsets = offsets.where(F.col("_before") <= most)
    own = Window.partitionBy(*keys, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip([*keys, "_stretch"], [*names, "_at"], strict=True)])
    placed = marked.join(offsets, same).withColumn(into, F.sum("_value").over(own) + F.col("_before"))
    out = placed.drop("_value", "_stretch", "_at", "_before", *names)
    return out if most is None else out.where(F.col(into) <= most)
