"""Row numbers and running totals over a whole table without one big task.

Rows are cut into ranges of the order column (quantile bounds found by one
sketch pass), each range is numbered on its own, and the few per-range totals
are accumulated and added back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE = "__range"
BEFORE = "__before"
ORDER = "__order"


def range_bounds(df: DataFrame, order: str, ranges: int | None = None) -> list[float]:
    """Strictly increasing cut points giving ranges of about equal size."""
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if ranges < 2:
        return []
    marks = [i / ranges for i in range(1, ranges)]
    return sorted(set(df.approxQuantile(order, marks, 1.0 / (4 * ranges))))


def with_ranges(df: DataFrame, order: str, ranges: int | None = None) -> DataFrame:
    """Add the number of the order range each row falls in."""
    keyed = df.withColumn(ORDER, F.col(order).cast("double"))
    cuts = [-float("inf"), *range_bounds(keyed, ORDER, ranges), float("inf")]
    if len(cuts) < 3:
        return keyed.withColumn(RANGE, F.lit(0.0)).drop(ORDER)
    return Bucketizer(splits=cuts, inputCol=ORDER, outputCol=RANGE).transform(keyed).drop(ORDER)


def running_total(
    df: DataFrame,
    value: Column,
    order: str,
    by: Sequence[str] = (),
    ties: Sequence[str] = (),
    name: str = "running_total",
    ranges: int | None = None,
) -> DataFrame:
    """Inclusive running sum of ``value`` in order, per ``by`` group.

    ``order`` is numeric, not null and, with ``ties``, unique within a group.
    """
    by = list(by)
    cut = with_ranges(df, order, ranges)
    per_range = cut.groupBy(*by, RANGE).agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    before = per_range.select(*by, RANGE, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias(BEFORE))
    within = Window.partitionBy(*by, RANGE).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumn(name, F.sum(value).over(within))
    if not by:
        before = F.broadcast(before)  # one row per range
        joined = local.join(before, RANGE)
    else:
        keys = [*by, RANGE]
        right = before.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], BEFORE)
        same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
        joined = local.join(right, same).drop(*[f"__k{i}" for i in range(len(keys))])
    return joined.withColumn(name, F.col(name) + F.col(BEFORE)).drop(RANGE, BEFORE)


def with_position(
    df: DataFrame,
    order: str,
    by: Sequence[str] = (),
    ties: Sequence[str] = (),
    name: str = "position",
    ranges: int | None = None,
) -> DataFrame:
    """1-based row number in order, per ``by`` group."""
    return running_total(df, F.lit(1).cast("long"), order, by, ties, name, ranges)
