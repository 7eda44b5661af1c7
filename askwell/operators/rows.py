"""Sharding, slicing, resuming and grid operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import with_position


def shard_contiguous(df: DataFrame, n_shards: int, order: str, shard: int | None = None) -> DataFrame:
    """Contiguous shards of ``rows // n`` rows; the last one takes the rest."""
    size = df.count() // n_shards
    placed = with_position(df, order, name="__pos")
    if size == 0:
        out = placed.withColumn("shard", F.lit(n_shards - 1).cast("long"))
    else:
        number = F.floor((F.col("__pos") - 1) / F.lit(size))
        out = placed.withColumn("shard", F.least(number, F.lit(n_shards - 1)).cast("long"))
    out = out.drop("__pos")
    return out if shard is None else out.filter(F.col("shard") == shard)


def shard_even(df: DataFrame, n_shards: int, order: str, shard: int | None = None) -> DataFrame:
    """Contiguous shards whose sizes differ by at most one, larger ones first."""
    size, larger = divmod(df.count(), n_shards)
    at = F.col("__pos") - 1
    head = larger * (size + 1)
    number = F.when(at < head, F.floor(at / F.lit(size + 1))).otherwise(
        F.lit(larger) + F.floor((at - head) / F.lit(max(size, 1)))
    )
    out = with_position(df, order, name="__pos").withColumn("shard", number.cast("long")).drop("__pos")
    return out if shard is None else out.filter(F.col("shard") == shard)


def shard_stride(df: DataFrame, n_shards: int, order: str, shard: int | None = None) -> DataFrame:
    """Row number modulo ``n``; the row number starts at one."""
    out = with_position(df, order, name="__pos").withColumn("shard", F.col("__pos") % n_shards).drop("__pos")
    return out if shard is None else out.filter(F.col("shard") == shard)


def slice_rows(df: DataFrame, order: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows ``start`` (0-based, inclusive) to ``end`` (exclusive) in order.

    Negative bounds count from the end, as in a sequence slice.
    """
    if (start or 0) < 0 or (end or 0) < 0:
        start, end, _ = slice(start, end).indices(df.count())
    at = F.col("__pos") - 1
    keep = F.lit(True)
    if start is not None:
        keep = keep & (at >= start)
    if end is not None:
        keep = keep & (at < end)
    return with_position(df, order, name="__pos").filter(keep).drop("__pos")


def resume_remaining(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key has no finished result yet."""
    return df.join(done.select(*keys), list(keys), "left_anti")


def restore_order(df: DataFrame, original: DataFrame, key: str, position: str) -> DataFrame:
    """Sort rows by the last position their key has in the original table."""
    last = original.groupBy(key).agg(F.max(position).alias(position))
    return df.drop(position).join(last, key).orderBy(position)


def add_teacher_columns(
    df: DataFrame, answers: DataFrame, teachers: Sequence[str], key: str = "qid"
) -> DataFrame:
    """One column per named teacher out of a long ``(key, teacher, answer)`` table."""
    wide = answers.groupBy(key).pivot("teacher", list(teachers)).agg(F.max("answer"))
    return df.join(wide, key, "left")


def run_grid(tasks: DataFrame, models: Sequence[str], results: DataFrame) -> DataFrame:
    """Every task and model pair with its result, null where it has not run."""
    cells = tasks.select("task").distinct().withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    return cells.join(results, ["task", "model"], "left")
