"""Weighted means and contrastive training reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import every_pair, matrix, packed

BLOCK_ROWS = 1 << 16
TILE = 1 << 22


def weighted_mean(stats: DataFrame, name: str = "name", value: str = "value", weight: str = "weight") -> DataFrame:
    """Weighted mean, total weight, plain mean and sum of each named value."""
    total = F.sum(weight)
    return stats.groupBy(name).agg(
        F.when(total != 0, F.sum(F.col(value) * F.col(weight)) / total).alias("weighted_mean"),
        total.alias("weight"),
        F.avg(value).alias("mean"),
        F.sum(value).alias("total"),
    )


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _spread(vectors: np.ndarray) -> float:
    return float(vectors.std(axis=0, ddof=1).mean()) if len(vectors) > 1 else float("nan")


def inbatch_report(
    batches: DataFrame, temperature: float = 1.0, label_smoothing: float = 0.0, batch: str = "batch"
) -> DataFrame:
    """Loss, accuracy and spread of ``q`` against every ``k`` of its batch, row ``pos`` matching row ``pos``.

    A batch has a set size, and its score matrix exists only inside one task.
    """

    def report(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        q, k = _stack(rows["q"]), _stack(rows["k"])
        logits = q @ k.T / temperature
        top = logits.max(axis=1, keepdims=True)
        log_p = logits - top - np.log(np.exp(logits - top).sum(axis=1, keepdims=True))
        own = np.diagonal(log_p)
        loss = -(1 - label_smoothing) * own - label_smoothing * log_p.mean(axis=1)
        right = logits.argmax(axis=1) == np.arange(len(q))
        return pd.DataFrame(
            {
                batch: [rows[batch].iloc[0]],
                "loss": [loss.mean()],
                "accuracy": [100.0 * right.mean()],
                "stdq": [_spread(q)],
                "stdk": [_spread(k)],
                "weight": [len(q)],
            }
        )

    kind = batches.schema[batch].dataType.simpleString()
    schema = f"{batch} {kind}, loss double, accuracy double, stdq double, stdk double, weight long"
    return batches.select(batch, "pos", "q", "k").groupBy(batch).applyInPandas(report, schema)


def with_negatives(
    pairs: DataFrame, negatives: DataFrame, temperature: float = 1.0, block_rows: int = BLOCK_ROWS, columns: tuple[str, ...] = ("id",)
) -> DataFrame:
    """``columns`` of ``pairs`` and ``top, total, plain, n``: what a softmax needs to know of a query's negatives.

    The highest logit, the sum of ``exp(logit - top)``, the sum of logits and
    their number. Such states add up, so more than ``block_rows`` negatives are
    split into groups, whose states a task adds up as long as it has the block;
    beyond what travels together ``columns`` must tell pairs apart. Without negatives ``top`` is minus
    infinity and the rest zero.
    """

    def visit() -> Callable:
        held, state = None, ()

        def each(block: dict | None, group: int | None, few) -> Iterator[pd.DataFrame]:
            nonlocal held, state
            if held is not None and held is not block:
                yield pd.DataFrame({**{c: held[c] for c in columns}, **dict(zip(("top", "total", "plain", "n"), state))})
                held = None
            if block is None:
                return
            q = matrix(block["data"], block["width"])
            if held is None:
                held, state = block, (np.full(len(q), -np.inf), np.zeros(len(q)), np.zeros(len(q)), 0)
            top, total, plain, n = state
            for f in few if few is not None else ():
                other = matrix(f["data"], f["width"])
                n += len(other)
                step = max(1, TILE // max(1, len(q)))
                for at in range(0, len(other), step):
                    logits = q @ other[at : at + step].T / temperature
                    higher = np.maximum(top, logits.max(axis=1))
                    total = total * np.exp(top - higher) + np.exp(logits - higher[:, None]).sum(axis=1)
                    top, plain = higher, plain + logits.sum(axis=1)
            state = top, total, plain, n

        return each

    kinds = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in columns)
    blocks = packed(negatives.withColumn("one", F.lit(1)), ["one"], "embedding", 64 * block_rows)
    width = negatives.agg(F.max(F.size("embedding"))).first()[0] or 1
    schema = f"{kinds}, top double, total double, plain double, n long"
    states, sets = every_pair(packed(pairs, columns, "q"), blocks, visit, schema, 8 * width * block_rows)
    if sets == 1:
        return states
    every = states.groupBy(*columns).agg(F.collect_list(F.struct("top", "total", "plain", "n")).alias("s"))  # one per set of groups
    top = F.array_max("s.top")

    def added(value: Callable[[Column], Column], zero: Column) -> Column:
        return F.aggregate("s", zero, lambda acc, x: acc + value(x))

    return every.withColumn("top", top).select(
        *columns, "top",
        added(lambda x: x["total"] * F.exp(x["top"] - F.col("top")), F.lit(0.0)).alias("total"),
        added(lambda x: x["plain"], F.lit(0.0)).alias("plain"),
        added(lambda x: x["n"], F.lit(0).cast("long")).alias("n"),
    )


def spreads(df: DataFrame, **named: str) -> DataFrame:
    """One row: per name, the mean over dimensions of its column's sample standard deviation; null without rows."""
    cells = F.arrays_zip(*[F.transform(c, lambda x: x.cast("double")).alias(n) for n, c in named.items()])
    per_dim = df.select(F.posexplode(cells).alias("dim", "x")).groupBy("dim")
    return per_dim.agg(*[F.stddev_samp(f"x.{n}").alias(n) for n in named]).agg(*[F.avg(n).alias(n) for n in named])


def queue_report(
    pairs: DataFrame,
    negatives: DataFrame,
    temperature: float = 1.0,
    label_smoothing: float = 0.0,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Loss, accuracy and spread of ``q`` with its own ``k`` against shared negatives.

    ``pairs``: id (one row each), q, k; ``negatives``: id, embedding. Without
    negatives the loss is 0 and the accuracy 100; without pairs both are null.
    """
    products = F.zip_with("q", "k", lambda a, b: a.cast("double") * b.cast("double"))
    own = F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x) / temperature
    pairs = pairs.withColumn("own", own)
    rows = with_negatives(pairs, negatives, temperature, block_rows, ("id", "own"))
    peak = F.greatest("own", "top")
    log_sum = peak + F.log(F.exp(F.col("own") - peak) + F.col("total") * F.exp(F.col("top") - peak))
    mean_logit = (F.col("own") + F.col("plain")) / (F.col("n") + 1)
    loss = (log_sum - F.col("own")) * (1 - label_smoothing) + (log_sum - mean_logit) * label_smoothing
    report = rows.agg(
        F.avg(loss).alias("loss"),
        (F.avg((F.col("own") >= F.col("top")).cast("int")) * 100).alias("accuracy"),
        F.count("*").alias("weight"),
    )
    return report.join(spreads(pairs, stdq="q", stdk="k"), F.lit(True))  # one row each
