"""Ranked retrieval metrics (E15-E21) from ``run`` and ``qrels`` tables.

``run``: query_id, doc_id, score; ``qrels``: query_id, doc_id, rel. Both may
carry further key columns (a sub-collection). Equal scores rank by doc_id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 3, 5, 10, 100, 1000)
METRICS = ("ndcg", "map", "recall", "precision", "mrr", "recall_cap", "hole")
# Averaged over the judged queries that were run; the rest over all judged queries.
OVER_RUN = ("ndcg", "map", "recall", "precision")


def rank_run(run: DataFrame, depth: int, keys: Sequence[str]) -> DataFrame:
    """Best ``depth`` documents per query with their rank; tasks prune before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "doc_id")
    return run.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= depth)


def _within(k: int, value: Column, rank: str = "rank") -> Column:
    return F.coalesce(F.sum(F.when(F.col(rank) <= k, value)), F.lit(0.0))


def query_scores(
    run: DataFrame, qrels: DataFrame, ks: Sequence[int] = KS, extra_keys: Sequence[str] = ()
) -> DataFrame:
    """``query_id, k`` and every metric, for each judged query of the run.

    One pass over the cut run and one over the judgements; the cut-offs are
    conditional sums, not copies of the rows.
    """
    keys = [*extra_keys, "query_id"]
    depth = max(ks)
    judged = (
        rank_run(run, depth, keys)
        .join(qrels, [*keys, "doc_id"], "left")
        .join(qrels.select(*extra_keys, "doc_id").distinct().withColumn("seen", F.lit(1)), [*extra_keys, "doc_id"], "left")
    )
    relevant = F.when(F.col("rel") > 0, 1.0).otherwise(0.0)
    so_far = F.sum(relevant).over(Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    gain = F.greatest(F.coalesce("rel", F.lit(0)), F.lit(0)) / F.log2(F.col("rank") + 1)
    marked = judged.select(
        *keys,
        "rank",
        relevant.alias("relevant"),
        gain.alias("gain"),
        (relevant * so_far / F.col("rank")).alias("step"),
        F.when(F.col("seen").isNull(), 1.0).otherwise(0.0).alias("hole"),
        F.when(F.col("rel") > 0, F.col("rank")).alias("hit_rank"),
    )
    at = F.array(
        *[
            F.struct(
                F.lit(k).alias("k"),
                _within(k, F.col("gain")).alias("dcg"),
                _within(k, F.col("step")).alias("steps"),
                _within(k, F.col("relevant")).alias("found"),
                _within(k, F.col("hole")).alias("holes"),
                F.min(F.when(F.col("hit_rank") <= k, F.col("hit_rank"))).alias("first"),
            )
            for k in ks
        ]
    )
    found = marked.groupBy(*keys).agg(at.alias("at")).select(*keys, F.inline("at"))
    best = Window.partitionBy(*keys).orderBy(F.col("rel").desc())
    positive = qrels.filter(F.col("rel") > 0)
    ideal_at = F.array(
        *[F.struct(F.lit(k).alias("k"), _within(k, F.col("rel") / F.log2(F.col("rank") + 1)).alias("idcg")) for k in ks]
    )
    ideal = (
        positive.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= depth)
        .groupBy(*keys)
        .agg(ideal_at.alias("at"))
        .select(*keys, F.inline("at"))
    )
    n_rel = qrels.groupBy(*keys).agg(F.count(F.when(F.col("rel") > 0, 1)).alias("n_rel"))
    rows = found.join(n_rel, keys).join(ideal, [*keys, "k"], "left")

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    k = F.col("k")
    return rows.select(
        *keys,
        "k",
        ratio(F.col("dcg"), F.coalesce("idcg", F.lit(0.0))).alias("ndcg"),
        ratio(F.col("steps"), F.col("n_rel")).alias("map"),
        ratio(F.col("found"), F.col("n_rel")).alias("recall"),
        (F.col("found") / k).alias("precision"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        ratio(F.col("found"), F.least(k, F.col("n_rel"))).alias("recall_cap"),
        (F.col("holes") / k).alias("hole"),
    )


def mean_scores(
    run: DataFrame, qrels: DataFrame, ks: Sequence[int] = KS, extra_keys: Sequence[str] = ()
) -> DataFrame:
    """``k`` and the mean of every metric, per sub-collection if there is one."""
    n_queries = qrels.select(*extra_keys, "query_id").distinct().groupBy(*extra_keys).agg(F.count("*").alias("n_queries"))
    over_run = [F.avg(m).alias(m) for m in OVER_RUN]
    sums = [F.sum(m).alias(m) for m in METRICS if m not in OVER_RUN]
    scores = query_scores(run, qrels, ks, extra_keys).groupBy(*extra_keys, "k").agg(*over_run, *sums)
    if extra_keys:
        joined = scores.join(n_queries, list(extra_keys))
    else:
        joined = scores.join(F.broadcast(n_queries.withColumn("__one", F.lit(1))), F.lit(1) == F.col("__one"))
    means = [F.col(m) if m in OVER_RUN else (F.col(m) / F.col("n_queries")).alias(m) for m in METRICS]
    return joined.select(*extra_keys, "k", *means)


def ir_report(
    run: DataFrame,
    qrels: DataFrame,
    ks: Sequence[int] = KS,
    subset: str | None = None,
    ignore_identical_ids: bool = True,
) -> DataFrame:
    """``metric, k, value``: every metric times 100, macro-averaged over sub-collections."""
    if ignore_identical_ids:
        run = run.filter(F.col("query_id").cast("string") != F.col("doc_id").cast("string"))
    means = mean_scores(run, qrels, ks, [subset] if subset else [])
    long = means.unpivot([c for c in means.columns if c not in METRICS], list(METRICS), "metric", "value")
    return long.groupBy("metric", "k").agg((F.avg("value") * 100).alias("value"))
