"""Connected components of a link table, as joins and groupings in rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, release


def local_forest(n: int, left: np.ndarray, right: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of ``n`` items over the links, continuing from ``labels``."""
    labels = np.arange(n) if labels is None else labels
    while True:
        a, b = labels[left], labels[right]
        differ = a != b
        if not differ.any():
            return labels
        low, high = np.minimum(a, b)[differ], np.maximum(a, b)[differ]
        np.minimum.at(labels, high, low)
        while True:  # point every item at its root
            root = labels[labels]
            if (root == labels).all():
                break
            labels = root


def _state(edges: DataFrame) -> tuple:
    """What tells two sets of links apart: their number and two sums of 64-bit hashes."""
    sums = [F.sum(F.xxhash64(F.lit(i), "a", "b").cast("decimal(38,0)")) for i in (1, 2)]
    return tuple(edges.agg(F.count("*"), *sums).first())


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns a, b); root is the smallest node reachable.

    Alternates two kinds of rounds: every node tells its larger neighbours, then
    its smaller ones, of the smallest node it knows. Paths halve, so rounds grow
    with the logarithm of a component's diameter. Null ends and self links are
    ignored; repeated links count once.
    """
    edges = kept(
        links.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = _state(edges)
    while True:
        # Large star: every neighbour above a node is linked to the smallest one around it.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = kept(
            both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        )
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = kept(
            large.join(lowest, "a")
            .select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        now = _state(small)
        if now == before:
            return small.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                small.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        edges, before = small, now
        del both, least, large, lowest, small
        release(edges.sparkSession)
