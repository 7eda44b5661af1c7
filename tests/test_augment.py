"""Draws told by the digest's text, and augmentations that share or sort few of them."""

from __future__ import annotations

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from askwell.functions.text import uniform, uniform_above, uniform_below, uniform_key
from askwell.operators import traindata as D


def draw(*parts) -> float:
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


@pytest.mark.parametrize("p", [-0.5, 0.0, 0.1, 0.25, draw("s", 7), 0.999, 1.0, 1.5])
def test_draws_below_and_above(spark, p):
    rows = spark.range(300).select(
        uniform("s", F.col("id")).alias("u"), uniform_key("s", F.col("id")).alias("key"),
        uniform_below(p, "s", F.col("id")).alias("low"), uniform_above(p, "s", F.col("id")).alias("high"),
    ).collect()
    assert all((r.low, r.high) == (r.u < p, r.u > p) for r in rows)
    assert sorted(rows, key=lambda r: r.key) == sorted(rows, key=lambda r: r.u)


def brute_shuffle(tokens, key, p):
    n = sum(draw("0|count", key, i) < p for i in range(len(tokens)))
    to = sorted(range(len(tokens)), key=lambda i: (draw("0|place", key, i), i))[:n]
    source = sorted(to, key=lambda i: (draw("0|deal", key, i), i))
    out = list(tokens)
    for a, b in zip(to, source):
        out[a] = tokens[b]
    return out


@pytest.mark.parametrize("p", [0.0, 0.1, 0.6, 1.0])
def test_augmentations_against_plain_loops(spark, p):
    rows = [(k, [k * 1000 + i for i in range(n)]) for k, n in enumerate([0, 1, 2, 3, 5, 9, 17, 40, 150, 400])] + [(99, None)]
    df = spark.createDataFrame(rows, "k long, t array<int>")
    t, k = F.col("t"), F.col("k")
    df = df.withColumn("keep", D.keep_draws(t, k, p))
    got = df.select(
        "k", "t", D.augment_shuffle(t, k, p).alias("shuffled"), D.augment_delete(t, k, p).alias("own"),
        D.augment_delete(t, k, p, keep=F.col("keep")).alias("shared"), D.augment_mask(t, k, 4, p, keep=F.col("keep")).alias("masked"),
    ).collect()
    for r in got:
        if r.t is None:
            assert r.shuffled is None and r.shared is None
            continue
        kept = [draw("0|token", r.k, i) > p for i in range(len(r.t))]
        assert r.own == r.shared == [x for x, keep in zip(r.t, kept) if keep]
        assert r.masked == [x if keep else 4 for x, keep in zip(r.t, kept)]
        assert r.shuffled == brute_shuffle(r.t, r.k, p)


def test_a_long_row_is_shuffled_in_little_more_than_its_length(spark):
    n = 200_000
    df = spark.range(1).select("id", F.sequence(F.lit(0), F.lit(n - 1)).alias("t"))
    start = time.time()
    got = df.select(D.augment_shuffle(F.col("t"), F.col("id")).alias("s")).first()["s"]
    assert sorted(got) == list(range(n)) and time.time() - start < 30
