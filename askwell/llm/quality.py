"""Quality rules by robust multivariate outliers: minimum covariance determinant per language and source."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, broadcast_within, kept, mix64, null_safe, utf8

SYMBOLS = b"#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = [*STATS, "n_lines"]


def repeated_words(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Words per text that lie in a three-word window found twice or more in that text.

    ``ids`` holds the word numbers of all texts in a row, ``sizes`` their counts.
    """
    found = np.zeros(len(sizes), np.int64)
    if len(ids) < 3:
        return found
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inside = owner[2:] == owner[:-2]
    a, b, c, doc = ids[:-2][inside], ids[1:-1][inside], ids[2:][inside], owner[2:][inside]
    place = np.flatnonzero(inside)
    # Equal windows have equal scrambles: only those seen twice go into the exact comparison.
    scramble = mix64(mix64(mix64(a) + b.astype(np.uint64)) + c.astype(np.uint64)) + mix64(doc + 1)
    ordered = np.sort(scramble)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return found
    at = np.searchsorted(twice, scramble)
    maybe = np.flatnonzero(twice[np.minimum(at, len(twice) - 1)] == scramble)
    order = maybe[np.lexsort((c[maybe], b[maybe], a[maybe], doc[maybe]))]
    rows = np.stack([doc[order], a[order], b[order], c[order]])
    same = (rows[:, 1:] == rows[:, :-1]).all(axis=0)
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    starts = place[order[again]]
    covered = np.zeros(len(ids), bool)
    for step in range(3):
        covered[starts + step] = True
    return np.bincount(owner[covered], minlength=len(sizes))


def measure(texts: list) -> dict[str, np.ndarray]:
    """The statistics of whole texts; null and empty texts have zeros."""
    data = utf8(texts)
    out = {name: np.zeros(len(data), np.int64) for name in MEASURES}
    for start, end in blocks([len(d) for d in data]):
        number = defaultdict(count().__next__)
        words = [d.split() for d in data[start:end]]
        sizes = np.array([len(w) for w in words], np.int64)
        ids = np.array([number[w] for ws in words for w in ws], np.int64)
        out["n_words"][start:end] = sizes
        out["n_repeat_words"][start:end] = repeated_words(ids, sizes)
        for i, d in enumerate(data[start:end], start):
            points = len(texts[i]) if d else 0
            out["word_chars"][i] = points - sum(d.count(blank) for blank in b" \t\n\v\f\r")
            out["n_symbols"][i] = sum(d.count(symbol) for symbol in SYMBOLS)
            lines = [line for line in d.split(b"\n") if line.strip()]
            out["n_lines"][i] = len(lines)
            out["n_dup_lines"][i] = len(lines) - len(set(lines))
    return out


#: Scales below which a measure never counts as spread: logarithm of word length,
#: logarithm of symbols per hundred characters, shares of repeated lines and words.
FLOORS = [0.06, 0.25, 0.12, 0.12]
#: Chi-square quantile at 0.999999 with four degrees of freedom.
CUT = 33.4
#: Share of a group's rows that the estimate rests on, and what makes it consistent for normal data.
CORE, CORRECTION = 0.75, 1.486
MIN_GROUP = 40
STEPS = 4

X = [f"__x{i}" for i in range(len(FLOORS))]
PAIRS = [(i, j) for i in range(len(X)) for j in range(i, len(X))]
CENTRE = [f"__m{i}" for i in range(len(X))]
PRECISION = [f"__p{i}{j}" for i, j in PAIRS]
MODEL = [*CENTRE, *PRECISION]


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics of a row with at least one word."""
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    return [
        F.log(chars / words).alias(X[0]),
        F.log1p(100 * F.col("n_symbols") / chars).alias(X[1]),
        (F.col("n_dup_lines") / lines).alias(X[2]),
        (F.col("n_repeat_words") / words).alias(X[3]),
    ]


def distance() -> Column:
    """Squared Mahalanobis distance of a row's vector under the model beside it."""
    off = [F.col(x) - F.col(m) for x, m in zip(X, CENTRE)]
    terms = [(1 if i == j else 2) * off[i] * off[j] * F.col(p) for (i, j), p in zip(PAIRS, PRECISION)]
    return sum(terms[1:], terms[0])


def measured(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of every row with the statistics of its text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            stats = pd.DataFrame(measure(batch.iloc[:, -1].tolist()))
            yield pd.concat([batch.iloc[:, : len(keep)].reset_index(drop=True), stats], axis=1)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    schema = ", ".join([*fields, *[f"{m} long" for m in MEASURES]])
    return docs.select(*keep, F.col(text).alias("__text")).mapInPandas(run, schema)


def _invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of a group's core rows to its centre and precision matrix."""
    for batch in batches:
        rows = []
        for row in batch.itertuples(index=False):
            n, first, second = row[1], np.array(row[2 : 2 + len(X)]), row[2 + len(X) :]
            centre = first / n
            spread = np.zeros((len(X), len(X)))
            for (i, j), value in zip(PAIRS, second):
                spread[i, j] = spread[j, i] = value / n - centre[i] * centre[j]
            spread = np.round(CORRECTION * spread, 10) + np.diag(np.square(FLOORS))
            precision = np.linalg.inv(spread)
            rows.append([row[0], *np.round(centre, 10), *[precision[i, j] for i, j in PAIRS]])
        yield pd.DataFrame(rows, columns=["__group", *MODEL])


def fit(stats: DataFrame) -> DataFrame:
    """Centre and precision per ``lang`` and ``source`` of a measured table.

    Minimum covariance determinant: from coordinate-wise medians, concentration
    steps refit each group on its closest three quarters of rows, found by an
    exact histogram of distances, so no row is sampled and no group gathered.
    Groups under ``MIN_GROUP`` rows pool by language, then together. Rows that
    fail the base rules take no part.
    """
    names = ["lang", "source"]
    sizes = stats.groupBy(*names).agg(F.sum((~base_failed()).cast("long")).alias("__n"))
    by_lang = sizes.groupBy("lang").agg(F.sum("__n").alias("__nl"))
    pooled = sizes.join(by_lang, sizes["lang"].eqNullSafe(by_lang["lang"])).drop(by_lang["lang"])
    label = (
        F.when(F.col("__n") >= MIN_GROUP, F.to_json(F.struct(*names)))
        .when(F.col("__nl") >= MIN_GROUP, F.to_json(F.struct("lang")))
        .otherwise("all")
    )
    groups = kept(pooled.select(*names, label.alias("__group")))
    sound = stats.filter(~base_failed())
    small = broadcast_within(groups)
    rows = kept(sound.join(small, null_safe(sound, groups, names)).select(F.col("__group"), *vector()))

    middle = [F.percentile_approx(x, 0.5, 10000).alias(m) for x, m in zip(X, CENTRE)]
    medians = kept(rows.groupBy("__group").agg(*middle))
    off = [F.percentile_approx(F.abs(F.col(x) - F.col(m)), 0.5, 10000).alias(x) for x, m in zip(X, CENTRE)]
    mads = rows.join(broadcast_within(medians), "__group").groupBy("__group").agg(*off, *[F.first(m).alias(m) for m in CENTRE])
    diagonal = [
        F.lit(0.0) if i != j else 1 / (F.pow(1.4826 * F.col(X[i]), 2) + FLOORS[i] ** 2) for i, j in PAIRS
    ]
    model = kept(mads.select("__group", *CENTRE, *[d.alias(p) for d, p in zip(diagonal, PRECISION)]))
    for _ in range(STEPS):
        scored = rows.join(broadcast_within(model), "__group").withColumn("__bin", F.floor(64 * F.log2(1 + distance())))
        counts = scored.groupBy("__group", "__bin").agg(F.count("*").alias("__c"))
        held = counts.groupBy("__group").agg(F.array_sort(F.collect_list(F.struct("__bin", "__c"))).alias("__h"))
        # The smallest bin up to which the group's core share of rows lies.
        total = F.aggregate("__h", F.lit(0).cast("long"), lambda a, e: a + e["__c"])
        walk = F.aggregate(
            "__h",
            F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).cast("long").alias("cut")),
            lambda a, e: F.when(a["seen"] >= CORE * F.col("__t"), a).otherwise(
                F.struct((a["seen"] + e["__c"]).alias("seen"), e["__bin"].alias("cut"))
            ),
        )
        cuts = kept(held.withColumn("__t", total).select("__group", walk["cut"].alias("__cut")))
        core = scored.join(broadcast_within(cuts), "__group").filter("__bin <= __cut")
        sums = core.groupBy("__group").agg(
            F.count("*").alias("__n"),
            *[F.sum(x).alias(f"__s{i}") for i, x in enumerate(X)],
            *[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"__q{i}{j}") for i, j in PAIRS],
        )
        model = kept(sums.mapInPandas(_invert, "__group string, " + ", ".join(f"{c} double" for c in MODEL)))
    return kept(groups.join(model, "__group", "left").drop("__group"))


def verdict(stats: DataFrame, rules: DataFrame) -> DataFrame:
    """``base_failed`` and ``kept`` beside a measured table; rows without a model follow the base rules."""
    names = ["lang", "source"]
    both = stats.withColumns({x: v for x, v in zip(X, vector())}).join(
        broadcast_within(rules), null_safe(stats, rules, names), "left"
    )
    keep = ~base_failed() & (F.coalesce(distance(), F.lit(0.0)) <= CUT)
    return both.select(*[stats[c] for c in stats.columns], base_failed().alias("base_failed"), keep.alias("kept"))


def judge(docs: DataFrame) -> DataFrame:
    """Statistics and verdict of every row of ``docs`` (doc_id, text, lang, source).

    Null, empty and blank texts have no words and fail; null languages and
    sources are values of their own; repeated rows get equal verdicts; other
    columns are ignored; an empty table gives an empty result.
    """
    stats = kept(measured(docs, ["doc_id", "lang", "source"]))
    return verdict(stats, fit(stats)).select("doc_id", *STATS, "base_failed", "kept")


def keep_sound(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    The statistics are taken once for the fit and once beside the rows: texts
    are never shuffled.
    """
    rules = fit(kept(measured(docs, ["lang", "source"])))
    boxed = docs.select(F.struct("*").alias("__row"), "lang", "source", "text")
    judged = verdict(measured(boxed, ["__row", "lang", "source"]), rules)
    return judged.filter("kept").select("__row.*")
