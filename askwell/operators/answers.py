"""Scoring answers and retrieved lists."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.match import answer_runs, passage_has_answer
from ..functions.text import answer_words, bind

ROUGE_TYPES = ("rouge1", "rouge2", "rougeL", "rougeLsum")


def hit_rate(hit: Column) -> Column:
    """Share of rows whose hit is exactly true."""
    return F.avg(F.coalesce(hit, F.lit(False)).cast("int"))


def accuracy(prediction: Column, labels: Column) -> Column:
    """100 times the share of predictions equal to the first label."""
    same = prediction.eqNullSafe(F.get(labels, F.lit(0)))
    return F.avg(same.cast("int")) * 100


def sequence_exact_match(prediction: Column, reference: Column) -> Column:
    """Share of predicted sequences equal to their reference."""
    return F.avg((prediction == reference).cast("int"))


def label_profile(df: DataFrame, label: str) -> DataFrame:
    """Rows per label value."""
    return df.groupBy(label).agg(F.count("*").alias("rows"))


def dataset_shapes(named: dict[str, DataFrame]) -> DataFrame:
    """``dataset, rows, columns`` of several tables."""
    shapes = [
        d.agg(F.count("*").alias("rows")).select(F.lit(n).alias("dataset"), "rows", F.lit(len(d.columns)).alias("columns"))
        for n, d in named.items()
    ]
    out = shapes[0]
    for shape in shapes[1:]:
        out = out.union(shape)
    return out


#: Items up to which a bag's equals are counted by looking each one up.
SHORT_BAG = 200


def bag_overlap(left: Column, right: Column) -> Column:
    """Common items of two arrays of strings as bags, within the row.

    In short bags each item gets the number of its equals before it, which makes
    bags sets; long ones are sorted together and counted in one pass.
    """

    def told_apart(items: Column) -> Column:
        return bind(F.array_sort(items), lambda s: F.transform(s, lambda x, i: F.concat_ws("\x00", x, (i - F.array_position(s, x)).cast("string"))))

    def merged(l: Column, r: Column) -> Column:
        sides = F.concat(
            F.transform(l, lambda x: F.struct(x.alias("x"), F.lit(1).alias("l"), F.lit(0).alias("r"))),
            F.transform(r, lambda x: F.struct(x.alias("x"), F.lit(0).alias("l"), F.lit(1).alias("r"))),
        )
        start = F.struct(F.lit(None).cast("string").alias("x"), F.lit(0).alias("l"), F.lit(0).alias("r"), F.lit(0).alias("n"))

        def step(s: Column, e: Column) -> Column:
            same = s["x"].eqNullSafe(e["x"])
            n_l, n_r = F.when(same, s["l"]).otherwise(0) + e["l"], F.when(same, s["r"]).otherwise(0) + e["r"]
            # Each item of the scarcer side adds one, when the second side's counterpart arrives.
            gained = F.when((e["r"] == 1) & (n_r <= n_l), 1).otherwise(0)
            return F.struct(e["x"].alias("x"), n_l.alias("l"), n_r.alias("r"), (s["n"] + gained).alias("n"))

        keyed = F.array_sort(F.transform(sides, lambda e: F.struct(e["x"].alias("x"), e["r"].alias("r"), e["l"].alias("l"))))
        return F.aggregate(keyed, start, step, lambda s: s["n"])

    nothing = F.array().cast("array<string>")
    both = F.struct(F.coalesce(left, nothing).alias("l"), F.coalesce(right, nothing).alias("r"))
    return bind(
        both,
        lambda b: F.when(
            F.size(b["l"]) + F.size(b["r"]) <= SHORT_BAG, F.size(F.array_intersect(told_apart(b["l"]), told_apart(b["r"])))
        ).otherwise(merged(b["l"], b["r"])),
    )


def f_measure(common: Column, n_prediction: Column, n_truth: Column) -> Column:
    """Harmonic mean of precision and recall; zero without overlap."""
    precision, recall = common / n_prediction, common / n_truth
    return F.when(common > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def token_f1(df: DataFrame, key: str, prediction: str, truths: str) -> DataFrame:
    """``key, f1``: best bag-overlap F1 of the normalised words over the truths, row by row; null without truths."""

    def best(p: Column) -> Column:
        def one(t: Column) -> Column:
            return bind(answer_words(t), lambda g: f_measure(bag_overlap(p, g), F.size(p), F.size(g)))

        return F.array_max(F.transform(F.col(truths), one))

    return df.select(key, bind(answer_words(F.col(prediction)), best).alias("f1"))


# Hits in retrieved lists.


def context_hits(df: DataFrame, answers: DataFrame) -> DataFrame:
    """Adds ``hit`` to rows ``qid, pos, text``: the passage holds one of its question's answers.

    A question without answers has no hits, but still counts.
    """
    runs = answers.select("qid", answer_runs(F.col("answers")).alias("__runs"))
    hit = F.coalesce(passage_has_answer(F.col("__runs"), F.col("text")), F.lit(False))
    return df.join(runs, "qid", "left").withColumn("hit", hit).drop("__runs")


def hits_at_k(hits: DataFrame) -> DataFrame:
    """``k, n_hits``: questions whose first hit lies within ``k``, up to the first question's depth."""
    per_question = hits.groupBy("qid").agg(
        F.count("*").alias("depth"), F.min(F.when(F.col("hit"), F.col("pos"))).alias("best")
    )
    first = per_question.groupBy((F.col("best") + 1).cast("long").alias("k")).agg(F.count("*").alias("n"))
    ks = per_question.agg(F.min_by("depth", "qid").alias("depth")).select(
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("depth"))).alias("k")
    )
    so_far = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # one row per list position
    return ks.join(first, "k", "left").select("k", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("n_hits"))


def question_hits(hits: DataFrame) -> DataFrame:
    """``qid, hits``: one boolean per listed passage, in list order."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "hit")))
    return hits.groupBy("qid").agg(F.transform(ordered, lambda h: h["hit"]).alias("hits"))


# Rank permutations: item ``i`` of a list has gold rank ``i``.


def rank_permutation(scores: Column) -> Column:
    """Gold ranks in order of falling predicted score; equal scores keep their order."""
    keyed = F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda x: x["i"])


def inversions(ranks: Column) -> Column:
    """Pairs out of order in a list of ranks from 0, in n log n steps per binary digit of the largest.

    A pair is told apart at the highest digit in which its ranks differ. Per
    digit, items of equal higher digits stand together in list order, and each
    one with a 0 counts those with a 1 before it.
    """

    def at_digit(digit: Column) -> Column:
        keyed = F.transform(
            ranks,
            lambda r, i: F.struct(
                F.call_function("shiftright", r, digit + 1).alias("high"), i.alias("i"), F.call_function("shiftright", r, digit).bitwiseAND(F.lit(1)).alias("one")
            ),
        )
        nothing = F.lit(0).cast("long")
        start = F.struct(F.lit(-1).cast("long").alias("high"), nothing.alias("ones"), nothing.alias("pairs"))

        def step(s: Column, x: Column) -> Column:
            high = x["high"].cast("long")
            before = F.when(s["high"] == high, s["ones"]).otherwise(nothing)
            return F.struct(high.alias("high"), (before + x["one"]).alias("ones"), (s["pairs"] + F.when(x["one"] == 0, before).otherwise(nothing)).alias("pairs"))

        return F.aggregate(F.array_sort(keyed), start, step, lambda s: s["pairs"])

    digits = F.sequence(F.lit(0), F.length(F.bin(F.coalesce(F.array_max(ranks), F.lit(0)).cast("long"))) - 1)
    return F.aggregate(F.transform(digits, at_digit), F.lit(0).cast("long"), lambda total, n: total + n)


def topk_overlap(ranks: Column, k: int) -> Column:
    """Share of the predicted top ``k`` that belongs to the gold top ``k``."""
    head = F.slice(ranks, 1, k)
    return F.size(F.filter(head, lambda r: r < k)) / F.size(head)


def depth_to_recover(ranks: Column, k: int) -> Column:
    """List length needed to see every gold top-``k`` item."""
    at = F.array_max(F.transform(ranks, lambda r, i: F.when(r < k, i + 1)))
    return F.coalesce(at, F.size(ranks))


# N-gram and subsequence overlap.


def rouge_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """Contiguous token runs of length ``n``."""
    if n == 1:
        return tokens

    def runs(t: Column) -> Column:
        starts = F.slice(F.sequence(F.lit(1), F.size(t) + 1), F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(0)))
        return F.transform(starts, lambda i: F.array_join(F.slice(t, i, F.lit(n)), " "))

    return bind(tokens, runs)


def rouge_n(df: DataFrame, key: str, prediction: str, reference: str, n: int) -> DataFrame:
    """``key, rouge{n}``: F-measure of n-gram overlap, row by row."""
    grams = F.struct(
        ngrams(rouge_tokens(F.col(prediction)), n).alias("p"), ngrams(rouge_tokens(F.col(reference)), n).alias("r")
    )
    score = bind(grams, lambda g: f_measure(bag_overlap(g["p"], g["r"]), F.size(g["p"]), F.size(g["r"])))
    return df.select(key, score.alias(f"rouge{n}"))


def _tokens(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


#: Table rows between two that are kept.
KEPT_EVERY = 64


def _masks(a: Sequence[str]) -> dict[str, int]:
    places: dict[str, int] = {}
    for i, token in enumerate(a):
        places[token] = places.get(token, 0) | (1 << i)
    return places


def _rows(places: dict[str, int], full: int, row: int, b: Sequence[str]) -> Iterator[int]:
    """Rows of the subsequence table from ``row`` on, one after each token of ``b``: a zero bit where the length rises."""
    yield row
    for token in b:
        match = row & places.get(token, 0)
        row = ((row + match) | (row - match)) & full
        yield row


def subsequence_length(a: Sequence[str], b: Sequence[str]) -> int:
    """Longest common subsequence, one machine-word row at a time."""
    full = (1 << len(a)) - 1
    for row in _rows(_masks(a), full, full, b):
        pass
    return len(a) - row.bit_count()


def _subsequence_places(reference: list[str], candidate: list[str]) -> set[int]:
    """Places in ``reference`` of one longest common subsequence, preferring later candidate tokens.

    Every 64th row is kept; on the way back the rows between two of them are
    computed again, so memory grows with the longer text and not with the table.
    """
    places, full = _masks(reference), (1 << len(reference)) - 1
    marks = [row for j, row in enumerate(_rows(places, full, full, candidate)) if j % KEPT_EVERY == 0]
    near: dict[int, list[int]] = {}

    def length(i: int, j: int) -> int:
        part = j // KEPT_EVERY
        if part not in near:
            begin = part * KEPT_EVERY
            if len(near) > 1:
                del near[max(near)]  # the way back doesn't return to it
            near[part] = list(_rows(places, full, marks[part], candidate[begin : begin + KEPT_EVERY - 1]))
        return i - (near[part][j % KEPT_EVERY] & ((1 << i) - 1)).bit_count()

    found, i, j = set(), len(reference), len(candidate)
    while i and j:
        if reference[i - 1] == candidate[j - 1]:
            i, j = i - 1, j - 1
            found.add(i)
        elif length(i, j - 1) > length(i - 1, j):
            j -= 1
        else:
            i -= 1
    return found


def _harmonic(hits: int, n_prediction: int, n_reference: int) -> float:
    return 2.0 * hits / (n_prediction + n_reference) if hits else 0.0


def rouge_l_score(prediction: str, reference: str) -> float:
    """F-measure of the longest common subsequence of tokens."""
    p, r = _tokens(prediction), _tokens(reference)
    return _harmonic(subsequence_length(r, p), len(p), len(r))


def rouge_lsum_score(prediction: str, reference: str) -> float:
    """The same summed over reference lines, each against the union of all predicted lines."""
    p = [t for t in map(_tokens, prediction.split("\n")) if t]
    r = [t for t in map(_tokens, reference.split("\n")) if t]
    left = Counter(t for line in p for t in line)
    n_prediction, n_reference = sum(left.values()), sum(map(len, r))
    hits = 0
    for line in r:
        union = set().union(*(_subsequence_places(line, other) for other in p)) if p else set()
        for i in sorted(union):
            if left[line[i]] > 0:
                left[line[i]] -= 1
                hits += 1
    return _harmonic(hits, n_prediction, n_reference)


@F.pandas_udf(T.DoubleType())
def rouge_l(prediction: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([rouge_l_score(p, r) for p, r in zip(prediction.fillna(""), reference.fillna(""))])


@F.pandas_udf(T.DoubleType())
def rouge_lsum(prediction: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([rouge_lsum_score(p, r) for p, r in zip(prediction.fillna(""), reference.fillna(""))])


def rouge(
    df: DataFrame, key: str, prediction: str, reference: str, types: Sequence[str] = ROUGE_TYPES
) -> DataFrame:
    """``key`` and one column per type. ``df`` has one row per key."""
    both = (F.col(prediction), F.col(reference))
    direct = {"rougeL": rouge_l(*both), "rougeLsum": rouge_lsum(*both)}
    out = df.select(key, *[direct[t].alias(t) for t in types if t in direct])
    for name in types:
        if name not in direct:
            out = out.join(rouge_n(df, key, prediction, reference, int(name.removeprefix("rouge"))), key)
    return out.select(key, *types)


# Bootstrap.

UNIT = 1 << 32
#: Draws that one digest gives, and rows drawn at once.
DRAWS, DRAWN_ROWS = 4, 256


def poisson_steps() -> list[int]:
    """Where a 32-bit uniform passes from one Poisson(1) draw to the next."""
    steps, term, total, n = [], math.exp(-1.0), 0.0, 0
    while not steps or steps[-1] < UNIT - 1:
        total += term
        n += 1
        term /= n
        steps.append(min(UNIT - 1, math.floor(total * UNIT)))
    return steps


def poisson_copies(prefixes: Sequence[str], resamples: int, steps: np.ndarray) -> np.ndarray:
    """Copies of each row (rows down, resamples across): a digest of prefix and block gives ``DRAWS`` of them."""
    ends = [f"|{b}".encode() for b in range(-(-resamples // DRAWS))]
    digests = b"".join(hashlib.md5(p + e).digest() for p in (x.encode() for x in prefixes) for e in ends)
    units = np.frombuffer(digests, ">u4").reshape(len(prefixes), -1)[:, :resamples]
    return np.searchsorted(steps, units.astype(np.int64), side="right")


def bootstrap_mid(df: DataFrame, key: str, scores: Sequence[str], resamples: int = 1000, seed: int = 0) -> DataFrame:
    """``metric, mid``: median of the mean over resampled rows.

    A row's number of copies in each resample is a Poisson draw from the digest
    of seed, key and resample, drawn a batch at a time, so a task sends one partial sum per
    resample and no rows. Rows of one key are drawn together; null scores count as absent.
    """
    names = list(scores)
    parts = df.sparkSession.sparkContext.defaultParallelism
    prefix = F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).alias("__prefix")
    values = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(f"v{i}") for i, n in enumerate(names)]
    given = [F.col(n).isNotNull().alias(f"g{i}") for i, n in enumerate(names)]
    # Rows are few bytes and much work, so even a small table goes to all cores.
    rows = df.select(prefix, *values, *given).repartition(parts)
    sums = [f"s{i}" for i in range(len(names))] + [f"n{i}" for i in range(len(names))]
    steps = np.array(poisson_steps(), np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drawn, total = np.zeros(resamples, np.int64), np.zeros((2 * len(names), resamples))
        for batch in batches:
            for at in range(0, len(batch), DRAWN_ROWS):
                part = batch.iloc[at : at + DRAWN_ROWS]
                copies = poisson_copies(part["__prefix"].tolist(), resamples, steps)
                drawn += copies.sum(axis=0)
                for i in range(len(names)):
                    value, some = part[f"v{i}"].to_numpy(float), part[f"g{i}"].to_numpy(bool)
                    finite = np.isfinite(value)
                    total[i] += np.where(finite, value, 0.0) @ copies
                    for j in np.flatnonzero(~finite):
                        total[i] += np.where(copies[j] > 0, value[j], 0.0)
                    total[len(names) + i] += some.astype(float) @ copies
        yield pd.DataFrame({"resample": np.arange(resamples), "drawn": drawn} | dict(zip(sums, total)))

    schema = "resample long, drawn long, " + ", ".join(f"{c} double" for c in sums)
    added = rows.mapInPandas(run, schema).groupBy("resample").agg(F.sum("drawn").alias("drawn"), *[F.sum(c).alias(c) for c in sums])
    total = added.filter("drawn > 0").select(
        "resample", *[F.when(F.col(f"n{i}") > 0, F.col(f"s{i}") / F.col(f"n{i}")).alias(n) for i, n in enumerate(names)]
    )
    means = total.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("mean")) for n in names])))
    return means.groupBy("metric").agg(F.percentile("mean", 0.5).alias("mid"))
