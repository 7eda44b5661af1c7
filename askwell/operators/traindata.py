"""Training data: sampling, token arrays and batches.

All randomness is a function of a seed and a row's key, so any task can be run
again and gives the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bind, normalize_text, seeded, strip_suffix, uniform, uniform_above, uniform_below, uniform_key
from .ordering import running_total, with_position
from .prepare import passage_text

IGNORED = -100


def word_ids(text: Column, vocabulary: int = 30000, first: int = 5) -> Column:
    """Ids of the blank-separated words, the built-in stand-in for a subword tokenizer."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.transform(
        words,
        lambda w: (F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("long") % (vocabulary - first) + first).cast("int"),
    )


# Contrastive examples.


def negative_quota(
    key: Column,
    random_pool: Column,
    hard_pool: Column,
    negatives: int = 1,
    hard_ratio: float = 0.0,
    hard_min_idx: int = 0,
    seed: int = 0,
) -> Column:
    """``(n_hard, n_random)``: hard ones by independent draws, both capped by what is there."""
    draws = F.transform(F.array_repeat(F.lit(0), negatives), lambda _, i: uniform(f"{seed}|quota", key, i))
    wanted = F.size(F.filter(draws, lambda u: u < hard_ratio))
    hard_left = F.greatest(F.coalesce(F.size(hard_pool), F.lit(0)) - hard_min_idx, F.lit(0))
    n_hard = F.when(hard_pool.isNull(), 0).otherwise(F.least(wanted, hard_left))
    n_random = F.when(random_pool.isNull(), 0).otherwise(F.least(F.lit(negatives) - n_hard, F.size(random_pool)))
    return F.struct(n_hard.alias("n_hard"), n_random.alias("n_random"))


def draw_from(pool: Column, n: Column, tag: str, key: Column, seed: int = 0) -> Column:
    """``n`` entries of an array without replacement, in the order drawn."""
    keyed = F.transform(
        pool, lambda x, i: F.struct(F.md5(F.concat_ws("|", F.lit(f"{seed}|{tag}"), key, i)).alias("u"), x.alias("x"))
    )
    return F.transform(F.slice(F.array_sort(keyed), F.lit(1), n), lambda e: e["x"])


def sample_triples(
    df: DataFrame,
    key: str = "id",
    training: bool = True,
    negatives: int = 1,
    hard_ratio: float = 0.0,
    hard_min_idx: int = 0,
    seed: int = 0,
) -> DataFrame:
    """``key, question, gold, negatives`` with contexts as structs.

    Training draws one positive and the quota of negatives; evaluation takes
    the first of each.
    """
    nothing = F.slice("positive_ctxs", 1, 0)
    if not training:
        first = F.slice("negative_ctxs", 1, 1)
        return df.select(
            key, "question", F.get("positive_ctxs", F.lit(0)).alias("gold"), F.coalesce(first, nothing).alias("negatives")
        )
    id_ = F.col(key).cast("string")
    quota = negative_quota(
        id_, F.col("negative_ctxs"), F.col("hard_negative_ctxs"), negatives, hard_ratio, hard_min_idx, seed
    )
    staged = df.withColumn("__quota", quota)
    pick = F.floor(uniform(f"{seed}|gold", id_) * F.size("positive_ctxs")).cast("int")
    hard = F.col("hard_negative_ctxs")
    if hard_min_idx:
        hard = F.slice(hard, F.lit(hard_min_idx + 1), F.greatest(F.size(hard), F.lit(0)))
    drawn = F.concat(
        F.coalesce(draw_from(F.col("negative_ctxs"), F.col("__quota.n_random"), "random", id_, seed), nothing),
        F.coalesce(draw_from(hard, F.col("__quota.n_hard"), "hard", id_, seed), nothing),
    )
    return staged.select(key, "question", F.get("positive_ctxs", pick).alias("gold"), drawn.alias("negatives"))


def normalize_triples(triples: DataFrame, key: str = "id") -> DataFrame:
    """``key, query, gold, negatives`` as plain normalised texts."""

    def plain(ctx: Column) -> Column:
        return normalize_text(passage_text(ctx["title"], ctx["text"]))

    return triples.select(
        key,
        normalize_text(F.col("question")).alias("query"),
        plain(F.col("gold")).alias("gold"),
        F.transform("negatives", plain).alias("negatives"),
    )


def with_batch(df: DataFrame, size: int, order: str) -> DataFrame:
    """Adds ``batch`` (0-based) and ``slot`` of each row in order."""
    at = F.col("__pos") - 1
    placed = with_position(df, order, name="__pos")
    return placed.withColumn("batch", F.floor(at / F.lit(size)).cast("long")).withColumn("slot", at % size).drop("__pos")


def batch_layout(triples: DataFrame, size: int, order: str) -> DataFrame:
    """``batch, queries, passages``: golds of a batch first, then all its negatives."""
    rows = F.array_sort(F.collect_list(F.struct("slot", "query", "gold", "negatives")))  # at most ``size``
    grouped = with_batch(triples, size, order).groupBy("batch").agg(rows.alias("rows"))
    golds = F.transform("rows", lambda r: r["gold"])
    negatives = F.flatten(F.transform("rows", lambda r: r["negatives"]))
    return grouped.select(
        "batch", F.transform("rows", lambda r: r["query"]).alias("queries"), F.concat(golds, negatives).alias("passages")
    )


# Token arrays.


def chunk_tokens(tokens: Column, length: int, offset: int = 0) -> Column:
    """Chunks of one array after ``offset``; the short tail is dropped."""
    def chunks(t: Column) -> Column:
        n = F.floor((F.size(t) - offset) / F.lit(length)).cast("int")
        starts = F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), F.lit(1), F.greatest(n, F.lit(0)))
        return F.transform(starts, lambda i: F.slice(t, i * length + offset + 1, F.lit(length)))

    return bind(tokens, chunks)


def random_offset(length: int, seed: int = 0) -> Column:
    """Offset below ``length`` drawn from the seed."""
    return F.floor(uniform(f"{seed}|offset") * length).cast("int")


def chunk_stream(df: DataFrame, order: str, length: int, offset: int = 0, tokens: str = "tokens") -> DataFrame:
    """``chunk, tokens``: all rows' tokens laid end to end in order and cut into chunks.

    Each row's start comes from running totals; a row sends every chunk it
    touches one slice, and a chunk gathers at most ``length`` tokens.
    """
    sized = df.select(order, F.col(tokens).alias("tokens"), F.size(tokens).cast("long").alias("__n")).filter("__n > 0")
    ends = running_total(sized.select(order, "__n"), F.col("__n"), order, name="__end").select(order, "__end")
    placed = sized.join(ends, order).withColumn("__start", F.col("__end") - F.col("__n") - offset)
    touched = F.sequence(
        F.floor(F.greatest(F.col("__start"), F.lit(0)) / F.lit(length)).cast("long"),
        F.floor((F.col("__start") + F.col("__n") - 1) / F.lit(length)).cast("long"),
    )
    pieces = (
        placed.filter(F.col("__start") + F.col("__n") > 0)
        .withColumn("chunk", F.explode(touched))
        .withColumn("__from", F.greatest(F.col("chunk") * length - F.col("__start"), -F.col("__start"), F.lit(0)))
        .withColumn("__to", F.least((F.col("chunk") + 1) * length - F.col("__start"), F.col("__n")))
        .select(
            "chunk",
            (F.col("__start") + F.col("__from")).alias("at"),
            F.slice("tokens", (F.col("__from") + 1).cast("int"), (F.col("__to") - F.col("__from")).cast("int")).alias("part"),
        )
    )
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda p: p["part"]))
    return pieces.groupBy("chunk").agg(whole.alias("tokens")).filter(F.size("tokens") == length)


def random_crop(tokens: Column, key: Column, view: str, ratio_min: float, ratio_max: float, seed: int = 0) -> Column:
    """A run of random relative length at a random place."""
    ratio = uniform(f"{seed}|ratio|{view}", key) * (ratio_max - ratio_min) + ratio_min
    length = F.floor(F.size(tokens) * ratio).cast("int")
    start = F.floor(uniform(f"{seed}|start|{view}", key) * (F.size(tokens) - length + 1)).cast("int")
    return F.slice(tokens, start + 1, length)


def crop_views(df: DataFrame, key: str, ratio_min: float, ratio_max: float, seed: int = 0) -> DataFrame:
    """Two independent crops, ``q_tokens`` and ``k_tokens``."""
    k = F.col(key).cast("string")
    return df.withColumn("q_tokens", random_crop(F.col("tokens"), k, "q", ratio_min, ratio_max, seed)).withColumn(
        "k_tokens", random_crop(F.col("tokens"), k, "k", ratio_min, ratio_max, seed)
    )


def keep_draws(tokens: Column, key: Column, p: float = 0.1, seed: int = 0) -> Column:
    """Whether each token is left as it is; a column of it serves all augmentations of one seed."""
    return bind(seeded(f"{seed}|token", key), lambda s: F.transform(tokens, lambda x, i: uniform_above(p, s, i)))


def _keep(keep: Column | None, key: Column, i: Column, p: float, seed: int) -> Column:
    return uniform_above(p, f"{seed}|token", key, i) if keep is None else F.get(keep, i)


def augment_delete(tokens: Column, key: Column, p: float = 0.1, seed: int = 0, keep: Column | None = None) -> Column:
    """Drop each token with probability ``p``, or as ``keep_draws`` says."""
    return F.filter(tokens, lambda x, i: _keep(keep, key, i, p, seed))


def augment_replace(
    tokens: Column, key: Column, low: int, high: int, p: float = 0.1, seed: int = 0, keep: Column | None = None
) -> Column:
    """Swap each token with probability ``p``, or as ``keep_draws`` says, for a random id in ``low..high``."""

    def swap(x: Column, i: Column) -> Column:
        other = F.floor(uniform(f"{seed}|other", key, i) * (high - low + 1)).cast("int") + low
        return F.when(_keep(keep, key, i, p, seed), x).otherwise(other)

    return F.transform(tokens, swap)


def augment_mask(tokens: Column, key: Column, mask_id: int, p: float = 0.1, seed: int = 0, keep: Column | None = None) -> Column:
    """Swap each token with probability ``p``, or as ``keep_draws`` says, for the mask id."""
    return F.transform(tokens, lambda x, i: F.when(_keep(keep, key, i, p, seed), x).otherwise(F.lit(mask_id)))


def augment_shuffle(tokens: Column, key: Column, p: float = 0.1, seed: int = 0) -> Column:
    """Permute a binomial number of a row's tokens among their places; only these and their like are sorted."""

    def dealt(places: Column, tag: str) -> Column:
        def keyed(s: Column) -> Column:
            return F.transform(places, lambda i: F.struct(uniform_key(s, i).alias("u"), i.alias("i")))

        return F.transform(F.sort_array(bind(seeded(f"{seed}|{tag}", key), keyed)), lambda e: e["i"])

    def move(to: Column, source: Column) -> Column:
        return F.struct(to.alias("to"), source.alias("source"))

    def shuffled(t: Column) -> Column:
        places = F.transform(t, lambda x, i: i)
        hits = bind(seeded(f"{seed}|count", key), lambda s: F.filter(places, lambda i: uniform_below(p, s, i)))

        def first(n: Column) -> Column:
            """The n first places: they are among those with a low draw, unless these are fewer."""
            low = bind(seeded(f"{seed}|place", key), lambda s: F.filter(places, lambda i: uniform_below(2 * p, s, i)))
            every = bind(low, lambda s: dealt(F.when(F.size(s) >= n, s).otherwise(places), "place"))
            return F.slice(every, F.lit(1), n)

        def swapped(moves: Column) -> Column:
            """The tokens between two moved ones stay."""

            def piece(m: Column, k: Column) -> Column:
                begin = F.coalesce(F.get(moves, k - 1)["to"] + 1, F.lit(0))
                return F.concat(F.slice(t, begin + 1, m["to"] - begin), F.array(F.get(t, m["source"])))

            end = F.coalesce(F.get(moves, F.size(moves) - 1)["to"] + 1, F.lit(0))
            return F.concat(F.flatten(F.transform(moves, piece)), F.slice(t, end + 1, F.size(t)))

        chosen = bind(F.size(hits), first)
        return bind(bind(chosen, lambda to: F.sort_array(F.zip_with(to, dealt(to, "deal"), move))), swapped)

    return bind(tokens, shuffled)


def add_bos_eos(tokens: Column, bos: int | None, eos: int | None) -> Column:
    """Begin and end ids around the tokens; either may be absent."""
    parts = [tokens]
    if bos is not None:
        parts.insert(0, F.array(F.lit(bos)))
    if eos is not None:
        parts.append(F.array(F.lit(eos)))
    return F.concat(*parts) if len(parts) > 1 else tokens


def pad_mask(df: DataFrame, tokens: str, batch: str = "batch") -> DataFrame:
    """Pad with zeros to the longest row of the batch; ``mask`` is true on real tokens."""
    longest = df.groupBy(batch).agg(F.max(F.size(tokens)).alias("__longest"))
    gap = F.col("__longest") - F.size(tokens)
    joined = df.join(longest, batch)
    mask = F.concat(F.array_repeat(F.lit(True), F.size(tokens)), F.array_repeat(F.lit(False), gap))
    return (
        joined.withColumn("mask", mask)
        .withColumn(tokens, F.concat(tokens, F.array_repeat(F.lit(0), gap)))
        .drop("__longest")
    )


# Mixtures.


def mixture_weights(df: DataFrame, dataset: str, coeff: float = 0.0) -> DataFrame:
    """``dataset, n, p``: share of each set raised to ``coeff`` and renormalised."""
    counts = df.groupBy(dataset).agg(F.count("*").alias("n"))
    every = Window.partitionBy()  # one row per dataset
    raised = F.pow(F.col("n") / F.sum("n").over(every), F.lit(coeff))
    return counts.withColumn("raised", raised).select(
        dataset, "n", (F.col("raised") / F.sum("raised").over(every)).alias("p")
    )


def sample_mixture(
    df: DataFrame, n: int, dataset: str, key: str, coeff: float = 0.0, seed: int = 0
) -> DataFrame:
    """``draw, dataset_id, key``: draw a set by its weight, then one of its rows uniformly.

    Sets are few and travel as one sorted array; a row is found by its number
    within its set, so draws and rows meet in an equi-join.
    """
    marks = Window.orderBy(dataset).rowsBetween(Window.unboundedPreceding, 0)
    bounds = mixture_weights(df, dataset, coeff).select(
        F.sum("p").over(marks).alias("upto"), F.col(dataset).alias("set"), "n"
    )
    sets = bounds.agg(F.array_sort(F.collect_list(F.struct("upto", "set", "n"))).alias("sets"))
    spark = df.sparkSession
    draws = spark.range(n).withColumnRenamed("id", "draw").withColumn("__one", F.lit(1))
    u, v = uniform(f"{seed}|set", F.col("draw")), uniform(f"{seed}|row", F.col("draw"))
    chosen = F.coalesce(
        F.get(F.filter("sets", lambda s: s["upto"] > F.col("u")), F.lit(0)), F.element_at("sets", -1)
    )
    placed = (
        draws.withColumn("u", u)
        .join(F.broadcast(sets.withColumn("__one", F.lit(1))), "__one")
        .withColumn("chosen", chosen)
        .select(
            "draw",
            F.col("chosen.set").alias("dataset_id"),
            (F.floor(v * F.col("chosen.n")) + 1).cast("long").alias("__pos"),
        )
    )
    rows = with_position(df.select(dataset, key), key, by=[dataset], name="__pos").withColumnRenamed(dataset, "dataset_id")
    return placed.join(rows, ["dataset_id", "__pos"]).select("draw", "dataset_id", key)


# Completion encoding.


def encode_completion(
    df: DataFrame, prompt: str, target: str, max_len: int, eos: str = "</s>", vocabulary: int = 30000
) -> DataFrame:
    """Adds ``input_ids, labels, attention_mask`` and the prompt's length.

    Labels of all but the last prompt token are ignored.
    """
    closed = F.concat(strip_suffix(F.col(target), eos), F.lit(" " + eos))
    prompt_ids = word_ids(F.col(prompt), vocabulary)
    staged = (
        df.withColumn("__prompt", prompt_ids)
        .withColumn("input_ids", F.slice(F.concat("__prompt", word_ids(closed, vocabulary)), 1, max_len))
        .withColumn("prompt_len", F.least(F.size("__prompt"), F.lit(max_len)))
    )
    hidden = F.greatest(F.col("prompt_len") - 1, F.lit(0))
    labels = F.concat(
        F.array_repeat(F.lit(IGNORED), hidden), F.slice("input_ids", hidden + 1, F.size("input_ids"))
    )
    return (
        staged.withColumn("labels", labels)
        .withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
        .drop("__prompt")
    )


def mask_between(df: DataFrame, open_id: int, close_id: int, labels: str = "labels", start: str = "prompt_len") -> DataFrame:
    """Ignore labels strictly between the first open and the last close marker after the prompt.

    Without a close marker, and again for an open marker after the last close,
    everything up to the final token is ignored.
    """

    def places(values: Column, marker: int) -> Column:
        at = F.transform(values, lambda x, i: F.when((x == marker) & (i >= F.col(start)), i))
        return F.filter(at, lambda i: i.isNotNull())

    def bounds(values: Column) -> Column:
        opens, closes = places(values, open_id), places(values, close_id)
        first = F.array_min(opens)
        close = bind(first, lambda o: F.array_max(F.filter(closes, lambda i: i >= o)))
        again = bind(close, lambda c: F.array_min(F.filter(opens, lambda i: i > c)))
        return F.struct(
            first.alias("open"), close.alias("close"), again.alias("again"), (F.size(values) - 1).alias("end")
        )

    def hidden(b: Column, i: Column) -> Column:
        one = (i > b["open"]) & (i < F.coalesce(b["close"], b["end"]))
        two = (i > b["again"]) & (i < b["end"])
        return F.coalesce(one, F.lit(False)) | F.coalesce(two, F.lit(False))

    def masked(values: Column) -> Column:
        return bind(
            bounds(values),
            lambda b: F.transform(values, lambda x, i: F.when(hidden(b, i), F.lit(IGNORED)).otherwise(x)),
        )

    return df.withColumn(labels, bind(F.col(labels), masked))


def drop_fully_masked(df: DataFrame, labels: str = "labels") -> DataFrame:
    """Rows with at least one label that counts."""
    return df.filter(F.exists(labels, lambda x: x != IGNORED))


def split_train_eval(df: DataFrame, key: str, eval_share: float = 0.1, seed: int = 0) -> DataFrame:
    """Adds ``split`` (``train`` or ``eval``), fixed by key and seed."""
    return df.withColumn("split", F.when(uniform(f"{seed}|split", F.col(key)) < eval_share, "eval").otherwise("train"))


def shuffle_rows(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """All rows in a repeatable random order."""
    return df.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))).orderBy(
        "shuffle_key", key
    )


def concat_encoded(first: DataFrame, second: DataFrame, columns: Sequence[str] = ("input_ids", "labels", "attention_mask")) -> DataFrame:
    """Second encoded set after the first."""
    return first.select(*columns).unionByName(second.select(*columns))


def rolling_negative_queue(keys: DataFrame, queue_size: int, batch_size: int, order: str) -> DataFrame:
    """``batch, ...``: for each batch, the rows of the batches its fixed-size queue still holds.

    A row sits in the queue for ``queue_size / batch_size`` batches, so it is
    copied that often and no batch is joined with another.
    """
    if queue_size % batch_size:
        raise ValueError(f"queue of {queue_size} does not hold whole batches of {batch_size}")
    stays = queue_size // batch_size
    last = math.ceil(keys.count() / batch_size) - 1
    placed = with_batch(keys, batch_size, order).drop("slot").withColumnRenamed("batch", "key_batch")
    until = F.least(F.col("key_batch") + stays, F.lit(last))
    return placed.filter(F.col("key_batch") < last).withColumn("batch", F.explode(F.sequence(F.col("key_batch") + 1, until)))
