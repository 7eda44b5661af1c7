"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-word blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_within, kept, null_safe, partitions

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
#: Words in a block, and words that a shard of a source holds at about most.
BLOCK = 16
SHARD = 1 << 18


def words_in(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``__place`` from 0 in a total order: ranges are sorted apart, then counted together."""
    n = partitions(rows.sparkSession)
    local = kept(
        rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    )
    part = F.shiftrightunsigned("__id", 33)
    sizes = local.groupBy(part.alias("__part")).agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__before"))  # one row per range
    inside = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        local.withColumn("__part", part).join(F.broadcast(starts), "__part")
        .withColumn("__place", F.col("__before") + inside).drop("__id", "__part", "__before")
    )


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources in code-point order, null last, weigh ``weights`` in turn. What a
    source gets stops at ``most`` times its size; the rest goes to the others by
    weight, until none is above.
    """
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("__place") % len(weights) + 1).cast("int"))
    order = [F.col("source").isNull(), F.col("source")]
    table = kept(numbered(sizes, *order).select("source", "source_size", turn.alias("weight")))
    cap = F.col("source_size") * most
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, F.lit(False)
    while True:
        row = table.select(
            F.sum(F.when(full, cap).otherwise(0.0)).alias("fixed"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.sum(full.cast("long")).alias("n"),
        ).first()
        if not row["open"]:
            break
        level = (total - row["fixed"]) / row["open"]
        above = full | (F.col("weight") * level > cap)
        if table.filter(above).count() == row["n"]:
            break
        full = F.col("weight") * level > cap
    return table.select("source", "source_size", F.when(full, cap).otherwise(F.col("weight") * level).alias("target"))


def seats(rows: DataFrame, house: list[str], share: str, bound: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the seats each gets of its house's ``__seats`` by highest quotients.

    Sainte-Laguë: a row competes with the quotients share / (2k - 1), and a
    house's seats go to its highest ones. Seats that every divisor which could
    separate them would give are given at once; only the few quotients between
    the two extreme divisors are ranked. No row gets more than its ``bound``.
    """
    total = F.sum(share).over(Window.partitionBy(*house))
    n = F.count("*").over(Window.partitionBy(*house))
    sure = F.when(
        F.col("__seats") > n / 2, F.floor(F.col(share) * (F.col("__seats") - n / 2) / total + 0.5)
    ).otherwise(F.lit(0))
    most = F.floor(F.col(share) * (F.col("__seats") + n / 2) / total + 0.5) + 1
    ready = rows.withColumn("__sure", F.coalesce(sure, F.lit(0)).cast("long")).withColumn(
        "__most", F.coalesce(most, F.lit(0)).cast("long")
    )
    ready = kept(ready.withColumn("__open", F.col("__seats") - F.sum("__sure").over(Window.partitionBy(*house))))
    step = F.explode(F.sequence(F.col("__sure") + 1, F.greatest("__most", F.col("__sure") + 1)))
    quotient = F.col(share) / (2 * F.col("__k") - 1)
    rank = F.row_number().over(Window.partitionBy(*house).orderBy(quotient.desc(), "__row"))
    won = (
        ready.select(*house, share, "__row", "__sure", "__open", step.alias("__k"))
        .withColumn("__rank", rank).filter("__rank <= __open").groupBy("__row").agg(F.count("*").alias("__more"))
    )
    got = F.least(F.col("__sure") + F.coalesce("__more", F.lit(0)), F.col(bound))
    return ready.join(won, "__row", "left").withColumn(name, got).drop("__sure", "__most", "__open", "__more")


def hashed(text: Column, seed: int) -> Column:
    """What decides a row's shard and its place there."""
    return F.xxhash64(F.lit(seed), F.col("doc_id"), text)


def quotas(slim: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """Per source and shard: size, target, blocks and the whole blocks it gives.

    ``slim`` has source, __size and __h. Sources share out blocks of ``block``
    words by their targets, each source's blocks go to its shards by their
    words.
    """
    sizes = kept(slim.groupBy("source").agg(F.sum("__size").alias("source_size")))
    aims = kept(targets(sizes))
    seat_total = aims.agg(F.round(F.sum("target") / block).cast("long")).first()[0] or 0
    shards = F.greatest(F.ceil(F.col("source_size") / shard), F.lit(1)).cast("int")
    limit = (2 * F.ceil(F.col("source_size") / block)).cast("long")
    entries = aims.withColumns({
        "__row": F.xxhash64("source", F.col("source").isNull()), "__seats": F.lit(seat_total), "__bound": limit, "__all": F.lit(0)
    })
    per_source = kept(seats(entries, ["__all"], "target", "__bound", "__quota").select(
        "source", "source_size", "target", "__quota", shards.alias("__shards")
    ))
    small = broadcast_within(per_source)
    dealt = slim.join(small, null_safe(slim, per_source, ["source"])).select(
        slim["source"], "source_size", "target", "__quota", F.pmod("__h", F.col("__shards")).cast("int").alias("__shard"), "__size"
    )
    by_shard = dealt.groupBy("source", "source_size", "target", "__quota", "__shard").agg(F.sum("__size").alias("__words"))
    rows = by_shard.withColumns({
        "__blocks": F.ceil(F.col("__words") / block).cast("long"),
        "__seats": F.col("__quota"),
        "__row": F.xxhash64("source", F.col("source").isNull(), "__shard"),
    }).withColumn("__bound", 2 * F.col("__blocks"))
    shared = seats(rows, ["source"], "__words", "__bound", "__take")
    return kept(
        shared.join(per_source.select(F.col("source").alias("__s"), "__shards"), F.col("source").eqNullSafe(F.col("__s")))
        .select("source", "source_size", "target", "__shards", "__shard", "__words", "__blocks", "__take")
    )


def mixture(rows: DataFrame, quota: DataFrame, seed: int, block: int = BLOCK) -> DataFrame:
    """``rows`` (source, __size, __h, ...) with what the mix takes of each.

    A shard's documents lie in seeded order on a line of words that is cut into
    blocks. A quota beyond the shard's blocks takes the line whole first; the
    rest is a run of blocks from a seeded one on, around the end of the line.
    ``whole`` counts full passes; ``from1, cut1`` and ``from2, cut2`` are the
    first word and the words of the pieces that the run takes besides.
    """
    plan = broadcast_within(quota.select(F.col("source").alias("__src"), "__shards").distinct(), 100_000)
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("__src"))).withColumn(
        "__shard", F.pmod("__h", F.col("__shards")).cast("int")
    ).drop("__src", "__shards")
    order = Window.partitionBy("source", "__shard").orderBy("__h", "__size").rowsBetween(Window.unboundedPreceding, 0)
    lined = placed.withColumn("__to", F.sum("__size").over(order)).withColumn("__at", F.col("__to") - F.col("__size"))
    right = quota.select(
        F.col("source").alias("__src"), F.col("__shard").alias("__shd"), "source_size", "target", "__words", "__blocks", "__take"
    )
    both = lined.join(right, F.col("source").eqNullSafe(F.col("__src")) & (F.col("__shard") == F.col("__shd")))
    blocks = F.greatest("__blocks", F.lit(1))
    first = F.pmod(F.xxhash64(F.lit(seed), F.col("source"), F.col("__shard")), blocks)
    last = first + F.pmod("__take", blocks)
    run = both.withColumns({
        "whole": F.floor(F.col("__take") / blocks).cast("long"),
        "__a": first * block,
        "__b": F.least(last * block, F.col("__words")),
        "__c": F.greatest((last - blocks) * block, F.lit(0)),
    })
    low, high = F.greatest("__at", "__a"), F.least("__to", "__b")
    out = run.withColumns({
        "from1": low - F.col("__at"),
        "cut1": F.greatest(high - low, F.lit(0)),
        "from2": F.lit(0).cast("long"),
        "cut2": F.greatest(F.least("__to", "__c") - F.col("__at"), F.lit(0)),
    })
    taken = F.col("whole") * F.col("__size") + F.col("cut1") + F.col("cut2")
    return out.withColumn("taken", taken.cast("long")).drop(
        "__src", "__shd", "__shard", "__to", "__at", "__words", "__blocks", "__take", "__a", "__b", "__c"
    )


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs`` (doc_id, text, source).

    Null, empty and blank texts have size 0 and nothing is taken of them; null
    is a source of its own, after all others; repeated rows count each; ids may
    be missing; other columns are ignored; an empty table gives an empty result.
    """
    slim = kept(docs.select("doc_id", "source", words_in(F.col("text")).alias("__size"), hashed(F.col("text"), seed).alias("__h")))
    return mixture(slim, quotas(slim), seed).select(
        "doc_id", F.col("__size").alias("size"), "source_size", "target", "taken"
    )


def mixed_texts(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix as rows of ``docs``' columns: whole texts as often as taken, and pieces of words."""
    size, h = words_in(F.col("text")).alias("__size"), hashed(F.col("text"), seed).alias("__h")
    quota = quotas(kept(docs.select("source", size, h)), BLOCK)
    boxed = docs.select(F.struct("*").alias("__doc"), "source", size, h)
    shares = mixture(boxed, quota, seed).filter("taken > 0")
    words = F.regexp_extract_all(F.col("__doc.text"), F.lit(WORD), F.lit(0))

    def piece(start: str, length: str) -> Column:
        whole = (F.col(length) == F.col("__size")) & (F.col(start) == 0)
        cut = F.array_join(F.slice(words, (F.col(start) + 1).cast("int"), F.col(length).cast("int")), " ")
        return F.when(F.col(length) > 0, F.array(F.when(whole, F.col("__doc.text")).otherwise(cut))).otherwise(F.array().cast("array<string>"))

    copies = F.array_repeat(F.col("__doc.text"), F.col("whole").cast("int"))
    texts = F.concat(copies, piece("from1", "cut1"), piece("from2", "cut2"))
    spread = shares.select("__doc", F.explode(texts).alias("__t"))
    fresh = {"text": F.col("__t"), "n_chars": F.length("__t").cast("long")}
    return spread.select(*[fresh.get(c, F.col(f"__doc.`{c}`")).alias(c) for c in docs.columns])
