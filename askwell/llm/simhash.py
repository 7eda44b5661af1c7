"""SimHash near-duplicates by a Gray-ordered hierarchical index of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, kept, partitions, utf8
from .components import components, local_forest
from .xxh import xxh64

#: Every byte's bits spread over eight one-byte counters.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1, bitorder="little").view("<u8").ravel()


def shingle_hashes(data: list[bytes], words: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of every text one after the other, and their number per text."""
    parts = [d.lower().split() for d in data]
    joined = b" ".join(w for p in parts for w in p)
    counts = np.array([len(p) for p in parts], np.int64)
    lengths = np.array([len(w) for p in parts for w in p], np.int64)
    begin = np.cumsum(lengths + 1) - lengths - 1
    finish = begin + lengths
    shingles = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    before = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(parts)), shingles)
    first = before[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    last = first + np.minimum(counts, words)[owner] - 1
    return xxh64(joined, begin[first], finish[last] - begin[first], seed), shingles


def fingerprints_of(texts: list, words: int = 4, seed: int = 42) -> np.ndarray:
    """Unsigned 64-bit fingerprint of every text; null and blank texts have zero."""
    data = utf8(texts)
    out = np.zeros(len(data), np.uint64)
    for start, end in blocks([len(d) for d in data]):
        out[start:end] = majority(*shingle_hashes(data[start:end], words, seed))
    return out


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bits set in over half of each text's hashes; ``counts`` gives the texts' runs of hashes."""
    filled = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint64)
    if not len(filled):
        return out
    sizes = counts[filled]
    # One-byte counters hold 255 hashes: sum pieces of that size, then the pieces.
    pieces = -(-sizes // 255)
    piece_owner = np.repeat(np.arange(len(filled)), pieces)
    first_piece = np.cumsum(pieces) - pieces
    begin = np.cumsum(sizes) - sizes
    starts = begin[piece_owner] + 255 * (np.arange(len(piece_owner)) - first_piece[piece_owner])
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros((len(filled), 64), np.int64)
    for k in range(8):
        sums = np.add.reduceat(SPREAD[octets[:, k]], starts).astype("<u8").view(np.uint8).reshape(-1, 8)
        ones[:, 8 * k : 8 * k + 8] = np.add.reduceat(sums.astype(np.int64), first_piece, axis=0)
    bits = (2 * ones > sizes[:, None]).astype(np.uint8)
    out[filled] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def with_fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of every row and ``fp``, its fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch.iloc[:, : len(keep)].copy()
            out["fp"] = fingerprints_of(batch.iloc[:, -1].tolist()).view(np.int64)
            yield out

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    return docs.select(*keep, F.col(text).alias("__text")).mapInPandas(run, ", ".join([*fields, "fp long"]))


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each 64-bit pattern in the reflected Gray sequence."""
    x = values.astype(np.uint64, copy=True)
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


#: Fingerprints under a lowest node of the index, and nodes under an upper one.
FANOUT = 16
#: Node pairs expanded at once.
PAIRS_AT_ONCE = 1 << 18


def build_index(ordered: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels of (pattern, mask) from the fingerprints up to one root.

    A node's mask marks the bits on which everything below it agrees, its
    pattern their values.
    """
    levels = [(ordered, np.full(len(ordered), np.uint64(0xFFFFFFFFFFFFFFFF)))]
    while len(levels[-1][0]) > 1:
        pattern, mask = levels[-1]
        starts = np.arange(0, len(pattern), FANOUT)
        ones = np.bitwise_and.reduceat(pattern & mask, starts)
        zeros = np.bitwise_and.reduceat(~pattern & mask, starts)
        levels.append((ones, ones | zeros))
    return levels


def _expand(nodes: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """Children of nodes on the next level, and which node each belongs to."""
    first = nodes * FANOUT
    count = np.minimum(first + FANOUT, below) - first
    owner = np.repeat(np.arange(len(nodes)), count)
    return first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count), owner


def linked_pairs(levels: list, other: list | None, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of fingerprints of two indexes (or of one with itself) within ``distance`` bits.

    Starts at the roots and opens pairs of nodes level by level. Bits that both
    nodes share below them count towards the distance; a pair of nodes whose
    shared bits already differ in more places is dropped with everything below.
    """
    own, other = other is None, other or levels
    stack = [(len(levels) - 1, len(other) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        i, j, a, b = stack.pop()
        if len(a) > PAIRS_AT_ONCE:
            stack += [(i, j, a[k : k + PAIRS_AT_ONCE], b[k : k + PAIRS_AT_ONCE]) for k in range(0, len(a), PAIRS_AT_ONCE)]
            continue
        (pa, ma), (pb, mb) = levels[i], other[j]
        near = np.bitwise_count((pa[a] ^ pb[b]) & ma[a] & mb[b]) <= distance
        a, b = a[near], b[near]
        if not len(a):
            continue
        if i == 0 and j == 0:
            if own:
                a, b = a[a < b], b[a < b]
            yield a, b
            continue
        if i > 0:
            a, owner = _expand(a, len(levels[i - 1][0]))
            b, i = b[owner], i - 1
        if j > 0:
            b, owner = _expand(b, len(other[j - 1][0]))
            a, j = a[owner], j - 1
        if own and i == j:
            a, b = a[a <= b], b[a <= b]
        stack.append((i, j, a, b))


def cell_links(left: np.ndarray, right: np.ndarray | None, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of what one cell connects: each fingerprint with the smallest it reaches there."""
    left = left[np.argsort(gray_rank(left))]
    index = build_index(left)
    if right is None:
        nodes, pairs = left, linked_pairs(index, None, distance)
    else:
        right = right[np.argsort(gray_rank(right))]
        nodes = np.concatenate([left, right])
        pairs = ((a, b + len(left)) for a, b in linked_pairs(index, build_index(right), distance))
    labels = np.arange(len(nodes))
    for a, b in pairs:
        labels = local_forest(len(nodes), a, b, labels)
    moved = np.flatnonzero(labels != np.arange(len(nodes)))
    return nodes[moved], nodes[labels[moved]]


#: Fingerprints of a bucket that one side of a cell may hold.
CELL = 20_000


def bucket_masks(total: int, distance: int, target: int = 64) -> list[int]:
    """Bit masks such that any two fingerprints within ``distance`` agree on one of them.

    The bits are cut into m blocks, of which at most ``distance`` can differ:
    each choice of m - distance blocks is a mask. m is the least for which
    buckets of random fingerprints hold about ``target``.
    """
    for m in range(distance + 1, distance + 5):
        kept_bits = 64 * (m - distance) // m
        if total <= target << kept_bits:
            break
    edges = [64 * i // m for i in range(m + 1)]
    parts = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(m)]
    masks = []
    for chosen in combinations(range(m), m - distance):
        value = sum(parts[i] for i in chosen)
        masks.append(value - (1 << 64) if value >> 63 else value)
    return masks


def near_links(distinct: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b) that connect the fingerprints ``fp`` within ``distance`` bits; not all pairs.

    Fingerprints meet in buckets of equal masked bits. A bucket beyond ``CELL``
    is dealt into chunks, and every two chunks meet in a cell of their own, so
    no task holds a whole bucket and none is cut off.
    """
    spark = distinct.sparkSession
    masks = bucket_masks(distinct.count(), distance)
    shares = F.array(*[
        F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks)
    ])
    members = distinct.select("fp", F.explode(shares).alias("__s")).select(
        "fp", F.col("__s.m").alias("m"), F.col("__s.v").alias("v")
    )
    sizes = members.groupBy("m", "v").agg(F.count("*").alias("n")).filter("n > 1")
    chunks = F.ceil(F.col("n") / CELL).cast("int")
    dealt = members.join(sizes, ["m", "v"]).select(
        "fp", "m", "v", chunks.alias("c"), F.pmod(F.xxhash64("fp"), chunks).cast("int").alias("k")
    )
    meets = F.transform(
        F.sequence(F.lit(0), F.col("c") - 1),
        lambda o: F.struct(F.least("k", o).alias("i"), F.greatest("k", o).alias("j")),
    )
    cells = dealt.select("fp", "m", "v", "k", F.explode(meets).alias("__c")).select(
        "m", "v", F.col("__c.i").alias("i"), F.col("__c.j").alias("j"), "k", "fp"
    )
    keys = ["m", "v", "i", "j"]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found(key: tuple, parts: list[pd.DataFrame]) -> pd.DataFrame | None:
            rows = pd.concat(parts) if len(parts) > 1 else parts[0]
            values, side = rows["fp"].to_numpy().view(np.uint64), rows["k"].to_numpy()
            if len(values) < 2:
                return None
            if key[2] == key[3]:
                a, b = cell_links(values, None, distance)
            else:
                one, two = values[side == key[2]], values[side != key[2]]
                if not len(one) or not len(two):  # a chunk without partners meets none here
                    return None
                a, b = cell_links(one, two, distance)
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)}) if len(a) else None

        open_key, parts = None, []
        for batch in batches:
            if not len(batch):
                continue
            columns = [batch[k].to_numpy() for k in keys]
            change = np.zeros(len(batch), bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            edges = [0, *np.flatnonzero(change).tolist(), len(batch)]
            out = []
            for s, e in zip(edges[:-1], edges[1:]):
                key = tuple(c[s] for c in columns)
                if key != open_key:
                    if parts and (links := found(open_key, parts)) is not None:
                        out.append(links)
                    open_key, parts = key, []
                parts.append(batch.iloc[s:e])
            if out:
                yield pd.concat(out)
        if parts and (links := found(open_key, parts)) is not None:
            yield links

    together = cells.repartition(partitions(spark), *keys).sortWithinPartitions(*keys)
    return together.mapInPandas(search, "a long, b long")


def near_classes(docs: DataFrame, distance: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs`` (doc_id, text).

    Equal fingerprints are one node, so copies never meet as pairs. Null, empty
    and blank texts have fingerprint zero and are linked like any other.
    ``component_id`` is the smallest doc_id reachable, null only where no row of
    the component has a doc_id. Repeated rows stay; other columns are ignored.
    """
    prints = kept(with_fingerprints(docs, ["doc_id"]))
    labelled = class_of(prints, distance)
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return labelled.select("doc_id", digits.alias("fingerprint"), "component_id")


def class_of(prints: DataFrame, distance: int) -> DataFrame:
    """``prints`` (fp, doc_id, ...) with ``component_id``."""
    nodes = kept(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    rooted = components(near_links(nodes.select("fp"), distance))
    known = kept(nodes.join(rooted, nodes["fp"] == rooted["node"], "left").select("fp", "root", "least"))
    groups = known.filter("root is not null").groupBy("root").agg(F.min("least").alias("lowest"))
    moved = kept(
        known.join(groups, "root", "left").select(F.col("fp").alias("__fp"), F.coalesce("lowest", "least").alias("component_id"))
    )
    return prints.join(moved, prints["fp"] == moved["__fp"]).drop("__fp")


def keep_one(docs: DataFrame, distance: int = 4) -> DataFrame:
    """One row of each component of ``docs``, the one with the smallest doc_id, with all its columns.

    A missing doc_id comes last; of equal rows one stays.
    """
    prints = kept(with_fingerprints(docs, ["doc_id"]))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "fp")).alias("w")
    rooted = class_of(prints, distance)
    # The component of rows that all lack an id is told by its fingerprint.
    label = F.when(F.col("component_id").isNull(), F.col("fp"))
    winners = kept(rooted.groupBy("component_id", label.alias("__l")).agg(first).select("w.doc_id", "w.fp"))
    boxed = docs.select(F.struct("*").alias("__row"), "doc_id", "text")
    rows = with_fingerprints(boxed, ["__row", "doc_id"])
    same = rows["doc_id"].eqNullSafe(winners["doc_id"]) & (rows["fp"] == winners["fp"])
    won = rows.join(winners, same, "left_semi")
    order = Window.partitionBy("doc_id", "fp").orderBy(F.xxhash64(F.to_json("__row")))
    return won.withColumn("__n", F.row_number().over(order)).filter("__n = 1").select("__row.*")
