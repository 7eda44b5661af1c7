"""Near copies by SimHash fingerprints and by exact Jaccard similarity of word shingles, whose candidates share a band of min-hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, broadcast_within, kept, mix64, utf8
from .components import components, local_forest
from .simhash import fingerprints_of, near_links, shingle_hashes

#: Words of a shingle, and the share of common shingles from which two texts are near copies.
WORDS, SIMILARITY = 5, 0.8
#: Two texts are candidates if all min-hashes of a band agree: at similarity 0.8 with a chance of 0.9996.
BANDS, ROWS = 20, 5
#: Rounds in which a band's texts meet one of them only, before those still apart meet each other.
STARS = 2
#: Texts of a chunk: a larger band is cut into chunks, and every two of these make a cell. Texts of small bands per group.
CHUNK, GROUP = 1024, 2048

FLIP = mix64(np.arange(401, 401 + BANDS * ROWS, dtype=np.uint64))
ODD = mix64(np.arange(601, 601 + BANDS * ROWS, dtype=np.uint64)) | np.uint64(1)


def sets_of(texts: list, words: int = WORDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For blocks of texts, the distinct shingles' hashes of every text one after the other, and their numbers."""
    data = utf8(texts)
    for start, end in blocks([len(d) for d in data]):
        hashes, counts = shingle_hashes(data[start:end], words)
        owner = np.repeat(np.arange(len(counts)), counts)
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        yield hashes[new], np.bincount(owner[new], minlength=len(counts))


def nodes_of(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A number for every set of shingles; zero for the empty one."""
    out = np.zeros(len(counts), np.uint64)
    filled = counts > 0
    if filled.any():
        out[filled] = mix64(np.add.reduceat(mix64(hashes), (np.cumsum(counts) - counts)[filled]))
    return out


def bands_of(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bands of every set, a row each; rows of empty sets are zero."""
    out = np.zeros((len(counts), BANDS), np.uint64)
    filled = np.flatnonzero(counts)
    if len(filled):
        begin = (np.cumsum(counts) - counts)[filled]
        for band in range(BANDS):
            value = np.full(len(filled), band + 1, np.uint64)
            for i in range(band * ROWS, band * ROWS + ROWS):
                value = mix64(value ^ np.minimum.reduceat((hashes ^ FLIP[i]) * ODD[i], begin))
            out[filled, band] = value
    return out


def with_bands(docs: DataFrame) -> DataFrame:
    """``doc_id, x, fp, node, bands`` of every row; x tells its text, fp is its fingerprint."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch.iloc[:, :2].copy()
            out["fp"] = fingerprints_of(batch["text"].tolist()).view(np.int64)
            found = [(nodes_of(*s), bands_of(*s)) for s in sets_of(batch["text"].tolist())]
            out["node"] = np.concatenate([n for n, _ in found] or [np.zeros(0, np.uint64)]).view(np.int64)
            out["bands"] = [row for _, b in found for row in b.view(np.int64)]
            yield out

    columns = docs.select("doc_id", text_key().alias("x"), "text")
    return columns.mapInPandas(run, "doc_id long, x long, fp long, node long, bands array<long>")


def with_sets(texts: DataFrame) -> DataFrame:
    """``node, shingles`` of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nodes, sets = [np.zeros(0, np.uint64)], []
            for hashes, counts in sets_of(batch["text"].tolist()):
                nodes.append(nodes_of(hashes, counts))
                sets += np.split(hashes.view(np.int64), np.cumsum(counts)[:-1])
            yield pd.DataFrame({"node": np.concatenate(nodes).view(np.int64), "shingles": sets})

    return texts.select("text").mapInPandas(run, "node long, shingles array<long>")


def text_key() -> F.Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose shingles are alike enough."""
    pairs = kept(pairs)
    ends = kept(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    sets = sets.join(broadcast_within(ends), "node", "left_semi")
    one, two = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    common = F.size(F.array_intersect("sa", "sb"))
    every = F.size("sa") + F.size("sb") - common
    return pairs.join(one, "a").join(two, "b").filter(common * 1000 >= every * round(similarity * 1000)).select("a", "b")


def common_counts(owner: np.ndarray, hashes: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """For blocks of texts, how many shingles each of them has in common with every text of the cell.

    A shingle that only one text has is in no common part, so few columns are left.
    """
    _, column, times = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    wide = int(column.max(initial=-1)) + 1
    step = max(1, (1 << 22) // max(1, n))
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for at in range(0, n, CHUNK):
        total = np.zeros((min(CHUNK, n - at), n), np.int64)
        for first in range(0, wide, step):
            s, e = np.searchsorted(column, [first, first + step])
            dense = np.zeros((n, min(step, wide - first)), np.float32)
            dense[owner[s:e], column[s:e] - first] = 1
            total += (dense[at : at + CHUNK] @ dense.T).astype(np.int64)
        yield at, total


def cell_forest(sets: list[np.ndarray], labels: np.ndarray, similarity: float) -> np.ndarray:
    """The smallest place connected with each text of a cell, by labels or by similarity."""
    n = len(sets)
    _, first, number = np.unique(labels, return_index=True, return_inverse=True)
    forest = local_forest(n, np.arange(n), first[number])
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    for at, common in common_counts(owner, np.concatenate(sets), n):
        every = sizes[at : at + len(common), None] + sizes[None, :] - common
        left, right = np.nonzero(common * 1000 >= every * round(similarity * 1000))
        forest = local_forest(n, left + at, right, forest)
    return forest


def cell_links(open_: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between texts of a band (node, band, label) that are alike and not connected yet.

    A large band is dealt to chunks and cells of two; a cell has each of its
    texts' shingles once and emits a forest, not pairs. Small bands share groups.
    """
    sizes = open_.groupBy("band").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    total = open_.count()
    dealt = open_.join(sizes, "band").withColumn("chunk", F.pmod(F.xxhash64("node", "band"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cell = F.xxhash64("band", F.least("chunk", "other"), F.greatest("chunk", "other"))
    group = F.when(F.col("chunks") > 1, cell).otherwise(F.pmod(cell, F.lit(max(1, -(-total // GROUP)))))
    ends = kept(open_.select("node").distinct())
    sets = sets.join(broadcast_within(ends), "node", "left_semi")
    dealt = dealt.select("node", "label", cell.alias("cell"), group.alias("group")).join(sets, "node")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((0, 2), np.int64)]
        for own in rows.groupby("cell").indices.values():
            part = rows.iloc[own]
            node, label = part["node"].to_numpy(), part["label"].to_numpy()
            if (label != label[0]).any():
                forest = cell_forest([np.asarray(s, np.int64) for s in part["shingles"]], label, similarity)
                joined = np.flatnonzero(label[forest] != label)
                out.append(np.stack([node[forest[joined]], node[joined]], axis=1))
        found = np.concatenate(out)
        return pd.DataFrame({"a": found.min(axis=1, initial=2**63 - 1), "b": found.max(axis=1, initial=-(2**63))})

    return dealt.groupBy("group").applyInPandas(run, "a long, b long")


def print_links(prints: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) that connect nodes as fingerprints within ``distance`` bits do; ``prints`` has every (node, fp)."""
    rooted = components(near_links(prints.select("fp").distinct(), distance))
    group = F.coalesce("root", "fp").alias("group")
    grouped = prints.join(rooted, prints["fp"] == rooted["node"], "left").select(prints["node"], group)
    least = grouped.groupBy("group").agg(F.min("node").alias("a"))
    return grouped.join(least, "group").select("a", F.col("node").alias("b")).filter("a <> b").distinct()


def alike_links(nodes: DataFrame, docs: DataFrame, similarity: float = SIMILARITY, links: DataFrame | None = None) -> DataFrame:
    """Links (a, b) that connect ``nodes`` (node, x, bands) as ``links`` and all candidate pairs of that similarity do.

    In a band every text first meets one text of it. Bands that this leaves in
    several components are then compared whole, in cells, so no pair is left out.
    """
    members = nodes.filter("node <> 0").select("node", F.explode("bands").alias("band"))
    sizes = members.groupBy("band").agg(F.count("*").alias("n"), *[F.sum(F.xxhash64(F.lit(i), "node").cast("decimal(38,0)")).alias(f"s{i}") for i in (1, 2)])
    # Bands with the same texts are one.
    sizes = sizes.filter("n > 1").groupBy("n", "s1", "s2").agg(F.min("band").alias("band")).select("band")
    shared = kept(members.join(sizes, "band"))
    wanted = kept(nodes.join(shared.select("node").distinct(), "node", "left_semi").select(F.col("x").alias("__x")).distinct())
    texts = docs.join(broadcast_within(wanted), text_key() == F.col("__x"), "left_semi").select("text")
    sets = kept(with_sets(texts).dropDuplicates(["node"]))
    for number in range(STARS + 1):
        if links is None:
            labelled = shared.withColumn("label", F.col("node"))
        else:
            rooted = components(links).select("node", "root")
            labelled = shared.join(rooted, "node", "left").select("node", "band", F.coalesce("root", "node").alias("label"))
        mixed = labelled.groupBy("band").agg(F.min("label").alias("l"), F.max("label").alias("h")).filter("l <> h").select("band")
        open_ = kept(labelled.join(mixed, "band"))
        if number < STARS:
            turn = F.col("node") if number == 0 else F.xxhash64("node", F.lit(number))
            lead = open_.groupBy("band").agg(F.min(F.struct(turn.alias("t"), "node", "label")).alias("w"))
            met = open_.join(lead, "band").filter("label <> w.label").select("node", F.col("w.node").alias("other"))
        else:
            links = kept(links.unionByName(cell_links(open_, sets, similarity)))
            break
        pairs = met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        found = confirmed(pairs, sets, similarity)
        links = kept(found if links is None else links.unionByName(found))
    return links


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, distance: int | None = None) -> DataFrame:
    """One row of each component of near copies in ``docs``, the one with the smallest doc_id, with all its columns.

    Two rows are near copies if their texts share ``similarity`` of their distinct
    five-word shingles (words in lower case; a shorter text is one shingle), and,
    with a ``distance``, also if their SimHash fingerprints differ in so many bits
    at most. Null, empty and blank texts are alike; no shingles are shared with
    them, and their fingerprint is zero. A missing doc_id comes last; of equal
    rows one stays. Shingles, sets of them and texts are told apart by 64-bit hashes.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "x")).alias("w")
    found = kept(with_bands(docs).groupBy("node", "fp").agg(first, F.first("bands").alias("bands")))
    links = None if distance is None else kept(print_links(found.select("node", "fp"), distance))
    # Texts of one set of shingles can have several fingerprints.
    nodes = kept(found.groupBy("node").agg(F.min("w").alias("w"), F.first("bands").alias("bands")))
    rooted = components(alike_links(nodes.select("node", "w.x", "bands"), docs, similarity, links))
    label = F.coalesce("root", "node").alias("label")
    winners = kept(
        nodes.join(rooted, "node", "left").select(label, "w").groupBy("label").agg(F.min("w").alias("w")).select("w.doc_id", "w.x")
    )
    rows = docs.select(F.struct("*").alias("__row"), "doc_id", text_key().alias("x"))
    same = rows["doc_id"].eqNullSafe(winners["doc_id"]) & (rows["x"] == winners["x"])
    order = Window.partitionBy("doc_id", "x").orderBy(F.xxhash64(F.to_json("__row")))
    won = rows.join(winners, same, "left_semi")
    return won.withColumn("__n", F.row_number().over(order)).filter("__n = 1").select("__row.*")
