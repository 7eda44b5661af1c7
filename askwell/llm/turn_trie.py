"""Prefix tries of conversations: ternary search trees per range shard, merged at the shards' boundaries.

A conversation is cut into segments of ``SEGMENT`` turns. Segments that start
after the same turns share a root; equal ones are one with a count. In the order
of root and turns, a shard is a range, so only the nodes on the paths of its
first and last segment can go on in another shard, and only what lies above a
segment's end can go on in later segments. Those are its boundary nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import with_position
from .common import WORD, broadcast_within, kept, partitions, unsigned_crc32

#: Turns of a segment, of a shard, and of a spliced opening at most; conversations that share a base.
SEGMENT, SHARD_TURNS, HEAD, FAMILY = 1024, 1 << 18, 3, 20
#: Ids of so many neighbouring numbers are joined at once.
CHUNK_BITS = 16


class TernaryTrie:
    """A ternary search tree over sequences of small numbers; a node per distinct prefix.

    ``low`` and ``high`` lead to other turns at the same place, ``down`` to the
    next place; ``up`` is the node of the prefix that is one turn shorter, -1 for
    the empty one. A node always comes after the one above it.
    """

    def __init__(self) -> None:
        self.turn: list[int] = []
        self.low: list[int] = []
        self.high: list[int] = []
        self.down: list[int] = []
        self.up: list[int] = []
        self.depth: list[int] = []
        self.first = -1

    def _new(self, turn: int, up: int, depth: int) -> int:
        self.turn.append(turn), self.low.append(-1), self.high.append(-1), self.down.append(-1)
        self.up.append(up), self.depth.append(depth)
        return len(self.turn) - 1

    def insert(self, sequence: list[int]) -> list[int]:
        """The nodes of the sequence's prefixes, from one turn to all."""
        path, up = [], -1
        for depth, turn in enumerate(sequence, 1):
            at = self.first if up < 0 else self.down[up]
            if at < 0:
                at = self._new(turn, up, depth)
                if up < 0:
                    self.first = at
                else:
                    self.down[up] = at
            while self.turn[at] != turn:
                side = self.low if turn < self.turn[at] else self.high
                if side[at] < 0:
                    side[at] = self._new(turn, up, depth)
                at = side[at]
            path.append(at)
            up = at
        return path

    def insert_all(self, sequences: list[list[int]]) -> list[list[int]]:
        """Paths of sorted sequences; the median of each range goes in first, so that siblings stay balanced."""
        paths: list = [None] * len(sequences)
        open_ = [(0, len(sequences))]
        while open_:
            begin, end = open_.pop()
            if begin < end:
                middle = (begin + end) // 2
                paths[middle] = self.insert(sequences[middle])
                open_ += [(begin, middle), (middle + 1, end)]
        return paths


NODE = (
    "key string, up string, conv_id long, depth long, words long, parent long, n_convs long, n_children long, n_leaves long, saved long, "
    "ends string"
)


def prefix_keys(root: str, turns: list[bytes]) -> Iterator[str]:
    """A key for each prefix of a segment, from one turn to all."""
    running = hashlib.blake2b(root.encode(), digest_size=16)
    for turn in turns:
        running.update(turn)
        yield running.copy().hexdigest()


def shard_nodes(rows: list, segment: int) -> list[tuple]:
    """Nodes of one range of segments, boundary nodes (with a key) with what this range adds to them.

    A segment is (root, after, band, turns, words, n, least, ends): the keys of
    what comes before it and of what it ends at, its number, its turns' digests
    and words, its conversations' number and smallest id, and the hash of the
    ids of those that end with it.
    """
    out: list[tuple] = []
    begin = 0
    while begin < len(rows):
        end = begin
        while end < len(rows) and rows[end].root == rows[begin].root:
            end += 1
        out += root_nodes(rows[begin:end], segment)
        begin = end
    return out


def root_nodes(rows: list, segment: int) -> list[tuple]:
    """Nodes of segments of one root: the root's share first, then those of its trie."""
    root, above = rows[0].root, rows[0].band * segment
    dictionary = {t: i for i, t in enumerate(sorted({t for r in rows for t in r.turns}))}
    trie = TernaryTrie()
    paths = trie.insert_all([[dictionary[t] for t in r.turns] for r in rows])
    n = len(trie.turn)
    convs, least, ends, words = [0] * n, [None] * n, [None] * n, [0] * n
    children, leaves, saved, key = [0] * n, [0] * n, [0] * n, [None] * n
    whole = [0, 0, 0, 0, None, None]  # the root: members, children, leaves, saved, least, ends
    for r, path in zip(rows, paths):
        for node, w in zip(path, r.words):
            words[node] = w
        if path:
            last = path[-1]
            convs[last] += r.n
            least[last] = r.least if least[last] is None else min(least[last], r.least)
            ends[last] = r.ends or ends[last]
        else:
            whole[5] = r.ends
        whole[0] += r.n
        whole[4] = r.least if whole[4] is None else min(whole[4], r.least)
    bounds = {0, len(rows) - 1} | {i for i, r in enumerate(rows) if len(r.turns) == segment}
    for i in bounds:
        for node, name in zip(paths[i], prefix_keys(root, rows[i].turns)):
            key[node] = name
        if len(paths[i]) == segment:
            key[paths[i][-1]] = rows[i].after
    for node in range(n - 1, -1, -1):  # what is below a node comes after it
        up = trie.up[node]
        if key[node] is None:
            leaves[node] += children[node] == 0
            saved[node] += (convs[node] - 1) * words[node]
        if up < 0:
            if key[node] is None:
                whole[1] += 1
                whole[2] += leaves[node]
                whole[3] += saved[node]
            continue
        convs[up] += convs[node]
        least[up] = least[node] if least[up] is None else min(least[up], least[node])
        if key[node] is None:
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
    # A root's members and ends are told by the node it is in the segment before; the first root has none.
    first = rows[0].band == 0
    told = (whole[4], whole[0], whole[5]) if first else (None, 0, None)
    out = [(root, None, told[0], above, 0, None, told[1], whole[1], whole[2], whole[3], told[2])]
    for node in range(n):
        up = trie.up[node]
        above_key = root if up < 0 else key[up]
        parent = None if above_key is not None else least[up]
        out.append((key[node], above_key, least[node], above + trie.depth[node], words[node], parent, convs[node], children[node], leaves[node], saved[node], ends[node]))
    return out


def numbered(turns: DataFrame) -> DataFrame:
    """``conv_id, p, turn, words``: turns in order, p from 1; turn is a digest of role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat_ws(":", F.octet_length(role), role, text), 256)
    rows = turns.filter("conv_id is not null").select(
        "conv_id", F.coalesce("turn", F.lit(-(2**63))).alias("at"), F.col("turn").isNotNull().alias("given"),
        F.unhex(F.substring(digest, 1, 32)).alias("turn"), F.regexp_count(text, F.lit(WORD)).alias("words"),
    )
    # A conversation with a large share of all turns is numbered in ranges.
    return with_position(kept(rows), "at", ["conv_id"], ["given", "turn"], "p").select("conv_id", "p", "turn", "words")


def rebuilt(own: DataFrame) -> DataFrame:
    """``conv_id, p, turn, words, bands`` of rebuilt conversations; one without turns has one row, p null.

    Conversation c opens with up to h turns of its family's first one and goes on
    with its own after the first h; h is the CRC-32 of c's digits modulo 4.
    """
    item = F.struct("p", "turn", "words")
    heads = (
        own.filter(F.col("p") <= HEAD).filter(F.col("conv_id") % FAMILY == 0)
        .groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(item)).alias("head"))
    )
    h = F.pmod(unsigned_crc32(F.col("conv_id")), F.lit(4)).cast("int")
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("size")).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    taken = F.slice(F.coalesce("head", F.array().cast("array<struct<p:bigint,turn:binary,words:int>>")), F.lit(1), F.col("h"))
    convs = sizes.join(heads, "base", "left").select("conv_id", "size", h.alias("h"), "head").select("conv_id", "h", taken.alias("taken"), "size")
    convs = convs.withColumn("shift", F.size("taken") - F.col("h"))
    total = F.size("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0))
    convs = convs.withColumn("bands", F.greatest(F.ceil(total / SEGMENT), F.lit(1)).cast("int"))
    opening = convs.select("conv_id", F.explode_outer("taken").alias("e"), "bands", "size", "h").filter("e is not null or size <= h")
    opening = opening.select("conv_id", F.col("e.p").alias("p"), "e.turn", "e.words", "bands")
    rest = own.join(convs.select("conv_id", "h", "shift", "bands"), "conv_id").filter("p > h")
    return opening.unionByName(rest.select("conv_id", (F.col("p") + F.col("shift")).alias("p"), "turn", "words", "bands"))


def lane(text: Column, at: int) -> Column:
    return F.conv(F.substring(text, at, 15), 16, 10).cast("decimal(38,0)")


def segments(rows: DataFrame) -> DataFrame:
    """``conv_id, band, root, after, turns, words, last`` of every conversation's segments.

    ``root`` and ``after`` are sums of digests of the segments so far, each with
    its number, so equal ones mean equal openings.
    """
    band = F.coalesce(((F.col("p") - 1) / SEGMENT).cast("int"), F.lit(0))
    found = F.sort_array(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("p", "turn", "words"))))
    cut = rows.groupBy("conv_id", band.alias("band")).agg(found.alias("e"), F.max("bands").alias("bands"))
    cut = cut.select("conv_id", "band", "bands", F.col("e.turn").alias("turns"), F.col("e.words").alias("words"))
    digest = F.sha2(F.concat_ws("", F.col("band").cast("string"), F.lit("|"), F.transform("turns", F.hex)), 256)
    some = F.size("turns") > 0
    cut = cut.withColumn("d", digest).withColumn("a", F.when(some, lane(F.col("d"), 1)).otherwise(0)).withColumn("b", F.when(some, lane(F.col("d"), 16)).otherwise(0))
    upto = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    one, many = cut.filter("bands = 1"), cut.filter("bands > 1")
    one = one.withColumn("sa", F.col("a")).withColumn("sb", F.col("b"))
    many = many.withColumn("sa", F.sum("a").over(upto)).withColumn("sb", F.sum("b").over(upto))
    both = one.unionByName(many)
    pair = lambda a, b: F.concat_ws(":", a.cast("decimal(38,0)").cast("string"), b.cast("decimal(38,0)").cast("string"))
    return both.select(
        "conv_id", "band", "turns", "words", (F.col("band") + 1 == F.col("bands")).alias("last"),
        pair(F.col("sa") - F.col("a"), F.col("sb") - F.col("b")).alias("root"), pair(F.col("sa"), F.col("sb")).alias("after"),
    )


def end_hashes(cut: DataFrame) -> DataFrame:
    """``after, ends``: for every full sequence, SHA-256 of its conversations' ids, ascending and joined by commas.

    Ids are joined by ranges of at most 65,536 numbers; the hash then runs over
    these in order, holding one of them at a time.
    """
    chunk = F.shiftright("conv_id", CHUNK_BITS).alias("chunk")
    text = F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")))
    chunks = cut.filter("last").groupBy("after", chunk).agg(text.alias("ids"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        after, running = None, None
        for batch in batches:
            out = []
            for a, ids in zip(batch["after"], batch["ids"]):
                if a == after:
                    running.update(b"," + ids.encode())
                    continue
                if after is not None:
                    out.append((after, running.hexdigest()))
                after, running = a, hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=["after", "ends"])
        if after is not None:
            yield pd.DataFrame([(after, running.hexdigest())], columns=["after", "ends"])

    return chunks.repartition("after").sortWithinPartitions("after", "chunk").select("after", "ids").mapInPandas(run, "after string, ends string")


def subtree_sums(nodes: DataFrame, depth: int) -> DataFrame:
    """``key, leaves, saved`` summed over each node of (key, up, leaves, saved) and all below it.

    Reach doubles every round: a node's sum so far goes to the node that many
    steps above, and it then looks twice as far up.
    """
    reach = 1
    state = kept(nodes.select("key", "up", "leaves", "saved"))
    while reach <= depth:
        given = state.filter("up is not null").groupBy(F.col("up").alias("key")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        far = state.select(F.col("key").alias("up"), F.col("up").alias("far"))
        moved = state.join(far, "up", "left").select("key", F.col("far").alias("up"), "leaves", "saved")
        state = kept(
            moved.join(given, "key", "left").select(
                "key", "up", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")
            )
        )
        reach *= 2
    return state.select("key", "leaves", "saved")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct opening of the rebuilt ``conversations`` (conv_id, turn, role, text).

    Columns conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256. Turns are ordered by
    turn, null first, equal ones by a digest of role and text; null role or text
    is empty; repeated rows are turns each. Rows without a conv_id take no part.
    Conversations of any length are cut into segments; a very long text is read
    where it lies and travels as a digest. An empty table has no nodes. Other
    columns are ignored.
    """
    segment, limit = SEGMENT, SHARD_TURNS
    cut = kept(segments(rebuilt(kept(numbered(conversations)))))
    merged = cut.groupBy("band", "root", "after").agg(
        F.first("turns").alias("turns"), F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("least")
    )
    distinct = kept(merged.join(end_hashes(cut), "after", "left"))
    turns = distinct.agg(F.sum(F.size("turns") + 1)).first()[0] or 0
    shards = max(partitions(conversations.sparkSession), -(-turns // limit))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                rows.append(row)
                size += len(row.turns) + 1
                if size >= limit:
                    yield pd.DataFrame(shard_nodes(rows, segment), columns=names).astype(kinds)
                    rows, size = [], 0
        yield pd.DataFrame(shard_nodes(rows, segment), columns=names).astype(kinds)

    names = [c.split()[0] for c in NODE.split(", ")]
    kinds = {c.split()[0]: "Int64" for c in NODE.split(", ") if c.endswith("long")}
    ordered = distinct.repartitionByRange(shards, "root", "turns").sortWithinPartitions("root", "turns")
    nodes = kept(ordered.mapInPandas(run, NODE))
    inner = nodes.filter("key is null")
    sums = ["n_convs", "n_children", "n_leaves", "saved"]
    outer = nodes.filter("key is not null").groupBy("key").agg(
        F.max("up").alias("up"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("words").alias("words"),
        *[F.sum(c).alias(c) for c in sums], F.max("ends").alias("ends"),
    )
    outer = kept(outer)
    below = outer.filter("up is not null").groupBy(F.col("up").alias("key")).agg(F.count("*").alias("more"))
    outer = outer.join(below, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    leaf = (F.col("n_children") == 0).cast("long")
    outer = kept(
        outer.withColumn("leaves", F.col("n_leaves") + leaf).withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("words")).drop("n_leaves")
    )
    deepest = outer.agg(F.max("depth")).first()[0] or 0
    totals = subtree_sums(outer, deepest)
    whole = outer.drop("leaves", "saved").join(totals, "key").withColumnsRenamed({"leaves": "n_leaves"})
    every = whole.withColumn("parent", F.lit(None).cast("long")).unionByName(inner)
    parents = broadcast_within(kept(outer.select(F.col("key").alias("up"), F.col("conv_id").alias("above"))))
    return every.join(parents, "up", "left").select(
        "conv_id", "depth", F.coalesce("parent", "above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
