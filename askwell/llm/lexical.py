"""Exact ranked lexical search: posting lists in blocks of similar documents, skipped by maximum summaries.

Every shard of documents has a forward index and posting lists. A long list is
cut into blocks of documents that are alike; a block's summary holds, for every
term at least as frequent as the list's own, the highest impact in the block. A
query reads its lists from the rarest on: what holds a rarer term of it has been
seen by then, so the summary needs no others and its bound is exact for the rest.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_within, kept, mix64, remove_folder, shared_folder, utf8
from .shards import gathered, pack, spans, unpack, word_hashes, word_table

#: Maximal runs of ASCII letters, digits and anything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or bytes([c]).isalnum() else 32 for c in range(256))
#: Text of a shard, and what a document counts besides.
SHARD_BYTES, DOC_BYTES = 12 << 20, 512
#: Lists of up to so many documents are read whole; documents of a block; dimensions in which documents are compared.
SHORT, BLOCK, DIMS = 256, 64, 16
#: Documents in more blocked lists than this stand in no block and are always scored: summaries grow with the square.
WIDE = 512
#: Queries of a block, and blocks that meet a shard at once. One shard of so many is searched first, for a lower bound.
QUERIES, TOGETHER, FIRST = 256, 64, 16


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def totals(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms, over all of ``docs``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = np.array([len(terms_of(t)) for t in utf8(batch["text"].tolist())], np.int64)
            yield pd.DataFrame({"docs": [int((sizes > 0).sum())], "terms": [int(sizes.sum())]})

    row = docs.select("text").mapInPandas(run, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def clusters(sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of documents by likeness, and the sizes of the blocks it is cut into.

    Evenly spaced documents are pivots, every document goes to the one most like it.
    """
    n = len(sketch)
    pivots = sketch[np.linspace(0, n - 1, -(-n // BLOCK)).astype(np.int64)]
    nearest = np.concatenate([(sketch[i : i + 4096] @ pivots.T).argmax(axis=1) for i in range(0, n, 4096)])
    order = np.argsort(nearest, kind="stable")
    sizes = np.bincount(nearest, minlength=len(pivots)).tolist()
    return order, np.array([min(BLOCK, s - i) for s in sizes for i in range(0, s, BLOCK)], np.int64)


def sketches(terms: np.ndarray, df: np.ndarray, n_docs: int, count: np.ndarray, term: np.ndarray, impact: np.ndarray) -> np.ndarray:
    """Every document's weighted terms, projected to a few dimensions by signs drawn from the terms, at unit length."""
    weight = impact * np.log1p(n_docs / np.maximum(df, 1))[term]
    owner = np.repeat(np.arange(len(count)), count)
    bits = mix64(terms)
    out = np.empty((len(count), DIMS), np.float32)
    for d in range(DIMS):
        sign = 2.0 * (bits >> np.uint64(d) & np.uint64(1)).astype(np.float64) - 1
        out[:, d] = np.bincount(owner, weight * sign[term], len(count))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def summary(block: np.ndarray, column: np.ndarray, value: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """The highest value of each block and column: places (block * wide + column) that are not zero, and values."""
    flat = block * wide + column
    size = int(flat.max(initial=-1)) + 1
    if size <= 4 * len(flat) + 1000:
        dense = np.zeros(size, np.int64)
        np.maximum.at(dense, flat, value)
        place = np.flatnonzero(dense)
        return place, dense[place]
    order = np.lexsort((value, flat))
    last = np.append(flat[order][1:] != flat[order][:-1], True)
    return flat[order][last], value[order][last]


def index_shard(doc_ids: list, texts: list, n_docs: int, n_terms: int) -> dict:
    """One shard's index; terms stand by falling document frequency, and so do those of a document.

    Documents without an id count in ``df`` and are not indexed.
    """
    words, ids, sizes = word_table(map(terms_of, utf8(texts)))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    pair, tf = np.unique(owner << 32 | ids, return_counts=True)
    hashes, df = word_hashes(words), np.bincount(pair & 0xFFFFFFFF, minlength=len(words))
    order = np.lexsort((hashes, -df))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    terms, df = hashes[order], df[order]
    named = np.array([i is not None and i == i for i in doc_ids], bool)
    real = named & (sizes > 0)
    place = np.cumsum(real) - 1
    keep = real[pair >> 32]
    doc, term, tf = place[pair[keep] >> 32], rank[pair[keep] & 0xFFFFFFFF], tf[keep]
    m = 50 + 50 * sizes[real] * n_docs // max(n_terms, 1)
    impact = 10**9 * tf // (1000 * tf + 20 * m[doc])
    sort = np.lexsort((term, doc))
    doc, term, impact = doc[sort], term[sort], impact[sort]
    count = np.bincount(doc, minlength=int(real.sum()))
    start = np.cumsum(count) - count
    blocked = df > SHORT
    wide = np.bincount(doc, blocked[term], len(count)) > WIDE
    by_term = np.lexsort((doc, term))
    listed = by_term[~(blocked[term[by_term]] & wide[doc[by_term]])]
    length = np.bincount(term[listed], minlength=len(terms))
    sketch = sketches(terms, df, len(count), count, term, impact)
    ends = np.cumsum(length)
    cuts, per_list, summaries, postings = [], [], [], []
    for t in range(int(blocked.sum())):
        own = listed[ends[t] - length[t] : ends[t]]
        if not len(own):
            per_list.append(0), summaries.append(b"")
            continue
        move, blocks = clusters(sketch[doc[own]])
        own = own[move]
        postings.append(own)
        cuts.append(blocks), per_list.append(len(blocks))
        upto = own - start[doc[own]] + 1
        take = spans(start[doc[own]], upto)
        block = np.repeat(np.repeat(np.arange(len(blocks)), blocks), upto)
        at, highest = summary(block, term[take], impact[take], t + 1)
        summaries.append(zlib.compress(np.diff(at, prepend=0).astype("<i4").tobytes() + highest.astype("<i4").tobytes(), 1))
    n_blocked = len(per_list)
    postings.append(listed[ends[n_blocked - 1] if n_blocked else 0 :])
    none = [np.zeros(0, np.int64)]
    return {
        "terms": terms, "df": df, "ids": np.array([int(i) for i, r in zip(doc_ids, real) if r], np.int64), "count": count, "term": term,
        "impact": impact, "length": length, "docs": doc[np.concatenate(postings)], "wide": np.flatnonzero(wide),
        "blocks": np.array(per_list, np.int64), "cuts": np.concatenate(none + cuts),
        "sizes": np.array([len(s) for s in summaries], np.int64), "summaries": b"".join(summaries),
    }


PACKED = ["count", "term", "impact", "length", "docs", "wide", "blocks", "cuts", "sizes"]
INDEX = "shard long, terms array<long>, df array<int>, ids binary, summaries binary, " + ", ".join(f"{c} binary" for c in PACKED)


def build_index(docs: DataFrame, folder: str) -> DataFrame:
    """One row per shard of ``docs`` (doc_id, text), as a table in ``folder``."""
    n_docs, n_terms = totals(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number = TaskContext.get().partitionId(), 0
        for rows in gathered(batches, lambda r: len(r[1] or "") + DOC_BYTES, SHARD_BYTES):
            index = index_shard([r[0] for r in rows], [r[1] for r in rows], n_docs, n_terms)
            head = [part << 32 | number, index["terms"].view(np.int64), index["df"].astype(np.int32), index["ids"].tobytes(), index["summaries"]]
            number += 1
            yield pd.DataFrame([[*head, *[pack(index[c]) for c in PACKED]]], columns=[c.split()[0] for c in INDEX.split(", ")])

    # A missing id must not turn the others into doubles.
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    rows.mapInPandas(run, INDEX).write.parquet(folder)
    return docs.sparkSession.read.schema(INDEX).parquet(folder).withColumn("n_docs", F.lit(n_docs).cast("long"))


class Shard:
    """A shard's index in memory, searched for blocks of queries."""

    def __init__(self, row):
        self.terms = np.asarray(row.terms, np.int64)
        self.ids = np.frombuffer(row.ids, np.int64)
        for c in PACKED:
            setattr(self, c, unpack(getattr(row, c)))
        self.summaries = row.summaries
        self.order = np.argsort(self.terms)
        self.list_start = np.cumsum(self.length) - self.length
        self.block_start = np.cumsum(self.blocks) - self.blocks
        self.summary_end = np.cumsum(self.sizes)
        self.peak = np.zeros(len(self.terms), np.int64)
        np.maximum.at(self.peak, self.term, self.impact)
        self.owner = np.repeat(np.arange(len(self.count)), self.count)
        self.opened = self.passed = 0

    def summary(self, t: int, column: np.ndarray, n: int) -> np.ndarray:
        """The summaries of list ``t`` as a matrix of its blocks by the first ``n`` of the columns asked for."""
        data = np.frombuffer(zlib.decompress(self.summaries[self.summary_end[t] - self.sizes[t] : self.summary_end[t]]), "<i4")
        at, value = np.cumsum(data[: len(data) // 2], dtype=np.int64), data[len(data) // 2 :]
        out = np.zeros((int(self.blocks[t]), n))
        c = column[at % (t + 1)]
        asked = c >= 0
        out[at[asked] // (t + 1), c[asked]] = value[asked]
        return out

    def top(self, query: np.ndarray, terms: np.ndarray, weights: np.ndarray, least: np.ndarray, k: int) -> tuple:
        """Queries' numbers, documents' places and scores: the shard's best ``k`` for each query, none below ``least``.

        Sums are integers below 2^53, so doubles hold them exactly.
        """
        n, least = len(least), np.maximum(least.astype(np.float64), 1.0)
        none = np.zeros(0, np.int64)
        if not len(self.ids) or not len(terms):
            return none, none, none
        at = np.minimum(np.searchsorted(self.terms, terms, sorter=self.order), len(self.terms) - 1)
        t = self.order[at]
        hit = (self.terms[t] == terms) & (weights > 0)
        asked = np.unique(t[hit])
        column = np.full(len(self.terms), -1)
        column[asked] = np.arange(len(asked))
        w = np.zeros((n, len(asked)))
        w[query[hit], column[t[hit]]] = weights[hit]
        c = column[self.term]
        own = c >= 0
        c, impact = c[own], self.impact[own].astype(np.float64)
        count = np.bincount(self.owner[own], minlength=len(self.ids))
        start = np.cumsum(count) - count
        left = np.cumsum(w * self.peak[asked], axis=1)
        seen = np.zeros((n, len(self.ids)), bool)
        best = [(none, np.zeros(0))] * n

        def score(q: int, docs: np.ndarray) -> None:
            docs = docs[~seen[q, docs]]
            if not len(docs):
                return
            seen[q, docs] = True
            take = spans(start[docs], count[docs])
            found = np.bincount(np.repeat(np.arange(len(docs)), count[docs]), impact[take] * w[q, c[take]], len(docs))
            good = found >= least[q]
            if not good.any():
                return
            d, s = np.concatenate([best[q][0], docs[good]]), np.concatenate([best[q][1], found[good]])
            rank = np.lexsort((self.ids[d], -s))[:k]
            best[q] = d[rank], s[rank]
            if len(rank) == k:
                least[q] = max(least[q], s[rank[-1]])

        if len(self.wide):
            for q in range(n):
                score(q, self.wide)
        for j in range(len(asked) - 1, -1, -1):
            t = int(asked[j])
            wants = np.flatnonzero(w[:, j] > 0)
            docs = self.docs[self.list_start[t] : self.list_start[t] + self.length[t]]
            self.passed += len(docs) * int((left[wants, j] < least[wants]).sum())  # all blocks of the list at once
            wants = wants[left[wants, j] >= least[wants]]
            if not len(wants) or not len(docs):
                continue
            if t >= len(self.blocks):
                for q in wants.tolist():
                    score(q, docs)
                continue
            sizes = self.cuts[self.block_start[t] : self.block_start[t] + self.blocks[t]]
            begin = np.cumsum(sizes) - sizes
            bounds = w[wants, : j + 1] @ self.summary(t, column, j + 1).T
            for q, bound in zip(wants.tolist(), bounds):
                falling = np.argsort(-bound, kind="stable")
                opened = 0
                for lo, hi in ((0, 1), (1, 4), (4, 16), (16, len(falling))):
                    now = falling[lo:hi]
                    now = now[bound[now] >= least[q]]
                    if not len(now):
                        break
                    score(q, docs[spans(begin[now], sizes[now])])
                    opened += int(sizes[now].sum())
                self.opened += opened
                self.passed += len(docs) - opened
        q = np.repeat(np.arange(n), [len(b[0]) for b in best])
        return q, np.concatenate([b[0] for b in best]), np.concatenate([b[1] for b in best]).astype(np.int64)


def query_terms(queries: DataFrame) -> DataFrame:
    """``block, item_id, q, term`` for every distinct term of every query; q tells apart texts that share an id."""
    asked = queries.filter("item_id is not null").select("item_id", "text", F.xxhash64("text").alias("q")).distinct()
    asked = kept(asked)
    groups = max(1, -(-asked.count() // QUERIES))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [word_hashes(sorted(set(terms_of(t)))).view(np.int64) for t in utf8(batch["text"].tolist())]
            row = np.repeat(np.arange(len(found)), [len(f) for f in found])
            out = batch[["block", "item_id", "q"]].iloc[row].reset_index(drop=True)
            out["term"] = np.concatenate([np.zeros(0, np.int64), *found])
            yield out

    block = F.pmod(F.xxhash64("item_id", "q"), F.lit(groups)).cast("int")
    return asked.withColumn("block", block).mapInPandas(run, "block int, item_id long, q long, term long")


SENT = ["items", "qs", "query", "terms", "number", "weights"]


def packed_block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Queries of a block in one row: ids, and for each query its terms by number, with their weights."""
    rows = rows.sort_values(["item_id", "q", "term"])
    items, q = rows["item_id"].to_numpy(np.int64), rows["q"].to_numpy(np.int64)
    new = np.ones(len(rows), bool)
    new[1:] = (items[1:] != items[:-1]) | (q[1:] != q[:-1])
    terms, number = np.unique(rows["term"].to_numpy(np.int64), return_inverse=True)
    weight = np.zeros(len(terms), np.int64)
    weight[number] = rows["w"].to_numpy(np.int64)
    out = [items[new].tobytes(), q[new].tobytes(), pack(np.cumsum(new) - 1), terms.tobytes(), pack(number), pack(weight)]
    return pd.DataFrame([[int(key[0]), *out]], columns=["block", *SENT])


#: Bytes of packed queries that are broadcast; more meet the shards without.
BROADCAST = 64 << 20


def search(index: DataFrame, sent: DataFrame, k: int) -> DataFrame:
    """``item_id, q, doc_id, score``: the best ``k`` of each shard of ``index`` for the query blocks of ``sent``.

    The stated query set goes, in groups of blocks, to every shard, which stays
    where it is read. A query isn't searched below its floor.
    """
    columns = ["block", *SENT, "floors"]
    group = sent.groupBy((F.col("block") / TOGETHER).cast("int").alias("g")).agg(F.collect_list(F.struct(*columns)).alias("asked")).drop("g")
    group = kept(group)
    size = group.select(F.explode("asked").alias("a")).agg(F.sum(sum(F.octet_length(f"a.{c}") for c in SENT))).first()[0] or 0
    met = index.drop("df", "n_docs").join(F.broadcast(group) if size <= BROADCAST else group, F.lit(True))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                shard = Shard(row)
                for b in sorted(row.asked, key=lambda b: b["block"]):
                    items, qs = np.frombuffer(b["items"], np.int64), np.frombuffer(b["qs"], np.int64)
                    number = unpack(b["number"])
                    floors = {(f["item_id"], f["q"]): f["score"] for f in (b["floors"] if b["floors"] is not None else ())}
                    least = np.array([floors.get(i, 0) for i in zip(items.tolist(), qs.tolist())], np.int64)
                    terms, weights = np.frombuffer(b["terms"], np.int64)[number], unpack(b["weights"])[number]
                    i, d, s = shard.top(unpack(b["query"]), terms, weights, least, k)
                    yield pd.DataFrame({"item_id": items[i], "q": qs[i], "doc_id": shard.ids[d], "score": s})

    return met.mapInPandas(run, "item_id long, q long, doc_id long, score long")


def best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item_id", "q").orderBy(F.col("score").desc(), "doc_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def rank(docs: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` rows of ``docs`` with the highest score above 0 for each of ``queries``.

    ``docs`` has doc_id (any whole number) and text, ``queries`` item_id and
    text. Weights use the counts of all of ``docs``; a query's terms count once.
    Equal scores rank by doc_id. Null and empty texts, and texts without a term,
    are never found and find nothing. Rows without a doc_id count in the
    statistics and are not returned; rows without an item_id are not asked.
    Repeated documents are found each; equal queries of one id are asked once,
    different ones of one id are ranked apart. A text of any length is one
    document of a shard of its own. Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/lexical-{uuid.uuid4().hex}"
    index = build_index(docs, folder)
    terms = kept(query_terms(queries))
    asked = kept(terms.select("term").distinct())
    pairs = index.select(F.explode(F.arrays_zip("terms", "df")).alias("e"), "n_docs").select(F.col("e.terms").alias("term"), "e.df", "n_docs")
    df = pairs.join(broadcast_within(asked), "term").groupBy("term").agg(F.sum("df").alias("df"), F.max("n_docs").alias("n"))
    weight = F.floor(1000 * F.log((2.0 * F.col("n") + 2) / (2.0 * F.col("df") + 1))).alias("w")
    weighted = terms.join(df.select("term", weight), "term")
    sent = kept(weighted.groupBy("block").applyInPandas(packed_block, "block int, " + ", ".join(f"{c} binary" for c in SENT)))
    first = F.pmod(F.xxhash64("shard"), F.lit(FIRST)) == 0
    floor = F.struct("item_id", "q", "score")
    no_floor = F.lit(None).cast("array<struct<item_id:bigint,q:bigint,score:bigint>>")
    early = kept(best(search(index.filter(first), sent.withColumn("floors", no_floor), k), k))
    block = terms.select("block", "item_id", "q").distinct()
    floors = early.filter(F.col("rank") == k).join(block, ["item_id", "q"]).groupBy("block").agg(F.collect_list(floor).alias("floors"))
    late = search(index.filter(~first), sent.join(floors, "block", "left"), k)
    found = best(early.drop("rank").unionByName(late), k)
    found = kept(found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    remove_folder(spark, folder)
    return found
