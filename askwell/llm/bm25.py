"""Exact BM25 top-k: an inverted index per shard, searched with block-max pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, utf8
from .shards import gathered, pack, spans, unpack, word_hashes, word_table

K1, B = 1.2, 0.75
#: Text of a shard, and what a document counts besides; documents of a block; buckets that terms meet in.
SHARD_BYTES, DOC_BYTES, BLOCK_DOCS, BUCKETS = 48 << 20, 1024, 64, 64
#: Queries that are sent together, and searched together.
SENT, TOGETHER = 2048, 256
#: A shard's most frequent terms, whose impacts stand in a matrix.
COMMON = 512
#: Sums of doubles agree so far: scores equal to so many digits are ties.
DIGITS = 9


def index_shard(doc_ids: list, texts: list) -> dict:
    """The inverted index of one shard: sorted terms, their document frequencies, postings and the documents.

    Documents stand by their most frequent term and then by size, so that those
    of a block are alike and the block's maxima low where its documents are.
    """
    words, ids, sizes = word_table(d.lower().split() for d in utf8(texts))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    hashes = word_hashes(words)
    order = np.argsort(hashes)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    pair, counts = counted(owner << 32 | place[ids]) if len(ids) else (ids, ids)
    top = np.zeros(len(sizes), np.int64)
    rank = np.lexsort((counts, pair >> 32))
    top[pair[rank] >> 32] = pair[rank] & 0xFFFFFFFF  # the last one of a document is its most frequent
    sort = np.lexsort((sizes, top))
    moved = np.empty(len(sort), np.int64)
    moved[sort] = np.arange(len(sort))
    term, doc = pair & 0xFFFFFFFF, moved[pair >> 32]
    final = np.lexsort((doc, term))
    return {
        "terms": hashes[order], "df": np.bincount(term, minlength=len(words)), "docs": doc[final], "tf": counts[final],
        "ids": np.array(doc_ids, np.int64)[sort], "sizes": sizes[sort],
    }


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys.astype(np.uint64)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys)))


PARTS = ["terms", "df", "docs", "tf", "ids", "sizes"]
INDEX = "shard long, bucket int, n_docs long, n_words long, " + ", ".join(f"{p} binary" for p in PARTS)


def build(docs: DataFrame) -> DataFrame:
    """One row per shard with its index (bucket -1), and its document frequencies by buckets of terms."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number = TaskContext.get().partitionId(), 0
        for rows in gathered(batches, lambda r: len(r[1] or "") + DOC_BYTES, SHARD_BYTES):
            index = index_shard([r[0] for r in rows], [r[1] for r in rows])
            shard = part << 32 | number
            number += 1
            bucket = (index["terms"] >> np.uint64(58)).astype(np.int64)
            edges = np.searchsorted(bucket, np.arange(BUCKETS + 1))
            whole = [index[p].tobytes() if p in ("terms", "ids") else pack(index[p]) for p in PARTS]
            out = [(shard, -1, len(rows), int(index["sizes"].sum()), *whole)]
            for b in range(BUCKETS):
                s, e = edges[b], edges[b + 1]
                if s < e:
                    out.append((shard, b, None, None, index["terms"][s:e].tobytes(), pack(index["df"][s:e]), *[None] * 4))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in INDEX.split(", ")])

    return docs.select("doc_id", "text").mapInPandas(run, INDEX)


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, q, term, n`` of every query text; q tells apart texts that share an id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words, ids, sizes = word_table(d.lower().split() for d in utf8(batch["text"].tolist()))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            pair, n = np.unique(owner << 32 | ids, return_counts=True)
            hashes = word_hashes(words).view(np.int64)
            row = pair >> 32
            yield pd.DataFrame({
                "query_id": batch["query_id"].to_numpy()[row], "q": batch["q"].to_numpy()[row],
                "term": hashes[pair & 0xFFFFFFFF] if len(pair) else np.zeros(0, np.int64), "n": n,
            })

    return queries.select("query_id", "q", "text").mapInPandas(run, "query_id long, q long, term long, n long")


def frequencies(index: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, df`` over all shards, for the distinct ``term`` values asked for."""

    def run(key: tuple, shards: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        wanted = np.sort(asked["term"].to_numpy().view(np.uint64))
        total = np.zeros(len(wanted), np.int64)
        for terms_, df in zip(shards["terms"], shards["df"]):
            have = np.frombuffer(terms_, np.uint64)
            at = np.minimum(np.searchsorted(have, wanted), len(have) - 1)
            hit = have[at] == wanted
            total[hit] += unpack(df)[at[hit]]
        return pd.DataFrame({"term": wanted.view(np.int64), "df": total})

    bucket = F.shiftrightunsigned("term", 58).cast("int")
    left = index.filter("bucket >= 0").select("bucket", "terms", "df").groupBy("bucket")
    right = terms.withColumn("bucket", bucket).groupBy("bucket")
    return left.cogroup(right).applyInPandas(run, "term long, df long")


class Searcher:
    """One shard's index, ready for queries under global statistics."""

    def __init__(self, row: pd.Series, mean_size: float):
        self.terms, self.ids = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["ids"], np.int64)
        df, sizes = unpack(row["df"]), unpack(row["sizes"])
        self.docs, tf = unpack(row["docs"]), unpack(row["tf"], np.float64)
        self.df, self.starts = df, np.concatenate([[0], np.cumsum(df)])
        norm = K1 * (1 - B + B * sizes / mean_size)
        self.impact = tf * (K1 + 1) / (tf + norm[self.docs])
        self.blocks = max(1, -(-len(self.ids) // BLOCK_DOCS))
        common = np.argsort(-df, kind="stable")[:COMMON]
        self.column = np.full(len(df), -1)
        self.column[common] = np.arange(len(common))
        # The common terms' impacts by document, and their maxima by block.
        self.dense = np.zeros((len(common), self.blocks * BLOCK_DOCS))
        take = spans(self.starts[common], df[common])
        self.dense[np.repeat(np.arange(len(common)), df[common]), self.docs[take]] = self.impact[take]
        self.highest = self.dense.reshape(len(common), self.blocks, BLOCK_DOCS).max(axis=2)

    def top(self, query: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, k: int) -> tuple:
        """Numbers of queries, documents' places and scores: the best ``k`` of the shard for each of ``n`` queries.

        Rare terms are added up posting by posting. For the common ones a block
        of documents has a bound, the sum of its maxima; blocks are opened from
        the highest bound down, more in each round, and left out where the bound
        is below the query's k-th score so far.
        """
        none = np.zeros(0, np.int64)
        if not len(self.terms):
            return none, none, np.zeros(0)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        hit = self.terms[at] == terms
        query, at, weights = query[hit], at[hit], weights[hit]
        column = self.column[at]
        q = np.zeros((n, len(self.dense)))
        q[query[column >= 0], column[column >= 0]] = weights[column >= 0]
        query, at, weights = query[column < 0], at[column < 0], weights[column < 0]
        wide = self.blocks * BLOCK_DOCS
        take, sizes = spans(self.starts[at], self.df[at]), self.df[at]
        flat = np.repeat(query * wide, sizes) + self.docs[take]
        rare = np.bincount(flat, np.repeat(weights, sizes) * self.impact[take], n * wide).reshape(n, wide)
        bound = q @ self.highest + rare.reshape(n, self.blocks, BLOCK_DOCS).max(axis=2)
        bound = np.where(bound > 0, bound * (1 + 1e-9) + 10.0**-DIGITS, -1.0)
        least, opened = np.zeros(n), np.zeros((n, self.blocks), bool)
        best = (none, none, np.zeros(0))
        order = np.argsort(-bound, axis=1)
        for begin, end in ((0, 1), (1, 4), (4, 16), (16, self.blocks)):
            now = np.zeros((n, self.blocks), bool)
            np.put_along_axis(now, order[:, begin:end], True, axis=1)
            now &= bound >= np.maximum(least, 1e-300)[:, None]
            if not now.any():
                continue
            opened |= now
            found = [best]
            for b in np.flatnonzero(now.any(axis=0)):
                own = np.flatnonzero(now[:, b])
                area = slice(b * BLOCK_DOCS, (b + 1) * BLOCK_DOCS)
                scores = np.round(q[own] @ self.dense[:, area] + rare[own, area], DIGITS)
                i, d = np.nonzero((scores > 0) & (scores >= least[own][:, None]))
                found.append((own[i], d + b * BLOCK_DOCS, scores[i, d]))
            best = tuple(np.concatenate(c) for c in zip(*found))
            rank = np.lexsort((self.ids[best[1]], -best[2], best[0]))
            best = tuple(c[rank] for c in best)
            head = np.searchsorted(best[0], np.arange(n + 1))
            stay = np.arange(len(rank)) - head[best[0]] < k
            full = np.flatnonzero(np.diff(head) >= k)
            least[full] = best[2][head[full] + k - 1]
            best = tuple(c[stay] for c in best)
        return best


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, doc_id, score``: the ``k`` best rows of ``docs`` for each row of ``queries``.

    ``docs`` has doc_id and text, ``queries`` query_id and text. Terms are the
    words of the lower-cased (A-Z) text; a query's repeated words weigh as often.
    Scores use the document frequencies and mean size of all of ``docs``. Ties
    rank by doc_id; rows that share no word with the query are not returned, so
    null, empty and blank texts are never found and find nothing. Rows without a
    doc_id or query_id take part in the statistics only; repeated rows are found
    each; equal queries of one id are asked once. Other columns are ignored.
    """
    index = kept(build(docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), "text")))
    stats = index.filter("bucket = -1").agg(F.sum("n_docs"), F.sum("n_words")).first()
    rows, words = stats[0] or 0, stats[1] or 0
    mean_size = max(words / max(rows, 1), 1e-9)
    asked = queries.filter("query_id is not null").select("query_id", "text", F.xxhash64("text").alias("q")).distinct()
    terms = kept(query_terms(asked))
    df = frequencies(index, terms.select("term").distinct())
    weighted = terms.join(df, "term").select("query_id", "q", "term", "n", "df")
    total = terms.select("query_id", "q").distinct().count()
    groups = max(1, -(-total // SENT))
    block = F.pmod(F.xxhash64("query_id", "q"), F.lit(groups)).cast("int")

    def packed_(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Queries of a block: ids, and their terms by number with what each weighs."""
        rows = rows.sort_values(["query_id", "q", "term"])
        ids, q = rows["query_id"].to_numpy(), rows["q"].to_numpy()
        new = np.ones(len(rows), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (q[1:] != q[:-1])
        terms, number = np.unique(rows["term"].to_numpy().view(np.uint64), return_inverse=True)
        found = np.zeros(len(terms), np.int64)
        found[number] = rows["df"].to_numpy()
        out = [ids[new].tobytes(), q[new].tobytes(), pack(np.cumsum(new) - 1), terms.tobytes(), pack(found), pack(number), pack(rows["n"].to_numpy())]
        return pd.DataFrame([[int(key[0]), *out]], columns=["block", *names])

    names = ["ids", "qs", "query", "terms", "df", "number", "n"]
    packed = weighted.withColumn("block", block).groupBy("block").applyInPandas(
        packed_, "block int, " + ", ".join(f"{c} binary" for c in names)
    )
    shards = index.filter("bucket = -1").drop("bucket")
    everywhere = shards.select("shard").agg(F.collect_list("shard").alias("all")).first()[0]
    # The query blocks go to every shard; both sides meet by the shard's number.
    sent = packed.withColumn("shard", F.explode(F.array(*[F.lit(s).cast("long") for s in everywhere]))) if everywhere else packed.withColumn(
        "shard", F.lit(0).cast("long")
    )

    def search(key: tuple, own: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own):
            shard = Searcher(own.iloc[0], mean_size)
            for row in blocks.sort_values("block").itertuples(index=False):
                ids, qs = np.frombuffer(row.ids, np.int64), np.frombuffer(row.qs, np.int64)
                query, number = unpack(row.query), unpack(row.number)
                terms_ = np.frombuffer(row.terms, np.uint64)[number]
                df_ = unpack(row.df, np.float64)
                weights = unpack(row.n, np.float64) * np.log(1 + (rows - df_ + 0.5) / (df_ + 0.5))[number]
                for first in range(0, len(ids), TOGETHER):
                    s, e = np.searchsorted(query, [first, first + TOGETHER])
                    n = min(TOGETHER, len(ids) - first)
                    i, d, scores = shard.top(query[s:e] - first, terms_[s:e], weights[s:e], n, k)
                    doc = shard.ids[d]
                    real = doc != -(2**63)
                    i = i[real] + first
                    out.append(pd.DataFrame({"query_id": ids[i], "q": qs[i], "doc_id": doc[real], "score": scores[real]}))
        kinds = {"query_id": "int64", "q": "int64", "doc_id": "int64", "score": "float64"}
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype=t) for c, t in kinds.items()})

    found = shards.groupBy("shard").cogroup(sent.groupBy("shard")).applyInPandas(
        search, "query_id long, q long, doc_id long, score double"
    )
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.col("score").desc(), "doc_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
