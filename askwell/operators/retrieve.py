"""Dense retrieval: exact and product-quantised top-k by inner product.

Brute force needs every question next to every passage, but never as rows:
packed blocks of vectors meet in numpy, and only the best ``k`` per question and
task are emitted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from .blocks import every_pair, matrix, number_of, packed

BROADCAST_BYTES = 64 << 20
#: Sums of products differ in their last digits with the order of addition; scores equal to so many are ties.
SCORE_DIGITS = 12
#: Numbers held at once, of candidates' vectors or of scores that wait.
TILE = 1 << 22
#: Questions and passages of a tile of scores, which stays in a core's cache.
ROWS, COLUMNS = 512, 1024
#: Vectors as long as this are multiplied in double precision, so that no product overflows.
LARGE = 1e15


@dataclass(frozen=True)
class Scorer:
    """How passages score: ``matrix`` for each question with each passage, ``pairs`` for each with its own.

    ``vectors`` are the passages' rows whose products with the questions are the scores but for rounding.
    """

    matrix: Callable[[np.ndarray, np.ndarray], np.ndarray]
    pairs: Callable[[np.ndarray, np.ndarray], np.ndarray]
    vectors: Callable[[np.ndarray], np.ndarray]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _products(questions: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return questions @ vectors.T.astype(np.float64)


def _own_products(questions: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", questions, vectors.astype(np.float64))


def rows_at_once(numbers: int) -> int:
    """Rows of so many numbers held together, so that what is held stays bounded whatever their width."""
    return max(1, TILE // max(1, numbers))


def _id_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _ordinal(ids: np.ndarray) -> np.ndarray:
    """Numbers in the order of the ids."""
    return ids if ids.dtype.kind in "iufMm" else pd.factorize(ids, sort=True)[0]


def _places(keys: np.ndarray) -> np.ndarray:
    """The place of each row within its run of equal, sorted keys."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return np.arange(len(keys)) - np.repeat(first, np.diff(first, append=len(keys)))


def _distinct(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each different vector, and each row's number among these."""
    rows = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * vectors.itemsize))).ravel()
    _, first, number = np.unique(rows, return_index=True, return_inverse=True)
    return first, number.ravel()


def _true_at(mask: np.ndarray) -> np.ndarray:
    """Flat places of what is true; eight are skipped at once where none is."""
    flat = mask.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    words = np.flatnonzero(flat.view(np.uint64))
    word, at = np.nonzero(flat.reshape(-1, 8)[words])
    return words[word] * 8 + at


class _Best:
    """The best ``k`` passages so far of each different vector of a block of questions, in rank order."""

    def __init__(self, qids: np.ndarray, vectors: np.ndarray, k: int):
        self.qids, self.k, self.seen = qids, k, 0
        self.first, self.number = _distinct(vectors)
        self.scores = np.full((len(self.first), k), -np.inf)
        self.found = np.zeros(len(self.first), np.int64)
        self.pids: np.ndarray | None = None

    def add(self, row: np.ndarray, scores: np.ndarray, pids: np.ndarray) -> None:
        """Merges passages, each for the question of ``row``; ties by id."""
        if not len(row):
            return
        if self.pids is None:
            self.pids = np.empty(self.scores.shape, pids.dtype)
        own = np.unique(row)
        held, at = np.nonzero(np.arange(self.k) < self.found[own, None])
        held = own[held]
        row = np.concatenate([row, held])
        scores, pids = np.concatenate([scores, self.scores[held, at]]), np.concatenate([pids, self.pids[held, at]])
        order = np.lexsort((_ordinal(pids), -scores, row))
        place = _places(row[order])
        order, place = order[place < self.k], place[place < self.k]
        row = row[order]
        self.scores[row, place], self.pids[row, place] = scores[order], pids[order]
        self.found += np.bincount(row, minlength=len(self.found)) - np.bincount(held, minlength=len(self.found))

    def rows(self) -> pd.DataFrame:
        row, at = np.nonzero(np.arange(self.k) < self.found[self.number, None])
        if not len(row):
            return pd.DataFrame({"qid": self.qids[:0], "pid": [], "score": []})
        own = self.number[row]
        return pd.DataFrame({"qid": self.qids[row], "pid": self.pids[own, at], "score": self.scores[own, at]})


class _Passages:
    """A block of passages as it is scored. Of equal vectors the ``k`` smallest ids are enough; without a number there is no score."""

    def __init__(self, pids: np.ndarray, own: np.ndarray, k: int, scorer: Scorer):
        _, number = _distinct(own)
        order = np.lexsort((_ordinal(pids), number))
        kept = np.sort(order[_places(number[order]) < k]) if len(order) else order
        kept = kept[~np.isnan(own[kept]).any(axis=1)]
        self.pids, self.own = pids[kept], own[kept]
        tiles = (scorer.vectors(self.own[at : at + COLUMNS]).astype(np.float64) for at in range(0, len(kept), COLUMNS))
        self.longest = max((float(np.sqrt(np.square(tile).sum(axis=1).max())) for tile in tiles), default=0.0)


def _meet(best: _Best, questions: np.ndarray, block: _Passages, scorer: Scorer) -> None:
    """Adds a block of passages to the best of the questions.

    Products of single precision leave out what is below the ``k``-th score by
    more than their error; what is left is scored in full.
    """
    asked = questions[best.first]
    length = np.sqrt(np.square(asked.astype(np.float64)).sum(axis=1))
    single = max(length.max(initial=0.0), block.longest) < LARGE
    kind = np.float32 if single else np.float64
    left = asked.astype(kind, copy=False)
    error = (asked.shape[1] + 16) * 2 * float(np.finfo(kind).eps) * length * block.longest + 2 * 10.0**-SCORE_DIGITS
    pairs = rows_at_once(2 * asked.shape[1])
    at = 0
    while at < len(block.pids):
        end = min(len(block.pids), at + max(COLUMNS, best.seen))
        floor = best.scores[:, -1].copy()
        pending: list[tuple] = []
        held = 0
        for start in range(at, end, COLUMNS):
            stop = min(end, start + COLUMNS)
            right = scorer.vectors(block.own[start:stop]).astype(kind, copy=False).T
            for top in range(0, len(asked), ROWS):
                if best.seen < best.k:  # nothing to compare with: the best of this tile are enough
                    near = scorer.matrix(asked[top : top + ROWS].astype(np.float64), block.own[start:stop])
                    limit = np.full(len(near), -np.inf) if near.shape[1] <= best.k else np.partition(near, -best.k, axis=1)[:, -best.k]
                else:
                    near = left[top : top + ROWS] @ right
                    limit = floor[top : top + ROWS]
                margin = error[top : top + ROWS]
                limit = np.where(np.isinf(margin), -np.inf, limit - margin).astype(near.dtype)
                hit = _true_at(near >= limit[:, None])
                for part in range(0, len(hit), pairs):
                    row, col = np.divmod(hit[part : part + pairs], stop - start)
                    row, col = row + top, col + start
                    scores = np.round(scorer.pairs(asked[row].astype(np.float64), block.own[col]), SCORE_DIGITS)
                    good = scores >= floor[row]
                    pending.append((row[good], scores[good], block.pids[col[good]]))
                    held += len(pending[-1][0])
                if held > TILE // 4:
                    best.add(*(np.concatenate(x) for x in zip(*pending)))
                    pending, held = [], 0
        if pending:
            best.add(*(np.concatenate(x) for x in zip(*pending)))
        best.seen += end - at
        at = end


def _search(questions: DataFrame, passages: DataFrame, k: int, scorer: Scorer, bound: int) -> DataFrame:
    """Blocks of the side with fewer rows go to every task, or lie on a grid with the other side's splits, which stay where they are scanned.

    Ids keep their type and order by it. Rows without an id or a vector are left out.
    """
    asks = passages.select("pid").count() > questions.select("qid").count()  # few questions, many passages
    q, p = questions.select("qid", "embedding").dropna(), passages.select("pid", "embedding").dropna()
    schema = f"qid {_id_type(q, 'qid')}, pid {_id_type(p, 'pid')}, score double"
    q_number, p_number = number_of(q, "embedding"), number_of(p, "embedding")

    def vectors(block: dict, number: str) -> np.ndarray:
        return matrix(block["data"], block["width"], number)

    def passages_of(block: dict) -> _Passages:
        return _Passages(np.asarray(block["pid"]), vectors(block, p_number), k, scorer)

    def visit() -> Callable:
        best: dict = {}
        last: dict = {}

        def few_questions(block: dict | None, group: int | None, few) -> Iterator[pd.DataFrame]:
            if block is None:
                for found in best.values():
                    yield found.rows()
                return
            if few is None:
                return
            if last.get("block") is not block:
                last["block"], last["passages"] = block, passages_of(block)
            for i, f in enumerate(few):
                asked = vectors(f, q_number)
                if (group, i) not in best:
                    best[group, i] = _Best(np.asarray(f["qid"]), asked, k)
                _meet(best[group, i], asked, last["passages"], scorer)

        def few_passages(block: dict | None, group: int | None, few) -> Iterator[pd.DataFrame]:
            if last.get("block") is not block:
                if "best" in last:
                    yield last.pop("best").rows()
                last["block"] = block
            if block is None or few is None:
                return
            asked = vectors(block, q_number)
            if "best" not in last:
                last["best"] = _Best(np.asarray(block["qid"]), asked, k)
            for f in few:
                _meet(last["best"], asked, passages_of(f), scorer)

        return few_questions if asks else few_passages

    sides = packed(p, ["pid"], "embedding", number=p_number), packed(q, ["qid"], "embedding", number=q_number)
    found, _ = every_pair(*(sides if asks else sides[::-1]), visit, schema, bound)
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "pid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def topk_inner_product(
    questions: DataFrame, passages: DataFrame, k: int = 10, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Exact best ``k`` passages per question: ``qid, pid, score, rank``.

    Ids may have any orderable type. Ties go to the smaller passage id, so the
    result does not depend on how vectors are split into blocks. Fewer than
    ``k`` passages give fewer rows. The side with fewer rows goes to every task;
    beyond ``broadcast_bytes`` it meets the other's splits on a grid of tasks. The
    other side is not shuffled.
    """
    return _search(questions, passages, k, Scorer(_products, _own_products, lambda own: own), broadcast_bytes)


# Product quantisation.


def subvector(vector: Column, part: int, width: int) -> Column:
    return F.slice(vector, part * width + 1, width)


def train_codebook(passages: DataFrame, m: int, bits: int, seed: int = 7, iterations: int = 8) -> DataFrame:
    """Centroids ``(part, code, centroid)`` per sub-vector, by Lloyd's steps on all rows.

    Every step is one pass for all parts: a task adds up its vectors per part and
    nearest centroid, and the sums merge by cell. A centroid nothing is nearest
    to stays. The start is a seeded choice of vectors, as many as the codebook has.
    """
    shape = passages.select(F.size("embedding").alias("d")).first()
    dim = shape["d"] if shape else 0
    if not dim or dim % m:
        raise ValueError(f"{dim} dimensions do not split into {m} parts")
    spark, size, width = passages.sparkSession, 2**bits, dim // m
    vectors = passages.select("embedding").dropna()
    drawn = vectors.orderBy(F.xxhash64(F.lit(seed), "embedding")).limit(2 * size).collect()
    start = list(dict.fromkeys(tuple(map(float, r[0])) for r in drawn))[:size]
    book = np.array([start[i % len(start)] for i in range(size)]).reshape(size, m, width).transpose(1, 0, 2).copy()
    for _ in range(iterations):
        shared = spark.sparkContext.broadcast(book)

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            centres = shared.value
            total, n = np.zeros((m, size, width)), np.zeros((m, size), np.int64)
            for batch in batches:
                if batch.empty:
                    continue
                every = _matrix(batch["embedding"]).reshape(len(batch), m, width)
                for part in range(m):
                    nearest = _nearest(every[:, part], centres[part])
                    n[part] += np.bincount(nearest, minlength=size)
                    for d in range(width):
                        total[part, :, d] += np.bincount(nearest, every[:, part, d], size)
            part, code = np.nonzero(n)
            yield pd.DataFrame({"part": part, "code": code, "total": list(total[part, code]), "n": n[part, code]})

        cells = vectors.mapInPandas(sums, "part int, code int, total array<double>, n long").groupBy("part", "code")
        merged = cells.agg(vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total"), F.sum("n").alias("n"))
        book = book.copy()
        for row in merged.collect():  # one per centroid
            book[row["part"], row["code"]] = np.array(row["total"]) / row["n"]
        shared.unpersist()
    rows = [(part, code, [float(x) for x in book[part, code]]) for part in range(m) for code in range(size)]
    return spark.createDataFrame(rows, "part int, code int, centroid array<double>")


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * vectors @ centres.T).argmin(axis=1)


def codebook_of(vectors: DataFrame, m: int) -> DataFrame:
    """A codebook of given vectors (``code, embedding``): each part of vector ``code`` is that part's centroid."""
    dim = vectors.select(F.size("embedding").alias("d")).first()["d"]
    parts = F.array(*[subvector(F.col("embedding"), i, dim // m).cast("array<double>") for i in range(m)])
    return vectors.select("code", F.posexplode(parts).alias("part", "centroid")).select(
        "part", F.col("code").cast("int").alias("code"), "centroid"
    )


def _book_array(codebook: DataFrame) -> list[np.ndarray]:
    rows = codebook.orderBy("part", "code").collect()  # m * 2^bits rows by construction
    parts: dict[int, list[list[float]]] = {}
    for row in rows:
        parts.setdefault(row["part"], []).append(row["centroid"])
    return [np.array(parts[p]) for p in sorted(parts)]


def encode_pq(passages: DataFrame, codebook: DataFrame) -> DataFrame:
    """``pid, codes``: nearest centroid per sub-vector."""
    books = passages.sparkSession.sparkContext.broadcast(_book_array(codebook))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            vectors, codes, at = _matrix(batch["embedding"]), [], 0
            for book in books.value:
                codes.append(_nearest(vectors[:, at : at + book.shape[1]], book))
                at += book.shape[1]
            yield pd.DataFrame({"pid": batch["pid"], "codes": list(np.stack(codes, axis=1).astype(np.int32))})

    return passages.select("pid", "embedding").mapInPandas(assign, f"pid {_id_type(passages, 'pid')}, codes array<int>")


def _looked_up(books: list[np.ndarray], questions: np.ndarray, codes: Iterable[np.ndarray]) -> np.ndarray:
    """Scores as sums of table entries: per part, the products of the questions with all its centroids."""
    chosen = np.stack(list(codes)).astype(np.int64)
    total, at = np.zeros((len(questions), len(chosen))), 0
    for part, book in enumerate(books):
        table = questions[:, at : at + book.shape[1]] @ book.T  # questions by centroids
        total += table[:, chosen[:, part]]
        at += book.shape[1]
    return total


def _own_looked_up(books: list[np.ndarray], questions: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The same sums for each question with the codes of its own row only."""
    total, at = np.zeros(len(questions)), 0
    for part, book in enumerate(books):
        total += np.einsum("ij,ij->i", questions[:, at : at + book.shape[1]], book[codes[:, part].astype(np.int64)])
        at += book.shape[1]
    return total


def topk_pq(
    questions: DataFrame, codes: DataFrame, codebook: DataFrame, k: int = 10, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Best ``k`` passages per question by inner product with the quantised vectors.

    Scores are looked up. Codes are decoded, a block at a time, only to leave out
    what is not among the best.
    """
    books = questions.sparkSession.sparkContext.broadcast(_book_array(codebook))

    def score(vectors: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        return _looked_up(books.value, vectors, chosen)

    def own(vectors: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        return _own_looked_up(books.value, vectors, chosen)

    def decoded(chosen: np.ndarray) -> np.ndarray:
        return np.concatenate([book[chosen[:, part].astype(np.int64)] for part, book in enumerate(books.value)], axis=1)

    coded = codes.select("pid", F.col("codes").alias("embedding"))
    return _search(questions, coded, k, Scorer(score, own, decoded), broadcast_bytes)


def recall(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """``wanted, found, recall``: the share of the hits ``wanted`` (qid, pid) that are among ``found``."""
    there = found.select("qid", "pid", F.lit(1).alias("__there"))
    both = wanted.select("qid", "pid").join(there, ["qid", "pid"], "left")
    n, hit = F.count("*"), F.count("__there")
    return both.agg(n.alias("wanted"), hit.alias("found"), F.round(hit / n, 6).alias("recall"))


# Results and vectors.


def hydrate(hits: DataFrame, passages: DataFrame, columns: tuple[str, ...] = ("title", "text")) -> DataFrame:
    """Passage columns next to each hit, null where the passage is unknown; no hit is lost."""
    return hits.join(passages.select(F.col("id").alias("pid"), *columns), "pid", "left")


def nest_results(hits: DataFrame, columns: tuple[str, ...] = ("title", "text")) -> DataFrame:
    """One row per question with its ``ctxs`` in rank order (at most ``k`` of them)."""
    entry = F.struct("rank", F.col("pid").cast("string").alias("id"), *columns, "score")
    ordered = F.array_sort(F.collect_list(entry))
    ctxs = F.transform(ordered, lambda c: F.struct(c["id"].alias("id"), *[c[x].alias(x) for x in columns], c["score"].alias("score")))
    return hits.groupBy("qid").agg(ctxs.alias("ctxs"))


def save_vectors(df: DataFrame, path: str, codebook: DataFrame | None = None) -> None:
    """Persist vectors (or codes) with ids, the codebook beside them and the row count."""
    df.write.mode("overwrite").parquet(f"{path}/vectors")
    df.agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/meta")
    if codebook is not None:
        codebook.write.mode("overwrite").parquet(f"{path}/codebook")


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Vectors written by ``save_vectors``; refuses a table whose ids do not match its count."""
    df = spark.read.parquet(f"{path}/vectors")
    expected = spark.read.parquet(f"{path}/meta").first()["n"]
    found = df.filter(F.col(df.columns[0]).isNotNull()).count()
    if found != expected:
        raise ValueError(f"{found} ids for {expected} vectors")
    return df


def l2_normalize(vector: Column) -> Column:
    """Unit-length vector; a zero vector stays as it is."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(norm > 0, F.transform(doubles, lambda x: x / norm)).otherwise(doubles)


def pool_vectors(
    tokens: DataFrame, how: str = "mean", key: str = "id", pos: str = "pos", vector: str = "embedding", mask: str = "mask"
) -> DataFrame:
    """One vector per key: the mean over unmasked tokens, or the first token's vector (``cls``)."""
    if how == "cls":
        return tokens.groupBy(key).agg(F.min_by(vector, pos).alias("pooled"))
    dense = array_to_vector(F.col(vector).cast("array<double>"))
    means = tokens.filter(F.col(mask)).groupBy(key).agg(Summarizer.mean(dense).alias("pooled"))
    return means.withColumn("pooled", vector_to_array("pooled"))


def encode_text(df: DataFrame, text: str, dim: int = 768, lower_case: bool = True, normalize: bool = True) -> DataFrame:
    """Adds ``embedding``: unit-length hashed word counts, the built-in stand-in for a neural encoder."""
    clean = F.coalesce(F.col(text), F.lit(""))
    if normalize:
        clean = normalize_text(clean)
    staged = df.withColumn("__text", clean)
    words = RegexTokenizer(inputCol="__text", outputCol="__words", pattern=r"\W+", toLowercase=lower_case)
    counts = HashingTF(inputCol="__words", outputCol="__tf", numFeatures=dim)
    unit = Normalizer(inputCol="__tf", outputCol="__unit", p=2.0)
    out = unit.transform(counts.transform(words.transform(staged)))
    return out.withColumn("embedding", vector_to_array("__unit", "float32")).drop("__text", "__words", "__tf", "__unit")


def search(
    questions: DataFrame, passages: DataFrame, k: int = 10, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Questions with their nested contexts.

    Vectors are used where both sides carry ``embedding``; otherwise
    ``question`` and ``title text`` go through the built-in encoder.
    """
    if "embedding" not in questions.columns:
        questions = encode_text(questions, "question")
    if "embedding" not in passages.columns:
        joined = F.concat_ws(" ", F.when(F.length("title") > 0, F.col("title")), "text")
        passages = encode_text(passages.withColumn("__passage", joined), "__passage").drop("__passage")
    hits = topk_inner_product(questions, passages.withColumnRenamed("id", "pid"), k, broadcast_bytes)
    return nest_results(hydrate(hits, passages))


def search_texts(spark: SparkSession, texts: str | list[str], passages: DataFrame, k: int = 10) -> DataFrame:
    """``search`` for one question or a list of them given as plain strings."""
    listed = [texts] if isinstance(texts, str) else texts
    questions = spark.createDataFrame(list(enumerate(listed)), "qid long, question string")
    return questions.join(search(questions, passages, k), "qid", "left")
