"""Byte-level BPE: pieces of equal length class merge side by side in padded matrices."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks
from .shards import spans

#: Longest piece (bytes) of each matrix; longer pieces merge alone, from a heap.
WIDTHS = (2, 4, 8, 16, 32, 64, 128, 256)
#: Rows of a matrix at once, pieces of a text at once, and pieces a worker remembers.
ROWS, PIECES, REMEMBERED = 1 << 14, 1 << 16, 1 << 19
#: A pair that no token is made of; no rank reaches it.
NONE = np.int64(1) << 40


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class PairTable:
    """Ranks of pairs of ranks in an open-addressed hash table, looked up for whole arrays."""

    SPREAD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(4, int(2 * max(len(rank), 1)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int64)
        key = left << 32 | right
        at, open_ = self.slot(key), np.arange(len(key))
        while len(open_):  # the first of those that meet in a free slot takes it, the others move on
            free = open_[self.keys[at[open_]] < 0]
            _, first = np.unique(at[free], return_index=True)
            taken = free[first]
            self.keys[at[taken]], self.ranks[at[taken]] = key[taken], rank[taken]
            open_ = np.setdiff1d(open_, taken, assume_unique=True)
            at[open_] = at[open_] + 1 & self.mask

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * self.SPREAD >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``NONE`` if no token is made of it."""
        key = left << 32 | right
        at = self.slot(key)
        have = self.keys[at]
        out = np.where(have == key, self.ranks[at], NONE)
        open_ = np.flatnonzero((have != key) & (have >= 0))
        while len(open_):
            at[open_] = at[open_] + 1 & self.mask
            have = self.keys[at[open_]]
            same = have == key[open_]
            out[open_[same]] = self.ranks[at[open_[same]]]
            open_ = open_[~same & (have >= 0)]
        return out


class Vocabulary:
    """Ranks of a vocabulary file, its pairs, and the bytes and decimal form of every id."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        left, right, rank = [], [], []
        for token, number in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(number)
        self.pairs = PairTable(*(np.array(c, np.int64) for c in (left, right, rank)))
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, number in self.ranks.items():
            tokens[number] = token
        self.tokens = tokens
        self.decimals = [b"%d" % i for i in range(len(tokens))]
        self.known: dict[str, int] = {}
        self.ids, self.starts = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))

    def text(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, a blank between them."""
        return b" ".join(map(self.decimals.__getitem__, ids.tolist()))

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """The number under which each piece's ids are known; new ones are merged first."""
        try:
            return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        except KeyError:
            pass
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.ids, self.starts = np.zeros(0, np.int64), np.zeros(1, np.int64)
        new = list({p for p in pieces if p not in self.known})
        found = self.merged([p.encode() for p in new])
        self.known.update(zip(new, range(len(self.starts) - 1, len(self.starts) - 1 + len(new))))
        self.ids = np.concatenate([self.ids, *found])
        self.starts = np.append(self.starts, self.starts[-1] + np.cumsum([len(f) for f in found]))
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces in a row, and how many each has."""
        number = self.numbers(pieces)
        sizes = self.starts[number + 1] - self.starts[number]
        return self.ids[spans(self.starts[number], sizes)], sizes

    def merged(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece: its own if it is a token, else by merges."""
        out: list = [None] * len(pieces)
        classes: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = np.array([whole], np.int64)
            elif len(piece) > WIDTHS[-1]:
                out[i] = self.merge_long(piece)
            else:
                classes.setdefault(next(w for w in WIDTHS if len(piece) <= w), []).append(i)
        for width, members in classes.items():
            for first in range(0, len(members), ROWS):
                own = members[first : first + ROWS]
                for i, ids in zip(own, self.merge_rows([pieces[i] for i in own], width)):
                    out[i] = ids
        return out

    def merge_rows(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Rounds over a padded matrix: each row merges its leftmost pair of least rank, then closes the gap.

        Rows without a pair leave the matrix. Only the two pairs beside a merge
        are looked up again.
        """
        sizes = np.array([len(p) for p in pieces], np.int64)
        data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        ids = self.single[data]
        ranks = np.full((len(pieces), width), NONE, np.int64)
        ranks[:, :-1] = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        column = np.arange(width)
        ranks[column[None, :] >= sizes[:, None] - 1] = NONE
        out: list = [None] * len(pieces)
        alive = np.arange(len(pieces))
        while len(alive):
            at = ranks.argmin(axis=1)  # the first of equal ones
            row = np.arange(len(alive))
            best = ranks[row, at]
            done = np.flatnonzero(best == NONE)
            for r in done.tolist():
                out[alive[r]] = ids[r, : sizes[r]].copy()
            if len(done):
                stay = np.flatnonzero(best != NONE)
                alive, ids, ranks, sizes, at, best = alive[stay], ids[stay], ranks[stay], sizes[stay], at[stay], best[stay]
                row = np.arange(len(alive))
                if not len(alive):
                    break
            ids[row, at] = best
            # All right of the merged pair moves one place to the left.
            source = np.minimum(column[None, :] + (column[None, :] > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, source, axis=1)
            source = np.minimum(column[None, :] + (column[None, :] >= at[:, None] + 1), width - 1)
            ranks = np.take_along_axis(ranks, source, axis=1)
            sizes = sizes - 1
            ranks[:, -1] = NONE
            ranks[row, at] = NONE
            right = np.flatnonzero(at + 1 < sizes)
            ranks[right, at[right]] = self.pairs.find(best[right], ids[right, at[right] + 1])
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.pairs.find(ids[left, at[left] - 1], best[left])
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges in the same order for one long piece, in n log n steps."""
        n = len(piece)
        ids = self.single[np.frombuffer(piece, np.uint8)]
        ranks = self.pairs.find(ids[:-1], ids[1:])
        at = np.flatnonzero(ranks != NONE)
        heap = list(zip(ranks[at].tolist(), at.tolist()))
        heapq.heapify(heap)
        ids, ranks = ids.tolist(), [*ranks.tolist(), int(NONE)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        seen: dict[tuple[int, int], int] = {}

        def rank_of(a: int, b: int) -> int:
            if (a, b) not in seen:
                seen[a, b] = int(self.pairs.find(np.array([a], np.int64), np.array([b], np.int64))[0])
            return seen[a, b]

        while heap:
            rank, i = heapq.heappop(heap)
            if ids[i] < 0 or ranks[i] != rank:
                continue  # merged away, or its pair has changed since
            gone = after[i]
            ids[i], ids[gone], after[i] = rank, -1, after[gone]
            if after[i] < n:
                before[after[i]] = i
            for j in (before[i], i):
                if j >= 0:
                    ranks[j] = rank_of(ids[j], ids[after[j]]) if after[j] < n else int(NONE)
                    if ranks[j] != NONE:
                        heapq.heappush(heap, (ranks[j], j))
        found = np.array(ids, np.int64)
        return found[found >= 0]


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def compiled(expression: str) -> regex.Pattern:
    return regex.compile(expression)


def windows(texts: list[str], split: regex.Pattern) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    """First text, pieces per text, and pieces in a row: of many short texts, or of a part of a long one."""
    sizes = [len(t) for t in texts]
    for start, end in blocks(sizes, 1 << 19):
        if end - start > 1 or sizes[start] <= 1 << 19:
            found = [split.findall(t) for t in texts[start:end]]
            yield start, np.array([len(f) for f in found], np.int64), [p for f in found for p in f]
            continue
        matches = (m.group() for m in split.finditer(texts[start]))
        while part := list(islice(matches, PIECES)):
            yield start, np.array([len(part)], np.int64), part


def digests(texts: list[str], vocabulary: Vocabulary, split: regex.Pattern) -> list[tuple[int, str, str]]:
    """Per text: how many ids, SHA-256 of the ids in decimal, and of the bytes they decode to."""
    count = [0] * len(texts)
    ids_hash = [hashlib.sha256() for _ in texts]
    text_hash = [hashlib.sha256() for _ in texts]
    for start, per_text, pieces in windows(texts, split):
        ids, per_piece = vocabulary.encode(pieces)
        ends = np.concatenate([[0], np.cumsum(per_piece)])[np.cumsum(per_text)]
        for i, own in enumerate(np.split(ids, ends[:-1]), start):
            if len(own):
                ids_hash[i].update((b" " if count[i] else b"") + vocabulary.text(own))
                text_hash[i].update(vocabulary.decode(own))
                count[i] += len(own)
    return [(n, a.hexdigest(), b.hexdigest()) for n, a, b in zip(count, ids_hash, text_hash)]


def encode(docs: DataFrame, path: str | None = None, expression: str | None = None) -> DataFrame:
    """``docs`` with a column ``ids`` (array of int), in place of one of that name: the ids of every whole text.

    A match of ``expression`` that is a token has that id; else, starting from
    bytes, the leftmost of the adjacent pairs whose joined bytes have the least
    rank is merged until none is a token. Null and empty texts have no ids. What
    the expression doesn't match isn't encoded (the public one matches all).
    Other columns stay; repeated rows stay.
    """
    path, expression = path or vocabulary(), expression or pattern()
    columns = [c for c in docs.columns if c != "ids"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, split = load(path), compiled(expression)
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"].tolist()]
            parts: list[list[np.ndarray]] = [[] for _ in texts]
            for start, per_text, pieces in windows(texts, split):
                ids, per_piece = known.encode(pieces)
                ends = np.concatenate([[0], np.cumsum(per_piece)])[np.cumsum(per_text)]
                for i, own in enumerate(np.split(ids, ends[:-1]), start):
                    parts[i].append(own)
            yield batch.assign(ids=[np.concatenate(p).astype(np.int32) if p else np.zeros(0, np.int32) for p in parts])

    schema = docs.select(*[F.col(f"`{c}`") for c in columns], F.array().cast("array<int>").alias("ids")).schema
    return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInPandas(run, schema)


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``rows`` with a binary column ``bytes``, in place of one of that name: what each row's ``ids`` stand for.

    Null ids decode to no bytes; an id outside the vocabulary is an error.
    """
    path = path or vocabulary()
    columns = [c for c in rows.columns if c != "bytes"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = load(path)
        for batch in batches:
            ids = [np.zeros(0, np.int64) if i is None else np.asarray(i, np.int64) for i in batch["ids"].tolist()]
            yield batch.assign(bytes=[known.decode(i) for i in ids])

    schema = rows.select(*[F.col(f"`{c}`") for c in columns], F.lit(b"").alias("bytes")).schema
    return rows.select(*[F.col(f"`{c}`") for c in columns]).mapInPandas(run, schema)


def digest(docs: DataFrame, path: str | None = None, expression: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row of ``docs`` (doc_id, text).

    The ids of ``encode`` and the bytes of ``decode`` without either as a column:
    a text is hashed in windows, so a very long one needs little more than
    itself. Null, empty: no ids and no bytes. A missing doc_id stays missing, and
    repeated rows stay; other columns are ignored.
    """
    path, expression = path or vocabulary(), expression or pattern()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, split = load(path), compiled(expression)
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"].tolist()]
            out = pd.DataFrame(digests(texts, known, split), columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind(docs, 'doc_id')}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
