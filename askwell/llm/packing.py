"""Best-fit packing of tokenised documents with large-item matching."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, partitions, utf8

CAPACITY = 4096
END = 1
#: Words whose ids a worker remembers between texts; beyond, it starts over.
REMEMBERED = 1_200_000
#: Stands between words that are encoded together.
MARK = "\x01"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def _encoder(path: str):
    """The tokenizer, the ids of the mark, and the words whose ids are known."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    mark = tokenizer.encode(MARK, add_special_tokens=False).ids
    return tokenizer, mark, {}


def _core(word: bytes) -> tuple[bytes, bytes]:
    """A word in lower case without the stops and commas after its last letter or digit, and these.

    The vocabulary lower-cases and keeps letters apart from marks, so the ids of
    a word are those of both parts.
    """
    lower = word.lower()
    core = lower.rstrip(b".,")
    return (core, lower[len(core) :]) if core[-1:].isalnum() else (lower, b"")


def _learn(path: str, words: list[bytes], remembered: int) -> dict[bytes, bytes]:
    """Ids of words, as little-endian 32-bit bytes.

    White space always ends a token of this vocabulary, so the ids of a text are
    those of its words. Words are encoded together, a mark between them.
    """
    tokenizer, mark, known = _encoder(path)
    if len(known) > remembered:
        known.clear()
    split = [_core(w) for w in words]
    new = list({part for pair in split for part in pair if part and part not in known})
    odd = new if len(mark) != 1 else [w for w in new if MARK.encode() in w]
    plain = [] if len(mark) != 1 else [w for w in new if MARK.encode() not in w]
    groups = [plain[i : i + 1000] for i in range(0, len(plain), 1000)]
    texts = [f" {MARK} ".join(w.decode("utf-8", "replace") for w in group) for group in groups]
    for group, found in zip(groups, tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
        ids = np.array(found.ids, "<u4")
        ends = np.flatnonzero(ids == mark[0])
        if len(ends) != len(group) - 1:  # a word holds the mark's id in another spelling
            odd += group
            continue
        raw, stops = ids.tobytes(), (4 * ends).tolist()
        for w, begin, stop in zip(group, [0, *[e + 4 for e in stops]], [*stops, len(raw)]):
            known[w] = raw[begin:stop]
    for w in odd:
        known[w] = np.array(tokenizer.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
    for w, (core, rest) in zip(words, split):
        known[w] = known[core] + known[rest] if rest else known[core]
    return known


def encoded(text: bytes, path: str, remembered: int = REMEMBERED) -> bytes:
    """A whole text's ids and the end id, as little-endian 32-bit bytes."""
    words = text.split()
    known = _encoder(path)[2]
    try:
        body = b"".join(map(known.__getitem__, words))
    except KeyError:
        known = _learn(path, list({w for w in words if w not in known}) if len(known) <= remembered else list(set(words)), remembered)
        body = b"".join(map(known.__getitem__, words))
    return body + END.to_bytes(4, "little")


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, remembered: int = REMEMBERED) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every row; longer rows are cut at the capacity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, owner = [], []
            for i, text in enumerate(utf8(batch.iloc[:, 1].tolist())):
                data = encoded(text, path, remembered)
                for number, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    owner.append(i)
                    rows.append((number, at // 4, len(part) // 4, zlib.crc32(part)))
            out = pd.DataFrame(rows, columns=["piece", "start", "length", "ids_crc32"])
            out.insert(0, "doc_id", batch.iloc[:, 0].iloc[owner].reset_index(drop=True))
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", "text").mapInPandas(run, schema)


def layout(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """How pieces of given lengths share sequences, from the counts of lengths alone.

    Returns rows (length, rank, each, first, offset): the pieces of a length
    from rank on lie, ``each`` to a sequence, in sequences from ``first`` on, at
    ``offset`` and after it. Large pieces (over a third of the capacity) go
    first, at most two to a sequence: from the longest down, each is matched
    with the longest that fits beside it. Smaller ones follow, longest first,
    into the tightest gap that holds them. Equal bins are handled together, so
    the work depends on the number of lengths, not of pieces.
    """
    left = dict(counts)
    bins: dict[int, list[tuple[int, tuple]]] = {}  # gap: (number of bins, their runs)

    def put(gap: int, number: int, runs: tuple) -> None:
        if number:
            bins.setdefault(gap, []).append((number, runs))

    large = sorted(x for x in left if 3 * x > capacity)
    while large:
        x = large.pop()
        n = left.pop(x)
        if 2 * x <= capacity:  # two of a kind fit, and nothing longer is left
            put(capacity - 2 * x, n // 2, ((x, 2),))
            n %= 2
        while n:
            at = bisect_right(large, capacity - x) - 1
            if at < 0:
                put(capacity - x, n, ((x, 1),))
                break
            y = large[at]
            m = min(n, left[y])
            put(capacity - x - y, m, ((x, 1), (y, 1)))
            n -= m
            left[y] -= m
            if not left[y]:
                del left[y], large[at]
    gaps = sorted(bins)
    for x in sorted(left, reverse=True):
        n = left[x]
        while n:
            at = bisect_left(gaps, x)
            if at == len(gaps):
                each = capacity // x
                made = [(n // each, each), (1, n % each)]
                for number, q in made:
                    if number and q:
                        gap = capacity - q * x
                        if gap not in bins:
                            gaps.insert(bisect_left(gaps, gap), gap)
                        put(gap, number, ((x, q),))
                break
            gap = gaps[at]
            number, runs = bins[gap].pop()
            if not bins[gap]:
                del bins[gap], gaps[at]
            each = gap // x
            full = min(number, n // each)
            part = n - full * each if full < number else 0
            rest = number - full - bool(part)
            n -= full * each + part
            for many, q in ((full, each), (1 if part else 0, part), (rest, 0)):
                if many:
                    new = gap - q * x
                    if new not in bins:
                        gaps.insert(bisect_left(gaps, new), new)
                    put(new, many, (*runs, (x, q)) if q else runs)
    used: dict[int, int] = {}
    rows, first = [], 0
    for gap in sorted(bins):
        for number, runs in bins[gap]:
            offset = 0
            for x, q in runs:
                rows.append((x, used.get(x, 0), q, first, offset))
                used[x] = used.get(x, 0) + number * q
                offset += x * q
            first += number
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def ranked(table: DataFrame) -> DataFrame:
    """Pieces with ``__rank`` from 0 among those of their length; a length is dealt over salts, so none is gathered."""
    salts = partitions(table.sparkSession)
    salted = table.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "__salt").agg(F.count("*").alias("__c"))
    earlier = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "__salt", F.coalesce(F.sum("__c").over(earlier), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return salted.withColumn("__rank", inside).join(before, ["length", "__salt"]).withColumn(
        "__rank", (F.col("__rank") + F.col("__before")).cast("long")
    ).drop("__salt", "__before")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, remembered: int = REMEMBERED) -> DataFrame:
    """``docs`` (doc_id, text) tokenised, cut and packed: one row per piece.

    Null and empty texts are the end id alone. Repeated rows and ids are pieces
    of their own; other columns are ignored; an empty table gives an empty
    result. Only the counts of lengths, at most ``capacity`` numbers, go through
    the driver. A worker keeps the ids of about ``remembered`` words.
    """
    table = kept(pieces(docs, path or vocabulary(), capacity, remembered))
    counts = {int(r[0]): int(r[1]) for r in table.groupBy("length").count().collect()}
    plan = layout(counts, capacity)
    wide = 1 << 44
    keys = plan[:, 0] * wide + plan[:, 1]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["__rank"].to_numpy()
            row = plan[np.searchsorted(keys, length * wide + rank, side="right") - 1]
            k = rank - row[:, 1]
            out = batch.drop(columns="__rank")
            out["sequence_id"] = row[:, 3] + k // row[:, 2]
            out["offset"] = row[:, 4] + k % row[:, 2] * length
            yield out

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked(table).select(*names, "__rank").mapInPandas(place, schema)
