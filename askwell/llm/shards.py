"""Texts cut into shards that numpy handles whole, and values that go to buckets as packed arrays."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import xxhash


def word_table(texts: Iterable[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of tokenised texts, the word numbers in a row, and the words per text.

    Texts that come from a generator are never held as words all at once.
    """
    number = defaultdict(count().__next__)
    ids = [np.fromiter(map(number.__getitem__, t), np.int64, len(t)) for t in texts]
    sizes = np.array([len(x) for x in ids], np.int64)
    return list(number), np.concatenate(ids) if ids else np.zeros(0, np.int64), sizes


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    """A 64-bit hash per word: two of 2^20 words meet with a chance of 2^-25."""
    return np.array([xxhash.xxh3_64_intdigest(w, seed) for w in words], np.uint64)


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes of many ranges in a row."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    filled = lengths > 0
    starts, lengths = starts[filled], lengths[filled]
    if not total:
        return out[:0]
    out[0] = starts[0]
    at = np.cumsum(lengths)[:-1]
    out[at] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out)


def gathered(batches: Iterator, sizes, limit: int) -> Iterator[list]:
    """Rows of Arrow batches (as tuples) in lists of about ``limit`` by the size of each."""
    rows, total = [], 0
    for batch in batches:
        for row in batch.itertuples(index=False):
            rows.append(row)
            total += sizes(row)
            if total >= limit:
                yield rows
                rows, total = [], 0
    if rows:
        yield rows


def pack(values: np.ndarray) -> bytes:
    """Small numbers in the narrowest type, compressed."""
    kind = np.min_scalar_type(values.max(initial=0))
    return kind.char.encode() + zlib.compress(values.astype(kind).tobytes(), 1)


def unpack(data: bytes, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), np.dtype(chr(data[0]))).astype(kind)
