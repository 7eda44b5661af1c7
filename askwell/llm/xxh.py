"""XXH64 of many byte ranges at once, in numpy."""

from __future__ import annotations

import numpy as np

# Fixed values of the hash function.
PRIME_1 = np.uint64(0x9E3779B185EBCA87)
PRIME_2 = np.uint64(0xC2B2AE3D27D4EB4F)
PRIME_3 = np.uint64(0x165667B19E3779F9)
PRIME_4 = np.uint64(0x85EBCA77C2B2AE63)
PRIME_5 = np.uint64(0x27D4EB2F165667C5)


def _left(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _left(acc + lane * PRIME_2, 31) * PRIME_1


def _same_length(data: bytes, starts: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Hashes of the ranges of one length."""
    with np.errstate(over="ignore"):
        seed64, n = np.uint64(seed), len(starts)

        def lane8(at: int) -> np.ndarray:
            view = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
            return view[starts + at]

        def lane4(at: int) -> np.ndarray:
            view = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))
            return view[starts + at].astype(np.uint64)

        at = 0
        if length >= 32:
            seeds = [seed64 + PRIME_1 + PRIME_2, seed64 + PRIME_2, seed64, seed64 - PRIME_1]
            accs = [np.full(n, s, np.uint64) for s in seeds]
            while at + 32 <= length:
                accs = [_round(a, lane8(at + 8 * i)) for i, a in enumerate(accs)]
                at += 32
            h = _left(accs[0], 1) + _left(accs[1], 7) + _left(accs[2], 12) + _left(accs[3], 18)
            for a in accs:
                h = (h ^ _round(np.zeros(n, np.uint64), a)) * PRIME_1 + PRIME_4
        else:
            h = np.full(n, seed64 + PRIME_5, np.uint64)
        h = h + np.uint64(length)
        while at + 8 <= length:
            h = _left(h ^ _round(np.zeros(n, np.uint64), lane8(at)), 27) * PRIME_1 + PRIME_4
            at += 8
        if at + 4 <= length:
            h = _left(h ^ (lane4(at) * PRIME_1), 23) * PRIME_2 + PRIME_3
            at += 4
        single = np.frombuffer(data, np.uint8)
        while at < length:
            h = _left(h ^ (single[starts + at].astype(np.uint64) * PRIME_5), 11) * PRIME_1
            at += 1
        h = (h ^ (h >> np.uint64(33))) * PRIME_2
        h = (h ^ (h >> np.uint64(29))) * PRIME_3
        return h ^ (h >> np.uint64(32))


def xxh64(data: bytes, starts: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of ``data[start:start + length]`` for every pair; ranges may overlap."""
    out = np.zeros(len(starts), np.uint64)
    padded = data + bytes(8)
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    cuts = np.flatnonzero(np.diff(ordered)) + 1
    for block in np.split(order, cuts) if len(order) else []:
        out[block] = _same_length(padded, starts[block], int(lengths[block[0]]), seed)
    return out
