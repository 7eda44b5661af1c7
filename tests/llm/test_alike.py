"""The pipeline's near copies against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from askwell.llm import alike

from .tables import SF, documents, empty, odd
from .test_corpus import brute_print, ordered, pairs


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def survivors(rows):
    """Smallest id of every component over all pairs of similarity 0.8 or more."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if 10 * common >= 8 * (len(sets[a]) + len(sets[b]) - common):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        key = (i is None, i or 0)
        least[find(a)] = min(key, least.get(find(a), key))
    return ordered((None if n else i,) for n, i in least.values())


def edited(rng, words, share):
    return [f"new{rng.integers(10**6)}" if rng.random() < share else w for w in words]


@pytest.mark.parametrize("make", [documents, odd])
def test_real_and_odd(spark, make):
    docs = make(spark)
    got = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert got.columns == docs.columns
    assert ordered(pairs(got, "doc_id")) == survivors(pairs(docs, "doc_id", "text"))
    assert alike.keep_one(empty(spark)).count() == 0


@pytest.mark.parametrize("share", [0.005, 0.015, 0.03])
def test_copies_chains_and_bands_of_several_components(spark, share):
    rng, rows = np.random.default_rng(3), []
    for group in range(12):
        words = [f"w{rng.integers(400)}" for _ in range(120)]
        for k in range(12):
            rows.append((len(rows), " ".join(edited(rng, words, share))))
            if k % 4 == 3:  # the next ones are copies of a copy
                words = rows[-1][1].split()
    rows = [rows[i] for i in rng.permutation(len(rows))]
    got = alike.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert ordered(pairs(got, "doc_id")) == survivors(rows)


def test_large_bands_just_below_the_similarity(spark, monkeypatch):
    """Hundreds of edits of one text, most pairs of them just below 0.8, in chunks and cells of several sizes."""
    rng, base = np.random.default_rng(11), [f"w{i % 97}" for i in range(150)]
    rows = [(i, " ".join(edited(rng, base, 0.012 if i % 7 else 0.02))) for i in range(260)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = survivors(rows)
    for chunk, group in ((1024, 8192), (40, 100)):
        monkeypatch.setattr(alike, "CHUNK", chunk)
        monkeypatch.setattr(alike, "GROUP", group)
        assert ordered(pairs(alike.keep_one(docs), "doc_id")) == want
    assert 1 < len(want) < 260


def test_near_fingerprints_without_common_shingles_enough(spark):
    """Long repeats settle the fingerprint, while most of the distinct shingles differ; and a chain over both kinds of links."""
    rng = np.random.default_rng(5)
    repeats = " ".join("alpha beta gamma delta epsilon".split() * 60)
    rows = [(i, " ".join([repeats, *[f"t{rng.integers(10**6)}" for _ in range(30)]])) for i in range(2, 6)]
    rows.append((1, rows[0][1] + " one more"))  # shares 0.8 with the first
    rows.append((9, " ".join(f"o{k}" for k in range(80))))
    prints = [brute_print(t) for _, t in rows]
    assert all((a ^ b).bit_count() <= 4 for a in prints[:4] for b in prints[:4])
    assert survivors(rows) == ordered([(1,), (3,), (4,), (5,), (9,)])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(pairs(corpus_pipeline.drop_near_copies(spark, docs, SF), "doc_id")) == ordered([(1,), (9,)])


def test_counts_of_common_shingles():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, rng.integers(0, 120))) for _ in range(70)]
    owner = np.repeat(np.arange(70), [len(s) for s in sets])
    got = np.concatenate([c for _, c in alike.common_counts(owner, np.concatenate(sets), 70)])
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    shared = np.bincount(np.concatenate(sets)) > 1
    assert (got - np.diag(np.diag(got)) == want - np.diag(np.diag(want))).all() and shared.any()
