"""The language model's contexts are whole words."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from askwell.llm import pitman_yor

from .test_corpus import pairs


def test_words_of_one_ending_are_different_contexts(spark):
    """Both words before end alike and what follows is as frequent, so only the whole word tells it."""
    rows = [(i, "firsting left" if i % 2 else "secondting right") for i in range(200)]
    rows += [(1000, "firsting left"), (1001, "firsting right"), (1002, "secondting right"), (1003, "secondting left")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(pairs(pitman_yor.score(docs, F.col("doc_id") < 1000), "doc_id", "score"))
    assert got[1000] > got[1001] + 1 and got[1002] > got[1003] + 1


def test_probabilities_after_a_word_add_up():
    """Over the known words and one unknown, after known words, unknown ones and the start of a text."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"{'abc'[int(x) % 3]}{int(x) % 4}ing" for x in rng.zipf(1.3, 40)) for _ in range(30)]
    t = pitman_yor.shard_tables([*texts, "never ending"], np.arange(31) == 30)
    learnt = t["count"] > 0
    words, number = np.unique(t["word"][learnt], return_inverse=True)
    s = pitman_yor.Leaves(t["words"][words], np.bincount(number), t["befores"], t["before"][learnt], t["count"][learnt])
    assert len(np.unique(s.word2 << 20 | s.ctx2)) == len(s.c2) < len(s.c3)

    def model():
        ctx, c, k = s.totals()
        full, tables = np.zeros((2, pitman_yor.ROOT + 1))
        full[ctx], tables[ctx] = c, k
        d = [0.5, 0.6, 0.7, 0.8]
        own = {"C3": s.of_befores(s.c3), "T3": s.of_befores(s.t3)}
        return {"C": full, "T": tables, "d": d, "stirling": [pitman_yor.stirling(x) for x in d], "base": 1 / (len(s.words) + 1)} | own

    samples = []
    for _ in range(3):
        s.sweep(model(), rng)
        assert (s.t3 >= 1).all() and (s.t3 <= s.c3).all() and s.c2.sum() == s.t3.sum()
        samples.append((s.seated(s.t3[s.several], s.t2, s.t1, s.t0), model()))
    every, n = pitman_yor.WordPredictions(samples), len(s.words)
    for before in range(len(s.befores)):
        p = every.after(np.append(np.arange(n), 0), np.append(np.ones(n, bool), False), np.full(n + 1, before))
        assert p.sum() == pytest.approx(1.0, abs=1e-9) and (p > 0).all()


def test_ascending_numbers_pack():
    for values in ([], [0], [5, 5, 2**64 - 1], range(1000)):
        v = np.array(values, np.uint64)
        assert (pitman_yor.unpack_sorted(pitman_yor.pack_sorted(v)) == v).all()
