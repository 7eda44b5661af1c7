"""The pipeline's stages, each against its own input, on real and on odd documents."""

from __future__ import annotations

from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline

from .tables import SF, documents, empty, odd
from .test_corpus import brute_print, brute_stats, ordered, pairs


def test_registered(spark):
    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names and [n for n, _ in corpus_pipeline.STAGES][1] == "near-duplicates"


@pytest.mark.parametrize("make", [documents, odd])
def test_stages(spark, make, tmp_path):
    docs = make(spark)
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(number))
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        last = number == len(corpus_pipeline.STAGES) - 1
        assert last or out.columns == docs.columns
        before, after = (Counter(map(tuple, d.collect())) for d in (docs, out))
        if number == 0:
            assert not after - before  # rows as they were, none twice
            assert all(not brute_stats(t)[-1] for _, t in pairs(out, "doc_id", "text"))
        if number == 1:
            assert not after - before
            prints = [brute_print(t) for _, t in pairs(out, "doc_id", "text")]
            assert all((a ^ b).bit_count() > 4 for i, a in enumerate(prints) for b in prints[:i])
        if number == 2:
            assert out.count() == docs.count() and all(n == len(t or "") for n, t in pairs(out, "n_chars", "text") if t is not None)
        if number == 3:
            size = Counter()
            for i, t in pairs(docs, "doc_id", "text"):
                size[i] += len((t or "").encode().split())
            taken = Counter()
            for i, t in pairs(out, "doc_id", "text"):
                taken[i] += len(t.encode().split())
            assert all(taken[i] <= 2 * size[i] for i in taken)
        if last:
            assert Counter(i for i, p in pairs(out, "doc_id", "piece") if p == 0) == Counter(i for (i,) in pairs(docs, "doc_id"))
        docs = out


def test_run_and_empty(spark):
    rows = corpus_pipeline.run(spark, SF)
    spaces = {}
    for s, o, n in pairs(rows, "sequence_id", "offset", "length"):
        spaces.setdefault(s, []).append((o, n))
    for parts in spaces.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    assert ordered(pairs(rows, "*")) == ordered(pairs(corpus_pipeline.run(spark, SF), "*"))
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
