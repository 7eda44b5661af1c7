"""Packed blocks, codebooks, inversions, resampling, file order and consolidation within a row."""

from __future__ import annotations

import math
import random
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from askwell.operators import answers as A
from askwell.operators import blocks
from askwell.operators import consolidate as V
from askwell.operators import retrieve as R
from askwell.operators import training_stats as TS
from askwell.operators.blocks import every_pair, packed
from askwell.session import scratch
from askwell.sources import records as S


def vectors(spark, rows, name):
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    return spark.createDataFrame(data, f"{name} long, embedding array<double>").repartition(3)


def test_topk_on_a_grid_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    q, p = rng.integers(-3, 4, (70, 6)), rng.integers(-3, 4, (90, 6))  # many ties
    want = []
    for i, row in enumerate(q @ p.T):
        order = sorted(range(len(p)), key=lambda j: (-row[j], j))[:5]
        want += [(i, j, float(row[j]), rank) for rank, j in enumerate(order, 1)]
    for bound in (1 << 20, 400, 1):
        got = R.topk_inner_product(vectors(spark, q, "qid"), vectors(spark, p, "pid"), 5, bound)
        assert sorted(map(tuple, got.select("qid", "pid", "score", "rank").collect())) == sorted(want)


def test_topk_of_empty_and_missing_rows(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (None, [3.0, 1.0])], "qid long, embedding array<double>")
    other = one.withColumnRenamed("qid", "pid")
    assert [tuple(r) for r in R.topk_inner_product(one, other, 3).select("qid", "pid", "score").collect()] == [(1, 1, 5.0)]
    assert R.topk_inner_product(one.limit(0), other).count() == 0 and R.topk_inner_product(one, other.limit(0)).count() == 0


@pytest.mark.parametrize(("asked", "there"), [(1500, 1300), (40, 2600)])
def test_topk_beyond_a_tile_equals_brute_force(spark, monkeypatch, asked, there):
    """Either side as the few, several blocks, ties across them, equal vectors on both sides, ids not in scan order."""
    rng = np.random.default_rng(6)
    q, p = rng.integers(-2, 3, (asked, 5)).astype(float), rng.integers(-2, 3, (there, 5)).astype(float)
    q[3:30], p[200:900] = q[2], p[7]
    q[35], p[:, 4] = 0.0, rng.normal(size=there)  # one asks with zeros: all its scores are ties
    ids = rng.permutation(there)
    left = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "qid long, embedding array<float>")
    data = [(f"p{n:05d}", [float(x) for x in v]) for n, v in zip(ids, p)]
    right = spark.createDataFrame(data, "pid string, embedding array<double>").repartition(2)
    monkeypatch.setattr(R, "COLUMNS", 256)
    scores = np.round(q @ p.T, 12)
    want = {i: [(f"p{ids[j]:05d}", scores[i, j]) for j in np.lexsort((ids, -scores[i]))[:7]] for i in range(asked)}
    for bound in (1 << 20, 4000):
        rows = R.topk_inner_product(left, right, 7, bound).orderBy("qid", "rank").collect()
        assert len(rows) == 7 * asked
        for n, r in enumerate(rows):
            pid, score = want[r["qid"]][n % 7]
            assert r["pid"] == pid and r["score"] == pytest.approx(score, abs=1e-11)


def test_quantised_topk_equals_the_sums_of_table_entries(spark):
    rng = np.random.default_rng(7)
    books = [rng.normal(size=(4, 3)) for _ in range(2)]
    cells = [(part, code, [float(x) for x in book[code]]) for part, book in enumerate(books) for code in range(4)]
    codebook = spark.createDataFrame(cells, "part int, code int, centroid array<double>")
    q, codes = rng.normal(size=(1400, 6)), rng.integers(0, 4, (1300, 2))
    coded = spark.createDataFrame([(i, [int(x) for x in c]) for i, c in enumerate(codes)], "pid long, codes array<int>")
    scores = np.round(R._looked_up(books, q, codes), 12)
    rows = R.topk_pq(vectors(spark, q, "qid"), coded, codebook, 3).collect()
    want = {(i, int(j), rank) for i in range(1400) for rank, j in enumerate(np.lexsort((np.arange(1300), -scores[i]))[:3], 1)}
    assert {(r["qid"], r["pid"], r["rank"]) for r in rows} == want


def test_vectors_beyond_single_precision(spark):
    big = [(i, [x * 1e200, 1.0]) for i, x in enumerate([1.0, -2.0, 3.0])]
    left = spark.createDataFrame([(0, [1e30, 0.0]), (1, [float("nan"), 1.0])], "qid long, embedding array<double>")
    right = spark.createDataFrame(big, "pid long, embedding array<double>")
    got = [(r["qid"], r["pid"]) for r in R.topk_inner_product(left, right, 2).orderBy("rank").collect()]
    assert got == [(0, 2), (0, 0)]


def test_queue_without_negatives_or_pairs(spark):
    pairs = spark.createDataFrame([(1, [1.0, 0.0], [0.5, 1.0]), (2, [0.0, 2.0], [1.0, 1.0])], "id long, q array<double>, k array<double>")
    none = spark.createDataFrame([], "id long, embedding array<double>")
    row = TS.queue_report(pairs, none, 0.5, 0.1).first()
    assert row["loss"] == pytest.approx(0.0) and row["accuracy"] == 100.0 and row["weight"] == 2
    negatives = pairs.select("id", F.col("k").alias("embedding"))
    row = TS.queue_report(pairs.limit(0), negatives).first()
    assert row["loss"] is None and row["weight"] == 0


def test_negatives_in_groups_add_up(spark):
    rng = np.random.default_rng(8)
    q, n = rng.normal(size=(40, 5)) * 30, rng.normal(size=(200, 5)) * 30
    pairs = vectors(spark, q, "id").select("id", F.col("embedding").alias("q"))
    logits = q @ n.T / 0.7
    top = logits.max(1)
    for rows in (1 << 16, 30):
        got = {r["id"]: r for r in TS.with_negatives(pairs, vectors(spark, n, "id"), 0.7, rows).collect()}
        assert len(got) == 40
        for i in range(40):
            assert got[i]["top"] == pytest.approx(top[i]) and got[i]["n"] == 200
            assert got[i]["total"] == pytest.approx(np.exp(logits[i] - top[i]).sum()) and got[i]["plain"] == pytest.approx(logits[i].sum())


def test_groups_that_travel_together_are_added_in_the_task(spark, monkeypatch):
    """One state a query and set of groups, however many groups there are; sets add up as groups do."""
    rng = np.random.default_rng(9)
    q, n = rng.normal(size=(30, 4)), rng.normal(size=(500, 4))
    pairs = vectors(spark, q, "id").select("id", F.col("embedding").alias("q"))
    few = packed(vectors(spark, n, "id").repartition(16), ["id"], "embedding", 40)
    seen = []

    def visit():
        def each(block, group, few):
            if block is not None:
                yield pd.DataFrame({"group": [group], "n": [sum(len(f["id"]) for f in few)]})

        return each

    for bound, most in ((64, 1 << 20), (64, 4096)):
        monkeypatch.setattr(blocks, "BOUND", most)
        met, sets = every_pair(packed(pairs, ["id"], "q"), few, visit, "group long, n long", bound)
        rows = met.collect()
        seen.append((sets, sum(r["n"] for r in rows) / 500, len({r["group"] for r in rows}) > 20))
        got = TS.with_negatives(pairs, vectors(spark, n, "id"), 0.7, 2)
        total = {r["id"]: r["total"] * np.exp(r["top"]) for r in got.collect()}
        assert len(total) == 30 and all(total[i] == pytest.approx(np.exp(q[i] @ n.T / 0.7).sum()) for i in range(30))
    number = packed(pairs, ["id"], "q").count()
    assert seen == [(1, number, True), (4, number, True)]


def error(book, rows, m):
    parts = rows.reshape(len(rows), m, -1)
    return sum(((parts[:, i, None] - book[i][None]) ** 2).sum(-1).min(1).sum() for i in range(m)) / len(rows)


def test_codebook_is_as_good_as_single_runs(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8)) * 4
    rows = centres[rng.integers(0, 6, 600)] + rng.normal(size=(600, 8))
    df = vectors(spark, rows, "pid")
    book = R._book_array(R.train_codebook(df, 4, 3, iterations=6))
    assert [b.shape for b in book] == [(8, 2)] * 4
    single = []
    for part in rows.reshape(600, 4, 2).transpose(1, 0, 2):  # plain Lloyd from the first rows
        own = part[:8].copy()
        for _ in range(6):
            near = ((part[:, None] - own[None]) ** 2).sum(-1).argmin(1)
            own = np.array([part[near == c].mean(0) if (near == c).any() else own[c] for c in range(8)])
        single.append(own)
    assert error(book, rows, 4) <= 1.25 * error(single, rows, 4)
    few = R._book_array(R.train_codebook(df.filter("pid < 3"), 2, 2, iterations=2))
    assert error(few, np.array([r["embedding"] for r in df.filter("pid < 3").collect()]), 2) == pytest.approx(0.0)


def test_inversions_of_long_lists(spark):
    rng = random.Random(3)
    lists = [[], [0], [1, 0], [2, 2, 1], rng.sample(range(300), 300), [rng.randrange(40) for _ in range(200)]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, ranks array<int>")
    got = {r["i"]: r["n"] for r in df.select("i", A.inversions(F.col("ranks")).alias("n")).collect()}
    assert got == {i: sum(a > b for k, a in enumerate(x) for b in x[k + 1 :]) for i, x in enumerate(lists)}
    long = spark.range(1).select(F.reverse(F.sequence(F.lit(0), F.lit(99_999))).alias("ranks"))
    assert long.select(A.inversions(F.col("ranks")).alias("n")).first()["n"] == 100_000 * 99_999 // 2


def test_bootstrap_centres_on_the_mean(spark):
    steps = A.poisson_steps()
    assert steps == sorted(steps) and steps[0] == math.floor(math.exp(-1) * 2**32) and steps[-1] == 2**32 - 1
    rows = spark.range(400).select("id", (F.col("id") % 10).cast("double").alias("s"), F.lit(None).cast("double").alias("none"))
    got = {r["metric"]: r["mid"] for r in A.bootstrap_mid(rows, "id", ["s", "none"], 200).collect()}
    assert got["s"] == pytest.approx(4.5, abs=0.1) and got["none"] is None
    assert got == {r["metric"]: r["mid"] for r in A.bootstrap_mid(rows.repartition(7), "id", ["s", "none"], 200).collect()}


def test_rows_in_file_order(spark):
    folder = scratch(spark, f"order-{uuid.uuid4().hex}")
    spark.range(0, 5000, 1, 5).select(F.col("id").cast("string").alias("question")).write.json(folder)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        placed = S.in_file_order(spark.read.schema("question string").json(folder))
        assert placed.count() == 5000 and placed.filter(F.col("question").cast("long") + 1 != F.col("__pos")).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def stepwise(contexts, answers, mode):
    """The same consolidation by the single operators."""
    gathered = V.gather_answers(V.parse_answers(answers))
    gate = gathered.select("qid", "outcome", "majority")
    usable = gathered.filter("outcome = 'open'").select("qid", F.inline("answers")).filter("status = 'parsed'")
    spans = V.quote_spans(V.match_quotes(usable, contexts), mode)
    votes = V.vote_counts(spans)
    kept = V.majority_span(votes, gate, contexts)
    grouped = V.context_votes(kept, V.peak_voters(votes, spans)).join(gate.select("qid", "majority"), "qid")
    rendered = V.render_exemplar(kept, V.assign_sections(grouped))
    out = gate.filter("outcome <> 'dropped'").join(rendered, "qid", "left")
    return {r["qid"]: r["exemplar"] or "" for r in out.collect()}


@pytest.mark.parametrize("mode", ["verbatim", "lcs"])
def test_consolidation_in_a_row_equals_its_steps(spark, mode):
    rng = random.Random(6)
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    contexts, answers = [], []
    for q in range(25):
        texts = [" ".join(rng.choices(words, k=rng.randrange(4, 25))) for _ in range(rng.randrange(0, 6))]
        contexts += [(q, i, f"Title {i % 4}" if i else "Title", t) for i, t in enumerate(texts)]
        for t in range(5):
            blocks = []
            for i, text in enumerate(texts):
                if rng.random() < 0.8:
                    source = text.split()
                    quote = " ".join(source[rng.randrange(3) : len(source) - rng.randrange(3)])
                    if rng.random() < 0.3:
                        quote = quote.replace("e", "é", 1)
                    blocks.append(f"{rng.randrange(1, 4)}.{rng.randrange(1, 3)}. ## {f'Title {i % 4}' if i else 'Title'}\n{quote}")
            answers.append((q, f"t{t}", t, rng.choice(["", "prose only", *["\n\n".join(blocks)] * 6])))
    c = spark.createDataFrame(contexts, "qid long, ctx_pos int, title string, text string")
    a = spark.createDataFrame(answers, "qid long, teacher string, teacher_ord int, answer string")
    got = V.consolidate(c, a, mode)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2
    found = {r["qid"]: r["exemplar"] for r in got.collect()}
    assert found == stepwise(c, a, mode) and any(found.values())
    assert V.consolidate(c.limit(0), a, mode).filter("exemplar <> ''").count() == 0
    assert V.consolidate(c, a.limit(0), mode).count() == 0


def test_subsequence_places_with_few_rows_kept(monkeypatch):
    rng = random.Random(12)

    def table(a, b):
        """The whole table, and the way back through it."""
        n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                n[i][j] = n[i - 1][j - 1] + 1 if x == y else max(n[i - 1][j], n[i][j - 1])
        found, i, j = set(), len(a), len(b)
        while i and j:
            if a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
                found.add(i)
            elif n[i][j - 1] > n[i - 1][j]:
                j -= 1
            else:
                i -= 1
        return n[-1][-1], found

    for every in (1, 3, 64):
        monkeypatch.setattr(A, "KEPT_EVERY", every)
        for size in (0, 1, 5, 40, 150):
            a, b = ([rng.choice("abcde") for _ in range(rng.randrange(size + 1))] for _ in range(2))
            n, places = table(a, b)
            assert A.subsequence_length(a, b) == n and A._subsequence_places(a, b) == places
