"""Golden and brute-force cases of the operators."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from askwell.functions.text import uniform
from askwell.operators import answers as A
from askwell.operators import consolidate as V
from askwell.operators import context as C
from askwell.operators import prepare as P
from askwell.operators import ranking as K
from askwell.operators import retrieve as R
from askwell.operators import rows as S
from askwell.operators import traindata as D
from askwell.operators import training_stats as TS
from askwell.operators.ordering import with_position
from askwell.sources import records as IO


def test_positions_with_skewed_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("id"), F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 5).alias("g"))
    got = {(r["g"], r["id"]): r["position"] for r in with_position(df, "id", by=["g"]).collect()}
    rows = sorted((r["g"], r["id"]) for r in df.collect())
    want = {}
    for g, members in itertools.groupby(rows, key=lambda x: x[0]):
        want.update({m: i + 1 for i, m in enumerate(members)})
    assert got == want


def test_shards(spark):
    df = spark.range(10)
    sizes = lambda d: [r["count"] for r in d.groupBy("shard").count().orderBy("shard").collect()]
    assert sizes(S.shard_contiguous(df, 3, "id")) == [3, 3, 4]
    assert sizes(S.shard_even(df, 3, "id")) == [4, 3, 3]
    assert [r["id"] for r in S.slice_rows(df, "id", 2, -5).orderBy("id").collect()] == [2, 3, 4]


def test_restore_order_uses_last_position(spark):
    original = spark.createDataFrame([("a", 0), ("b", 1), ("a", 2)], "q string, pos int")
    done = spark.createDataFrame([("a", "x"), ("b", "y")], "q string, out string")
    assert [r["q"] for r in S.restore_order(done, original, "q", "pos").collect()] == ["b", "a"]


def test_contexts(spark):
    rows = [
        (1, 0, 4, "a", "  fourth text ", 0.9), (1, 1, 3, "a", "third text", 0.9), (1, 2, 6, "b", "sixth text", 0.9),
        (1, 3, 9, "Category:x", "some text", 0.5), (1, 4, 8, "b", "x ; y text", 0.5), (1, 5, 7, "b", "sixth text", 0.2),
        (1, 6, 1, "c", "tiny", 0.1),
    ]
    df = spark.createDataFrame(rows, "qid int, pos int, id long, title string, text string, score double")
    assert C.assemble_context(df, n_contexts=2).first()["context"] == "## a\nthird text fourth text\n---\n## b\nsixth text"
    apart = df.withColumn("id", F.col("id") * 2)
    assert C.assemble_context(apart, n_docs=1).first()["context"] == "## a\nthird text...fourth text"


@pytest.mark.parametrize(("budget", "kept"), [(20, 2), (19, 1), (30, 3)])
def test_budget(spark, budget, kept):
    df = spark.createDataFrame([(1, i, i, "", "x" * 10, 1.0) for i in range(3)], "qid int, pos int, id int, title string, text string, score double")
    assert C.budget_contexts(df, budget).count() == kept


def test_keyword(spark):
    got = spark.range(1).select(C.highlight_keyword(F.lit("see rome, Rome"), "Rome").alias("x")).first()["x"]
    assert got == "see **rome**, Rome"


def test_topk_forms_agree_with_brute_force(spark):
    rng = np.random.default_rng(1)
    q, p = rng.normal(size=(17, 8)).round(2), rng.normal(size=(40, 8)).round(2)
    p[5] = p[6]
    left = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "qid long, embedding array<double>")
    right = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(p)], "pid long, embedding array<double>")
    want = {(i, *pair) for i, row in enumerate((q @ p.T).round(6)) for pair in enumerate(sorted(range(40), key=lambda j: (-row[j], j))[:4], 1)}
    for limit in (1 << 20, 512):
        hits = R.topk_inner_product(left, right, 4, broadcast_bytes=limit)
        assert {(r["qid"], r["rank"], r["pid"]) for r in hits.collect()} == want
    assert R.topk_inner_product(left, right.limit(2), 4).count() == 34


def test_topk_keeps_the_closer_of_near_equals(spark):
    left = spark.createDataFrame([("q", [1.0])], "qid string, embedding array<double>")
    right = spark.createDataFrame([("a", [1.0]), ("b", [1.0 + 1e-9]), ("c", [1.0])], "pid string, embedding array<double>")
    assert [r["pid"] for r in R.topk_inner_product(left, right, 2).orderBy("rank").collect()] == ["b", "a"]


def test_pq_blocks_are_bounded_by_questions_not_width(spark):
    """768 dimensions in 8 parts: a tile holds scores, never decoded vectors."""
    rng = np.random.default_rng(4)
    books = [rng.normal(size=(16, 96)) for _ in range(8)]
    codes = pd.Series(list(rng.integers(0, 16, size=(50, 8))))
    questions = rng.normal(size=(3, 768))
    whole = np.stack([np.concatenate([b[c] for b, c in zip(books, row)]) for row in codes])
    assert np.allclose(R._looked_up(books, questions, codes), questions @ whole.T)
    assert R.rows_at_once(10**6) * 10**6 <= R.TILE and R.rows_at_once(10**9) == 1


def test_hydrate_keeps_unknown_ids(spark):
    hits = spark.createDataFrame([(1, 5, 0.5, 1), (1, 9, 0.4, 2)], "qid long, pid long, score double, rank int")
    passages = spark.createDataFrame([(5, "t", "x")], "id long, title string, text string")
    nested = R.nest_results(R.hydrate(hits, passages)).first()["ctxs"]
    assert [(c["id"], c["title"]) for c in nested] == [("5", "t"), ("9", None)]


def test_budget_counts_every_short_passage(spark):
    rows = [(1, i, i, "", "ab", 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "qid long, pos long, id long, title string, text string, score double")
    assert C.budget_contexts(df, 16).count() == 8


def test_no_negatives_and_literal_end_token(spark):
    row = spark.createDataFrame([("k", "q", [("t", "p")], [("t", "n")], [("t", "h")])],
        "id string, question string, positive_ctxs array<struct<title:string,text:string>>, "
        "negative_ctxs array<struct<title:string,text:string>>, hard_negative_ctxs array<struct<title:string,text:string>>")
    assert D.sample_triples(row, negatives=0, hard_ratio=0.5).first()["negatives"] == []
    text = spark.createDataFrame([("a", "x y eot_id"), ("a", "x y<|eot_id|>")], "p string, t string")
    ids = [len(r["input_ids"]) for r in D.encode_completion(text, "p", "t", 99, eos="<|eot_id|>").collect()]
    assert ids == [5, 4]


def test_highlight_keeps_the_spelling(spark):
    row = spark.createDataFrame([("see rome, Rome", "ROME"), ("a.b (x) axb", "(X)")], "t string, k string")
    got = [r[0] for r in row.select(C.highlight_keyword(F.col("t"), F.col("k"))).collect()]
    assert got == ["see **rome**, Rome", "a.b **(x)** axb"]


def test_pq_recall(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(120, 8))
    p = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "pid long, embedding array<double>")
    q = p.limit(20).withColumnRenamed("pid", "qid")
    book = R.train_codebook(p, m=4, bits=4)
    near = R.topk_pq(q, R.encode_pq(p, book), book, 10).select("qid", "pid")
    exact = R.topk_inner_product(q, p, 10).select("qid", "pid")
    assert near.join(exact, ["qid", "pid"]).count() / exact.count() > 0.6


def test_search_by_text(spark):
    passages = spark.createDataFrame([("1", "Rome", "capital of italy"), ("2", "", "cats and dogs"), ("3", "Oslo", "fjords")], "id string, title string, text string")
    found = R.search_texts(spark, "dogs and cats", passages, 1).first()
    assert [c["id"] for c in found["ctxs"]] == ["2"]


def votes_by_character(spans):
    seen = {}
    for _, _, teacher, start, end, _, _ in spans:
        for i in range(start, end):
            seen.setdefault(i, set()).add(teacher)
    return {i: len(v) for i, v in seen.items()}


def test_votes_match_counting_characters(spark):
    rng = random.Random(5)
    spans = []
    for order in range(25):
        start = rng.randint(0, 40)
        spans.append((1, 0, rng.randint(0, 4), start, start + rng.randint(1, 12), 1, order))
    df = spark.createDataFrame(spans, "qid int, ctx_pos int, teacher_ord int, start int, end int, section int, quote_ord int")
    got = {}
    for r in V.vote_counts(df).collect():
        got.update(dict.fromkeys(range(r["start"], r["end"]), r["votes"]))
    assert got == votes_by_character(spans)


@pytest.mark.parametrize(
    ("statuses", "want"),
    [
        ("empty empty empty parsed parsed", "empty"),
        ("empty empty parsed parsed parsed", "open"),
        ("malformed malformed malformed empty empty", "dropped"),
        ("malformed empty empty malformed malformed", "empty"),
        ("malformed malformed empty empty parsed", "empty"),
        ("parsed parsed malformed parsed parsed", "open"),
    ],
)
def test_gate(spark, statuses, want):
    listed = F.array(*map(F.lit, statuses.split()))
    assert spark.range(1).select(V.gate_fold(listed).alias("g")).first()["g"]["outcome"] == want


def test_consolidate(spark):
    rome = "Rome was founded long ago on seven hills beside the river."
    oslo = "Oslo lies at the end of a long fjord in the south of Norway."
    contexts = spark.createDataFrame([(1, 0, "Rome city", rome), (1, 1, "Oslo", oslo)], "qid int, ctx_pos int, title string, text string")
    quotes = [rome[:40], rome[5:], rome[:20] + rome[30:]]
    said = [f"1.1. ## Rome\n{q}\n\n1.2. ## Oslo\n{oslo[:30]}" for q in quotes] + ["", "prose\n\nonly"]
    answers = spark.createDataFrame([(1, f"t{i}", i, a) for i, a in enumerate(said)], "qid int, teacher string, teacher_ord int, answer string")
    got = V.consolidate(contexts, answers).collect()
    assert [r["qid"] for r in got] == [1]
    lines = got[0]["exemplar"].split("\n")
    assert lines[0] == "1.1. Rome city" and lines[2] == "1.2. Oslo" and lines[3] == oslo[:30].strip()
    assert lines[1] in rome


def test_rank_metrics(spark):
    row = spark.range(1).select(F.array(*map(F.lit, [2, 0, 1, 3])).alias("x"))
    got = row.select(A.inversions("x").alias("i"), A.topk_overlap(F.col("x"), 2).alias("o"), A.depth_to_recover(F.col("x"), 2).alias("d")).first()
    assert tuple(got) == (2, 0.5, 3)


def test_rouge_by_hand():
    assert A.rouge_l_score("the cat sat", "the cat on the mat") == pytest.approx(2 * 2 / (3 + 5))
    assert A.rouge_lsum_score("a b\nc d", "a c\nb d") == pytest.approx(1.0)
    rng = random.Random(1)
    for _ in range(100):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert A.subsequence_length(a, b) == table[-1][-1] == len(A._subsequence_places(a, b))


def test_bootstrap_is_near_the_mean_and_ignores_partitioning(spark):
    df = spark.range(500).select("id", (F.col("id") % 10 / 10).alias("s"))
    one = A.bootstrap_mid(df.repartition(1), "id", ["s"]).first()["mid"]
    many = A.bootstrap_mid(df.repartition(7), "id", ["s"]).first()["mid"]
    assert one == pytest.approx(many, abs=1e-9) and one == pytest.approx(0.45, abs=0.01)


def test_ir_report(spark):
    run = spark.createDataFrame([("q", d, s) for d, s in (("a", 3.0), ("b", 2.0), ("c", 1.0))], "query_id string, doc_id string, score double")
    qrels = spark.createDataFrame([("q", "b", 2), ("q", "c", 0), ("q", "z", 1), ("other", "x", 1)], "query_id string, doc_id string, rel int")
    got = {(r["metric"], r["k"]): r["value"] for r in K.ir_report(run, qrels, (1, 3)).collect()}
    assert got[("mrr", 3)] == pytest.approx(100 * 0.5 / 2)
    assert got[("hole", 1)] == pytest.approx(100 * 1.0 / 2)
    assert got[("recall", 3)] == pytest.approx(50.0) and got[("map", 3)] == pytest.approx(25.0)
    assert got[("ndcg", 3)] == pytest.approx(100 * (2 / math.log2(3)) / (2 + 1 / math.log2(3)))


def test_queue_report_blocks_agree(spark):
    rng = np.random.default_rng(3)
    q, k, n = (rng.normal(size=(s, 4)) for s in (6, 6, 9))
    pairs = spark.createDataFrame([(i, [float(x) for x in a], [float(x) for x in b]) for i, (a, b) in enumerate(zip(q, k))], "id long, q array<double>, k array<double>")
    negatives = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(n)], "id long, embedding array<double>")
    logits = np.concatenate([(q * k).sum(1, keepdims=True), q @ n.T], axis=1) / 0.5
    want = float((np.log(np.exp(logits).sum(1)) - logits[:, 0]).mean())
    for rows in (100, 4):
        assert TS.queue_report(pairs, negatives, 0.5, block_rows=rows).first()["loss"] == pytest.approx(want)


def test_label_masks(spark):
    df = spark.createDataFrame([("a b c d", "x y </s>")], "p string, t string")
    row = D.encode_completion(df, "p", "t", 50).first()
    assert row["labels"][:3] == [-100] * 3 and row["labels"][3:] == row["input_ids"][3:] and len(row["input_ids"]) == 7
    marked = spark.createDataFrame([([9, 1, 5, 2, 6, 2, 7], 1), ([9, 1, 5, 2, 1, 6, 7], 0), ([9, 1, 5, 6], 0)], "labels array<int>, prompt_len int")
    got = [r["labels"] for r in D.mask_between(marked, 1, 2).collect()]
    assert got == [[9, 1, -100, -100, -100, 2, 7], [9, 1, -100, 2, 1, -100, 7], [9, 1, -100, 6]]


def test_chunks(spark):
    assert spark.range(1).select(D.chunk_tokens(F.sequence(F.lit(0), F.lit(9)), 4, 3).alias("x")).first()["x"] == [[3, 4, 5, 6]]
    rows = spark.createDataFrame([(0, [0, 1, 2]), (1, [3]), (2, []), (3, [4, 5, 6, 7, 8])], "id long, tokens array<int>")
    got = {r["chunk"]: r["tokens"] for r in D.chunk_stream(rows, "id", 3, offset=1).collect()}
    assert got == {0: [1, 2, 3], 1: [4, 5, 6]}


def test_augment_shuffle_keeps_the_bag(spark):
    tokens = F.sequence(F.lit(1), F.lit(200))
    got = spark.range(1).select(D.augment_shuffle(tokens, F.col("id"), 0.3).alias("x")).first()["x"]
    assert sorted(got) == list(range(1, 201)) and 20 < sum(a != i + 1 for i, a in enumerate(got)) < 100


def test_supporting(spark):
    paragraphs = [(f"p{i}", i in (2, 5)) for i in range(12)]
    df = spark.createDataFrame([(paragraphs,), (paragraphs[:9],)], "p array<struct<text:string,is_supporting:boolean>>")
    got = [r["x"] for r in df.select(P.select_supporting(F.col("p")).alias("x")).collect()]
    assert [p["text"] for p in got[0]] == ["p2", "p5", "p0", "p1", "p3", "p4", "p6", "p7", "p8", "p9"] and got[1] is None
    strict = df.select(P.select_supporting(F.col("p"), strict_compat=True).alias("x")).first()["x"]
    assert [p["text"] for p in strict] == ["p2", "p5"] + ["p11"] * 8


def test_uniform_is_repeatable(spark):
    values = [r["u"] for r in spark.range(2000).select(uniform(1, F.col("id")).alias("u")).collect()]
    assert 0 <= min(values) and max(values) < 1 and abs(np.mean(values) - 0.5) < 0.02


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"question": "q1"}, {"question": "q2"}]')
    (tmp_path / "b.jsonl").write_text('{"question": "q3"}\n{"question": "q4"}\n')
    assert IO.read_records(spark, str(tmp_path / "a.json")).count() == 2
    some = IO.read_contrastive(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.jsonl")], maxload=3)
    assert sorted(r["question"] for r in some.collect()) == ["q1", "q2", "q3"]
    (tmp_path / "p.tsv").write_text('id\ttext\ttitle\n1\t"say ""hi""\tthere"\tT\n')
    assert tuple(IO.read_passages(spark, str(tmp_path / "p.tsv")).first()) == ("1", "T", 'say "hi"\tthere')
    path = IO.write_scored(spark.range(3), spark.range(1).select(F.lit(0.12345).alias("acc"), F.lit(2.0).alias("f")), str(tmp_path), "out")
    assert path.endswith("/out_acc=0.123&f=2.000")
    shards = str(tmp_path / "shards")
    spark.range(4).select(F.array(F.col("id").cast("int")).alias("tokens")).repartition(4).write.parquet(shards)
    assert IO.read_token_shards(spark, shards).count() == 4
    assert sum(IO.read_token_shards(spark, shards, "split", i, 3).count() for i in range(3)) == 4
    R.save_vectors(spark.range(3).select("id", F.array(F.lit(1.0)).alias("embedding")), str(tmp_path / "v"))
    assert R.load_vectors(spark, str(tmp_path / "v")).count() == 3


def test_contrastive_takes_the_first_rows_by_file(spark, tmp_path):
    for i, n in enumerate((3, 400, 5)):
        rows = [f'{{"question": "{i}-{j:04d}{"x" * (200 if i == 1 else 1)}"}}' for j in range(n)]
        (tmp_path / f"part-{i}.jsonl").write_text("\n".join(rows) + "\n")
    got = [r["question"].split("x")[0] for r in IO.read_contrastive(spark, [str(tmp_path)], maxload=203).collect()]
    assert sorted(got) == [f"0-{j:04d}" for j in range(3)] + [f"1-{j:04d}" for j in range(200)]
