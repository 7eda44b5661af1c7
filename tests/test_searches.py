"""Searches ask with all rows, against all rows; contexts are titled by one letter."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from askwell import plans
from askwell.plans import inputs as I

SF = "/root/testdata/sf0.001"


WHOLE = ["r01_topk_inner_product", "r01_topk_inner_product_blocks", "r03_hydrate", "r04_nest_results", "r09_search"]
WHOLE += ["e10_inversions", "e11_topk_overlap", "e12_depth_to_recover", "c12_assemble_retrieved"]


def every_id(spark):
    return {r[0] for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect()}


@pytest.mark.parametrize("name", WHOLE)
def test_every_vector_asks(spark, name):
    found = {r["qid"] for r in plans.QUERIES[name](spark, SF).select("qid").collect()}
    # A list without an inversion, or with no text, has no row.
    assert found <= every_id(spark) and len(found) > 100 and (name[:3] in ("e10", "c12") or found == every_id(spark))


def test_every_vector_asks_by_string(spark):
    found = {r["qid"] for r in plans.QUERIES["r01_topk_string_ids"](spark, SF).select("qid").collect()}
    assert found == {f"q-{i}" for i in every_id(spark)}


def test_every_vector_asks_the_codes(spark):
    rows = plans.QUERIES["r02_topk_pq_given_codebook"](spark, SF).select("qid").collect()
    assert {r["qid"] for r in rows} == every_id(spark)
    assert plans.QUERIES["r02_pq_recall"](spark, SF).first()["wanted"] == len(rows) == 10 * len(every_id(spark))


@pytest.mark.parametrize("name", ["r02_topk_pq"])
def test_every_hundredth_vector_asks(spark, name):
    wanted = {i for i in every_id(spark) if i % 100 == 0}
    found = {r["qid"] for r in plans.QUERIES[name](spark, SF).select("qid").collect()}
    assert found == wanted


def test_all_vectors_are_searched(spark):
    found = {r["pid"] for r in plans.QUERIES["r01_topk_inner_product"](spark, SF).select("pid").collect()}
    assert any(p % 100 for p in found)


def test_questions_of_every_conversation(spark):
    found = {r["qid"] for r in plans.QUERIES["r09_search_texts"](spark, SF).select("qid").collect()}
    assert found == {r["id"] for r in I.turns(spark, SF).select("id").collect()} and any(i // 1000 % 100 for i in found)


def test_titles_are_one_letter(spark):
    rows = spark.createDataFrame([("\u00df",), ("\ufb01",), ("a",), ("",), ("\u00e4",), ("7",)], "c string")
    got = [r[0] for r in rows.select(I.capital(F.col("c"))).collect()]
    assert got == ["\u1e9e", "\ufb01", "A", "", "\u00c4", "7"]
