"""Work and exchanges of queries that grow with the tables."""

from __future__ import annotations

import hashlib
import re
import statistics

import pytest
from pyspark.sql import functions as F

from askwell.functions import fixed
from askwell.functions import text as X
from askwell.operators import answers as A
from askwell.plans import consolidate as C
from askwell.plans import inputs as I

TABLES = "/root/testdata/sf0.001"


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_consolidation_moves_texts_once_a_side(spark):
    """Answers are quoted, parsed and matched where a document's text arrives."""
    steps = C.Steps(spark, TABLES)
    assert exchanges(steps.parsed) == 1 and exchanges(C.v01(spark, TABLES)) == 1
    assert exchanges(steps.matched()) == 2 and exchanges(steps.spans()) == 2
    assert exchanges(C.V.question_spans(steps.parsed, steps.contexts)) == 2


def test_lines_are_counted_once_for_all_teachers(spark):
    """Blanks are looked for in a document's row, before it is repeated for each teacher."""
    plan = I.teacher_answers(spark, TABLES)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate explode", 1)
    assert "replace(" not in above and "replace(" in below


def test_ends_are_looked_at_before_texts_are_searched(spark):
    """Only a text that ends in an end token or a blank is searched for these; results are as by search."""
    texts = ["", " ", "a", "a ", "\u3000a\u00a0b\u2003\n", "a</s>", "a</s></s>", "</s>a", "a</s> ", None, "</s>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", X.strip_space(F.col("t")), X.strip_suffix(F.col("t"), "</s>")).collect()
    for t, bare, cut in got:
        assert bare == (t and t.strip(fixed.WHITE_SPACE)) and cut == (t and re.sub(r"(</s>)+\Z", "", t))
    plan = df.select(X.strip_space(F.col("t")), X.strip_suffix(F.col("t"), "</s>"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("endswith(") > 1


def test_teachers_quote_repeated_and_odd_documents(spark, tmp_path):
    texts = {1: ["a b c d e f", "  g h  i j k l m \n\nn"], 2: [None], 3: ["one two three four"], 4: [""]}
    rows = [(i, t, "s", "en") for i, ts in texts.items() for t in ts]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["qid"], r["teacher_ord"]): r["answer"] for r in I.teacher_answers(spark, str(tmp_path)).collect()}
    assert {q for q, _ in got} == {1, 3, 4}
    for (q, t), answer in got.items():
        lines = []
        for text in texts[q]:
            for n, line in enumerate(text.split("\n")):
                words = line.strip(" ").split(" ")
                quote = " ".join(words[t : t + max(len(words) - 4, 0)])
                lines.append((n, f"{(n + (t >= 3)) // 2 + 1}.1. ## s-{q}-{n}\n{quote}"))
        assert answer in ("", "I found nothing.\n\nSorry.", "\n\n".join(x for _, x in sorted(lines)))
    assert sum("## s" in a for a in got.values()) > 5


def test_bootstrap_draws_equal_single_draws(spark):
    """Drawn a batch at a time; nulls count as absent, endless scores only where they are drawn."""
    data = [(i if i % 7 else None, float(i % 5), None if i % 3 else i / 4, float("inf") if i == 11 else 1.0) for i in range(300)]
    df = spark.createDataFrame(data, "id long, a double, b double, c double")
    steps, means = A.poisson_steps(), {n: [] for n in "abc"}
    for r in range(40):
        sums, counts = dict.fromkeys("abc", 0.0), dict.fromkeys("abc", 0)
        for key, *values in data:
            digest = hashlib.md5("|".join(str(x) for x in ("0", key, r // 4) if x is not None).encode()).hexdigest()
            copies = sum(int(digest[r % 4 * 8 : r % 4 * 8 + 8], 16) >= s for s in steps)
            for name, value in zip("abc", values):
                if value is not None and copies:
                    sums[name] += value * copies
                    counts[name] += copies
        for name in means:
            means[name].append(sums[name] / counts[name])
    got = {r["metric"]: r["mid"] for r in A.bootstrap_mid(df, "id", ["a", "b", "c"], 40).collect()}
    assert got == {n: pytest.approx(statistics.median(m)) for n, m in means.items()}
    plan = A.bootstrap_mid(df, "id", ["a"], 40)._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan and A.bootstrap_mid(df.filter("id < 0"), "id", ["a"], 40).count() == 0
