"""Golden cases of the text functions, worked out by hand."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from askwell.functions import match as M
from askwell.functions import text as X
from askwell.functions.choices import format_choices
from askwell.functions.sections import clean_sections


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_normalize_text(spark):
    assert one(spark, X.normalize_text(F.lit("a\u0007b\u000bc — “d” ‘e’ 5″ 7⁗ … x . . . y 1⁄2 ~˜"))) == (
        "ab c - \"d\" 'e' 5'' 7'''' ... x ... y 1/2 ~˜"
    )


def test_normalize_answer(spark):
    assert one(spark, X.normalize_answer(F.lit(" The U.S.A., an  émigré's theme; a "))) == "usa émigrés theme"


def test_fix_spacing(spark):
    assert one(spark, X.fix_spacing(F.lit("a.b!c d. e é.à"))) == "a. b! c d. e é. à"


def test_control_tokens(spark):
    assert one(spark, X.strip_control_tokens(F.lit("[Relevant] yes[Utility:5]</s>"))) == "yes"
    assert one(spark, X.strip_control_tokens(F.lit("[No Retrieval]"))) == ""


def test_suffix(spark):
    assert one(spark, X.strip_suffix(F.lit("answers</s>"), "</s>")) == "answers"
    assert one(spark, X.strip_suffix(F.lit("answers</s>"), "</s>", strict_compat=True)) == "answer"


def test_entity_tags(spark):
    assert one(spark, X.entity_tags(F.lit("Paris <LOC> Bob <PER> Paris <CITY>"))) == {"Bob": "PER", "Paris": "CITY"}


def test_tokens_agree_for_composed_and_decomposed_text(spark):
    composed, apart = "Café No.5", unicodedata.normalize("NFD", "Café No.5")
    assert one(spark, X.qa_tokens(F.lit(composed))) == one(spark, X.qa_tokens(F.lit(apart)))
    assert len(one(spark, X.qa_tokens(F.lit(composed)))) == 4


def test_sections(spark):
    answer = "1.1. ## T: x\nfoo\n\n* T\nq\n\nthat is all"
    rows = one(spark, X.section_rows(F.lit(answer)))
    assert [(r["section"], r["title"], r["quote"]) for r in rows] == [("1.1.", "T", "x"), ("*", "T", "q")]
    for text, status in ((answer, "parsed"), ("", "empty"), ("only prose", "empty"), ("more\n\nprose", "malformed")):
        assert one(spark, X.parse_status(F.lit(text), X.section_rows(F.lit(text)))) == status


def test_three_line_breaks_split_from_the_left(spark):
    assert one(spark, X.strip_trailing_block(F.lit("a\n\n\n1.1. T\nq"))) == "a"


def test_clean_sections(spark):
    answer = "\n\n".join(
        ["1.1. ## One\nsame quote", "1.10. ## Ten\nlong enough text", "2.1. ## Two\nsame quote", "2.2. ## Dup\naaa",
         "3.1. ## AAA\nbefore long enough text after", "* ## Star\nlast words here"]
    )
    df = spark.createDataFrame([(answer,), ("prose",)], "a string")
    got = [r["c"] for r in clean_sections(df, "a", "c").collect()]
    assert got == [
        "1.1. One\nsame quote\n2.1. (No Title)\nbefore long enough text after\n3.1. Star\nlast words here",
        "",
    ]
    starred = clean_sections(df, "a", "c", section_type="star", title_type=None, content_type="quote").first()["c"]
    assert starred.split("\n")[0] == '* "same quote"'


def test_choices(spark):
    choices = F.struct(
        F.array(*map(F.lit, ["2", "A", "F", "B"])).alias("label"), F.array(*map(F.lit, "wxyz")).alias("text")
    )
    assert one(spark, format_choices(choices, F.lit("Q?"), "Pick.")) == "Pick.\nQ?\nB: z\nA: x"


@pytest.mark.parametrize(
    ("row", "text", "want"),
    [
        ({"answers": ["U.S."]}, "in the U.S. now", False),
        ({"answers": ["Paris"]}, "it is PARIS!", True),
        ({"answerKey": "B"}, "the answer is (B).", True),
        ({"answerKey": "B"}, "no letter", False),
        ({"answerKey": ""}, "no letter", True),
        ({"answer": "The U.S."}, "of us", True),
        ({"other": "x"}, "x", None),
    ],
)
def test_answer_hit(spark, row, text, want):
    df = spark.createDataFrame([row])
    assert df.select(M.answer_hit(df, F.lit(text)).alias("x")).first()["x"] is want


def test_passage_has_answer(spark):
    df = spark.createDataFrame(
        [(["New York"], "in new york city"), ([""], "x"), (["ork"], "york"), (["a"], None), ([], "a")], "a array<string>, t string"
    )
    got = [r["x"] for r in df.select(M.passage_has_answer(M.answer_runs(F.col("a")), F.col("t")).alias("x")).collect()]
    assert got == [True, True, False, False, False]


def test_longest_common_forms_agree():
    from askwell.operators.consolidate import _longest_by_automaton, longest_common

    rng = random.Random(3)
    for _ in range(300):
        text, quote = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(2))
        best, start = 0, 0
        for i in range(len(text)):
            for j in range(i + 1, len(text) + 1):
                if text[i:j] in quote and j - i > best:
                    best, start = j - i, i
        assert longest_common(text, quote) == (start, best)
        assert _longest_by_automaton(text, quote)[1] == best
        assert not best or _longest_by_automaton(text, quote)[0] == start
