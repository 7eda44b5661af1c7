"""Answer matching expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import answer_letter, bind, nfd, normalize_answer, plain_tokens, qa_tokens

# Control characters never occur inside a token.
SEPARATOR = "\u0001"
BREAK = "\u0002"


def listed_hit(answers: Column, text: Column) -> Column:
    """Any lower-cased answer inside the normalised text."""
    return bind(normalize_answer(text), lambda plain: F.exists(answers, lambda a: plain.contains(F.lower(a))))


def letter_hit(answer_key: Column, text: Column) -> Column:
    """Every character of the key equals the letter the text announces."""

    def agrees(letter: Column) -> Column:
        same = F.forall(
            F.split(answer_key, ""), lambda c: (c == "") | ((letter != "") & (F.lower(c) == F.lower(letter)))
        )
        return F.when(F.length(answer_key) == 0, letter == "").otherwise(same)

    return bind(answer_letter(text), agrees)


def single_hit(answer: Column, text: Column) -> Column:
    """The normalised answer inside the normalised text."""
    return normalize_answer(text).contains(normalize_answer(answer))


def answer_hit(df: DataFrame, text: Column) -> Column:
    """Hit of the first truth a row has: ``answers``, ``answerKey``, ``answer``; null without any."""
    forms = {"answers": listed_hit, "answerKey": letter_hit, "answer": single_hit}
    out = F.lit(None).cast("boolean")
    for name in reversed(list(forms)):
        if name in df.columns:
            out = F.when(F.col(name).isNotNull(), forms[name](F.col(name), text)).otherwise(out)
    return out


def contains_any(prediction: Column, truths: Column) -> Column:
    """1 if any truth occurs in the prediction, case-insensitively."""
    return bind(F.lower(prediction), lambda low: F.exists(truths, lambda t: low.contains(F.lower(t))).cast("int"))


def exact_match(prediction: Column, truths: Column) -> Column:
    """1 if the normalised prediction equals any normalised truth."""
    return bind(
        normalize_answer(prediction),
        lambda plain: F.exists(truths, lambda t: plain == normalize_answer(t)).cast("int"),
    )


def best_over_truths(truths: Column, score: Callable[[Column], Column]) -> Column:
    """Largest score over the truths."""
    return F.array_max(F.transform(truths, score))


def token_run(tokens: Column) -> Column:
    """Tokens as one string in which a contiguous run is a substring."""
    return F.concat(F.lit(SEPARATOR), F.array_join(tokens, SEPARATOR), F.lit(SEPARATOR))


def answer_runs(answers: Column) -> Column:
    """Searchable form of each answer; the empty answer is found everywhere."""
    joined = F.array_join(F.transform(answers, lambda a: F.translate(a, BREAK, " ")), BREAK)
    runs = F.transform(
        F.split(nfd(joined), BREAK),
        lambda a: bind(plain_tokens(a), lambda t: F.when(F.size(t) == 0, F.lit("")).otherwise(token_run(t))),
    )
    return F.when(F.size(answers) > 0, runs).otherwise(F.slice(runs, 1, 0))


def passage_has_answer(runs: Column, text: Column) -> Column:
    """Any answer run is a contiguous token run of the passage; false without text."""
    both = F.struct(runs.alias("runs"), token_run(qa_tokens(text)).alias("passage"))
    hit = bind(both, lambda b: F.exists(b["runs"], lambda r: F.contains(b["passage"], r)))
    return F.coalesce(hit, F.lit(False))
