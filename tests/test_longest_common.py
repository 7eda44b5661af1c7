"""The longest common substring against a table of all pairs of places, and how many searches it takes."""

from __future__ import annotations

import random

import pytest

from askwell.operators import consolidate as V


def by_table(text, quote):
    best, before = (0, 0), [0] * (len(quote) + 1)
    for i, c in enumerate(text):
        row = [0] * (len(quote) + 1)
        for j, d in enumerate(quote):
            if c == d:
                row[j + 1] = before[j] + 1
                if row[j + 1] > best[1] or row[j + 1] == best[1] and i + 1 - best[1] < best[0]:
                    best = (i + 1 - row[j + 1], row[j + 1])
        before = row
    return best


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdefgh ", "é😀x "])
@pytest.mark.parametrize("places", [4, 0])
def test_equals_the_table(monkeypatch, letters, places):
    monkeypatch.setattr(V, "PLACES", places)
    draw = random.Random(letters)
    some = lambda n: "".join(draw.choice(letters) for _ in range(draw.randint(0, n)))
    for _ in range(1500):
        text = some(60)
        at = draw.randint(0, len(text))
        quote = draw.choice([some(60), some(5) + text[at : at + draw.randint(0, 40)] + some(5)])
        assert V.longest_common(text, quote) == by_table(text, quote)


class Searched(str):
    """A text that counts how often it is searched."""

    asked = 0

    def find(self, *args):
        Searched.asked += 1
        return super().find(*args)

    def __contains__(self, part):
        Searched.asked += 1
        return super().__contains__(part)


def test_a_nearly_verbatim_quote_takes_few_searches():
    draw = random.Random(1)
    text = " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9))) for _ in range(200))
    quote = text.replace(" ", "", 1)
    Searched.asked = 0
    at = text.index(" ") + 1
    assert V.longest_common(Searched(text), quote) == (at, len(text) - at)
    assert Searched.asked < 20 < len(quote)


def test_a_long_nearly_verbatim_quote_needs_no_automaton(monkeypatch):
    monkeypatch.setattr(V, "_longest_by_automaton", lambda text, quote: pytest.fail("searched by automaton"))
    draw = random.Random(2)
    text = " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9))) for _ in range(1500))
    at = text.index(" ") + 1
    assert len(text) ** 2 > V.SEARCH_CELLS
    assert V.longest_common(text, text.replace(" ", "", 1)) == (at, len(text) - at)


def test_a_span_is_searched_for_once(spark):
    """The filter on empty spans must not evaluate the search a second time."""
    rows = [(1, 0, 0, 0, 1, "ab cd", "xx abcd yy ab"), (1, 1, 0, 0, 1, "zz", "abc"), (1, 2, 0, 0, 1, "bc", "abcd")]
    matched = spark.createDataFrame(rows, "qid int, ctx_pos int, teacher_ord int, quote_ord int, section int, quote string, text string")
    spans = V.quote_spans(matched)
    assert spans._jdf.queryExecution().executedPlan().toString().count("EvalPython [") == 1
    got = {(r["ctx_pos"], r["start"], r["end"] - r["start"]) for r in spans.collect()}
    assert got == {(i, *by_table(text, quote)) for i, (quote, text) in enumerate([r[5:] for r in rows]) if i != 1}
