"""Scalar text functions, all evaluated inside the JVM except NFD."""

from __future__ import annotations

import math
import re
import string
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed

SPACE_RUN = "[" + fixed.WHITE_SPACE + "]+"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where lambdas use it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def normalize_text(text: Column) -> Column:
    """Plain quotes, hyphens, slashes and spaces; control characters dropped."""
    plain = [
        (fixed.BLANK_CHARS, " "),
        (fixed.HYPHEN_CHARS, "-"),
        (fixed.DOUBLE_QUOTE_CHARS, '"'),
        (fixed.SINGLE_QUOTE_CHARS, "'"),
        (fixed.SLASH_CHARS, "/"),
    ]
    source = "".join(chars for chars, _ in plain)
    target = "".join(char * len(chars) for chars, char in plain)
    out = F.translate(text, source + fixed.CONTROL_CHARS + fixed.SOFT_HYPHEN, target)
    for symbol, expansion in fixed.EXPANSIONS:
        out = F.replace(out, F.lit(symbol), F.lit(expansion))
    return out


def normalize_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single blanks."""
    bare = F.translate(F.lower(text), string.punctuation, "")
    # The cheap look at a first letter comes before the dear one at the word's boundary.
    first = "".join(sorted({a[0] for a in fixed.ARTICLES}))
    words = F.regexp_replace(bare, rf"(?U)(?=[{first}])\b(" + "|".join(fixed.ARTICLES) + r")\b", " ")
    return F.trim(F.regexp_replace(words, SPACE_RUN, " "))


def answer_words(text: Column) -> Column:
    """Words of a normalised answer; none for an empty one."""
    return F.filter(F.split(normalize_answer(text), " "), lambda w: w != "")


def fix_spacing(text: Column) -> Column:
    """A blank after ``.!?`` when it sits between word characters."""
    return F.regexp_replace(text, r"(?<=[\p{L}\p{N}_])([.!?])(?=[\p{L}\p{N}_])", "$1 ")


def strip_control_tokens(text: Column) -> Column:
    """Remove control tokens, then one leading blank."""
    tokens = "|".join(re.escape(t) for t in fixed.CONTROL_TOKENS)
    bare = F.regexp_replace(F.regexp_replace(text, tokens, ""), fixed.END_TOKEN, "")
    return F.regexp_replace(bare, r"\A ", "")


@F.pandas_udf(T.StringType())
def _nfd(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFD")


def nfd(text: Column) -> Column:
    """Canonical decomposition; pure ASCII text never leaves the JVM as data."""
    return F.coalesce(_nfd(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def qa_tokens(text: Column, uncased: bool = True) -> Column:
    """Letter/digit/mark runs or single visible characters, after NFD."""
    return plain_tokens(nfd(text), uncased)


def plain_tokens(text: Column, uncased: bool = True) -> Column:
    """Tokens of text that is decomposed already."""
    return F.regexp_extract_all(F.lower(text) if uncased else text, F.lit(fixed.TOKEN_PATTERN), F.lit(0))


def entity_tags(sentence: Column) -> Column:
    """``name <TAG>`` pairs as a map; a repeated name keeps its last tag."""
    names = F.regexp_extract_all(sentence, F.lit(r"(?d)(.+?)(?=(?U:\s)<|$)"), F.lit(1))
    names = F.transform(
        names,
        lambda n: F.when(n.contains("<"), F.get(F.split(n, "> "), F.lit(1))).otherwise(n),
    )
    tags = F.regexp_extract_all(sentence, F.lit(r"(?d)<(.+?)>"), F.lit(1))
    pairs = F.filter(
        F.arrays_zip(names.alias("name"), tags.alias("tag")),
        lambda p: p["name"].isNotNull() & p["tag"].isNotNull(),
    )

    def last_wins(pairs: Column) -> Column:
        kept = F.filter(
            pairs,
            lambda p, i: ~F.exists(
                F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["name"] == p["name"]
            ),
        )
        return F.map_from_entries(kept)

    return bind(pairs, last_wins)


def closed_answer(output: Column, task: str, choices: Column | None = None) -> Column:
    """Map free text onto the closed answer set of a task."""
    final = F.lit(None).cast("string")
    if choices is not None:
        final = bind(
            F.filter(F.split(choices, " "), lambda c: output.contains(c)), lambda found: F.get(found, F.size(found) - 1)
        )
    if task == "fever":
        low = F.lower(output)
        final = (
            F.when(low.isin("true", "false"), low)
            .when(output == "SUPPORTS", F.lit("true"))
            .when(output == "REFUTES", F.lit("REFUTES"))
            .otherwise(final)
        )
    return F.coalesce(final, output)


def answer_letter(text: Column) -> Column:
    """First letter A-E announced by ``is``; empty when there is none."""
    return F.regexp_extract(text, fixed.LETTER_PATTERN, 1)


def strip_suffix(text: Column, token: str, strict_compat: bool = False) -> Column:
    """Drop trailing end tokens; the strict form drops any of their characters."""
    if strict_compat:
        return F.rtrim(text, F.lit(token))
    # A text is searched only if it ends so.
    return bind(text, lambda t: F.when(t.endswith(token), F.regexp_replace(t, "(" + re.escape(token) + r")+\z", "")).otherwise(t))


def strip_space(text: Column) -> Column:
    """Trim Unicode white space on both sides."""
    blanks = F.lit(fixed.WHITE_SPACE)

    def trimmed(t: Column) -> Column:
        # From the right, Spark looks up the places of all characters first.
        ends = reduce(Column.__or__, [t.endswith(c) for c in fixed.WHITE_SPACE])
        return F.ltrim(F.when(ends, F.rtrim(t, blanks)).otherwise(t), blanks)

    return bind(text, trimmed)


def unquote(text: Column) -> Column:
    """Trim blanks and quotes when the whole text stands in quotes."""
    quoted = strip_space(text).rlike(r"""(?d)\A["'].*["']\n?\z""")
    return F.when(quoted, F.trim(text, F.lit(" \"'\n"))).otherwise(text)


def section_rows(answer: Column, end_token: str = fixed.END_TOKEN, strict_compat: bool = False) -> Column:
    """Every ``(section, title, quote)`` of a sectioned answer, in text order.

    The last blank-line block is dropped unless it opens with a section.
    """
    body = strip_space(strip_suffix(strip_trailing_block(answer), end_token, strict_compat))
    pattern, opening = "(?dU)" + fixed.SECTION_PATTERN, r"(?dU)\A" + fixed.SECTION_OPENING

    def row(m: Column) -> Column:
        def parts(head: Column) -> Column:
            return F.struct(
                F.regexp_extract(head, opening, 1).alias("section"),
                F.regexp_extract(head, opening, 4).alias("title"),
                F.substring(m, F.length(head) + 1, F.length(m)).alias("quote"),
            )

        return bind(F.regexp_extract(m, opening, 0), parts)

    # One scan of the answer; the groups are then read off the short openings of the matches.
    return F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)), row)


def strip_trailing_block(answer: Column) -> Column:
    """Drop the last blank-line block unless it opens with a section."""
    last = F.element_at(F.split(answer, "\n\n"), -1)
    opens = last.rlike(r"(?dU)\A" + fixed.SECTION_PATTERN)
    rest = F.greatest(F.length(answer) - F.length(last) - 2, F.lit(0))
    return F.when(opens, answer).otherwise(F.substring(answer, F.lit(1), rest))


def parse_status(answer: Column, rows: Column) -> Column:
    """``parsed``, ``empty`` or ``malformed`` for one sectioned answer."""
    return (
        F.when(F.size(rows) > 0, "parsed")
        .when(strip_trailing_block(answer) == "", "empty")
        .otherwise("malformed")
    )


def seeded(seed: int | str, *parts: Column) -> Column:
    """A seed with leading parts, to be bound once where only the last part changes."""
    return F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts], F.lit(""))


def _digest(seed: int | str | Column, *parts: Column) -> Column:
    if isinstance(seed, Column):
        return F.md5(F.concat(seed, *[p.cast("string") for p in parts]))
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def uniform(seed: int | str, *parts: Column) -> Column:
    """Repeatable number in [0, 1): 52 bits of md5 over the seed and parts."""
    return F.conv(uniform_key(seed, *parts), 16, 10).cast("long") / F.lit(2.0**52)


def uniform_key(seed: int | str | Column, *parts: Column) -> Column:
    """Text that sorts as ``uniform`` does."""
    return F.substring(_digest(seed, *parts), 1, 13)


def _under(bound: int, seed: int | str | Column, *parts: Column) -> Column:
    if bound >= 1 << 52:
        return F.lit(True)
    return _digest(seed, *parts) < F.lit(f"{max(bound, 0):013x}")


def uniform_below(p: float, seed: int | str | Column, *parts: Column) -> Column:
    """``uniform(seed, *parts) < p``, told by the digest's text."""
    return _under(math.ceil(p * 2.0**52), seed, *parts)


def uniform_above(p: float, seed: int | str | Column, *parts: Column) -> Column:
    """``uniform(seed, *parts) > p``, told by the digest's text."""
    return ~_under(math.floor(p * 2.0**52) + 1, seed, *parts)
