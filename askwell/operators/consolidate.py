"""Agreement of several teachers' quotes by character votes.

Teachers' quotes become intervals over a context's characters. Votes are
counted by sweeping interval ends, so the work grows with the quotes and not
with the characters they cover.

Tables: contexts ``qid, ctx_pos, title, text``; answers ``qid, teacher,
teacher_ord, answer``; spans ``qid, ctx_pos, teacher_ord, start, end, section,
quote_ord`` (0-based, end exclusive).
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import bind, parse_status, section_rows, strip_space
from .context import explode_contexts

MIN_TEXT = 3
MIN_QUOTE = 15
SEARCH_CELLS = 4_000_000
#: Characters compared at once.
STRIDE = 64
#: Places of pieces that are looked at, per character of text and quote, before a text counts as periodic.
PLACES = 4
#: Characters that are searched in the time of one place.
SEARCHED = 256
CONTEXT_KEY = ["qid", "ctx_pos"]


def parse_answers(answers: DataFrame, strict_compat: bool = False) -> DataFrame:
    """Adds ``rows`` (section, title, quote) and ``status`` to each teacher's answer."""
    parsed = answers.withColumn("rows", section_rows(F.col("answer"), strict_compat=strict_compat))
    return parsed.withColumn("status", parse_status(F.col("answer"), F.col("rows")))


def gate_fold(statuses: Column) -> Column:
    """``(outcome, majority)`` of one question's statuses in teacher order.

    Empty answers that reach the current majority end as ``empty``. Each
    malformed one lowers the number of teachers and with it the majority; two
    or fewer teachers left end as ``dropped``. Otherwise ``open``.
    """
    start = F.struct(
        F.size(statuses).alias("n"),
        F.floor((F.size(statuses) + 1) / 2).cast("int").alias("majority"),
        F.lit(0).alias("empties"),
        F.lit("open").alias("outcome"),
    )

    def step(s: Column, status: Column) -> Column:
        left = s["n"] - (status == "malformed").cast("int")
        majority = F.floor((left + 1) / 2).cast("int")
        empties = s["empties"] + (status == "empty").cast("int")
        outcome = (
            F.when(s["outcome"] != "open", s["outcome"])
            .when((status == "empty") & (empties >= majority), "empty")
            .when((status == "malformed") & (left <= 2), "dropped")
            .otherwise("open")
        )
        return F.struct(left.alias("n"), majority.alias("majority"), empties.alias("empties"), outcome.alias("outcome"))

    return F.aggregate(statuses, start, step, lambda s: F.struct(s["outcome"].alias("outcome"), s["majority"].alias("majority")))


def gather_answers(parsed: DataFrame) -> DataFrame:
    """``qid, outcome, majority, answers`` per question; one entry per teacher."""
    entries = F.array_sort(F.collect_list(F.struct("teacher_ord", "status", "rows")))
    grouped = parsed.groupBy("qid").agg(entries.alias("answers"))
    gate = gate_fold(F.transform("answers", lambda a: a["status"]))
    return grouped.withColumn("gate", gate).select("qid", "gate.outcome", "gate.majority", "answers")


def teacher_gate(parsed: DataFrame) -> DataFrame:
    """``qid, outcome, majority`` per question."""
    ordered = F.array_sort(F.collect_list(F.struct("teacher_ord", "status")))
    gate = parsed.groupBy("qid").agg(gate_fold(F.transform(ordered, lambda s: s["status"])).alias("gate"))
    return gate.select("qid", "gate.outcome", "gate.majority")


def match_quotes(parsed: DataFrame, contexts: DataFrame) -> DataFrame:
    """Quotes next to the contexts of their question whose title contains the quote's title.

    Both sides meet by question, one row each, and are matched within it; quotes
    leave that row only beside their context. ``*`` sections carry no number and
    take no part.
    """
    entries = F.collect_list(F.struct("teacher_ord", F.lit("parsed").alias("status"), "rows"))
    quotes = parsed.filter(F.size("rows") > 0).groupBy("qid").agg(entries.alias("answers")).select("qid", _matches(F.col("answers")).alias("quotes"))
    rows = quotes.join(_context_lists(contexts), "qid")
    found = rows.select("qid", F.inline(_spans_in(F.col("ctxs"), F.col("quotes"), "lcs")))
    return (
        found.select(*CONTEXT_KEY, "text", F.explode("spans").alias("s"))
        .select(*CONTEXT_KEY, "s.teacher_ord", "s.quote_ord", "s.section", "s.quote", "text")
    )


def question_spans(parsed: DataFrame, contexts: DataFrame) -> DataFrame:
    """``qid, outcome, majority, spans`` per question: its gate and, as an array, the spans of its verbatim quotes.

    The texts are needed here for the last time but one; what follows (votes,
    voters, sections) reads the spans.
    """
    quotes = gather_answers(parsed).select("qid", "outcome", "majority", _matches(F.col("answers")).alias("quotes"))
    rows = quotes.join(_context_lists(contexts), "qid", "left")

    def of_context(c: Column) -> Column:
        return F.transform(
            c["spans"],
            lambda s: F.struct(
                c["ctx_pos"].alias("ctx_pos"), s["teacher_ord"].alias("teacher_ord"), s["start"].alias("start"),
                (s["start"] + s["length"]).alias("end"), s["section"].alias("section"), s["quote_ord"].alias("quote_ord"),
            ),
        )

    spans = F.flatten(F.transform(_spans_in(F.col("ctxs"), F.col("quotes"), "verbatim"), of_context))
    return rows.select("qid", "outcome", "majority", spans.alias("spans"))


def longest_common(text: str, quote: str) -> tuple[int, int]:
    """Start and length of the longest common substring, earliest in ``text``.

    The quote is cut into pieces, first halves; every place of a piece in the
    text is extended both ways. A common substring of twice a piece's length
    holds a whole piece, so one as long as that ends the search; otherwise the
    pieces become shorter. Where that takes too many places (periodic texts) or
    searches (long ones), another form finds the same.
    """
    if quote in text:
        return text.find(quote), len(quote)
    best = start = 0
    long = len(text) * len(quote) > SEARCH_CELLS
    left = PLACES * (len(text) + len(quote)) // (16 if long else 1)
    piece = len(quote) // 2
    while piece > 1:
        for i in range(0, len(quote) - piece + 1, piece):
            part = quote[i : i + piece]
            at = text.find(part)
            while at >= 0:
                back = _same_before(text, at, quote, i)
                found = back + piece + _same_after(text, at + piece, quote, i + piece)
                if found > best or found == best and at - back < start:
                    best, start = found, at - back
                at = text.find(part, at + 1)
                left -= 1
            left -= len(text) // SEARCHED
            if left < 0:
                return _longest_by_automaton(text, quote) if long else _longest_by_growth(text, quote)
        if best >= 2 * piece - 1:
            return start, best
        piece = (best + 1) // 2 if best >= piece > 3 else piece // 2 if piece > 3 else piece - 1
    for length in (2, 1):
        parts = {quote[i : i + length] for i in range(len(quote) - length + 1)}
        for at in range(len(text) - length + 1):
            if text[at : at + length] in parts:
                return at, length
    return 0, 0


def _longest_by_growth(text: str, quote: str) -> tuple[int, int]:
    """The same by a search for one more character than the best so far, from every place of the quote."""
    best = 0
    for i in range(len(quote)):
        while i + best < len(quote) and quote[i : i + best + 1] in text:
            best += 1
    if not best:
        return 0, 0
    places = (text.find(quote[i : i + best]) for i in range(len(quote) - best + 1))
    return min(p for p in places if p >= 0), best


def _same_after(a: str, i: int, b: str, j: int) -> int:
    """How many characters from ``i`` of ``a`` and from ``j`` of ``b`` are equal."""
    n, end = 0, min(len(a) - i, len(b) - j)
    while n + STRIDE <= end and a[i + n : i + n + STRIDE] == b[j + n : j + n + STRIDE]:
        n += STRIDE
    while n < end and a[i + n] == b[j + n]:
        n += 1
    return n


def _same_before(a: str, i: int, b: str, j: int) -> int:
    """How many characters before ``i`` of ``a`` and before ``j`` of ``b`` are equal."""
    n, end = 0, min(i, j)
    while n + STRIDE <= end and a[i - n - STRIDE : i - n] == b[j - n - STRIDE : j - n]:
        n += STRIDE
    while n < end and a[i - n - 1] == b[j - n - 1]:
        n += 1
    return n


def _longest_by_automaton(text: str, quote: str) -> tuple[int, int]:
    """The same for long texts: suffix automaton of the quote, linear in both."""
    nexts: list[dict[str, int]] = [{}]
    link, size, last = [-1], [0], 0
    for char in quote:
        new = len(nexts)
        nexts.append({})
        link.append(0)
        size.append(size[last] + 1)
        at = last
        while at != -1 and char not in nexts[at]:
            nexts[at][char] = new
            at = link[at]
        if at != -1:
            target = nexts[at][char]
            if size[target] == size[at] + 1:
                link[new] = target
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[target]))
                link.append(link[target])
                size.append(size[at] + 1)
                while at != -1 and nexts[at].get(char) == target:
                    nexts[at][char] = copy
                    at = link[at]
                link[target] = link[new] = copy
        last = new
    best = best_end = at = run = 0
    for i, char in enumerate(text):
        while at and char not in nexts[at]:
            at = link[at]
            run = size[at]
        if char in nexts[at]:
            at = nexts[at][char]
            run += 1
        if run > best:
            best, best_end = run, i + 1
    return best_end - best, best


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())])


@F.pandas_udf(SPAN)
def _common_span(text: pd.Series, quote: pd.Series) -> pd.DataFrame:
    spans: Iterable[tuple[int | None, int | None]] = (
        (None, None) if t is None or q is None else longest_common(t, q) for t, q in zip(text, quote)
    )
    return pd.DataFrame(list(spans), columns=["start", "length"]).astype("Int32")


# Otherwise a filter on the span is moved below it, and every span is searched for twice.
_common_span = _common_span.asNondeterministic()


def quote_spans(matched: DataFrame, mode: str = "lcs") -> DataFrame:
    """Span of each quote in its context's text.

    A verbatim quote is located in the JVM; only the others reach the longest
    common substring function, and with ``verbatim`` they are dropped.
    """
    found = matched.withColumn("__at", F.expr("instr(text, quote)"))
    if mode == "verbatim":
        spans = found.filter((F.col("__at") > 0) & F.col("quote").rlike(r"(?U)\w")).withColumn(
            "__span", F.struct((F.col("__at") - 1).alias("start"), F.length("quote").alias("length"))
        )
    else:
        other = F.col("__at") == 0
        near = _common_span(F.when(other, F.col("text")), F.when(other, F.col("quote")))
        spans = found.withColumn("__near", near).withColumn(
            "__span",
            F.when(
                F.col("__at") > 0,
                F.struct((F.col("__at") - 1).alias("start"), F.length("quote").alias("length")),
            ).otherwise(F.col("__near")),
        )
    return (
        spans.select(
            *CONTEXT_KEY,
            "teacher_ord",
            F.col("__span.start").alias("start"),
            (F.col("__span.start") + F.col("__span.length")).alias("end"),
            "section",
            "quote_ord",
        )
        .filter(F.col("end") > F.col("start"))
    )


def vote_counts(spans: DataFrame) -> DataFrame:
    """``qid, ctx_pos, start, end, votes``: distinct teachers per stretch of characters."""
    one = [*CONTEXT_KEY, "teacher_ord"]
    order = Window.partitionBy(*one).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    merged = (
        spans.withColumn("__new", F.when(F.col("start") <= reach, 0).otherwise(1))
        .withColumn("__island", island)
        .groupBy(*one, "__island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
    )
    ends = F.array(
        F.struct(F.col("start").alias("at"), F.lit(1).alias("delta")),
        F.struct(F.col("end").alias("at"), F.lit(-1).alias("delta")),
    )
    marks = merged.select(*CONTEXT_KEY, F.inline(ends)).groupBy(*CONTEXT_KEY, "at").agg(F.sum("delta").alias("delta"))
    sweep = Window.partitionBy(*CONTEXT_KEY).orderBy("at")
    return marks.select(
        *CONTEXT_KEY,
        F.col("at").alias("start"),
        F.lead("at").over(sweep).alias("end"),
        F.sum("delta").over(sweep.rowsBetween(Window.unboundedPreceding, 0)).alias("votes"),
    ).filter(F.col("votes") > 0)


def majority_span(votes: DataFrame, gate: DataFrame, contexts: DataFrame, min_quote: int = MIN_QUOTE) -> DataFrame:
    """``qid, ctx_pos, title, quote``: text from the first to the last majority character."""
    spans = (
        votes.join(gate.filter(F.col("outcome") == "open").select("qid", "majority"), "qid")
        .filter(F.col("votes") >= F.col("majority"))
        .groupBy(*CONTEXT_KEY)
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
    )
    quote = strip_space(F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")))
    return (
        contexts.join(spans, CONTEXT_KEY)
        .select(*CONTEXT_KEY, "title", quote.alias("quote"))
        .filter(F.length("quote") >= min_quote)
    )


def peak_voters(votes: DataFrame, spans: DataFrame) -> DataFrame:
    """``qid, ctx_pos, teacher_ord, section`` at the first character with most votes.

    Where a teacher quotes a character twice, the later quote's section counts.
    """
    best = F.max_by("start", F.struct("votes", -F.col("start")))
    peak = votes.groupBy(*CONTEXT_KEY).agg(best.alias("peak"))
    covering = spans.join(peak, CONTEXT_KEY).filter(
        (F.col("start") <= F.col("peak")) & (F.col("peak") < F.col("end"))
    )
    return covering.groupBy(*CONTEXT_KEY, "teacher_ord").agg(F.max_by("section", "quote_ord").alias("section"))


def context_votes(kept: DataFrame, voters: DataFrame) -> DataFrame:
    """``qid, ctxs``: a question's kept contexts with their voters, as one array.

    At most one entry per retrieved context and one vote per teacher.
    """
    one = F.array_sort(F.collect_list(F.struct("teacher_ord", "section"))).alias("votes")
    per_context = voters.join(kept.select(*CONTEXT_KEY), CONTEXT_KEY).groupBy(*CONTEXT_KEY).agg(one)
    return per_context.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("ctx_pos", "votes"))).alias("ctxs"))


def _shared(a: Column, b: Column) -> Column:
    return F.array_intersect(a["votes"], b["votes"])


def section_pairs(grouped: DataFrame, min_votes: int) -> DataFrame:
    """``qid, a, b, votes``: contexts that at least ``min_votes`` teachers put in one section."""
    mates = F.transform(
        F.col("ctxs"),
        lambda a: F.struct(
            a["ctx_pos"].alias("a"),
            F.filter(
                F.transform(
                    F.col("ctxs"),
                    lambda b: F.struct(b["ctx_pos"].alias("b"), F.size(_shared(a, b)).alias("votes")),
                ),
                lambda m: (m["b"] != a["ctx_pos"]) & (m["votes"] >= min_votes),
            ).alias("mates"),
        ),
    )
    return grouped.select("qid", F.inline(mates)).select("qid", "a", F.inline("mates"))


def section_numbers(ctxs: Column, majority: Column) -> Column:
    """``ctx_pos, section`` of a question's contexts: new section numbers, greedy in context order.

    A context without a number opens a new major section; those that a majority
    puts beside it follow as its minors, in order of the first agreeing teacher,
    then of the context.
    """

    def mates(c: Column, done: Column) -> Column:
        fits = F.filter(
            ctxs,
            lambda o: (o["ctx_pos"] != c["ctx_pos"])
            & (F.size(_shared(o, c)) >= majority)
            & ~F.exists(done, lambda d: d["ctx_pos"] == o["ctx_pos"]),
        )
        keyed = F.transform(
            fits,
            lambda o: F.struct(F.array_min(_shared(c, o))["teacher_ord"].alias("first"), o["ctx_pos"].alias("ctx_pos")),
        )
        return F.sort_array(keyed)

    def numbered(ctx_pos: Column, major: Column, minor: Column) -> Column:
        label = F.concat(major.cast("string"), F.lit("."), minor.cast("string"), F.lit("."))
        return F.struct(ctx_pos.alias("ctx_pos"), label.alias("section"))

    def step(s: Column, c: Column) -> Column:
        opened = F.concat(
            s["done"],
            F.array(numbered(c["ctx_pos"], s["major"], F.lit(1))),
            F.transform(mates(c, s["done"]), lambda m, i: numbered(m["ctx_pos"], s["major"], i + 2)),
        )
        seen = F.exists(s["done"], lambda d: d["ctx_pos"] == c["ctx_pos"])
        return F.struct(
            F.when(seen, s["major"]).otherwise(s["major"] + 1).alias("major"),
            F.when(seen, s["done"]).otherwise(opened).alias("done"),
        )

    nothing = F.slice(F.transform(ctxs, lambda c: numbered(c["ctx_pos"], F.lit(0), F.lit(0))), 1, 0)
    return F.aggregate(ctxs, F.struct(F.lit(1).alias("major"), nothing.alias("done")), step, lambda s: s["done"])


def assign_sections(grouped: DataFrame) -> DataFrame:
    """``qid, ctx_pos, section`` of questions with ``ctxs`` and ``majority``."""
    return grouped.select("qid", F.inline(section_numbers(F.col("ctxs"), F.col("majority"))))


def render_exemplar(kept: DataFrame, sections: DataFrame) -> DataFrame:
    """``qid, exemplar``: ``section title`` and quote lines in context order."""
    line = F.concat("section", F.lit(" "), "title", F.lit("\n"), "quote").alias("line")
    ordered = F.array_sort(F.collect_list(F.struct("ctx_pos", line)))
    return (
        kept.join(sections, CONTEXT_KEY)
        .groupBy("qid")
        .agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("exemplar"))
    )


# One question in one row: the same steps over nested arrays.


def _context_lists(contexts: DataFrame) -> DataFrame:
    """``qid, ctxs``: a question's contexts in one array, without titles too short to match."""
    entry = F.struct("ctx_pos", "title", "text")
    return contexts.filter(F.length("title") >= MIN_TEXT).groupBy("qid").agg(F.sort_array(F.collect_list(entry)).alias("ctxs"))


def _matches(answers: Column) -> Column:
    """A question's usable quotes in one array: teacher_ord, quote_ord, section, title, quote."""

    def of_teacher(a: Column) -> Column:
        numbered = F.transform(
            a["rows"],
            lambda r, i: F.struct(
                a["teacher_ord"].alias("teacher_ord"), i.alias("quote_ord"), r["section"].alias("label"),
                F.get(F.split(r["section"], r"\."), F.lit(0)).try_cast("int").alias("section"), r["title"].alias("title"), r["quote"].alias("quote"),
            ),
        )
        return F.filter(numbered, lambda r: (F.length(r["title"]) >= MIN_TEXT) & (F.length(r["quote"]) >= MIN_TEXT) & (r["label"] != "*"))

    return F.flatten(F.transform(F.filter(answers, lambda a: a["status"] == "parsed"), of_teacher))


def _spans_in(ctxs: Column, quotes: Column, mode: str) -> Column:
    """Contexts with the quotes whose title theirs contains; ``start`` is -1 where a quote is not verbatim."""

    def of_context(c: Column) -> Column:
        fits = F.filter(quotes, lambda q: F.contains(c["title"], q["title"])) if mode != "verbatim" else F.filter(
            quotes, lambda q: F.contains(c["title"], q["title"]) & F.contains(c["text"], q["quote"]) & q["quote"].rlike(r"(?U)\w")
        )
        spans = F.transform(
            fits,
            lambda q: F.struct(
                q["teacher_ord"].alias("teacher_ord"), q["quote_ord"].alias("quote_ord"), q["section"].alias("section"),
                (F.call_function("instr", c["text"], q["quote"]) - 1).alias("start"), F.length(q["quote"]).alias("length"), q["quote"].alias("quote"),
            ),
        )
        return F.struct(c["ctx_pos"].alias("ctx_pos"), c["title"].alias("title"), c["text"].alias("text"), spans.alias("spans"))

    return F.transform(ctxs, of_context)


NEAR = T.ArrayType(T.ArrayType(SPAN))


@F.pandas_udf(NEAR)
def _near_spans(texts: pd.Series, quotes: pd.Series) -> pd.Series:
    """For each context of a question, the longest common substrings of its text with each of its quotes.

    A quote is searched once per text; one that is null here is verbatim.
    """
    out = []
    for of_contexts, of_quotes in zip(texts, quotes):
        rows = []
        for text, wanted in zip(of_contexts, of_quotes) if of_contexts is not None else ():
            known: dict[str, dict] = {}
            for q in wanted:
                if q is not None and q not in known:
                    start, length = longest_common(text, q)
                    known[q] = {"start": start, "length": length}
            rows.append([None if q is None else known[q] for q in wanted])
        out.append(rows)
    return pd.Series(out)


def _swept(spans: Column, majority: Column) -> Column:
    """``first, last, peak``: from the first to the last majority character, and the first character with most votes.

    One pass over the spans' ends in order. A teacher votes while any of its
    spans is open.
    """
    teachers = F.array_distinct(F.transform(spans, lambda s: s["teacher_ord"]))

    def ends(s: Column) -> Column:
        return F.array(
            F.struct(s["start"].alias("at"), F.lit(1).alias("delta"), s["teacher_ord"].alias("teacher")),
            F.struct(s["end"].alias("at"), F.lit(-1).alias("delta"), s["teacher_ord"].alias("teacher")),
        )

    none = F.lit(None).cast("int")

    def swept(t: Column) -> Column:
        start = F.struct(
            F.transform(t, lambda x: F.lit(0)).alias("open"), F.lit(0).alias("votes"), none.alias("first"), none.alias("last"),
            F.lit(0).alias("best"), none.alias("peak"),
        )

        def step(s: Column, e: Column) -> Column:
            place = F.array_position(t, e["teacher"]).cast("int") - 1
            now = F.get(s["open"], place)
            change = F.when((e["delta"] > 0) & (now == 0), 1).when((e["delta"] < 0) & (now == 1), -1).otherwise(0)
            votes = s["votes"] + change
            return F.struct(
                F.transform(s["open"], lambda n, i: F.when(i == place, n + e["delta"]).otherwise(n)).alias("open"),
                votes.alias("votes"),
                F.when(s["first"].isNull() & (votes >= majority), e["at"]).otherwise(s["first"]).alias("first"),
                F.when((s["votes"] >= majority) & (votes < majority), e["at"]).otherwise(s["last"]).alias("last"),
                F.greatest(s["best"], votes).alias("best"),
                F.when(votes > s["best"], e["at"]).otherwise(s["peak"]).alias("peak"),
            )

        return F.aggregate(F.sort_array(F.flatten(F.transform(spans, ends))), start, step)

    return bind(teachers, swept)


def _voted(c: Column, majority: Column) -> Column:
    """``ctx_pos, title, quote, votes`` of one context; the quote is null without a majority."""

    def with_sweep(w: Column) -> Column:
        quote = strip_space(F.substring(c["text"], w["first"] + 1, w["last"] - w["first"]))
        over = F.filter(c["spans"], lambda s: (s["start"] <= w["peak"]) & (w["peak"] < s["end"]))
        keyed = F.sort_array(F.transform(over, lambda s: F.struct(s["teacher_ord"].alias("teacher_ord"), (-s["quote_ord"]).alias("later"), s["section"].alias("section"))))
        latest = bind(keyed, lambda k: F.filter(k, lambda x, i: (i == 0) | (F.get(k, i - 1)["teacher_ord"] != x["teacher_ord"])))
        votes = F.transform(latest, lambda x: F.struct(x["teacher_ord"].alias("teacher_ord"), x["section"].alias("section")))
        return F.struct(c["ctx_pos"].alias("ctx_pos"), c["title"].alias("title"), quote.alias("quote"), votes.alias("votes"))

    return bind(_swept(c["spans"], majority), with_sweep)


def _rendered(ctxs: Column, sections: Column) -> Column:
    """Lines of the numbered contexts in their order."""

    def line(x: Column) -> Column:
        own = F.get(F.filter(ctxs, lambda c: c["ctx_pos"] == x["ctx_pos"]), F.lit(0))
        return F.concat(x["section"], F.lit(" "), own["title"], F.lit("\n"), own["quote"])

    return F.array_join(F.transform(F.sort_array(sections), line), "\n")


def consolidate(contexts: DataFrame, answers: DataFrame, mode: str = "lcs", strict_compat: bool = False) -> DataFrame:
    """``qid, exemplar`` per question; questions with too few usable answers are dropped.

    Contexts and answers meet by question, one exchange each; everything after
    that is done within the row. Quotes that are not verbatim reach Python, a
    question at a time; with ``verbatim`` they are left out.
    """
    gathered = gather_answers(parse_answers(answers, strict_compat)).filter(F.col("outcome") != "dropped")
    lists = _context_lists(contexts)
    usable = F.when(F.col("outcome") == "open", F.col("answers"))
    quotes = F.coalesce(_matches(usable), _matches(F.slice("answers", 1, 0)))
    rows = gathered.select("qid", "majority", quotes.alias("quotes")).join(lists, "qid", "left")
    rows = rows.select("qid", "majority", _spans_in(F.col("ctxs"), F.col("quotes"), mode).alias("ctxs"))
    if mode != "verbatim":
        open_ = F.transform("ctxs", lambda c: F.transform(c["spans"], lambda s: F.when(s["start"] < 0, s["quote"])))
        some = F.exists("ctxs", lambda c: F.exists(c["spans"], lambda s: s["start"] < 0))
        texts = F.transform("ctxs", lambda c: c["text"])
        rows = rows.withColumn("near", _near_spans(F.when(some, texts).otherwise(F.slice(texts, 1, 0)), F.when(some, open_).otherwise(F.slice(open_, 1, 0))))

        def placed(c: Column, i: Column) -> Column:
            def span(s: Column, j: Column) -> Column:
                near = F.get(F.get("near", i), j)
                return s.withField("start", F.coalesce(near["start"], s["start"])).withField("length", F.coalesce(near["length"], s["length"]))

            return c.withField("spans", F.transform(c["spans"], span))

        rows = rows.withColumn("ctxs", F.transform("ctxs", placed))

    def ended(c: Column) -> Column:
        spans = F.transform(
            F.filter(c["spans"], lambda s: s["length"] > 0),
            lambda s: F.struct(s["teacher_ord"].alias("teacher_ord"), s["quote_ord"].alias("quote_ord"), s["section"].alias("section"), s["start"].alias("start"), (s["start"] + s["length"]).alias("end")),
        )
        return c.withField("spans", spans)

    quoted = F.filter(F.transform("ctxs", ended), lambda c: F.size(c["spans"]) > 0)
    voted = F.transform(quoted, lambda c: _voted(c, F.col("majority")))
    kept = F.filter(voted, lambda c: F.length(c["quote"]) >= MIN_QUOTE)
    rows = rows.select("qid", "majority", kept.alias("ctxs"))
    rows = rows.withColumn("sections", section_numbers(F.col("ctxs"), F.col("majority")))
    return rows.select("qid", F.coalesce(_rendered(F.col("ctxs"), F.col("sections")), F.lit("")).alias("exemplar"))


def unpivot_teachers(records: DataFrame, teachers: list[str], key: str = "qid") -> DataFrame:
    """``qid, teacher, teacher_ord, answer`` from records with one answer column per teacher."""
    answers = F.array(*[F.struct(F.lit(t).alias("teacher"), F.col(t).alias("answer")) for t in teachers])
    rows = records.select(F.col(key).alias("qid"), F.posexplode(answers).alias("teacher_ord", "__a"))
    return rows.select("qid", "__a.teacher", "teacher_ord", "__a.answer")


def consolidate_records(
    records: DataFrame, teachers: list[str], key: str = "qid", mode: str = "lcs", strict_compat: bool = False
) -> DataFrame:
    """Records with nested ``ctxs`` and one column per teacher, and their ``exemplar``.

    Records with too few usable answers are dropped.
    """
    contexts = explode_contexts(records, key).select("qid", F.col("pos").cast("int").alias("ctx_pos"), "title", "text")
    found = consolidate(contexts, unpivot_teachers(records, teachers, key), mode, strict_compat)
    return records.join(found.withColumnRenamed("qid", key), key)
