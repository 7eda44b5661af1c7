"""Cleaning one model's sectioned quotes (T10), as a chain of array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed
from .text import section_rows, strip_trailing_block, unquote


def _short(quote: Column) -> Column:
    """Under three characters, or one character three times."""
    dummy = (F.length(quote) == 3) & (F.replace(quote, F.substring(quote, 1, 1)) == "")
    return (F.length(quote) < 3) | dummy


def _items(rows: Column) -> Column:
    """Rows with their place, two-level section number and bare quote."""
    return F.transform(
        rows,
        lambda r, i: F.struct(
            i.alias("at"),
            F.array_join(F.slice(F.split(r["section"], r"\."), 1, 2), ".").alias("number"),
            r["title"].alias("title"),
            unquote(r["quote"]).alias("quote"),
        ),
    )


def _distinct(items: Column) -> Column:
    """Each quote at its last place, with the section and title of its first."""

    def merge(x: Column) -> Column:
        first = F.element_at(F.filter(items, lambda y: y["quote"] == x["quote"]), 1)
        return F.struct(x["at"].alias("at"), first["number"].alias("number"), first["title"].alias("title"), x["quote"].alias("quote"))

    last = F.filter(items, lambda x: ~F.exists(items, lambda y: (y["quote"] == x["quote"]) & (y["at"] > x["at"])))
    return F.transform(last, merge)


def _kept(distinct: Column) -> Column:
    """No short quote, and none that lies inside a later one."""
    return F.filter(
        distinct,
        lambda x: ~_short(x["quote"])
        & ~F.exists(
            distinct,
            lambda y: (y["at"] > x["at"]) & ~_short(y["quote"]) & F.contains(y["quote"], x["quote"]),
        ),
    )


def _sorted(kept: Column) -> Column:
    """By numeric section, ``*`` last; equal sections from the end of the text."""
    keyed = F.transform(
        kept,
        lambda x: F.struct(
            F.coalesce(x["number"].try_cast("double"), F.lit(float("inf"))).alias("key"),
            (-x["at"]).alias("back"),
            x["number"].alias("number"),
            x["title"].alias("title"),
            x["quote"].alias("quote"),
        ),
    )
    return F.array_sort(keyed)


def _numbers(ordered: Column) -> Column:
    """New ``major.minor.`` per quote: a fold that restarts minors when the major changes."""
    start = F.struct(
        F.lit(1).alias("major"), F.lit(1).alias("minor"), F.lit(1).alias("last"), F.array().cast("array<string>").alias("out")
    )

    def step(s: Column, x: Column) -> Column:
        given = F.get(F.split(x["number"], r"\."), F.lit(0)).try_cast("int")
        current = F.coalesce(given, s["major"])
        same = (s["last"] == current) | ((s["major"] == 1) & (s["minor"] == 1))
        major = F.when(same, s["major"]).otherwise(s["major"] + 1)
        minor = F.when(same, s["minor"]).otherwise(F.lit(1))
        label = F.concat(major.cast("string"), F.lit("."), minor.cast("string"), F.lit("."))
        return F.struct(
            major.alias("major"),
            (minor + 1).alias("minor"),
            current.alias("last"),
            F.concat(s["out"], F.array(label)).alias("out"),
        )

    return F.aggregate(ordered, start, step)["out"]


def clean_sections(
    df: DataFrame,
    answer: str,
    output: str,
    sep: str = "\n",
    section_type: str | None = "origin",
    title_type: str | None = "origin",
    content_type: str = "origin",
    strict_compat: bool = False,
) -> DataFrame:
    """Adds the cleaned, renumbered and rendered form of a sectioned answer.

    Section: ``origin``, ``star``, ``number`` or ``None``; title: ``origin``,
    ``quote``, ``md`` or ``None``; content: ``origin`` or ``quote``. An answer
    without any section comes back with its last block dropped.
    """
    ordered = F.col("__ordered")
    labels = {
        "star": F.transform(ordered, lambda x: F.lit("*")),
        "number": F.transform(ordered, lambda x, i: F.concat((i + 1).cast("string"), F.lit("."))),
    }

    def line(x: Column, label: Column) -> Column:
        head = [] if section_type is None else [label]
        if title_type is not None:
            shown = {"quote": F.concat(F.lit('"'), x["title"], F.lit('"')), "md": F.concat(F.lit("## "), x["title"])}
            head.append(shown.get(title_type, x["title"]))
        quote = x["quote"]
        if content_type == "quote":
            quote = F.concat(F.lit('"'), F.replace(quote, F.lit('"'), F.lit("'")), F.lit('"'))
        if not head:
            return quote
        return F.concat(F.concat_ws(" ", *head), F.lit("\n" if title_type is not None else " "), quote)

    # One column per step: nested in a single expression they take the analyser far too long.
    staged = (
        df.withColumn("__rows", section_rows(F.col(answer), strict_compat=strict_compat))
        .withColumn("__items", _items(F.col("__rows")))
        .withColumn("__distinct", _distinct(F.col("__items")))
        .withColumn("__ordered", _sorted(_kept(F.col("__distinct"))))
        .withColumn("__labels", labels.get(section_type, _numbers(ordered)))
    )
    lines = F.zip_with("__ordered", "__labels", line)
    text = F.regexp_replace(F.array_join(lines, sep), r"([A-Z])\1{2}", fixed.NO_TITLE)
    result = F.when(F.size("__rows") > 0, text).otherwise(strip_trailing_block(F.col(answer)))
    return staged.withColumn(output, result).drop("__rows", "__items", "__distinct", "__ordered", "__labels")
