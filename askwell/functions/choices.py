"""Multiple-choice question text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind

# Numbered choice labels and their letters.
LETTERS = {"1": "A", "2": "B", "3": "C", "4": "D", "5": "E"}


def choice_lines(choices: Column) -> Column:
    """``K: text`` lines of parallel ``label`` and ``text`` arrays.

    Labels outside 1-5 and A-E are dropped; a repeated label keeps its first
    place and its last text.
    """

    def letter(label: Column) -> Column:
        out = F.when(label.isin(*LETTERS.values()), label)
        for number, name in LETTERS.items():
            out = out.when(label == number, name)
        return out

    pairs = F.arrays_zip(choices["label"].alias("label"), choices["text"].alias("text"))
    known = F.filter(
        F.transform(pairs, lambda p: F.struct(letter(p["label"]).alias("key"), p["text"].alias("text"))),
        lambda p: p["key"].isNotNull(),
    )

    def lines(known: Column) -> Column:
        return F.transform(
            F.array_distinct(F.transform(known, lambda p: p["key"])),
            lambda k: F.concat(k, F.lit(": "), F.element_at(F.filter(known, lambda p: p["key"] == k), -1)["text"]),
        )

    return F.array_join(bind(known, lines), "\n")


def format_choices(
    choices: Column, question: Column, instruction: str | None = None, own_instruction: Column | None = None
) -> Column:
    """Instruction, stem and choice lines; a row's own instruction replaces its question."""
    stem = question if own_instruction is None else F.coalesce(own_instruction, question)
    out = F.concat(stem, F.lit("\n"), choice_lines(choices))
    return out if instruction is None else F.concat(F.lit(instruction + "\n"), out)
