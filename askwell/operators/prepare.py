"""Dataset preparation: projections, reshapes and filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.match import answer_hit
from ..functions.text import strip_control_tokens
from .ordering import with_position

OPTIONAL_COLUMNS = (
    "answers",
    "answer",
    "choices",
    "label",
    "answerKey",
    "type",
    "level",
    "context",
    "output",
)


def flatten_sentences(context: Column, joint: str = "...") -> Column:
    """``(title, sentences)`` pairs to ``(title, text)``."""
    return F.transform(
        context,
        lambda c: F.struct(c["title"].alias("title"), F.array_join(c["sentences"], joint).alias("text")),
    )


def select_supporting(
    paragraphs: Column, top_n: int = 10, seed_key: Column | None = None, seed: int = 0, strict_compat: bool = False
) -> Column:
    """Supporting paragraphs padded to ``top_n`` with others, in order.

    Null below ten paragraphs. The strict form pads with the last paragraph
    only, and only when it is not a supporting one. ``seed_key`` shuffles.
    """
    supporting = F.filter(paragraphs, lambda p: p["is_supporting"])
    room = F.greatest(F.lit(top_n) - F.size(supporting), F.lit(0))
    if strict_compat:
        last = F.element_at(paragraphs, -1)
        padding = F.when(last["is_supporting"], F.slice(paragraphs, F.lit(1), F.lit(0))).otherwise(
            F.array_repeat(last, room)
        )
    else:
        padding = F.slice(F.filter(paragraphs, lambda p: ~p["is_supporting"]), F.lit(1), room)
    kept = F.concat(supporting, padding)
    if seed_key is not None:
        keyed = F.transform(
            kept, lambda p, i: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), seed_key, i)).alias("k"), i, p.alias("p"))
        )
        kept = F.transform(F.array_sort(keyed), lambda x: x["p"])
    return F.when(F.size(paragraphs) >= 10, kept)


def ctxs_from_columns(df: DataFrame, title: str, text: str, question: str, key: str) -> DataFrame:
    """``id, question, ctxs`` with one context per row; no context without text."""
    one = F.array(F.struct(F.coalesce(F.col(title), F.lit(fixed.NO_TITLE)).alias("title"), F.col(text).alias("text")))
    return (
        df.dropna(subset=[question, key])
        .withColumn("ctxs", F.when(F.col(text).isNotNull(), one).otherwise(F.slice(one, 1, 0)))
        .withColumnRenamed(key, "id")
        .withColumnRenamed(question, "question")
        .drop(title, text)
    )


def keep_labels(df: DataFrame, allowed: Sequence[str], column: str = "label") -> DataFrame:
    """Rows whose label is in the white list."""
    return df.filter(F.col(column).isin(*allowed))


def rename_project(df: DataFrame, renames: dict[str, str], columns: Sequence[str]) -> DataFrame:
    """Rename, then keep the named columns."""
    return df.withColumnsRenamed(renames).select(*columns)


def positional_attach(left: DataFrame, right: DataFrame, left_order: str, right_order: str, columns: Sequence[str]) -> DataFrame:
    """Columns of the right table joined on row number."""
    a = with_position(left, left_order, name="__pos")
    b = with_position(right, right_order, name="__pos").select("__pos", *columns)
    return a.join(b, "__pos", "left").drop("__pos")


def aliases_lookup(df: DataFrame, qa: DataFrame) -> DataFrame:
    """Alias lists of the same question; repeated questions multiply."""
    return df.join(qa.select("question", F.col("answer.aliases").alias("answers")), "question")


def strip_instruction(question: Column, instruction: str) -> Column:
    """Question without the literal instruction line."""
    return F.replace(question, F.lit(instruction))


def match_flags(df: DataFrame, context: str = "context", output: str = "output") -> DataFrame:
    """``context_match`` and ``output_match``: does the gold answer occur there."""
    return df.withColumn("context_match", answer_hit(df, F.col(context))).withColumn(
        "output_match", answer_hit(df, F.col(output))
    )


def match_rates(flagged: DataFrame) -> DataFrame:
    """Means of the two flags."""
    return flagged.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in ("context_match", "output_match")])


def mismatch_rows(flagged: DataFrame, kind: str = "lost") -> DataFrame:
    """``lost``: gold in the context but not in the output; ``invented``: the reverse."""
    context, output = F.col("context_match"), F.col("output_match")
    return flagged.filter(context & ~output if kind == "lost" else ~context & output)


def drop_disagreeing(flagged: DataFrame) -> DataFrame:
    """Rows whose two flags agree."""
    return flagged.filter(F.col("context_match") == F.col("output_match"))


def blank_unsupported(flagged: DataFrame) -> DataFrame:
    """Empty the output where it holds an answer its context lacks."""
    invented = ~F.col("context_match") & F.col("output_match")
    return flagged.withColumn("output", F.when(invented, "").otherwise(F.col("output")))


def merge_training_sets(dfs: Sequence[DataFrame], columns: Sequence[str] = ("question", "context", "output")) -> DataFrame:
    """Common columns of several sets, one after another; absent columns become null."""
    parts = [d.select(*[c for c in columns if c in d.columns]) for d in dfs]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select(*columns)


def fill_teacher(flagged: DataFrame, answers: DataFrame, key: str, column: str = "teacher") -> DataFrame:
    """Second opinion on rows whose answer was lost, and whether it now holds the gold answer."""
    second = answers.select(key, F.col("answer").alias("__second"))
    lost = F.col("context_match") & ~F.col("output_match")
    out = flagged.join(second, key, "left").withColumn(column, F.when(lost, F.col("__second"))).drop("__second")
    return out.withColumn("teacher_match", F.when(F.col(column).isNotNull(), answer_hit(out, F.col(column))))


def normalize_task_input(df: DataFrame, task: str) -> DataFrame:
    """Bring the columns of a task's file to the common names."""
    names = df.columns
    if task == "factscore":
        answer = F.coalesce(F.col("output"), F.col("topic")) if "output" in names else F.col("topic")
        return df.withColumn("instruction", F.col("input")).withColumn("output", F.array(answer))
    if task == "qa":
        own = F.coalesce(F.col("instruction"), F.col("question")) if "instruction" in names else F.col("question")
        out = df.withColumn("instruction", own)
        if "output" in names:
            listed = F.array("output")
            out = out.withColumn("answers", F.coalesce(F.col("answers"), listed) if "answers" in names else listed)
        return out
    if task in ("asqa", "eli5"):
        prefix = fixed.TASK_INSTRUCTIONS[task] + "## Input:\n\n"
        return df.withColumn("instruction", F.concat(F.lit(prefix), "question"))
    raise ValueError(f"unknown task {task}")


def task_output(df: DataFrame, task: str, prediction: str = "prediction") -> DataFrame:
    """Shape a task's prediction as its scorer expects it."""
    if task == "factscore":
        return df.select("input", F.col(prediction).alias("output"), "topic", "cat")
    if task == "qa":
        return df.withColumnRenamed(prediction, "pred")
    if task in ("asqa", "eli5"):
        return df.withColumn("output", strip_control_tokens(F.col(prediction)))
    raise ValueError(f"unknown task {task}")


def carry_columns(df: DataFrame, keys: Sequence[str], optional: Sequence[str] = OPTIONAL_COLUMNS) -> DataFrame:
    """The given columns and those optional ones that exist."""
    return df.select(*keys, *[c for c in optional if c in df.columns and c not in keys])


def citation_answer(sentences: Column, docs: Column) -> Column:
    """``(output, docs)``: cleaned sentences ending in ``[i]. `` and the documents they cite."""
    cited = F.filter(
        F.transform(
            F.arrays_zip(sentences.alias("s"), docs.alias("d")),
            lambda p, i: F.struct(i.alias("i"), p["s"].alias("s"), p["d"].alias("d")),
        ),
        lambda p: F.length(p["s"]) > 0,
    )

    def cite(pair: Column) -> Column:
        clean = strip_control_tokens(pair["s"])
        body = F.substring(clean, F.lit(1), F.greatest(F.length(clean) - 1, F.lit(0)))
        return F.concat(body, F.lit(" ["), pair["i"].cast("string"), F.lit("]. "))

    text = F.regexp_replace(F.array_join(F.transform(cited, cite), ""), r" \z", "")
    return F.struct(text.alias("output"), F.transform(cited, lambda p: p["d"]).alias("docs"))


def passage_text(title: Column, text: Column, joint: str = " ") -> Column:
    """Text to embed: title and text, or the text alone without a title."""
    return F.when(F.length(title) > 0, F.concat(title, F.lit(joint), text)).otherwise(text)


def renumber_docs(context: Column) -> Column:
    """Titles of an assembled context replaced by document numbers, one document after another."""
    docs = F.split(context, fixed.DOCUMENT_BREAK)
    numbered = F.transform(
        docs, lambda d, i: F.replace(d, F.lit("## "), F.concat(F.lit("["), i.cast("string"), F.lit("]")))
    )
    return F.array_join(numbered, "\n")


def fill_template(template: str, **values: Column) -> Column:
    """A template with its ``{name}`` places filled in one pass."""
    parts: list[Column] = []
    rest = template
    while rest:
        places = sorted((rest.find("{" + n + "}"), n) for n in values if "{" + n + "}" in rest)
        if not places:
            parts.append(F.lit(rest))
            break
        at, name = places[0]
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(values[name])
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def render_prompt(template: str, task: str | None = None, **values: Column) -> Column:
    """A named template filled with columns; a task instruction goes before ``question`` or ``instruction``."""
    instruction = fixed.TASK_INSTRUCTIONS.get(task) if task else None
    if instruction is not None:
        for name in ("question", "instruction"):
            if name in values:
                values[name] = F.concat(F.lit(instruction + "\n"), values[name])
    return fill_template(fixed.PROMPT_TEMPLATES[template], **values)


def to_messages(system: Column, user: Column) -> Column:
    """Two-element chat: system, then user."""
    return F.array(
        F.struct(F.lit("system").alias("role"), system.alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )


def quote_messages(question: Column, context: Column, task_type: str = "question", strict: bool = False) -> Column:
    """Chat that asks for sectioned verbatim quotes."""
    system = fill_template(
        fixed.SYSTEM_TEXTS["quote_strict" if strict else "quote_relaxed"], task_type=F.lit(task_type)
    )
    user = fill_template(
        fixed.QUOTE_REQUEST, task_type=F.lit(task_type.capitalize()), question=question, context=context
    )
    return to_messages(system, user)


def map_batches(
    df: DataFrame, column: str, fn: Callable[[pd.Series], pd.Series], output: str, output_type: T.DataType, batch: int = 512
) -> DataFrame:
    """Append one column computed by a user function over batches of at most ``batch`` values."""
    schema = T.StructType([*df.schema.fields, T.StructField(output, output_type)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch].reset_index(drop=True)
                result = pd.Series(fn(part[column])).reset_index(drop=True)
                if len(result) != len(part):
                    raise ValueError(f"{len(result)} results for {len(part)} rows")
                yield part.assign(**{output: result})

    return df.mapInPandas(run, schema)
