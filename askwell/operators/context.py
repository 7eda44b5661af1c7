"""Context assembly (C1-C12) over rows ``qid, pos, id, title, text, score``.

``pos`` is the place of a passage in its question's list, best score first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.choices import format_choices
from ..functions.text import strip_space

SHORTEST = 5


def filter_contexts(df: DataFrame) -> DataFrame:
    """Trim texts; drop short ones, category pages and `` ; `` lists."""
    return (
        df.withColumn("text", strip_space(F.col("text")))
        .filter(F.length("text") >= SHORTEST)
        .filter(~F.col("title").startswith("Category:"))
        .filter(F.instr("text", " ; ") == 0)
    )


def budget_contexts(df: DataFrame, max_len: int) -> DataFrame:
    """Keep the leading passages whose running text and title length stays within ``max_len``."""
    order = Window.partitionBy("qid").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.length("text") + F.length("title")).over(order)
    return df.withColumn("__used", used).filter(F.col("__used") <= max_len).drop("__used")


def dedup_contexts(df: DataFrame) -> DataFrame:
    """One row per question and text: first position, last score, title and id."""
    last = F.max_by(F.struct("score", "title", "id"), "pos")
    return (
        df.groupBy("qid", "text")
        .agg(F.min("pos").alias("pos"), last.alias("last"))
        .select("qid", "pos", "last.id", "last.title", "text", "last.score")
    )


def title_max_score(df: DataFrame) -> DataFrame:
    """Best score of each question's title next to every passage."""
    return df.withColumn("max_score", F.max("score").over(Window.partitionBy("qid", "title")))


def top_passages_per_title(df: DataFrame, n_contexts: int = 2) -> DataFrame:
    """Best ``n_contexts`` passages per question and title, earliest first among equals."""
    best = Window.partitionBy("qid", "title").orderBy(F.col("score").desc(), "pos")
    return df.withColumn("__rn", F.row_number().over(best)).filter(F.col("__rn") <= n_contexts).drop("__rn")


def stitch_title(df: DataFrame) -> DataFrame:
    """One markdown document per question and title, passages in id order.

    Consecutive ids are joined by a blank, others by ``...``. Run it on the
    few passages kept per title.
    """
    parts = F.array_sort(F.collect_list(F.struct("id", "pos", "text")))
    rows = df.groupBy("qid", "title").agg(F.max("score").alias("max_score"), parts.alias("parts"))

    def piece(part: Column, i: Column) -> Column:
        before = F.get(F.col("parts"), i - 1)["id"]
        joint = F.when(i == 0, "").when(before + 1 == part["id"], " ").otherwise("...")
        return F.concat(joint, part["text"])

    body = F.array_join(F.transform("parts", piece), "")
    return rows.select("qid", "title", "max_score", F.concat(F.lit("## "), "title", F.lit("\n"), body).alias("document"))


def top_titles(df: DataFrame, n_docs: int = 10) -> DataFrame:
    """Best ``n_docs`` titles per question, with their rank; equal scores go by title, last first."""
    best = Window.partitionBy("qid").orderBy(F.col("max_score").desc(), F.col("title").desc())
    return df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n_docs)


def shuffle_titles(df: DataFrame, seed: int) -> DataFrame:
    """Re-rank the kept titles of a question in a repeatable random order."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("qid").cast("string"), "title"))
    order = Window.partitionBy("qid").orderBy(key, "title")
    return df.withColumn("rank", F.row_number().over(order))


def join_context(df: DataFrame) -> DataFrame:
    """``qid, context``: documents of a question in rank order (at most ``n_docs`` of them)."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "document")))
    return df.groupBy("qid").agg(
        F.array_join(F.transform(ordered, lambda d: d["document"]), fixed.DOCUMENT_BREAK).alias("context")
    )


def build_question(
    question: Column,
    instruction: str | None = None,
    given_input: Column | None = None,
    choices: Column | None = None,
    own_instruction: Column | None = None,
) -> Column:
    """Question text of a prompt: choices form, or instruction and input."""
    body = question if given_input is None else F.coalesce(given_input, question)
    if instruction is None:
        plain = body
    else:
        plain = F.when(question.startswith(instruction), body).otherwise(F.concat(F.lit(instruction + "\n"), body))
    if choices is None:
        return plain
    return F.when(choices.isNotNull(), format_choices(choices, question, instruction, own_instruction)).otherwise(plain)


def highlight_keyword(text: Column, keyword: Column | str) -> Column:
    """Bold the first case-insensitive hit of a keyword, in the text's own spelling."""
    key = F.lit(keyword) if isinstance(keyword, str) else keyword
    pattern = F.concat(F.lit("(?iu)"), quoted(key))
    hit, at = F.regexp_substr(text, pattern), F.regexp_instr(text, pattern)
    head = F.substring(text, F.lit(1), at - 1)
    tail = F.substring(text, at + F.length(hit), F.length(text))
    return F.when(at > 0, F.concat(head, F.lit("**"), hit, F.lit("**"), tail)).otherwise(text)


def quoted(key: Column) -> Column:
    """A text as a pattern that matches just that text."""
    return F.concat(F.lit(r"\Q"), F.replace(key, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def assemble_context(
    df: DataFrame,
    max_len: int | None = None,
    n_docs: int = 10,
    n_contexts: int = 2,
    seed: int | None = None,
) -> DataFrame:
    """``qid, context``: filtered, budgeted, de-duplicated passages stitched by title.

    The best score of a title is the score of its first kept passage, so no
    separate pass over the titles is needed. A seed shuffles the titles.
    """
    kept = filter_contexts(df)
    if max_len is not None:
        kept = budget_contexts(kept, max_len)
    documents = stitch_title(top_passages_per_title(dedup_contexts(kept), n_contexts))
    best = top_titles(documents, n_docs)
    if seed is not None:
        best = shuffle_titles(best, seed)
    return join_context(best)


def explode_contexts(records: DataFrame, key: str = "qid", ctxs: str = "ctxs") -> DataFrame:
    """Rows ``qid, pos, id, title, text, score`` of records with a list of contexts.

    The list may stand in a field ``ctxs`` of its own. A missing score is 0, a
    missing id the position.
    """
    kind, column = records.schema[ctxs].dataType, F.col(ctxs)
    if isinstance(kind, T.StructType):
        kind, column = kind["ctxs"].dataType, column["ctxs"]
    names = kind.elementType.fieldNames()
    rows = records.select(F.col(key).alias("qid"), F.posexplode(column).alias("pos", "__ctx"))

    def given(name: str, type_: str, default: Column) -> Column:
        return F.coalesce(F.col(f"__ctx.{name}").cast(type_), default) if name in names else default

    return rows.select(
        "qid",
        F.col("pos").cast("long").alias("pos"),
        given("id", "long", F.col("pos").cast("long")).alias("id"),
        F.col("__ctx.title").alias("title"),
        F.col("__ctx.text").alias("text"),
        given("score", "double", F.lit(0.0)).alias("score"),
    )


def assemble_records(records: DataFrame, key: str = "qid", instruction: str | None = None, **options) -> DataFrame:
    """Records with ``prompt`` and ``context``: the question's text and its assembled contexts.

    ``input`` stands for the question and ``choices`` for the answer options
    where a record has them; ``options`` go to ``assemble_context``. A record
    without any usable context has an empty one.
    """
    own = {c: F.col(c) for c in ("input", "choices") if c in records.columns}
    prompt = build_question(F.col("question"), instruction, own.get("input"), own.get("choices"))
    contexts = assemble_context(explode_contexts(records, key), **options).withColumnRenamed("qid", key)
    joined = records.withColumn("prompt", prompt).join(contexts, key, "left")
    return joined.withColumn("context", F.coalesce("context", F.lit("")))
