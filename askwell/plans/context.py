"""Queries for context assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import context as C
from . import inputs as I
from .registry import query

KEPT = f"""+ kept as (select qid, id, title, {I.sql_strip("text")} as text, score, pos from contexts
  where length({I.sql_strip("text")}) >= 5 and not starts_with(title, 'Category:') and not contains(text, ' ; '))"""
BUDGET = (
    KEPT
    + """, budget as (select * from (select *, sum(length(text) + length(title)) over
  (partition by qid order by pos rows between unbounded preceding and current row) as used from kept) where used <= 1500)"""
)


def dedup(source: str) -> str:
    return f""", dedup as (select qid, text, min(pos) as pos, arg_max(id, pos) as id, arg_max(title, pos) as title,
  arg_max(score, pos) as score from {source} group by qid, text)"""


PER_TITLE = """, best as (select * from (select *, row_number() over (partition by qid, title order by score desc, pos) as rn
  from dedup) where rn <= 2),
  gaps as (select *, lag(id) over (partition by qid, title order by id, pos) as before from best),
  documents_md as (select qid, title, max(score) as max_score, '## ' || title || chr(10) ||
    string_agg(case when before is null then '' when before + 1 = id then ' ' else '...' end || text, '' order by id, pos) as document
    from gaps group by qid, title)"""
RANKED = """, ranked as (select *, row_number() over (partition by qid order by max_score desc, title desc) as rank from documents_md)"""


def filtered(spark: SparkSession, sf: str) -> DataFrame:
    return C.filter_contexts(I.contexts(spark, sf))


@query("c01_filter_contexts", I.with_views("contexts", then=KEPT + " select qid, pos, id, title, md5(text) as text_md5 from kept"))
def c01(spark: SparkSession, sf: str) -> DataFrame:
    return filtered(spark, sf).select("qid", "pos", "id", "title", F.md5("text").alias("text_md5"))


@query("c02_budget_contexts", I.with_views("contexts", then=BUDGET + " select qid, pos, id, title from budget"))
def c02(spark: SparkSession, sf: str) -> DataFrame:
    return C.budget_contexts(filtered(spark, sf), 1500).select("qid", "pos", "id", "title")


@query(
    "c03_dedup_contexts",
    I.with_views("contexts", then=KEPT + dedup("kept") + " select qid, pos, id, title, round(score, 6) as score, md5(text) as text_md5 from dedup"),
)
def c03(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.dedup_contexts(filtered(spark, sf))
    return rows.select("qid", "pos", "id", "title", F.round("score", 6).alias("score"), F.md5("text").alias("text_md5"))


@query(
    "c04_title_max_score",
    I.with_views("contexts", then="select qid, pos, title, round(max(score) over (partition by qid, title), 6) as max_score from contexts"),
)
def c04(spark: SparkSession, sf: str) -> DataFrame:
    return C.title_max_score(I.contexts(spark, sf)).select("qid", "pos", "title", F.round("max_score", 6).alias("max_score"))


@query(
    "c05_top_passages_per_title",
    I.with_views("contexts", then="select qid, pos, title from (select *, row_number() over (partition by qid, title order by score desc, pos) as rn from contexts) where rn <= 2"),
)
def c05(spark: SparkSession, sf: str) -> DataFrame:
    return C.top_passages_per_title(I.contexts(spark, sf), 2).select("qid", "pos", "title")


def stitched(spark: SparkSession, sf: str) -> DataFrame:
    return C.stitch_title(C.top_passages_per_title(C.dedup_contexts(filtered(spark, sf)), 2))


STITCHED = KEPT + dedup("kept") + PER_TITLE


@query(
    "c06_stitch_title",
    I.with_views("contexts", then=STITCHED + " select qid, title, round(max_score, 6) as max_score, md5(document) as document_md5 from documents_md"),
)
def c06(spark: SparkSession, sf: str) -> DataFrame:
    rows = stitched(spark, sf)
    return rows.select("qid", "title", F.round("max_score", 6).alias("max_score"), F.md5("document").alias("document_md5"))


@query("c07_top_titles", I.with_views("contexts", then=STITCHED + RANKED + " select qid, title, rank::int as rank from ranked where rank <= 3"))
def c07(spark: SparkSession, sf: str) -> DataFrame:
    return C.top_titles(stitched(spark, sf), 3).select("qid", "title", "rank")


@query(
    "c08_shuffle_titles",
    I.with_views(
        "contexts",
        then=STITCHED
        + RANKED
        + """ select qid, title, (row_number() over (partition by qid order by md5(concat_ws('|', '11', qid::varchar, title)), title))::int as rank
        from ranked where rank <= 3""",
    ),
)
def c08(spark: SparkSession, sf: str) -> DataFrame:
    return C.shuffle_titles(C.top_titles(stitched(spark, sf), 3), 11).select("qid", "title", "rank")


JOINED = """ select qid, md5(string_agg(document, chr(10) || '---' || chr(10) order by rank)) as context_md5
  from ranked where rank <= {} group by qid"""


@query("c09_join_context", I.with_views("contexts", then=STITCHED + RANKED + JOINED.format(3)))
def c09(spark: SparkSession, sf: str) -> DataFrame:
    return C.join_context(C.top_titles(stitched(spark, sf), 3)).select("qid", F.md5("context").alias("context_md5"))


FEVER = fixed.TASK_INSTRUCTIONS["fever"]
SQL_FEVER = "'" + FEVER.replace("'", "''") + "'"


@query(
    "c10_build_question",
    I.with_views(
        "turns",
        then=f"""select id, case when turn = 0 then {SQL_FEVER} || chr(10) || question || chr(10) || 'A: ' || answers[1] || chr(10) || 'B: ' || answers[2]
          when turn = 2 then {SQL_FEVER} || chr(10) || pred else {SQL_FEVER} || question end as prompt from turns""",
    ),
)
def c10(spark: SparkSession, sf: str) -> DataFrame:
    turns = I.turns(spark, sf)
    choices = F.struct(F.array(F.lit("1"), F.lit("B")).alias("label"), F.col("answers").alias("text"))
    prefixed = F.when(~F.col("turn").isin(0, 2), F.concat(F.lit(FEVER), "question")).otherwise(F.col("question"))
    prompt = C.build_question(
        prefixed, FEVER, F.when(F.col("turn") == 2, F.col("pred")), F.when(F.col("turn") == 0, choices)
    )
    return turns.select("id", prompt.alias("prompt"))


@query(
    "c11_highlight_keyword",
    I.with_views(
        "passages",
        then="""select id, md5(case when hit > 0 then substr(text, 1, hit - 1) || '**' || substr(text, hit, 3) || '**' || substr(text, hit + 3) else text end) as text_md5
        from (select id, text, instr(lower(text), 'the') as hit from passages)""",
    ),
)
def c11(spark: SparkSession, sf: str) -> DataFrame:
    return I.passages(spark, sf).select("id", F.md5(C.highlight_keyword(F.col("text"), "THE")).alias("text_md5"))


@query(
    "c12_assemble_context",
    I.with_views("contexts", then=BUDGET + dedup("budget") + PER_TITLE + RANKED + JOINED.format(10)),
)
def c12(spark: SparkSession, sf: str) -> DataFrame:
    return C.assemble_context(I.contexts(spark, sf), max_len=1500).select("qid", F.md5("context").alias("context_md5"))


@query(
    "c12_assemble_records",
    I.with_views(
        "contexts",
        then=BUDGET + dedup("budget") + PER_TITLE + RANKED
        + f""", joined as ({JOINED.format(10)})
          select doc_id as qid, {SQL_FEVER} || chr(10) || lang as prompt, coalesce(context_md5, md5('')) as context_md5
          from documents left join joined on qid = doc_id""",
    ),
)
def c12_records(spark: SparkSession, sf: str) -> DataFrame:
    """From records with doubly nested contexts to prompt and context."""
    rows = I.contexts(spark, sf).groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("pos", "id", "title", "text", "score"))).alias("__c")
    )
    entry = lambda c: F.struct(c["id"].cast("string").alias("id"), *[c[x].alias(x) for x in ("title", "text", "score")])
    nested = rows.select("qid", F.struct(F.transform("__c", entry).alias("ctxs")).alias("ctxs"))
    questions = I.table(spark, sf, "documents").select(F.col("doc_id").alias("qid"), F.col("lang").alias("question"))
    out = C.assemble_records(nested.join(questions, "qid"), instruction=FEVER, max_len=1500)
    return out.select("qid", "prompt", F.md5("context").alias("context_md5"))


@query(
    "c12_assemble_retrieved",
    I.with_views(
        "hits",
        then="""+ contexts as (select qid, rank - 1 as pos, pid as id, source as title, text, score from hits join documents on pid = doc_id)"""
        + KEPT.replace("+ kept", ", kept")
        + dedup("kept")
        + PER_TITLE
        + RANKED
        + JOINED.format(5),
    ),
)
def c12_retrieved(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieval and assembly in one plan."""
    docs = I.table(spark, sf, "documents").select(F.col("doc_id").alias("pid"), F.col("source").alias("title"), "text")
    rows = I.hits(spark, sf).join(docs, "pid").select(
        "qid", (F.col("rank") - 1).alias("pos"), F.col("pid").alias("id"), "title", "text", "score"
    )
    return C.assemble_context(rows, n_docs=5).select("qid", F.md5("context").alias("context_md5"))
