"""Queries for dataset preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.choices import format_choices
from ..operators import prepare as P
from . import inputs as I
from .registry import query
from .text import quoted


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return I.table(spark, sf, "documents")


@query(
    "p01_flatten_sentences",
    "select doc_id, source as title, md5(array_to_string(string_split(text, chr(10)), '...')) as text_md5 from documents",
)
def p01(spark: SparkSession, sf: str) -> DataFrame:
    pair = F.struct(F.col("source").alias("title"), F.split("text", "\n").alias("sentences"))
    rows = docs(spark, sf).select("doc_id", F.inline(P.flatten_sentences(F.array(pair))))
    return rows.select("doc_id", "title", F.md5("text").alias("text_md5"))




@query(
    "p02_select_supporting",
    f"""with paras as (select doc_id, p, i, n, {I.sql_uniform("sup", "doc_id", "i")} < 0.2 as sup from (
          select doc_id, len(ps) as n, unnest(ps) as p, generate_subscripts(ps, 1) - 1 as i from (select doc_id, string_split(text, chr(10)) as ps from documents))),
        placed as (select *, count(*) filter (sup) over (partition by doc_id) as n_sup,
          row_number() over (partition by doc_id, sup order by i) as r, (max(sup::int) over (partition by doc_id)) as has from paras where n >= 10),
        kept as (select * from placed where sup or r <= 10 - n_sup),
        ours as (select doc_id, md5(string_agg(p, '|' order by sup desc, i)) as kept_md5, count(*)::int as n_kept from kept group by doc_id),
        strict as (select doc_id, (max(n_sup) + case when arg_max(sup, i) then 0 else greatest(10 - max(n_sup), 0) end)::int as n_strict from placed group by doc_id)
        select doc_id, kept_md5, n_kept, n_strict from documents left join ours using (doc_id) left join strict using (doc_id)""",
)
def p02(spark: SparkSession, sf: str) -> DataFrame:
    paragraphs = F.transform(
        F.split("text", "\n"),
        lambda p, i: F.struct(p.alias("text"), (I.uniform("sup", F.col("doc_id"), i) < 0.2).alias("is_supporting")),
    )
    rows = docs(spark, sf).select("doc_id", paragraphs.alias("paragraphs"))
    kept = rows.withColumn("kept", P.select_supporting(F.col("paragraphs")))
    return kept.select(
        "doc_id",
        F.md5(F.array_join(F.transform("kept", lambda p: p["text"]), "|")).alias("kept_md5"),
        F.size("kept").alias("n_kept"),
        F.size(P.select_supporting(F.col("paragraphs"), strict_compat=True)).alias("n_strict"),
    )


@query(
    "p03_ctxs_from_columns",
    """select doc_id as id, source as question, case when lang = 'es' then 0 else 1 end as n_ctxs,
              case when lang = 'es' then null when lang = 'fr' then '(No Title)' else lang end as title,
              case when lang = 'es' then null else md5(text) end as text_md5
       from documents where n_chars is not null and not (lang = 'de' and source = 'src0')""",
)
def p03(spark: SparkSession, sf: str) -> DataFrame:
    lang = F.col("lang")
    rows = docs(spark, sf).select(
        F.col("doc_id").alias("claim_id"),
        F.when(~((lang == "de") & (F.col("source") == "src0")), F.col("source")).alias("claim"),
        F.when(lang != "fr", lang).alias("subjects"),
        F.when(lang != "es", F.col("text")).alias("main_text"),
    )
    out = P.ctxs_from_columns(rows, "subjects", "main_text", "claim", "claim_id")
    one = F.get("ctxs", F.lit(0))
    return out.select(
        "id", "question", F.size("ctxs").alias("n_ctxs"), one["title"].alias("title"), F.md5(one["text"]).alias("text_md5")
    )


@query("p04_keep_labels", "select event_id, event_type from events where event_type in ('click', 'purchase')")
def p04(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.table(spark, sf, "events").select("event_id", "event_type")
    return P.keep_labels(rows, ["click", "purchase"], "event_type")


@query("p05_rename_project", "select page_id as id, url as question, md5(html) as ctxs from pages")
def p05(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.table(spark, sf, "pages").withColumn("html", F.md5("html"))
    return P.rename_project(rows, {"page_id": "id", "url": "question", "html": "ctxs"}, ["id", "question", "ctxs"])


@query(
    "p06_format_choices",
    f"""select p_partkey, {quoted(fixed.FOUR_CHOICES)} || chr(10) || p_name || chr(10) || 'A: ' || p_brand || chr(10) || 'C: ' || p_size || chr(10) || 'E: ' || p_brand as prompt
        from part""",
)
def p06(spark: SparkSession, sf: str) -> DataFrame:
    labels = F.array(*[F.lit(x) for x in ("1", "C", "F", "3", "E")])
    size = F.col("p_size").cast("string")
    texts = F.array(F.col("p_brand"), F.col("p_type"), F.col("p_type"), size, F.col("p_brand"))
    choices = F.struct(labels.alias("label"), texts.alias("text"))
    prompt = format_choices(choices, F.col("p_name"), fixed.FOUR_CHOICES)
    return I.table(spark, sf, "part").select("p_partkey", prompt.alias("prompt"))


@query(
    "p07_positional_attach",
    """with a as (select o_orderkey, row_number() over (order by o_orderkey) as p from orders),
            b as (select c_custkey, c_name, row_number() over (order by c_custkey desc) as p from customer)
       select o_orderkey, c_name from a left join b using (p)""",
)
def p07(spark: SparkSession, sf: str) -> DataFrame:
    right = I.table(spark, sf, "customer").select("c_name", (-F.col("c_custkey")).alias("back"))
    return P.positional_attach(I.table(spark, sf, "orders").select("o_orderkey"), right, "o_orderkey", "back", ["c_name"])


@query(
    "p08_aliases_lookup",
    "select e.event_id, e.event_type as question, l.n_name || ',' || l.n_regionkey as answers from events e join nation l on (e.user_id % 25)::int = l.n_nationkey",
)
def p08(spark: SparkSession, sf: str) -> DataFrame:
    asked = I.table(spark, sf, "events").select(
        "event_id", "event_type", (F.col("user_id") % 25).cast("int").cast("string").alias("question")
    )
    aliases = F.struct(F.array("n_name", F.col("n_regionkey").cast("string")).alias("aliases"))
    qa = I.table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("question"), aliases.alias("answer"))
    found = P.aliases_lookup(asked, qa)
    return found.select("event_id", F.col("event_type").alias("question"), F.array_join("answers", ",").alias("answers"))


@query("p09_strip_instruction", "select conv_id, turn, md5(replace(text, ' the ', '')) as text_md5 from conversations")
def p09(spark: SparkSession, sf: str) -> DataFrame:
    said = I.table(spark, sf, "conversations")
    return said.select("conv_id", "turn", F.md5(P.strip_instruction(F.col("text"), " the ")).alias("text_md5"))


# Gold answers in the context (the assistant's turn) and in the output (the user's turn back to front).
SQL_FLAGS = f"""+ texts as (select id, question, answers, pred as context,
    array_to_string(list_reverse(string_split(pred, chr(10)))[1:greatest(len(string_split(pred, chr(10))) // 2, 1)], chr(10)) as output from turns),
  flagged as (select *, len(list_filter(answers, lambda a: contains({I.sql_answer("context")}, lower(a)))) > 0 as context_match,
    len(list_filter(answers, lambda a: contains({I.sql_answer("output")}, lower(a)))) > 0 as output_match from texts)"""


def flags_sql(select: str) -> str:
    return I.with_views("turns", then=SQL_FLAGS + " " + select)


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.split("pred", "\n")
    half = F.greatest(F.floor(F.size(lines) / 2).cast("int"), F.lit(1))
    output = F.array_join(F.slice(F.reverse(lines), F.lit(1), half), "\n")
    rows = I.turns(spark, sf).select("id", "question", "answers", F.col("pred").alias("context"), output.alias("output"))
    return P.match_flags(rows)


@query("p10_match_flags", flags_sql("select id, context_match, output_match from flagged"))
def p10(spark: SparkSession, sf: str) -> DataFrame:
    return flagged(spark, sf).select("id", "context_match", "output_match")


@query("p10_match_rates", flags_sql("select round(avg(context_match::int), 6) as context_match, round(avg(output_match::int), 6) as output_match from flagged"))
def p10_rates(spark: SparkSession, sf: str) -> DataFrame:
    rates = P.match_rates(flagged(spark, sf))
    return rates.select(*[F.round(c, 6).alias(c) for c in rates.columns])


@query("p11_mismatch_rows", flags_sql("select id, 'lost' as kind from flagged where context_match and not output_match union all select id, 'invented' from flagged where output_match and not context_match"))
def p11(spark: SparkSession, sf: str) -> DataFrame:
    rows = flagged(spark, sf)
    lost = P.mismatch_rows(rows).select("id", F.lit("lost").alias("kind"))
    return lost.unionByName(P.mismatch_rows(rows, "invented").select("id", F.lit("invented").alias("kind")))


@query("p12_drop_disagreeing", flags_sql("select id, context_match from flagged where context_match = output_match"))
def p12(spark: SparkSession, sf: str) -> DataFrame:
    return P.drop_disagreeing(flagged(spark, sf)).select("id", "context_match")


def swapped(spark: SparkSession, sf: str) -> DataFrame:
    """Context and output exchanged, so that outputs hold answers their context lacks."""
    return flagged(spark, sf).select(
        "id",
        F.col("output").alias("context"),
        F.col("context").alias("output"),
        F.col("output_match").alias("context_match"),
        F.col("context_match").alias("output_match"),
    )


@query("p13_blank_unsupported", flags_sql("select id, md5(case when context_match and not output_match then '' else context end) as output_md5 from flagged"))
def p13(spark: SparkSession, sf: str) -> DataFrame:
    return P.blank_unsupported(swapped(spark, sf)).select("id", F.md5("output").alias("output_md5"))


@query(
    "p14_merge_training_sets",
    I.with_views(
        "turns",
        then="""select question, md5(pred) as context, null::varchar as output from turns
                union all select url, md5(html), lower(url) from pages union all select event_type, null, props from events""",
    ),
)
def p14(spark: SparkSession, sf: str) -> DataFrame:
    a = I.turns(spark, sf).select("id", "question", F.md5("pred").alias("context"))
    b = I.table(spark, sf, "pages").select(
        F.col("url").alias("question"), F.md5("html").alias("context"), F.lower("url").alias("output")
    )
    c = I.table(spark, sf, "events").select(F.col("event_type").alias("question"), F.col("props").alias("output"), "value")
    return P.merge_training_sets([a, b, c])


@query(
    "p15_fill_teacher",
    flags_sql(
        """select id, case when lost then md5(context) end as teacher_md5, case when lost then context_match end as teacher_match
           from (select *, context_match and not output_match as lost from flagged)"""
    ),
)
def p15(spark: SparkSession, sf: str) -> DataFrame:
    answers = I.turns(spark, sf).select("id", F.col("pred").alias("answer"))
    filled = P.fill_teacher(flagged(spark, sf), answers, "id")
    return filled.select("id", F.md5("teacher").alias("teacher_md5"), "teacher_match")


@query(
    "p16_normalize_task_input",
    f"""select page_id as id, 'factscore' as task, url as instruction, coalesce(case when page_id % 2 = 0 then md5(html) end, url) as output from pages
        union all select conv_id * 100 + turn, 'qa', text, role from conversations
        union all select event_id, 'eli5', {quoted(fixed.TASK_INSTRUCTIONS["eli5"])} || '## Input:' || chr(10) || chr(10) || event_type, null from events""",
)
def p16(spark: SparkSession, sf: str) -> DataFrame:
    even = F.when(F.col("page_id") % 2 == 0, F.md5("html"))
    facts = I.table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("input"), F.col("url").alias("topic"), even.alias("output"))
    said = I.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("question"), F.col("role").alias("output")
    )
    asked = I.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("question"))
    a = P.normalize_task_input(facts, "factscore").select("id", F.lit("factscore").alias("task"), "instruction", F.col("output")[0].alias("output"))
    b = P.normalize_task_input(said, "qa").select("id", F.lit("qa").alias("task"), "instruction", F.col("answers")[0].alias("output"))
    c = P.normalize_task_input(asked, "eli5").select("id", F.lit("eli5").alias("task"), "instruction", F.lit(None).cast("string").alias("output"))
    return a.unionByName(b).unionByName(c)


@query("p17_carry_columns", "select p_partkey, p_type as type, p_brand as label from part")
def p17(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.table(spark, sf, "part").withColumnsRenamed({"p_type": "type", "p_brand": "label"})
    return P.carry_columns(rows, ["p_partkey"])


@query(
    "p18_citation_answer",
    """with sents as (select doc_id, unnest(ss) as s, generate_subscripts(ss, 1) - 1 as i from
         (select doc_id, string_split(text, chr(10)) as ss from documents)),
       used as (select * from sents where s <> '')
       select doc_id, md5(regexp_replace(string_agg(left(c, greatest(length(c) - 1, 0)) || ' [' || i || ']. ', '' order by i), ' $', '')) as output_md5,
              string_agg(i::varchar, ',' order by i) as docs
       from (select doc_id, i, regexp_replace(s, '^ ', '') as c from used) group by doc_id""",
)
def p18(spark: SparkSession, sf: str) -> DataFrame:
    sentences = F.split("text", "\n")
    numbers = F.transform(sentences, lambda s, i: i.cast("string"))
    rows = docs(spark, sf).select("doc_id", P.citation_answer(sentences, numbers).alias("cited"))
    cited = rows.filter(F.size("cited.docs") > 0)
    return cited.select("doc_id", F.md5("cited.output").alias("output_md5"), F.array_join("cited.docs", ",").alias("docs"))


@query(
    "p19_passage_text",
    "select doc_id, md5(case when lang = 'en' then text else lang || ' ' || text end) as blank_md5, md5(lang || chr(10) || text) as line_md5 from documents",
)
def p19(spark: SparkSession, sf: str) -> DataFrame:
    title = F.when(F.col("lang") == "en", "").otherwise(F.col("lang"))
    return docs(spark, sf).select(
        "doc_id",
        F.md5(P.passage_text(title, F.col("text"))).alias("blank_md5"),
        F.md5(P.passage_text(F.col("lang"), F.col("text"), "\n")).alias("line_md5"),
    )


@query(
    "p20_renumber_docs",
    """with parts as (select doc_id, unnest(ps) as p, generate_subscripts(ps, 1) - 1 as i from
         (select doc_id, string_split(text, chr(10)) as ps from documents))
       select doc_id, md5(string_agg('[' || i || ']' || p, chr(10) order by i)) as text_md5 from
         (select doc_id, i, replace(p, '## ', '[' || i || ']') as p from parts) group by doc_id""",
)
def p20(spark: SparkSession, sf: str) -> DataFrame:
    context = F.concat(F.lit("## "), F.replace("text", F.lit("\n"), F.lit(fixed.DOCUMENT_BREAK + "## ")))
    return docs(spark, sf).select("doc_id", F.md5(P.renumber_docs(context)).alias("text_md5"))


def _sql_template(template: str, **values: str) -> str:
    parts, rest = [], template
    while rest:
        places = sorted((rest.find("{" + n + "}"), n) for n in values if "{" + n + "}" in rest)
        if not places:
            parts.append(quoted(rest))
            break
        at, name = places[0]
        if at:
            parts.append(quoted(rest[:at]))
        parts.append(values[name])
        rest = rest[at + len(name) + 2 :]
    return " || ".join(parts)


VALUES = {"instruction": "question", "input": "answer", "paragraph": "pred", "context": "pred", "question": "question"}


@query(
    "p21_render_prompt",
    I.with_views(
        "turns",
        then=" union all ".join(
            f"select id, '{n}' as template, md5({_sql_template(t, **VALUES)}) as prompt_md5 from turns"
            for n, t in fixed.PROMPT_TEMPLATES.items()
        )
        + f" union all select id, 'with_task', md5({quoted('### Instruction:' + chr(10) + fixed.TASK_INSTRUCTIONS['fever'] + chr(10))} || question || {quoted(chr(10) * 2 + '### Response:' + chr(10))}) from turns",
    ),
)
def p21(spark: SparkSession, sf: str) -> DataFrame:
    turns = I.turns(spark, sf)
    values = {name: F.col(column) for name, column in VALUES.items()}
    named = [F.struct(F.lit(n).alias("template"), F.md5(P.render_prompt(n, **values)).alias("prompt_md5")) for n in fixed.PROMPT_TEMPLATES]
    tasked = P.render_prompt("prompt_no_input", task="fever", instruction=F.col("question"))
    named.append(F.struct(F.lit("with_task").alias("template"), F.md5(tasked).alias("prompt_md5")))
    return turns.select("id", F.inline(F.array(*named)))


def _messages_sql() -> str:
    parts = []
    for strict in (False, True):
        system = fixed.SYSTEM_TEXTS["quote_strict" if strict else "quote_relaxed"].replace("{task_type}", "statement")
        user = _sql_template(fixed.QUOTE_REQUEST.replace("{task_type}", "Statement"), question="question", context="pred")
        for role, text in (("system", quoted(system)), ("user", user)):
            parts.append(f"select id, {str(strict).lower()} as strict, '{role}' as role, md5({text}) as content_md5 from turns")
    return I.with_views("turns", then=" union all ".join(parts))


@query("p22_to_messages", _messages_sql())
def p22(spark: SparkSession, sf: str) -> DataFrame:
    turns = I.turns(spark, sf)

    def chat(strict: bool) -> DataFrame:
        messages = P.quote_messages(F.col("question"), F.col("pred"), "statement", strict)
        return turns.select("id", F.lit(strict).alias("strict"), F.inline(messages))

    both = chat(False).unionByName(chat(True))
    return both.select("id", "strict", "role", F.md5("content").alias("content_md5"))


@query("p23_map_batches", "select doc_id, length(text)::bigint as n from documents")
def p23(spark: SparkSession, sf: str) -> DataFrame:
    rows = docs(spark, sf).select("doc_id", "text")
    return P.map_batches(rows, "text", lambda texts: texts.str.len(), "n", T.LongType(), 64).select("doc_id", "n")
