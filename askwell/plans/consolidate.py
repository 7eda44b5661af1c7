"""Queries for teacher consolidation."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import consolidate as V
from . import inputs as I
from .registry import query
from .text import PARSED, SQL_CUT

CTX = """, ctx as (select doc_id as qid, line_no as ctx_pos, title || '-' || line_no as title, text from passages)"""
GATE = f""", statuses as (select a.qid, a.teacher_ord, case when p.qid is not null then 'parsed'
      when {SQL_CUT} = '' then 'empty' else 'malformed' end as status
    from (select *, string_split(answer, chr(10) || chr(10)) as blocks from teacher_answers) a left join (select distinct qid, teacher_ord from parsed) p using (qid, teacher_ord)),
  seen as (select *, count(*) filter (status = 'empty') over so_far as empties,
      5 - count(*) filter (status = 'malformed') over so_far as n from statuses
    window so_far as (partition by qid order by teacher_ord)),
  gate as (select qid, coalesce(arg_min(case when status = 'empty' then 'empty' else 'dropped' end, teacher_ord) filter (
      (status = 'empty' and empties >= (n + 1) // 2) or (status = 'malformed' and n <= 2)), 'open') as outcome,
    ((min(n) + 1) // 2)::int as majority from seen group by qid)"""
MATCHED = """, matched as (select q.qid, c.ctx_pos, q.teacher_ord, q.quote_ord, split_part(q.section, '.', 1)::int as section, q.quote, c.text
  from parsed q join ctx c on q.qid = c.qid and contains(c.title, q.title)
  where length(q.title) >= 3 and length(q.quote) >= 3 and q.section <> '*')"""
VERBATIM = """, spans as (select qid, ctx_pos, teacher_ord, instr(text, quote) - 1 as s, instr(text, quote) - 1 + length(quote) as e, section, quote_ord
  from matched where contains(text, quote) and regexp_matches(quote, '[\\p{L}\\p{M}\\p{N}\\p{Pc}]'))"""
# Equal characters on one diagonal without a gap are a common substring; the longest one counts, the earliest of these.
NEAREST = """, searched as materialized (select text, quote, row_number() over () as k from (select distinct text, quote from matched where not contains(text, quote))),
  text_chars as (select k, unnest(string_split(text, '')) as c, generate_subscripts(string_split(text, ''), 1) as i from searched),
  quote_chars as (select k, unnest(string_split(quote, '')) as c, generate_subscripts(string_split(quote, ''), 1) as j from searched),
  cells as (select k, i - j as d, i, i - row_number() over (partition by k, i - j order by i) as run from text_chars join quote_chars using (k, c)),
  runs as (select k, min(i) - 1 as s, count(*) as n from cells group by k, d, run),
  nearest as (select k, arg_min(s, (-n, s)) as s, max(n) as n from runs group by k),
  spans as (select qid, ctx_pos, teacher_ord, s, s + n as e, section, quote_ord from (
    select m.*, case when contains(m.text, m.quote) then instr(m.text, m.quote) - 1 else nearest.s end as s,
           case when contains(m.text, m.quote) then length(m.quote) else nearest.n end as n
    from matched m left join searched x on x.text = m.text and x.quote = m.quote left join nearest using (k)) where n > 0)"""
VOTES = """, marks as (select distinct qid, ctx_pos, s as mark from spans union select distinct qid, ctx_pos, e from spans),
  pieces as (select qid, ctx_pos, mark as s, lead(mark) over (partition by qid, ctx_pos order by mark) as e from marks),
  votes as (select p.qid, p.ctx_pos, p.s, p.e, count(distinct t.teacher_ord) as votes from pieces p
            join spans t on t.qid = p.qid and t.ctx_pos = p.ctx_pos and t.s <= p.s and p.s < t.e where p.e is not null group by all)"""
SPAN = f""", cuts as (select v.qid, v.ctx_pos, min(s) as s, max(e) as e from votes v join gate g on v.qid = g.qid
                     where outcome = 'open' and v.votes >= majority group by all),
  kept as (select * from (select c.qid, c.ctx_pos, c.title, {I.sql_strip("substr(c.text, s + 1, e - s)")} as quote
           from cuts join ctx c on c.qid = cuts.qid and c.ctx_pos = cuts.ctx_pos) where length(quote) >= 15)"""
PEAK = """, peak as (select qid, ctx_pos, arg_min(s, (-votes * 1000000000 + s)) as top_at from votes group by all),
  voters as (select t.qid, t.ctx_pos, t.teacher_ord, arg_max(section, quote_ord) as section from spans t
             join peak p on t.qid = p.qid and t.ctx_pos = p.ctx_pos and s <= top_at and top_at < e group by all)"""
PAIRS = """, members as (select v.* from voters v join kept k on v.qid = k.qid and v.ctx_pos = k.ctx_pos),
  pairs as (select a.qid, a.ctx_pos as a, b.ctx_pos as b, count(*) as votes, min(a.teacher_ord) as first
            from members a join members b on a.qid = b.qid and a.teacher_ord = b.teacher_ord and a.section = b.section and a.ctx_pos <> b.ctx_pos
            group by all)"""
SECTIONS = """, ordered as (select qid, ctx_pos, row_number() over (partition by qid order by ctx_pos) as step from (select distinct qid, ctx_pos from members)),
  mates as (select o.qid, o.step, o.ctx_pos, coalesce(list(p.b order by p.first, p.b) filter (p.b is not null), []) as mates
            from ordered o join gate g on g.qid = o.qid left join pairs p on o.qid = p.qid and o.ctx_pos = p.a and p.votes >= g.majority group by all),
  walk as (select qid, 0::bigint as step, 1 as major, []::bigint[] as done, []::varchar[] as labels from (select distinct qid from ordered)
    union all
    select qid, step, case when seen then major else major + 1 end,
      case when seen then done else list_concat(done, [ctx_pos], fresh) end,
      case when seen then labels else list_concat(labels, [major || '.1.'], list_transform(generate_series(2, len(fresh) + 1), lambda i: major || '.' || i || '.')) end
    from (select w.qid, m.step, w.major, w.done, w.labels, m.ctx_pos, list_contains(w.done, m.ctx_pos) as seen,
                 list_filter(m.mates, lambda x: not list_contains(w.done, x)) as fresh
          from walk w join mates m on m.qid = w.qid and m.step = w.step + 1)),
  finished as (select qid, arg_max(done, step) as done, arg_max(labels, step) as labels from walk group by qid),
  sections as (select qid, unnest(done) as ctx_pos, unnest(labels) as section from finished)"""
EXEMPLARS = """, rendered as (select s.qid, string_agg(s.section || ' ' || k.title || chr(10) || k.quote, chr(10) order by s.ctx_pos) as exemplar
             from sections s join kept k on k.qid = s.qid and k.ctx_pos = s.ctx_pos group by s.qid)"""


def statement(*parts: str, select: str, recursive: bool = False) -> str:
    sql = I.with_views("passages", "teacher_answers", then=PARSED + CTX + GATE + MATCHED + "".join(parts) + select)
    return sql.replace("with ", "with recursive ", 1) if recursive else sql


class Steps:
    """The steps of one consolidation, each computed from the ones before."""

    def __init__(self, spark: SparkSession, sf: str) -> None:
        self.contexts = I.teacher_contexts(spark, sf)
        self.parsed = V.parse_answers(I.teacher_answers(spark, sf))
        self.lines = I.context_lines(I.passages(spark, sf))

    @cached_property
    def questions(self) -> DataFrame:
        """The gate and the spans of every question; answers are quoted, parsed and matched in one pass."""
        return I.written(V.question_spans(self.parsed, self.contexts), "spans")

    def gate(self) -> DataFrame:
        return self.questions.select("qid", "outcome", "majority")

    def matched(self) -> DataFrame:
        return V.match_quotes(self.parsed, self.contexts)

    def spans(self) -> DataFrame:
        return V.quote_spans(self.matched(), "verbatim")

    def votes(self) -> tuple[DataFrame, DataFrame]:
        spans = self.questions.select("qid", F.inline("spans"))
        return V.vote_counts(spans), spans

    def kept(self, votes: DataFrame) -> DataFrame:
        return V.majority_span(votes, self.gate(), self.lines)

    def grouped(self) -> tuple[DataFrame, DataFrame]:
        votes, spans = self.votes()
        kept = self.kept(votes)
        voters = V.context_votes(kept, V.peak_voters(votes, spans))
        return voters.join(self.gate().select("qid", "majority"), "qid"), kept


@query("v01_teacher_gate", statement(select=" select qid, outcome, majority from gate"))
def v01(spark: SparkSession, sf: str) -> DataFrame:
    return V.teacher_gate(V.parse_answers(I.teacher_answers(spark, sf)))


@query("v02_match_quotes", statement(select=" select qid, ctx_pos, teacher_ord, quote_ord, section, md5(quote) as quote_md5 from matched"))
def v02(spark: SparkSession, sf: str) -> DataFrame:
    rows = Steps(spark, sf).matched()
    return rows.select("qid", "ctx_pos", "teacher_ord", "quote_ord", "section", F.md5("quote").alias("quote_md5"))


@query("v03_quote_span", statement(VERBATIM, select=' select qid, ctx_pos, teacher_ord, quote_ord, section, s as "start", e as "end" from spans'))
def v03(spark: SparkSession, sf: str) -> DataFrame:
    return Steps(spark, sf).spans()


@query("v03_quote_span_near", statement(NEAREST, select=' select qid, ctx_pos, teacher_ord, quote_ord, section, s as "start", e as "end" from spans'))
def v03_near(spark: SparkSession, sf: str) -> DataFrame:
    """Every quote in every context whose title contains its title, verbatim or not."""
    return V.quote_spans(Steps(spark, sf).matched())


@query("v03_quote_span_lcs")
def v03_lcs(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes whose first blank was dropped, so that no quote of two words is verbatim."""
    rows = Steps(spark, sf).matched()
    return V.quote_spans(rows.withColumn("quote", F.regexp_replace("quote", r"\A(\S+) ", "$1")))


@query(
    "v04_vote_counts",
    statement(VERBATIM, VOTES, select=" select qid, ctx_pos, sum((e - s) * votes)::bigint as cast_votes, min(s) as first, max(e) as last, max(votes) as top from votes group by all"),
)
def v04(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = Steps(spark, sf).votes()
    return rows.groupBy("qid", "ctx_pos").agg(
        F.sum((F.col("end") - F.col("start")) * F.col("votes")).alias("cast_votes"),
        F.min("start").alias("first"),
        F.max("end").alias("last"),
        F.max("votes").alias("top"),
    )


@query("v05_majority_span", statement(VERBATIM, VOTES, SPAN, select=" select qid, ctx_pos, title, md5(quote) as quote_md5 from kept"))
def v05(spark: SparkSession, sf: str) -> DataFrame:
    steps = Steps(spark, sf)
    rows = steps.kept(steps.votes()[0])
    return rows.select("qid", "ctx_pos", "title", F.md5("quote").alias("quote_md5"))


@query("v06_peak_voters", statement(VERBATIM, VOTES, PEAK, select=" select qid, ctx_pos, teacher_ord, section from voters"))
def v06(spark: SparkSession, sf: str) -> DataFrame:
    return V.peak_voters(*Steps(spark, sf).votes())


@query("v07_section_pairs", statement(VERBATIM, VOTES, SPAN, PEAK, PAIRS, select=" select qid, a, b, votes::int as votes from pairs where votes >= 3"))
def v07(spark: SparkSession, sf: str) -> DataFrame:
    return V.section_pairs(Steps(spark, sf).grouped()[0], 3)


@query("v08_assign_sections", statement(VERBATIM, VOTES, SPAN, PEAK, PAIRS, SECTIONS, select=" select qid, ctx_pos, section from sections", recursive=True))
def v08(spark: SparkSession, sf: str) -> DataFrame:
    return V.assign_sections(Steps(spark, sf).grouped()[0])


@query(
    "v09_render_exemplar",
    statement(VERBATIM, VOTES, SPAN, PEAK, PAIRS, SECTIONS, EXEMPLARS, select=" select qid, md5(exemplar) as exemplar_md5 from rendered", recursive=True),
)
def v09(spark: SparkSession, sf: str) -> DataFrame:
    grouped, kept = Steps(spark, sf).grouped()
    return V.render_exemplar(kept, V.assign_sections(grouped)).select("qid", F.md5("exemplar").alias("exemplar_md5"))


@query(
    "v10_consolidate",
    statement(
        VERBATIM, VOTES, SPAN, PEAK, PAIRS, SECTIONS, EXEMPLARS,
        select=" select g.qid, md5(coalesce(exemplar, '')) as exemplar_md5 from gate g left join rendered r on r.qid = g.qid where outcome <> 'dropped'",
        recursive=True,
    ),
)
def v10(spark: SparkSession, sf: str) -> DataFrame:
    out = V.consolidate(I.teacher_contexts(spark, sf), I.teacher_answers(spark, sf), mode="verbatim")
    return out.select("qid", F.md5("exemplar").alias("exemplar_md5"))


@query(
    "v10_consolidate_wide",
    statement(
        VERBATIM, VOTES, SPAN, PEAK, PAIRS, SECTIONS, EXEMPLARS,
        select=""" select g.qid, d.lang, md5(coalesce(exemplar, '')) as exemplar_md5 from gate g join documents d on d.doc_id = g.qid
          left join rendered r on r.qid = g.qid where outcome <> 'dropped'""",
        recursive=True,
    ),
)
def v10_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Records as they are stored: contexts nested, one column per teacher, the record's own columns kept."""
    lines = I.teacher_contexts(spark, sf).groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("ctx_pos", "title", "text"))).alias("__lines")
    )
    nested = lines.select("qid", F.transform("__lines", lambda x: F.struct(x["title"].alias("title"), x["text"].alias("text"))).alias("ctxs"))
    names = [f"teacher{i}" for i in range(I.TEACHERS)]
    wide = I.teacher_answers(spark, sf).groupBy("qid").pivot("teacher", names).agg(F.first("answer"))
    langs = I.table(spark, sf, "documents").select(F.col("doc_id").alias("qid"), "lang")
    records = nested.join(wide, "qid").join(langs, "qid")
    out = V.consolidate_records(records, names, mode="verbatim")
    return out.select("qid", "lang", F.md5("exemplar").alias("exemplar_md5"))


@query(
    "v10_consolidate_lcs",
    statement(
        NEAREST, VOTES, SPAN, PEAK, PAIRS, SECTIONS, EXEMPLARS,
        select=" select g.qid, md5(coalesce(exemplar, '')) as exemplar_md5 from gate g left join rendered r on r.qid = g.qid where outcome <> 'dropped'",
        recursive=True,
    ),
)
def v10_lcs(spark: SparkSession, sf: str) -> DataFrame:
    out = V.consolidate(I.teacher_contexts(spark, sf), I.teacher_answers(spark, sf))
    return out.select("qid", F.md5("exemplar").alias("exemplar_md5"))
