"""Queries for the scalar text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from ..functions.sections import clean_sections
from . import inputs as I
from .registry import query


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_normalize_text(x: str) -> str:
    source = (
        fixed.BLANK_CHARS + fixed.HYPHEN_CHARS + fixed.DOUBLE_QUOTE_CHARS + fixed.SINGLE_QUOTE_CHARS + fixed.SLASH_CHARS
    )
    target = (
        " " * len(fixed.BLANK_CHARS)
        + "-" * len(fixed.HYPHEN_CHARS)
        + '"' * len(fixed.DOUBLE_QUOTE_CHARS)
        + "'" * len(fixed.SINGLE_QUOTE_CHARS)
        + "/" * len(fixed.SLASH_CHARS)
    )
    out = f"translate({x}, {quoted(source + fixed.CONTROL_CHARS + fixed.SOFT_HYPHEN)}, {quoted(target)})"
    for symbol, expansion in fixed.EXPANSIONS:
        out = f"replace({out}, {quoted(symbol)}, {quoted(expansion)})"
    return out


# Marks that give the normaliser something to do in every document.
MARKED = "‘“—″⁄…­\u0007\u000b . . . "


@query(
    "t01_normalize_text",
    f"select doc_id, md5({sql_normalize_text(f'text || {quoted(MARKED)} || text')}) as text_md5 from documents",
)
def t01(spark: SparkSession, sf: str) -> DataFrame:
    marked = F.concat("text", F.lit(MARKED), "text")
    return I.table(spark, sf, "documents").select("doc_id", F.md5(X.normalize_text(marked)).alias("text_md5"))


@query("t02_normalize_answer", f"select doc_id, md5({I.sql_answer('text')}) as text_md5 from documents")
def t02(spark: SparkSession, sf: str) -> DataFrame:
    return I.table(spark, sf, "documents").select("doc_id", F.md5(X.normalize_answer(F.col("text"))).alias("text_md5"))


SPACED = r"regexp_replace({}, '([\p{{L}}\p{{N}}_])([.!?])([\p{{L}}\p{{N}}_])', '\1\2 \3', 'g')"
TIGHT = "regexp_replace(text, '([.!?]) ', '\\1', 'g')"


@query("t03_fix_spacing", f"select doc_id, md5({SPACED.format(SPACED.format(TIGHT))}) as text_md5 from documents")
def t03(spark: SparkSession, sf: str) -> DataFrame:
    tight = F.regexp_replace("text", "([.!?]) ", "$1")
    return I.table(spark, sf, "documents").select("doc_id", F.md5(X.fix_spacing(tight)).alias("text_md5"))


def _sql_control(x: str) -> str:
    out = x
    for token in [*fixed.CONTROL_TOKENS, fixed.END_TOKEN]:
        out = f"replace({out}, {quoted(token)}, '')"
    return f"regexp_replace({out}, '^ ', '')"


# Control tokens placed between words, all of them in turn.
TOKEN_AT = [*fixed.CONTROL_TOKENS, fixed.END_TOKEN]
SQL_TOKEN_AT = "[" + ", ".join(quoted(t) for t in TOKEN_AT) + f"][(conv_id % {len(TOKEN_AT)} + 1)::int]"
SQL_CONTROLLED = f"{SQL_TOKEN_AT} || replace(text, ' ', ' ' || {SQL_TOKEN_AT} || ' ')"


def controlled() -> F.Column:
    token = F.element_at(F.array(*[F.lit(t) for t in TOKEN_AT]), (F.col("conv_id") % len(TOKEN_AT) + 1).cast("int"))
    return F.concat(token, F.replace("text", F.lit(" "), F.concat(F.lit(" "), token, F.lit(" "))))


@query("t04_strip_control_tokens", f"select conv_id, turn, md5({_sql_control(SQL_CONTROLLED)}) as text_md5 from conversations")
def t04(spark: SparkSession, sf: str) -> DataFrame:
    said = I.table(spark, sf, "conversations")
    return said.select("conv_id", "turn", F.md5(X.strip_control_tokens(controlled())).alias("text_md5"))


@query(
    "t05_qa_tokens",
    r"""select doc_id, len(t)::int as n_tokens, len(list_distinct(t))::int as n_distinct from (
        select doc_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]') as t from documents)""",
)
def t05(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.table(spark, sf, "documents").select("doc_id", X.qa_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


SQL_TAGGED = """
  with tagged as (
    select c_custkey, c_name || ' <' || c_mktsegment || '> ' || n_name || ' <NATION> ' || r_name || ' <REGION> ' || n_name || ' <LAND>' as s
    from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
  pairs as (
    select c_custkey, unnest(regexp_extract_all(s, '([^<>]+?)\\s<([^>]+)>', 1)) as name,
           unnest(regexp_extract_all(s, '([^<>]+?)\\s<([^>]+)>', 2)) as tag,
           generate_subscripts(regexp_extract_all(s, '([^<>]+?)\\s<([^>]+)>', 1), 1) as i from tagged)
  select c_custkey, trim(name) as name, arg_max(tag, i) as tag from pairs group by c_custkey, trim(name)"""


@query("t06_entity_tags", SQL_TAGGED)
def t06(spark: SparkSession, sf: str) -> DataFrame:
    n, r = I.table(spark, sf, "nation"), I.table(spark, sf, "region")
    sentence = F.format_string("%s <%s> %s <NATION> %s <REGION> %s <LAND>", "c_name", "c_mktsegment", "n_name", "r_name", "n_name")
    rows = (
        I.table(spark, sf, "customer")
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", X.entity_tags(sentence).alias("tags"))
    )
    return rows.select("c_custkey", F.explode("tags").alias("name", "tag"))


@query(
    "t07_closed_answer",
    """select o_orderkey,
              coalesce(list_filter(['URGENT', 'HIGH', 'LOW', 'O', 'F'], lambda c: contains(o_orderpriority || ' ' || o_orderstatus, c))[-1],
                       o_orderpriority || ' ' || o_orderstatus) as closed,
              case o_orderstatus when 'F' then 'REFUTES' when 'O' then 'true' else 'true' end as verdict
       from orders""",
)
def t07(spark: SparkSession, sf: str) -> DataFrame:
    output = F.concat_ws(" ", "o_orderpriority", "o_orderstatus")
    said = F.when(F.col("o_orderstatus") == "F", "REFUTES").when(F.col("o_orderstatus") == "O", "SUPPORTS").otherwise("TRUE")
    return I.table(spark, sf, "orders").select(
        "o_orderkey",
        X.closed_answer(output, "qa", F.lit("URGENT HIGH LOW O F")).alias("closed"),
        X.closed_answer(said, "fever").alias("verdict"),
    )


LETTERED = "text || ' The answer is (' || substr('ABCDEFG', (conv_id % 7 + 1)::int, 1) || '). ' || text"


@query(
    "t08_answer_letter",
    rf"select conv_id, turn, regexp_extract({LETTERED}, 'is[^\p{{L}}\p{{N}}_]+([A-E])[^\p{{L}}\p{{N}}_]+', 1) as letter from conversations",
)
def t08(spark: SparkSession, sf: str) -> DataFrame:
    letter = F.substring(F.lit("ABCDEFG"), (F.col("conv_id") % 7 + 1).cast("int"), F.lit(1))
    text = F.concat("text", F.lit(" The answer is ("), letter, F.lit("). "), "text")
    return I.table(spark, sf, "conversations").select("conv_id", "turn", X.answer_letter(text).alias("letter"))


SQL_SECTION = fixed.SECTION_PATTERN
SQL_CUT = (
    f"case when regexp_matches(blocks[-1], '^{SQL_SECTION}') then answer "
    "else array_to_string(blocks[:-2], chr(10) || chr(10)) end"
)
SQL_BODY = f"regexp_replace({I.sql_strip(SQL_CUT)}, '(</s>)+$', '')"


def sql_parsed(group: int) -> str:
    return f"unnest(regexp_extract_all(body, '{SQL_SECTION}', {group}))"


PARSED = f"""+ bodies as (select qid, teacher_ord, {SQL_BODY} as body from
          (select *, string_split(answer, chr(10) || chr(10)) as blocks from teacher_answers)),
        parsed as (select qid, teacher_ord, {sql_parsed(1)} as section, {sql_parsed(4)} as title, {sql_parsed(6)} as quote,
          generate_subscripts(regexp_extract_all(body, '{SQL_SECTION}', 1), 1) - 1 as quote_ord from bodies)"""


@query(
    "t09_parse_sections",
    I.with_views(
        "teacher_answers", then=PARSED + " select qid, teacher_ord, section, title, md5(quote) as quote_md5 from parsed"
    ),
)
def t09(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.teacher_answers(spark, sf).select("qid", "teacher_ord", F.inline(X.section_rows(F.col("answer"))))
    return rows.select("qid", "teacher_ord", "section", "title", F.md5("quote").alias("quote_md5"))


@query(
    "t10_clean_sections",
    I.with_views(
        "passages",
        then="""+ lines as (
          select doc_id, line_no, 1 + line_no // 3 as major, 'Doc ' || line_no as title, text as quote from passages),
        firsts as (
          select doc_id, quote, min(line_no) as first_no, max(line_no) as last_no, arg_min(major, line_no) as major,
                 arg_min(title, line_no) as title from lines group by doc_id, quote),
        kept as (
          select * from firsts f where length(f.quote) >= 3 and f.quote <> repeat(substr(f.quote, 1, 1), 3) and not exists (
            select 1 from firsts g where g.doc_id = f.doc_id and g.last_no > f.last_no and contains(g.quote, f.quote))),
        numbered as (
          select *, dense_rank() over (partition by doc_id order by major) as new_major,
                 row_number() over (partition by doc_id, major order by last_no desc) as new_minor from kept)
        select doc_id, md5(regexp_replace(string_agg(new_major || '.' || new_minor || '. ## ' || title || chr(10) || '"' ||
               replace(quote, '"', '''') || '"', chr(10) order by new_major, new_minor),
               'AAA|BBB|CCC|DDD|EEE|FFF|GGG|HHH|III|JJJ|KKK|LLL|MMM|NNN|OOO|PPP|QQQ|RRR|SSS|TTT|UUU|VVV|WWW|XXX|YYY|ZZZ',
               '(No Title)', 'g')) as clean_md5
        from numbered group by doc_id""",
    ),
)
def t10(spark: SparkSession, sf: str) -> DataFrame:
    number = F.floor(F.col("line_no") / 3).cast("int") + 1
    line = F.concat(number.cast("string"), F.lit(".1. Doc "), F.col("line_no").cast("string"), F.lit(": "), "text")
    answers = (
        I.passages(spark, sf)
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("line_no", line.alias("line")))).alias("lines"))
        .select("doc_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n").alias("answer"))
    )
    cleaned = clean_sections(answers, "answer", "clean", title_type="md", content_type="quote")
    return cleaned.select("doc_id", F.md5("clean").alias("clean_md5"))


@query(
    "t11_strip_suffix",
    """select conv_id, turn, md5(text) as plain_md5, md5(rtrim(text || 's</s></s>', '</s>')) as compat_md5 from
       (select conv_id, turn, regexp_replace(text, '(</s>)+$', '') as text from conversations)""",
)
def t11(spark: SparkSession, sf: str) -> DataFrame:
    ended = F.concat("text", F.lit("s</s></s>"))
    return I.table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.md5(X.strip_suffix(F.concat("text", F.lit("</s></s>")), fixed.END_TOKEN)).alias("plain_md5"),
        F.md5(X.strip_suffix(ended, fixed.END_TOKEN, strict_compat=True)).alias("compat_md5"),
    )


@query(
    "t12_unquote",
    I.with_views(
        "passages",
        then="""select id, case when id % 3 = 0 then trim(text, ' "''' || chr(10)) when id % 3 = 1 then '"' || text else text end as bare from passages""",
    ),
)
def t12(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("id") % 3
    quoted_text = F.when(kind == 0, F.concat(F.lit(" \"' "), "text", F.lit("'\" "))).when(
        kind == 1, F.concat(F.lit('"'), "text")
    )
    return I.passages(spark, sf).select("id", X.unquote(quoted_text.otherwise(F.col("text"))).alias("bare"))
