"""Queries for sources, sinks and sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.match import answer_hit
from ..operators import rows as R
from ..operators.answers import hit_rate
from ..sources import records as S
from . import inputs as I
from .registry import query


@query("s01_read_jsonl", "select doc_id, md5(text) as text_md5, lang, source from documents")
def s01(spark: SparkSession, sf: str) -> DataFrame:
    path = I.scratch(spark, "s01")
    S.write_records(I.table(spark, sf, "documents"), path)
    schema = "doc_id long, text string, lang string, source string"
    return S.read_records(spark, path, schema).select("doc_id", F.md5("text").alias("text_md5"), "lang", "source")


@query("s02_read_json_array", "select doc_id, md5(text) as text_md5, lang from documents")
def s02(spark: SparkSession, sf: str) -> DataFrame:
    """One array per file, a few hundred records in each."""
    path = I.scratch(spark, "s02") + ".json"
    entry = F.struct("doc_id", "text", "lang")
    arrays = I.table(spark, sf, "documents").groupBy(F.expr("doc_id div 400").alias("part")).agg(F.to_json(F.collect_list(entry)).alias("value"))
    arrays.repartition("part").write.partitionBy("part").text(path)
    back = S.read_records(spark, path, "doc_id long, text string, lang string")
    return back.select("doc_id", F.md5("text").alias("text_md5"), "lang")


@query("s03_read_parquet", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders")
def s03(spark: SparkSession, sf: str) -> DataFrame:
    return S.read_records(spark, f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("s04_read_passages", I.with_views("passages", then="select id::varchar as id, title, md5(text) as text_md5 from passages"))
def s04(spark: SparkSession, sf: str) -> DataFrame:
    path = I.scratch(spark, "s04")
    out = I.passages(spark, sf).select(F.col("id").cast("string").alias("id"), "text", "title")
    S.write_passages(out, path)
    return S.read_passages(spark, path).select("id", "title", F.md5("text").alias("text_md5"))


@query("s05_read_tsv_header", "select page_id, url, md5(html) as html_md5 from pages")
def s05(spark: SparkSession, sf: str) -> DataFrame:
    path = I.scratch(spark, "s05")
    S.write_tsv(I.table(spark, sf, "pages"), path)
    back = S.read_tsv_header(spark, path, "page_id long, url string, html string")
    return back.select("page_id", "url", F.md5("html").alias("html_md5"))


@query("s06_read_embeddings", "select vec_id, len(embedding)::int as dim, round(list_sum(embedding::double[]), 5) as total from embeddings")
def s06(spark: SparkSession, sf: str) -> DataFrame:
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return S.read_embeddings(spark, f"{sf}/embeddings*.parquet").select(
        "vec_id", F.size("embedding").alias("dim"), F.round(total, 5).alias("total")
    )


@query("s07_read_token_shards", I.with_views("tokens", then="select len(tokens)::int as n, md5(array_to_string(tokens, ',')) as ids_md5 from tokens"))
def s07(spark: SparkSession, sf: str) -> DataFrame:
    path = I.scratch(spark, "s07")
    I.tokens(spark, sf).select("tokens").write.parquet(path)
    shards = S.read_token_shards(spark, path, "full")
    return shards.select(F.size("tokens").alias("n"), F.md5(I.joined("tokens")).alias("ids_md5"))


@query(
    "s08_read_contrastive",
    I.with_views(
        "pools",
        "example_ids",
        then="select e.question, count(p.id) as lines, count(distinct e.id) as examples from example_ids e left join pools p on p.id = e.id group by e.question",
    ),
)
def s08(spark: SparkSession, sf: str) -> DataFrame:
    path = I.scratch(spark, "s08")
    S.write_records(I.examples(spark, sf).drop("id"), path)
    parts = ("positive_ctxs", "negative_ctxs", "hard_negative_ctxs")
    lines = sum((F.size(p) for p in parts), F.lit(0))
    rows = S.read_contrastive(spark, [path])
    return rows.groupBy("question").agg(F.sum(lines).alias("lines"), F.count("*").alias("examples"))


@query(
    "s08_read_contrastive_maxload",
    I.with_views(
        "pools",
        "example_ids",
        then="""+ loaded as (select id, question from example_ids order by id limit 400)
        select e.question, count(p.id) as lines, count(distinct e.id) as examples from loaded e left join pools p on p.id = e.id group by e.question""",
    ),
)
def s08_maxload(spark: SparkSession, sf: str) -> DataFrame:
    """The first examples of two paths of several files, in file order."""
    ordered = I.written(I.examples(spark, sf).withColumn("n", F.col("id")), "examples")
    middle = ordered.agg(F.expr("percentile_disc(0.2) within group (order by n)")).first()[0]
    paths = [I.scratch(spark, "s08a"), I.scratch(spark, "s08b")]
    for path, part in zip(paths, (ordered.filter(F.col("n") < middle), ordered.filter(F.col("n") >= middle))):
        S.write_records(part.orderBy("n").drop("id", "n"), path)
    parts = ("positive_ctxs", "negative_ctxs", "hard_negative_ctxs")
    lines = sum((F.size(p) for p in parts), F.lit(0))
    rows = S.read_contrastive(spark, paths, maxload=400)
    return rows.groupBy("question").agg(F.sum(lines).alias("lines"), F.count("*").alias("examples"))


@query(
    "s09_read_ir_dataset",
    """select source as query_id, count(*) as docs, sum(length(text))::bigint as chars, count(quality) as judged
       from documents left join labels using (doc_id) group by source""",
)
def s09(spark: SparkSession, sf: str) -> DataFrame:
    path = I.scratch(spark, "s09")
    docs = I.table(spark, sf, "documents")
    ids = F.col("doc_id").cast("string")
    S.write_records(docs.select(ids.alias("_id"), F.col("source").alias("title"), "text"), f"{path}/corpus.jsonl")
    S.write_records(docs.select(F.col("source").alias("_id"), F.col("source").alias("text")).distinct(), f"{path}/queries.jsonl")
    judged = docs.join(I.table(spark, sf, "labels"), "doc_id").select(
        F.col("source").alias("query_id"), ids.alias("doc_id"), F.col("quality").alias("rel")
    )
    S.write_tsv(judged, f"{path}/qrels/test.tsv")
    corpus, queries, qrels = S.read_ir_dataset(spark, path)
    per_title = corpus.groupBy(F.col("title").alias("query_id")).agg(
        F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars")
    )
    per_query = qrels.groupBy("query_id").agg(F.count("*").alias("judged"))
    return (
        queries.select("query_id")
        .join(per_title, "query_id")
        .join(per_query, "query_id", "left")
        .select("query_id", "docs", "chars", F.coalesce("judged", F.lit(0)).alias("judged"))
    )


@query("s10_write_records", "select conv_id, turn, role, md5(text) as text_md5 from conversations union all select conv_id, turn, role, md5(text) from conversations")
def s10(spark: SparkSession, sf: str) -> DataFrame:
    path = I.scratch(spark, "s10")
    said = I.table(spark, sf, "conversations")
    S.write_records(said, path)
    S.write_records(said, path, mode="append")
    back = S.read_records(spark, path, "conv_id long, turn long, role string, text string")
    return back.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query(
    "s11_write_scored",
    I.with_views(
        "turns",
        then=f"""select count(*) as n, 'turns_acc=' || printf('%.3f', avg(case when len(list_filter(answers, lambda a:
             contains({I.sql_answer("pred")}, lower(a)))) > 0 then 1 else 0 end)) as name from turns""",
    ),
)
def s11(spark: SparkSession, sf: str) -> DataFrame:
    turns = I.turns(spark, sf)
    scored = turns.withColumn("hit", answer_hit(turns, F.col("pred")))
    path = S.write_scored(scored, scored.agg(hit_rate(F.col("hit")).alias("acc")), I.scratch(spark, "s11"), "turns")
    return spark.read.schema("id long").json(path).agg(F.count("id").alias("n")).withColumn("name", F.lit(path.rsplit("/", 1)[1]))


#: Where the evaluation files of a catalogue lie.
FILES = {"eval": {task: f"eval/{task}.jsonl" for task in ("arc_c", "asqa", "eli5", "hotpotqa_dev", "musique_dev", "popqa", "triviaqa")}}


def _catalog_sql() -> str:
    def text(value: str | None) -> str:
        return "null" if value is None else "'" + value.replace("'", "''") + "'"

    rows = ", ".join(f"('{t}', '{p}', {text(fixed.TASK_INSTRUCTIONS.get(t))})" for t, p in FILES["eval"].items())
    names = ", ".join(f"'{t}'" for t in [*FILES["eval"], "fever"])
    return f"""with catalog(task, path, instruction) as (values {rows}),
        asked as (select event_id, [{names}][(user_id % {len(FILES['eval']) + 1} + 1)::int] as task from events)
        select event_id, task, path, 'question' as kind, instruction from asked left join catalog using (task)"""


@query("s12_dataset_catalog", _catalog_sql())
def s12(spark: SparkSession, sf: str) -> DataFrame:
    names = [*FILES["eval"], "fever"]
    task = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("user_id") % len(names) + 1).cast("int"))
    asked = I.table(spark, sf, "events").select("event_id", task.alias("task"))
    return S.resolve_tasks(asked, S.dataset_catalog(spark, FILES), "eval").select("event_id", "task", "path", "kind", "instruction")


NUMBERED = "select event_id, row_number() over (order by event_id) - 1 as p, count(*) over () as n from events"


@query("s13_shard_contiguous", f"select event_id, least(p // (n // 7), 6)::bigint as shard from ({NUMBERED})")
def s13(spark: SparkSession, sf: str) -> DataFrame:
    return R.shard_contiguous(I.table(spark, sf, "events").select("event_id"), 7, "event_id")


@query("s14_shard_even", "select event_id, (ntile(7) over (order by event_id) - 1)::bigint as shard from events")
def s14(spark: SparkSession, sf: str) -> DataFrame:
    return R.shard_even(I.table(spark, sf, "events").select("event_id"), 7, "event_id")


@query("s15_shard_stride", f"select event_id, ((p + 1) % 7)::bigint as shard from ({NUMBERED})")
def s15(spark: SparkSession, sf: str) -> DataFrame:
    return R.shard_stride(I.table(spark, sf, "events").select("event_id"), 7, "event_id")


@query("s16_slice_rows", f"select o_orderkey, o_totalprice from (select *, row_number() over (order by o_orderkey) - 1 as p, count(*) over () as n from orders) where p >= 100 and p < n - 50")
def s16(spark: SparkSession, sf: str) -> DataFrame:
    orders = I.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return R.slice_rows(orders, "o_orderkey", 100, -50)


@query("s17_resume_remaining", "select doc_id, lang from documents where doc_id not in (select doc_id from labels)")
def s17(spark: SparkSession, sf: str) -> DataFrame:
    return R.resume_remaining(I.table(spark, sf, "documents").select("doc_id", "lang"), I.table(spark, sf, "labels"), ["doc_id"])


@query(
    "s18_restore_order",
    """select c.conv_id, c.turn, c.role, p.pos from conversations c
       join (select role, max(conv_id * 100 + turn) as pos from conversations group by role) p using (role)""",
)
def s18(spark: SparkSession, sf: str) -> DataFrame:
    said = I.table(spark, sf, "conversations").select("conv_id", "turn", "role")
    original = said.withColumn("pos", F.col("conv_id") * 100 + F.col("turn"))
    return R.restore_order(said, original, "role", "pos")


@query(
    "s19_add_teacher_columns",
    I.with_views(
        "teacher_answers",
        then="""select d.doc_id as qid, """
        + ", ".join(f"md5(max(case when teacher_ord = {t} then answer end)) as teacher{t}" for t in range(5))
        + " from documents d left join teacher_answers a on d.doc_id = a.qid group by d.doc_id",
    ),
)
def s19(spark: SparkSession, sf: str) -> DataFrame:
    questions = I.table(spark, sf, "documents").select(F.col("doc_id").alias("qid"))
    names = [f"teacher{t}" for t in range(5)]
    wide = R.add_teacher_columns(questions, I.teacher_answers(spark, sf), names)
    return wide.select("qid", *[F.md5(n).alias(n) for n in names])


@query(
    "s20_run_grid",
    """with cells as (select distinct source as task, m.model from documents cross join (select unnest(['en', 'de', 'fr', 'xx']) as model) m),
       results as (select source as task, lang as model, round(avg(n_chars), 6) as score from documents group by all)
       select task, model, score from cells left join results using (task, model)""",
)
def s20(spark: SparkSession, sf: str) -> DataFrame:
    docs = I.table(spark, sf, "documents").select(F.col("source").alias("task"), F.col("lang").alias("model"), "n_chars")
    results = docs.groupBy("task", "model").agg(F.round(F.avg("n_chars"), 6).alias("score"))
    return R.run_grid(docs, ["en", "de", "fr", "xx"], results)
