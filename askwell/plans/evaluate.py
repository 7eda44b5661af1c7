"""Queries for evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import match as M
from ..operators import answers as A
from ..operators import ranking as K
from ..operators import training_stats as S
from ..operators.traindata import with_batch
from . import inputs as I
from .registry import query

LISTED = f"len(list_filter(answers, lambda a: contains({I.sql_answer('pred')}, lower(a)))) > 0"
PRED_LETTER = "'The answer is (' || substr('ABCDE', (id % 5 + 1)::int, 1) || '). ' || pred"
SINGLE = f"contains({I.sql_answer('pred')}, {I.sql_answer('answer')})"


def pick(form: str, turns: DataFrame) -> DataFrame:
    return turns.drop(*[c for c in ("answers", "answerKey", "answer") if c != form])


def lettered() -> F.Column:
    letter = F.substring(F.lit("ABCDE"), (F.col("id") % 5 + 1).cast("int"), F.lit(1))
    return F.concat(F.lit("The answer is ("), letter, F.lit("). "), "pred")


@query(
    "e01_answer_hit",
    I.with_views(
        "turns",
        then=f"""select id, {LISTED} as listed, substr('ABCDE', (id % 5 + 1)::int, 1) = "answerKey" as letter, {SINGLE} as single from turns""",
    ),
)
def e01(spark: SparkSession, sf: str) -> DataFrame:
    turns = I.turns(spark, sf)
    return turns.select(
        "id",
        M.answer_hit(turns, F.col("pred")).alias("listed"),
        M.answer_hit(pick("answerKey", turns), lettered()).alias("letter"),
        M.answer_hit(pick("answer", turns), F.col("pred")).alias("single"),
    )


@query("e02_hit_rate", I.with_views("turns", then=f"select round(avg(({LISTED})::int), 6) as acc from turns"))
def e02(spark: SparkSession, sf: str) -> DataFrame:
    turns = I.turns(spark, sf)
    return turns.agg(F.round(A.hit_rate(M.answer_hit(turns, F.col("pred"))), 6).alias("acc"))


@query(
    "e03_contains_any",
    I.with_views("turns", then="select id, (len(list_filter(answers, lambda a: contains(lower(pred), lower(a)))) > 0)::int as hit from turns"),
)
def e03(spark: SparkSession, sf: str) -> DataFrame:
    return I.turns(spark, sf).select("id", M.contains_any(F.col("pred"), F.col("answers")).alias("hit"))


@query("e04_accuracy", "select o_orderpriority, round(100 * avg((o_orderstatus = 'F')::int), 6) as accuracy from orders group by 1")
def e04(spark: SparkSession, sf: str) -> DataFrame:
    score = A.accuracy(F.col("o_orderstatus"), F.array(F.lit("F"), F.lit("O")))
    return I.table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.round(score, 6).alias("accuracy"))


@query(
    "e05_exact_match",
    I.with_views(
        "turns",
        then=f"select id, ({I.sql_answer('question')} in ({I.sql_answer('answer')}, {I.sql_answer(chr(39)+'"the '+chr(39)+' || question || '+chr(39)+' !"'+chr(39))}))::int as both, ({I.sql_answer('question')} = {I.sql_answer('answer')})::int as one from turns",
    ),
)
def e05(spark: SparkSession, sf: str) -> DataFrame:
    question = F.col("question")
    return I.turns(spark, sf).select(
        "id",
        M.exact_match(question, F.array(F.col("answer"), F.concat(F.lit('"the '), question, F.lit(' !"')))).alias("both"),
        M.exact_match(question, F.array("answer")).alias("one"),
    )


def sql_bag(x: str) -> str:
    return I.sql_words(I.sql_answer(x))


F1 = I.with_views(
    "turns",
    then=f"""+ truths as (select id, unnest([question, answer || ' ' || question]) as gold, unnest([0, 1]) as truth, pred from turns),
    p as (select id, truth, item, count(*) as c from (select id, truth, unnest({sql_bag("pred")}) as item from truths) group by all),
    g as (select id, truth, item, count(*) as c from (select id, truth, unnest({sql_bag("gold")}) as item from truths) group by all),
    same as (select id, truth, sum(least(p.c, g.c)) as n from p join g using (id, truth, item) group by all),
    f as (select t.id, t.truth, coalesce(2.0 * n / (len({sql_bag("pred")}) + len({sql_bag("gold")})), 0)::double as f1 from truths t left join same using (id, truth))
    select id, round(max(f1), 6) as f1 from f group by id""",
)


@query("e06_token_f1", F1)
def e06(spark: SparkSession, sf: str) -> DataFrame:
    turns = I.turns(spark, sf).withColumn("truths", F.array(F.col("question"), F.concat_ws(" ", "answer", "question")))
    return A.token_f1(turns, "id", "pred", "truths").select("id", F.round("f1", 6).alias("f1"))


@query("e07_best_over_truths", I.with_views("turns", then="select id, greatest(length(answers[1]), length(answers[2]))::int as best from turns"))
def e07(spark: SparkSession, sf: str) -> DataFrame:
    return I.turns(spark, sf).select("id", M.best_over_truths(F.col("answers"), F.length).alias("best"))


# Every line of a document is retrieved for it; the answers are two of its words.
RUN_OF = "chr(1) || array_to_string(regexp_extract_all(lower(nfc_normalize({})), '[\\p{{L}}\\p{{N}}\\p{{M}}]+|[^\\p{{Z}}\\p{{C}}]'), chr(1)) || chr(1)"
HITS = f"""+ golds as (select doc_id as qid, [string_split(text, ' ')[2], string_split(text, ' ')[-1]] as answers from documents),
  hit_rows as (select c.qid, c.pos, len(list_filter(answers, lambda a: contains({RUN_OF.format("c.text")}, {RUN_OF.format("a")}))) > 0 as hit
  from contexts c join golds using (qid))"""


def answer_sets(spark: SparkSession, sf: str) -> DataFrame:
    words = F.split("text", " ")
    pair = F.array_compact(F.array(F.get(words, F.lit(1)), F.element_at(words, -1)))
    return I.table(spark, sf, "documents").select(F.col("doc_id").alias("qid"), pair.alias("answers"))


def hit_rows(spark: SparkSession, sf: str) -> DataFrame:
    return A.context_hits(I.contexts(spark, sf), answer_sets(spark, sf))


@query("e08_passage_has_answer", I.with_views("contexts", then=HITS + " select qid, pos, hit from hit_rows"))
def e08(spark: SparkSession, sf: str) -> DataFrame:
    return hit_rows(spark, sf).select("qid", "pos", "hit")


@query(
    "e09_hits_at_k",
    I.with_views(
        "contexts",
        then=HITS
        + """, q as (select qid, count(*) as depth, min(pos) filter (hit) as best from hit_rows group by qid)
        select k, count(best) filter (best < k) as n_hits from q, (select unnest(generate_series(1, (select arg_min(depth, qid) from q))) as k) group by k""",
    ),
)
def e09(spark: SparkSession, sf: str) -> DataFrame:
    return A.hits_at_k(hit_rows(spark, sf).select("qid", "pos", "hit"))


@query("e09_question_hits", I.with_views("contexts", then=HITS + " select qid, string_agg(case when hit then '1' else '0' end, '' order by pos) as hits from hit_rows group by qid"))
def e09_question(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.question_hits(hit_rows(spark, sf).select("qid", "pos", "hit"))
    return rows.select("qid", F.array_join(F.transform("hits", lambda h: h.cast("int").cast("string")), "").alias("hits"))


# Gold order: the retrieval rank; predicted order: a repeatable second score.
PERM = f"""+ second as (select qid, rank - 1 as gold, round({I.sql_uniform("second", "qid", "pid")}, 4) as s from hits),
  perm as (select qid, gold, row_number() over (partition by qid order by s desc, gold) - 1 as pos from second)"""


def permutations(spark: SparkSession, sf: str) -> DataFrame:
    second = F.round(I.uniform("second", F.col("qid"), F.col("pid")), 4)
    ordered = F.array_sort(F.collect_list(F.struct("rank", second.alias("s"))))
    lists = I.hits(spark, sf).groupBy("qid").agg(F.transform(ordered, lambda x: x["s"]).alias("scores"))
    return lists.select("qid", A.rank_permutation(F.col("scores")).alias("ranks"))


@query(
    "e10_inversions",
    I.with_views("hits", then=PERM + " select a.qid, count(*) as inversions from perm a join perm b on a.qid = b.qid and a.pos < b.pos and a.gold > b.gold group by a.qid"),
)
def e10(spark: SparkSession, sf: str) -> DataFrame:
    return permutations(spark, sf).select("qid", A.inversions("ranks").alias("inversions"))


@query("e11_topk_overlap", I.with_views("hits", then=PERM + " select qid, round(avg((gold < 5)::int), 6) as overlap from perm where pos < 5 group by qid"))
def e11(spark: SparkSession, sf: str) -> DataFrame:
    return permutations(spark, sf).select("qid", F.round(A.topk_overlap(F.col("ranks"), 5), 6).alias("overlap"))


@query("e12_depth_to_recover", I.with_views("hits", then=PERM + " select qid, (max(pos) + 1)::int as depth from perm where gold < 5 group by qid"))
def e12(spark: SparkSession, sf: str) -> DataFrame:
    return permutations(spark, sf).select("qid", A.depth_to_recover(F.col("ranks"), 5).alias("depth"))


def rouge_sql(n: int) -> str:
    def grams(x: str) -> str:
        t = f"regexp_extract_all(lower({x}), '[a-z0-9]+')"
        if n == 1:
            return t
        return f"list_transform(generate_series(1, len({t}) - 1), lambda i: {t}[i] || ' ' || {t}[i + 1])"

    return I.with_views(
        "turns",
        then=f"""+ bags as materialized (select id, {grams("pred")} as p, {grams("question")} as r from turns),
        a as (select id, item, count(*) as c from (select id, unnest(p) as item from bags) group by all),
        b as (select id, item, count(*) as c from (select id, unnest(r) as item from bags) group by all),
        same as (select id, sum(least(a.c, b.c)) as n from a join b using (id, item) group by id)
        select bags.id, round(coalesce(2.0 * n / (len(p) + len(r)), 0)::double, 6) as rouge{n} from bags left join same using (id)""",
    )


@query("e13_rouge1", rouge_sql(1))
def e13_1(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.rouge(I.turns(spark, sf), "id", "pred", "question", ["rouge1"])
    return rows.select("id", F.round("rouge1", 6).alias("rouge1"))


@query("e13_rouge2", rouge_sql(2))
def e13_2(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.rouge(I.turns(spark, sf), "id", "pred", "question", ["rouge2"])
    return rows.select("id", F.round("rouge2", 6).alias("rouge2"))


# The table row of each reference token: raised where the tokens are equal, then the highest so far.
LONGEST = """+ pairs as materialized (select id, regexp_extract_all(lower(pred), '[a-z0-9]+') as p, regexp_extract_all(lower(question), '[a-z0-9]+') as r from turns),
  walk as (select id, 0 as i, list_transform(p, lambda x: 0) as seen from pairs
    union all
    select id, i, list_transform(raised, lambda x, j: list_max(raised[1:j])) from (
      select w.id, w.i + 1 as i, list_transform(w.seen, lambda x, j: case when p[j] = r[w.i + 1] then coalesce(w.seen[j - 1], 0) + 1 else x end) as raised
      from walk w join pairs using (id) where w.i < len(r))),
  lcs as (select id, coalesce(seen[len(p)], 0) as n, len(p) + len(r) as size from walk join pairs using (id) where i = len(r)),
  longest as (select id, case when n > 0 then 2.0 * n::double / size else 0 end as score from lcs)"""


def recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


@query("e13_rougel", recursive(I.with_views("turns", then=LONGEST + " select id, round(score, 6) as rougel from longest")))
def e13_l(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.rouge(I.turns(spark, sf), "id", "pred", "question", ["rougeL"])
    return rows.select("id", F.round("rougeL", 6).alias("rougel"))


@query("e13_rouge")
def e13(spark: SparkSession, sf: str) -> DataFrame:
    return A.rouge(I.turns(spark, sf), "id", "pred", "question")


RESAMPLES = 1000
BOOTSTRAP = LONGEST + f""", unigrams as (
    select id, coalesce(2.0 * n::double / size, 0) as score from (select id, len(p) + len(r) as size from pairs) left join (
      select id, sum(least(a.c, b.c)) as n from (select id, item, count(*) as c from (select id, unnest(p) as item from pairs) group by all) a
      join (select id, item, count(*) as c from (select id, unnest(r) as item from pairs) group by all) b using (id, item) group by id) using (id)),
  scored as (select id, u.score as rouge1, l.score as rougeL from unigrams u join longest l using (id)),
  digests as (select s.*, b, md5(concat_ws('|', '0', id::varchar, b::varchar)) as d from scored s, (select unnest(range({RESAMPLES // A.DRAWS})) as b)),
  units as (select rouge1, rougeL, b * {A.DRAWS} + j as resample, ('0x' || substr(d, 8 * j + 1, 8))::bigint as u from digests, (select unnest(range({A.DRAWS})) as j)),
  drawn as (select *, len(list_filter({A.poisson_steps()}, lambda x: u >= x)) as copies from units),
  means as (select resample, sum(rouge1 * copies) / sum(copies) as rouge1, sum(rougeL * copies) / sum(copies) as rougeL from drawn where copies > 0 group by resample)
  select 'rouge1' as metric, round(quantile_cont(rouge1, 0.5), 6) as mid from means union all select 'rougeL', round(quantile_cont(rougeL, 0.5), 6) from means"""


@query("e14_bootstrap_mid", recursive(I.with_views("turns", then=BOOTSTRAP)))
def e14(spark: SparkSession, sf: str) -> DataFrame:
    scores = A.rouge(I.turns(spark, sf), "id", "pred", "question", ["rouge1", "rougeL"])
    mids = A.bootstrap_mid(scores, "id", ["rouge1", "rougeL"], RESAMPLES)
    return mids.select("metric", F.round("mid", 6).alias("mid"))


KS = (1, 3, 10, 100)
JUDGED = f"""+ ks as (select unnest([{", ".join(map(str, KS))}]) as k),
  ranked as (select *, row_number() over (partition by lang, query_id order by score desc, doc_id) as rank from run),
  j as (select r.lang, r.query_id, r.doc_id, r.rank, coalesce(q.rel, 0) as rel, s.doc_id is null as hole from ranked r
        left join qrels q on q.lang = r.lang and q.query_id = r.query_id and q.doc_id = r.doc_id
        left join (select distinct lang, doc_id from qrels) s on s.lang = r.lang and s.doc_id = r.doc_id),
  found as (select *, sum((rel > 0)::int) over (partition by lang, query_id order by rank rows between unbounded preceding and current row) as sofar from j),
  ideal as (select lang, query_id, rel, row_number() over (partition by lang, query_id order by rel desc) as rank from qrels where rel > 0),
  totals as (select lang, query_id, sum((rel > 0)::int) as n_rel from qrels group by all),
  idcg as (select lang, query_id, k, sum(rel / log2(rank + 1)) as idcg from ideal, ks where rank <= k group by all),
  per_query as (select t.lang, t.query_id, f.k, n_rel, dcg, steps, n_found, holes, first, coalesce(idcg, 0) as idcg from totals t join
    (select lang, query_id, k, sum(rel / log2(rank + 1)) as dcg, sum(case when rel > 0 then sofar / rank else 0 end) as steps,
            sum((rel > 0)::int) as n_found, sum(hole::int) as holes, min(rank) filter (rel > 0) as first
     from found, ks where rank <= k group by all) f on f.lang = t.lang and f.query_id = t.query_id
    left join idcg i on i.lang = f.lang and i.query_id = f.query_id and i.k = f.k),
  scored as (select lang, query_id, k, case when idcg > 0 then dcg / idcg else 0 end as ndcg, case when n_rel > 0 then steps / n_rel else 0 end as map,
    case when n_rel > 0 then n_found / n_rel else 0 end as recall, n_found / k as precision, coalesce(1.0 / first, 0) as mrr,
    case when n_rel > 0 then n_found / least(k, n_rel) else 0 end as recall_cap, holes / k as hole from per_query)"""


def metric_sql(name: str, columns: str) -> str:
    rounded = ", ".join(f"round({c}::double, 6) as {c}" for c in columns.split())
    return I.with_views("run", "qrels", then=JUDGED + f" select lang, query_id, k, {rounded} from scored")


def metric_rows(spark: SparkSession, sf: str, *names: str) -> DataFrame:
    rows = K.query_scores(I.run(spark, sf), I.qrels(spark, sf), KS, ["lang"])
    return rows.select("lang", "query_id", "k", *[F.round(n, 6).alias(n) for n in names])


@query("e15_ndcg", metric_sql("e15", "ndcg"))
def e15(spark: SparkSession, sf: str) -> DataFrame:
    return metric_rows(spark, sf, "ndcg")


@query("e16_map", metric_sql("e16", "map"))
def e16(spark: SparkSession, sf: str) -> DataFrame:
    return metric_rows(spark, sf, "map")


@query("e17_recall_precision", metric_sql("e17", "recall precision"))
def e17(spark: SparkSession, sf: str) -> DataFrame:
    return metric_rows(spark, sf, "recall", "precision")


@query("e18_mrr", metric_sql("e18", "mrr"))
def e18(spark: SparkSession, sf: str) -> DataFrame:
    return metric_rows(spark, sf, "mrr")


@query("e19_recall_cap", metric_sql("e19", "recall_cap"))
def e19(spark: SparkSession, sf: str) -> DataFrame:
    return metric_rows(spark, sf, "recall_cap")


@query("e20_hole", metric_sql("e20", "hole"))
def e20(spark: SparkSession, sf: str) -> DataFrame:
    return metric_rows(spark, sf, "hole")


REPORT = (
    JUDGED
    + """, sizes as (select lang, count(distinct query_id) as n from qrels group by lang),
  means as (select s.lang, k, avg(ndcg)::double as ndcg, avg(map)::double as map, avg(recall)::double as recall, avg(precision)::double as precision,
    (sum(mrr) / max(n))::double as mrr, (sum(recall_cap) / max(n))::double as recall_cap, (sum(hole) / max(n))::double as hole from scored s join sizes using (lang) group by s.lang, k)
  select metric, k, round(avg(value) * 100, 6) as value from (unpivot means on ndcg, map, recall, precision, mrr, recall_cap, hole into name metric value value) group by all"""
)


@query("e21_ir_report", I.with_views("run", "qrels", then=REPORT))
def e21(spark: SparkSession, sf: str) -> DataFrame:
    report = K.ir_report(I.run(spark, sf), I.qrels(spark, sf), KS, subset="lang")
    return report.select("metric", "k", F.round("value", 6).alias("value"))


@query(
    "e22_weighted_mean",
    """select event_type as name, round(sum(value * w) / sum(w), 6) as weighted_mean, sum(w) as weight, round(avg(value), 6) as mean, round(sum(value), 4) as total
       from (select event_type, value, json_extract_string(props, '$.k')::double as w from events) group by 1""",
)
def e22(spark: SparkSession, sf: str) -> DataFrame:
    weight = F.get_json_object("props", "$.k").cast("double")
    stats = I.table(spark, sf, "events").select(F.col("event_type").alias("name"), "value", weight.alias("weight"))
    rows = S.weighted_mean(stats)
    return rows.select(
        "name", F.round("weighted_mean", 6).alias("weighted_mean"), "weight", F.round("mean", 6).alias("mean"), F.round("total", 4).alias("total")
    )


# Questions are vectors, each key is the vector after it (the last one's, its own reversed); 64 rows make a batch.
PAIRS = """with numbered as (select vec_id, embedding::double[] as q, lead(embedding::double[], 1, list_reverse(embedding::double[])) over (order by vec_id) as k,
  (row_number() over (order by vec_id) - 1) // 64 as batch from embeddings)"""
SPREAD = "(select {key}, avg(sd) as {name} from (select {key}, dim, stddev_samp(x) as sd from (select batch, unnest({col}) as x, generate_subscripts({col}, 1) as dim from numbered) group by all) group by {key})"


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    e = I.vectors(spark, sf).select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("k"))
    return e.join(after, "vec_id", "left").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("q"), F.coalesce("k", F.reverse("embedding")).alias("k")
    )


@query(
    "e23_inbatch_report",
    PAIRS
    + f""", s as (select a.batch, a.vec_id, b.vec_id as other, list_inner_product(a.q, b.k) / 0.05 as logit from numbered a join numbered b using (batch)),
      z as (select batch, vec_id, max(logit) as m, arg_max(other, logit) = vec_id as hit, max(case when other = vec_id then logit end) as own, avg(logit) as mean from s group by batch, vec_id),
      l as (select s.batch, s.vec_id, m + ln(sum(exp(logit - m))) as lse, any_value(own) as own, any_value(mean) as mean, any_value(hit) as hit
            from s join z on s.batch = z.batch and s.vec_id = z.vec_id group by s.batch, s.vec_id, m)
      select batch, round(avg(0.9 * (lse - own) + 0.1 * (lse - mean)), 6) as loss, round(100 * avg(hit::int), 6) as accuracy,
             round(any_value(stdq), 6) as stdq, round(any_value(stdk), 6) as stdk, count(*) as weight
      from l join {SPREAD.format(key="batch", name="stdq", col="q")} using (batch) join {SPREAD.format(key="batch", name="stdk", col="k")} using (batch) group by batch""",
)
def e23(spark: SparkSession, sf: str) -> DataFrame:
    batches = with_batch(pairs(spark, sf), 64, "id").withColumnRenamed("slot", "pos")
    rows = S.inbatch_report(batches, temperature=0.05, label_smoothing=0.1)
    return rows.select("batch", *[F.round(c, 6).alias(c) for c in ("loss", "accuracy", "stdq", "stdk")], "weight")


@query(
    "e24_queue_report",
    PAIRS
    + f""", neg as (select vec_id, embedding::double[] as e from embeddings),
      s as (select a.vec_id, list_inner_product(a.q, n.e) / 0.5 as logit, list_inner_product(a.q, a.k) / 0.5 as own from numbered a cross join neg n),
      z as (select vec_id, own, greatest(max(logit), own) as m, max(logit) as top, avg(logit) as mean, count(*) as n from s group by vec_id, own),
      l as (select z.vec_id, z.own, top, n, mean, m + ln(exp(z.own - m) + sum(exp(logit - m))) as lse from s join z on s.vec_id = z.vec_id group by z.vec_id, z.own, m, top, n, mean)
      select round(avg(0.9 * (lse - own) + 0.1 * (lse - (own + mean * n) / (n + 1))), 6) as loss, round(100 * avg((own >= top)::int), 6) as accuracy, count(*) as weight,
             (select round(avg(sd), 6) from (select dim, stddev_samp(x) as sd from (select unnest(q) as x, generate_subscripts(q, 1) as dim from numbered) group by dim)) as stdq,
             (select round(avg(sd), 6) from (select dim, stddev_samp(x) as sd from (select unnest(k) as x, generate_subscripts(k, 1) as dim from numbered) group by dim)) as stdk
      from l""",
)
def e24(spark: SparkSession, sf: str) -> DataFrame:
    negatives = I.vectors(spark, sf).select(F.col("vec_id").alias("id"), "embedding")
    report = S.queue_report(pairs(spark, sf), negatives, temperature=0.5, label_smoothing=0.1, block_rows=150)
    return report.select(*[F.round(c, 6).alias(c) for c in ("loss", "accuracy", "stdq", "stdk")], "weight")


@query(
    "e25_sequence_exact_match",
    "select source, round(avg((lower(text) = text)::int), 6) as exact_match from documents group by source",
)
def e25(spark: SparkSession, sf: str) -> DataFrame:
    words = F.split("text", " ")
    score = A.sequence_exact_match(F.transform(words, lambda w: F.lower(w)), words)
    return I.table(spark, sf, "documents").groupBy("source").agg(F.round(score, 6).alias("exact_match"))


@query("e26_label_profile", "select quality, count(*) as rows from labels group by quality")
def e26(spark: SparkSession, sf: str) -> DataFrame:
    return A.label_profile(I.table(spark, sf, "labels"), "quality")


@query(
    "e26_dataset_shapes",
    "select 'documents' as dataset, count(*) as rows, 5 as columns from documents union all select 'pages', count(*), 3 from pages union all select 'events', count(*), 6 from events",
)
def e26_shapes(spark: SparkSession, sf: str) -> DataFrame:
    return A.dataset_shapes({n: I.table(spark, sf, n) for n in ("documents", "pages", "events")})
