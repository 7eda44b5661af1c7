"""Queries for training data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import traindata as D
from . import inputs as I
from .registry import query
from .text import quoted, sql_normalize_text


def ids(column: str) -> Column:
    return F.md5(I.joined(column))


IDS = "md5(coalesce(string_agg(token::varchar, ',' order by i), ''))"
SIZES = """+ sizes as (select e.id, max(case when kind = 'random' then pool else 0 end) as n_rand, max(case when kind = 'hard' then pool else 0 end) as n_hard,
  max(case when kind = 'positive' then pool else 0 end) as n_pos from example_ids e left join pools p on p.id = e.id group by e.id),
  draws as (select id, n_rand, n_hard, n_pos, unnest(range(4)) as d from sizes),
  quota as (select id, any_value(n_rand) as n_rand, any_value(n_pos) as n_pos, least(count(*) filter ({u} < 0.5), greatest(any_value(n_hard) - 1, 0)) as hard_n from draws group by id),
  quotas as (select id, n_pos, hard_n, least(4 - hard_n, n_rand) as rand_n from quota)""".replace(
    "{u}", I.sql_uniform("3|quota", "id", "d")
)


@query("d01_negative_quota", I.with_views("pools", "example_ids", then=SIZES + " select id, hard_n::int as n_hard, rand_n::int as n_random from quotas"))
def d01(spark: SparkSession, sf: str) -> DataFrame:
    quota = D.negative_quota(
        F.col("id").cast("string"), F.col("negative_ctxs"), F.col("hard_negative_ctxs"), 4, 0.5, 1, seed=3
    )
    return I.examples(spark, sf).select("id", quota.alias("q")).select("id", "q.n_hard", "q.n_random")


TRIPLES = (
    SIZES
    + f""", gold as (select p.id, p.question, p.title, p.text from pools p join quotas q using (id)
    where kind = 'positive' and place = floor({I.sql_uniform("3|gold", "id")} * n_pos)::bigint),
  picked as (select p.id, p.title, p.text, kind, row_number() over (partition by p.id, kind order by
      md5(concat_ws('|', '3|' || kind, p.id::varchar, (place - case when kind = 'hard' then 1 else 0 end)::varchar))) as r, hard_n, rand_n
    from pools p join quotas q using (id) where kind = 'random' or (kind = 'hard' and place >= 1)),
  negs as (select id, string_agg(text, '|' order by kind desc, r) as negatives, count(*)::int as n from picked
    where r <= case when kind = 'hard' then hard_n else rand_n end group by id)"""
)


def triples(spark: SparkSession, sf: str) -> DataFrame:
    return D.sample_triples(I.examples(spark, sf), "id", True, 4, 0.5, 1, seed=3)


def texts(column: str) -> Column:
    return F.array_join(F.transform(column, lambda n: n["text"]), "|")


@query(
    "d02_sample_triples",
    I.with_views(
        "pools",
        "example_ids",
        then=TRIPLES
        + """ select e.id, e.question, md5(g.text) as gold_md5, md5(coalesce(negatives, '')) as negatives_md5, coalesce(n, 0) as n
        from example_ids e left join gold g on g.id = e.id left join negs on negs.id = e.id""",
    ),
)
def d02(spark: SparkSession, sf: str) -> DataFrame:
    return triples(spark, sf).select(
        "id", "question", F.md5("gold.text").alias("gold_md5"), F.md5(texts("negatives")).alias("negatives_md5"), F.size("negatives").alias("n")
    )


@query(
    "d02_sample_triples_eval",
    I.with_views("pools", "example_ids", then="""select e.id, md5(p.text) as gold_md5, md5(coalesce(n.text, '')) as negatives_md5 from example_ids e
        left join (select * from pools where kind = 'positive' and place = 0) p on p.id = e.id
        left join (select * from pools where kind = 'random' and place = 0) n on n.id = e.id"""),
)
def d02_eval(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.sample_triples(I.examples(spark, sf), "id", training=False)
    return rows.select("id", F.md5("gold.text").alias("gold_md5"), F.md5(texts("negatives")).alias("negatives_md5"))


PLAIN = f"""+ shown as (select id, question, kind, place, {sql_normalize_text("title || ' ' || text")} as passage from pools),
  golds as (select e.id, e.question, passage from example_ids e left join (select * from shown where kind = 'positive' and place = 0) p on p.id = e.id)"""


@query(
    "d03_normalize_triples",
    I.with_views("pools", "example_ids", then=PLAIN + """ select p.id, p.question as query, md5(p.passage) as gold_md5, md5(coalesce(n.passage, '')) as negatives_md5 from golds p
        left join (select * from shown where kind = 'random' and place = 0) n on n.id = p.id"""),
)
def d03(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.normalize_triples(D.sample_triples(I.examples(spark, sf), "id", training=False))
    return rows.select("id", "query", F.md5("gold").alias("gold_md5"), F.md5(F.array_join("negatives", "|")).alias("negatives_md5"))


@query(
    "d04_batch_layout",
    I.with_views(
        "pools",
        "example_ids",
        then=PLAIN
        + """, placed as (select id, question, passage as gold, (row_number() over (order by id) - 1) // 16 as batch from golds),
        negs as (select id, passage from shown where kind = 'random' and place = 0)
        select batch, string_agg(question, ',' order by p.id) as queries, md5(string_agg(gold, '|' order by p.id) || coalesce('|' || string_agg(n.passage, '|' order by p.id), '')) as passages_md5
        from placed p left join negs n on n.id = p.id group by batch""",
    ),
)
def d04(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.normalize_triples(D.sample_triples(I.examples(spark, sf), "id", training=False))
    return D.batch_layout(rows, 16, "id").select(
        "batch", F.array_join("queries", ",").alias("queries"), F.md5(F.array_join("passages", "|")).alias("passages_md5")
    )


@query(
    "d05_chunk_tokens",
    I.with_views("token_rows", then=f"""select doc_id, (i - 3) // 32 as chunk, {IDS} as ids_md5 from token_rows where i >= 3 group by 1, 2 having count(*) = 32"""),
)
def d05(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.tokens(spark, sf).select("doc_id", F.posexplode(D.chunk_tokens(F.col("tokens"), 32, 3)).alias("chunk", "ids"))
    return rows.select("doc_id", F.col("chunk").cast("long").alias("chunk"), ids("ids").alias("ids_md5"))


@query(
    "d05_chunk_stream",
    I.with_views(
        "token_rows",
        then="""+ laid as (select token, row_number() over (order by doc_id, i) - 1 - 5 as place from token_rows)
        select place // 256 as chunk, md5(string_agg(token::varchar, ',' order by place)) as ids_md5 from laid where place >= 0 group by 1 having count(*) = 256""",
    ),
)
def d05_stream(spark: SparkSession, sf: str) -> DataFrame:
    chunks = D.chunk_stream(I.written(I.tokens(spark, sf), "tokens"), "doc_id", 256, offset=5)
    return chunks.select("chunk", ids("tokens").alias("ids_md5"))


def _crop_sql(view: str) -> str:
    ratio, start = I.sql_uniform(f"5|ratio|{view}", "doc_id"), I.sql_uniform(f"5|start|{view}", "doc_id")
    return f"""(select doc_id, {IDS} as {view}_md5 from (select *, floor(n * ({ratio} * 0.4 + 0.1))::bigint as len from (select *, count(*) over (partition by doc_id) as n from token_rows))
        where i >= floor({start} * (n - len + 1)) and i < floor({start} * (n - len + 1)) + len group by doc_id)"""


@query(
    "d06_random_crop",
    I.with_views("token_rows", then=f"""select d.doc_id, coalesce(q_md5, md5('')) as q_md5, coalesce(k_md5, md5('')) as k_md5 from (select distinct doc_id from token_rows) d
        left join {_crop_sql("q")} q on q.doc_id = d.doc_id left join {_crop_sql("k")} k on k.doc_id = d.doc_id"""),
)
def d06(spark: SparkSession, sf: str) -> DataFrame:
    views = D.crop_views(I.tokens(spark, sf), "doc_id", 0.1, 0.5, seed=5)
    return views.select("doc_id", ids("q_tokens").alias("q_md5"), ids("k_tokens").alias("k_md5"))


U_TOKEN = I.sql_uniform("0|token", "doc_id", "i")
OTHER = f"floor({I.sql_uniform('0|other', 'doc_id', 'i')} * 100)::int + 50"


@query(
    "d07_augment",
    I.with_views(
        "token_rows",
        then=f"""select doc_id, md5(coalesce(string_agg(token::varchar, ',' order by i) filter ({U_TOKEN} > 0.1), '')) as deleted_md5,
        md5(string_agg((case when {U_TOKEN} > 0.1 then token else {OTHER} end)::varchar, ',' order by i)) as replaced_md5,
        md5(string_agg((case when {U_TOKEN} > 0.1 then token else 4 end)::varchar, ',' order by i)) as masked_md5 from token_rows group by doc_id""",
    ),
)
def d07(spark: SparkSession, sf: str) -> DataFrame:
    tokens, key, keep = F.col("tokens"), F.col("doc_id"), F.col("keep")
    rows = I.tokens(spark, sf).withColumn("keep", D.keep_draws(tokens, key))
    out = rows.select(
        "doc_id",
        D.augment_delete(tokens, key, keep=keep).alias("deleted"),
        D.augment_replace(tokens, key, 50, 149, keep=keep).alias("replaced"),
        D.augment_mask(tokens, key, 4, keep=keep).alias("masked"),
    )
    return out.select("doc_id", *[ids(c).alias(f"{c}_md5") for c in ("deleted", "replaced", "masked")])


@query(
    "d08_augment_shuffle",
    I.with_views(
        "token_rows",
        then=f"""+ drawn as (select *, {I.sql_uniform("0|place", "doc_id", "i")} as u, count(*) filter ({I.sql_uniform("0|count", "doc_id", "i")} < 0.1) over (partition by doc_id) as n from token_rows),
        places as (select *, row_number() over (partition by doc_id order by u, i) as r from drawn),
        dealt as (select *, row_number() over (partition by doc_id order by {I.sql_uniform("0|deal", "doc_id", "i")}, i) as s from places where r <= n),
        moved as (select a.doc_id, a.i, b.token from dealt a join dealt b on a.doc_id = b.doc_id and a.r = b.s)
        select t.doc_id, md5(string_agg(coalesce(m.token, t.token)::varchar, ',' order by t.i)) as ids_md5 from token_rows t left join moved m on m.doc_id = t.doc_id and m.i = t.i group by t.doc_id""",
    ),
)
def d08(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.tokens(spark, sf)
    out = rows.select("doc_id", D.augment_shuffle(F.col("tokens"), F.col("doc_id")).alias("ids"))
    return out.select("doc_id", ids("ids").alias("ids_md5"))


@query(
    "d09_add_bos_eos",
    I.with_views("tokens", then="select doc_id, md5(array_to_string([1] || tokens || [2], ',')) as both_md5, md5(array_to_string([1] || tokens, ',')) as bos_md5, md5(array_to_string(tokens || [2], ',')) as eos_md5 from tokens"),
)
def d09(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.tokens(spark, sf)
    forms = {"both": (1, 2), "bos": (1, None), "eos": (None, 2)}
    out = rows.select("doc_id", *[D.add_bos_eos(F.col("tokens"), *v).alias(k) for k, v in forms.items()])
    return out.select("doc_id", *[ids(k).alias(f"{k}_md5") for k in forms])


@query(
    "d10_pad_mask",
    I.with_views(
        "tokens",
        then="""+ placed as (select doc_id, tokens, (row_number() over (order by doc_id) - 1) // 8 as batch from tokens),
        sized as (select *, max(len(tokens)) over (partition by batch) as longest from placed)
        select doc_id, batch, longest::int as n, len(tokens)::int as n_real, md5(array_to_string(list_concat(tokens, list_transform(range(longest - len(tokens)), lambda x: 0)), ',')) as ids_md5 from sized""",
    ),
)
def d10(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.with_batch(I.tokens(spark, sf), 8, "doc_id")
    padded = D.pad_mask(rows, "tokens")
    real = F.size(F.filter("mask", lambda m: m))
    return padded.select("doc_id", "batch", F.size("tokens").alias("n"), real.alias("n_real"), ids("tokens").alias("ids_md5"))


WEIGHTS = """weights as (select source, n, pow(n / sum(n) over (), 0.5) / sum(pow(n / sum_n, 0.5)) over () as p
  from (select source, n, sum(n) over () as sum_n from (select source, count(*) as n from documents group by source)))"""


@query("d11_mixture_weights", f"with {WEIGHTS} select source, n, round(p, 6) as p from weights")
def d11(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.mixture_weights(I.table(spark, sf, "documents"), "source", 0.5)
    return rows.select("source", "n", F.round("p", 6).alias("p"))


@query(
    "d12_sample_mixture",
    f"""with {WEIGHTS}, sets as (select source, n, sum(p) over (order by source) as upto, row_number() over (order by source) as nr from weights),
        draws as (select range as draw, {I.sql_uniform("9|set", "range")} as u, {I.sql_uniform("9|row", "range")} as v from range((select count(*) from documents))),
        chosen as (select draw, v, coalesce(min(s.nr), (select max(nr) from sets)) as nr from draws left join sets s on s.upto > u group by draw, v),
        numbered as (select doc_id, source, row_number() over (partition by source order by doc_id) as pos from documents)
        select draw, s.source as dataset_id, d.doc_id from chosen c join sets s using (nr) join numbered d on d.source = s.source and d.pos = floor(v * n) + 1""",
)
def d12(spark: SparkSession, sf: str) -> DataFrame:
    docs = I.table(spark, sf, "documents")
    return D.sample_mixture(docs, docs.count(), "source", "doc_id", 0.5, seed=9)


def completion(limit: int) -> str:
    return COMPLETION.replace("200", str(limit))


#: Longer than any prompt and answer together.
WHOLE = 1_000_000

COMPLETION = f"""+ prompts as (select id, regexp_split_to_array(question, '[\\s\\x{{0B}}]+') as p, regexp_split_to_array(pred || ' </s>', '[\\s\\x{{0B}}]+') as t from turns),
  clean as (select id, list_filter(p, lambda w: w <> '') as p, list_filter(t, lambda w: w <> '') as t from prompts),
  words as (select id, least(len(p), 200) as prompt_len, unnest(list_concat(p, t)) as w, generate_subscripts(list_concat(p, t), 1) - 1 as i from clean),
  enc as (select id, prompt_len, i, {I.sql_word_id("w")} as token, case when i < prompt_len - 1 then -100 else {I.sql_word_id("w")} end as label from words where i < 200)"""


def encoded(spark: SparkSession, sf: str, limit: int = WHOLE) -> DataFrame:
    return D.encode_completion(I.turns(spark, sf), "question", "pred", limit)


@query(
    "d13_encode_completion",
    I.with_views("turns", then=COMPLETION + """ select id, any_value(prompt_len)::int as prompt_len, md5(string_agg(token::varchar, ',' order by i)) as ids_md5,
        md5(string_agg(label::varchar, ',' order by i)) as labels_md5, count(*)::int as n from enc group by id"""),
)
def d13(spark: SparkSession, sf: str) -> DataFrame:
    return encoded(spark, sf, 200).select(
        "id", "prompt_len", ids("input_ids").alias("ids_md5"), ids("labels").alias("labels_md5"), F.size("attention_mask").alias("n")
    )


# Markers: the most frequent article of the English text opens, another frequent word closes.
OPEN, CLOSE = "the", "of"


@query(
    "d14_mask_between",
    I.with_views(
        "turns",
        then=completion(WHOLE)
        + f""", marks as (select id, max(i) as last, min(i) filter (label = {I.sql_word_id(quoted(OPEN))} and i >= prompt_len) as o from enc group by id),
        closes as (select m.id, any_value(m.last) as last, any_value(m.o) as o, max(i) filter (label = {I.sql_word_id(quoted(CLOSE))} and i >= o and i >= prompt_len) as c from marks m join enc using (id) group by m.id),
        again as (select c.id, any_value(last) as last, any_value(o) as o, any_value(c) as c, min(i) filter (label = {I.sql_word_id(quoted(OPEN))} and i > c and i >= prompt_len) as o2 from closes c join enc using (id) group by c.id)
        select id, md5(string_agg((case when coalesce(i > o and i < coalesce(c, last), false) or coalesce(i > o2 and i < last, false) then -100 else label end)::varchar, ',' order by i)) as labels_md5
        from enc join again using (id) group by id""",
    ),
)
def d14(spark: SparkSession, sf: str) -> DataFrame:
    marks = spark.range(1).select(D.word_ids(F.lit(f"{OPEN} {CLOSE}")).alias("m")).first()["m"]
    return D.mask_between(encoded(spark, sf), marks[0], marks[1]).select("id", ids("labels").alias("labels_md5"))


@query(
    "d15_drop_fully_masked",
    I.with_views("turns", then=f"{completion(WHOLE)} select id from enc where id % 3 <> 0 group by id having count(*) filter (label <> -100) > 0"),
)
def d15(spark: SparkSession, sf: str) -> DataFrame:
    """Whole rows, of which every third has no label left."""
    hidden = F.transform("labels", lambda x: F.lit(D.IGNORED))
    rows = encoded(spark, sf).withColumn("labels", F.when(F.col("id") % 3 == 0, hidden).otherwise(F.col("labels")))
    return D.drop_fully_masked(rows).select("id")


@query("d16_split_train_eval", f"select event_id, case when {I.sql_uniform('4|split', 'event_id')} < 0.1 then 'eval' else 'train' end as split from events")
def d16(spark: SparkSession, sf: str) -> DataFrame:
    return D.split_train_eval(I.table(spark, sf, "events"), "event_id", 0.1, seed=4).select("event_id", "split")


@query("d17_shuffle_rows", "select o_orderkey, md5('6|' || o_orderkey) as shuffle_key from orders order by 2, 1")
def d17(spark: SparkSession, sf: str) -> DataFrame:
    return D.shuffle_rows(I.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", seed=6)


@query(
    "d18_concat_encoded",
    I.with_views("turns", "token_rows", then=completion(WHOLE) + """ , words_of as (select doc_id, md5(string_agg(token::varchar, ',' order by i)) as ids_md5 from token_rows group by doc_id)
        select md5(string_agg(token::varchar, ',' order by i)) as ids_md5 from enc group by id union all select ids_md5 from words_of""").replace("words as (select id, least", "pwords as (select id, least").replace(f"from words where i < {WHOLE}", f"from pwords where i < {WHOLE}"),
)
def d18(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.tokens(spark, sf)
    second = rows.select(
        F.col("tokens").alias("input_ids"), F.col("tokens").alias("labels"), F.transform("tokens", lambda x: F.lit(1)).alias("attention_mask")
    )
    return D.concat_encoded(encoded(spark, sf), second).select(ids("input_ids").alias("ids_md5"))


@query(
    "d19_rolling_negative_queue",
    """with placed as (select vec_id, (row_number() over (order by vec_id) - 1) // 32 as key_batch from embeddings)
       select vec_id, key_batch, b.batch from placed join (select distinct key_batch as batch from placed) b
       on b.batch > key_batch and b.batch <= key_batch + 4""",
)
def d19(spark: SparkSession, sf: str) -> DataFrame:
    return D.rolling_negative_queue(I.vectors(spark, sf).select("vec_id"), 128, 32, "vec_id")
