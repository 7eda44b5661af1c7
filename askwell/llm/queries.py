"""Registered queries over the shared test tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25, byte_bpe, lang_id, lexical, mixing, packing, pii, pitman_yor, quality, simhash, suffix_dedup, turn_trie, warc
from .common import kept, remove_folder, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def op7_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(read(spark, sf, "documents"))


def op9_simhash_neardup(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_classes(read(spark, sf, "documents"))


def op3_pii_surrogates(spark: SparkSession, sf: str) -> DataFrame:
    return pii.replace_entities(read(spark, sf, "documents")).select("doc_id", "text", "n_replaced")


def op4_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(read(spark, sf, "documents"))


def op5_bestfit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(read(spark, sf, "documents"))


def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return lang_id.identify(read(spark, sf, "documents"))


def op2_bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Every document whose id is divisible by 100, as a query against all documents."""
    docs = read(spark, sf, "documents")
    asked = docs.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return bm25.top_k(docs, asked).withColumn("score", F.round("score", 4))


def op6_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.dedup(read(spark, sf, "documents"))


def op8_pitman_yor(spark: SparkSession, sf: str) -> DataFrame:
    return pitman_yor.score(read(spark, sf, "documents"))


def op10_warc_archive(spark: SparkSession, sf: str) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads them back."""
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archive(read(spark, sf, "pages"), folder)
    found = kept(warc.read_archive(spark, folder, payloads=False).drop("payload", "url"))
    remove_folder(spark, folder)
    return found


def op11_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return turn_trie.prefix_trie(read(spark, sf, "conversations"))


def op12_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return byte_bpe.digest(read(spark, sf, "documents"))


def op13_ranked_lexical(spark: SparkSession, sf: str) -> DataFrame:
    """The fifty best of all documents for every benchmark item."""
    return lexical.rank(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


QUERIES |= {
    "op11_prefix_trie": op11_prefix_trie,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_ranked_lexical": op13_ranked_lexical,
    "op1_language_id": op1_language_id,
    "op2_bm25_topk": op2_bm25_topk,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op8_pitman_yor": op8_pitman_yor,
    "op10_warc_archive": op10_warc_archive,
    "op4_mix_sources": op4_mix_sources,
    "op5_bestfit_packing": op5_bestfit_packing,
    "op3_pii_surrogates": op3_pii_surrogates,
    "op7_quality_rules": op7_quality_rules,
    "op9_simhash_neardup": op9_simhash_neardup,
}

#: Lower case of A-Z only.
FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES |= {
    # CRC-32 bit by bit: a byte is folded in, then eight steps (-1) follow.
    "op11_prefix_trie": r"""
        with own as (
          select conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} as t,
                 row_number() over (partition by conv_id order by turn nulls first,
                   sha256(concat_ws(':', strlen(coalesce(role, '')), coalesce(role, ''), coalesce(text, '')))) as p
          from conversations where conv_id is not null),
        lists as (select conv_id, list(t order by p) as ts from own group by conv_id),
        sized as (
          select *, xor(4294967295, list_reduce(
                   list_concat([4294967295], flatten(list_transform(string_split(conv_id::varchar, ''), lambda c: [ord(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
                   lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end)) % 4 as h from lists),
        rebuilt as (
          select s.conv_id, list_concat(coalesce(b.ts, [])[1:s.h], s.ts[s.h + 1:]) as ts from sized s left join lists b on b.conv_id = s.conv_id - s.conv_id % 20),
        members as (select conv_id, ts, unnest(range(len(ts) + 1)) as d from rebuilt),
        nodes as (
          select ts[1:d] as k, any_value(d) as d, min(conv_id) as conv_id, count(*) as n,
                 sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (len(ts) = d), '')) as ends from members group by ts[1:d]),
        children as (select k[1:d - 1] as k, count(*) as c from nodes where d > 0 group by k[1:d - 1]),
        own_share as (
          select n.*, coalesce(c, 0) as c, case when d = 0 then 0 else (n - 1) * len(regexp_extract_all(k[d].text, '[^ 	-
]+')) end as saved
          from nodes n left join children using (k)),
        above as (select *, unnest(range(d + 1)) as u from own_share),
        sums as (select k[1:u] as k, count(*) filter (c = 0) as leaves, sum(saved)::bigint as saved from above group by k[1:u])
        select n.conv_id, n.d as depth, p.conv_id as parent_conv_id, n.n as n_convs, n.c as n_children, s.leaves as n_leaves, s.saved as saved_tokens, n.ends as ends_sha256
        from own_share n join sums s on s.k = n.k left join nodes p on n.d > 0 and p.k = n.k[1:n.d - 1]""",
    "op13_ranked_lexical": rf"""
        with words as (select doc_id, unnest(regexp_extract_all({FOLDED}, '{lexical.TERM}')) as t from documents),
        tf as (select doc_id, t, count(*) as tf from words group by doc_id, t),
        sizes as (select doc_id, sum(tf)::bigint as n from tf group by doc_id),
        whole as (select count(*) as docs, sum(n)::bigint as terms from sizes),
        asked as (select distinct item_id, unnest(regexp_extract_all({FOLDED}, '{lexical.TERM}')) as t from benchmark),
        weights as (
          select t, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint as w
          from (select t, count(*) as df from tf where t in (select t from asked) group by t), whole),
        scores as (
          select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::bigint as score
          from asked join tf using (t) join weights using (t) join sizes using (doc_id), whole group by item_id, doc_id)
        select item_id, rank::int as rank, doc_id, score
        from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0) where rank <= 50""",
    "op2_bm25_topk": r"""
        with words as (
          select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[^\x20\x09-\x0D]+')) as w from documents),
        tf as (select doc_id, w, count(*) as n from words group by doc_id, w),
        sizes as (select d.doc_id, coalesce(n, 0) as n from documents d left join (select doc_id, sum(n) as n from tf group by doc_id) t using (doc_id)),
        whole as (select count(*) as docs, avg(n) as mean from sizes),
        asked as (select doc_id as query_id, w, n as times from tf where doc_id % 100 = 0),
        df as (select w, count(*) as df from tf where w in (select w from asked) group by w),
        scores as (
          select a.query_id, t.doc_id,
                 sum(a.times * ln(1 + (docs - df + 0.5) / (df + 0.5)) * t.n * 2.2 / (t.n + 1.2 * (0.25 + 0.75 * s.n / mean))) as score
          from asked a join tf t on t.w = a.w join df on df.w = a.w join sizes s on s.doc_id = t.doc_id, whole group by a.query_id, t.doc_id)
        select query_id, rank::int as rank, doc_id, round(score, 4) as score
        from (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from scores) where rank <= 10""",
    "op10_warc_archive": """
        with p as (select page_id, coalesce(html, '') as payload, strlen(coalesce(html, '')) as n from pages),
        k as (select payload, max(page_id) as keeper from p where n >= 1000 group by payload)
        select page_id, n::bigint as payload_bytes, sha1(p.payload) as payload_digest,
               case when keeper <> page_id then 'revisit' else 'response' end as record_type,
               case when keeper <> page_id then keeper end as refers_to
        from p left join k on p.payload = k.payload""",
}
