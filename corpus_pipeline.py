"""From raw documents to packed training sequences, in stages that each run one operator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askwell.llm import alike, mixing, packing, pii, quality
from askwell.llm.common import release, remove_folder, shared_folder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return quality.keep_sound(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose fingerprints are near or that share 0.8 of their five-word shingles."""
    return alike.keep_one(docs, distance=DISTANCE)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates in place of personal data, and their new lengths."""
    replaced = pii.replace_entities(docs)
    fresh = {"n_chars": F.length("text").cast("long")}
    return replaced.select(*[fresh.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix of sources takes them."""
    return mixing.mixed_texts(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each tokenised document lies in the training sequences."""
    return packing.pack(docs, remembered=REMEMBERED)


#: Bits in which fingerprints of near copies differ at most, as in the operator's own query.
DISTANCE = 4

#: Words whose ids a worker keeps: the same workers run the other stages too, and hold what one of them keeps.
REMEMBERED = 250_000

STAGES = [
    ("quality rules", keep_quality),
    ("near-duplicates", drop_near_copies),
    ("personal data", replace_personal_data),
    ("source mix", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Hashing tokens, fits and searches have no counterpart in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if number:
            remove_folder(spark, f"{folder}/{number - 1}")
        release(spark)
    return docs
