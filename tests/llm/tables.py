"""Small tables for the tests: real documents, and odd rows with clashing extra columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp string, kept string"


def documents(spark: SparkSession) -> DataFrame:
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd(spark: SparkSession) -> DataFrame:
    """Nulls in every column, empty and blank and long texts, ties, repeated rows, columns named like results."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()
    mean = " ".join(words[(7 * i + i * i) % 11] + str(i % 37) for i in range(80))
    long = " ".join(words[(i * i + 3 * i) % 11] + str(i * 7919 % 1009) for i in range(30_000))
    rows = [
        (1, mean, "en", "a"), (2, mean, "en", "a"), (2, mean, "en", "a"), (3, None, None, None), (None, mean + " end", None, "a"),
        (None, None, "de", None), (4, "", "de", "b"), (5, " \t\n\x0b\f\r ", "de", "b"), (6, long, None, None), (7, long + " tail", "en", ""),
        (8, "É é ñ ß Ωμ 文字 \x00\x1c ", "fr", "Z"), (9, "word", "en", "b"), (10, "UPPER upper " * 60, "en", "é"), (11, "1 2 3 4", "en", "a"),
    ]
    return spark.createDataFrame([(*r, 0, -1, "x", "y") for r in rows], SCHEMA).repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return odd(spark).filter(F.lit(False))
