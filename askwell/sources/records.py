"""Readers and writers for records, passages, vectors and token shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..session import broadcast_within, written

TSV = {"sep": "\t", "quote": '"', "escape": '"'}
PASSAGE = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType())]
)
PASSAGE_TSV = T.StructType([PASSAGE["id"], PASSAGE["text"], PASSAGE["title"]])
CONTEXT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)
QA_RECORD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("ctxs", T.ArrayType(CONTEXT)),
        T.StructField("answers", T.ArrayType(T.StringType())),
        T.StructField("answer", T.StringType()),
        T.StructField("answerKey", T.StringType()),
        T.StructField(
            "choices",
            T.StructType(
                [
                    T.StructField("label", T.ArrayType(T.StringType())),
                    T.StructField("text", T.ArrayType(T.StringType())),
                ]
            ),
        ),
        T.StructField("label", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("level", T.StringType()),
    ]
)
EXAMPLE_PART = T.ArrayType(PASSAGE)
CONTRASTIVE = T.StructType(
    [
        T.StructField("question", T.StringType()),
        T.StructField("positive_ctxs", EXAMPLE_PART),
        T.StructField("negative_ctxs", EXAMPLE_PART),
        T.StructField("hard_negative_ctxs", EXAMPLE_PART),
    ]
)
EMBEDDING = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]
)


def read_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Records by file name: ``.json`` one array per file, ``.parquet``, else one object a line."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if path.endswith(".json"):
        return reader.option("multiLine", True).json(path)
    return reader.json(path)


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    """``id, title, text`` from TSV (id, text, title) without its header row, or from JSON lines."""
    if path.endswith(".jsonl"):
        return spark.read.schema(PASSAGE).json(path)
    rows = spark.read.schema(PASSAGE_TSV).options(**TSV, multiLine=True).csv(path)
    return rows.filter(F.col("id") != "id").select("id", "title", "text")


def read_tsv_header(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Tab-separated file whose first row names the columns."""
    reader = spark.read.options(**TSV, header=True, multiLine=True)
    return (reader if schema is None else reader.schema(schema)).csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated sink with a header row, every value quoted."""
    plain = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(**TSV, **plain, header=True, quoteAll=True).csv(path)


def write_passages(df: DataFrame, path: str) -> None:
    """Passage file in the column order ``read_passages`` expects."""
    write_tsv(df.select("id", "text", "title"), path)


def read_embeddings(spark: SparkSession, glob: str) -> DataFrame:
    """Vector shards matched by a glob, as one table."""
    return spark.read.parquet(glob)


def read_token_shards(
    spark: SparkSession, folder: str, mode: str = "full", shard: int = 0, n_shards: int = 1
) -> DataFrame:
    """Token shards: ``full`` all files, ``single`` the first, ``split`` this worker's share.

    ``split`` skips unreadable files.
    """
    if mode == "full":
        return spark.read.option("pathGlobFilter", "*.p*").parquet(folder)
    names = sorted(
        r["path"]
        for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.p*").load(folder).select("path").collect()
    )
    if mode == "single":
        return spark.read.parquet(names[0])
    size, larger = divmod(len(names), n_shards)
    start = shard * size + min(shard, larger)
    mine = names[start : start + size + (1 if shard < larger else 0)]
    return spark.read.option("ignoreCorruptFiles", True).schema(TOKENS).parquet(*mine)


TOKENS = T.StructType([T.StructField("tokens", T.ArrayType(T.IntegerType()))])


def in_file_order(df: DataFrame) -> DataFrame:
    """Adds ``__pos``: each row's number, from 1, in the order of file names and lines.

    ``df`` comes straight from a reader. Rows are counted per split; what lies
    before a split is the sum of the files before its own (one row per file, as
    many as the reader lists) and of the splits before it in its file. Within a
    split rows keep their order.
    """
    split = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start")]
    rows = df.select("*", *split, F.monotonically_increasing_id().alias("__line"))
    splits = written(rows.groupBy("__file", "__start").agg(F.count("*").alias("n"), F.min("__line").alias("first")), "splits")
    earlier = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    files = splits.groupBy("__file").agg(F.sum("n").alias("n")).select("__file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("files"))
    inside = Window.partitionBy("__file").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)
    before = splits.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(broadcast_within(files), "__file")
    places = before.select("__file", "__start", (F.col("files") + F.col("inside") - F.col("first") + 1).alias("__add"))
    placed = rows.join(broadcast_within(places), ["__file", "__start"])
    return placed.withColumn("__pos", F.col("__line") + F.col("__add")).drop("__file", "__start", "__line", "__add")


def read_contrastive(spark: SparkSession, paths: Sequence[str], maxload: int | None = None) -> DataFrame:
    """Example files in the given order, up to ``maxload`` examples in all."""
    kept, room = [], maxload
    for path in paths:
        part = read_records(spark, path, CONTRASTIVE)
        if maxload:
            part = in_file_order(part).filter(F.col("__pos") <= room).drop("__pos")
            room -= part.count()
        kept.append(part)
        if maxload and room <= 0:
            break
    out = kept[0]
    for part in kept[1:]:
        out = out.unionByName(part)
    return out


def read_ir_dataset(spark: SparkSession, folder: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus, queries and judgements of one collection."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl")
    queries = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl")
    qrels = (
        spark.read.option("sep", "\t")
        .option("header", True)
        .schema("query_id string, doc_id string, rel int")
        .csv(f"{folder}/qrels/{split}.tsv")
    )
    return corpus.withColumnRenamed("_id", "doc_id"), queries.withColumnRenamed("_id", "query_id"), qrels


def write_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON-lines sink."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def scored_name(stem: str, metrics: dict[str, float]) -> str:
    """``stem_k=v&k=v`` with three decimals."""
    return f"{stem}_" + "&".join(f"{k}={v:.3f}" for k, v in metrics.items())


def write_scored(df: DataFrame, metrics: DataFrame, folder: str, stem: str) -> str:
    """Write ``df`` below ``folder`` under a name that carries its one row of metrics."""
    path = f"{folder}/{scored_name(stem, metrics.first().asDict())}"
    write_records(df, path)
    return path


def dataset_catalog(spark: SparkSession, files: dict[str, dict[str, str]], exemplar_suffix: str | None = None) -> DataFrame:
    """``task, split, path, kind, instruction`` of files given by split and task; with a suffix also the exemplar path."""
    rows = []
    for split, paths in files.items():
        for task, path in paths.items():
            kind = "statement" if task in fixed.STATEMENT_TASKS else fixed.DEFAULT_TASK_KIND
            exemplar = None if exemplar_suffix is None else f"{task}{exemplar_suffix}"
            rows.append((task, split, path, kind, fixed.TASK_INSTRUCTIONS.get(task), exemplar))
    return spark.createDataFrame(
        rows, "task string, split string, path string, kind string, instruction string, exemplar_path string"
    )


def resolve_tasks(df: DataFrame, catalog: DataFrame, split: str) -> DataFrame:
    """Add path, kind and instruction to rows that name a task; the kind has a default."""
    known = catalog.filter(F.col("split") == split).drop("split")
    return df.join(known, "task", "left").withColumn("kind", F.coalesce("kind", F.lit(fixed.DEFAULT_TASK_KIND)))
