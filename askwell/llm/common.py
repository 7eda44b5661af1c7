"""Helpers that several operators share: shared-folder checkpoints, text blocks, 64-bit mixing."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: exactly these six bytes.
BLANKS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Text handled at once by a Python task.
BLOCK_BYTES = 1 << 20

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only a local session
    without that setting gets a temporary one.
    """
    context = spark.sparkContext
    folder = spark.conf.get(SETTING, None) or context.getConf().get(SETTING, None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="askwell-llm-")
        atexit.register(shutil.rmtree, folder, True)
        spark.conf.set(SETTING, folder)
    return folder.rstrip("/")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate rows that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and cut off from its lineage, in the shared folder."""
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let executors delete the shuffle files of rounds that nothing refers to any more.

    Spark does so when the driver collects garbage, which a job of many small
    rounds hardly makes it do; each round has files in every partition.
    """
    gc.collect()
    spark._jvm.System.gc()


def blocks(sizes: Sequence[int], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges whose sizes add up to about ``limit``; a larger item has a range of its own."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def utf8(texts: Sequence) -> list[bytes]:
    """Texts as bytes; null is empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def unsigned_crc32(value: Column) -> Column:
    """CRC-32 of a value's text, as unsigned long."""
    return F.crc32(value.cast("string").cast("binary"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts; sizes shards, never the result."""
    return int(docs.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def broadcast_within(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` (computed already) marked for broadcast if its counted rows are within the bound."""
    return F.broadcast(df) if df.count() <= rows else df


def null_safe(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    """Equality of columns of the same names where null equals null."""
    same = F.lit(True)
    for c in columns:
        same = same & left[c].eqNullSafe(right[c])
    return same
