"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def build_session(app: str = "askwell", cores: str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Local session for tests and timings; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread_out(df: DataFrame) -> DataFrame:
    """``df`` in at least as many parts as there are cores.

    A small table in few files would otherwise leave cores idle; a table with
    enough splits stays where it is. Filters and column choice still reach the scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def broadcast_within(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are within the bound."""
    return F.broadcast(df) if df.count() <= rows else df


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder every executor can reach: below the one the cluster names.

    Only a local session, where none is named, gets a temporary one.
    """
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="askwell-")
        atexit.register(shutil.rmtree, folder, True)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once, as a table in the shared folder.

    What reads it next gets column pruning, and a lost executor costs a
    re-read instead of a recomputation.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
