"""Session helpers: a tuned local session and the shared working folder."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

BROADCAST_ROWS = 2_000_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
OPEN_FILES = 16
ROW_GROUP = 8 << 20


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gradus")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def conf_value(spark: SparkSession, key: str) -> str | None:
    """A setting from the session, else from the application, else None."""
    value = spark.conf.get(key, None)
    if value is None:
        value = spark.sparkContext.getConf().get(key, None)
    return value or None


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    Only a local master, where one machine holds every task, may fall back to
    the machine's temporary folder.
    """
    base = conf_value(spark, "spark.checkpoint.dir")
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="gradus-")
    return os.path.join(base, "gradus", f"{label}-{uuid.uuid4().hex}")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """The frame as a parquet table in the shared folder, written once.

    For derived tables that several passes read: later passes scan only the
    columns they need, and a lost executor costs no recomputation. Shuffle
    files of the write go when it has ended. Each value of `by`, a column of
    few, gets a folder, so that a pass over one of them reads no other; a
    task keeps a file open for each up to OPEN_FILES, with small row groups,
    and sorts nothing.
    """
    spark = df.sparkSession
    path = work_dir(spark, label)
    conf = {CLEANUP: ("true", "false")} | ({WRITERS: (str(OPEN_FILES), "0")} if by else {})
    before = {key: spark.conf.get(key, default) for key, (_, default) in conf.items()}
    for key, (value, _) in conf.items():
        spark.conf.set(key, value)
    try:
        w = df.write.partitionBy(by).option("parquet.block.size", str(ROW_GROUP)) if by else df.write
        w.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def written_keys(keys: DataFrame, label: str) -> DataFrame:
    """Short rows to join a wide table with, written; up to BROADCAST_ROWS are broadcast, so that the wide rows stay where they are."""
    keys = written(keys, label)
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
