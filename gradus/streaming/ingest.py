"""Incremental ingestion of trial documents and running meters.

Every sink is written per micro-batch into its own folder with overwrite, so
a batch that is replayed after a failure replaces itself.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from gradus.schemas import RESULT_DOC
from gradus.sources.results import parse_documents


def _append(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything available, then stop; state and progress stay in the checkpoint."""
    q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def ingest_documents(
    spark: SparkSession, source: str, target: str, checkpoint: str, metrics: Sequence[tuple[str, str]],
) -> None:
    """New documents below `source` to {target}/results and {target}/errors, each once.

    The metric columns are fixed up front so that all batches agree.
    """
    docs = spark.readStream.schema(RESULT_DOC).option("pathGlobFilter", "*.json*").json(source)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        results, errors = parse_documents(batch, metrics)
        _append(results, f"{target}/results", batch_id)
        _append(errors, f"{target}/errors", batch_id)
        batch.unpersist()

    run(docs, sink, checkpoint)


def read_ingested(spark: SparkSession, target: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{target}/{table}").drop("batch")


# fixed value: the columns that identify a trial's fold
UPLOAD_KEY = ("alg_name", "dataset_fold_id", "alg_hparam_id")


def drop_duplicate_uploads(df: DataFrame) -> DataFrame:
    """One row per trial and fold, in batch or stream."""
    return df.dropDuplicates(list(UPLOAD_KEY))


def ingest_distinct(spark: SparkSession, source: str, schema, target: str, checkpoint: str) -> None:
    """Stream flat result rows, keeping the first upload of each trial and fold.

    The keys seen so far are state partitioned by key.
    """
    rows = drop_duplicate_uploads(spark.readStream.schema(schema).parquet(source))
    run(rows, lambda b, i: _append(b, target, i), checkpoint)


def running_meters(spark: SparkSession, source: str, schema, target: str, checkpoint: str, key: str, value: str, n: str, glob: str = "*.parquet") -> None:
    """Sum, count and average per key, updated as rows arrive; the latest state wins."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", 1).parquet(source)
    state = rows.groupBy(key).agg(F.sum(F.expr(f"{value} * ({n})")).alias("sum"), F.sum(F.expr(n)).alias("count"))
    run(state, lambda b, i: _append(b.withColumn("version", F.lit(i)), target, i), checkpoint, "update")


def latest_meters(spark: SparkSession, target: str, key: str) -> DataFrame:
    rows = spark.read.parquet(target)
    last = rows.groupBy(key).agg(F.max(F.struct("version", "sum", "count")).alias("m"))
    return last.select(key, F.col("m.sum").alias("sum"), F.col("m.count").alias("count"), (F.col("m.sum") / F.col("m.count")).alias("avg"))
