"""Object listings, work lists and logs of what was done."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

SUFFIX = 23  # fixed value: length of "_MMddyy_HHmmss_xxxx.zip"


def filter_paths(listing: DataFrame, substr: str) -> DataFrame:
    return listing.filter(F.col("path").contains(substr))


def experiment_log(listing: DataFrame) -> DataFrame:
    """Dataset, algorithm and experiment of each object path."""
    parts = F.split("path", "/")
    name = F.element_at(parts, 4)
    stem = F.when(F.length(name) < SUFFIX, name).otherwise(F.substring(name, F.lit(1), F.length(name) - SUFFIX))
    return listing.select(
        F.element_at(parts, 2).alias("dataset_name"), F.element_at(parts, 3).alias("alg_name"), stem.alias("experiment")
    )


def ingest_new(listing: DataFrame, results: DataFrame, errors: DataFrame) -> DataFrame:
    """Paths that neither the results nor the errors table has seen."""
    from gradus.operators.analysis import processed_paths

    done = processed_paths(results, errors).withColumnRenamed("results_bucket_path", "path")
    return listing.join(done, "path", "left_anti")


def read_task_ids(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return task_ids(spark.read.text(path))


def task_ids(lines: DataFrame, col: str = "value") -> DataFrame:
    """One id per line: trimmed, blank lines dropped."""
    text = F.trim(F.col(col))
    return lines.select(text.alias("t")).filter(F.length("t") > 0).select(F.col("t").cast("int").alias("task_id"))


def list_datasets(catalog: DataFrame) -> DataFrame:
    """Distinct dataset names, sorted and numbered from 1."""
    from gradus.plans.ordering import sorted_codes

    codes = sorted_codes(catalog.select("dataset_name"), [], "dataset_name")
    return codes.select((F.col("code") + 1).alias("number"), "dataset_name").orderBy("number")


def pending_datasets(catalog: DataFrame, done: DataFrame, overwrite: bool = False) -> DataFrame:
    return catalog if overwrite else catalog.join(done, "dataset_name", "left_anti")
