"""Table files: CSV and text variants, LIBSVM, dataset folders."""
from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from gradus.plans.ordering import BUCKET, prefix_sums


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unknown format: {fmt}")


def read_metadata(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_typed_csv(spark: SparkSession, path: str, n_features: int) -> DataFrame:
    """No header; an int label, then floats."""
    schema = ", ".join(["label INT", *[f"f{i} FLOAT" for i in range(n_features)]])
    return spark.read.schema(schema).csv(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("row_id BIGINT").csv(path)


def read_text_indexed(spark: SparkSession, path: str, per_file: bool = False) -> DataFrame:
    """(value, row_index): text lines with their position in path order, or within their file.

    A split of a file is one bucket, so no task holds more than a split.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_mid"))
    if per_file:
        tagged = lines.withColumn(BUCKET, F.col("_start"))
        out = prefix_sums(tagged, ["file"], ["_mid"], {"row_index": F.lit(1).cast("bigint")}, inclusive=False)
    else:
        tagged = lines.withColumn(BUCKET, F.format_string("%s:%020d", "file", F.col("_start")))
        out = prefix_sums(tagged, [], ["_mid"], {"row_index": F.lit(1).cast("bigint")}, inclusive=False)
    return out.select("value", "row_index")


def read_csv_skip(spark: SparkSession, path: str, n: int, schema: str) -> DataFrame:
    """Header-less CSV after the first n lines of each file."""
    if n == 1:
        return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
    body = read_text_indexed(spark, path, per_file=True).filter(F.col("row_index") >= n)
    return body.select(F.from_csv("value", schema).alias("r")).select("r.*")


def read_ltr_tsv(spark: SparkSession, path: str, n_features: int) -> DataFrame:
    """Ranking table: first line skipped, label, query id, features.

    Lines in which the tab was written as backslash-t are repaired.
    """
    body = read_text_indexed(spark, path, per_file=True).filter("row_index > 0")
    cells = F.split(F.replace(F.col("value"), F.lit("\\t"), F.lit("\t")), "\t")
    return body.select(cells.alias("c")).select(
        F.col("c")[0].cast("int").alias("label"), F.col("c")[1].cast("bigint").alias("query_id"),
        *[F.col("c")[i + 2].cast("float").alias(f"f{i}") for i in range(n_features)])


def zip_by_position(a: DataFrame, b: DataFrame) -> DataFrame:
    """Lines of two text sources paired by row_index (see read_text_indexed)."""
    return a.withColumnRenamed("value", "left").join(b.withColumnRenamed("value", "right"), "row_index")


def read_libsvm(spark: SparkSession, path: str, n_features: int, dense: bool = True) -> DataFrame:
    df = spark.read.format("libsvm").option("numFeatures", n_features).load(path)
    return df.withColumn("features", vector_to_array("features")) if dense else df


def write_libsvm(df: DataFrame, label: str, cols: Sequence[str], path: str) -> None:
    vec = array_to_vector(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]))
    df.select(F.col(label).cast("double").alias("label"), vec.alias("features")).write.format("libsvm").save(path)


def export_split_csv(df: DataFrame, path: str, features: Sequence[str], y: str) -> None:
    """Train and validation matrices and labels as CSV folders."""
    for part in ("train", "val"):
        rows = df.filter(F.col("part") == part)
        rows.select("row_id", *features).write.mode("errorifexists").csv(f"{path}/X_{part}")
        rows.select("row_id", y).write.mode("errorifexists").csv(f"{path}/y_{part}")


# --- dataset folders ---------------------------------------------------------------------
PARTS = ("X", "y", "splits", "metadata")


def write_dataset(df: DataFrame, meta: dict, path: str, overwrite: bool = False) -> None:
    """A dataset folder: features, labels, test fold of each row, metadata."""
    mode = "overwrite" if overwrite else "errorifexists"
    y = meta["target"]
    df.drop(y, "test_fold").write.mode(mode).parquet(f"{path}/X")
    df.select("row_id", y).write.mode(mode).parquet(f"{path}/y")
    df.select("row_id", "test_fold").write.mode(mode).parquet(f"{path}/splits")
    spark = df.sparkSession
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/metadata")


def read_dataset(spark: SparkSession, path: str, features: str | None = None) -> tuple[DataFrame, dict]:
    """Rows and metadata of a dataset folder; a missing part is an error naming it."""
    frames = {}
    for part in PARTS:
        try:
            frames[part] = spark.read.text(f"{path}/{part}") if part == "metadata" else spark.read.parquet(f"{path}/{part}")
        except AnalysisException as e:
            raise FileNotFoundError(f"dataset folder {path} lacks its part {part}") from e
    meta = json.loads(frames["metadata"].first()["value"])
    rows = frames["X"].join(frames["y"], "row_id").join(frames["splits"], "row_id")
    return rows, meta
