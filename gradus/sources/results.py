"""Trial documents: read, flatten, nest, zip bundles, write."""
from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradus.operators.analysis import make_ids, split_errors
from gradus.schemas import RESULT_DOC

# fixed values: phases of a trial; "train-eval" has a time but no metrics
PHASES = ("train", "val", "test")
TIMED = ("train", "val", "test", "train-eval")
KEYS = ("dataset_fold_id", "dataset_name", "target_type", "alg_name", "hparam_source", "trial_number", "alg_hparam_id")


def read_documents(spark: SparkSession, path: str, pattern: str = "*_results.json*", multi_line: bool = False) -> DataFrame:
    """Documents below a folder, one per line or (multi_line) one per file, with their path."""
    reader = spark.read.schema(RESULT_DOC).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    docs = reader.option("multiLine", multi_line).json(path)
    return docs.withColumn("results_bucket_path", F.col("_metadata.file_path"))


def with_path_keys(df: DataFrame, path: str = "results_bucket_path") -> DataFrame:
    """Dataset, algorithm and experiment from .../{dataset}/{algorithm}/{experiment}."""
    parts = F.split(path, "/")
    return df.withColumns({
        "path_dataset": F.element_at(parts, -3), "path_alg": F.element_at(parts, -2),
        "path_expt": F.regexp_replace(F.element_at(parts, -1), "\\.(zip|json)(\\.gz)?$", "")})


def metric_names(docs: DataFrame) -> list[tuple[str, str]]:
    """(phase, metric) pairs that occur: a handful of names."""
    phases = docs.select(F.explode("scorers").alias("phase", "m"))
    pairs = phases.select("phase", F.explode(F.map_keys("m")).alias("metric")).distinct()
    return sorted((r["phase"], r["metric"]) for r in pairs.collect())


def column_label(metric: str) -> str:
    return metric.strip().lower().replace(" ", "_")


def flatten_results(docs: DataFrame, metrics: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """One row per fold with {metric}__{phase} and time__{phase} columns.

    A document holds all folds of its trial, so its arrays are exploded in
    place and indexed by fold: no shuffle.
    """
    metrics = metric_names(docs) if metrics is None else metrics
    folds = docs.select("*", F.posexplode(F.col("timers")["train"]).alias("fold", "_t"))
    at = lambda a: F.try_element_at(a, F.col("fold") + 1)
    values: dict[str, Column] = {
        f"{column_label(m)}__{p}": at(F.col("scorers")[p][m]) for p, m in metrics if p in PHASES}
    values |= {f"time__{p}": at(F.col("timers")[p]) for p in TIMED}
    keyed = make_ids(folds.withColumns({
        "dataset_name": F.col("dataset.name"), "target_type": F.col("dataset.target_type"), "alg_name": F.col("model.name"),
        "hparam_seed": F.col("experiemnt_args.hparam_seed")}))
    extra = [c for c in ("results_bucket_path",) if c in docs.columns]
    return keyed.select(*KEYS, *[v.alias(k) for k, v in values.items()], *extra)


def error_rows(docs: DataFrame) -> DataFrame:
    seed = F.col("experiemnt_args.hparam_seed")
    extra = [c for c in ("results_bucket_path",) if c in docs.columns]
    return docs.select(
        F.col("dataset.name").alias("dataset_name"), F.col("model.name").alias("alg_name"), "hparam_source", "trial_number",
        F.format_string("%s__seed_%d__trial_%d", F.col("model.name"), seed, F.col("trial_number")).alias("alg_hparam_id"),
        "exception", *extra)


def parse_documents(docs: DataFrame, metrics: Sequence[tuple[str, str]] | None = None) -> tuple[DataFrame, DataFrame]:
    ok, bad = split_errors(docs)
    return flatten_results(ok, metrics), error_rows(bad)


def read_results(spark: SparkSession, path: str, pattern: str = "*_results.json*", multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(results, errors) of all documents below a folder."""
    return parse_documents(read_documents(spark, path, pattern, multi_line))


def nest_results(results: DataFrame, exception: Column | None = None) -> DataFrame:
    """Flat rows back to one document per trial, arrays indexed by fold.

    The arrays reach to the trial's last fold. A fold without a row is null in
    every array.
    """
    value_cols = [c for c in results.columns if "__" in c]
    keys = ["dataset_name", "target_type", "alg_name", "hparam_source", "trial_number"]
    per = results.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("fold", F.struct(*value_cols)))).alias("m"), F.max("fold").alias("_last"))

    def series(c: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col("_last").cast("int")), lambda f: F.try_element_at(F.col("m"), f.cast("bigint"))[c])

    timers, scorers = [], {}
    for c in value_cols:
        metric, phase = c.rsplit("__", 1)
        if metric == "time":
            timers += [F.lit(phase), series(c)]
        else:
            scorers.setdefault(phase, []).extend([F.lit(metric), series(c)])
    exc = F.lit("None") if exception is None else exception
    none_map = F.lit(None).cast("map<string,string>")
    dataset = F.struct(
        F.col("dataset_name").alias("name"), F.lit(None).cast("array<int>").alias("cat_idx"), F.lit(None).cast("array<int>").alias("cat_dims"),
        "target_type", F.lit(None).cast("int").alias("num_classes"), F.lit(None).cast("int").alias("num_features"),
        F.lit(None).cast("bigint").alias("num_instances"), F.lit(None).cast("string").alias("split_source"))
    return per.select(
        dataset.alias("dataset"), F.struct(F.col("alg_name").alias("name"), none_map.alias("params"), none_map.alias("args")).alias("model"),
        F.struct(F.lit(0).alias("hparam_seed")).alias("experiemnt_args"), "hparam_source", F.col("trial_number").cast("int").alias("trial_number"),
        exc.alias("exception"), F.create_map(*timers).alias("timers"),
        F.create_map(*[x for p, kv in scorers.items() for x in (F.lit(p), F.create_map(*kv))]).alias("scorers"))


def write_results_json(docs: DataFrame, path: str, compress: bool = False) -> None:
    """One JSON document per line; an existing target is an error."""
    w = docs.write.mode("errorifexists")
    (w.option("compression", "gzip") if compress else w).json(path)


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").partitionBy("alg_name").parquet(path)


# --- zip bundles ----------------------------------------------------------------------
def read_zip_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content")


def unzip_members(bundles: DataFrame, ending: str = "results.json") -> DataFrame:
    """(path, member, json) of the bundle members with the given name ending."""
    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if name.endswith(ending):
                            yield pd.DataFrame({"path": [path], "member": [name], "json": [z.read(name).decode()]})

    return bundles.select("path", "content").mapInPandas(unpack, "path string, member string, json string")


def documents_from_json(members: DataFrame) -> DataFrame:
    docs = members.select(F.from_json("json", RESULT_DOC).alias("d"), F.col("path").alias("results_bucket_path"))
    return docs.select("d.*", "results_bucket_path")


def read_results_zip(bundles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, errors) of zip bundles given as (path, content) rows."""
    return parse_documents(documents_from_json(unzip_members(bundles)))


def zip_documents(docs: DataFrame, path: Column) -> DataFrame:
    """Each document as a zip bundle (path, content) with a second, unrelated member."""
    @F.pandas_udf("binary")
    def pack(text: pd.Series) -> pd.Series:
        def one(t: str) -> bytes:
            buf = io.BytesIO()
            with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("trial_results.json", t)
                z.writestr("log.txt", "done")
            return buf.getvalue()

        return text.map(one)

    return docs.select(path.alias("path"), pack(F.to_json(F.struct(*docs.columns))).alias("content"))


# --- consolidated tables -------------------------------------------------------------------
def append_consolidated(old: DataFrame, new: DataFrame, order: Sequence[str] = ("dataset_fold_id", "alg_hparam_id")) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True).orderBy(*order)
