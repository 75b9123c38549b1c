"""A training corpus from raw documents in five stages; each stage's table is written and read again as the next one's input."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradus.llm import apportion, hyperminhash, robust, unigram, windows
from gradus.llm.text import fresh
from gradus.session import written, written_keys

PIECES = "piece_bpe_32k.model"

#: Verdicts come from robust estimates and hash order over several passes, which SQL cannot say; the tests hold the
#: pipeline against brute force.
ORACLE_SQL = None


def _matching(docs: DataFrame, keys: DataFrame, of: Column, how: str) -> DataFrame:
    """`docs` semi- or anti-joined with the one column of `keys` on the expression `of`, whatever the columns' names."""
    name = fresh(docs.columns, "_key")
    return docs.join(written_keys(keys.toDF(name), "keys"), of == F.col(name), how)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules or lie far out of their language and source."""
    rejected = robust.quality(docs).filter("not kept").select("row").distinct()
    return _matching(docs, rejected, F.xxhash64("doc_id", "lang", "source", "text"), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of texts alike at 0.8 on five-word shingles, and a row of each id."""
    found = written(hyperminhash.near_duplicates(docs, size=5, percent=80), "classes")
    rest = _matching(docs, found.filter("not kept").select("doc_id").distinct(), F.col("doc_id"), "left_anti")
    again = found.filter("kept").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    once = _matching(rest, again, F.col("doc_id"), "left_semi").dropDuplicates(["doc_id"])
    return _matching(rest, again, F.col("doc_id"), "left_anti").unionByName(once)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that are near copies of an earlier document's; n_chars follows the text."""
    cut = windows.remove_passages(docs)
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns) if "n_chars" in docs.columns else cut


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes its words, rounded by a hash of its id; documents that the mix leaves go."""
    mixed = apportion.mix(docs).dropDuplicates(["doc_id"])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(apportion.SEED)), F.lit(1 << 20)) / float(1 << 20)
    key, times = fresh(docs.columns, "_key"), fresh(docs.columns, "_times")
    mixed = mixed.select(F.col("doc_id").alias(key), F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + draw).cast("int").alias(times))
    joined = docs.join(mixed.filter(F.col(times) > 0), F.col("doc_id").eqNullSafe(F.col(key)))
    copies = F.explode(F.array_repeat(F.lit(0), F.col(times))).alias(fresh(docs.columns, "_copy"))
    return joined.select(*docs.columns, copies).select(*docs.columns)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every kept text, and whether they decode to it."""
    return unigram.round_trip(docs, public_tokenizers.path(PIECES))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("piece_ids", piece_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; returns what the last one returns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
