"""Fold arithmetic: one `test_fold` per row stands for all ten splits.

Row r is the test part of fold test_fold, the validation part of the fold
before it, and a training row of the other folds. Statistics are gathered
once per test_fold and summed into the training part of each fold, so the
rows themselves are never copied per fold unless the output needs them.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

N_FOLDS = 10


def part_of(fold: Column, test_fold: Column | str = "test_fold", n: int = N_FOLDS) -> Column:
    tf = F.col(test_fold) if isinstance(test_fold, str) else test_fold
    return F.when(tf == fold, "test").when(tf == F.pmod(fold + 1, F.lit(n)), "val").otherwise("train")


def all_folds(n: int = N_FOLDS) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def assign_parts(df: DataFrame, n: int = N_FOLDS) -> DataFrame:
    """Each row once per fold with its part; a generator, not a join."""
    return df.withColumn("fold", all_folds(n)).withColumn("part", part_of(F.col("fold"), "test_fold", n))


def to_train_folds(stats: DataFrame, n: int = N_FOLDS) -> DataFrame:
    """Rows of a per-test_fold table, once per fold that trains on them."""
    folds = stats.withColumn("fold", all_folds(n))
    return folds.filter(part_of(F.col("fold"), "test_fold", n) == "train").drop("test_fold")


def sum_over_train(stats: DataFrame, keys: Sequence[str], sums: Sequence[str], n: int = N_FOLDS) -> DataFrame:
    """Mergeable sums per (keys, test_fold) to sums per (keys, training fold)."""
    return to_train_folds(stats, n).groupBy("fold", *keys).agg(*[F.sum(c).alias(c) for c in sums])


def train_weights(df: DataFrame, n: int = N_FOLDS) -> list[Column]:
    """Aggregates w0..w9: how many rows of a group train each fold."""
    return [
        F.count_if(part_of(F.lit(i), "test_fold", n) == "train").alias(f"w{i}") for i in range(n)
    ]


def weight_fold(weight: Column) -> Column:
    """Fold number back from a weight column's name."""
    return F.substring(weight, 2, 10).cast("int")
