"""Column moments per training fold from one pass over the rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gradus.plans.folds import to_train_folds
from gradus.plans.ordering import melt

MAX_AGGS = 200


def group_moments(long: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Count, nulls, mean, central moment sums, minimum and maximum per key."""
    v = F.col(value)
    n = F.count(v)
    return long.groupBy(*keys).agg(
        n.alias("n"), F.count_if(v.isNull()).alias("n_null"), F.avg(v).alias("mean"),
        (F.var_pop(v) * n).alias("m2"),
        (F.coalesce(F.skewness(v), F.lit(0.0)) * n * F.pow(F.var_pop(v), 1.5)).alias("m3"),
        ((F.coalesce(F.kurtosis(v), F.lit(-3.0)) + 3.0) * n * F.pow(F.var_pop(v), 2)).alias("m4"),
        F.min(v).alias("min"), F.max(v).alias("max"),
    )


def merge_moments(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge moment rows that share `keys` about their common mean.

    Each input row is one group (at most ten test folds per key), so the
    second pass over them costs nothing and no large sums are subtracted.
    """
    centre = parts.groupBy(*keys).agg((F.sum(F.col("n") * F.col("mean")) / F.nullif(F.sum("n"), F.lit(0))).alias("_mu"))
    d = F.col("mean") - F.col("_mu")
    n, m2, m3, m4 = (F.col(c) for c in ("n", "m2", "m3", "m4"))
    return parts.join(centre, list(keys)).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("n_null").alias("n_null"), F.first("_mu").alias("mean"),
        F.sum(m2 + n * d * d).alias("m2"),
        F.sum(m3 + 3 * d * m2 + n * d * d * d).alias("m3"),
        F.sum(m4 + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d).alias("m4"),
        F.min("min").alias("min"), F.max("max").alias("max"),
    )


def fold_moments(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Moments of each numeric column over the training part of every fold.

    Rows are aggregated once per test fold; `by` adds group columns such as
    the class. Wide tables are cut into chunks of columns.
    """
    frames = []
    for i in range(0, len(cols), MAX_AGGS):
        long = melt(df, ["test_fold", *by], cols[i : i + MAX_AGGS])
        frames.append(group_moments(long, ["test_fold", *by, "feature"]))
    parts = frames[0]
    for f in frames[1:]:
        parts = parts.unionByName(f)
    return merge_moments(to_train_folds(parts), ["fold", *by, "feature"])


def sample_var() -> Column:
    return F.try_divide(F.col("m2"), F.col("n") - 1)


def skewness() -> Column:
    """Sample-size adjusted form g * ((n - 1) / n) ** 1.5; null at zero variance."""
    n = F.col("n").cast("double")
    g = F.try_divide(F.col("m3") / n, F.pow(F.col("m2") / n, 1.5))
    return g * F.pow((n - 1) / n, 1.5)


def kurtosis() -> Column:
    """Excess kurtosis m4 / s**4 - 3 with the sample variance; null at zero variance."""
    n = F.col("n").cast("double")
    k = F.try_divide(F.col("m4") / n, F.pow(F.col("m2") / n, 2.0))
    return k * F.pow((n - 1) / n, 2.0) - 3.0
