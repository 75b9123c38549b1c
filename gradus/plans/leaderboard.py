"""From raw trial logs to tuned, normalised and ranked tables.

All metrics are tuned in one aggregate over the trials, so the trial log is
scanned and shuffled once however many metrics are asked for. What follows
works on one row per (algorithm, dataset fold); a window over a dataset fold
holds one row per algorithm.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gradus.functions import names
from gradus.functions.scalar import safe_div
from gradus.operators import analysis as A

RUNTIME = "train_per_1000_inst"


def analysis_table(results: DataFrame, mf: DataFrame) -> DataFrame:
    """Classification results with runtime per 1000 rows, display name and family."""
    df = A.filter_classification(results)
    df = A.add_runtime_per_1000(A.join_num_instances(df, mf))
    return A.alg_type(A.display_name(df))


def _best(metric: str, payload: Sequence[str]) -> Column:
    """The payload of the best trial by validation metric, first by trial id on ties.

    The minimum of a struct combines in the map tasks, so hot groups shrink
    to one row per task before the shuffle.
    """
    val = F.col(f"{metric}__val")
    key = -val if names.MAXIMIZE[metric] else val
    row = F.struct(key.alias("_k"), "alg_hparam_id", "trial_number", *[c for c in payload if c not in ("alg_hparam_id", "trial_number")])
    return F.min(F.when(val.isNotNull(), row))


def tuned_metrics(df: DataFrame, metrics: Sequence[str], payload: Sequence[str] | None = None) -> DataFrame:
    """One row per (algorithm, fold) with the best trial of each metric.

    `payload` limits the columns carried along. The columns of the first metric's trial stay as they are; each metric adds
    its test value and runtime, null where it has no validated trial.
    """
    keys = [c for c in ("alg_name", "alg_type", "dataset_fold_id", "dataset_name") if c in df.columns]
    own = [c for c in df.columns if c not in keys] if payload is None else list(payload)
    aggs = [
        _best(m, own if i == 0 else [f"{m}__test", RUNTIME]).alias(f"_b_{m}") for i, m in enumerate(metrics)
    ]
    best = df.groupBy(*keys).agg(*aggs)
    first = metrics[0]
    cols = [F.col(f"_b_{first}.{c}").alias(c) for c in own]
    # under another metric's name, as the first metric's own columns stay
    cols += [F.col(f"_b_{m}.{m}__test").alias(f"_test_{m}") for m in metrics]
    cols += [F.col(f"_b_{m}.{RUNTIME}").alias(f"_run_{m}") for m in metrics]
    cols += [F.col(f"_b_{m}").isNotNull().alias(f"_has_{m}") for m in metrics]
    return best.select(*keys, *cols)


def _place(df: DataFrame, key: str, value: str, name: str, rank: str, metric: str) -> dict[str, Column]:
    """Bounds, normalised value and rank within `key`, one shuffle for all of them."""
    whole = W.partitionBy(key)
    order = F.col(value).desc_nulls_last() if names.MAXIMIZE[metric] else F.col(value).asc_nulls_last()
    lo, hi = F.min(value).over(whole), F.max(value).over(whole)
    return {
        f"{name}_min": lo, f"{name}_max": hi,
        f"normalized_{name}": safe_div(F.col(value) - lo, hi - lo),
        rank: F.when(F.col(value).isNotNull(), F.rank().over(whole.orderBy(order))),
    }


def merged_folds(df: DataFrame, metrics: Sequence[str] = names.RESULT_METRICS) -> DataFrame:
    """Tuned rows per (algorithm, fold) with every metric's bounds, normalised value and rank.

    Plain metric columns are those of the first metric's trial.
    """
    tuned = tuned_metrics(df, metrics)
    placed: dict[str, Column] = {}
    for m in metrics:
        placed |= _place(tuned, "dataset_fold_id", f"_test_{m}", f"{m}__test", f"{m}_rank", m)
    out = tuned.withColumns(placed).filter(_all_true(metrics))
    return out.drop(*[f"{p}_{m}" for m in metrics for p in ("_test", "_run", "_has")])


def _all_true(metrics: Sequence[str]) -> Column:
    """Inner-join semantics: the row exists for every metric."""
    return reduce(lambda a, b: a & b, [F.col(f"_has_{m}") for m in metrics])


def merged_datasets(df: DataFrame, metrics: Sequence[str] = names.RESULT_METRICS) -> DataFrame:
    """Fold means and medians per (algorithm, dataset), normalised and ranked.

    The spread of the normalised metric is the standard deviation over the
    range of the dataset means, since the bounds are constants per dataset.
    """
    tuned = tuned_metrics(df, metrics, [f"{metrics[0]}__test", RUNTIME, "time__train"])
    aggs = [F.median("time__train").alias("time__train_median"), F.avg("time__train").alias("time__train_mean")]
    for m in metrics:
        aggs += [
            F.median(f"_test_{m}").alias(f"{m}__test_median"),
            F.round(F.avg(f"_test_{m}"), 9).alias(f"{m}__test_mean"),
            F.stddev_samp(f"_test_{m}").alias(f"_sd_{m}"),
            F.median(f"_run_{m}").alias(f"{RUNTIME}_median_{m}"),
            F.avg(f"_run_{m}").alias(f"{RUNTIME}_mean_{m}"), F.max(f"_has_{m}").alias(f"_has_{m}"),
        ]
    keys = [c for c in ("alg_name", "alg_type", "dataset_name") if c in df.columns]
    out = tuned.groupBy(*keys).agg(*aggs)
    placed: dict[str, Column] = {}
    for m in metrics:
        placed |= _place(out, "dataset_name", f"{m}__test_mean", f"{m}__test_mean", f"{m}_rank_mean", m)
    out = out.withColumns(placed).filter(_all_true(metrics))
    return out.withColumns({
        f"normalized_{m}__test_std": safe_div(F.col(f"_sd_{m}"), F.col(f"{m}__test_mean_max") - F.col(f"{m}__test_mean_min"))
        for m in metrics
    }).drop(*[f"{p}_{m}" for m in metrics for p in ("_sd", "_has")])


def leaderboard(results: DataFrame, mf: DataFrame, metric: str = "accuracy", with_default: bool = False) -> DataFrame:
    """The rank table of one metric."""
    df = analysis_table(results, mf)
    if with_default:
        df = A.append_default_rows(df)
    return A.rank_table(merged_datasets(df, [metric]), metric)


def cleaned_tables(results: DataFrame, mf: DataFrame) -> dict[str, DataFrame]:
    """The four result tables: fold and dataset level, without and with default rows."""
    df = analysis_table(results, mf)
    both = A.append_default_rows(df)
    return {
        "tuned_fold_results": merged_folds(df),
        "tuned_aggregated_results": merged_datasets(df),
        "tuned_fold_results_with_default": merged_folds(both),
        "tuned_aggregated_results_with_default": merged_datasets(both),
    }


def featurised_correlations(results: DataFrame, mf: DataFrame, metric: str, as_abs: bool = False) -> DataFrame:
    """Correlation of imputed metafeatures with the tuned test metric."""
    tuned = A.tuned_alg_perf(A.filter_classification(results), metric)
    return A.feature_corrs(A.join_tuned_with_metafeatures(tuned, A.impute_median(mf)), metric, as_abs)


def finished_metafeatures(mf: DataFrame) -> DataFrame:
    """Dataset-level medians with the instance total and rounded counts."""
    return A.finish_metafeatures(A.agg_metafeatures(mf))
