"""Result-table analytics: derivations, tuning, ranking, normalising, reports.

A "results" frame has one row per (dataset fold, algorithm, trial). Tuned
frames keep one row per (algorithm, dataset fold), so a window over one
dataset fold holds at most one row per algorithm. Reductions over raw trials
use aggregates, or row_number() <= k, which Spark limits before the shuffle.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gradus.functions import names
from gradus.functions.scalar import lookup, safe_div
from gradus.plans.ordering import melt, quantiles, row_index


# --- B: projections, filters, derivations -----------------------------------
def filter_classification(df: DataFrame) -> DataFrame:
    return df.filter(F.col("target_type").isin("binary", "classification"))


def num_instances(mf: DataFrame) -> DataFrame:
    return mf.select(F.col("dataset_name").alias("dataset_fold_id"), F.col("f__general_nr_inst").alias("num_inst"))


def lookup_results(df: DataFrame, alg: str, source: str, dataset: str, cols: Sequence[str]) -> DataFrame:
    hit = (F.col("alg_name") == alg) & (F.col("hparam_source") == source) & (F.col("dataset_name") == dataset)
    return df.filter(hit).select(*cols)


def add_runtime_per_1000(df: DataFrame) -> DataFrame:
    return df.withColumn("train_per_1000_inst", safe_div(F.lit(1000.0) * F.col("time__train"), F.col("num_inst")))


def display_name(df: DataFrame) -> DataFrame:
    """Raw to display algorithm name; an unknown name fails the job."""
    unknown = F.raise_error(F.concat(F.lit("unknown algorithm name: "), F.col("alg_name"))).cast("string")
    return df.withColumn("alg_name", F.coalesce(lookup(names.DISPLAY_NAMES, F.col("alg_name")), unknown))


def alg_type(df: DataFrame) -> DataFrame:
    unknown = F.raise_error(F.concat(F.lit("algorithm without a family: "), F.col("alg_name"))).cast("string")
    return df.withColumn("alg_type", F.coalesce(lookup(names.FAMILIES, F.col("alg_name")), unknown))


def default_rows(df: DataFrame, single: Sequence[str] = ("TabPFNModel", "LinearModel")) -> DataFrame:
    """Default-parameter rows as algorithms of their own.

    `single` are substrings of algorithms with one parameter set. Display
    names come first, so "TabPFN" rows stay unless "TabPFN" is listed.
    """
    named = df.filter(F.col("hparam_source") == "default").withColumn(
        "alg_name", F.concat("alg_name", F.lit(" (default)"))
    )
    return named.filter(~reduce(lambda a, b: a | b, [F.col("alg_name").contains(s) for s in single]))


def fold_base_name(col: str) -> Column:
    """Drop "__fold_N" (8 characters, folds have one digit)."""
    return F.expr(f"substring({col}, 1, length({col}) - 8)")


ROUNDED = ("total_num_instances", "nr_attr", "nr_bin", "nr_cat", "nr_num", "nr_class")


def finish_metafeatures(df: DataFrame) -> DataFrame:
    out = df.withColumn("f__general_total_num_instances", F.col("f__general_nr_inst") / F.lit(0.8))
    cols = [f"f__general_{c}" for c in ROUNDED if f"f__general_{c}" in out.columns]
    return out.withColumns({c: F.bround(c, 0) for c in cols})


def drop_hist(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if "hist" not in c])


def select_families(df: DataFrame, families: Sequence[str]) -> DataFrame:
    keep = tuple(f"f__{f}" for f in families)
    return df.select(*[c for c in df.columns if not c.startswith("f__") or c.startswith(keep)])


def clean_dataset_name(col: str) -> Column:
    """"openml__a_b__12" to "a-b (12)"."""
    p = F.split(F.col(col), "__")
    return F.concat(F.translate(F.element_at(p, 2), "_", "-"), F.lit(" ("), F.element_at(p, 3), F.lit(")"))


def style(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "marker": F.coalesce(lookup(names.MARKERS, F.col("alg_name")), F.lit("x")),
        "color": F.coalesce(lookup(names.COLORS, F.col("alg_type")), F.lit("gray")),
    })


def rename_axes(df: DataFrame, axes: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in axes.items() if k in df.columns})


def select_points(df: DataFrame, dataset_ids: DataFrame, x: str, y: str) -> DataFrame:
    """Rows of the selected datasets with the two chosen axes."""
    return df.join(dataset_ids, "dataset_id", "left_semi").select("dataset_id", "alg_name", F.col(x).alias("x"), F.col(y).alias("y"))


def split_errors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = F.col("exception") == "None"
    return df.filter(ok).drop("exception"), df.filter(~ok)


def make_ids(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "dataset_fold_id": F.concat("dataset_name", F.lit("__fold_"), "fold"),
        "alg_hparam_id": F.format_string("%s__seed_%d__trial_%d", "alg_name", "hparam_seed", "trial_number"),
    })


def openml_name(name: Column, task_id: Column) -> Column:
    return F.concat(F.lit("openml__"), name, F.lit("__"), task_id)


def hparam_source(trial: Column, seed: Column, sampler: bool = False) -> Column:
    if sampler:
        return F.concat(F.lit("sampler_"), trial)
    return F.when(trial == 0, "default").otherwise(F.concat(F.lit("random_"), trial, F.lit("_s"), seed))


def assert_no_nulls(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row of null counts; raises in the job when any is above zero."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return counts.select(*[
        F.when(F.col(c) == 0, F.col(c)).otherwise(
            F.raise_error(F.lit(f"nulls in column {c}")).cast("bigint")).alias(c) for c in cols
    ])


def supported(plan: DataFrame) -> DataFrame:
    """Drop (algorithm, target type) pairs the algorithm cannot learn."""
    bad = [
        (F.col("alg_name") == a) & F.col("target_type").isin(*kinds) for a, kinds in names.UNSUPPORTED.items()
    ]
    return plan.filter(~reduce(lambda a, b: a | b, bad))


# --- F: tuning, ranks, normalising ------------------------------------------
def _better_first(metric_col: str, metric: str) -> Column:
    return F.col(metric_col).desc_nulls_last() if names.MAXIMIZE[metric] else F.col(metric_col).asc_nulls_last()


def tuned_alg_perf(df: DataFrame, metric: str, group_col: str = "alg_name") -> DataFrame:
    """The trial with the best validation metric per (algorithm, dataset fold).

    Ties go to the first row by (alg_hparam_id, trial_number). Spark keeps one
    row per group in every map task before it shuffles, so a group that holds
    a third of the rows sends no more than any other.
    """
    val = f"{metric}__val"
    w = W.partitionBy(group_col, "dataset_fold_id").orderBy(_better_first(val, metric), "alg_hparam_id", "trial_number")
    return df.filter(F.col(val).isNotNull()).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def rank_algs(df: DataFrame, key: str, value: str, metric: str, out: str) -> DataFrame:
    """Competition rank per dataset (fold); the input has one row per algorithm and key."""
    w = W.partitionBy(key).orderBy(_better_first(value, metric))
    return df.withColumn(out, F.when(F.col(value).isNotNull(), F.rank().over(w)))


def bounds(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(value).alias(f"{value}_min"), F.max(value).alias(f"{value}_max"))


def with_bounds(df: DataFrame, key: str, value: str) -> DataFrame:
    """Group minimum and maximum on every row.

    An aggregate joined back, not a window: the aggregate combines before its
    shuffle and the join can split a hot key, which a window cannot.
    """
    return df.join(bounds(df, key, value), key, "left")


def min_max(value: Column, lo: Column, hi: Column) -> Column:
    """(v - min) / (max - min); null when the range is zero."""
    return safe_div(value - lo, hi - lo)


def normalize(df: DataFrame, key: str, value: str) -> DataFrame:
    return with_bounds(df, key, value).withColumn(
        f"normalized_{value}", min_max(F.col(value), F.col(f"{value}_min"), F.col(f"{value}_max"))
    )


def normalize_with(df: DataFrame, limits: DataFrame, key: str, value: str, lo: str, hi: str) -> DataFrame:
    """Normalise by given bounds per key; values may leave [0, 1]."""
    return df.join(limits.select(key, lo, hi), key, "left").withColumn(
        f"normalized_{value}", min_max(F.col(value), F.col(lo), F.col(hi))
    )


def running_best(df: DataFrame, keys: Sequence[str], trial: str, value: str, maximize: bool | Column) -> DataFrame:
    """Best objective up to each trial; `maximize` may be a condition that is the same for all rows of a key.

    Two levels, blocks of 1000 trials, so a study of any length is scanned in
    bounded windows.
    """
    sign = F.when(maximize, -1.0).otherwise(1.0) if isinstance(maximize, Column) else F.lit(-1.0 if maximize else 1.0)
    blocks = df.withColumns({"_b": F.floor(F.col(trial) / 1000), "_s": sign}).withColumn("_v", F.col(value) * F.col("_s"))
    inside = W.partitionBy(*keys, "_b").orderBy(trial).rangeBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    totals = blocks.groupBy(*keys, "_b").agg(F.min("_v").alias("_t"))
    offs = totals.select(*keys, "_b", F.min("_t").over(before).alias("_o"))
    return (
        blocks.withColumn("_i", F.min("_v").over(inside))
        .join(offs, [*keys, "_b"])
        .withColumn("best_so_far", F.least("_i", "_o") * F.col("_s"))
        .drop("_i", "_o", "_b", "_s", "_v")
    )


def first_seen_id(df: DataFrame, col: str, position: str, out: str = "dataset_id") -> DataFrame:
    """Dense id per distinct value, by the smallest position it occurs at."""
    firsts = df.groupBy(col).agg(F.min(position).alias("first_at"))
    return row_index(firsts, "first_at", [col], out=out)


# --- early stopping ----------------------------------------------------------
def early_stop(curve: DataFrame, patience: int, max_epochs: int) -> DataFrame:
    """Best and last epoch per run when training halts after `patience` flat epochs.

    Training ends at `max_epochs` in any case, so a run has at most that many
    rows and its window is bounded.
    """
    run = curve.filter(F.col("epoch") < max_epochs)
    prior = W.partitionBy("run_id").orderBy("epoch").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("run_id").orderBy("epoch").rowsBetween(W.unboundedPreceding, 0)
    better = (F.col("val_loss") < F.col("_prior")) | (F.col("_prior").isNull() & F.col("val_loss").isNotNull())
    seen = (
        run.withColumn("_prior", F.min("val_loss").over(prior))
        .withColumn("_best", F.max(F.when(better, F.col("epoch"))).over(upto))
        .withColumn("_stop", F.coalesce(F.col("_best"), F.lit(0)) + patience < F.col("epoch"))
    )
    halted = seen.withColumn("_halted", F.max(F.col("_stop")).over(prior))
    kept = halted.filter(~F.coalesce("_halted", F.lit(False)))
    return kept.groupBy("run_id").agg(
        F.max("_best").alias("best_epoch"),
        F.max("epoch").alias("last_epoch"),
        F.min("val_loss").alias("best_val_loss"),
        F.max("_stop").alias("stopped_early"),
    )


def early_stop_tol(
    curve: DataFrame, patience: int, tol: float, maximize: bool, max_epochs: int
) -> DataFrame:
    """Early stopping where only a change above `tol` counts as better.

    The state depends on the last accepted best, so the epochs of a run are
    folded in order. A run has at most `max_epochs` epochs, which bounds the
    folded array; epochs with no value are skipped.
    """
    sign = 1.0 if maximize else -1.0
    runs = (
        curve.filter((F.col("epoch") < max_epochs) & F.col("val_loss").isNotNull())
        .groupBy("run_id")
        .agg(F.array_sort(F.collect_list(F.struct("epoch", "val_loss"))).alias("c"))
    )
    start = F.struct(
        F.lit(None).cast("double").alias("best"), F.lit(0).alias("best_epoch"),
        F.lit(0).alias("wait"), F.lit(0).alias("stopped_epoch"), F.lit(False).alias("stop"),
    )

    def step(s: Column, x: Column) -> Column:
        up = s["best"].isNull() | ((x["val_loss"] - s["best"]) * F.lit(sign) > F.lit(tol))
        out = s["wait"] >= patience
        new = F.struct(
            F.when(up, x["val_loss"]).otherwise(s["best"]).alias("best"),
            F.when(up, x["epoch"]).otherwise(s["best_epoch"]).alias("best_epoch"),
            F.when(up, F.lit(1)).otherwise(s["wait"] + 1).alias("wait"),
            F.when(~up & out, x["epoch"]).otherwise(s["stopped_epoch"]).alias("stopped_epoch"),
            (~up & out).alias("stop"),
        )
        return F.when(s["stop"], s).otherwise(new)

    return runs.select("run_id", F.aggregate("c", start, step).alias("s")).select(
        "run_id", F.col("s.best_epoch").alias("best_epoch"), F.col("s.best").alias("best_value"),
        F.col("s.stopped_epoch").alias("stopped_epoch"), F.col("s.stop").alias("stopped"),
    )


# --- C: joins ------------------------------------------------------------------
def join_num_instances(res: DataFrame, mf: DataFrame) -> DataFrame:
    return res.join(num_instances(mf), "dataset_fold_id", "left")


def merge_metrics(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Inner join of per-metric tables; all other columns come from the first."""
    def add(left: DataFrame, right: DataFrame) -> DataFrame:
        fresh = [c for c in right.columns if c not in left.columns]
        return left.join(right.select(*keys, *fresh), list(keys))

    return reduce(add, frames)


def alg_types(df: DataFrame) -> DataFrame:
    return df.select("alg_name", "alg_type").dropDuplicates()


def join_alg_type(df: DataFrame, typed: DataFrame) -> DataFrame:
    return df.join(alg_types(typed), "alg_name", "left")


def join_std(df: DataFrame, std: DataFrame) -> DataFrame:
    return df.join(std, ["dataset_name", "alg_name"], "left")


def join_tuned_with_metafeatures(tuned: DataFrame, mf: DataFrame) -> DataFrame:
    renamed = mf.withColumnRenamed("dataset_name", "mf_dataset_name")
    return tuned.join(renamed, F.col("dataset_fold_id") == F.col("mf_dataset_name"), "left")


def join_axes(res: DataFrame, mf: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Dataset axes by cleaned name."""
    left = res.withColumn("dataset_name", clean_dataset_name("dataset_name"))
    right = mf.select(clean_dataset_name("dataset_basename").alias("dataset_name"), *axes)
    return left.join(right, "dataset_name", "left")


def experiment_plan(algs: Sequence[str], datasets: DataFrame, expts: Sequence[str]) -> DataFrame:
    """Every algorithm on every dataset: a generator over the dataset list."""
    return datasets.select(
        "dataset_name", F.explode(F.array(*[F.lit(a) for a in algs])).alias("alg_name")
    ).select("dataset_name", "alg_name", F.explode(F.array(*[F.lit(e) for e in expts])).alias("experiment"))


def pending(plan: DataFrame, log: DataFrame) -> DataFrame:
    return plan.join(log, ["dataset_name", "alg_name", "experiment"], "left_anti")


def flag_in_repo(tasks: DataFrame, imported: DataFrame) -> DataFrame:
    seen = imported.select("task_id").distinct().withColumn("_seen", F.lit(True))
    out = tasks.join(seen, "task_id", "left")
    return out.select(F.coalesce("_seen", F.lit(False)).alias("in_repo"), *tasks.columns)


def anti_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "left_anti")


def take_rows(df: DataFrame, idx: DataFrame, key: str = "row_id") -> DataFrame:
    return df.join(idx, key, "left_semi")


# --- D: aggregations -----------------------------------------------------------
def datasets_per_alg(df: DataFrame, approx: bool = False) -> DataFrame:
    n = F.approx_count_distinct("dataset_name") if approx else F.countDistinct("dataset_name")
    return df.groupBy("alg_name").agg(n.alias("n_datasets")).orderBy("n_datasets", "alg_name")


def algs_per_dataset(df: DataFrame) -> DataFrame:
    return df.groupBy("dataset_name").agg(F.countDistinct("alg_name").alias("n_algs")).orderBy("n_algs", "dataset_name")


def complete_datasets(df: DataFrame, algs: Sequence[str]) -> DataFrame:
    """Rows of the datasets on which every listed algorithm has a result."""
    chosen = df.filter(F.col("alg_name").isin(*algs))
    full = chosen.groupBy("dataset_name").agg(F.countDistinct("alg_name").alias("n")).filter(F.col("n") == len(algs))
    return df.join(full, "dataset_name", "left_semi")


def agg_over_folds(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean and median over folds of tuned rows (one row per fold).

    Metric means are rounded to 9 digits: the sum of doubles depends on the
    order in which they arrive, and equal algorithms must stay equal in rank.
    """
    def mean(c: str) -> Column:
        return F.round(F.avg(c), 9) if c.endswith("__test") else F.avg(c)

    aggs = [x for c in cols for x in (F.median(c).alias(f"{c}_median"), mean(c).alias(f"{c}_mean"))]
    return df.groupBy("alg_name", "dataset_name").agg(*aggs)


def norm_std(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy("dataset_name", "alg_name").agg(F.stddev_samp(value).alias(f"{value}_std"))


def rank_table(df: DataFrame, metric: str) -> DataFrame:
    """Rank and normalised-score summary per algorithm, best mean rank first."""
    cols = {
        "rank": f"{metric}_rank_mean", "norm": f"normalized_{metric}__test_mean",
        "std": f"normalized_{metric}__test_std", "runtime": f"train_per_1000_inst_mean_{metric}",
    }
    src = df.select("alg_name", *[F.col(c).cast("double").alias(n) for n, c in cols.items()])
    aggs = [F.min("rank").alias("rank_min"), F.max("rank").alias("rank_max")]
    for n in cols:
        aggs += [F.avg(n).alias(f"{n}_mean"), F.median(n).alias(f"{n}_median")]
    return src.groupBy("alg_name").agg(*aggs).orderBy("rank_mean", "alg_name")


def format_rank_table(table: DataFrame) -> DataFrame:
    two = lambda c: F.format_string("%.2f", c)
    med = F.col("rank_median")
    return table.select(
        "alg_name",
        F.format_string("%d", F.col("rank_min").cast("int")).alias("rank_min"),
        F.format_string("%d", F.col("rank_max").cast("int")).alias("rank_max"),
        two("rank_mean").alias("rank_mean"),
        F.when(med == F.floor(med), F.format_string("%d", med.cast("int")))
        .otherwise(F.format_string("%.1f", med)).alias("rank_median"),
        *[two(c).alias(c) for c in table.columns if c.split("_")[0] in ("norm", "std", "runtime")],
    )


def metafeature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("f__")]


def agg_metafeatures(mf: DataFrame) -> DataFrame:
    """Median of every metafeature per dataset; at most ten fold rows per dataset."""
    base = mf.withColumn("dataset_basename", fold_base_name("dataset_name"))
    return base.groupBy("dataset_basename").agg(*[F.median(c).alias(c) for c in metafeature_columns(mf)])


def impute_median(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Fill nulls with the exact column median, one bounded row of parameters."""
    cols = list(cols or metafeature_columns(df))
    long = melt(df, [], cols)
    med = {r["feature"]: r["value"] for r in quantiles(long, ["feature"], "value", {"med": 0.5}).collect()}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(med[c])) for c in cols if med.get(c) is not None})


def describe(df: DataFrame, col: str) -> DataFrame:
    """count, mean, std, min, quartiles and max with exact quartiles."""
    one = df.select(F.lit("all").alias("k"), F.col(col).cast("double").alias("value"))
    base = one.groupBy("k").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    q = quantiles(one, ["k"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    wide = q.groupBy("k").pivot("q", ["q25", "q50", "q75"]).agg(F.first("value"))
    return base.join(wide, "k").drop("k")


def guarded_corr(x: str, y: str) -> Column:
    """Pearson correlation over rows where both exist; null at zero variance."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    px, py = F.when(both, F.col(x)), F.when(both, F.col(y))
    denom = F.stddev_pop(px) * F.stddev_pop(py)
    return F.when(denom > 0, safe_div(F.covar_pop(px, py), denom))


def feature_corrs(joined: DataFrame, metric: str, as_abs: bool = False) -> DataFrame:
    """Correlation of each metafeature with the test metric, per algorithm (long)."""
    test = f"{metric}__test"
    long = melt(joined, ["alg_name", test], metafeature_columns(joined))
    corr = guarded_corr("value", test)
    return long.groupBy("feature", "alg_name").agg((F.abs(corr) if as_abs else corr).alias("corr"))


def corrs_wide(corrs: DataFrame, algs: Sequence[str]) -> DataFrame:
    return corrs.groupBy("feature").pivot("alg_name", list(algs)).agg(F.first("corr"))


OBJECTIVE = {"regression": "mse", "classification": "log_loss", "binary": "auc"}


def trial_objective(df: DataFrame) -> DataFrame:
    """Mean over folds of the validation objective of the target type."""
    val = F.lit(None).cast("double")
    direction = F.lit(None).cast("string")
    for kind, metric in OBJECTIVE.items():
        here = F.col("target_type") == kind
        if f"{metric}__val" in df.columns:
            val = F.when(here, F.col(f"{metric}__val")).otherwise(val)
        direction = F.when(here, F.lit("maximize" if names.MAXIMIZE[metric] else "minimize")).otherwise(direction)
    return (
        df.withColumns({"_v": val, "direction": direction})
        .groupBy("alg_name", "dataset_name", "trial_number", "target_type", "direction")
        .agg(F.avg("_v").alias("objective"))
    )


def best_trial(obj: DataFrame) -> DataFrame:
    """Study optimum per (algorithm, dataset); earliest trial on ties."""
    signed = F.when(F.col("direction") == "maximize", -F.col("objective")).otherwise(F.col("objective"))
    w = W.partitionBy("alg_name", "dataset_name").orderBy(F.col("_s").asc_nulls_last(), "trial_number")
    return (
        obj.filter(F.col("objective").isNotNull()).withColumn("_s", signed)
        .withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_s")
    )


def avg_time(df: DataFrame) -> DataFrame:
    return df.groupBy("alg_name", "dataset_name").agg(
        *[F.avg(f"time__{p}").alias(f"time__{p}_mean") for p in ("train", "val", "test")]
    )


def meters(df: DataFrame, key: str, value: str, n: str, order: str) -> DataFrame:
    """Running-meter end state per key: last value, weighted sum, count, average."""
    return df.groupBy(key).agg(
        F.max_by(value, order).alias("val"),
        F.sum(F.col(value) * F.col(n)).alias("sum"),
        F.sum(n).alias("count"),
        safe_div(F.sum(F.col(value) * F.col(n)), F.sum(n).cast("double")).alias("avg"),
    )


def label_domain(df: DataFrame, y: str, key: str | None = None) -> DataFrame:
    """Sorted distinct labels and their number."""
    src = df.select(*([key] if key else []), F.col(y).alias("label")).distinct()
    grouped = src.groupBy(key) if key else src.groupBy()
    return grouped.agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("labels"), F.count("label").alias("n_classes"))


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct values per column: (column, value) pairs first, then a count."""
    long = df.unpivot([], [F.col(c).cast("string").alias(c) for c in cols], "feature", "value")
    return long.filter(F.col("value").isNotNull()).distinct().groupBy("feature").agg(F.count("*").alias("n_distinct"))


def top_gain_features(gains: DataFrame, n: int) -> DataFrame:
    """n features of largest summed gain per group, padded with feature -1."""
    tot = gains.groupBy("tree_group", "feature").agg(F.sum("gain").alias("gain"))
    w = W.partitionBy("tree_group").orderBy(F.desc("gain"), "feature")
    top = tot.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= n)
    slots = gains.select("tree_group").distinct().withColumn("pos", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return slots.join(top, ["tree_group", "pos"], "left").select(
        "tree_group", "pos", F.coalesce("feature", F.lit(-1)).alias("feature"), F.coalesce("gain", F.lit(0.0)).alias("gain")
    )


def failure_report(results: DataFrame, errors: DataFrame) -> DataFrame:
    """Trials, failures and error rate per (dataset, algorithm)."""
    keys = ["dataset_name", "alg_name"]
    ok = results.select(*keys, "alg_hparam_id").distinct().groupBy(*keys).agg(F.count("*").alias("n_ok"))
    bad = errors.groupBy(*keys).agg(F.count("*").alias("n_failed"))
    both = ok.join(bad, keys, "full_outer").na.fill(0, ["n_ok", "n_failed"])
    return both.withColumn(
        "error_rate", F.col("n_failed").cast("double") / (F.col("n_ok") + F.col("n_failed"))
    )


# --- G: sorts and limits ---------------------------------------------------------
def sort_results(df: DataFrame) -> DataFrame:
    return df.orderBy("dataset_fold_id", "alg_hparam_id")


def sort_errors(df: DataFrame) -> DataFrame:
    return df.orderBy("dataset_name", "alg_hparam_id")


def head(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


# --- H: set operations --------------------------------------------------------------
def append_default_rows(df: DataFrame) -> DataFrame:
    return df.unionByName(default_rows(df))


def prepend_metafeatures(new: DataFrame, stored: DataFrame) -> DataFrame:
    return new.unionByName(stored, allowMissingColumns=True)


def processed_paths(results: DataFrame, errors: DataFrame) -> DataFrame:
    col = "results_bucket_path"
    return results.select(col).union(errors.select(col)).distinct()


def check_disjoint(splits: DataFrame) -> DataFrame:
    """Rows that appear in more than one part of a fold, or in two test folds."""
    within = (
        splits.groupBy("fold", "row_id").agg(F.count("*").alias("n"))
        .filter("n > 1").select(F.lit("parts").alias("check"), "fold", "row_id", "n")
    )
    tests = (
        splits.filter(F.col("part") == "test").groupBy("row_id").agg(F.count("*").alias("n"))
        .filter("n > 1").select(F.lit("test folds").alias("check"), F.lit(-1).alias("fold"), "row_id", "n")
    )
    return within.unionByName(tests)


def flatten(df: DataFrame, array_col: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c != array_col], F.explode(array_col).alias("row"))


def distinct_first(df: DataFrame, cols: Sequence[str], order: str) -> DataFrame:
    """Distinct rows with the position of their first occurrence."""
    return df.groupBy(*cols).agg(F.min(order).alias("first_at"))


def unknown_labels(train: DataFrame, valid: DataFrame, y: str) -> DataFrame:
    """Validation labels that training has not seen."""
    return valid.select(y).distinct().join(train.select(y).distinct(), y, "left_anti")
