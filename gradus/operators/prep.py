"""Dataset preparation: splits, encoding, imputing, scaling, binning, checks.

Everything fitted is fitted on the training part of each fold, for all folds
at once: statistics are taken per test fold and summed into training folds.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame, functions as F

from gradus.functions.scalar import bit, safe_div
from gradus.plans.folds import N_FOLDS, assign_parts, part_of, train_weights, weight_fold
from gradus.plans.moments import fold_moments
from gradus.plans.ordering import (
    first_in_hash_order, hash_cut, hash_row_index, hash_uniform, melt, quantile_grid, row_index, sorted_codes,
)
from gradus.session import written


# --- splits --------------------------------------------------------------------
def kfold(df: DataFrame, row_id: str, n: int = N_FOLDS, seed: int = 0) -> DataFrame:
    """Shuffled folds whose sizes differ by at most one."""
    out = hash_row_index(df, row_id, seed, out="_i")
    return out.withColumn("test_fold", (F.col("_i") % n).cast("int")).drop("_i")


def _stratum(df: DataFrame, y: str) -> DataFrame:
    """The class as a key without nulls: rows with no label are a class of their own."""
    return df.withColumn("_y", F.coalesce(F.col(y).cast("string"), F.lit("\u0000null")))


def stratified_kfold(df: DataFrame, row_id: str, y: str, n: int = N_FOLDS, seed: int = 0) -> DataFrame:
    """Shuffled folds that deal out each class in turn."""
    out = hash_row_index(_stratum(df, y), row_id, seed, ["_y"], out="_i")
    return out.withColumn("test_fold", (F.col("_i") % n).cast("int")).drop("_i", "_y")


def splits_table(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """(fold, part, row_id) for all folds."""
    return assign_parts(df.select(row_id, "test_fold")).select("fold", "part", F.col(row_id).alias("row_id"))


def fold_part(df: DataFrame, fold: int, part: str) -> DataFrame:
    """Rows of one part of one fold: a filter on test_fold, no join."""
    return df.filter(part_of(F.lit(fold)) == part)


def fold_part_join(df: DataFrame, splits: DataFrame, fold: int, part: str) -> DataFrame:
    """Rows of one part from a stored split table."""
    chosen = splits.filter((F.col("fold") == fold) & (F.col("part") == part)).select("row_id")
    return df.join(chosen, "row_id", "left_semi")


def train_minus_val(train: DataFrame, val: DataFrame) -> DataFrame:
    return train.join(val, "row_id", "left_anti")


def tail_split(df: DataFrame, order: str, n: int, tie: Sequence[str] = ()) -> DataFrame:
    """The last n rows by order, then by `tie`, are the test part.

    A numeric `tie` also spreads an order value that many rows share over several tasks.
    """
    total = df.count()
    out = row_index(df, order, tie, out="_i")
    return out.withColumn("part", F.when(F.col("_i") >= total - n, "test").otherwise("train")).drop("_i")


def size_split(df: DataFrame, row_id: str, n_train: int, n_valid: int, seed: int = 0) -> DataFrame:
    """Random parts of absolute size; rows beyond both sizes are left out.

    When the sizes exceed the table, the parts are as full as it allows.
    """
    among = lambda n: first_in_hash_order(row_id, hash_cut(df, row_id, n, seed), seed) if n > 0 else F.lit(False)
    part = F.when(among(n_train), "train").when(among(n_train + n_valid), "val")
    return df.withColumn("part", part).filter("part IS NOT NULL")


def frac_split(df: DataFrame, row_id: str, frac: float, seed: int = 0) -> DataFrame:
    """A sample of exactly round(frac * n) rows and its complement."""
    cut = round(frac * df.count())
    inside = first_in_hash_order(row_id, hash_cut(df, row_id, cut, seed), seed) if cut > 0 else F.lit(False)
    return df.withColumn("part", F.when(inside, "sample").otherwise("rest"))


def stratified_holdout(df: DataFrame, row_id: str, y: str, frac: float, seed: int = 0) -> DataFrame:
    """Validation takes round(frac * class size) rows of each class."""
    rows = _stratum(df, y)
    sizes = rows.groupBy("_y").agg(F.count("*").alias("_n"))
    out = hash_row_index(rows, row_id, seed, ["_y"], out="_i").join(sizes, "_y")
    cut = F.round(F.col("_n") * F.lit(float(frac)), 0)
    return out.withColumn("part", F.when(F.col("_i") < cut, "val").otherwise("train")).drop("_i", "_n", "_y")


def splits_from_indicators(df: DataFrame, row_id: str, cols: Sequence[str]) -> DataFrame:
    """One split per 0/1 column; 1 marks the rows that belong to it."""
    long = df.unpivot([row_id], list(cols), "split", "flag")
    return long.filter("flag = 1").select("split", row_id)


def order_by_part(df: DataFrame, row_id: str = "row_id", keys: Sequence[str] = ()) -> DataFrame:
    """Rows of train, then val, then test, within each of `keys`."""
    code = F.when(F.col("part") == "train", 0).when(F.col("part") == "val", 1).otherwise(2)
    return df.withColumn("part_code", code).orderBy(*keys, "part_code", row_id)


def subset_rows(df: DataFrame, row_id: str, n: int, method: str = "random", seed: int = 0) -> DataFrame:
    """Exactly n rows at random, or the first n by id; all rows when n < 0 or enough.

    Ids are unique. The random rows are those up to the n-th smallest hash, a filter that needs no shuffle of rows.
    """
    if n < 0:
        return df
    if method == "random":
        return df.filter(first_in_hash_order(row_id, hash_cut(df, row_id, n, seed), seed)) if n else df.filter(F.lit(False))
    if method == "first":
        return row_index(df, row_id, out="_i").filter(F.col("_i") < n).drop("_i")
    raise ValueError(f"unknown row subset method: {method}")


def first_features(features: Sequence[str], k: int) -> list[str]:
    return list(features)[:k]


def random_features(features: Sequence[str], k: int, seed: int = 0) -> list[str]:
    """k names by hash order of the name, returned in table order."""
    order = sorted(features, key=lambda c: hashlib.md5(f"{c}:{seed}".encode()).hexdigest())
    chosen = set(order[:k])
    return [c for c in features if c in chosen]


def subset_features(
    df: DataFrame, features: Sequence[str], k: int, method: str = "random", seed: int = 0, y: str | None = None,
    numeric: Sequence[str] = (),
) -> list[str]:
    """Names of the kept features, the same for all parts."""
    if k < 0 or k >= len(features):
        return list(features)
    if method == "random":
        return random_features(features, k, seed)
    if method == "first":
        return first_features(features, k)
    if method == "mutual_information":
        from gradus.operators.metafeatures import select_k_best

        return select_k_best(df, features, numeric, y, k)[0]
    raise ValueError(f"unknown feature subset method: {method}")


def make_subset(df: DataFrame, row_id: str, n_rows: int, n_features: int, features: Sequence[str], seed: int = 0) -> DataFrame:
    """Row subset per part plus a common feature subset.

    The training part is always cut; validation and test rows are cut only
    when `n_features` is below the number of features (the default -1 is).
    """
    keep = subset_features(df, features, n_features, "random", seed)
    cut = ["train", "val", "test"] if n_features < len(features) else ["train"]
    if n_rows >= 0:
        out = hash_row_index(df, row_id, seed, ["part"], out="_i")
        df = out.filter(~F.col("part").isin(*cut) | (F.col("_i") < n_rows)).drop("_i")
    return df.select(*[c for c in df.columns if c not in features or c in keep])


def super_sample(df: DataFrame, k: int) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(k))))


def minibatches(
    df: DataFrame, row_id: str, size: int, epochs: int, seed: int = 0, shuffle: bool = True, allow_incomplete: bool = True
) -> DataFrame:
    """(epoch, batch, row): rows dealt into batches, reshuffled for each epoch."""
    total = df.count()
    frames = []
    for e in range(epochs):
        ids = df.select(row_id)
        frame = hash_row_index(ids, row_id, f"{seed}-{e}", out="_i") if shuffle else row_index(ids, row_id, out="_i")
        frames.append(frame.select(F.lit(e).alias("epoch"), F.floor(F.col("_i") / size).cast("int").alias("batch"), row_id))
    out = reduce(DataFrame.unionByName, frames)
    return out if allow_incomplete else out.filter(F.col("batch") < total // size)


def map_chunks(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, size: int) -> DataFrame:
    """Apply a pandas function to row chunks of at most `size` rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), size):
                yield fn(pdf.iloc[i : i + size])

    return df.mapInPandas(run, schema)


# --- types, labels, checks ---------------------------------------------------------
def drop_features(df: DataFrame, cols: Sequence[str], cat_flags: dict[str, bool]) -> tuple[DataFrame, dict[str, bool]]:
    return df.drop(*cols), {k: v for k, v in cat_flags.items() if k not in cols}


def override_types(df: DataFrame, cat: Sequence[str] = (), num: Sequence[str] = ()) -> DataFrame:
    casts = {c: F.col(c).cast("string") for c in cat} | {c: F.col(c).cast("double") for c in num}
    return df.withColumns(casts)


def remap_label(col: str) -> Column:
    return F.when(F.col(col) == -1, 0).otherwise(F.col(col))


def binarise(col: str, positive) -> Column:
    return F.col(col) == F.lit(positive)


def encode_target(df: DataFrame, y: str, num_classes: int | None = None) -> DataFrame:
    """Labels to 0..C-1 in sorted order; a wrong class count is an error."""
    codes = sorted_codes(df.select(F.col(y).cast("string").alias(y)), [], y)
    n = codes.count()
    if num_classes is not None and n != num_classes:
        raise ValueError(f"target {y} has {n} classes, expected {num_classes}")
    key = codes.withColumnsRenamed({y: "_label", "code": "_code"})
    joined = df.join(key, F.col(y).cast("string") == F.col("_label"), "left")
    return joined.withColumn(y, F.col("_code")).drop("_label", "_code")


def category_codes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, value, code); a missing value is the last class of its feature."""
    long = df.unpivot([], list(cols), "feature", "value").distinct()
    return sorted_codes(long, ["feature"], "value")


def encode_categoricals(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, dict[str, int]]:
    """Categories to integer codes and the number of classes per column."""
    types = dict(df.dtypes)
    done = [c for c in cols if types[c] != "string"]
    if done:
        raise ValueError(f"columns are not strings, encoded already? {done}")
    codes = written(category_codes(df, cols), "codes")
    dims = {r["feature"]: r["n"] for r in codes.groupBy("feature").agg(F.count("*").alias("n")).collect()}
    out = df
    for c in cols:
        one = codes.filter(F.col("feature") == c).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        out = out.join(one, F.col(c).eqNullSafe(F.col("_value")), "left")
        out = out.withColumn(c, F.col("_code")).drop("_value", "_code")
    return out, {c: dims.get(c, 0) for c in cols}


def infer_target(df: DataFrame, y: str, declared: int | None = None) -> tuple[str, int]:
    """(target type, number of classes); binary has one output, not two."""
    n = df.select(y).filter(F.col(y).isNotNull()).distinct().count()
    if declared is not None and declared != n:
        raise ValueError(f"declared {declared} classes, found {n}")
    if n == 2:
        return "binary", 1
    if n > 2:
        return "classification", n
    raise ValueError(f"target {y} has only {n} distinct labels")


def target_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Target kind of several label columns, inside one job."""
    long = df.unpivot([], [F.col(c).cast("string").alias(c) for c in cols], "target", "label")
    n = F.count("*")
    kind = F.when(n == 2, "binary").when(n > 2, "classification").otherwise("invalid")
    return long.filter("label IS NOT NULL").distinct().groupBy("target").agg(
        n.alias("n_labels"), kind.alias("target_type"), F.when(n == 2, 1).otherwise(n).cast("int").alias("num_classes"))


def type_of_target(df: DataFrame, y: str) -> DataFrame:
    """continuous, binary or multiclass for a numeric target; infinite or NaN is an error."""
    v = F.col(y).cast("double")
    pairs = df.groupBy(v.alias("v")).agg(F.count("*").alias("n"))
    bad = F.count_if(F.isnan("v") | (F.abs(F.col("v")) == float("inf")))
    s = pairs.agg(
        F.count("v").alias("n_values"), F.coalesce(F.max(F.col("v") != F.floor("v")), F.lit(False)).alias("frac"), bad.alias("bad"),
    )
    kind = (
        F.when(F.col("bad") > 0, F.raise_error(F.lit(f"target {y} holds NaN or infinite values")).cast("string"))
        .when(F.col("frac"), "continuous").when(F.col("n_values") <= 2, "binary").otherwise("multiclass")
    )
    return s.select(F.lit(y).alias("target"), kind.alias("kind"), "n_values")


def check_unique_type(df: DataFrame, targets: Sequence[str]) -> str:
    kinds = {t for c, t in df.dtypes if c in targets}
    if len(kinds) != 1:
        raise ValueError(f"target columns mix types: {sorted(kinds)}")
    return kinds.pop()


def inspect_dataset(
    df: DataFrame, y: str, categorical: Sequence[str], numeric: Sequence[str], accept_nulls: bool = True,
    name: str = "dataset",
) -> DataFrame:
    """Failed quality checks as rows (dataset, check, feature, n), from one pass.

    Checks: missing labels, fully null columns, missing cells (unless
    accepted), and columns whose type is not the declared kind.
    """
    cols = [*categorical, *numeric, y]
    types = dict(df.dtypes)
    row = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = row.unpivot(["_n"], cols, "feature", "n_missing")
    is_y = F.col("feature") == y
    checks = [
        F.when(is_y & (F.col("n_missing") > 0), "missing label"),
        F.when(~is_y & (F.col("n_missing") == F.col("_n")) & (F.col("_n") > 0), "fully null column"),
    ]
    if not accept_nulls:
        checks.append(F.when(~is_y & (F.col("n_missing") > 0), "missing cells"))
    wrong = [c for c in categorical if types[c] != "string"] + [c for c in numeric if types[c] == "string"]
    if wrong:
        checks.append(F.when(F.col("feature").isin(*wrong), "type differs from declaration"))
    return (
        long.select(F.lit(name).alias("dataset_name"), "feature", F.col("n_missing").alias("n"),
                    F.explode(F.array_compact(F.array(*checks))).alias("failure"))
    )


def check_cv_settings(settings: dict) -> list[str]:
    """Messages for task settings other than 10-fold, one repeat, supervised classification."""
    # fixed values: the settings an importable task must have
    want = {"task_type": "Supervised Classification", "estimation": "crossvalidation", "repeats": 1, "folds": 10}
    return [f"{k} is {settings.get(k)}, expected {v}" for k, v in want.items() if settings.get(k) != v]


def inspect_suite(reports: Sequence[DataFrame], names: DataFrame) -> DataFrame:
    """Pass or fail per dataset over the union of the reports."""
    rows = reduce(DataFrame.unionByName, reports)
    n = rows.groupBy("dataset_name").agg(F.count("*").alias("n_failures"))
    out = names.join(n, "dataset_name", "left").na.fill(0, ["n_failures"])
    return out.withColumn("passed", F.col("n_failures") == 0)


def validate_dataset(meta: dict, df: DataFrame) -> dict:
    """Check the metadata row against the table; raises on the first violation."""
    n_features = meta["num_features"]
    features = [c for c in df.columns if c not in ("row_id", "test_fold", meta["target"])]
    kind, classes = meta["target_type"], meta["num_classes"]
    problems = {
        f"expected {n_features} features, found {len(features)}": len(features) != n_features,
        "a categorical index is out of range": any(not 0 <= i < n_features for i in meta["cat_idx"]),
        "categorical indices repeat": len(set(meta["cat_idx"])) != len(meta["cat_idx"]),
        f"unknown target type {kind}": kind not in ("regression", "binary", "classification"),
        f"{kind} cannot have {classes} classes": (classes <= 2) if kind == "classification" else classes != 1,
    }
    for text, bad in problems.items():
        if bad:
            raise ValueError(text)
    n = df.count()
    if n != meta["num_instances"]:
        raise ValueError(f"expected {meta['num_instances']} rows, found {n}")
    return meta


def check_eval_set(train: DataFrame, evals: Sequence[DataFrame]) -> None:
    """Every evaluation set must have the training columns and at least one row."""
    for i, e in enumerate(evals):
        if e.columns != train.columns or [t for _, t in e.dtypes] != [t for _, t in train.dtypes]:
            raise ValueError(f"evaluation set {i} differs from the training columns")
        if e.isEmpty():
            raise ValueError(f"evaluation set {i} has no rows")


def missing_mask(df: DataFrame, cols: Sequence[str], row_id: str = "row_id") -> DataFrame:
    return df.select(row_id, *[F.col(c).isNull().alias(c) for c in cols])


# --- fitted transforms ------------------------------------------------------------
def _per_fold(df: DataFrame, stats: DataFrame, values: dict[str, Column], cols: Sequence[str]) -> DataFrame:
    """Join per-fold parameters (one row per fold, a struct per column) to rows.

    The parameter side has one row per fold, so it is always broadcast.
    """
    wide = stats.groupBy("fold").agg(*[
        F.max(F.when(F.col("feature") == c, F.struct(*[v.alias(k) for k, v in values.items()]))).alias(f"_p_{c}")
        for c in cols
    ])
    if "fold" not in df.columns:
        df = assign_parts(df)
    return df.join(F.broadcast(wide), "fold")


def fixed_stats(stats: DataFrame) -> DataFrame:
    """Fitted parameters as a literal table: folds x columns rows.

    Sums of doubles differ in the last digit from run to run; what is fitted
    once must be applied with exactly the same values.
    """
    return stats.sparkSession.createDataFrame(stats.collect(), stats.schema)


def fill_values(stats: DataFrame) -> DataFrame:
    """(fold, feature, mean, n, n_null): zero is the mean of a column with no training value."""
    return stats.select(
        "fold", "feature", F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.col("mean")).alias("mean"), "n", "n_null")


def imputed_value_counts(df: DataFrame, cols: Sequence[str], stats: DataFrame) -> DataFrame:
    """(feature, value, w0..w9) of the imputed training rows of each fold.

    Nulls enter as one row per fold at that fold's mean, so no row is copied
    per fold.
    """
    weights = [f"w{i}" for i in range(N_FOLDS)]
    at_mean = fill_values(stats).filter("n_null > 0").select(
        "feature", F.col("mean").alias("value"),
        *[F.when(F.col("fold") == i, F.col("n_null")).otherwise(F.lit(0)).cast("bigint").alias(f"w{i}") for i in range(N_FOLDS)])
    both = fold_value_counts(df, cols).unionByName(at_mean)
    return both.groupBy("feature", "value").agg(*[F.sum(w).alias(w) for w in weights])


def impute_mean(df: DataFrame, cols: Sequence[str], stats: DataFrame | None = None) -> DataFrame:
    """Every row in every fold, numeric nulls filled with that fold's training mean.

    A column with no training value in a fold becomes zero in all parts.
    Column order is kept.
    """
    stats = fold_moments(df, cols) if stats is None else stats
    order = [*df.columns, "fold", "part"]
    out = _per_fold(df, stats, {"mean": F.col("mean"), "n": F.col("n")}, cols)
    filled = {
        c: F.when(F.col(f"_p_{c}.n") == 0, F.lit(0.0)).otherwise(F.coalesce(F.col(c), F.col(f"_p_{c}.mean"))) for c in cols
    }
    return out.withColumns(filled).select(*order)


def standardize(df: DataFrame, cols: Sequence[str], variant: str = "plain") -> DataFrame:
    """Scale by training statistics of each fold.

    plain: (x - mean) / sd, population sd. eps: divisor sd + 1e-5.
    centre: population sd, only centred when sd is zero. sample: as centre
    with the sample sd.
    """
    stats = fold_moments(df, cols)
    n = F.col("n").cast("double")
    var = F.try_divide(F.col("m2"), n - 1) if variant == "sample" else F.try_divide(F.col("m2"), n)
    out = _per_fold(df, stats, {"mean": F.col("mean"), "sd": F.sqrt(var)}, cols)

    def scaled(c: str) -> Column:
        x, sd = F.col(c) - F.col(f"_p_{c}.mean"), F.col(f"_p_{c}.sd")
        if variant == "plain":
            return safe_div(x, sd)
        if variant == "eps":
            return x / (sd + F.lit(1e-5))
        if variant in ("centre", "sample"):
            return F.when(sd == 0, x).otherwise(safe_div(x, sd))
        raise ValueError(f"unknown variant: {variant}")

    return out.withColumns({c: scaled(c) for c in cols}).drop(*[f"_p_{c}" for c in cols])


def standardize_with(df: DataFrame, offset: dict[str, float], scale: dict[str, float]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(offset[c])) / F.lit(scale[c]) for c in offset})


def normalize_label(df: DataFrame, y: str) -> DataFrame:
    """(y - mean) / sd of the training labels, with both kept for the way back."""
    stats = fold_moments(df, [y])
    n = F.col("n").cast("double")
    out = _per_fold(df, stats, {"mean": F.col("mean"), "sd": F.sqrt(F.try_divide(F.col("m2"), n))}, [y])
    return out.withColumns({
        "y_mean": F.col(f"_p_{y}.mean"), "y_sd": F.col(f"_p_{y}.sd"),
        f"{y}_norm": safe_div(F.col(y) - F.col(f"_p_{y}.mean"), F.col(f"_p_{y}.sd")),
    }).drop(f"_p_{y}")


def denormalize_label(pred: str) -> Column:
    return F.col(pred) * F.col("y_sd") + F.col("y_mean")


def mean_state(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mergeable (feature, sum, count) state of column means."""
    return melt(df, [], cols).groupBy("feature").agg(F.sum("value").alias("sum"), F.count("value").alias("count"))


def refit_means(old: DataFrame, new: DataFrame) -> DataFrame:
    merged = old.unionByName(new).groupBy("feature").agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"))
    return merged.withColumn("mean", safe_div(F.col("sum"), F.col("count").cast("double")))


def fold_value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, value, w0..w9): training rows of each fold that hold the value."""
    long = melt(df, ["test_fold"], cols).filter("value IS NOT NULL")
    return long.groupBy("feature", "value").agg(*train_weights(df))


def quantile_references(counts: DataFrame, n_quantiles: int = 1000) -> DataFrame:
    """(feature, fold, refs): evenly spaced training quantiles as one array, from value counts."""
    weights = [f"w{i}" for i in range(N_FOLDS)]
    grid = quantile_grid(counts, ["feature"], "value", weights, n_quantiles)
    return grid.groupBy("feature", weight_fold(F.col("weight")).alias("fold")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda s: s["value"]).alias("refs")
    )


def _interpolate(x: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Rank of x within refs in [0, 1], the middle of a run of equal references."""
    grid = np.linspace(0.0, 1.0, len(refs))
    right = np.interp(x, refs, grid)
    left = -np.interp(-x, -refs[::-1], -grid[::-1])
    out = (right + left) / 2.0
    out[x == refs[-1]] = 1.0
    out[x == refs[0]] = 0.0
    out[np.isnan(x)] = np.nan
    return out


def quantile_scale(
    df: DataFrame, cols: Sequence[str], n_quantiles: int = 1000, output: str = "uniform", noise: float = 0.0, seed: int = 0
) -> DataFrame:
    """Map each numeric column to its training rank, per fold.

    `df` has row_id and test_fold. With `noise`, the references are fitted on
    values jittered by a normal draw of deviation noise / max(sd, noise), sd being the column's over all rows. The references,
    folds x columns x n_quantiles numbers, travel in the function's closure.
    """
    fit = df
    if noise:
        # a column's draw has the deviation noise / max(sd, noise)
        sds = df.agg(*[F.stddev_pop(c).alias(c) for c in cols]).first()
        share = {c: noise / max(sds[c] or 0.0, noise) for c in cols}
        fit = df.withColumns({c: F.col(c) + F.lit(share[c]) * hash_normal("row_id", f"{seed}-{c}") for c in cols})
    rows = df if "fold" in df.columns else assign_parts(df)
    counts = written(fold_value_counts(fit, cols), "value-counts")
    return apply_quantiles(rows, cols, quantile_references(counts, n_quantiles), output)


def apply_quantiles(rows: DataFrame, cols: Sequence[str], references: DataFrame, output: str = "uniform") -> DataFrame:
    """Scale rows that carry `fold` by collected references, folds x columns arrays."""
    refs = {(r["fold"], r["feature"]): np.asarray(r["refs"], dtype=float) for r in references.collect()}

    def scaler(name: str):
        mine = {f: r for (f, c), r in refs.items() if c == name}

        @F.pandas_udf("double")
        def scale(fold: pd.Series, x: pd.Series) -> pd.Series:
            out = np.full(len(x), np.nan)
            xs = x.to_numpy(dtype=float, na_value=np.nan)
            for f in fold.unique():
                if int(f) in mine:
                    here = (fold == f).to_numpy()
                    out[here] = _interpolate(xs[here], mine[int(f)])
            if output == "normal":
                from statistics import NormalDist

                inv = NormalDist().inv_cdf
                lo = 1e-7
                out = np.array([np.nan if np.isnan(v) else inv(min(max(v, lo), 1 - lo)) for v in out])
            return pd.Series(out)

        return scale

    # missing values travel as NaN and come back as null
    null = F.lit(None).cast("double")
    return rows.withColumns({c: F.nanvl(scaler(c)("fold", F.col(c).cast("double")), null) for c in cols})


def hash_normal(row_id: str, seed: int | str) -> Column:
    """Standard normal draw by Box-Muller from two hash uniforms; replayable."""
    u = F.lit(1.0) - hash_uniform(row_id, f"{seed}-u")
    v = hash_uniform(row_id, f"{seed}-v")
    return F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(2.0 * np.pi) * v)


def one_hot_domains(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, value, w0..w9) of the categories, with training counts per fold."""
    long = df.unpivot(["test_fold"], list(cols), "feature", "value").filter("value IS NOT NULL")
    return long.groupBy("feature", "value").agg(*train_weights(df))


def one_hot(df: DataFrame, cols: Sequence[str], fit: DataFrame | None = None, limit: int = 10_000) -> DataFrame:
    """One 0/1 array per categorical column over the categories of the table.

    A category the fold's training part has not seen gives all zeros, as does
    a null. The domain is a table of categories; more than `limit` of them
    make an error, as the output itself would have that many cells per row:
    one_hot_sparse takes any number.
    `fit` gives the rows to fit on where `df` holds each row once per fold.
    """
    domains = one_hot_domains(df if fit is None else fit, cols)
    rows = domains.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} categories; one-hot output would be that wide")
    out = df if "fold" in df.columns else assign_parts(df)
    for c in cols:
        mine = sorted((r for r in rows if r["feature"] == c), key=lambda r: r["value"].encode())
        cells = []
        for r in mine:
            seen = [i for i in range(N_FOLDS) if r[f"w{i}"] > 0]
            ok = F.col(c) == F.lit(r["value"])
            if len(seen) < N_FOLDS:
                ok = ok & F.col("fold").isin(*seen)
            cells.append(F.coalesce(ok.cast("int"), F.lit(0)))
        out = out.withColumn(f"{c}_onehot", F.array(*cells) if cells else F.array().cast("array<int>"))
    return out


def one_hot_sparse(df: DataFrame, cols: Sequence[str], fit: DataFrame | None = None, broadcast_rows: int = 100_000) -> DataFrame:
    """One sparse 0/1 vector per categorical column, `{c}_onehot`, for domains of any size.

    The category's number in byte order comes from a join with the table of categories, not from an expression per
    category; which folds' training parts have seen it is a mask of one bit a fold. What a fold has not seen, and a
    null, gives all zeros, and so does a column without any category (a vector of one zero). The table of categories
    is broadcast up to `broadcast_rows` counted rows. `fit` gives the rows to fit on where `df` holds each row once
    per fold.
    """
    domains = one_hot_domains(df if fit is None else fit, cols)
    seen = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.col(f"w{i}") > 0, F.lit(1 << i)).otherwise(F.lit(0)) for i in range(N_FOLDS)])
    masks = written(domains.select("feature", "value", seen.alias("seen")), "category-masks")
    index = written(sorted_codes(masks, ["feature"], "value").join(masks, ["feature", "value"]), "category-index")
    sizes = {r["feature"]: r["n"] for r in index.groupBy("feature").agg(F.count("*").alias("n")).collect()}  # one row a column
    few = sum(sizes.values()) <= broadcast_rows
    out = df
    for k, c in enumerate(cols):
        one = index.filter(F.col("feature") == c).select(F.col("value").alias(c), F.col("code").alias(f"_code{k}"), F.col("seen").alias(f"_seen{k}"))
        out = out.join(F.broadcast(one) if few else one, c, "left")
    out = out if "fold" in df.columns else assign_parts(out)
    bit_of_fold = F.call_function("shiftleft", F.lit(1), F.col("fold"))
    for k, c in enumerate(cols):
        known = F.col(f"_seen{k}").bitwiseAND(bit_of_fold) > 0
        out = out.withColumn(f"_code{k}", F.when(known, F.col(f"_code{k}")).otherwise(sizes.get(c, 0) or 1).cast("double"))
    # an index beyond the domain is the encoder's dropped last category: all zeros
    widths = df.sparkSession.range(1).select(*[F.lit(float((sizes.get(c, 0) or 1) - 1)).alias(f"_code{k}") for k, c in enumerate(cols)])
    names = [f"_code{k}" for k in range(len(cols))]
    model = OneHotEncoder(inputCols=names, outputCols=[f"{c}_onehot" for c in cols], handleInvalid="keep").fit(widths)
    rest = [c for c in (df.columns if "fold" in df.columns else [*df.columns, "fold", "part"])]
    return model.transform(out).select(*rest, *[f"{c}_onehot" for c in cols])


def fit_bins(df: DataFrame, col: str, bins: int = 32) -> list[float]:
    """Edges of equal-frequency bins, duplicates dropped: at most bins + 1 numbers."""
    counts = df.select(F.lit(col).alias("feature"), F.col(col).cast("double").alias("value")).filter("value IS NOT NULL")
    counts = counts.groupBy("feature", "value").agg(F.count("*").alias("n_rows"))
    got = quantile_grid(counts, ["feature"], "value", ["n_rows"], bins + 1, shrink=False).collect()
    return sorted({r["value"] for r in got})


def cut(col: str, edges: Sequence[float]) -> Column:
    """Bin of right-closed intervals, lowest edge included; outside or missing is bin 0."""
    x = F.col(col)
    above = reduce(lambda a, b: a + b, [(x > F.lit(e)).cast("int") for e in edges])
    inside = (x >= F.lit(edges[0])) & (x <= F.lit(edges[-1]))
    return F.when(inside, F.greatest(above - 1, F.lit(0))).otherwise(F.lit(0))


def qcut(df: DataFrame, col: str, bins: int = 32, out: str = "bin") -> DataFrame:
    return df.withColumn(out, cut(col, fit_bins(df, col, bins)))


def binary_encode(df: DataFrame, col: str, train: DataFrame | None = None) -> DataFrame:
    """Bits of a category code, lowest first, as wide as the largest training code."""
    top = (train if train is not None else df).agg(F.max(col)).first()[0] or 0
    return df.withColumns({f"{col}_bit{i}": bit(col, i) for i in range(max(1, int(top).bit_length()))})


def offset_categories(df: DataFrame, dims: dict[str, int], n_special: int = 1) -> DataFrame:
    """Shift each coded column so that all columns share one vocabulary."""
    shift, cols = n_special, {}
    for c, d in dims.items():
        cols[c] = F.col(c) + F.lit(shift)
        shift += d
    return df.withColumns(cols)


def process_data(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], scaler: str | None = "quantile",
    one_hot_encode: bool = True, n_quantiles: int = 1000,
) -> DataFrame:
    """Impute, scale and encode for all folds; input has row_id and test_fold.

    Scaling is fitted on the imputed training values: a null stands at the
    training mean, which the fitted statistics take into account.
    """
    stats = fixed_stats(fold_moments(df, numeric))
    out = impute_mean(df, numeric, stats)
    if scaler == "quantile":
        out = apply_quantiles(out, numeric, quantile_references(
            written(imputed_value_counts(df, numeric, stats), "value-counts"), n_quantiles))
    elif scaler is not None:
        raise ValueError(f"unknown scaler: {scaler}")
    if one_hot_encode and categorical:
        out = one_hot(out, categorical, fit=df)
    return out


def preprocess(df: DataFrame, y: str, categorical: Sequence[str], row_id: str = "row_id") -> tuple[DataFrame, dict]:
    """Raw labelled table to folds, coded target and coded categories, with metadata."""
    features = [c for c in df.columns if c not in (row_id, y)]
    kind, classes = infer_target(df, y)
    out, dims = encode_categoricals(encode_target(df, y), categorical)
    meta = {
        "target": y, "target_type": kind, "num_classes": classes, "num_features": len(features),
        "num_instances": df.count(), "cat_idx": [features.index(c) for c in categorical],
        "cat_dims": [dims[c] for c in categorical], "split_source": "stratified",
    }
    validate_dataset(meta, df)
    return stratified_kfold(out, row_id, y), meta
