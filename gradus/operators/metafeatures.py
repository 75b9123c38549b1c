"""Dataset metafeatures of every fold's imputed training part, as aggregates.

Input rows carry row_id, test_fold, features and label. Work starts from two
tables that are built in one pass each: column moments per fold, and counts
per distinct (feature, value) with one weight column per fold. A null numeric
cell stands at its fold's training mean; a null category is a category.
Definitions follow Rivolli et al. (2022) and Alcobaca et al. (2020).
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gradus.functions.scalar import safe_div
from gradus.operators.information import nearest_information
from gradus.operators.prep import fill_values, fixed_stats, imputed_value_counts
from gradus.plans.folds import N_FOLDS, sum_over_train, to_train_folds, train_weights, weight_fold
from gradus.plans.moments import fold_moments, kurtosis, skewness
from gradus.plans.ordering import BUCKET, cut_points, exact_quantiles, hash_order, melt, prefix_sums, value_buckets
from gradus.session import written

WEIGHTS = [f"w{i}" for i in range(N_FOLDS)]
NULL_CATEGORY = "\u0000null"


class Input:
    """A labelled table with its column roles and the statistics all operators share."""

    def __init__(self, df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], y: str):
        self.df, self.numeric, self.categorical, self.y = df, list(numeric), list(categorical), y
        self._stats: DataFrame | None = None
        self._counts: DataFrame | None = None

    @property
    def moments(self) -> DataFrame:
        """Moments per (fold, column), evaluated once: folds x columns rows."""
        if self._stats is None:
            self._stats = fixed_stats(fold_moments(self.df, self.numeric))
        return self._stats

    @property
    def imputed_moments(self) -> DataFrame:
        """The same over imputed values: nulls at the mean add rows but no deviation."""
        zero = lambda c: F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.col(c)).alias(c)
        return self.moments.select(
            "fold", "feature", (F.col("n") + F.col("n_null")).alias("n"), *[zero(c) for c in ("mean", "m2", "m3", "m4", "min", "max")])

    @property
    def value_counts(self) -> DataFrame:
        """(feature, value, w0..w9) of the numeric columns, written once for its several readers."""
        if self._counts is None:
            self._counts = written(imputed_value_counts(self.df, self.numeric, self.moments), "value-counts")
        return self._counts

    @property
    def category_counts(self) -> DataFrame:
        """(feature, value, y, w0..w9) for the categorical columns."""
        filled = [F.coalesce(F.col(c), F.lit(NULL_CATEGORY)).alias(c) for c in self.categorical]
        long = self.df.unpivot(["test_fold", self.y], filled, "feature", "value")
        return long.groupBy("feature", "value", F.col(self.y).cast("string").alias("y")).agg(*train_weights(self.df))

    @property
    def class_counts(self) -> DataFrame:
        return self.df.groupBy(F.col(self.y).cast("string").alias("y")).agg(*train_weights(self.df))


def fold_sums(counts: DataFrame, keys: Sequence[str], exprs: dict[str, callable]) -> DataFrame:
    """(fold, keys, sums): every expression of a fold's weight summed per key.

    Ten folds are ten columns of one aggregate, not ten copies of the rows.
    """
    per = F.array(*[
        F.struct(F.lit(i).alias("fold"), *[F.sum(fn(F.col(w))).alias(n) for n, fn in exprs.items()])
        for i, w in enumerate(WEIGHTS)])
    grouped = counts.groupBy(*keys) if keys else counts.groupBy()
    return grouped.agg(per.alias("e")).select(*keys, F.explode("e").alias("e")).select(*keys, "e.*")


def long_rows(df: DataFrame, group: str, cols: Sequence[str], attribute: bool = False) -> DataFrame:
    """(fold, grp, feature, attribute, value) rows of wide per-fold columns."""
    src = df.withColumn("attribute", F.col("feature") if attribute else F.lit(None).cast("string"))
    if "feature" in src.columns:
        src = src.drop("feature")
    out = src.unpivot(["fold", "attribute"], [F.col(c).cast("double").alias(c) for c in cols], "feature", "value")
    return out.select("fold", F.lit(group).alias("grp"), "feature", "attribute", "value")


# --- general ------------------------------------------------------------------------------
def mf_general(x: Input) -> DataFrame:
    """nr_inst, nr_attr, nr_num, nr_cat, nr_bin, nr_class per fold."""
    cls = fold_sums(x.class_counts, [], {"nr_inst": lambda w: w, "nr_class": lambda w: (w > 0).cast("int")})
    counts = [x.value_counts] if x.numeric else []
    if x.categorical:
        counts.append(x.category_counts.groupBy("feature", "value").agg(*[F.sum(w).alias(w) for w in WEIGHTS]))
    both = reduce(DataFrame.unionByName, [fold_sums(c, ["feature"], {"k": lambda w: (w > 0).cast("int")}) for c in counts])
    binary = both.groupBy("fold").agg(F.count_if(F.col("k") == 2).alias("nr_bin"))
    return cls.join(binary, "fold").select(
        "fold", "nr_inst", F.lit(len(x.numeric) + len(x.categorical)).alias("nr_attr"), F.lit(len(x.numeric)).alias("nr_num"),
        F.lit(len(x.categorical)).alias("nr_cat"), "nr_bin", "nr_class")


def mf_ratios(general: DataFrame) -> DataFrame:
    d = lambda c: F.col(c).cast("double")
    return general.select(
        "fold", safe_div(d("nr_attr"), d("nr_inst")).alias("attr_to_inst"), safe_div(d("nr_inst"), d("nr_attr")).alias("inst_to_attr"),
        safe_div(d("nr_cat"), d("nr_num")).alias("cat_to_num"), safe_div(d("nr_num"), d("nr_cat")).alias("num_to_cat"))


def mf_freq_class(x: Input) -> DataFrame:
    """(fold, y, freq_class) for the classes that occur in training."""
    per = fold_sums(x.class_counts, ["y"], {"n": lambda w: w}).filter("n > 0")
    return per.withColumn("freq_class", F.col("n").cast("double") / F.sum("n").over(W.partitionBy("fold"))).drop("n")


# --- statistical ----------------------------------------------------------------------------
def mf_quartiles(x: Input) -> DataFrame:
    """(fold, feature, q25, q50, q75) of the imputed training values, exact."""
    q = exact_quantiles(x.value_counts, ["feature"], "value", WEIGHTS, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return q.groupBy("feature", weight_fold(F.col("weight")).alias("fold")).agg(
        *[F.max(F.when(F.col("q") == n, F.col("value"))).alias(n) for n in ("q25", "q50", "q75")])


def mf_mad(x: Input, quartiles: DataFrame) -> DataFrame:
    """1.4826 times the median distance to the median.

    The distance depends on the fold, so here the distinct values (not the
    rows) are listed once per fold they train.
    """
    per = F.explode(F.array(*[F.struct(F.lit(i).alias("fold"), F.col(w).alias("n_rows")) for i, w in enumerate(WEIGHTS)]))
    long = x.value_counts.select("feature", "value", per.alias("e")).select("feature", "value", "e.*").filter("n_rows > 0")
    dev = long.join(F.broadcast(quartiles.select("fold", "feature", "q50")), ["fold", "feature"]).withColumn(
        "dev", F.abs(F.col("value") - F.col("q50")))
    counts = dev.groupBy("fold", "feature", "dev").agg(F.sum("n_rows").alias("n_rows"))
    # fixed value: scale that makes the MAD of a normal sample its standard deviation
    return exact_quantiles(counts, ["fold", "feature"], "dev", ["n_rows"], {"m": 0.5}, cut_points(dev, "dev")).select(
        "fold", "feature", (F.lit(1.4826) * F.col("value")).alias("mad"))


def mf_column_stats(x: Input) -> DataFrame:
    """mean, sd, var, min, max, range, median, mad, iq_range, skewness, kurtosis per (fold, column)."""
    q = fixed_stats(mf_quartiles(x))
    m = x.imputed_moments
    var = safe_div(F.col("m2"), (F.col("n") - 1).cast("double"))
    base = m.select(
        "fold", "feature", "mean", F.sqrt(var).alias("sd"), var.alias("var"), "min", "max", (F.col("max") - F.col("min")).alias("range"),
        skewness().alias("skewness"), kurtosis().alias("kurtosis"))
    return base.join(q, ["fold", "feature"]).join(mf_mad(x, q), ["fold", "feature"]).withColumns({
        "median": F.col("q50"), "iq_range": F.col("q75") - F.col("q25")}).drop("q25", "q50", "q75")


def mf_means(x: Input) -> DataFrame:
    """Geometric, harmonic and 20 % trimmed mean per (fold, column).

    Geometric and harmonic mean are zero when a value is zero, null when one
    is negative.
    """
    v = F.col("value")
    pos = F.when(v > 0, v)
    sums = fold_sums(x.value_counts, ["feature"], {
        "n": lambda w: w, "neg": lambda w: F.when(v < 0, w).otherwise(0), "zero": lambda w: F.when(v == 0, w).otherwise(0),
        "logs": lambda w: w * F.ln(pos), "inv": lambda w: w / pos})
    guard = lambda e: F.when(F.col("neg") > 0, None).when(F.col("zero") > 0, F.lit(0.0)).otherwise(e)
    gh = sums.select("fold", "feature", guard(F.exp(F.col("logs") / F.col("n"))).alias("g_mean"),
                     guard(safe_div(F.col("n").cast("double"), F.col("inv"))).alias("h_mean"))
    counts = x.value_counts
    totals = counts.groupBy("feature").agg(*[F.sum(w).alias(f"n_{w}") for w in WEIGHTS])
    cum = prefix_sums(value_buckets(counts, "value"), ["feature"], ["value"], {f"c_{w}": w for w in WEIGHTS}).join(totals, "feature")
    per = []
    for i, w in enumerate(WEIGHTS):
        n = F.col(f"n_{w}")
        cut = F.floor(n * F.lit(0.2))
        upper = F.least(F.col(f"c_{w}"), n - cut)
        lower = F.greatest(F.col(f"c_{w}") - F.col(w), cut)
        taken = F.greatest(upper - lower, F.lit(0))
        per.append(F.struct(F.lit(i).alias("fold"), safe_div(F.sum(v * taken), F.sum(taken).cast("double")).alias("t_mean")))
    trimmed = cum.groupBy("feature").agg(F.array(*per).alias("e")).select("feature", F.explode("e").alias("e")).select("feature", "e.*")
    return gh.join(trimmed, ["fold", "feature"])


def mf_sparsity(x: Input) -> DataFrame:
    """(n / distinct - 1) / (n - 1) per (fold, column)."""
    s = fold_sums(x.value_counts, ["feature"], {"n": lambda w: w, "k": lambda w: (w > 0).cast("int")})
    n = F.col("n").cast("double")
    return s.select("fold", "feature", safe_div(n / F.col("k") - 1, n - 1).alias("sparsity"))


def mf_outliers(x: Input) -> DataFrame:
    """Columns with a value more than 1.5 interquartile ranges outside the quartiles."""
    both = x.imputed_moments.join(mf_quartiles(x), ["fold", "feature"])
    iqr = F.col("q75") - F.col("q25")
    out = (F.col("min") < F.col("q25") - 1.5 * iqr) | (F.col("max") > F.col("q75") + 1.5 * iqr)
    return both.groupBy("fold").agg(F.count_if(out).alias("nr_outliers"))


def gram(x: Input, by_class: bool = False) -> DataFrame:
    """Centred cross products of the imputed training part, (fold, [y], i, j, c, n).

    One pass: every task keeps one matrix per (test fold, class) and emits it
    once, so the shuffle carries columns squared numbers per task. A null
    cell is at the mean and adds nothing to a centred product.
    """
    cols, y = x.numeric, x.y
    shift = {r["feature"]: r["m"] for r in x.moments.groupBy("feature").agg(F.avg("mean").alias("m")).collect()}
    offset = np.array([shift.get(c) or 0.0 for c in cols])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            a = pdf[cols].to_numpy(dtype=float, na_value=np.nan) - offset
            seen = ~np.isnan(a)
            a = np.where(seen, a, 0.0)
            s = seen.astype(float)
            for key, idx in pdf.groupby(["test_fold", "y"]).indices.items():
                z, m = a[idx], s[idx]
                block = np.stack([m.T @ m, z.T @ m, m.T @ z, z.T @ z])
                acc[key] = acc[key] + block if key in acc else block
        for (fold, label), b in acc.items():
            i, j = np.triu_indices(len(cols))
            yield pd.DataFrame({
                "test_fold": fold, "y": label, "i": i, "j": j, "n": b[0][i, j], "sx": b[1][i, j], "sy": b[2][i, j], "sxy": b[3][i, j]})

    src = x.df.select("test_fold", (F.col(y).cast("string") if by_class else F.lit("")).alias("y"), *cols)
    parts = src.mapInPandas(partial, "test_fold int, y string, i int, j int, n double, sx double, sy double, sxy double")
    summed = parts.groupBy("test_fold", "y", "i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxy")])
    per = sum_over_train(summed, ["y", "i", "j"], ["n", "sx", "sy", "sxy"])
    # fold means about the same offset; an all-null column has no products
    mean = fill_values(x.moments).select("fold", "feature", "mean", "n")
    idx = F.array_position(F.array(*[F.lit(c) for c in cols]), F.col("feature")).cast("int") - 1
    off = F.element_at(F.array(*[F.lit(float(o)) for o in offset]), idx + 1)
    mu = mean.select("fold", idx.alias("i"), F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.col("mean") - off).alias("mu"))
    a, b = mu.withColumnRenamed("mu", "mu_i"), mu.select("fold", F.col("i").alias("j"), F.col("mu").alias("mu_j"))
    out = per.join(F.broadcast(a), ["fold", "i"]).join(F.broadcast(b), ["fold", "j"])
    c = F.col("sxy") - F.col("mu_i") * F.col("sy") - F.col("mu_j") * F.col("sx") + F.col("n") * F.col("mu_i") * F.col("mu_j")
    return out.select("fold", "y", "i", "j", c.alias("c"))


def mf_cor_cov(x: Input) -> DataFrame:
    """(fold, i, j, cor, cov), absolute values over column pairs i < j; cor null at zero variance."""
    g = gram(x)
    m = x.imputed_moments
    idx = F.array_position(F.array(*[F.lit(c) for c in x.numeric]), F.col("feature")).cast("int") - 1
    v = m.select("fold", idx.alias("i"), F.col("m2"), F.col("n"))
    a = v.withColumnsRenamed({"m2": "vi"})
    b = v.select("fold", F.col("i").alias("j"), F.col("m2").alias("vj"))
    both = g.filter("i < j").join(F.broadcast(a), ["fold", "i"]).join(F.broadcast(b), ["fold", "j"])
    cor = F.when((F.col("vi") > 0) & (F.col("vj") > 0), safe_div(F.abs("c"), F.sqrt(F.col("vi") * F.col("vj"))))
    return both.select("fold", "i", "j", cor.alias("cor"), safe_div(F.abs("c"), (F.col("n") - 1).cast("double")).alias("cov"))


def mf_nr_cor_attr(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    return pairs.groupBy("fold").agg(
        (F.count_if(F.col("cor") >= threshold).cast("double") / F.count("*")).alias("nr_cor_attr"))


def _matrix(pdf: pd.DataFrame, d: int) -> np.ndarray:
    m = np.zeros((d, d))
    m[pdf["i"], pdf["j"]] = pdf["c"]
    return m + np.triu(m, 1).T


def mf_eigenvalues(x: Input) -> DataFrame:
    """(fold, k, eigenvalue) of the covariance matrix, ascending.

    A fold's matrix has columns squared entries; each fold is one small task.
    """
    d = len(x.numeric)
    n = x.imputed_moments.groupBy("fold").agg(F.max("n").alias("n"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        cov = _matrix(pdf, d) / max(pdf["n"].iloc[0] - 1, 1)
        return pd.DataFrame({"fold": pdf["fold"].iloc[0], "k": range(d), "eigenvalue": np.linalg.eigvalsh(cov)})

    return gram(x).join(F.broadcast(n), "fold").groupBy("fold").applyInPandas(solve, "fold int, k int, eigenvalue double")


def class_means(x: Input) -> DataFrame:
    """(fold, y, feature, n, mean) over imputed training rows of each class."""
    long = melt(x.df.withColumn("y", F.col(x.y).cast("string")), ["test_fold", "y"], x.numeric)
    parts = long.groupBy("test_fold", "y", "feature").agg(
        F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("nulls"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("s"))
    per = sum_over_train(parts, ["y", "feature"], ["n", "nulls", "s"])
    mu = fill_values(x.moments).select("fold", "feature", F.col("mean").alias("mu"))
    return per.join(F.broadcast(mu), ["fold", "feature"]).select(
        "fold", "y", "feature", "n", ((F.col("s") + F.col("nulls") * F.col("mu")) / F.col("n")).alias("mean"))


def mf_gravity(x: Input) -> DataFrame:
    """Distance between the centroids of the largest and smallest class (first label on ties)."""
    m = class_means(x)
    sizes = m.groupBy("fold", "y").agg(F.max("n").alias("n"))
    pick = sizes.groupBy("fold").agg(
        F.min(F.struct((-F.col("n")).alias("k"), "y"))["y"].alias("big"), F.min(F.struct(F.col("n").alias("k"), "y"))["y"].alias("low"))
    j = m.join(F.broadcast(pick), "fold")
    per = j.groupBy("fold", "feature").agg(
        F.max(F.when(F.col("y") == F.col("big"), F.col("mean"))).alias("a"), F.max(F.when(F.col("y") == F.col("low"), F.col("mean"))).alias("b"))
    return per.groupBy("fold").agg(F.sqrt(F.sum(F.pow(F.col("a") - F.col("b"), 2))).alias("gravity"))


def mf_nr_norm(x: Input, alpha: float = 0.05) -> DataFrame:
    """Columns that a Jarque-Bera test does not reject as normal.

    Stands in for a small-sample rank test, which has no distributed form.
    """
    n = F.col("n").cast("double")
    s = safe_div(F.col("m3") / n, F.pow(F.col("m2") / n, 1.5))
    k = safe_div(F.col("m4") / n, F.pow(F.col("m2") / n, 2.0)) - 3
    p = F.exp(-(n / 6 * (s * s + k * k / 4)) / 2)
    return x.imputed_moments.groupBy("fold").agg(F.count_if(p >= alpha).alias("nr_norm"))


SCATTER = ("can_cor", "nr_disc", "w_lambda", "p_trace", "lh_trace", "roy_root", "sd_ratio")


def mf_scatter(x: Input) -> DataFrame:
    """Canonical correlations and the classic multivariate test statistics per fold.

    From per-class scatter matrices; the eigen problem of one fold has the
    size of the columns. can_cor is the mean canonical correlation.
    """
    d = len(x.numeric)
    pos = F.array_position(F.array(*[F.lit(c) for c in x.numeric]), F.col("feature")).cast("int") - 1
    means = class_means(x).select("fold", "y", pos.alias("i"), F.lit(-1).alias("j"), F.col("mean").alias("c"), F.col("n").cast("double").alias("n"))
    grams = gram(x, by_class=True).withColumn("n", F.lit(0.0))
    rows = grams.unionByName(means)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        mats, mus, ns = [], [], []
        for _, g in pdf.groupby("y"):
            head = g[g["j"] < 0].sort_values("i")
            mats.append(_matrix(g[g["j"] >= 0], d))
            mus.append(head["c"].to_numpy())
            ns.append(head["n"].iloc[0])
        n, mu = np.array(ns), np.array(mus)
        total = mats[0] * 0 + sum(mats)
        grand = (n[:, None] * mu).sum(0) / n.sum()
        keep = np.diag(total) > 1e-12
        dev = (mu - grand)[:, keep]
        t = total[np.ix_(keep, keep)]
        scale = np.sqrt(np.diag(t))
        t, dev = t / np.outer(scale, scale), dev / scale
        between = (n[:, None, None] * dev[:, :, None] * dev[:, None, :]).sum(0)
        within = t - between
        lam = np.sort(np.clip(np.real(np.linalg.eigvals(np.linalg.pinv(within) @ between)), 0, None))[::-1]
        lam = lam[: max(1, min(len(lam), len(n) - 1))] if len(lam) else np.zeros(1)
        sd = None
        p, q = int(keep.sum()), len(n)
        if p and q > 1 and (n > p).all():
            s_c = [(m[np.ix_(keep, keep)] / np.outer(scale, scale) - k * np.outer(v, v)) / (k - 1) for m, k, v in zip(mats, n, dev)]
            pooled = within / (n.sum() - q)
            dets = [np.linalg.slogdet(s) for s in s_c]
            if all(g > 0 for g, _ in dets) and np.linalg.slogdet(pooled)[0] > 0:
                gamma = 1 - (2 * p * p + 3 * p - 1) / (6 * (p + 1) * (q - 1)) * ((1 / (n - 1)).sum() - 1 / (n.sum() - q))
                m_stat = gamma * ((n - 1) * (np.linalg.slogdet(pooled)[1] - np.array([v for _, v in dets]))).sum()
                sd = float(np.exp(m_stat / (p * (n - 1).sum())))
        return pd.DataFrame([{
            "fold": int(pdf["fold"].iloc[0]), "can_cor": float(np.sqrt(lam / (1 + lam)).mean()), "nr_disc": float((lam > 1e-12).sum()),
            "w_lambda": float(np.prod(1 / (1 + lam))), "p_trace": float((lam / (1 + lam)).sum()), "lh_trace": float(lam.sum()),
            "roy_root": float(lam.max()), "sd_ratio": sd}])

    return rows.groupBy("fold").applyInPandas(solve, "fold int, " + ", ".join(f"{c} double" for c in SCATTER))


# --- information theory -----------------------------------------------------------------------
def _entropies(counts: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Base-2 entropy of the counts of each key per fold: log2(n) - sum(c log2 c) / n."""
    s = fold_sums(counts, keys, {"n": lambda w: w, "e": lambda w: F.when(w > 0, w * F.log2(w)).otherwise(0.0)})
    n = F.col("n").cast("double")
    return s.select("fold", *keys, F.greatest(F.log2(n) - F.col("e") / n, F.lit(0.0)).alias(name))


def mf_attr_ent(x: Input) -> DataFrame:
    vals = x.category_counts.groupBy("feature", "value").agg(*[F.sum(w).alias(w) for w in WEIGHTS])
    return _entropies(vals, ["feature"], "attr_ent")


def mf_class_ent(x: Input) -> DataFrame:
    return _entropies(x.class_counts, [], "class_ent")


def mf_joint_ent(x: Input) -> DataFrame:
    return _entropies(x.category_counts, ["feature"], "joint_ent")


def mf_info(x: Input) -> DataFrame:
    """attr_ent, joint_ent, class_ent and mut_inf per (fold, categorical column)."""
    out = mf_attr_ent(x).join(mf_joint_ent(x), ["fold", "feature"]).join(F.broadcast(mf_class_ent(x)), "fold")
    return out.withColumn("mut_inf", F.col("attr_ent") + F.col("class_ent") - F.col("joint_ent"))


def mf_info_ratios(info: DataFrame) -> DataFrame:
    """eq_num_attr and ns_ratio per fold."""
    g = info.groupBy("fold").agg(F.avg("attr_ent").alias("a"), F.avg("mut_inf").alias("m"), F.max("class_ent").alias("c"))
    return g.select("fold", safe_div(F.col("c"), F.col("m")).alias("eq_num_attr"), safe_div(F.col("a") - F.col("m"), F.col("m")).alias("ns_ratio"))


def _concentration(counts: DataFrame, keys: Sequence[str], given: str, target: str, name: str) -> DataFrame:
    """Goodman-Kruskal tau: how far `given` fixes `target`; null when target is constant."""
    n = fold_sums(counts, keys, {"n": lambda w: w})
    per = F.explode(F.array(*[F.struct(F.lit(i).alias("fold"), F.col(w).alias("c")) for i, w in enumerate(WEIGHTS)]))
    cells = counts.select(*keys, given, target, per.alias("e")).select(*keys, given, target, "e.*").filter("c > 0")
    c = F.col("c").cast("double")
    rows = cells.groupBy("fold", *keys, given).agg((F.sum(c * c) / F.sum(c)).alias("s")).groupBy("fold", *keys).agg(F.sum("s").alias("s"))
    cols = cells.groupBy("fold", *keys, target).agg(F.sum(c).alias("t")).groupBy("fold", *keys).agg(F.sum(F.col("t") * F.col("t")).alias("t2"))
    j = rows.join(cols, ["fold", *keys]).join(n, ["fold", *keys])
    nn = F.col("n").cast("double")
    marg = F.col("t2") / (nn * nn)
    return j.select("fold", *keys, safe_div(F.col("s") / nn - marg, F.lit(1.0) - marg).alias(name))


def mf_class_conc(x: Input) -> DataFrame:
    """(fold, feature, class_conc): attribute to class."""
    return _concentration(x.category_counts, ["feature"], "value", "y", "class_conc")


def mf_attr_conc(x: Input) -> DataFrame:
    """(fold, given, target, attr_conc) over ordered pairs of categorical columns.

    Column pairs come from the schema; rows are counted per pair of values in
    the map tasks before the shuffle.
    """
    cols = {c: F.coalesce(F.col(c), F.lit(NULL_CATEGORY)) for c in x.categorical}
    pairs = [
        F.struct(F.lit(a).alias("given"), F.lit(b).alias("target"), cols[a].alias("u"), cols[b].alias("v"))
        for a in cols for b in cols if a != b]
    long = x.df.select("test_fold", F.explode(F.array(*pairs)).alias("p")).select("test_fold", "p.*")
    counts = long.groupBy("given", "target", "u", "v").agg(*train_weights(x.df))
    return _concentration(counts, ["given", "target"], "u", "v", "attr_conc")


# --- feature choice ----------------------------------------------------------------------------
def mutual_information(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], y: str, bins: int = 32) -> DataFrame:
    """(feature, mut_inf) in bits, numeric columns in equal-frequency bins."""
    from gradus.operators.prep import cut
    from gradus.plans.ordering import quantile_grid

    cols = {c: F.coalesce(F.col(c).cast("string"), F.lit(NULL_CATEGORY)) for c in categorical}
    if numeric:
        counts = melt(df, [], numeric).filter("value IS NOT NULL").groupBy("feature", "value").agg(F.count("*").alias("n_rows"))
        edges: dict[str, set] = {}
        for r in quantile_grid(counts, ["feature"], "value", ["n_rows"], bins + 1, shrink=False).collect():
            edges.setdefault(r["feature"], set()).add(r["value"])
        for c in numeric:
            binned = cut(c, sorted(edges[c])) if c in edges else F.lit(0)
            cols[c] = F.when(F.col(c).isNull(), NULL_CATEGORY).otherwise(binned.cast("string"))
    long = df.select(F.col(y).cast("string").alias("y"), *[v.alias(c) for c, v in cols.items()]).unpivot(
        ["y"], list(cols), "feature", "value")
    cell = long.groupBy("feature", "value", "y").agg(F.count("*").alias("c"))
    ent = lambda: F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")
    joint = cell.groupBy("feature").agg(ent().alias("j"))
    attr = cell.groupBy("feature", "value").agg(F.sum("c").alias("c")).groupBy("feature").agg(ent().alias("a"))
    cls = cell.groupBy("feature", "y").agg(F.sum("c").alias("c")).groupBy("feature").agg(ent().alias("k"))
    return joint.join(attr, "feature").join(cls, "feature").select("feature", (F.col("a") + F.col("k") - F.col("j")).alias("mut_inf"))


def select_k_best(
    df: DataFrame, features: Sequence[str], numeric: Sequence[str], y: str, k: int, estimate: str = "nearest",
) -> tuple[list[str], DataFrame]:
    """The k features that tell most about y, in table order, and their scores.

    Numeric columns are judged by the nearest-neighbour estimate, or with `estimate="binned"` in equal-frequency bins;
    categories by their counts. Fit on the first training part and reuse the names for every other part.
    """
    if estimate not in ("nearest", "binned"):
        raise ValueError(f"unknown estimate: {estimate}")
    num = [c for c in features if c in set(numeric)]
    cat = [c for c in features if c not in set(num)]
    if estimate == "binned" or not num:
        scores = mutual_information(df, num, cat, y)
    else:
        scores = nearest_information(df, num, y)
        scores = scores.unionByName(mutual_information(df, [], cat, y)) if cat else scores
    top = {r["feature"] for r in scores.orderBy(F.desc(F.round("mut_inf", 9)), "feature").limit(k).collect()}
    return [c for c in features if c in top], scores


# --- landmarking ----------------------------------------------------------------------------------
def _balanced(scored: DataFrame, name: str, extra: Sequence[str] = ()) -> DataFrame:
    per = scored.groupBy("fold", *extra, "y").agg(F.avg((F.col("y") == F.col("pred")).cast("double")).alias("r"))
    return per.groupBy("fold", *extra).agg(F.avg("r").alias(name))


def mf_naive_bayes(x: Input) -> DataFrame:
    """Balanced accuracy of Gaussian naive Bayes, trained per fold, scored on its test part.

    Each row is a test row of one fold, so every row is scored once, by a
    Column expression over that fold's class parameters.
    """
    mu = fill_values(x.moments).select("fold", "feature", F.col("mean").alias("mu"))
    long = melt(x.df.withColumn("y", F.col(x.y).cast("string")), ["test_fold", "y"], x.numeric)
    parts = long.groupBy("test_fold", "y", "feature").agg(
        F.count("*").alias("rows"), F.count("value").alias("n"), F.avg("value").alias("m"), (F.var_pop("value") * F.count("value")).alias("m2"))
    per = to_train_folds(parts).join(F.broadcast(mu), ["fold", "feature"])
    # imputed class mean, then squared deviations about it, nulls standing at mu
    n, rows, m = F.col("n"), F.col("rows"), F.coalesce(F.col("m"), F.lit(0.0))
    cm = per.groupBy("fold", "y", "feature").agg(
        (F.sum(n * m + (rows - n) * F.col("mu")) / F.sum("rows")).alias("mean"), F.sum("rows").alias("n_rows"))
    dev = per.join(cm.select("fold", "y", "feature", "mean"), ["fold", "y", "feature"])
    cv = dev.groupBy("fold", "y", "feature").agg((F.sum(
        F.coalesce(F.col("m2"), F.lit(0.0)) + n * F.pow(m - F.col("mean"), 2) + (rows - n) * F.pow(F.col("mu") - F.col("mean"), 2)
    ) / F.sum("rows")).alias("var"))
    # fixed value: share of the largest column variance that is added to every variance
    eps = x.imputed_moments.groupBy("fold").agg((F.lit(1e-9) * F.max(F.col("m2") / F.col("n"))).alias("eps"))
    params = cm.join(cv, ["fold", "y", "feature"]).join(F.broadcast(eps), "fold").withColumn("var", F.col("var") + F.col("eps"))
    pos = F.array_position(F.array(*[F.lit(c) for c in x.numeric]), F.col("feature"))
    model = params.groupBy("fold", "y").agg(
        F.max("n_rows").alias("n_rows"), F.array_sort(F.collect_list(F.struct(pos.alias("i"), "mean", "var"))).alias("p"))
    model = model.groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("y", "n_rows", "p"))).alias("classes"))
    fills = mu.groupBy("fold").agg(F.array_sort(F.collect_list(F.struct(pos.alias("i"), "mu"))).alias("fill"))
    rows_in = x.df.select(F.col("test_fold").alias("fold"), F.col(x.y).cast("string").alias("y"),
                          F.array(*[F.col(c).cast("double") for c in x.numeric]).alias("v"))
    scored = rows_in.join(F.broadcast(model), "fold").join(F.broadcast(fills), "fold").withColumn(
        "v", F.zip_with("v", "fill", lambda a, f: F.coalesce(a, f["mu"])))

    def loglik(c: Column) -> Column:
        terms = F.zip_with(c["p"], "v", lambda p, v: -F.lit(0.5) * (F.ln(F.lit(2 * np.pi) * p["var"]) + F.pow(v - p["mean"], 2) / p["var"]))
        return F.aggregate(terms, F.ln(c["n_rows"].cast("double")), lambda s, t: s + t)

    best = F.aggregate(
        F.transform("classes", lambda c: F.struct(loglik(c).alias("s"), c["y"].alias("y"))),
        F.struct(F.lit(float("-inf")).alias("s"), F.lit(None).cast("string").alias("y")),
        lambda a, b: F.when(b["s"] > a["s"], b).otherwise(a))
    return _balanced(scored.select("fold", "y", best["y"].alias("pred")), "naive_bayes")


def _n_log_n(c: Column) -> Column:
    return F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(0.0)


def stumps(x: Input, seed: int = 0) -> DataFrame:
    """Best binary split of every numeric column per fold, by information gain, for any number of classes.

    n times the entropy of a side is n log n minus the sum of c log c over its classes. Moving one (value, class)
    cell from right to left changes one term on either side, so running sums of these changes along the values give
    both entropies: a first pass counts each class up to a value, a second adds up the changes. Folds are columns of
    both passes, and no column, plan branch or row holds all classes. The split is at most that value; equal gains
    go to the smallest, and a side's label is its most frequent class, ties to the smallest. Rows without a label
    are left out. Returns (fold, feature, threshold, gain, left, right).
    """
    counts = written(_imputed_class_counts(x).filter("y IS NOT NULL"), "class-value-counts")
    folds = range(N_FOLDS)
    of_class = prefix_sums(value_buckets(counts, "value", cut_points(counts, "value")), ["feature", "y"], ["value"], {f"l{i}": w for i, w in enumerate(WEIGHTS)})
    total = counts.groupBy("feature", "y").agg(*[F.sum(w).alias(f"t{i}") for i, w in enumerate(WEIGHTS)])
    cell = of_class.join(total, ["feature", "y"])

    def changes(i: int) -> list[Column]:
        c, after, rest = F.col(f"w{i}"), F.col(f"l{i}"), F.col(f"t{i}") - F.col(f"l{i}")
        return [F.sum(_n_log_n(after) - _n_log_n(after - c)).alias(f"a{i}"), F.sum(_n_log_n(rest) - _n_log_n(rest + c)).alias(f"b{i}"), F.sum(c).alias(f"n{i}")]

    step = cell.groupBy("feature", BUCKET, "value").agg(*[c for i in folds for c in changes(i)])
    along = prefix_sums(step, ["feature"], ["value"], {f"s{k}{i}": f"{k}{i}" for i in folds for k in "abn"})
    whole = total.groupBy("feature").agg(*[e for i in folds for e in (F.sum(f"t{i}").alias(f"n_all{i}"), F.sum(_n_log_n(F.col(f"t{i}"))).alias(f"c_all{i}"))])
    j = along.join(F.broadcast(whole), "feature")  # one row a column of the table

    def gain(i: int) -> Column:
        n, terms, left = F.col(f"n_all{i}"), F.col(f"c_all{i}"), F.col(f"sn{i}")
        sides = _n_log_n(left) - F.col(f"sa{i}") + _n_log_n(n - left) - terms - F.col(f"sb{i}")
        return F.round((_n_log_n(n) - terms - sides) / n, 9)

    top = lambda i: F.min(F.when(F.col(f"n{i}") > 0, F.struct((-gain(i)).alias("g"), F.col("value").alias("v"))))
    best = written(j.groupBy("feature").agg(*[top(i).alias(f"best{i}") for i in folds]), "splits")
    below = lambda i: F.sum(F.when(F.col("value") <= F.col(f"best{i}.v"), F.col(f"w{i}")).otherwise(0))
    sides = counts.join(F.broadcast(best), "feature").groupBy("feature", "y").agg(F.array(*[
        F.struct(F.lit(i).alias("fold"), F.first(f"best{i}").alias("b"), below(i).alias("l"), (F.sum(f"w{i}") - below(i)).alias("r")) for i in folds]).alias("e"))
    sides = sides.select("feature", "y", F.explode("e").alias("e")).select("feature", "y", "e.*").filter("b IS NOT NULL")
    most = lambda c: F.min(F.struct((-F.col(c)).alias("n"), "y"))["y"]
    picked = sides.groupBy("fold", "feature").agg(F.first("b").alias("b"), most("l").alias("left"), F.when(F.sum("r") > 0, most("r")).alias("right"))
    return picked.select("fold", "feature", F.col("b.v").alias("threshold"), (-F.col("b.g")).alias("gain"), "left", F.coalesce("right", "left").alias("right"))


def _imputed_class_counts(x: Input) -> DataFrame:
    """(feature, value, y, w0..w9) of imputed training values; nulls at the fold mean."""
    src = x.df.withColumn("y", F.col(x.y).cast("string"))
    long = melt(src, ["test_fold", "y"], x.numeric)
    seen = long.filter("value IS NOT NULL").groupBy("feature", "value", "y").agg(*train_weights(x.df))
    nulls = long.filter("value IS NULL").groupBy("feature", "y").agg(*train_weights(x.df))
    per = F.explode(F.array(*[F.struct(F.lit(i).alias("fold"), F.col(w).alias("c")) for i, w in enumerate(WEIGHTS)]))
    placed = nulls.select("feature", "y", per.alias("e")).select("feature", "y", "e.*").filter("c > 0").join(
        F.broadcast(fill_values(x.moments).select("fold", "feature", F.col("mean").alias("value"))), ["fold", "feature"])
    at_mean = placed.select("feature", "value", "y", *[F.when(F.col("fold") == i, F.col("c")).otherwise(F.lit(0)).cast("bigint").alias(w) for i, w in enumerate(WEIGHTS)])
    return seen.unionByName(at_mean).groupBy("feature", "value", "y").agg(*[F.sum(w).alias(w) for w in WEIGHTS])


def mf_nodes(x: Input, seed: int = 0) -> DataFrame:
    """best_node, worst_node, random_node: balanced accuracy of one-split trees.

    The best and worst columns are those of largest and smallest gain; the
    random one is the first in hash order.
    """
    s = fixed_stats(stumps(x))
    pick = s.groupBy("fold").agg(
        F.min(F.struct((-F.col("gain")).alias("k"), "feature", "threshold", "left", "right")).alias("best_node"),
        F.min(F.struct(F.col("gain").alias("k"), "feature", "threshold", "left", "right")).alias("worst_node"),
        F.min(F.struct(F.lit(0.0).alias("k"), hash_order("feature", seed).alias("h"), "feature", "threshold", "left", "right")).alias("r"))
    pick = pick.withColumn("random_node", F.struct(F.col("r.k").alias("k"), F.col("r.feature").alias("feature"), F.col("r.threshold").alias("threshold"),
                                                   F.col("r.left").alias("left"), F.col("r.right").alias("right"))).drop("r")
    kinds = ["best_node", "worst_node", "random_node"]
    one = pick.select("fold", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("s")) for k in kinds])).alias("e")).select("fold", "e.kind", "e.s.*")
    fill = fill_values(x.moments).select("fold", "feature", F.col("mean").alias("mu"))
    rules = one.join(F.broadcast(fill), ["fold", "feature"])
    rows = x.df.select(F.col("test_fold").alias("fold"), F.col(x.y).cast("string").alias("y"),
                       F.create_map(*[v for c in x.numeric for v in (F.lit(c), F.col(c).cast("double"))]).alias("v"))
    scored = rows.join(F.broadcast(rules), "fold").withColumn("x", F.coalesce(F.try_element_at("v", F.col("feature")), F.col("mu")))
    pred = F.when(F.col("x") <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
    acc = _balanced(scored.select("fold", "kind", "y", pred.alias("pred")), "score", ["kind"])
    return acc.groupBy("fold").agg(*[F.max(F.when(F.col("kind") == k, F.col("score"))).alias(k) for k in kinds])


def mf_linear_discr(x: Input) -> DataFrame:
    """Balanced accuracy of linear discriminant analysis per fold, scored on the test part.

    The pooled within-class scatter comes from the one-pass Gram matrices;
    the discriminant is linear, so rows are scored by a Column expression.
    """
    d = len(x.numeric)
    pos = F.array_position(F.array(*[F.lit(c) for c in x.numeric]), F.col("feature")).cast("int") - 1
    means = class_means(x).select("fold", "y", pos.alias("i"), F.lit(-1).alias("j"), F.col("mean").alias("c"), F.col("n").cast("double").alias("n"))
    rows = gram(x, by_class=True).withColumn("n", F.lit(0.0)).unionByName(means)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        total, mus, ns, labels = np.zeros((d, d)), [], [], []
        for label, g in pdf.groupby("y"):
            head = g[g["j"] < 0].sort_values("i")
            total += _matrix(g[g["j"] >= 0], d)
            mus.append(head["c"].to_numpy())
            ns.append(head["n"].iloc[0])
            labels.append(label)
        n, mu = np.array(ns), np.array(mus)
        grand = (n[:, None] * mu).sum(0) / n.sum()
        dev = mu - grand
        within = total - (n[:, None, None] * dev[:, :, None] * dev[:, None, :]).sum(0)
        inv = np.linalg.pinv(within / max(n.sum() - len(n), 1), hermitian=True)
        w = mu @ inv
        b = np.log(n / n.sum()) - 0.5 * (w * mu).sum(1)
        return pd.DataFrame({"fold": int(pdf["fold"].iloc[0]), "label": labels, "w": list(w), "b": b})

    model = rows.groupBy("fold").applyInPandas(solve, "fold int, label string, w array<double>, b double")
    fill = fill_values(x.moments).groupBy("fold").agg(F.array_sort(F.collect_list(F.struct(
        F.array_position(F.array(*[F.lit(c) for c in x.numeric]), F.col("feature")).alias("i"), "mean"))).alias("fill"))
    per = model.groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("label", "w", "b"))).alias("classes"))
    src = x.df.select(F.col("test_fold").alias("fold"), F.col(x.y).cast("string").alias("y"), F.array(*[F.col(c).cast("double") for c in x.numeric]).alias("v"))
    scored = src.join(F.broadcast(per), "fold").join(F.broadcast(fill), "fold").withColumn(
        "v", F.zip_with("v", "fill", lambda a, f: F.coalesce(a, f["mean"])))
    best = F.aggregate(
        F.transform("classes", lambda c: F.struct(
            F.aggregate(F.zip_with(c["w"], "v", lambda p, q: p * q), c["b"], lambda s, t: s + t).alias("s"), c["label"].alias("y"))),
        F.struct(F.lit(float("-inf")).alias("s"), F.lit(None).cast("string").alias("y")),
        lambda a, b: F.when(b["s"] > a["s"], b).otherwise(a))
    return _balanced(scored.select("fold", "y", best["y"].alias("pred")), "linear_discr")


def mf_relative(landmarks: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rank of every landmark within its fold (1 is lowest), ties averaged."""
    long = landmarks.unpivot(["fold"], list(names), "feature", "value")
    w = W.partitionBy("fold").orderBy("value")
    tie = F.count("*").over(W.partitionBy("fold", "value"))
    return long.withColumn("rank", F.when(F.col("value").isNotNull(), F.rank().over(w) + (tie - 1) / F.lit(2.0))).select("fold", "feature", "rank")


# --- summaries and export ------------------------------------------------------------------------
SUMMARIES = ("mean", "sd", "count", "iq_range", "kurtosis", "max", "median", "min", "range", "skewness") + tuple(
    f"quantiles_{i}" for i in range(5)) + tuple(f"histogram_{i}" for i in range(10))


def summarise(long: DataFrame) -> DataFrame:
    """Twelve summary functions of every vector (fold, grp, feature), as long rows.

    A vector has one entry per column, column pair or class, which bounds it.
    """
    keys = ["fold", "grp", "feature"]
    v = F.col("value").cast("double")
    w = W.partitionBy(*keys)
    lo, hi = F.min(v).over(w), F.max(v).over(w)
    # equal bins over the range, the last one closed; a constant vector fills the middle bin
    slot = F.when(hi > lo, F.least(F.floor(safe_div((v - lo) * 10, hi - lo)), F.lit(9))).otherwise(F.lit(5))
    src = long.filter(F.col("value").isNotNull()).withColumn("_slot", slot)
    n = F.count(v).cast("double")
    g = F.try_divide((n - 1), n)
    q = F.percentile(v, F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    agg = src.groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), n.alias("count"), F.max(v).alias("max"), F.min(v).alias("min"),
        (F.max(v) - F.min(v)).alias("range"), q.alias("_q"),
        F.when(F.var_pop(v) > 0, F.skewness(v) * F.pow(g, 1.5)).alias("skewness"),
        F.when(F.var_pop(v) > 0, (F.kurtosis(v) + 3) * F.pow(g, 2.0) - 3).alias("kurtosis"),
        *[(F.count_if(F.col("_slot") == i) / n).alias(f"histogram_{i}") for i in range(10)])
    wide = agg.withColumns({f"quantiles_{i}": F.col("_q")[i] for i in range(5)}).withColumns({
        "median": F.col("_q")[2], "iq_range": F.col("_q")[3] - F.col("_q")[1]}).drop("_q")
    return wide.unpivot(keys, list(SUMMARIES), "summary", "value")


def column_name(prefix: str = "f__pymfe.") -> Column:
    """{prefix}{group}.{feature}[.{summary}]; numbered summaries use a dot before the number."""
    summary = F.regexp_replace("summary", "_(\\d)$", ".$1")
    return F.when(F.col("summary").isNull(), F.concat(F.lit(prefix), "grp", F.lit("."), "feature")).otherwise(
        F.concat(F.lit(prefix), "grp", F.lit("."), "feature", F.lit("."), summary))


def export_wide(long: DataFrame, dataset: str, names: Sequence[str], prefix: str = "f__pymfe.") -> DataFrame:
    """One row per fold with a fixed list of metafeature columns, key {dataset}__fold_{i}."""
    named = long.withColumn("_c", column_name(prefix)).withColumn("dataset_name", F.concat(F.lit(f"{dataset}__fold_"), F.col("fold")))
    return named.groupBy("dataset_name").pivot("_c", list(names)).agg(F.first("value"))


def pending_featurisation(catalog: DataFrame, done: DataFrame) -> DataFrame:
    """Classification datasets whose first fold has no metafeature row yet."""
    todo = catalog.filter(F.col("target_type") != "regression").withColumn("_k", F.concat("dataset_name", F.lit("__fold_0")))
    return todo.join(done.select(F.col("dataset_name").alias("_k")), "_k", "left_anti").drop("_k")


def attribute_vectors(x: Input) -> list[DataFrame]:
    """The long metafeature vectors: one value per column, pair of columns, class or eigenvalue."""
    wide = lambda df, group: long_rows(df, group, [c for c in df.columns if c not in ("fold", "feature")], attribute=True)
    frames = [wide(mf_freq_class(x).withColumnRenamed("y", "feature"), "general")]
    if x.numeric:
        frames += [wide(f(x), "statistical") for f in (mf_column_stats, mf_means, mf_sparsity)]
        eigen = mf_eigenvalues(x).select("fold", F.col("k").cast("string").alias("feature"), F.col("eigenvalue").alias("eigenvalues"))
        frames.append(wide(eigen, "statistical"))
    if len(x.numeric) > 1:
        pair = F.concat_ws("-", F.col("i").cast("string"), F.col("j").cast("string"))
        frames.append(wide(mf_cor_cov(x).select("fold", pair.alias("feature"), "cor", "cov"), "statistical"))
    if x.categorical:
        frames += [wide(mf_info(x).drop("class_ent"), "info-theory"), wide(mf_class_conc(x), "info-theory")]
    if len(x.categorical) > 1:
        conc = mf_attr_conc(x).select("fold", F.concat_ws("-", "given", "target").alias("feature"), "attr_conc")
        frames.append(wide(conc, "info-theory"))
    return frames


def landmarks(x: Input) -> tuple[DataFrame, list[str]]:
    """One row per fold with every landmark learner's balanced accuracy, and their names."""
    names = ["naive_bayes", "best_node", "random_node", "worst_node", "linear_discr"]
    return written(mf_naive_bayes(x).join(mf_nodes(x), "fold", "outer").join(mf_linear_discr(x), "fold", "outer").select("fold", *names), "landmarks"), names


def featurise(x: Input) -> DataFrame:
    """Long metafeatures (fold, grp, feature, summary, value) of every fold, all groups.

    Scalars have no summary; vectors have every one of SUMMARIES, unless all of their values are null. Groups that need numeric columns, categories or pairs
    of them are left out where the table has none. Each operator's rows are written before they meet, so that the plan
    of the whole stays a union of small tables and a lost executor repeats one operator.
    """
    single = lambda df, group: long_rows(df, group, [c for c in df.columns if c != "fold"])
    general = mf_general(x)
    scalars = [single(general, "general"), single(mf_ratios(general), "general"), single(mf_class_ent(x), "info-theory")]
    if x.numeric:
        scalars += [single(f(x), "statistical") for f in (mf_outliers, mf_gravity, mf_nr_norm, mf_scatter)]
        marks, names = landmarks(x)
        scalars.append(single(marks, "landmarking"))
        scalars.append(mf_relative(marks.withColumns({n: F.round(n, 9) for n in names}), names).select(
            "fold", F.lit("relative").alias("grp"), "feature", F.lit(None).cast("string").alias("attribute"), F.col("rank").cast("double").alias("value")))
    if len(x.numeric) > 1:
        scalars.append(single(mf_nr_cor_attr(mf_cor_cov(x)), "statistical"))
    if x.categorical:
        scalars.append(single(mf_info_ratios(mf_info(x)), "info-theory"))
    kept = lambda frames: reduce(DataFrame.unionByName, [written(f, "metafeatures") for f in frames])
    flat = kept(scalars).select("fold", "grp", "feature", F.lit(None).cast("string").alias("summary"), "value")
    return summarise(kept(attribute_vectors(x))).unionByName(flat)
