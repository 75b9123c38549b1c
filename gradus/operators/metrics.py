"""Metrics on prediction tables, for any number of groups in one aggregate.

Simple metrics are Column aggregates. Metrics that need an order (AUC) first
count rows per (group, score), so a group is as large as its distinct scores,
and sum along ordered score buckets, so even those are spread over tasks.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gradus.functions.scalar import argmax, array_sum, at, clip, mean_abs_diff, safe_div
from gradus.plans.ordering import cut_points, order_buckets, prefix_sums, value_buckets
from gradus.session import written

# fixed value: machine epsilon of a double, the clipping bound of log loss
EPS = 2.220446049250313e-16


def _d(c: str) -> Column:
    return F.col(c).cast("double")


# --- column aggregates -------------------------------------------------------------
def mse(y: str, p: str) -> Column:
    return F.avg((_d(y) - _d(p)) * (_d(y) - _d(p)))


def rmse(y: str, p: str) -> Column:
    return F.sqrt(mse(y, p))


def mae(y: str, p: str) -> Column:
    return F.avg(F.abs(_d(y) - _d(p)))


def msle(y: str, p: str) -> Column:
    """Mean squared log error with predictions clipped at zero; no square root is taken."""
    e = F.log1p(_d(y)) - F.log1p(F.greatest(_d(p), F.lit(0.0)))
    return F.avg(e * e)


def r2(y: str, p: str) -> Column:
    """1 - SSE / SST about the mean of y; null when y is constant."""
    both = F.col(y).isNotNull() & F.col(p).isNotNull()
    e = F.when(both, _d(y) - _d(p))
    return F.lit(1.0) - safe_div(F.sum(e * e), F.count(e) * F.var_pop(F.when(both, _d(y))))


def accuracy(y: str, p: str) -> Column:
    return F.avg((F.col(y) == F.col(p)).cast("double"))


def f1_micro(y: str, p: str) -> Column:
    """Pooled F1: each wrong row is one false positive and one false negative."""
    tp, wrong = F.count_if(F.col(y) == F.col(p)), F.count_if(F.col(y) != F.col(p))
    return safe_div(tp.cast("double"), tp + F.lit(0.5) * (wrong + wrong))


def log_loss(y: str, proba: str) -> Column:
    """Mean negative log of the true class's share of the clipped probabilities."""
    q = F.transform(F.col(proba), lambda v: clip(v, EPS, 1.0 - EPS))
    return F.avg(-F.ln(at(q, F.col(y)) / array_sum(q)))


def log_loss_binary(y: str, score: str) -> Column:
    """The same for one probability of the positive class."""
    p = clip(_d(score), EPS, 1.0 - EPS)
    n = clip(F.lit(1.0) - _d(score), EPS, 1.0 - EPS)
    return F.avg(-F.ln(F.when(F.col(y) == 1, p).otherwise(n) / (p + n)))


REGISTRY: dict[str, Callable[[str, str], Column]] = {}


def register(name: str):
    """Add a metric by name; a name can be taken once."""
    def add(fn: Callable[[str, str], Column]):
        if name in REGISTRY:
            raise ValueError(f"metric {name} is registered already")
        REGISTRY[name] = fn
        return fn

    return add


for _name, _fn in {
    "mse": mse, "rmse": rmse, "mae": mae, "rmsle": msle, "r2": r2, "accuracy": accuracy, "f1_micro": f1_micro,
    "log_loss": log_loss, "log_loss_binary": log_loss_binary,
}.items():
    register(_name)(_fn)


def get_metric(name: str) -> Callable[[str, str], Column]:
    if name not in REGISTRY:
        raise KeyError(f"no metric named {name}; have {sorted(REGISTRY)}")
    return REGISTRY[name]


def metric(df: DataFrame, keys: Sequence[str], y: str, p: str, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(get_metric(name)(y, p).alias(name))


def score(df: DataFrame, keys: Sequence[str], y: str, p: str, metrics: Sequence[str], prefix: str = "") -> DataFrame:
    """Several named metrics in one aggregate, columns prefix + name."""
    return df.groupBy(*keys).agg(*[get_metric(m)(y, p).alias(prefix + m) for m in metrics])


def score_outputs(df: DataFrame, keys: Sequence[str], ys: Sequence[str], ps: Sequence[str], name: str) -> DataFrame:
    """One metric averaged over several output columns."""
    cols = [get_metric(name)(y, p).alias(f"_m{i}") for i, (y, p) in enumerate(zip(ys, ps))]
    out = df.groupBy(*keys).agg(*cols)
    total = sum((F.col(f"_m{i}") for i in range(1, len(ys))), F.col("_m0"))
    return out.select(*keys, (total / len(ys)).alias(name))


# --- per-class metrics -----------------------------------------------------------------
def class_counts(df: DataFrame, keys: Sequence[str], y: str, p: str) -> DataFrame:
    """Support, predicted count and true positives per (group, class).

    Rows are reduced to the confusion counts before anything else happens.
    """
    conf = df.groupBy(*keys, F.col(y).alias("_y"), F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    both = F.explode(F.array(
        F.struct(F.col("_y").alias("cls"), F.col("_n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(F.lit(0)).alias("tp")),
        F.struct(F.col("_p").alias("cls"), F.lit(0).cast("bigint").alias("support"), F.col("_n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("tp")),
    ))
    return conf.select(*keys, both.alias("c")).select(*keys, "c.*").groupBy(*keys, "cls").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "tp")]
    )


def f1_weighted(df: DataFrame, keys: Sequence[str], y: str, p: str) -> DataFrame:
    """Per-class F1 weighted by support; a class without a hit counts zero."""
    f1 = F.coalesce(safe_div(F.lit(2.0) * F.col("tp"), (F.col("support") + F.col("predicted")).cast("double")), F.lit(0.0))
    return class_counts(df, keys, y, p).groupBy(*keys).agg(
        safe_div(F.sum(f1 * F.col("support")), F.sum("support").cast("double")).alias("f1_weighted"))


def balanced_accuracy(df: DataFrame, keys: Sequence[str], y: str, p: str) -> DataFrame:
    """Mean recall over the classes that occur."""
    return class_counts(df, keys, y, p).filter("support > 0").groupBy(*keys).agg(
        F.avg(F.col("tp").cast("double") / F.col("support")).alias("balanced_accuracy"))


# --- AUC -------------------------------------------------------------------------------
def roc_auc(df: DataFrame, keys: Sequence[str], y: str, s: str) -> DataFrame:
    """Binary AUC with ties at their average rank; null when a class is absent."""
    per = df.filter(F.col(s).isNotNull()).groupBy(*keys, F.col(s).cast("double").alias("_s")).agg(
        F.count_if(F.col(y) == 1).alias("_pos"), F.count_if(F.col(y) != 1).alias("_neg"))
    # the cuts only balance the buckets, so they come from the unshuffled rows
    cum = prefix_sums(value_buckets(per, "_s", cut_points(df, s)), keys, ["_s"], {"_below": "_neg"}, inclusive=False)
    wins = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / F.lit(2.0)))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg").cast("double")
    return cum.groupBy(*keys).agg(safe_div(wins.cast("double"), pairs).alias("auc"))


def roc_auc_ovo(df: DataFrame, keys: Sequence[str], y: str, proba: str, n_classes: int) -> DataFrame:
    """One-against-one AUC, macro mean over class pairs of (AUC(a|b) + AUC(b|a)) / 2.

    For every class a the rows are counted per (group, a, score of a) with one
    count column per class; one running sum then serves all pairs of a. Null
    when any class is absent from the group.
    """
    c = range(n_classes)
    cells = F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.element_at(F.col(proba), a + 1).cast("double").alias("s")) for a in c]))
    long = df.select(*keys, F.col(y).alias("_y"), cells.alias("e")).select(*keys, "_y", "e.a", "e.s")
    per = long.groupBy(*keys, "a", "s").agg(*[F.count_if(F.col("_y") == b).alias(f"n{b}") for b in c])
    cum = prefix_sums(value_buckets(per, "s", cut_points(long, "s")), [*keys, "a"], ["s"], {f"below{b}": f"n{b}" for b in c}, inclusive=False)
    pos = F.element_at(F.array(*[F.col(f"n{b}") for b in c]), F.col("a") + 1)
    tot = cum.groupBy(*keys, "a").agg(
        F.sum(pos).cast("double").alias("P"),
        *[F.sum(f"n{b}").cast("double").alias(f"N{b}") for b in c],
        *[F.sum(pos * (F.col(f"below{b}") + F.col(f"n{b}") / F.lit(2.0))).cast("double").alias(f"w{b}") for b in c],
    )
    pair_auc = F.explode(F.array(*[
        F.struct(F.lit(b).alias("b"), safe_div(F.col(f"w{b}"), F.col("P") * F.col(f"N{b}")).alias("auc")) for b in c]))
    pairs = tot.select(*keys, "a", pair_auc.alias("e")).select(*keys, "a", "e.b", "e.auc").filter("a <> b")
    want = n_classes * (n_classes - 1)
    return pairs.groupBy(*keys).agg(F.when(F.count("auc") == want, F.avg("auc")).alias("auc_ovo"))


# --- whole result rows --------------------------------------------------------------------
# fixed values: scorer metrics by target type
SCORERS = {
    "regression": ("mse", "r2"), "classification": ("log_loss", "auc_ovo", "accuracy", "f1_weighted"),
    "binary": ("log_loss_binary", "auc", "accuracy", "f1_micro"),
}


def get_scorer(target_type: str) -> tuple[str, ...]:
    if target_type not in SCORERS:
        raise NotImplementedError(f"no scorer for {target_type}")
    return SCORERS[target_type]


def score_phases(df: DataFrame, keys: Sequence[str], target_type: str, y: str, p: str, proba: str, n_classes: int = 2) -> DataFrame:
    """Metrics of every (group, part) as {metric}__{part} columns.

    `p` is the predicted label or value; `proba` the class probabilities, or
    for binary targets the probability of class 1.
    """
    by = [*keys, "part"]
    if target_type == "regression":
        out = score(df, by, y, p, get_scorer(target_type))
    elif target_type == "binary":
        simple = df.groupBy(*by).agg(
            log_loss_binary(y, proba).alias("log_loss_binary"), accuracy(y, p).alias("accuracy"), f1_micro(y, p).alias("f1_micro"))
        out = simple.join(roc_auc(df, by, y, proba), by)
    else:
        simple = df.groupBy(*by).agg(log_loss(y, proba).alias("log_loss"), accuracy(y, p).alias("accuracy"))
        out = simple.join(f1_weighted(df, by, y, p), by).join(roc_auc_ovo(df, by, y, proba, n_classes), by)
    names = {"log_loss_binary": "log_loss", "f1_micro": "f1", "f1_weighted": "f1", "auc_ovo": "auc"}
    metrics = get_scorer(target_type)
    cols = [
        F.max(F.when(F.col("part") == part, F.col(m))).alias(f"{names.get(m, m)}__{part}")
        for m in metrics for part in ("train", "val", "test")
    ]
    return out.groupBy(*keys).agg(*cols)


def eval_metrics(df: DataFrame, keys: Sequence[str], task: str, y: str, s: str) -> DataFrame:
    """(log loss, AUC) for a binary task, mse for a regression."""
    if task == "regression":
        return metric(df, keys, y, s, "mse")
    loss = df.groupBy(*keys).agg(log_loss_binary(y, s).alias("log_loss"))
    return loss.join(roc_auc(df, keys, y, s), list(keys))


# --- survival -----------------------------------------------------------------------------
def cox_partial_loss(df: DataFrame, t: str, e: str, risk: str, row_id: str) -> DataFrame:
    """Negative partial log-likelihood per event, later times first, no tie handling."""
    src = df.select(row_id, F.col(e).alias("_e"), F.col(risk).alias("_r"), (-F.col(t)).alias("_t"))
    cum = prefix_sums(order_buckets(src, "_t", row_id), [], ["_t", row_id], {"_h": F.exp("_r")})
    return cum.agg(
        safe_div(-F.sum(F.col("_e") * (F.col("_r") - F.ln("_h"))), F.sum("_e").cast("double")).alias("neg_log_likelihood"),
        F.sum("_e").alias("n_events"),
    )


def concordance_index(df: DataFrame, t: str, e: str, risk: str) -> DataFrame:
    """Share of comparable pairs in which the earlier event has the higher risk.

    A pair is comparable when the earlier row had the event (an event at the
    same time as a censoring counts as earlier; two events at one time do not
    compare). Ties in risk count half.

    Pairs are counted, never listed: order positions are cut into binary
    digits, and a pair i before j meets at exactly one digit, where their
    higher digits agree and i has 0 and j has 1. Per (digit, higher digits)
    a running count over risk gives concordant and tied pairs. Each row is
    emitted once per digit, so the work is rows x log(rows).
    """
    rows = df.select(F.col(t).alias("_t"), F.col(e).alias("_e"), F.col(risk).cast("double").alias("_r")).na.drop()
    per = written(rows.select("_t").distinct(), "times")
    # events and censorings of one time get two adjacent positions
    pos = prefix_sums(value_buckets(per, "_t"), [], ["_t"], {"_pos": F.lit(2).cast("bigint")}, inclusive=False)
    top = per.count() * 2
    digits = max(1, int(top).bit_length())
    placed = rows.join(pos.select("_t", "_pos"), "_t").withColumn(
        "_q", F.when(F.col("_e") == 1, F.col("_pos")).otherwise(F.col("_pos") + 1))
    counts = placed.groupBy("_q", "_r").agg(
        F.count_if(F.col("_e") == 1).alias("_ev"), F.count("*").alias("_all"))
    cells = F.explode(F.array(*[
        F.struct(F.lit(b).alias("digit"), F.shiftright("_q", b + 1).alias("high"),
                 F.shiftright("_q", b).bitwiseAND(F.lit(1)).alias("side")) for b in range(digits)]))
    long = counts.select("_r", "_ev", "_all", cells.alias("c")).select("_r", "c.*", "_ev", "_all")
    cell = long.groupBy("digit", "high", "_r").agg(
        F.sum(F.when(F.col("side") == 0, F.col("_ev")).otherwise(0)).alias("early"),
        F.sum(F.when(F.col("side") == 1, F.col("_all")).otherwise(0)).alias("late"),
    )
    run = prefix_sums(value_buckets(cell, "_r", cut_points(rows, "_r")), ["digit", "high"], ["_r"], {"below": "late"}, inclusive=False)
    w = run.groupBy("digit", "high").agg(
        F.sum(F.col("early") * F.col("below")).alias("c"), F.sum(F.col("early") * F.col("late")).alias("t"),
        (F.sum("early") * F.sum("late")).alias("p"))
    tot = w.agg(F.sum("c").alias("concordant"), F.sum("t").alias("tied"), F.sum("p").alias("comparable"))
    return tot.withColumn(
        "c_index", safe_div(F.col("concordant") + F.col("tied") / F.lit(2.0), F.col("comparable").cast("double")))


# --- meta-learning metrics -------------------------------------------------------------------
def meta_metrics(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Quality of predicted score vectors: columns y_scores, pred_scores, best, worst."""
    y, best, worst = F.col("y_scores"), F.col("best"), F.col("worst")
    got = at(y, argmax("pred_scores"))
    top = at(y, argmax("y_scores"))
    low = F.array_min(y)
    return df.groupBy(*keys).agg(
        F.avg((argmax("y_scores") == argmax("pred_scores")).cast("double")).alias("accuracy"),
        F.avg(safe_div(F.abs(best - got), best - worst)).alias("regret_global"),
        F.avg(safe_div(F.abs(got - worst), best - worst)).alias("gain_global"),
        F.avg(safe_div(F.abs(top - got), top - low)).alias("regret_subset"),
        F.avg(safe_div(F.abs(got - low), top - low)).alias("gain_subset"),
        F.avg(mean_abs_diff("y_scores", "pred_scores")).alias("mae"),
        F.avg(got).alias("perf_of_best_predicted"),
    )
