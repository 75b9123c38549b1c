"""Model evaluation on MLlib learners, random search, meta-learners, tree shape."""
from __future__ import annotations

import math
import time
import traceback
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml import classification as C, regression as R
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradus.functions.scalar import argmax
from gradus.operators import boosting, kernel
from gradus.plans.ordering import hash_uniform
from gradus.session import work_dir, written

ESTIMATORS: dict[str, Callable] = {}


def register(name: str):
    """Add an estimator factory (params, objective) -> Estimator by name."""
    def add(fn: Callable):
        if name in ESTIMATORS:
            raise ValueError(f"algorithm {name} is registered already")
        ESTIMATORS[name] = fn
        return fn

    return add


def get_model(name: str) -> Callable:
    if name not in ESTIMATORS:
        raise KeyError(f"no algorithm named {name}; have {sorted(ESTIMATORS)}")
    return ESTIMATORS[name]


def supported_objectives(name: str) -> tuple[str, ...]:
    return ("binary", "classification") if name in ("SVM", "MLP") else ("binary", "classification", "regression")


@register("LinearModel")
def make_linear(params: dict, objective: str):
    if objective == "regression":
        return R.LinearRegression(featuresCol="features", labelCol="label")
    family = "binomial" if objective == "binary" else "multinomial"
    # an L2 penalty with weight 1 against the summed loss; the learner's loss is a mean
    return C.LogisticRegression(
        featuresCol="features", labelCol="label", family=family, regParam=1.0 / max(1, params.get("n_rows", 1)), standardization=False)


@register("SVM")
def make_svm(params: dict, objective: str):
    if objective == "regression":
        raise NotImplementedError("SVM has no distributed regression learner")
    return kernel.KernelMachine(objective, float(params.get("C", 1.0)), int(params.get("n_rows", 1)))


@register("DecisionTree")
def make_tree(params: dict, objective: str):
    cls = R.DecisionTreeRegressor if objective == "regression" else C.DecisionTreeClassifier
    return cls(featuresCol="features", labelCol="label", maxDepth=int(params.get("max_depth", 5)), seed=0)


@register("RandomForest")
def make_forest(params: dict, objective: str):
    cls = R.RandomForestRegressor if objective == "regression" else C.RandomForestClassifier
    return cls(featuresCol="features", labelCol="label", maxDepth=int(params.get("max_depth", 5)),
               numTrees=int(params.get("n_estimators", 50)), seed=0)


class FoldBooster:
    """A boosting learner; fits all folds of a table together."""

    def __init__(self, params: boosting.Params, objective: str):
        self.params, self.objective = params, objective

    def fit_folds(self, data: DataFrame) -> boosting.Booster:
        return boosting.fit(data, self.objective, self.params)


def _common(params: dict, step_key: str) -> dict:
    return {"step": float(params.get(step_key, 0.08)), "rounds": int(params.get("n_iter", boosting.ROUNDS))}


@register("XGBoost")
def make_level_boosting(params: dict, objective: str):
    """Trees grown level by level, with both penalties; a child needs a second derivative of 1."""
    return FoldBooster(boosting.Params("depth", int(params.get("max_depth", 5)), l1=float(params.get("alpha", 1e-4)), l2=float(params.get("lambda", 1e-4)),
                                       min_hess=1.0, **_common(params, "eta")), objective)


@register("CatBoost")
def make_symmetric_boosting(params: dict, objective: str):
    """Trees with one split per level."""
    return FoldBooster(boosting.Params("symmetric", int(params.get("max_depth", 5)), l2=float(params.get("l2_leaf_reg", 5.0)), **_common(params, "learning_rate")), objective)


@register("LightGBM")
def make_leaf_boosting(params: dict, objective: str):
    """Trees grown best leaf first; a leaf needs 20 rows."""
    return FoldBooster(boosting.Params("leaves", num_leaves=int(params.get("num_leaves", 512)), l1=float(params.get("lambda_l1", 1e-3)), l2=float(params.get("lambda_l2", 1e-3)),
                                       min_rows=20, min_hess=1e-3, **_common(params, "learning_rate")), objective)


@register("MLP")
def make_mlp(params: dict, objective: str):
    if objective == "regression":
        raise NotImplementedError("MLP has no distributed regression learner")
    hidden = [int(params.get("hidden_dim", 30))] * int(params.get("n_layers", 3))
    layers = [int(params["n_features"]), *hidden, int(params.get("n_classes", 2))]
    return C.MultilayerPerceptronClassifier(featuresCol="features", labelCol="label", layers=layers, maxIter=int(params.get("n_iter", 50)), seed=0)


@register("DeepFM")
def make_fm(params: dict, objective: str):
    """The factorisation-machine part."""
    if objective == "classification":
        raise NotImplementedError("the factorisation machine is binary or regression")
    cls = R.FMRegressor if objective == "regression" else C.FMClassifier
    return cls(featuresCol="features", labelCol="label", factorSize=int(params.get("factor_size", 8)), stepSize=0.05,
               maxIter=int(params.get("n_iter", 50)), seed=0)


# --- cross-validation ---------------------------------------------------------------
def assemble(processed: DataFrame, numeric: Sequence[str], onehot: Sequence[str], y: str) -> DataFrame:
    """(row_id, fold, part, label, features) from processed rows; one-hot block first."""
    vec_in = processed
    if onehot:
        cells = F.concat(*[F.col(f"{c}_onehot").cast("array<double>") for c in onehot], F.array(*[F.col(c) for c in numeric]).cast("array<double>"))
        from pyspark.ml.functions import array_to_vector

        vec_in = processed.withColumn("features", array_to_vector(cells))
    else:
        vec_in = VectorAssembler(inputCols=list(numeric), outputCol="features", handleInvalid="keep").transform(processed)
    return vec_in.select("row_id", "fold", "part", F.col(y).cast("double").alias("label"), "features", (F.col("part") == "val").alias("is_val"))


def _predictions(scored: DataFrame, name: str, trial: int, fold: int) -> DataFrame:
    proba = vector_to_array("probability") if "probability" in scored.columns else F.lit(None).cast("array<double>")
    return scored.select(
        F.lit(name).alias("alg_name"), F.lit(trial).alias("trial_number"), F.lit(fold).alias("fold"), "part", "row_id",
        F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"), proba.alias("proba"))


FITS_AT_ONCE = 4


def _fit_together(name: str, params: dict, data: DataFrame, objective: str, folds: Sequence[int], trial: int) -> tuple[DataFrame | None, list[dict]] | None:
    """cross_validate for a learner that fits all folds at once; None for others. Each fold's time is its share of the whole."""
    start, scored = time.time(), None
    try:
        est = get_model(name)(params, objective)
        if not hasattr(est, "fit_folds"):
            return None
        rows = data.filter(F.col("fold").isin(*folds))
        model = est.fit_folds(rows)
        seconds, exception = (time.time() - start) / max(1, len(folds)), "None"
        made = model.transform(rows)
        scored = written(made.select(
            F.lit(name).alias("alg_name"), F.lit(trial).alias("trial_number"), "fold", "part", "row_id",
            F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"), "proba"), "predictions")
    except Exception:
        seconds, exception = None, traceback.format_exc(limit=3)
    return scored, [{"alg_name": name, "trial_number": trial, "fold": f, "seconds": seconds, "exception": exception} for f in folds]


def cross_validate(
    name: str, params: dict, data: DataFrame, objective: str, folds: Sequence[int], trial: int = 0,
) -> tuple[DataFrame | None, list[dict]]:
    """Fit on the training part of each fold, predict all parts.

    `data` is assemble()'s table, best read from a written table as every fit
    scans it. Folds are independent jobs and FITS_AT_ONCE of them run together.
    Each fold's predictions are written as soon as they are made, so a trial
    that fails in fitting or in scoring becomes a report with its exception
    while others go on. Returns the predictions of all folds and a report per
    fold.
    """
    together = _fit_together(name, params, data, objective, folds, trial)
    if together is not None:
        return together
    sizes = {r["fold"]: r["count"] for r in data.filter("part = 'train'").groupBy("fold").count().collect()}

    def one(fold: int) -> tuple[DataFrame | None, dict]:
        start = time.time()
        rows = data.filter(F.col("fold") == fold)
        try:
            est = get_model(name)({"n_rows": sizes.get(fold, 0), **params}, objective)
            uses_val = est.hasParam("validationIndicatorCol") and est.isSet("validationIndicatorCol")
            fit_on = rows.filter("part <> 'test'" if uses_val else "part = 'train'")
            model = est.fit(fit_on)
            seconds = time.time() - start
            scored = written(_predictions(model.transform(rows), name, trial, fold), f"predictions-{fold}")
            return scored, {"alg_name": name, "trial_number": trial, "fold": fold, "seconds": seconds, "exception": "None"}
        except Exception:
            return None, {"alg_name": name, "trial_number": trial, "fold": fold, "seconds": None, "exception": traceback.format_exc(limit=3)}

    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        done = list(pool.map(one, folds))
    out = None
    for f, _ in done:
        if f is not None:
            out = f if out is None else out.unionByName(f)
    return out, [report for _, report in done]


def report_frame(spark: SparkSession, report: list[dict]) -> DataFrame:
    """One row per fit: trials x folds rows."""
    return spark.createDataFrame(
        [(r["alg_name"], r["trial_number"], r["fold"], r["seconds"], r["exception"]) for r in report],
        "alg_name string, trial_number int, fold int, seconds double, exception string")


def predicted_label(proba: str) -> Column:
    return argmax(proba)


# --- random search ------------------------------------------------------------------
# Fixed values: (algorithm, parameter, kind, base, low, high, factor, choices, default). "scaled" is
# factor * base ** U(low, high), "rounded" is that rounded, "odd" is 1 + 2 * U{low..high}, "int" is U{low..high},
# "uniform" is U(low, high), "choice" picks one of the choices.
SPACE = [
    ("KNN", "n_neighbors", "odd", 0.0, 1.0, 20.0, 0.0, [], 9.0),
    ("KNN", "leaf_size", "choice", 0.0, 0.0, 0.0, 0.0, [30.0, 50.0, 70.0, 100.0, 300.0], 30.0),
    ("SVM", "C", "scaled", 10.0, -10.0, 10.0, 1.0, [], 1.0),
    ("DecisionTree", "max_depth", "rounded", 2.0, 1.0, math.log2(12), 1.0, [], 5.0),
    ("RandomForest", "max_depth", "rounded", 2.0, 1.0, math.log2(12), 1.0, [], 5.0),
    ("RandomForest", "n_estimators", "rounded", 5.0, 1.0, math.log(100, 5), 1.0, [], 50.0),
    ("XGBoost", "max_depth", "rounded", 2.0, 1.0, math.log2(12), 1.0, [], 5.0),
    ("XGBoost", "alpha", "scaled", 10.0, -8.0, 0.0, 1.0, [], 1e-4),
    ("XGBoost", "lambda", "scaled", 10.0, -8.0, 0.0, 1.0, [], 1e-4),
    ("XGBoost", "eta", "scaled", 10.0, -2.0, -1.0, 3.0, [], 0.08),
    ("CatBoost", "learning_rate", "scaled", 10.0, -2.0, -1.0, 3.0, [], 0.08),
    ("CatBoost", "max_depth", "rounded", 2.0, 1.0, math.log2(12), 1.0, [], 5.0),
    ("CatBoost", "l2_leaf_reg", "scaled", 60.0, 0.0, 1.0, 0.5, [], 5.0),
    ("LightGBM", "num_leaves", "rounded", 2.0, 1.0, 12.0, 1.0, [], 512.0),
    ("LightGBM", "lambda_l1", "scaled", 10.0, -8.0, 1.0, 1.0, [], 1e-3),
    ("LightGBM", "lambda_l2", "scaled", 10.0, -8.0, 1.0, 1.0, [], 1e-3),
    ("LightGBM", "learning_rate", "scaled", 10.0, -2.0, 1.0, 3.0, [], 0.08),
    ("MLP", "hidden_dim", "int", 0.0, 10.0, 100.0, 0.0, [], 30.0),
    ("MLP", "n_layers", "int", 0.0, 2.0, 5.0, 0.0, [], 3.0),
    ("MLP", "learning_rate", "uniform", 0.0, 5e-4, 1e-3, 0.0, [], 7e-4),
]
SPACE_COLUMNS = "alg_name string, param string, kind string, base double, low double, high double, factor double, choices array<double>, dflt double"
SEED_STEP = 999  # fixed value: trial t of hparam seed s draws with seed t + 999 * s


def parameter_space(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SPACE, SPACE_COLUMNS)


def random_trials(trials: DataFrame, hparam_seed: int = 0) -> DataFrame:
    """Parameter values of (alg_name, trial_number) rows: trial 0 has the defaults.

    Every draw is a hash of algorithm, parameter and seed, so trials can be
    made anywhere and again. The space is a table of a few dozen rows.
    """
    space = F.broadcast(parameter_space(trials.sparkSession))
    seed = F.col("trial_number") + F.lit(SEED_STEP * hparam_seed)
    u = hash_uniform(F.concat("alg_name", F.lit("."), "param", F.lit("."), seed), "trial")
    between = F.col("low") + F.col("u") * (F.col("high") - F.col("low"))
    power = F.col("factor") * F.pow(F.col("base"), between)
    whole = F.col("low") + F.floor(F.col("u") * (F.col("high") - F.col("low") + 1))
    value = (
        F.when(F.col("trial_number") == 0, F.col("dflt"))
        .when(F.col("kind") == "scaled", power).when(F.col("kind") == "rounded", F.round(power, 0))
        .when(F.col("kind") == "odd", F.lit(1.0) + F.lit(2.0) * whole).when(F.col("kind") == "int", whole)
        .when(F.col("kind") == "uniform", between)
        .otherwise(F.get("choices", F.floor(F.col("u") * F.size("choices")).cast("int")))
    )
    out = trials.join(space, "alg_name").withColumn("u", u)
    return out.select(*trials.columns, "param", value.alias("value"))


# --- meta-learners --------------------------------------------------------------------
def _gram_xy(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Sum of z z^T over rows, z = (1, cols): one small matrix per task, added up."""
    d = len(cols) + 1

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((d, d))
        for pdf in batches:
            z = np.column_stack([np.ones(len(pdf)), pdf[list(cols)].to_numpy(dtype=float)])
            acc += z.T @ z
        i, j = np.indices((d, d))
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": acc.ravel()})

    rows = df.select(*[F.col(c).cast("double") for c in cols]).mapInPandas(part, "i int, j int, v double")
    out = np.zeros((d, d))
    for r in rows.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def meta_linear(df: DataFrame, xs: Sequence[str], ys: Sequence[str], alpha: float = 10.0) -> dict:
    """Ridge on standardised features, one output per column of ys.

    The driver solves a system the size of the features; rows are read once.
    """
    g = _gram_xy(df, [*xs, *ys])
    n, d = g[0, 0], len(xs)
    mean = g[0, 1:] / n
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.diag(cov)[:d])
    sd[sd == 0] = 1.0
    a = n * cov[:d, :d] / np.outer(sd, sd)
    b = n * cov[:d, d:] / sd[:, None]
    w = np.linalg.solve(a + alpha * np.eye(d), b)
    return {"xs": list(xs), "ys": list(ys), "mean": mean[:d], "sd": sd, "w": w, "intercept": mean[d:]}


def score_linear(df: DataFrame, model: dict) -> DataFrame:
    out = {}
    for k, y in enumerate(model["ys"]):
        e = F.lit(float(model["intercept"][k]))
        for i, x in enumerate(model["xs"]):
            e = e + (F.col(x) - F.lit(float(model["mean"][i]))) / F.lit(float(model["sd"][i])) * F.lit(float(model["w"][i, k]))
        out[f"{y}_pred"] = e
    return df.withColumns(out)


def meta_knn(train: DataFrame, query: DataFrame, xs: Sequence[str], y: str, row_id: str = "row_id", k: int = 5) -> DataFrame:
    """Mean label of the 5 nearest rows on standardised features."""
    from gradus.operators.neighbors import knn_join, knn_mean

    s = train.agg(*[f(c).alias(f"{n}_{c}") for c in xs for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    vec = F.array(*[(F.col(c) - F.lit(s[f"m_{c}"])) / F.lit(s[f"s_{c}"] or 1.0) for c in xs])
    tr, qu = train.withColumn("_vec", vec), query.withColumn("_vec", vec)
    return knn_mean(knn_join(tr, qu, k, "_vec", row_id, y), row_id, y)


# --- tree shape ---------------------------------------------------------------------------
def tree_nodes(spark: SparkSession, models: dict[int, object]) -> DataFrame:
    """Node tables of the trees of several folds: fold, id, feature, children, rows, depth.

    Levels come from one join per level for all trees together, at most the
    depth of the deepest tree.
    """
    raw = None
    for fold, model in models.items():
        path = work_dir(spark, f"tree-{fold}")
        model.write().save(path)
        one = spark.read.parquet(f"{path}/data").select(
            F.lit(fold).alias("fold"), "id", "gain", F.col("rawCount").cast("double").alias("rows"), F.col("leftChild").alias("l"),
            F.col("rightChild").alias("r"), F.col("split.featureIndex").alias("feature"))
        raw = one if raw is None else raw.unionByName(one)
    nodes = written(raw, "tree-nodes")
    level = nodes.filter("id = 0").select("fold", "id").withColumn("depth", F.lit(0))
    out = level
    for depth in range(1, max(m.depth for m in models.values()) + 1):
        kids = nodes.join(level.select("fold", "id"), ["fold", "id"]).filter("l >= 0").select("fold", F.explode(F.array("l", "r")).alias("id"))
        level = kids.withColumn("depth", F.lit(depth))
        out = out.unionByName(level)
    return nodes.join(out, ["fold", "id"])


def tree_metafeatures(nodes: DataFrame, n_features: int, n_classes: int) -> DataFrame:
    """Shape measures of one decision tree per fold, averaged where they are vectors.

    leaves_branch: depth of each leaf. leaves_corrob: share of rows per leaf.
    tree_shape: -p log2 p of each leaf with p = 2 ** -depth. leaves_homo:
    leaves over tree shape of each leaf. tree_imbalance: entropy over groups
    of equally probable leaves. nodes_per_level and nodes_repeated: inner
    nodes per level and per used feature.
    """
    leaf = F.col("l") < 0
    p = F.pow(F.lit(2.0), -F.col("depth"))
    shape = -p * F.log2(p)
    n_rows = F.max(F.when(F.col("id") == 0, F.col("rows")))
    base = nodes.groupBy("fold").agg(
        F.count_if(leaf).cast("double").alias("leaves"), F.count_if(~leaf).cast("double").alias("nodes"),
        F.max("depth").cast("double").alias("tree_depth"), F.avg(F.when(leaf, F.col("depth").cast("double"))).alias("leaves_branch"),
        (F.avg(F.when(leaf, F.col("rows"))) / n_rows).alias("leaves_corrob"), F.avg(F.when(leaf, shape)).alias("tree_shape"),
        F.avg(F.when(leaf & (F.col("depth") > 0), F.lit(1.0) / shape)).alias("_inv"), n_rows.alias("_rows"))
    groups = nodes.filter(leaf).groupBy("fold", "depth").agg((F.count("*") * F.first(p)).alias("q"))
    imb = groups.groupBy("fold").agg((-F.sum(F.col("q") * F.log2("q"))).alias("tree_imbalance"))
    inner = nodes.filter(~leaf)
    per_level = inner.groupBy("fold", "depth").agg(F.count("*").alias("c")).groupBy("fold").agg(F.avg("c").alias("nodes_per_level"))
    repeated = inner.groupBy("fold", "feature").agg(F.count("*").alias("c")).groupBy("fold").agg(F.avg("c").alias("nodes_repeated"))
    j = base.join(imb, "fold", "left").join(per_level, "fold", "left").join(repeated, "fold", "left")
    return j.select(
        "fold", "leaves", "nodes", "tree_depth", (F.col("leaves") / n_classes).alias("leaves_per_class"),
        (F.col("nodes") / n_features).alias("nodes_per_attr"), (F.col("nodes") / F.col("_rows")).alias("nodes_per_inst"),
        "leaves_corrob", "leaves_branch", (F.col("leaves") * F.col("_inv")).alias("leaves_homo"), "tree_shape", "tree_imbalance",
        F.coalesce("nodes_per_level", F.lit(0.0)).alias("nodes_per_level"), F.coalesce("nodes_repeated", F.lit(0.0)).alias("nodes_repeated"))


def tree_importance(nodes: DataFrame) -> DataFrame:
    """(fold, feature, var_importance): each used feature's share of the weighted impurity decrease."""
    per = nodes.filter("l >= 0").groupBy("fold", "feature").agg(F.sum(F.col("gain") * F.col("rows")).alias("g"))
    total = per.groupBy("fold").agg(F.sum("g").alias("t"))
    return per.join(total, "fold").select("fold", "feature", F.try_divide(F.col("g"), F.col("t")).alias("var_importance"))
