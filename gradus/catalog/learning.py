"""Queries over augmentation, neighbours, learners, trials and meta-learners."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradus.catalog.preparation import NUM
from gradus.catalog.registry import query
from gradus.catalog.scoring import UNIT
from gradus.operators import augment as J
from gradus.operators import boosting
from gradus.operators import metrics as M
from gradus.operators import models as L
from gradus.operators import neighbors as N
from gradus.operators import prep as P
from gradus.plans.folds import assign_parts
from gradus.session import written

XS = ["x0", "x1", "x2"]


def unit(seed: str, key: str = "row_id") -> str:
    return UNIT.replace("row_id", key).format(seed)


# --- J ---------------------------------------------------------------------------
@query("j01_bernoulli_mask", "SELECT row_id, " + ", ".join(f"CAST({unit(f'{c}-1')} < 3e-1 AS INT) AS {c}" for c in NUM) + " FROM v_features")
def _(t):
    return J.bernoulli_mask(t.features, NUM, 0.3, 1)


LONG = " UNION ALL ".join(f"SELECT row_id, '{c}' AS feature, {c} AS value FROM v_features" for c in NUM)


@query("j02_corrupt", f"""WITH l AS ({LONG}), a AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY md5(concat(row_id, '-', feature, '-a:5')), concat(row_id, '-', feature, '-a')) AS i FROM l),
 b AS (SELECT feature, value AS other, row_number() OVER (PARTITION BY feature ORDER BY md5(concat(row_id, '-', feature, '-b:5')), concat(row_id, '-', feature, '-b')) AS i FROM l),
 c AS (SELECT row_id, a.feature, value, CASE WHEN {unit('m-5', "row_id, '-', a.feature")} < 4e-1 THEN other ELSE value END AS corrupted FROM a JOIN b ON a.feature = b.feature AND a.i = b.i)
 SELECT *, CAST(value IS DISTINCT FROM corrupted AS INT) AS mask FROM c""")
def _(t):
    return J.corrupt(t.features, NUM, 0.4, 5)


PERM = """pa AS (SELECT row_id, row_number() OVER (ORDER BY md5(concat(row_id, ':{s}-a')), row_id) AS i FROM v_features),
 pb AS (SELECT row_id AS partner, row_number() OVER (ORDER BY md5(concat(row_id, ':{s}-b')), row_id) AS i FROM v_features),
 pp AS (SELECT pa.row_id, pb.partner FROM pa JOIN pb ON pa.i = pb.i)"""


@query("j03_mixup", f"""WITH {PERM.format(s=2)} SELECT a.row_id, pp.partner, """ + ", ".join(f"7e-1 * a.{c} + 3e-1 * b.{c} AS {c}" for c in NUM) + """, a.y_bin AS y_a, b.y_bin AS y_b
 FROM v_features AS a JOIN pp ON a.row_id = pp.row_id JOIN v_features AS b ON b.row_id = pp.partner""", r=" ".join(NUM))
def _(t):
    return J.mixup(t.features, NUM, "y_bin", 0.7, 2)


@query("j04_cutmix", f"""WITH {PERM.format(s=3)} SELECT a.row_id, pp.partner, """ + ", ".join(
    f"CASE WHEN {unit(f'{c}-3', 'a.row_id')} < 2e-1 THEN b.{c} ELSE a.{c} END AS {c}" for c in NUM) + """
 FROM v_features AS a JOIN pp ON a.row_id = pp.row_id JOIN v_features AS b ON b.row_id = pp.partner""")
def _(t):
    return J.cutmix(t.features, NUM, 0.2, 3)


@query("j05_missing_noise", "SELECT row_id, " + ", ".join(f"CASE WHEN {unit(f'{c}-4')} < 1e-1 THEN 0e0 ELSE {c} END AS {c}" for c in NUM) + " FROM v_features")
def _(t):
    return J.missing_noise(t.features.select("row_id", *NUM), NUM, 0.1, 4)


KINDS = ["1-URGENT", "2-HIGH", "5-LOW"]
CHOSEN = "({} < 5e-1 AND {} IS NOT NULL)"


def noise_sql(c: str, categorical: bool) -> str:
    chosen, u = CHOSEN.format(unit(f"{c}-6"), c), unit(f"{c}-kind-6")
    if categorical:
        draw = f"CASE CAST(floor({unit(f'{c}-draw-6')} * 3) AS INT) " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(KINDS)) + " END"
        zero, base = "NULL", c
    else:
        draw, zero, base = f"sqrt(-2 * ln(1 - {unit(f'{c}-draw-6-u')})) * cos(2 * pi() * {unit(f'{c}-draw-6-v')})", "0e0", f"coalesce({c}, 0e0)"
    return f"CASE WHEN {chosen} AND {u} < 4e-1 THEN {zero} WHEN {chosen} AND {u} < 4e-1 + 4e-1 THEN {draw} ELSE {base} END AS {c}, {chosen} AS {c}_masked"


@query("j06_mask_noise", "SELECT row_id, " + ", ".join(noise_sql(c, False) for c in NUM) + f", {noise_sql('k1', True)} FROM v_features", r=" ".join(NUM))
def _(t):
    return J.mask_noise(t.features.select("row_id", *NUM, "k1"), [*NUM, "k1"], {"k1": KINDS}, 0.5, 0.4, 0.4, 6)


# --- C13 -------------------------------------------------------------------------
KNN_ALL = """SELECT a.vec_id, b.vec_id AS neighbor, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2)))) AS distance, b.label
 FROM v_knn AS a JOIN v_knn AS b ON a.vec_id <> b.vec_id"""
KNN9 = f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY round(distance, 12), neighbor) AS INT) AS rank FROM ({KNN_ALL}) AS d) AS r WHERE rank <= 9"""


@query("c13_knn_join", KNN9, r="distance")
def _(t):
    return N.knn_join(t.knn, t.knn, 9, exclude_self=True)


@query("c13_knn_vote", f"""WITH n AS (SELECT vec_id, label, count(*) AS n FROM ({KNN9}) AS k GROUP BY 1, 2)
 SELECT vec_id, label AS prediction, n / 9e0 AS share FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) AS rn FROM n) AS z WHERE rn = 1""", r="share")
def _(t):
    return N.knn_vote(N.knn_join(t.knn, t.knn, 9, exclude_self=True))


@query("l02_knn", f"""WITH d AS (SELECT a.vec_id, a.label AS y, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(k.distance, 12), b.vec_id) AS rn
 FROM ({KNN_ALL}) AS k JOIN v_knn AS a ON a.vec_id = k.vec_id JOIN v_knn AS b ON b.vec_id = k.neighbor WHERE b.fold <> a.fold AND b.fold <> (a.fold + 1) % 10),
 n AS (SELECT vec_id, y, label, count(*) AS n FROM d WHERE rn <= 9 GROUP BY 1, 2, 3),
 p AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) AS rn FROM n)
 SELECT CAST(f.fold AS INT) AS fold, count(*) AS n_test, avg(CAST(y = p.label AS DOUBLE)) AS accuracy FROM p JOIN v_knn AS f ON f.vec_id = p.vec_id WHERE rn = 1 GROUP BY f.fold""", r="accuracy")
def _(t):
    votes = None
    for fold in range(10):
        train = t.knn.filter(~F.col("fold").isin(fold, (fold + 1) % 10))
        one = N.knn_vote(N.knn_join(train, t.knn.filter(F.col("fold") == fold), 9))
        votes = one if votes is None else votes.unionByName(one)
    out = votes.join(t.knn.select("vec_id", "fold", F.col("label").alias("y")), "vec_id")
    return out.groupBy(F.col("fold").cast("int").alias("fold")).agg(F.count("*").alias("n_test"), M.accuracy("y", "prediction").alias("accuracy"))


@query("k20_one_nn")
def _(t):
    """Nearest-neighbour landmark of every fold on all columns and on the three of largest gain."""
    from gradus.operators import metafeatures as K

    cols = ["x0", "x1", "x2", "x4"]
    x = K.Input(t.folds.select("row_id", "test_fold", "y_multi", *cols), cols, [], "y_multi")
    gains = K.stumps(x).select("fold", "feature", "gain").collect()  # folds x columns rows
    imputed = written(P.impute_mean(x.df, cols, x.moments), "imputed", "fold")
    out = None
    for fold in range(10):
        mine = sorted((g for g in gains if g["fold"] == fold), key=lambda g: (-g["gain"], g["feature"]))
        rows = imputed.filter(F.col("fold") == fold)
        for name, use in (("one_nn", cols), ("elite_nn", [g["feature"] for g in mine[:3]])):
            d = rows.withColumn("_vec", F.array(*[F.col(c) for c in use]))
            train, test = d.filter("part = 'train'"), d.filter("part = 'test'")
            near = N.knn_vote(N.knn_join(train, test, 1, "_vec", "row_id", "y_multi"), "row_id", "y_multi")
            scored = near.join(test.select("row_id", F.col("y_multi").alias("y")), "row_id")
            # written one by one, so that shuffle files of one join go before the next
            one = written(M.balanced_accuracy(scored.withColumns({"feature": F.lit(name), "fold": F.lit(fold)}), ["fold", "feature"], "y", "prediction"), f"{name}-{fold}")
            out = one if out is None else out.unionByName(one)
    return out


# --- L -----------------------------------------------------------------------------
FOLDS = tuple(range(10))
_DATA: dict = {}


def data(t, y: str):
    """Imputed, scaled, one-hot encoded rows of all folds with one target, written once per session, a folder for each fold."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir, y)
    if key not in _DATA:
        src = t.folds.select("row_id", "test_fold", *XS, "k0", "k1", F.col(y).alias("y"))
        if y == "y_multi":
            src = P.encode_target(src, "y")
        out = P.process_data(src, XS, ["k0", "k1"])
        _DATA[key] = written(L.assemble(out, XS, ["k0", "k1"], "y"), "model-rows", "fold")
    return _DATA[key]


TARGET = {"binary": "y_bin", "classification": "y_multi", "regression": "y_reg"}


def evaluate(t, name: str, objective: str, params: dict | None = None, folds=FOLDS):
    """Metrics of every part per fold, all folds scored in one job."""
    preds, report = L.cross_validate(name, params or {}, data(t, TARGET[objective]), objective, folds)
    failed = [r["exception"] for r in report if r["exception"] != "None"]
    if failed:
        raise RuntimeError(failed[0])
    score = "proba"
    if objective == "binary":
        preds = preds.withColumn("p1", F.coalesce(F.col("proba")[1], F.col("y_pred")))
        score = "p1"
    elif objective == "classification":
        preds = preds.withColumn("proba", F.coalesce("proba", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda c: (c == F.col("y_pred")).cast("double"))))
    ints = preds.withColumns({c: F.col(c).cast("int") for c in ("y_true", "y_pred")}) if objective != "regression" else preds
    return M.score_phases(ints, ["alg_name", "fold"], objective, "y_true", "y_pred", score, 3)


def learner_sql(name: str, objective: str) -> str:
    """Rows of each part, what a constant scores on the training part, and that the learner is no worse."""
    y = TARGET[objective]
    base = "ln(var_pop(y) FILTER (WHERE part = 'train'))" if objective == "regression" else "any_value(c.majority)"
    return f"""WITH p AS (SELECT t.fold, {y} AS y, CASE WHEN f.test_fold = t.fold THEN 'test' WHEN f.test_fold = (t.fold + 1) % 10 THEN 'val' ELSE 'train' END AS part
 FROM v_folds AS f, (SELECT unnest(range(10)) AS fold) AS t),
 c AS (SELECT fold, max(n) * 1e0 / sum(n) AS majority FROM (SELECT fold, y, count(*) AS n FROM p WHERE part = 'train' GROUP BY ALL) AS z GROUP BY fold)
 SELECT '{name}' AS alg_name, CAST(p.fold AS INT) AS fold, count(*) FILTER (WHERE part = 'train') AS n_train, count(*) FILTER (WHERE part = 'val') AS n_val,
 count(*) FILTER (WHERE part = 'test') AS n_test, {base} AS constant, TRUE AS no_worse FROM p JOIN c ON c.fold = p.fold GROUP BY p.fold"""


def check_learner(t, name: str, objective: str, params: dict) -> DataFrame:
    """Per fold: rows predicted in each part, the score of the best constant on the training part, whether the learner reaches it.

    The score is the share of the largest class, or the log of the mean's squared error. Iterative learners may end within
    a hundredth of it.
    """
    preds, report = L.cross_validate(name, params, data(t, TARGET[objective]), objective, FOLDS)
    failed = [r["exception"] for r in report if r["exception"] != "None"]
    if failed:
        raise RuntimeError(failed[0])
    train = F.col("part") == "train"
    counts = [F.count(F.when(F.col("part") == p, 1)).alias(f"n_{p}") for p in ("train", "val", "test")]
    if objective == "regression":
        out = preds.groupBy("alg_name", "fold").agg(
            *counts, F.var_pop(F.when(train, F.col("y_true"))).alias("constant"), F.avg(F.when(train, F.pow(F.col("y_true") - F.col("y_pred"), 2))).alias("score"))
        return out.withColumn("no_worse", F.col("score") <= F.col("constant") * 1.01).withColumn("constant", F.ln("constant")).drop("score")
    out = preds.groupBy("alg_name", "fold").agg(*counts, F.avg(F.when(train, (F.col("y_true") == F.col("y_pred")).cast("double"))).alias("score"))
    classes = preds.filter(train).groupBy("fold", "y_true").agg(F.count("*").alias("n"))
    best = classes.groupBy("fold").agg((F.max("n") / F.sum("n")).alias("constant"))
    return out.join(best, "fold").withColumn("no_worse", F.col("score") >= F.col("constant") - 0.01).drop("score")


for _id, _name, _kind, _params in (
    ("l01_linear_binary", "LinearModel", "binary", {}), ("l01_linear_multiclass", "LinearModel", "classification", {}),
    ("l01_linear_regression", "LinearModel", "regression", {}), ("l03_svm", "SVM", "binary", {}),
    ("l04_decision_tree", "DecisionTree", "classification", {}), ("l04_decision_tree_regression", "DecisionTree", "regression", {}),
    ("l05_random_forest", "RandomForest", "classification", {}), ("l06_boosting", "XGBoost", "binary", {"eta": 0.3}),
    ("l06_boosting_multiclass", "CatBoost", "classification", {"learning_rate": 0.3}), ("l06_boosting_regression", "LightGBM", "regression", {"n_iter": 10}), ("l07_mlp", "MLP", "binary", {"n_features": 13}),
    ("l08_factorisation_machine", "DeepFM", "binary", {}),
):
    @query(_id, learner_sql(_name, _kind), r="constant")
    def _(t, name=_name, kind=_kind, params=_params):
        p = dict(params)
        if name == "MLP":
            p["n_features"] = len(data(t, TARGET[kind]).select("features").first()[0])
        return check_learner(t, name, kind, p)


FIRST = boosting.Params("depth", 1, l1=1e-4, l2=1e-4, min_hess=1.0, rounds=1)


# one round of one split: gradients in units of 2^-24, edges at every 32nd part of the training rows
@query("l06_first_split", f"""WITH p AS (SELECT t.fold, [coalesce(x0, 0e0), x1, x2] AS x, y_reg AS y FROM v_folds AS f, (SELECT unnest(range(10)) AS fold) AS t
 WHERE f.test_fold <> t.fold AND f.test_fold <> (t.fold + 1) % 10),
 s AS (SELECT fold, avg(y) AS m, stddev_pop(y) AS sd FROM p GROUP BY fold),
 c AS (SELECT p.fold, j AS feature, p.x[j + 1] AS v, CAST(round((m - y) / sd * 16777216) AS BIGINT) AS g FROM p JOIN s ON p.fold = s.fold, (SELECT unnest(range(3)) AS j) AS k),
 e AS (SELECT DISTINCT fold, feature, edge FROM (SELECT fold, feature, unnest(quantile_cont(v, [{', '.join(f'{k / 32!r}' for k in range(32))}])) AS edge FROM c GROUP BY fold, feature) AS q),
 l AS (SELECT e.fold, e.feature, e.edge, sum(g) FILTER (WHERE v <= edge) / 16777216e0 AS gl, count(*) FILTER (WHERE v <= edge) AS nl, sum(g) / 16777216e0 AS ga, count(*) AS na
  FROM c JOIN e ON c.fold = e.fold AND c.feature = e.feature GROUP BY ALL),
 r AS (SELECT *, pow(greatest(abs(gl) - 1e-4, 0), 2) / (nl + 1e-4) + pow(greatest(abs(ga - gl) - 1e-4, 0), 2) / (na - nl + 1e-4) AS gain FROM l WHERE nl < na),
 b AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY gain DESC, feature, edge) AS place FROM r)
 SELECT CAST(fold AS INT) AS fold, CAST(feature AS INT) AS feature, edge, -8e-2 * sign(gl) * (abs(gl) - 1e-4) / (nl + 1e-4) AS low_value,
 -8e-2 * sign(ga - gl) * (abs(ga - gl) - 1e-4) / (na - nl + 1e-4) AS high_value FROM b WHERE place = 1""", r="edge low_value high_value")
def _(t):
    """The split that a first round of boosting makes in every fold."""
    rows = assign_parts(t.folds.select("row_id", "test_fold", F.coalesce("x0", F.lit(0.0)).alias("x0"), "x1", "x2", F.col("y_reg").alias("y")))
    model = boosting.fit(L.assemble(rows, XS, [], "y"), "regression", FIRST)
    found = [(f, tree.feature[0], float(model.edges[f][tree.feature[0]][tree.bin[0]]), tree.value[tree.left[0]], tree.value[tree.right[0]]) for f, (tree,) in model.rounds[0].items()]
    return t.spark.createDataFrame(found, "fold int, feature int, edge double, low_value double, high_value double")


@query("l01_linear_scores")
def _(t):
    """All metrics of the linear model in every fold and part."""
    return evaluate(t, "LinearModel", "binary")


# closed form of two-feature ridge: standardised x1, x2, alpha = 10
@query("l09_meta_linear", """WITH s AS (SELECT count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, avg(y_reg) AS my FROM v_features),
 z AS (SELECT row_id, (x1 - m1) / s1 AS a, (x2 - m2) / s2 AS b, y_reg - my AS y, my FROM v_features, s),
 g AS (SELECT sum(a * a) + 10 AS aa, sum(b * b) + 10 AS bb, sum(a * b) AS ab, sum(a * y) AS ay, sum(b * y) AS bj FROM z)
 SELECT row_id, (my + a * (ay * bb - bj * ab) / (aa * bb - ab * ab) + b * (bj * aa - ay * ab) / (aa * bb - ab * ab)) / 1e3 AS y_pred_thousands FROM z, g""", r="y_pred_thousands")
def _(t):
    model = L.meta_linear(t.features, ["x1", "x2"], ["y_reg"])
    return L.score_linear(t.features, model).select("row_id", (F.col("y_reg_pred") / 1e3).alias("y_pred_thousands"))


@query("l10_meta_knn", """WITH f AS (SELECT c_custkey AS row_id, c_acctbal AS a, c_nationkey * 1e0 AS b FROM customer), s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM f),
 z AS (SELECT row_id, (a - ma) / sa AS u, (b - mb) / sb AS v, a FROM f, s),
 d AS (SELECT q.row_id, t.a, row_number() OVER (PARTITION BY q.row_id ORDER BY round(sqrt(pow(q.u - t.u, 2) + pow(q.v - t.v, 2)), 9), t.row_id) AS rn FROM z AS q JOIN z AS t ON true)
 SELECT row_id, avg(a) AS prediction FROM d WHERE rn <= 5 GROUP BY row_id""", r="prediction")
def _(t):
    c = t.table("customer").select(F.col("c_custkey").alias("row_id"), F.col("c_acctbal").alias("a"), F.col("c_nationkey").cast("double").alias("b"))
    return L.meta_knn(c, c, ["a", "b"], "a")


@query("l12_cross_validate")
def _(t):
    preds, _report = L.cross_validate("DecisionTree", {}, data(t, "y_bin"), "binary", range(10))
    p = preds.withColumns({"p1": F.col("proba")[1], "y_true": F.col("y_true").cast("int"), "y_pred": F.col("y_pred").cast("int")})
    return M.score_phases(p, ["alg_name", "trial_number", "fold"], "binary", "y_true", "y_pred", "p1")


def space_sql() -> str:
    rows = ", ".join(f"('{n}', '{p}', '{k}', {base!r}, {low!r}, {high!r}, {factor!r}, {choices!r}, {d!r})" for n, p, k, base, low, high, factor, choices, d in L.SPACE)
    u = unit("trial", "r.alg_name, '.', s.param, '.', r.trial_number + 1998")
    power = "factor * pow(base, low + u * (high - low))"
    return f"""WITH sp AS (SELECT * FROM (VALUES {rows}) AS v(alg_name, param, kind, base, low, high, factor, choices, dflt)),
 tr AS (SELECT DISTINCT alg_name, dataset_name, trial_number FROM v_results),
 d AS (SELECT r.alg_name, r.dataset_name, r.trial_number, s.* EXCLUDE (alg_name), {u} AS u FROM tr AS r JOIN sp AS s ON r.alg_name = s.alg_name)
 SELECT alg_name, dataset_name, trial_number, param, round(CAST(CASE WHEN trial_number = 0 THEN dflt WHEN kind = 'scaled' THEN {power} WHEN kind = 'rounded' THEN round({power})
 WHEN kind = 'odd' THEN 1 + 2 * (low + floor(u * (high - low + 1))) WHEN kind = 'int' THEN low + floor(u * (high - low + 1)) WHEN kind = 'uniform' THEN low + u * (high - low)
 ELSE choices[CAST(floor(u * len(choices)) AS INT) + 1] END AS DOUBLE), 6) + 0e0 AS value FROM d WHERE NOT (alg_name = 'SVM')
 UNION ALL SELECT alg_name, dataset_name, trial_number, param, round(CASE WHEN trial_number = 0 THEN 0e0 ELSE -1e1 + u * 2e1 END, 6) + 0e0 FROM d WHERE alg_name = 'SVM'"""


# the SVM parameter spans twenty decades, so its exponent is compared
@query("l13_random_trials", space_sql())
def _(t):
    out = L.random_trials(t.results.select("alg_name", "dataset_name", "trial_number").distinct(), 2)
    value = F.when(F.col("alg_name") == "SVM", F.log10("value")).otherwise(F.col("value"))
    return out.withColumn("value", F.round(value, 6) + F.lit(0.0))


@query("l14_failed_trials", "SELECT a.alg_name, CAST(a.trial_number AS INT) AS trial_number, CAST(f.fold AS INT) AS fold, a.alg_name = 'DecisionTree' AS ok FROM (VALUES ('DecisionTree', 0), ('SVM', 1)) AS a(alg_name, trial_number) CROSS JOIN (SELECT DISTINCT test_fold AS fold FROM v_folds) AS f")
def _(t):
    """A trial that fails becomes an error row; the other trial goes on."""
    rows = data(t, "y_reg")
    report = []
    for trial, name in enumerate(("DecisionTree", "SVM")):
        report += L.cross_validate(name, {}, rows, "regression", FOLDS, trial)[1]
    out = L.report_frame(t.spark, report)
    return out.select("alg_name", "trial_number", "fold", (F.col("exception") == "None").alias("ok"))


@query("u01_algorithm_registry", "SELECT DISTINCT alg_name, alg_name IN ('LinearModel', 'SVM', 'DecisionTree', 'RandomForest', 'XGBoost', 'CatBoost', 'LightGBM', 'MLP', 'DeepFM') AS has_learner FROM v_results")
def _(t):
    known = [n for n in L.ESTIMATORS if callable(L.get_model(n))]
    return t.results.select("alg_name").distinct().withColumn("has_learner", F.col("alg_name").isin(*known))


def fold_trees(t) -> dict:
    """One tree per fold on its training part."""
    rows = data(t, "y_multi")
    return {
        fold: L.make_tree({"max_depth": 5}, "classification").fit(rows.filter((F.col("fold") == fold) & (F.col("part") == "train")))
        for fold in range(10)}


@query("k21_tree_shape")
def _(t):
    models = fold_trees(t)
    one = models[0]
    return L.tree_metafeatures(L.tree_nodes(t.spark, models), one.numFeatures, one.numClasses)


@query("k21_tree_importance")
def _(t):
    return L.tree_importance(L.tree_nodes(t.spark, fold_trees(t)))
