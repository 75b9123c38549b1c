"""Queries over prediction tables and score vectors."""
from __future__ import annotations

from pyspark.sql import functions as F

from gradus.catalog.registry import query
from gradus.functions import scalar as S
from gradus.operators import metrics as M

KEYS = ["alg_name", "fold"]
HARD = "CAST(CASE WHEN score >= 5e-1 THEN 1 ELSE 0 END AS INT)"
ARGMAX = "CAST(CASE WHEN w0 >= w1 AND w0 >= w2 THEN 0 WHEN w1 >= w2 THEN 1 ELSE 2 END AS INT)"
PRED = f"SELECT *, {HARD} AS hard, {ARGMAX} AS cls FROM v_preds"
REG = ["y_reg", "yhat_reg"]


def preds(t):
    return t.preds.withColumns({
        "hard": F.expr(HARD), "wsum": F.col("w0") + F.col("w1") + F.col("w2"),
        "proba": F.transform(F.array("w0", "w1", "w2"), lambda w: w / (F.col("w0") + F.col("w1") + F.col("w2"))),
    }).withColumn("cls", S.argmax(F.array("w0", "w1", "w2")))


SQL = {
    "mse": "avg(pow(y_reg - yhat_reg, 2))", "rmse": "sqrt(avg(pow(y_reg - yhat_reg, 2)))", "mae": "avg(abs(y_reg - yhat_reg))",
    "rmsle": "avg(pow(ln(1 + y_reg) - ln(1 + greatest(yhat_reg, 0)), 2))",
    "r2": "1 - sum(pow(y_reg - yhat_reg, 2)) / nullif(count(*) * var_pop(y_reg), 0)",
}


def simple(name: str, key: str):
    sql = f"SELECT alg_name, fold, {SQL[key]} AS {key} FROM v_preds GROUP BY alg_name, fold"

    @query(name, sql, r=key)
    def _(t):
        return M.metric(t.preds, KEYS, *REG, key)


simple("e01_mse", "mse")
simple("e02_r2", "r2")
simple("e11_mae", "mae")
simple("e12_rmsle", "rmsle")
simple("e13_rmse", "rmse")


@query("e03_accuracy", f"SELECT alg_name, fold, avg(CAST(y_true = cls AS DOUBLE)) AS accuracy FROM ({PRED}) AS p GROUP BY 1, 2", r="accuracy")
def _(t):
    return M.metric(preds(t), KEYS, "y_true", "cls", "accuracy")


@query("e04_f1_micro", f"""SELECT alg_name, fold, count(*) FILTER (WHERE y_bin = hard) / (count(*) FILTER (WHERE y_bin = hard) + 5e-1 * 2 * count(*) FILTER (WHERE y_bin <> hard))
 AS f1_micro FROM ({PRED}) AS p GROUP BY 1, 2""", r="f1_micro")
def _(t):
    return M.metric(preds(t), KEYS, "y_bin", "hard", "f1_micro")


def weighted_f1_sql(by: str, source: str = PRED) -> str:
    return f"""SELECT {by}, sum(sup * CASE WHEN sup + prd = 0 THEN 0 ELSE 2e0 * tp / (sup + prd) END) / sum(sup) AS f1_weighted FROM (
 SELECT {by}, c, count(*) FILTER (WHERE y_true = c) AS sup, count(*) FILTER (WHERE cls = c) AS prd, count(*) FILTER (WHERE y_true = c AND cls = c) AS tp
 FROM ({source}) AS p, (SELECT unnest(range(3)) AS c) AS k GROUP BY {by}, c) AS s GROUP BY {by}"""


@query("e05_f1_weighted", weighted_f1_sql("alg_name, fold"), r="f1_weighted")
def _(t):
    return M.f1_weighted(preds(t), KEYS, "y_true", "cls")


EPS = "2.220446049250313e-16"
BIN_LOSS = f"""avg(-ln(CASE WHEN y_bin = 1 THEN least(greatest(score, {EPS}), 1 - {EPS}) ELSE least(greatest(1 - score, {EPS}), 1 - {EPS}) END
 / (least(greatest(score, {EPS}), 1 - {EPS}) + least(greatest(1 - score, {EPS}), 1 - {EPS}))))"""


@query("e06_log_loss_binary", f"SELECT alg_name, fold, {BIN_LOSS} AS log_loss_binary FROM v_preds GROUP BY 1, 2", r="log_loss_binary")
def _(t):
    return M.metric(t.preds, KEYS, "y_bin", "score", "log_loss_binary")


MULTI_LOSS = "avg(-ln((CASE y_true WHEN 0 THEN w0 WHEN 1 THEN w1 ELSE w2 END) / (w0 + w1 + w2)))"


@query("e07_log_loss_multiclass", f"SELECT alg_name, fold, {MULTI_LOSS} AS log_loss FROM v_preds GROUP BY 1, 2", r="log_loss")
def _(t):
    return M.metric(preds(t), KEYS, "y_true", "proba", "log_loss")


def auc_sql(by: str, source: str, y: str, s: str) -> str:
    """Mann-Whitney form over average ranks."""
    return f"""SELECT {by}, (sum(r) FILTER (WHERE {y} = 1) - count(*) FILTER (WHERE {y} = 1) * (count(*) FILTER (WHERE {y} = 1) + 1) / 2e0)
 / nullif(CAST(count(*) FILTER (WHERE {y} = 1) AS DOUBLE) * count(*) FILTER (WHERE {y} <> 1), 0) AS auc FROM (
 SELECT {by}, {y}, rank() OVER (PARTITION BY {by} ORDER BY {s}) + (count(*) OVER (PARTITION BY {by}, {s}) - 1) / 2e0 AS r FROM ({source}) AS p) AS q GROUP BY {by}"""


@query("e08_roc_auc", auc_sql("alg_name, fold", "SELECT * FROM v_preds", "y_bin", "score"), r="auc")
def _(t):
    return M.roc_auc(t.preds, KEYS, "y_bin", "score")


def ovo_sql(by: str, source: str) -> str:
    pairs = " UNION ALL ".join(
        f"SELECT {by}, {a} AS a, {b} AS b, CASE WHEN y_true = {a} THEN 1 ELSE 0 END AS y, w{a} / (w0 + w1 + w2) AS s FROM ({source}) AS p WHERE y_true IN ({a}, {b})"
        for a in range(3) for b in range(3) if a != b)
    return f"SELECT {by}, CASE WHEN count(auc) = 6 THEN avg(auc) END AS auc_ovo FROM ({auc_sql(by + ', a, b', pairs, 'y', 's')}) AS z GROUP BY {by}"


@query("e09_roc_auc_ovo", ovo_sql("alg_name, fold", "SELECT * FROM v_preds"), r="auc_ovo")
def _(t):
    return M.roc_auc_ovo(preds(t), KEYS, "y_true", "proba", 3)


@query("e10_balanced_accuracy", f"""SELECT alg_name, fold, avg(rec) AS balanced_accuracy FROM (SELECT alg_name, fold, y_true,
 avg(CAST(y_true = cls AS DOUBLE)) AS rec FROM ({PRED}) AS p GROUP BY 1, 2, 3) AS r GROUP BY 1, 2""", r="balanced_accuracy")
def _(t):
    return M.balanced_accuracy(preds(t), KEYS, "y_true", "cls")


@query("e14_score_container", "SELECT alg_name, " + ", ".join(f"{SQL[k]} AS val_{k}" for k in ("mse", "mae", "rmse", "r2")) + " FROM v_preds GROUP BY 1",
       r="val_mse val_mae val_rmse val_r2")
def _(t):
    return M.score(t.preds, ["alg_name"], *REG, ["mse", "mae", "rmse", "r2"], prefix="val_")


@query("e14_score_outputs", "SELECT fold, (avg(abs(y_reg - yhat_reg)) + avg(abs(y_bin - score))) / 2 AS mae FROM v_preds GROUP BY 1", r="mae")
def _(t):
    return M.score_outputs(t.preds, ["fold"], ["y_reg", "y_bin"], ["yhat_reg", "score"], "mae")


PHASED = f"SELECT *, CASE fold WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS part FROM ({PRED}) AS p0"


def phase_sql(metrics: dict[str, str]) -> str:
    """metric name -> query giving (alg_name, part, value)."""
    parts = ("train", "val", "test")
    joined = " UNION ALL ".join(f"SELECT alg_name, part, '{m}' AS m, v FROM ({q}) AS q_{m}" for m, q in metrics.items())
    cols = ", ".join(f"max(v) FILTER (WHERE m = '{m}' AND part = '{p}') AS {m}__{p}" for m in metrics for p in parts)
    return f"SELECT alg_name, {cols} FROM ({joined}) AS j GROUP BY alg_name"


def phase_cols(*metrics: str) -> str:
    return " ".join(f"{m}__{p}" for m in metrics for p in ("train", "val", "test"))


BY = "alg_name, part"


@query("e15_score_phases_binary", phase_sql({
    "log_loss": f"SELECT {BY}, {BIN_LOSS} AS v FROM ({PHASED}) AS p GROUP BY {BY}",
    "auc": f"SELECT {BY}, auc AS v FROM ({auc_sql(BY, PHASED, 'y_bin', 'score')}) AS a",
    "accuracy": f"SELECT {BY}, avg(CAST(y_bin = hard AS DOUBLE)) AS v FROM ({PHASED}) AS p GROUP BY {BY}",
    "f1": f"SELECT {BY}, avg(CAST(y_bin = hard AS DOUBLE)) AS v FROM ({PHASED}) AS p GROUP BY {BY}",
}), r=phase_cols("log_loss", "auc", "accuracy", "f1"))
def _(t):
    return M.score_phases(phased(t), ["alg_name"], "binary", "y_bin", "hard", "score")


def phased(t):
    return preds(t).withColumn("part", F.when(F.col("fold") == 0, "test").when(F.col("fold") == 1, "val").otherwise("train"))


@query("e15_score_phases_multiclass", phase_sql({
    "log_loss": f"SELECT {BY}, {MULTI_LOSS} AS v FROM ({PHASED}) AS p GROUP BY {BY}",
    "auc": f"SELECT {BY}, auc_ovo AS v FROM ({ovo_sql(BY, PHASED)}) AS a",
    "accuracy": f"SELECT {BY}, avg(CAST(y_true = cls AS DOUBLE)) AS v FROM ({PHASED}) AS p GROUP BY {BY}",
    "f1": f"SELECT {BY}, f1_weighted AS v FROM ({weighted_f1_sql(BY, PHASED)}) AS a",
}), r=phase_cols("log_loss", "auc", "accuracy", "f1"))
def _(t):
    return M.score_phases(phased(t), ["alg_name"], "classification", "y_true", "cls", "proba", 3)


@query("e15_score_phases_regression", phase_sql({
    k: f"SELECT {BY}, {SQL[k]} AS v FROM ({PHASED}) AS p GROUP BY {BY}" for k in ("mse", "r2")}), r=phase_cols("mse", "r2"))
def _(t):
    return M.score_phases(phased(t), ["alg_name"], "regression", *REG, "score")


@query("e16_cox_partial_loss", """SELECT -sum(e * (risk - ln(h))) / sum(e) AS neg_log_likelihood, CAST(sum(e) AS BIGINT) AS n_events FROM (
 SELECT e, risk, sum(exp(risk)) OVER (ORDER BY t DESC, row_id ROWS UNBOUNDED PRECEDING) AS h FROM v_survival) AS a""", r="neg_log_likelihood")
def _(t):
    return M.cox_partial_loss(t.survival, "t", "e", "risk", "row_id")


@query("g06_sort_by_time", "SELECT row_id, t, row_number() OVER (ORDER BY t DESC, row_id) - 1 AS row_index FROM v_survival")
def _(t):
    from gradus.plans.ordering import row_index

    out = row_index(t.survival.select("row_id", "t", (-F.col("t")).alias("o")), "o", ["row_id"])
    return out.select("row_id", "t", "row_index")


C_INDEX = """SELECT CAST(sum(CASE WHEN a.risk > b.risk THEN 1 ELSE 0 END) AS BIGINT) AS concordant,
 CAST(sum(CASE WHEN a.risk = b.risk THEN 1 ELSE 0 END) AS BIGINT) AS tied, count(*) AS comparable,
 (sum(CASE WHEN a.risk > b.risk THEN 1e0 WHEN a.risk = b.risk THEN 5e-1 ELSE 0e0 END)) / count(*) AS c_index
 FROM v_survival AS a JOIN v_survival AS b ON a.e = 1 AND (a.t < b.t OR (a.t = b.t AND b.e = 0))"""


@query("e17_concordance_index", C_INDEX, r="c_index")
def _(t):
    return M.concordance_index(t.survival, "t", "e", "risk")


@query("c14_comparable_pairs", C_INDEX.replace("a.risk", "CAST(a.risk * 10 AS INT)").replace("b.risk", "CAST(b.risk * 10 AS INT)"), r="c_index")
def _(t):
    coarse = t.survival.withColumn("risk", F.round(F.col("risk") * 10, 0))
    return M.concordance_index(coarse, "t", "e", "risk")


# --- meta metrics: true scores w0..w2 against scores shifted by the row ------------------
META_SRC = """SELECT alg_name, [w0, w1, w2] AS y, [w1, w2, w0] AS p, greatest(w0, w1, w2) + 5 AS best,
 CASE WHEN row_id % 17 = 0 THEN greatest(w0, w1, w2) + 5 ELSE 0e0 END AS worst, greatest(w0, w1, w2) AS hi, least(w0, w1, w2) AS lo FROM v_preds"""
META = f"SELECT *, y[CAST(list_position(p, list_max(p)) AS INT)] AS got, list_position(y, list_max(y)) AS yi, list_position(p, list_max(p)) AS pi FROM ({META_SRC}) AS m"
META_COLS = {
    "accuracy": "avg(CAST(yi = pi AS DOUBLE))", "regret_global": "avg(abs(best - got) / nullif(best - worst, 0))",
    "gain_global": "avg(abs(got - worst) / nullif(best - worst, 0))", "regret_subset": "avg(abs(hi - got) / nullif(hi - lo, 0))",
    "gain_subset": "avg(abs(got - lo) / nullif(hi - lo, 0))",
    "mae": "avg((abs(y[1] - p[1]) + abs(y[2] - p[2]) + abs(y[3] - p[3])) / 3)", "perf_of_best_predicted": "avg(got)",
}


def meta_frame(t):
    hi = F.greatest("w0", "w1", "w2")
    return t.preds.select(
        "alg_name", F.array("w0", "w1", "w2").alias("y_scores"), F.array("w1", "w2", "w0").alias("pred_scores"),
        (hi + 5).alias("best"), F.when(F.col("row_id") % 17 == 0, hi + 5).otherwise(F.lit(0.0)).alias("worst"))


for _id, _cols in {
    "e18_meta_accuracy": ["accuracy"], "e19_meta_regret_global": ["regret_global"], "e20_meta_gain_global": ["gain_global"],
    "e21_meta_regret_subset": ["regret_subset"], "e22_meta_gain_subset": ["gain_subset"],
    "e23_meta_mae": ["mae", "perf_of_best_predicted"],
}.items():
    @query(_id, "SELECT alg_name, " + ", ".join(f"{META_COLS[c]} AS {c}" for c in _cols) + f" FROM ({META}) AS q GROUP BY alg_name", r=" ".join(_cols))
    def _(t, cols=_cols):
        return M.meta_metrics(meta_frame(t), ["alg_name"]).select("alg_name", *cols)


@query("e24_eval_metrics_binary", f"SELECT l.fold, l.log_loss, a.auc FROM (SELECT fold, {BIN_LOSS} AS log_loss FROM v_preds GROUP BY fold) AS l JOIN ({auc_sql('fold', 'SELECT * FROM v_preds', 'y_bin', 'score')}) AS a ON l.fold = a.fold",
       r="log_loss auc")
def _(t):
    return M.eval_metrics(t.preds, ["fold"], "binary", "y_bin", "score")


@query("e24_eval_metrics_regression", f"SELECT fold, {SQL['mse']} AS mse FROM v_preds GROUP BY fold", r="mse")
def _(t):
    return M.eval_metrics(t.preds, ["fold"], "regression", *REG)


@query("u03_metric_registry", f"SELECT alg_name, {SQL['mae']} / 2e0 AS half_mae FROM v_preds GROUP BY alg_name", r="half_mae")
def _(t):
    if "half_mae" not in M.REGISTRY:
        M.register("half_mae")(lambda y, p: M.mae(y, p) / 2)
    return M.metric(t.preds, ["alg_name"], *REG, "half_mae")


@query("u04_scorer_by_target_type", "SELECT DISTINCT target_type, CASE target_type WHEN 'regression' THEN 'mse,r2' WHEN 'binary' THEN "
       "'log_loss_binary,auc,accuracy,f1_micro' ELSE 'log_loss,auc_ovo,accuracy,f1_weighted' END AS metrics FROM v_results")
def _(t):
    table = {k: ",".join(M.get_scorer(k)) for k in M.SCORERS}
    return t.results.select("target_type").distinct().withColumn("metrics", S.lookup(table, F.col("target_type")))


# --- probability post-processing and scalar functions -----------------------------------------
@query("l11_expand_proba", """SELECT row_id, 1 - score AS p0, score AS p1, w0 / (w0 + w1) AS q0, 0e0 AS q1, w1 / (w0 + w1) AS q2,
 CAST(CASE WHEN w0 >= w1 THEN 0 ELSE 2 END AS INT) AS label FROM v_preds""", r="p0 p1 q0 q2")
def _(t):
    two = S.two_column_proba("score")
    seen = F.transform(F.array("w0", "w1"), lambda w: w / (F.col("w0") + F.col("w1")))
    out = t.preds.select("row_id", two.alias("p"), S.expand_proba(seen, [0, 2], 3).alias("q"))
    return out.select("row_id", F.col("p")[0].alias("p0"), F.col("p")[1].alias("p1"), *[F.col("q")[i].alias(f"q{i}") for i in range(3)],
                      S.argmax("q").alias("label"))


@query("s01_strings", """SELECT DISTINCT dataset_fold_id, split_part(dataset_fold_id, '__', 2) AS a, replace(dataset_fold_id, '_', '-') AS b,
 contains(dataset_fold_id, 'd_1') AS c, starts_with(dataset_fold_id, 'openml') AS d, ends_with(dataset_fold_id, '_3') AS e,
 trim(concat(' ', dataset_fold_id, ' ')) AS f, substring(dataset_fold_id, 1, length(dataset_fold_id) - 8) AS g, concat(dataset_fold_id, '/', fold) AS h FROM v_results""")
def _(t):
    c = F.col("dataset_fold_id")
    return t.results.select(
        c, F.element_at(F.split(c, "__"), 2).alias("a"), F.replace(c, F.lit("_"), F.lit("-")).alias("b"), c.contains("d_1").alias("c"),
        c.startswith("openml").alias("d"), c.endswith("_3").alias("e"), F.trim(F.concat(F.lit(" "), c, F.lit(" "))).alias("f"),
        F.expr("substring(dataset_fold_id, 1, length(dataset_fold_id) - 8)").alias("g"), F.format_string("%s/%d", c, F.col("fold")).alias("h")).distinct()


@query("s02_null_handling", """SELECT row_id, coalesce(x0, -1e0) AS a, x0 IS NULL AS b, CASE WHEN x2 = 0 THEN NULL ELSE x2 END AS c FROM v_features WHERE k0 IS NOT NULL""")
def _(t):
    nan = F.when(F.col("x2") == 0, F.lit(float("nan"))).otherwise(F.col("x2"))
    return t.features.na.drop(subset=["k0"]).select(
        "row_id", F.coalesce("x0", F.lit(-1.0)).alias("a"), F.col("x0").isNull().alias("b"), S.nan_to_null(nan).alias("c"))


@query("s03_math", """SELECT row_id, abs(x1) AS a, round_even(x1, 0) AS b, pow(x2, 2) AS c, log2(x2 + 1) AS d, exp(x2 / 1e2) AS e, ln(x2 + 1) AS f,
 sqrt(x2) AS g, least(greatest(x1, 0e0), 5e3) AS h, log10(x2 + 1) AS i FROM v_features""", r="d e f g i")
def _(t):
    x1, x2 = F.col("x1"), F.col("x2")
    return t.features.select(
        "row_id", F.abs(x1).alias("a"), F.bround(x1, 0).alias("b"), F.pow(x2, 2).alias("c"), F.log2(x2 + 1).alias("d"),
        F.exp(x2 / 100).alias("e"), F.ln(x2 + 1).alias("f"), F.sqrt(x2).alias("g"), S.clip(x1, 0.0, 5000.0).alias("h"), F.log10(x2 + 1).alias("i"))


@query("s04_membership", "SELECT row_id, k1 IN ('1-URGENT', '2-HIGH') AS a, CASE k1 WHEN '1-URGENT' THEN 'u' WHEN '5-LOW' THEN 'l' END AS b FROM v_features")
def _(t):
    return t.features.select("row_id", F.col("k1").isin("1-URGENT", "2-HIGH").alias("a"),
                             S.lookup({"1-URGENT": "u", "5-LOW": "l"}, F.col("k1")).alias("b"))


@query("s05_timestamp_labels", """SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS a, strftime(ts, '%m%d%y_%H%M%S') AS b,
 strftime(strptime(strftime(ts, '%Y%m%d_%H%M%S'), '%Y%m%d_%H%M%S'), '%m%d%y_%H%M%S') AS c FROM events""")
def _(t):
    a = S.timestamp_label("ts")
    back = F.to_timestamp(a, "yyyyMMdd_HHmmss")
    return t.table("events").select("event_id", a.alias("a"), S.timestamp_label("ts", "mdy").alias("b"), S.timestamp_label(back, "mdy").alias("c"))


@query("s06_bits", "SELECT row_id, CAST(length(bin(row_id)) AS INT) AS width, CAST(row_id & 1 AS INT) AS b0, CAST((row_id >> 3) & 1 AS INT) AS b3 FROM v_features")
def _(t):
    return t.features.select("row_id", S.bit_width("row_id").alias("width"), S.bit("row_id", 0).alias("b0"), S.bit("row_id", 3).alias("b3"))


@query("s07_sigmoid_softmax", """SELECT row_id, 1 / (1 + exp(-score)) AS sig, exp(w0 / 1e1) / (exp(w0 / 1e1) + exp(w1 / 1e1) + exp(w2 / 1e1)) AS s0,
 exp(w2 / 1e1) / (exp(w0 / 1e1) + exp(w1 / 1e1) + exp(w2 / 1e1)) AS s2 FROM v_preds""", r="sig s0 s2")
def _(t):
    sm = S.softmax(F.array(F.col("w0") / 10, F.col("w1") / 10, F.col("w2") / 10))
    return t.preds.select("row_id", S.sigmoid("score").alias("sig"), sm.alias("s")).select(
        "row_id", "sig", F.col("s")[0].alias("s0"), F.col("s")[2].alias("s2"))


UNIT = "CAST(CAST(concat('0x', substring(md5(concat(row_id, ':{}')), 1, 13)) AS BIGINT) AS DOUBLE) / 4503599627370496e0"


@query("s08_hash_uniform", f"""SELECT row_id, {UNIT.format(3)} AS u, row_number() OVER (ORDER BY md5(concat(row_id, ':3')), row_id) - 1 AS pos,
 CASE CAST(floor({UNIT.format(4)} * 3) AS INT) WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS choice,
 sqrt(-2 * ln(1 - {UNIT.format('5-u')})) * cos(2 * pi() * {UNIT.format('5-v')}) AS z FROM v_features""", r="u z")
def _(t):
    from gradus.operators.prep import hash_normal
    from gradus.plans.ordering import hash_row_index, hash_uniform

    d = hash_row_index(t.features.select("row_id"), "row_id", 3, out="pos")
    slot = F.floor(hash_uniform("row_id", 4) * 3).cast("int") + 1
    return d.select("row_id", hash_uniform("row_id", 3).alias("u"), "pos",
                    F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), slot).alias("choice"), hash_normal("row_id", 5).alias("z"))


@query("s09_argmax", f"SELECT row_id, {ARGMAX} AS cls FROM v_preds")
def _(t):
    return t.preds.select("row_id", S.argmax(F.array("w0", "w1", "w2")).alias("cls"))


@query("s10_array_functions", """SELECT row_id, least(w0, w1, w2) AS lo, CASE y_true WHEN 0 THEN w0 WHEN 1 THEN w1 ELSE w2 END AS own,
 (abs(w0 - w1) + abs(w1 - w2) + abs(w2 - w0)) / 3 AS mad FROM v_preds""", r="mad")
def _(t):
    a, b = F.array("w0", "w1", "w2"), F.array("w1", "w2", "w0")
    return t.preds.select("row_id", F.array_min(a).alias("lo"), S.at(a, F.col("y_true")).alias("own"), S.mean_abs_diff(a, b).alias("mad"))


@query("s11_expand_vector", "SELECT row_id, concat(w0, ',0.0,', w1, ',0.0') AS v FROM v_preds")
def _(t):
    return t.preds.select("row_id", F.array_join(S.expand_proba(F.array("w0", "w1"), [0, 2], 4), ",").alias("v"))


@query("s12_json_access", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def _(t):
    return t.table("events").select("event_id", F.try_element_at(F.from_json("props", "map<string,int>"), F.lit("k")).alias("k"))


@query("s13_json_encode", """SELECT row_id, concat('{"id":', row_id, ',"y":', y_true, ',"a":[', y_true, ',', y_bin, ']}') AS doc FROM v_preds""")
def _(t):
    doc = F.to_json(F.struct(F.col("row_id").alias("id"), F.col("y_true").alias("y"), F.array("y_true", "y_bin").alias("a")))
    return t.preds.select("row_id", doc.alias("doc"))
