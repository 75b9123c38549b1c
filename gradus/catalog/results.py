"""Queries over trial logs: derivations, joins, aggregates, ranks, set operations."""
from __future__ import annotations

from pyspark.sql import functions as F

from gradus.catalog.registry import query
from gradus.catalog.views import Tables, datasets_sql, folds_sql, tuned_sql
from gradus.functions import names
from gradus.operators import analysis as A
from gradus.plans import leaderboard as L

ALGS8 = ("KNN", "XGBoost", "CatBoost", "LightGBM", "MLP", "SVM", "RandomForest", "DecisionTree")


def analysis(t: Tables):
    return L.analysis_table(t.results, t.metafeatures)


BOARD_COLS = ("rank_min rank_max rank_mean rank_median norm_mean norm_median std_mean std_median "
              "runtime_mean runtime_median")


def board_sql(source: str, m: str) -> str:
    return f"""SELECT alg_name, CAST(min({m}_rank_mean) AS DOUBLE) AS rank_min, CAST(max({m}_rank_mean) AS DOUBLE) AS rank_max,
 avg({m}_rank_mean) AS rank_mean, CAST(median({m}_rank_mean) AS DOUBLE) AS rank_median,
 avg(normalized_{m}__test_mean) AS norm_mean, median(normalized_{m}__test_mean) AS norm_median,
 avg(normalized_{m}__test_std) AS std_mean, median(normalized_{m}__test_std) AS std_median,
 avg(train_per_1000_inst_mean_{m}) AS runtime_mean, median(train_per_1000_inst_mean_{m}) AS runtime_median
FROM ({datasets_sql(source, m)}) AS d GROUP BY alg_name"""


@query("flagship_leaderboard", board_sql("v_analysis", "accuracy"), r=BOARD_COLS)
def _(t):
    return L.leaderboard(t.results, t.metafeatures, "accuracy")


@query("flagship_leaderboard_with_default", board_sql("v_with_default", "log_loss"), r=BOARD_COLS)
def _(t):
    return L.leaderboard(t.results, t.metafeatures, "log_loss", with_default=True)


# --- B -------------------------------------------------------------------------
@query("b01_filter_classification", "SELECT * FROM v_results WHERE target_type <> 'regression'")
def _(t):
    return A.filter_classification(t.results)


@query("b02_num_instances", "SELECT dataset_name AS dataset_fold_id, f__general_nr_inst AS num_inst FROM v_metafeatures")
def _(t):
    return A.num_instances(t.metafeatures)


@query("b03_lookup", """SELECT dataset_fold_id, trial_number, accuracy__test FROM v_results
 WHERE alg_name = 'XGBoost' AND hparam_source = 'default' AND dataset_name = 'openml__d_3__103'""")
def _(t):
    return A.lookup_results(t.results, "XGBoost", "default", "openml__d_3__103",
                            ["dataset_fold_id", "trial_number", "accuracy__test"])


@query("b04_runtime_per_1000", """SELECT dataset_fold_id, alg_hparam_id,
 1e3 * time__train / nullif(f__general_nr_inst, 0) AS train_per_1000_inst
 FROM v_results LEFT JOIN v_metafeatures AS m ON dataset_fold_id = m.dataset_name""", r="train_per_1000_inst")
def _(t):
    df = A.add_runtime_per_1000(A.join_num_instances(t.results, t.metafeatures))
    return df.select("dataset_fold_id", "alg_hparam_id", "train_per_1000_inst")


@query("b05_display_name", "SELECT dataset_fold_id, alg_hparam_id, shown AS alg_name FROM v_results JOIN v_names ON alg_name = raw")
def _(t):
    return A.display_name(t.results).select("dataset_fold_id", "alg_hparam_id", "alg_name")


@query("b06_alg_type", "SELECT DISTINCT shown AS alg_name, family AS alg_type FROM v_results JOIN v_names ON alg_name = raw")
def _(t):
    return A.alg_type(A.display_name(t.results.select("alg_name"))).distinct()


@query("b07_default_rows", """SELECT dataset_fold_id, alg_hparam_id, concat(shown, ' (default)') AS alg_name
 FROM v_results JOIN v_names ON alg_name = raw WHERE hparam_source = 'default' AND shown <> 'LinearModel'""")
def _(t):
    return A.default_rows(A.display_name(t.results)).select("dataset_fold_id", "alg_hparam_id", "alg_name")


@query("b08_fold_base_name", """SELECT dataset_name AS dataset_fold_id,
 regexp_replace(dataset_name, '__fold_[0-9]$', '') AS dataset_basename FROM v_metafeatures""")
def _(t):
    return t.metafeatures.select(F.col("dataset_name").alias("dataset_fold_id"),
                                 A.fold_base_name("dataset_name").alias("dataset_basename"))


MF_COLS = ("f__general_nr_inst f__general_nr_class f__statistical_min f__statistical_max f__infotheory_x")
AGG_MF = ("SELECT regexp_replace(dataset_name, '__fold_[0-9]$', '') AS dataset_basename, "
          + ", ".join(f"median({c}) AS {c}" for c in MF_COLS.split()) + " FROM v_metafeatures GROUP BY 1")


@query("b09_finish_metafeatures", f"""SELECT * REPLACE (round_even(f__general_nr_class, 0) AS f__general_nr_class),
 round_even(f__general_nr_inst / 8e-1, 0) AS f__general_total_num_instances FROM ({AGG_MF}) AS a""", r=MF_COLS)
def _(t):
    return L.finished_metafeatures(t.metafeatures)


@query("b10_drop_hist", """SELECT dataset_name, f__general_nr_inst, f__general_nr_class, f__statistical_min,
 f__statistical_max FROM v_metafeatures""")
def _(t):
    return A.drop_hist(t.metafeatures.withColumnRenamed("f__infotheory_x", "f__infotheory_x.histogram.0"))


@query("b11_select_families", "SELECT dataset_name, f__general_nr_inst, f__general_nr_class, f__infotheory_x FROM v_metafeatures")
def _(t):
    return A.select_families(t.metafeatures, ["general", "infotheory"])


CLEAN = "concat(translate(split_part({c}, '__', 2), '_', '-'), ' (', split_part({c}, '__', 3), ')')"


@query("b12_clean_dataset_name", f"""SELECT DISTINCT dataset_name AS raw_name,
 {CLEAN.format(c='dataset_name')} AS shown_name FROM v_results""")
def _(t):
    return t.results.select(F.col("dataset_name").alias("raw_name"),
                            A.clean_dataset_name("dataset_name").alias("shown_name")).distinct()


def case_map(key: str, table: dict, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{default}' END"


@query("b13_style", f"""SELECT dataset_fold_id, alg_hparam_id, alg_name, {case_map('alg_name', names.MARKERS, 'x')} AS marker,
 {case_map('alg_type', names.COLORS, 'gray')} AS color FROM v_with_default""")
def _(t):
    return A.style(A.append_default_rows(analysis(t))).select(
        "dataset_fold_id", "alg_hparam_id", "alg_name", "marker", "color")


@query("b14_rename_axes", """SELECT dataset_name, f__general_nr_class AS "Num. target classes" FROM v_metafeatures""")
def _(t):
    return A.rename_axes(t.metafeatures, names.DATASET_AXES).select("dataset_name", "`Num. target classes`")


@query("b15_select_points", """SELECT dataset_name AS dataset_id, alg_name, time__train AS x, accuracy__test AS y
 FROM v_results WHERE dataset_name IN (SELECT concat('openml__d_', r_regionkey, '__', 100 + r_regionkey) FROM region)""")
def _(t):
    chosen = t.table("region").select(
        F.concat(F.lit("openml__d_"), "r_regionkey", F.lit("__"), F.lit(100) + F.col("r_regionkey")).alias("dataset_id"))
    return A.select_points(t.results.withColumnRenamed("dataset_name", "dataset_id"), chosen, "time__train", "accuracy__test")


EXC = "CASE WHEN (trial_number * 7 + fold) % 11 = 0 THEN 'ValueError: bad input' ELSE 'None' END"


@query("b16_split_errors", f"""SELECT alg_name, count(*) FILTER (WHERE x = 'None') AS n_ok,
 count(*) FILTER (WHERE x <> 'None') AS n_failed FROM (SELECT alg_name, {EXC} AS x FROM v_results) AS a GROUP BY alg_name""")
def _(t):
    ok, bad = A.split_errors(t.results.withColumn("exception", F.expr(EXC)))
    tagged = ok.select("alg_name", F.lit(1).alias("ok")).unionByName(bad.select("alg_name", F.lit(0).alias("ok")))
    return tagged.groupBy("alg_name").agg(F.count_if(F.col("ok") == 1).alias("n_ok"),
                                          F.count_if(F.col("ok") == 0).alias("n_failed"))


@query("b17_make_ids", """SELECT dataset_fold_id, alg_hparam_id, concat('openml__', alg_name, '__', trial_number) AS task_name
 FROM v_results""")
def _(t):
    src = t.results.drop("dataset_fold_id", "alg_hparam_id").withColumn("hparam_seed", F.lit(0))
    return A.make_ids(src).select("dataset_fold_id", "alg_hparam_id",
                                  A.openml_name(F.col("alg_name"), F.col("trial_number")).alias("task_name"))


@query("b18_hparam_source", """SELECT dataset_fold_id, alg_hparam_id, hparam_source,
 concat('sampler_', trial_number) AS sampler_source FROM v_results""")
def _(t):
    return t.results.select("dataset_fold_id", "alg_hparam_id",
                            A.hparam_source(F.col("trial_number"), F.lit(0)).alias("hparam_source"),
                            A.hparam_source(F.col("trial_number"), F.lit(0), sampler=True).alias("sampler_source"))


@query("b21_remap_label", """SELECT row_id, CASE WHEN y_bin * 2 - 1 = -1 THEN 0 ELSE y_bin * 2 - 1 END AS y_zero_one,
 y_multi = 'F' AS y_is_f FROM v_features""")
def _(t):
    from gradus.operators import prep as P

    src = t.features.withColumn("signed", F.col("y_bin") * 2 - 1)
    return src.select("row_id", P.remap_label("signed").alias("y_zero_one"), P.binarise("y_multi", "F").alias("y_is_f"))


@query("b22_assert_no_nulls", "SELECT CAST(0 AS BIGINT) AS alg_name, CAST(0 AS BIGINT) AS alg_type FROM (SELECT count(*) FROM v_results) AS a")
def _(t):
    return A.assert_no_nulls(A.alg_type(A.display_name(t.results.select("alg_name"))), ["alg_name", "alg_type"])


@query("b23_supported", """SELECT DISTINCT alg_name, target_type FROM v_results
 WHERE NOT (alg_name IN ('DeepFM', 'NAM') AND target_type = 'classification')
 AND NOT (alg_name IN ('rtdl_MLP', 'rtdl_ResNet', 'rtdl_FTTransformer') AND target_type = 'regression')""")
def _(t):
    return A.supported(t.results.select("alg_name", "target_type").distinct())


# --- C -------------------------------------------------------------------------
@query("c01_join_num_instances", """SELECT dataset_fold_id, alg_hparam_id, f__general_nr_inst AS num_inst
 FROM v_results LEFT JOIN v_metafeatures AS m ON dataset_fold_id = m.dataset_name""")
def _(t):
    return A.join_num_instances(t.results, t.metafeatures).select("dataset_fold_id", "alg_hparam_id", "num_inst")


@query("c02_with_bounds", """SELECT dataset_fold_id, alg_hparam_id, accuracy__test,
 min(accuracy__test) OVER (PARTITION BY dataset_fold_id) AS accuracy__test_min,
 max(accuracy__test) OVER (PARTITION BY dataset_fold_id) AS accuracy__test_max FROM v_results""")
def _(t):
    df = t.results.select("dataset_fold_id", "alg_hparam_id", "accuracy__test")
    return A.with_bounds(df, "dataset_fold_id", "accuracy__test")


MERGED_FOLD = "accuracy__test f1__test " + " ".join(f"normalized_{m}__test" for m in names.RESULT_METRICS)


@query("c03_merge_metrics", "WITH " + ", ".join(
    f"t_{m} AS ({folds_sql('v_analysis', m)})" for m in names.RESULT_METRICS) + """
 SELECT a.alg_name, a.dataset_fold_id, a.alg_hparam_id, a.accuracy__test, a.f1__test, a.alg_type, """ + ", ".join(
    f"t_{m}.normalized_{m}__test, t_{m}.{m}_rank" for m in names.RESULT_METRICS if m != "accuracy") + """,
 a.normalized_accuracy__test, a.accuracy_rank FROM t_accuracy AS a """ + " ".join(
    f"JOIN t_{m} ON a.alg_name = t_{m}.alg_name AND a.dataset_fold_id = t_{m}.dataset_fold_id"
    for m in names.RESULT_METRICS if m != "accuracy"), r=MERGED_FOLD)
def _(t):
    df = L.merged_folds(analysis(t))
    return df.select("alg_name", "dataset_fold_id", "alg_hparam_id", "alg_type", *MERGED_FOLD.split(),
                     *[f"{m}_rank" for m in names.RESULT_METRICS])


MERGED_DS = "time__train_median " + " ".join(
    f"{m}__test_mean normalized_{m}__test_mean normalized_{m}__test_std train_per_1000_inst_mean_{m}"
    for m in names.RESULT_METRICS)


@query("c03_merge_metrics_datasets", "WITH " + ", ".join(
    f"t_{m} AS ({datasets_sql('v_with_default', m)})" for m in names.RESULT_METRICS) + """
 SELECT a.alg_name, a.dataset_name, a.time__train_median, """ + ", ".join(
    f"t_{m}.{m}__test_mean, t_{m}.normalized_{m}__test_mean, t_{m}.normalized_{m}__test_std, "
    f"t_{m}.train_per_1000_inst_mean_{m}, t_{m}.{m}_rank_mean" for m in names.RESULT_METRICS) + """
 FROM t_accuracy AS a """ + " ".join(
    f"JOIN t_{m} ON a.alg_name = t_{m}.alg_name AND a.dataset_name = t_{m}.dataset_name"
    for m in names.RESULT_METRICS), r=MERGED_DS)
def _(t):
    df = L.merged_datasets(A.append_default_rows(analysis(t)))
    return df.select("alg_name", "dataset_name", *MERGED_DS.split(), *[f"{m}_rank_mean" for m in names.RESULT_METRICS])


@query("c04_join_alg_type", "SELECT alg_name, dataset_fold_id, alg_hparam_id, alg_type FROM v_analysis")
def _(t):
    df = analysis(t)
    return A.join_alg_type(df.select("alg_name", "dataset_fold_id", "alg_hparam_id"), df)


NORM_STD = f"""SELECT alg_name, dataset_name, normalized_accuracy__test_std FROM ({datasets_sql('v_analysis', 'accuracy')}) AS d"""


def _spread(t: Tables):
    """Dataset means of the tuned rows, and the rows normalised by the means' bounds."""
    folds = A.tuned_alg_perf(analysis(t), "accuracy")
    agg = A.agg_over_folds(folds, ["accuracy__test"])
    limits = A.bounds(agg, "dataset_name", "accuracy__test_mean")
    return agg, A.normalize_with(folds, limits, "dataset_name", "accuracy__test",
                                 "accuracy__test_mean_min", "accuracy__test_mean_max")


@query("c05_join_std", f"SELECT alg_name, dataset_name, accuracy__test_mean, normalized_accuracy__test_std FROM ({datasets_sql('v_analysis', 'accuracy')}) AS d",
       r="normalized_accuracy__test_std accuracy__test_mean")
def _(t):
    agg, spread = _spread(t)
    return A.join_std(agg, A.norm_std(spread, "normalized_accuracy__test")).select(
        "alg_name", "dataset_name", "accuracy__test_mean", "normalized_accuracy__test_std")


@query("c06_join_tuned_with_metafeatures", f"""SELECT t.alg_name, t.dataset_fold_id, t.alg_hparam_id, m.f__statistical_max,
 m.f__infotheory_x FROM ({tuned_sql('v_results', 'auc')}) AS t LEFT JOIN v_metafeatures AS m ON t.dataset_fold_id = m.dataset_name""")
def _(t):
    df = A.join_tuned_with_metafeatures(A.tuned_alg_perf(t.results, "auc"), t.metafeatures)
    return df.select("alg_name", "dataset_fold_id", "alg_hparam_id", "f__statistical_max", "f__infotheory_x")


@query("c07_join_axes", f"""SELECT {CLEAN.format(c='r.dataset_name')} AS dataset_name, r.alg_hparam_id, r.dataset_fold_id,
 a.f__statistical_max FROM v_results AS r LEFT JOIN ({AGG_MF}) AS a ON r.dataset_name = a.dataset_basename""")
def _(t):
    df = A.join_axes(t.results, A.agg_metafeatures(t.metafeatures), ["f__statistical_max"])
    return df.select("dataset_name", "alg_hparam_id", "dataset_fold_id", "f__statistical_max")


PLAN_SQL = """SELECT d.dataset_name, a.alg_name, e.experiment FROM (SELECT DISTINCT split_part(path, '/', 2) AS dataset_name
 FROM v_listing) AS d, (VALUES ('alg0'), ('alg1'), ('alg2'), ('alg3'), ('alg4')) AS a(alg_name),
 (VALUES ('expt-0'), ('expt-1'), ('expt-2')) AS e(experiment)"""
LOG_SQL = """SELECT split_part(path, '/', 2) AS dataset_name, split_part(path, '/', 3) AS alg_name,
 CASE WHEN length(split_part(path, '/', 4)) < 23 THEN split_part(path, '/', 4)
 ELSE substring(split_part(path, '/', 4), 1, length(split_part(path, '/', 4)) - 23) END AS experiment FROM v_listing"""


def _plan(t):
    from gradus.sources import listing as S

    log = S.experiment_log(t.listing)
    plan = A.experiment_plan([f"alg{i}" for i in range(5)], log.select("dataset_name").distinct(),
                             [f"expt-{i}" for i in range(3)])
    return plan, log


@query("c08_experiment_plan", PLAN_SQL)
def _(t):
    return _plan(t)[0]


@query("c09_pending", f"SELECT * FROM ({PLAN_SQL}) AS p EXCEPT SELECT dataset_name, alg_name, experiment FROM ({LOG_SQL}) AS l")
def _(t):
    return A.pending(*_plan(t))


IMPORTED = "SELECT DISTINCT p_partkey % 50 AS task_id FROM part WHERE p_size < 3"


@query("c10_flag_in_repo", f"""SELECT l_suppkey IN ({IMPORTED}) AS in_repo, l_suppkey AS task_id, n FROM (
 SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey) AS a""")
def _(t):
    tasks = t.table("lineitem").groupBy(F.col("l_suppkey").alias("task_id")).agg(F.count("*").alias("n"))
    return A.flag_in_repo(tasks, _imported(t))


def _imported(t):
    return t.table("part").filter("p_size < 3").select((F.col("p_partkey") % 50).alias("task_id")).distinct()


@query("c11_suite_todo", f"SELECT DISTINCT l_suppkey AS task_id FROM lineitem WHERE l_suppkey NOT IN ({IMPORTED})")
def _(t):
    return A.anti_on(t.table("lineitem").select(F.col("l_suppkey").alias("task_id")).distinct(), _imported(t), ["task_id"])


@query("c15_take_rows", "SELECT row_id, x1, k1 FROM v_features WHERE row_id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def _(t):
    idx = t.table("lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("row_id"))
    return A.take_rows(t.features.select("row_id", "x1", "k1"), idx)


# --- D -------------------------------------------------------------------------
@query("d01_datasets_per_alg", "SELECT alg_name, count(DISTINCT dataset_name) AS n_datasets FROM v_results GROUP BY alg_name")
def _(t):
    return A.datasets_per_alg(t.results)


@query("d02_algs_per_dataset", "SELECT dataset_name, count(DISTINCT alg_name) AS n_algs FROM v_results GROUP BY dataset_name")
def _(t):
    return A.algs_per_dataset(t.results)


@query("d03_complete_datasets", f"""SELECT dataset_fold_id, alg_hparam_id FROM v_results WHERE dataset_name IN (
 SELECT dataset_name FROM v_results WHERE alg_name IN {ALGS8} GROUP BY dataset_name HAVING count(DISTINCT alg_name) = 8)""")
def _(t):
    return A.complete_datasets(t.results, ALGS8).select("dataset_fold_id", "alg_hparam_id")


@query("d04_bounds", """SELECT dataset_fold_id, min(auc__test) AS auc__test_min, max(auc__test) AS auc__test_max
 FROM v_results GROUP BY dataset_fold_id""")
def _(t):
    return A.bounds(t.results, "dataset_fold_id", "auc__test")


D05 = "f1__test_median f1__test_mean time__train_median time__train_mean"


@query("d05_agg_over_folds", f"""SELECT alg_name, dataset_name, median(f1__test) AS f1__test_median, round(avg(f1__test), 9) AS f1__test_mean,
 median(time__train) AS time__train_median, avg(time__train) AS time__train_mean
 FROM ({tuned_sql('v_analysis', 'f1')}) AS a GROUP BY alg_name, dataset_name""", r=D05)
def _(t):
    return A.agg_over_folds(A.tuned_alg_perf(analysis(t), "f1"), ["f1__test", "time__train"])


@query("d06_norm_std", NORM_STD, r="normalized_accuracy__test_std")
def _(t):
    return A.norm_std(_spread(t)[1], "normalized_accuracy__test")


@query("d07_rank_table", board_sql("v_analysis", "auc"), r=BOARD_COLS)
def _(t):
    return L.leaderboard(t.results, t.metafeatures, "auc")


FMT = "norm_mean norm_median std_mean std_median runtime_mean runtime_median"


@query("d08_format_rank_table", "SELECT alg_name, printf('%d', CAST(rank_min AS INT)) AS rank_min, printf('%d', CAST(rank_max AS INT)) AS rank_max, "
       "printf('%.2f', round(rank_mean + 1.7e-9, 6) + 1e-9) AS rank_mean, CASE WHEN rank_median = floor(rank_median) THEN printf('%d', CAST(rank_median AS INT)) "
       "ELSE printf('%.1f', rank_median) END AS rank_median, "
       + ", ".join(f"printf('%.2f', round({c} + 1.7e-9, 6) + 1e-9) AS {c}" for c in FMT.split())
       + f" FROM ({board_sql('v_analysis', 'f1')}) AS b")
def _(t):
    table = L.leaderboard(t.results, t.metafeatures, "f1")
    return A.format_rank_table(table.withColumns({
        c: F.round(F.col(c) + F.lit(1.7e-9), 6) + F.lit(1e-9) for c in ["rank_mean", *FMT.split()]}))


@query("d09_agg_metafeatures", AGG_MF, r=MF_COLS)
def _(t):
    return A.agg_metafeatures(t.metafeatures)


@query("d10_impute_median", "SELECT dataset_name, " + ", ".join(
    f"coalesce({c}, (SELECT median({c}) FROM v_metafeatures)) AS {c}" for c in MF_COLS.split()) + " FROM v_metafeatures", r=MF_COLS)
def _(t):
    return A.impute_median(t.metafeatures)


@query("d11_describe", """SELECT count(x0) AS "count", avg(x0) AS mean, stddev_samp(x0) AS std, min(x0) AS "min", max(x0) AS "max",
 quantile_cont(x0, 0.25) AS q25, quantile_cont(x0, 0.5) AS q50, quantile_cont(x0, 0.75) AS q75 FROM v_features""",
       r="mean std q25 q50 q75")
def _(t):
    return A.describe(t.features, "x0")


CORR_SQL = ("SELECT 'FEAT' AS feature, alg_name, CASE WHEN isnan(corr(FEAT, accuracy__test)) THEN NULL ELSE corr(FEAT, accuracy__test) END AS corr "
            f"FROM (SELECT t.*, m.* EXCLUDE (dataset_name) FROM ({tuned_sql('v_analysis', 'accuracy')}) AS t LEFT JOIN (SELECT dataset_name, "
            + ", ".join(f"coalesce({c}, (SELECT median({c}) FROM v_metafeatures)) AS {c}" for c in MF_COLS.split())
            + " FROM v_metafeatures) AS m ON t.dataset_fold_id = m.dataset_name) AS j GROUP BY alg_name")


@query("d12_feature_corrs", " UNION ALL ".join(CORR_SQL.replace("FEAT", c) for c in MF_COLS.split()), r="corr")
def _(t):
    return L.featurised_correlations(A.display_name(t.results), t.metafeatures, "accuracy")


@query("d13_alg_types", "SELECT DISTINCT alg_name, alg_type FROM v_analysis")
def _(t):
    return A.alg_types(analysis(t))


OBJ_SQL = """SELECT alg_name, dataset_name, trial_number, target_type, CASE target_type WHEN 'binary' THEN 'maximize' ELSE 'minimize' END AS direction,
 avg(CASE target_type WHEN 'binary' THEN auc__val WHEN 'classification' THEN log_loss__val ELSE time__val END) AS objective
 FROM v_results GROUP BY 1, 2, 3, 4, 5"""


def _objective(t):
    return A.trial_objective(t.results.withColumn("mse__val", F.col("time__val")))


@query("d14_trial_objective", OBJ_SQL, r="objective")
def _(t):
    return _objective(t)


@query("d15_best_trial", f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY alg_name, dataset_name ORDER BY
 round(CASE direction WHEN 'maximize' THEN -objective ELSE objective END, 9), trial_number) AS rn
 FROM ({OBJ_SQL}) AS o WHERE objective IS NOT NULL) AS q WHERE rn = 1""", r="objective")
def _(t):
    return A.best_trial(_objective(t).withColumn("objective", F.round("objective", 9)))


@query("d16_avg_time", """SELECT alg_name, dataset_name, avg(time__train) AS time__train_mean, avg(time__val) AS time__val_mean,
 avg(time__test) AS time__test_mean FROM v_results GROUP BY 1, 2""", r="time__train_mean time__val_mean time__test_mean")
def _(t):
    return A.avg_time(t.results)


METER_SQL = """SELECT event_type, max_by(value, event_id) AS val, sum(value * (event_id % 5 + 1)) AS "sum",
 CAST(sum(event_id % 5 + 1) AS BIGINT) AS "count", sum(value * (event_id % 5 + 1)) / sum(event_id % 5 + 1) AS "avg" FROM events GROUP BY event_type"""


@query("d17_meters", METER_SQL, r="sum avg")
def _(t):
    return A.meters(t.table("events").withColumn("n", F.col("event_id") % 5 + 1), "event_type", "value", "n", "event_id")


@query("d18_label_domain", """SELECT k1, string_agg(y_multi, ',' ORDER BY y_multi) AS labels, count(*) AS n_classes
 FROM (SELECT DISTINCT k1, y_multi FROM v_features) AS a GROUP BY k1""")
def _(t):
    return A.label_domain(t.features, "y_multi", "k1")


@query("d19_distinct_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS n_distinct FROM v_features" for c in ("x0", "x1", "x2", "x4", "k0", "k1", "k2")))
def _(t):
    return A.distinct_counts(t.features, ["x0", "x1", "x2", "x4", "k0", "k1", "k2"])


GAINS = """SELECT l_suppkey % 6 AS tree_group, CAST(l_linenumber AS INT) AS feature, l_quantity AS gain FROM lineitem
 WHERE l_linenumber <= l_suppkey % 6 + 1"""


@query("d20_top_gain_features", f"""WITH g AS ({GAINS}), s AS (SELECT tree_group, feature, sum(gain) AS gain FROM g GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY tree_group ORDER BY gain DESC, feature) AS pos FROM s)
 SELECT x.tree_group, CAST(p.pos AS INT) AS pos, coalesce(r.feature, -1) AS feature, coalesce(r.gain, 0e0) AS gain
 FROM (SELECT DISTINCT tree_group FROM g) AS x CROSS JOIN (SELECT unnest(range(1, 5)) AS pos) AS p
 LEFT JOIN r ON r.tree_group = x.tree_group AND r.pos = p.pos""")
def _(t):
    return A.top_gain_features(t.sql(GAINS), 4)


@query("d21_failure_report", f"""SELECT dataset_name, alg_name, n_ok, n_failed, n_failed * 1e0 / (n_ok + n_failed) AS error_rate FROM (
 SELECT dataset_name, alg_name, count(DISTINCT CASE WHEN x = 'None' THEN alg_hparam_id END) AS n_ok,
 count(*) FILTER (WHERE x <> 'None') AS n_failed FROM (SELECT *, {EXC} AS x FROM v_results) AS a GROUP BY 1, 2) AS b""", r="error_rate")
def _(t):
    ok, bad = A.split_errors(t.results.withColumn("exception", F.expr(EXC)))
    return A.failure_report(ok, bad)


# --- F -------------------------------------------------------------------------
for _m in names.RESULT_METRICS:
    @query(f"f01_tuned_alg_perf_{_m}", f"SELECT dataset_fold_id, alg_name, alg_hparam_id, {_m}__val, {_m}__test FROM ({tuned_sql('v_results', _m)}) AS a")
    def _(t, m=_m):
        return A.tuned_alg_perf(t.results, m).select("dataset_fold_id", "alg_name", "alg_hparam_id", f"{m}__val", f"{m}__test")


@query("f02_rank_algs", f"SELECT alg_name, dataset_fold_id, log_loss_rank FROM ({folds_sql('v_analysis', 'log_loss')}) AS a")
def _(t):
    tuned = A.tuned_alg_perf(analysis(t), "log_loss")
    return A.rank_algs(tuned, "dataset_fold_id", "log_loss__test", "log_loss", "log_loss_rank").select(
        "alg_name", "dataset_fold_id", "log_loss_rank")


@query("f03_normalize", f"SELECT alg_name, dataset_fold_id, normalized_auc__test FROM ({folds_sql('v_analysis', 'auc')}) AS a", r="normalized_auc__test")
def _(t):
    tuned = A.tuned_alg_perf(analysis(t), "auc")
    return A.normalize(tuned, "dataset_fold_id", "auc__test").select("alg_name", "dataset_fold_id", "normalized_auc__test")


@query("f04_normalize_with", f"""SELECT x.alg_name, x.dataset_fold_id, (x.f1__test - d.f1__test_mean_min) / nullif(d.f1__test_mean_max - d.f1__test_mean_min, 0)
 AS normalized_f1__test FROM ({tuned_sql('v_analysis', 'f1')}) AS x JOIN (SELECT DISTINCT dataset_name, f1__test_mean_min, f1__test_mean_max
 FROM ({datasets_sql('v_analysis', 'f1')}) AS a) AS d ON x.dataset_name = d.dataset_name""", r="normalized_f1__test")
def _(t):
    tuned = A.tuned_alg_perf(analysis(t), "f1")
    limits = A.bounds(A.agg_over_folds(tuned, ["f1__test"]), "dataset_name", "f1__test_mean")
    out = A.normalize_with(tuned, limits, "dataset_name", "f1__test", "f1__test_mean_min", "f1__test_mean_max")
    return out.select("alg_name", "dataset_fold_id", "normalized_f1__test")


@query("f05_prefix_sum_keyed", """SELECT e, row_id, sum(risk) OVER (PARTITION BY e ORDER BY t, row_id ROWS UNBOUNDED PRECEDING) AS cum
 FROM v_survival""", r="cum")
def _(t):
    from gradus.plans.ordering import order_buckets, prefix_sums

    return prefix_sums(order_buckets(t.survival, "t", "row_id"), ["e"], ["t", "row_id"], {"cum": "risk"}).select("e", "row_id", "cum")


@query("f05_prefix_sum_global", """SELECT event_id, sum(value) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS cum FROM events""", r="cum")
def _(t):
    from gradus.plans.ordering import prefix_sums, value_buckets

    ev = t.table("events").select("event_id", "value")
    return prefix_sums(value_buckets(ev, "event_id"), [], ["event_id"], {"cum": "value"}).select("event_id", "cum")


@query("f06_row_index_hash", "SELECT row_id, row_number() OVER (ORDER BY md5(concat(row_id, ':7')), row_id) - 1 AS row_index FROM v_features")
def _(t):
    from gradus.plans.ordering import hash_row_index

    return hash_row_index(t.features.select("row_id"), "row_id", 7)


@query("f06_row_index_value", """SELECT row_id, k1, row_number() OVER (PARTITION BY k1 ORDER BY x1, row_id) - 1 AS row_index FROM v_features""")
def _(t):
    from gradus.plans.ordering import row_index

    return row_index(t.features.select("row_id", "k1", "x1"), "x1", ["row_id"], ["k1"]).drop("x1")


@query("f07_first_seen_id", """SELECT k2, first_at, row_number() OVER (ORDER BY first_at, k2) - 1 AS dataset_id FROM (
 SELECT k2, min(row_id) AS first_at FROM v_features GROUP BY k2) AS a""")
def _(t):
    return A.first_seen_id(t.features.select("row_id", "k2"), "k2", "row_id")


MAX_EPOCHS = 500  # fixed value: the most epochs of a training


@query("f08_early_stop", """WITH a AS (SELECT *, min(val_loss) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p
 FROM v_curve WHERE epoch < 500), b AS (SELECT *, max(CASE WHEN p IS NULL OR val_loss < p THEN epoch END) OVER (PARTITION BY run_id ORDER BY epoch) AS best FROM a),
 c AS (SELECT run_id, min(epoch) FILTER (WHERE best + 20 < epoch) AS stop FROM b GROUP BY run_id)
 SELECT b.run_id, max(b.best) AS best_epoch, max(b.epoch) AS last_epoch, min(b.val_loss) AS best_val_loss, c.stop IS NOT NULL AS stopped_early
 FROM b JOIN c ON b.run_id = c.run_id WHERE c.stop IS NULL OR b.epoch <= c.stop GROUP BY b.run_id, c.stop""")
def _(t):
    return A.early_stop(t.curve, 20, MAX_EPOCHS)


@query("f09_early_stop_tol", """WITH RECURSIVE v AS (SELECT * FROM v_curve WHERE epoch < 500 AND val_loss IS NOT NULL),
 s(run_id, epoch, best, best_epoch, wait, stopped_epoch, stop) AS (
 SELECT run_id, epoch, val_loss, epoch, 1, 0, false FROM v WHERE epoch = 0 UNION ALL
 SELECT v.run_id, v.epoch, CASE WHEN s.best - v.val_loss > 5e-1 THEN v.val_loss ELSE s.best END,
 CASE WHEN s.best - v.val_loss > 5e-1 THEN v.epoch ELSE s.best_epoch END,
 CASE WHEN s.best - v.val_loss > 5e-1 THEN 1 ELSE s.wait + 1 END,
 CASE WHEN NOT s.best - v.val_loss > 5e-1 AND s.wait >= 5 THEN v.epoch ELSE s.stopped_epoch END,
 NOT s.best - v.val_loss > 5e-1 AND s.wait >= 5
 FROM s JOIN v ON v.run_id = s.run_id AND v.epoch = s.epoch + 1 WHERE NOT s.stop)
 SELECT run_id, best_epoch, best AS best_value, stopped_epoch, stop AS stopped FROM (
 SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY epoch DESC) AS rn FROM s) AS z WHERE rn = 1""")
def _(t):
    return A.early_stop_tol(t.curve, 5, 0.5, False, MAX_EPOCHS)


@query("f10_running_best", f"""SELECT alg_name, dataset_name, trial_number, target_type, direction, objective,
 CASE direction WHEN 'maximize' THEN max(objective) OVER w ELSE min(objective) OVER w END AS best_so_far FROM ({OBJ_SQL}) AS o
 WINDOW w AS (PARTITION BY alg_name, dataset_name, target_type ORDER BY trial_number)""", r="objective best_so_far")
def _(t):
    return A.running_best(_objective(t), ["alg_name", "dataset_name", "target_type"], "trial_number", "objective", F.col("direction") == "maximize")


# --- G -------------------------------------------------------------------------
@query("g01_sort_results", "SELECT dataset_fold_id, alg_hparam_id, accuracy__test FROM v_results ORDER BY 1, 2")
def _(t):
    return A.sort_results(t.results.select("dataset_fold_id", "alg_hparam_id", "accuracy__test"))


@query("g01_sort_errors", f"SELECT dataset_name, alg_hparam_id, fold FROM v_results WHERE {EXC} <> 'None' ORDER BY 1, 2")
def _(t):
    bad = A.split_errors(t.results.withColumn("exception", F.expr(EXC)))[1]
    return A.sort_errors(bad.select("dataset_name", "alg_hparam_id", "fold"))


@query("g02_sort_ranks", f"SELECT alg_name, rank_mean FROM ({board_sql('v_analysis', 'log_loss')}) AS b ORDER BY rank_mean, alg_name", r="rank_mean")
def _(t):
    return L.leaderboard(t.results, t.metafeatures, "log_loss").select("alg_name", "rank_mean")


@query("g03_head", "SELECT dataset_fold_id, alg_hparam_id FROM v_results ORDER BY 1, 2 LIMIT 20")
def _(t):
    return A.head(t.results.select("dataset_fold_id", "alg_hparam_id"), 20, ["dataset_fold_id", "alg_hparam_id"])


@query("g07_top_gain", f"""SELECT tree_group, feature, gain FROM (SELECT *, row_number() OVER (PARTITION BY tree_group ORDER BY gain DESC, feature) AS rn
 FROM (SELECT tree_group, feature, sum(gain) AS gain FROM ({GAINS}) AS g GROUP BY 1, 2) AS s) AS r WHERE rn <= 1""")
def _(t):
    return A.top_gain_features(t.sql(GAINS), 1).drop("pos")


# --- H -------------------------------------------------------------------------
@query("h01_append_default_rows", "SELECT alg_name, dataset_fold_id, alg_hparam_id FROM v_with_default")
def _(t):
    return A.append_default_rows(analysis(t)).select("alg_name", "dataset_fold_id", "alg_hparam_id")


@query("h02_prepend_metafeatures", """SELECT dataset_name, f__general_nr_inst, NULL AS f__infotheory_x FROM v_metafeatures
 UNION ALL SELECT dataset_name, NULL, f__infotheory_x FROM v_metafeatures""")
def _(t):
    mf = t.metafeatures
    return A.prepend_metafeatures(mf.select("dataset_name", "f__general_nr_inst"), mf.select("dataset_name", "f__infotheory_x"))


@query("h03_processed_paths", "SELECT DISTINCT path AS results_bucket_path FROM v_listing")
def _(t):
    ls = t.listing.withColumnRenamed("path", "results_bucket_path")
    return A.processed_paths(ls.filter(F.col("results_bucket_path").contains("alg1")), ls)


@query("h06_flatten", "SELECT dataset_name, alg_name, accuracy__test AS \"row\" FROM v_results")
def _(t):
    nested = t.results.select("dataset_name", "alg_name", F.array("accuracy__test").alias("rows"))
    return A.flatten(nested, "rows")


@query("h07_concat_tasks", "SELECT l_suppkey AS task_id FROM lineitem UNION ALL SELECT p_partkey FROM part")
def _(t):
    a = t.table("lineitem").select(F.col("l_suppkey").alias("task_id"))
    return a.unionByName(t.table("part").select(F.col("p_partkey").alias("task_id")))


@query("h08_distinct_first", "SELECT k0, k1, min(row_id) AS first_at FROM v_features GROUP BY k0, k1")
def _(t):
    return A.distinct_first(t.features, ["k0", "k1"], "row_id")
