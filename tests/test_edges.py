"""Hand-made frames: ties, nulls, zero ranges, missing classes, hot keys."""
import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.functions import scalar as S
from gradus.operators import analysis as A
from gradus.operators import metafeatures as K
from gradus.operators import metrics as M
from gradus.operators import neighbors as N
from gradus.operators.information import nearest_information
from gradus.operators import prep as P
from gradus.plans import leaderboard as L
from gradus.plans import ordering as O
from gradus.plans.moments import fold_moments

COLS = "alg_name string, dataset_fold_id string, alg_hparam_id string, trial_number int, accuracy__val double, accuracy__test double"


def test_tuning_ties_take_the_first_id_as_a_string(spark):
    df = spark.createDataFrame([
        ("A", "d__fold_0", "A__trial_2", 2, 0.9, 0.1), ("A", "d__fold_0", "A__trial_10", 10, 0.9, 0.2),
        ("A", "d__fold_0", "A__trial_1", 1, 0.8, 0.3), ("A", "d__fold_1", "A__trial_1", 1, None, 0.5)], COLS)
    got = A.tuned_alg_perf(df, "accuracy").collect()
    assert [(r.alg_hparam_id, r.accuracy__test) for r in got] == [("A__trial_10", 0.2)]


def test_tuning_limits_groups_before_the_shuffle(spark):
    df = spark.range(1000).select(
        (F.col("id") % 2).cast("string").alias("alg_name"), (F.col("id") % 3).cast("string").alias("dataset_fold_id"), F.col("id").cast("string").alias("alg_hparam_id"),
        F.col("id").cast("int").alias("trial_number"), F.rand(1).alias("accuracy__val"))
    plan = A.tuned_alg_perf(df, "accuracy")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_single_pass_tuning_agrees_with_the_window(spark):
    rng = random.Random(1)
    rows = [(f"a{a}", f"d__fold_{f}", f"a{a}__t{i}", i, rng.choice([None, 0.5, 0.6, 0.7]), rng.random())
            for a in range(4) for f in range(5) for i in range(6)]
    df = spark.createDataFrame(rows, COLS).withColumn("dataset_name", F.lit("d")).withColumn("train_per_1000_inst", F.lit(1.0))
    a = {(r.alg_name, r.dataset_fold_id): r.alg_hparam_id for r in A.tuned_alg_perf(df, "accuracy").collect()}
    b = {(r.alg_name, r.dataset_fold_id): r.alg_hparam_id for r in L.tuned_metrics(df, ["accuracy"]).collect() if r["_has_accuracy"]}
    assert a == b


def test_zero_range_normalises_to_null_and_null_has_no_rank(spark):
    df = spark.createDataFrame([("d", "a", 0.5), ("d", "b", 0.5), ("e", "a", 0.1), ("e", "b", 0.3), ("e", "c", None)],
                               "k string, alg_name string, v double")
    n = {(r.k, r.alg_name): r.normalized_v for r in A.normalize(df, "k", "v").collect()}
    assert n[("d", "a")] is None and n[("e", "a")] == 0.0 and n[("e", "b")] == 1.0
    r = {(x.k, x.alg_name): x.rank for x in A.rank_algs(df, "k", "v", "accuracy", "rank").collect()}
    assert r[("d", "a")] == r[("d", "b")] == 1 and r[("e", "c")] is None and r[("e", "b")] == 1


def test_unknown_algorithm_fails(spark):
    df = spark.createDataFrame([("Nobody",)], "alg_name string")
    with pytest.raises(Exception, match="unknown algorithm name: Nobody"):
        A.display_name(df).collect()


def test_one_row_group_has_no_deviation(spark):
    df = spark.createDataFrame([("d", "a", 1.0)], "dataset_name string, alg_name string, v double")
    assert A.norm_std(df, "v").first().v_std is None


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([("a", 1.0, 0.1), ("a", 1.0, 0.2), ("a", None, 0.3)], "alg_name string, f__x double, accuracy__test double")
    assert A.feature_corrs(df, "accuracy").first().corr is None


def test_log_loss_at_zero_and_one(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.0), (1, 0.0)], "y int, s double")
    got = df.agg(M.log_loss_binary("y", "s").alias("v")).first().v
    assert math.isclose(got, -math.log(M.EPS) / 3, rel_tol=1e-9)


def test_auc_of_missing_class_is_null_and_ties_count_half(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 1, 0.7), ("b", 1, 0.5), ("b", 0, 0.5)], "k string, y int, s double")
    got = {r.k: r.auc for r in M.roc_auc(df, ["k"], "y", "s").collect()}
    assert got == {"a": None, "b": 0.5}
    three = spark.createDataFrame([("a", 0, [0.6, 0.2, 0.2]), ("a", 1, [0.1, 0.8, 0.1])], "k string, y int, p array<double>")
    assert M.roc_auc_ovo(three, ["k"], "y", "p", 3).first().auc_ovo is None


def test_weighted_f1_counts_missed_class_as_zero(spark):
    df = spark.createDataFrame([("a", 0, 0), ("a", 0, 0), ("a", 1, 0)], "k string, y int, p int")
    assert math.isclose(M.f1_weighted(df, ["k"], "y", "p").first().f1_weighted, 0.8 * 2 / 3)


@pytest.mark.parametrize("seed", [0, 1])
def test_concordance_index_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 15), rng.randint(0, 1), float(rng.randint(0, 6))) for _ in range(120)]
    c = t = n = 0
    for (t1, e1, r1), (t2, e2, r2) in itertools.permutations(rows, 2):
        if e1 == 1 and (t1 < t2 or (t1 == t2 and e2 == 0)):
            n, c, t = n + 1, c + (r1 > r2), t + (r1 == r2)
    got = M.concordance_index(spark.createDataFrame(rows, "t int, e int, r double"), "t", "e", "r").first()
    assert (got.comparable, got.concordant, got.tied) == (n, c, t)


@pytest.mark.parametrize("copies", [0, 40])
def test_knn_join_against_brute_force(spark, copies):
    rng = np.random.default_rng(3)
    pts = rng.integers(0, 6, size=(120, 3)).astype(float)  # many exact ties
    if copies:
        pts[:copies] = pts[0]  # a third of the rows are copies
    rows = [(i, [float(v) for v in p], i % 3) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {}
    for r in N.knn_join(df, df, 4, pivots=5, block=16, exclude_self=True).collect():
        got.setdefault(r.vec_id, []).append((r["rank"], r.neighbor))
    d = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(2))
    for i in range(len(pts)):
        want = sorted((round(d[i, j], 9), j) for j in range(len(pts)) if j != i)[:4]
        assert [j for _, j in sorted(got[i])] == [j for _, j in want]


def test_knn_with_fewer_rows_than_k(spark):
    df = spark.createDataFrame([(1, [0.0], 1), (2, [1.0], 0)], "vec_id bigint, embedding array<double>, label int")
    assert N.knn_join(df, df, 9).count() == 4


@pytest.mark.parametrize("n, points", [(1, 5), (2, 3), (7, 7), (50, 11), (11, 50)])
def test_quantile_grid_against_numpy(spark, n, points):
    rng = np.random.default_rng(n)
    xs = rng.integers(0, 20, n).astype(float)
    df = spark.createDataFrame([("f", float(x), int(c)) for x, c in zip(*np.unique(xs, return_counts=True))], "feature string, value double, w bigint")
    got = [r.value for r in sorted(O.quantile_grid(df, ["feature"], "value", ["w"], points, shrink=False).collect(), key=lambda r: r.k)]
    assert np.allclose(got, np.quantile(xs, np.linspace(0, 1, points)))
    q = {r.q: r.value for r in O.exact_quantiles(df, ["feature"], "value", ["w"], {"a": 0.25, "b": 0.5, "c": 1.0}).collect()}
    assert np.allclose([q["a"], q["b"], q["c"]], np.quantile(xs, [0.25, 0.5, 1.0]))


def test_stratified_folds_with_a_hot_class_do_not_depend_on_partitions(spark):
    df = spark.range(3000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("y"))
    a = P.stratified_kfold(df.repartition(3), "row_id", "y")
    b = P.stratified_kfold(df.repartition(11), "row_id", "y")
    assert a.exceptAll(b).isEmpty() and a.count() == 3000
    sizes = {(r.y, r.test_fold): r["count"] for r in a.groupBy("y", "test_fold").count().collect()}
    assert {sizes[("hot", f)] for f in range(10)} == {270} and {sizes[("rare", f)] for f in range(10)} == {30}
    assert A.check_disjoint(P.splits_table(a)).isEmpty()


def test_unlabelled_rows_keep_a_fold(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(40)], "row_id bigint, y string")
    assert P.stratified_kfold(df, "row_id", "y").count() == 40


def test_row_index_splits_a_hot_value(spark):
    rows = [(i, 1.0 if i % 3 else float(i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "row_id bigint, v double")
    assert O.order_buckets(df, "v", "row_id").filter("v = 1.0").select(O.BUCKET).distinct().count() > 5
    got = {r.row_id: r.row_index for r in O.row_index(df, "v", ["row_id"]).collect()}
    assert got == {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}


def test_fewer_rows_than_folds(spark):
    df = spark.createDataFrame([(i, "a") for i in range(4)], "row_id bigint, y string")
    assert sorted(r.test_fold for r in P.stratified_kfold(df, "row_id", "y").collect()) == [0, 1, 2, 3]


def test_sorted_codes(spark):
    values = [f"common_{i * 7919 % 1000:03d}" for i in range(1000)] + [None]
    df = spark.createDataFrame([(k, v) for k in ("f", "g") for v in values], "feature string, value string")
    for k in ("f", "g"):
        got = {r.value: r.code for r in O.sorted_codes(df, ["feature"], "value").filter(f"feature = '{k}'").collect()}
        assert [v for v, _ in sorted(got.items(), key=lambda kv: kv[1])] == sorted(v for v in values if v) + [None]


def test_text_buckets_spread_strings_with_one_outlier(spark):
    urls = [f"https://example.com/some/long/common/path/{i:05d}" for i in range(20_000)] + ["a"]
    df = O.text_buckets(spark.createDataFrame([(u,) for u in urls], "u string"), "u")
    sizes = [r["count"] for r in df.groupBy(O.BUCKET).count().collect()]
    assert len(sizes) > 10 and max(sizes) < 12_000 and sum(sizes) == 20_001
    ends = df.groupBy(O.BUCKET).agg(F.min("u").alias("lo"), F.max("u").alias("hi")).orderBy(O.BUCKET).collect()
    assert all(a.hi < b.lo for a, b in zip(ends, ends[1:]))


def test_nested_results_keep_every_fold(spark):
    from gradus.sources.results import nest_results

    rows = [("d", "binary", "A", "default", 0, f, f / 10) for f in range(12)]
    df = spark.createDataFrame(rows, "dataset_name string, target_type string, alg_name string, hparam_source string, trial_number int, fold int, Accuracy__test double")
    got = nest_results(df).first()["scorers"]["test"]["Accuracy"]
    assert list(got) == [f / 10 for f in range(12)]


def fold_frame(spark, rows):
    return spark.createDataFrame(rows, "row_id bigint, test_fold int, x double, z double, k string")


def test_column_without_training_values_becomes_zero(spark):
    # z is present only in test folds 0 and 1, so fold 0 trains on none of it
    df = fold_frame(spark, [(i, i % 10, float(i), 5.0 if i % 10 < 2 else None, "a") for i in range(40)])
    out = P.impute_mean(df, ["x", "z"]).filter("fold = 0")
    assert {r.z for r in out.select("z").distinct().collect()} == {0.0}
    other = P.impute_mean(df, ["x", "z"]).filter("fold = 5")
    assert {r.z for r in other.select("z").distinct().collect()} == {5.0}


def test_unknown_category_is_all_zero(spark):
    df = fold_frame(spark, [(i, i % 10, 0.0, 0.0, "only" if i == 3 else ("a", "b")[i % 2]) for i in range(40)])
    out = P.one_hot(df, ["k"])
    assert out.filter("fold = 3 AND row_id = 3").first().k_onehot == [0, 0, 0]
    assert out.filter("fold = 6 AND row_id = 3").first().k_onehot == [0, 0, 1]


def test_sparse_one_hot_of_many_categories(spark):
    # 50,000 categories, half of the rows in one of them; each other one stands in a single test fold
    n = 50_000
    df = spark.range(2 * n).select(F.col("id").alias("row_id"), (F.col("id") % 10).cast("int").alias("test_fold"),
                                   F.when(F.col("id") < n, F.lit("hot")).when(F.col("id") == n, None).otherwise(F.format_string("c%06d", F.col("id") - n)).alias("k"))
    for limit in (100_000, 10):
        out = P.one_hot_sparse(df, ["k"], broadcast_rows=limit).filter("row_id IN (5, 50000, 50003, 99999)").collect()
        assert len(out) == 40 and all(r.k_onehot.size == n for r in out)
        for r in out:
            unseen = r.k is None or r.k != "hot" and r.test_fold in (r.fold, (r.fold + 1) % 10)
            want = [] if unseen else [n - 1 if r.k == "hot" else int(r.k[1:]) - 1]
            assert list(r.k_onehot.indices) == want, (r.row_id, r.fold)


def test_sparse_one_hot_edges(spark):
    df = fold_frame(spark, [(i, i % 10, 0.0, 0.0, "only" if i == 3 else ("a", "b", None)[i % 3]) for i in range(40)])
    dense = {(r.row_id, r.fold): r.k_onehot for r in P.one_hot(df, ["k"]).collect()}
    sparse = P.one_hot_sparse(df, ["k"])
    assert {(r.row_id, r.fold): [int(v) for v in r.k_onehot.toArray()] for r in sparse.collect()} == dense
    assert P.one_hot_sparse(df.limit(0), ["k"]).count() == 0
    empty = P.one_hot_sparse(df.withColumn("k", F.lit(None).cast("string")), ["k"]).first().k_onehot
    assert empty.size == 1 and empty.numNonzeros() == 0


def test_stumps_of_many_classes(spark):
    # 2,000 classes whose order follows x: the best split of x halves them, z tells nothing
    rows = [(i, i % 10, float(i // 30), 1.0, f"c{i // 30:04d}") for i in range(60_000)]
    df = spark.createDataFrame(rows, "row_id bigint, test_fold int, x double, z double, y string")
    got = {(r.fold, r.feature): r for r in K.stumps(K.Input(df, ["x", "z"], [], "y")).collect()}
    assert len(got) == 20
    for fold in range(10):
        x, z = got[fold, "x"], got[fold, "z"]
        assert x.threshold == 999.0 and abs(x.gain - 1.0) < 1e-8 and (x.left, x.right) == ("c0000", "c1000")
        assert z.gain == 0 and z.threshold == 1.0 and z.left == z.right == "c0000"


def test_stumps_match_brute_force(spark):
    rng = np.random.default_rng(5)
    x, z, y = rng.integers(0, 40, 600), rng.normal(size=600).round(1), rng.integers(0, 7, 600)
    y = np.where(x > 25, y % 3, y)
    rows = [(i, i % 10, float(x[i]) if i % 11 else None, float(z[i]), None if i % 50 == 7 else f"c{y[i]}") for i in range(600)]
    df = spark.createDataFrame(rows, "row_id bigint, test_fold int, x double, z double, y string")
    got = {(r.fold, r.feature): r for r in K.stumps(K.Input(df, ["x", "z"], [], "y")).collect()}

    def entropy(labels):
        n = np.unique(labels, return_counts=True)[1]
        return -(n / n.sum() * np.log2(n / n.sum())).sum() if len(labels) else 0.0

    for fold in range(10):
        train = [r for r in rows if r[1] not in (fold, (fold + 1) % 10)]
        for name, k in (("x", 2), ("z", 3)):
            mean = np.mean([r[k] for r in train if r[k] is not None])
            v = np.array([mean if r[k] is None else r[k] for r in train if r[4] is not None])
            lab = np.array([r[4] for r in train if r[4] is not None])
            gains = {t: entropy(lab) - np.mean(v <= t) * entropy(lab[v <= t]) - np.mean(v > t) * entropy(lab[v > t]) for t in np.unique(v)}
            g = got[fold, name]
            best = max(gains.values())
            assert abs(g.gain - best) < 1e-8 and abs(gains[min(gains, key=lambda t: abs(t - g.threshold))] - best) < 1e-8
            sides = [lab[v <= g.threshold + 1e-9], lab[v > g.threshold + 1e-9]]
            assert [g.left, g.right] == [max(sorted(set(s)), key=list(s).count) for s in sides]


def test_nearest_information(spark):
    def psi(n):
        return -0.5772156649015329 + sum(1 / j for j in range(1, n))

    rng = np.random.default_rng(11)
    y = rng.integers(0, 3, 500)
    x, z = np.round(y * 2 + rng.normal(size=500), 2), rng.integers(0, 4, 500).astype(float)
    rows = [(float(a) if i % 17 else None, float(b), 7.0, None if i % 40 == 1 else f"c{c}") for i, (a, b, c) in enumerate(zip(x, z, y))]
    rows.append((1.5, 2.0, 7.0, "alone"))
    rows += [(0.5, 9.0, 7.0, "pair"), (0.75, 8.0, 7.0, "pair")]
    df = spark.createDataFrame(rows, "x double, z double, one double, y string")
    # ranges of five rows, so that most neighbours are borrowed, and one range for all
    small, large = [{r.feature: r.mut_inf for r in nearest_information(df, ["x", "z", "one"], "y", rows=n).collect()} for n in (5, 10_000)]
    for k, name in enumerate(("x", "z", "one")):
        mean = np.mean([r[k] for r in rows if r[k] is not None])
        labels = [r[3] for r in rows]
        use = [(mean if r[k] is None else r[k], r[3]) for r in rows if r[3] is not None and labels.count(r[3]) > 1]
        v, lab = np.array([p[0] for p in use]), np.array([p[1] for p in use])
        total = psi(len(v))
        for a, c in zip(v, lab):
            n = int((lab == c).sum())
            kk = min(3, n - 1)
            r = np.sort(np.abs(v[lab == c] - a))[kk] * (1 - 1e-12)
            total += (psi(kk) - psi(n) - psi(int(((v >= a - r) & (v <= a + r)).sum()))) / len(v)
        want = max(0.0, total / math.log(2))
        assert abs(small[name] - want) < 1e-8 and abs(large[name] - want) < 1e-8
    assert small["x"] > 0.5 > small["z"]
    assert nearest_information(df.limit(0), ["x"], "y").count() == 0
    assert nearest_information(df.withColumn("y", F.lit(None).cast("string")), ["x"], "y").count() == 0


def test_hash_cut_is_the_rank_in_hash_order(spark):
    df = spark.range(3000).withColumnRenamed("id", "row_id").withColumn("v", F.lit(1))
    order = sorted(range(3000), key=lambda i: hashlib.md5(f"{i}:4".encode()).hexdigest())
    for few in (1, 50, 10_000):
        for n in (1, 2, 1499, 2999, 3000):
            cut = O.hash_cut(df, "row_id", n, 4, few=few)
            assert cut == hashlib.md5(f"{order[n - 1]}:4".encode()).hexdigest()
    assert O.hash_cut(df, "row_id", 3001, 4) is None
    assert {r.row_id for r in P.subset_rows(df, "row_id", 700, "random", 4).collect()} == set(order[:700])
    assert [P.subset_rows(df, "row_id", n, "random", 4).count() for n in (-1, 0, 5000)] == [3000, 0, 3000]
    plan = P.subset_rows(df, "row_id", 700, "random", 4)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    parts = {r.part: r.n for r in P.size_split(df, "row_id", 1000, 4000, 4).groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert parts == {"train": 1000, "val": 2000}


def test_tail_split_with_ties(spark):
    df = spark.range(5000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 5).alias("v"))
    got = P.tail_split(df, "v", 900, ["row_id"]).filter("part = 'test'").collect()
    want = sorted(((7 if i % 3 > 0 else i % 5), i) for i in range(5000))[-900:]
    assert sorted(r.row_id for r in got) == sorted(i for _, i in want)


def test_featurise_has_every_group(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 10, float(abs(rng.normal()) + 1 + i % 3), float(rng.normal()), "ab"[i % 2], "xyz"[int(rng.integers(3))], f"c{i % 3}") for i in range(240)]
    x = K.Input(spark.createDataFrame(rows, "row_id bigint, test_fold int, x double, z double, k string, m string, y string"), ["x", "z"], ["k", "m"], "y")
    got = K.featurise(x).collect()
    value = {(r.fold, r.grp, r.feature, r.summary): r.value for r in got}
    assert len(value) == len(got)
    scalars = {"nr_inst", "nr_attr", "nr_num", "nr_cat", "nr_bin", "nr_class", "attr_to_inst", "inst_to_attr", "cat_to_num", "num_to_cat", "class_ent",
               "nr_outliers", "gravity", "nr_norm", "nr_cor_attr", *K.SCATTER, "naive_bayes", "best_node", "random_node", "worst_node", "linear_discr",
               "eq_num_attr", "ns_ratio"}
    assert {r.feature for r in got if r.summary is None} == scalars
    vectors = {"freq_class", "mean", "sd", "var", "min", "max", "range", "median", "mad", "iq_range", "skewness", "kurtosis", "g_mean", "h_mean", "t_mean",
               "sparsity", "eigenvalues", "cor", "cov", "attr_ent", "joint_ent", "mut_inf", "class_conc", "attr_conc"}
    assert vectors <= {r.feature for r in got if r.summary is not None}
    assert {r.feature for r in got if r.grp == "relative"} == {"naive_bayes", "best_node", "random_node", "worst_node", "linear_discr"}
    for fold, name in itertools.product(range(10), ("gravity", "nr_norm", "nr_outliers")):
        assert (fold, "statistical", name, None) in value
    for r in K.mf_linear_discr(x).collect():
        assert math.isclose(value[r.fold, "landmarking", "linear_discr", None], r.linear_discr)
    conc = {}
    for r in K.mf_attr_conc(x).collect():
        conc.setdefault(r.fold, []).append(r.attr_conc)
    assert all(math.isclose(value[f, "info-theory", "attr_conc", "mean"], np.mean(v), abs_tol=1e-12) for f, v in conc.items())
    only = K.Input(x.df, [], ["k", "m"], "y")
    assert {r.grp for r in K.featurise(only).collect()} == {"general", "info-theory"}


def test_fold_moments_of_large_offset_keep_their_digits(spark):
    df = fold_frame(spark, [(i, i % 10, 1e9 + (i % 7), 0.0, "a") for i in range(700)])
    train = [1e9 + (i % 7) for i in range(700) if i % 10 not in (0, 1)]
    got = fold_moments(df, ["x"]).filter("fold = 0").first()
    assert math.isclose(got.m2 / got.n, np.var(np.array(train) - 1e9), rel_tol=1e-7)


def test_encoding_twice_is_an_error(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "row_id bigint, k string")
    out, dims = P.encode_categoricals(df, ["k"])
    assert dims == {"k": 2} and {r.k for r in out.collect()} == {0, 1}
    with pytest.raises(ValueError, match="encoded already"):
        P.encode_categoricals(out, ["k"])


def test_target_checks(spark):
    one = spark.createDataFrame([("a",), ("a",)], "y string")
    with pytest.raises(ValueError, match="only 1 distinct"):
        P.infer_target(one, "y")
    two = spark.createDataFrame([("a",), ("b",)], "y string")
    assert P.infer_target(two, "y") == ("binary", 1)
    with pytest.raises(ValueError, match="declared 3"):
        P.infer_target(two, "y", 3)
    bad = spark.createDataFrame([(float("nan"),), (1.0,)], "y double")
    with pytest.raises(Exception, match="NaN or infinite"):
        P.type_of_target(bad, "y").collect()


def test_validate_dataset_rejects_bad_metadata(spark):
    df = spark.createDataFrame([(1, 0.0, "a")], "row_id bigint, x double, y string")
    meta = {"target": "y", "target_type": "binary", "num_classes": 1, "num_features": 1, "num_instances": 1, "cat_idx": []}
    assert P.validate_dataset(meta, df) == meta
    for change in ({"num_classes": 2}, {"num_features": 2}, {"cat_idx": [1]}, {"target_type": "ranking"}, {"num_instances": 9}):
        with pytest.raises(ValueError):
            P.validate_dataset({**meta, **change}, df)


def test_early_stopping(spark):
    losses = [5, 4, 4, 4, 3, 9, 9, 9, 1]
    curve = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(losses)], "run_id string, epoch int, val_loss double")
    got = A.early_stop(curve, 2, 100).first()
    assert (got.best_epoch, got.last_epoch, got.best_val_loss, got.stopped_early) == (4, 7, 3.0, True)
    assert A.early_stop(curve, 2, 4).first().last_epoch == 3
    tol = A.early_stop_tol(curve, 3, 1.5, False, 100).first()
    assert (tol.best_epoch, tol.stopped_epoch, tol.stopped) == (0, 3, True)


def test_scalar_helpers(spark):
    df = spark.createDataFrame([([0.2, 0.5, 0.5], 13)], "a array<double>, n int")
    r = df.select(S.argmax("a").alias("i"), S.bit_width("n").alias("w"), S.bit("n", 1).alias("b"),
                  S.expand_proba("a", [0, 2, 3], 5).alias("e"), S.softmax("a").alias("s")).first()
    assert (r.i, r.w, r.b, r.e) == (1, 4, 0, [0.2, 0.0, 0.5, 0.5, 0.0]) and math.isclose(sum(r.s), 1.0)


def test_registries():
    from gradus.operators import models as ML

    with pytest.raises(KeyError):
        M.get_metric("nothing")
    with pytest.raises(ValueError):
        M.register("mse")(M.mse)
    with pytest.raises(KeyError):
        ML.get_model("nothing")
    with pytest.raises(NotImplementedError):
        M.get_scorer("ranking")


def test_work_dir_uses_the_cluster_folder(spark, monkeypatch):
    from gradus import session

    monkeypatch.setattr(session, "conf_value", lambda s, k: "hdfs://shared" if k == "spark.checkpoint.dir" else None)
    assert session.work_dir(spark, "x").startswith("hdfs://shared/gradus/x-")
