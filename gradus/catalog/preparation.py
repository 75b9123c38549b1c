"""Queries over labelled tables: folds, encoding, imputing, scaling, checks."""
from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gradus.catalog.registry import query
from gradus.operators import prep as P
from gradus.operators import analysis as A
from gradus.plans.folds import assign_parts

NUM = ["x0", "x1", "x2", "x3", "x4"]
CAT = ["k0", "k1", "k2"]
FOLDS_T = "(SELECT unnest(range(10)) AS fold) AS t"
PART = "CASE WHEN test_fold = t.fold THEN 'test' WHEN test_fold = (t.fold + 1) % 10 THEN 'val' ELSE 'train' END"
PARTS_SQL = f"SELECT f.*, CAST(t.fold AS INT) AS fold, {PART} AS part FROM v_folds AS f, {FOLDS_T}"


def order_of(seed) -> str:
    return f"md5(concat(row_id, ':{seed}')), row_id"


@query("i01_kfold", f"SELECT row_id, CAST((row_number() OVER (ORDER BY {order_of(0)}) - 1) % 10 AS INT) AS test_fold FROM v_features")
def _(t):
    return P.kfold(t.features.select("row_id"), "row_id")


@query("i02_stratified_kfold", "SELECT row_id, y_multi, test_fold FROM v_folds")
def _(t):
    return P.stratified_kfold(t.features.select("row_id", "y_multi"), "row_id", "y_multi")


@query("i03_assign_parts", f"SELECT row_id, fold, part FROM ({PARTS_SQL}) AS p")
def _(t):
    return P.splits_table(t.folds).select("row_id", "fold", "part")


@query("c12_fold_part", "SELECT row_id, x1 FROM v_folds WHERE test_fold = 4")
def _(t):
    return P.fold_part(t.folds, 3, "val").select("row_id", "x1")


@query("c12_fold_part_join", "SELECT row_id, x1, k1 FROM v_folds WHERE test_fold NOT IN (0, 9)")
def _(t):
    return P.fold_part_join(t.features.select("row_id", "x1", "k1"), P.splits_table(t.folds), 9, "train")


@query("h04_train_minus_val", "SELECT row_id FROM v_folds WHERE test_fold NOT IN (0, 1)")
def _(t):
    d = t.folds.select("row_id", "test_fold")
    return P.train_minus_val(d.filter("test_fold <> 0"), d.filter("test_fold = 1")).select("row_id")


@query("h05_check_disjoint", "SELECT 'parts' AS \"check\", CAST(0 AS INT) AS fold, row_id, count(*) AS n FROM v_folds WHERE false GROUP BY row_id")
def _(t):
    return A.check_disjoint(P.splits_table(t.folds))


@query("h05_check_disjoint_violations", """SELECT 'test folds' AS "check", -1 AS fold, l_orderkey AS row_id, count(*) AS n FROM (
 SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) AS a GROUP BY l_orderkey HAVING count(*) > 1""")
def _(t):
    splits = t.table("lineitem").select(
        F.col("l_linenumber").alias("fold"), F.lit("test").alias("part"), F.col("l_orderkey").alias("row_id")).distinct()
    return A.check_disjoint(splits)


@query("h09_unknown_labels", """SELECT DISTINCT l_suppkey AS label FROM lineitem WHERE l_linenumber <= 3
 AND l_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity < 2 AND l_linenumber > 3)""")
def _(t):
    li = t.table("lineitem").withColumnRenamed("l_suppkey", "label")
    return A.unknown_labels(li.filter("l_quantity < 2 AND l_linenumber > 3"), li.filter("l_linenumber <= 3"), "label")


@query("i04_encode_target", "SELECT row_id, CAST(dense_rank() OVER (ORDER BY y_multi) - 1 AS INT) AS y_multi FROM v_features")
def _(t):
    return P.encode_target(t.features.select("row_id", "y_multi"), "y_multi", 3)


@query("i05_encode_categoricals", "SELECT row_id, " + ", ".join(
    f"CAST(dense_rank() OVER (ORDER BY {c} NULLS LAST) - 1 AS INT) AS {c}" for c in CAT) + " FROM v_features")
def _(t):
    return P.encode_categoricals(t.features.select("row_id", *CAT), CAT)[0]


@query("i05_cat_dims", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) AS dim FROM (SELECT DISTINCT {c} FROM v_features) AS a" for c in CAT))
def _(t):
    return P.category_codes(t.features, CAT).groupBy("feature").agg(F.count("*").alias("dim"))


@query("i06_infer_target", " UNION ALL ".join(
    f"""SELECT '{c}' AS target, count(DISTINCT {c}) AS n_labels, CASE WHEN count(DISTINCT {c}) = 2 THEN 'binary' WHEN count(DISTINCT {c}) > 2
 THEN 'classification' ELSE 'invalid' END AS target_type, CAST(CASE WHEN count(DISTINCT {c}) = 2 THEN 1 ELSE count(DISTINCT {c}) END AS INT) AS num_classes FROM v_features"""
    for c in ("y_multi", "y_bin", "k1")))
def _(t):
    return P.target_summary(t.features, ["y_multi", "y_bin", "k1"])


@query("i07_inspect_dataset", """SELECT 'features' AS dataset_name, 'x0' AS feature, count(*) - count(x0) AS n, 'missing cells' AS failure FROM v_features
 UNION ALL SELECT 'features', 'k0', count(*) - count(k0), 'missing cells' FROM v_features
 UNION ALL SELECT 'features', 'x3', count(*), 'missing cells' FROM v_features
 UNION ALL SELECT 'features', 'x3', count(*), 'fully null column' FROM v_features""")
def _(t):
    return P.inspect_dataset(t.features, "y_multi", CAT, NUM, accept_nulls=False, name="features")


@query("i08_inspect_suite", """SELECT * FROM (VALUES ('features', CAST(1 AS BIGINT), false), ('preds', CAST(0 AS BIGINT), true)) AS v(dataset_name, n_failures, passed)
 WHERE (SELECT count(x3) FROM v_features) = 0""")
def _(t):
    a = P.inspect_dataset(t.features, "y_multi", CAT, NUM, name="features")
    b = P.inspect_dataset(t.preds, "y_true", [], ["score", "w0"], name="preds")
    both = t.features.select(F.lit("features").alias("dataset_name")).distinct().unionByName(
        t.preds.select(F.lit("preds").alias("dataset_name")).distinct())
    return P.inspect_suite([a, b], both)


@query("i09_validate_dataset", "SELECT 'classification' AS target_type, CAST(3 AS INT) AS num_classes, count(*) AS num_instances FROM v_features")
def _(t):
    d = t.features.drop("y_bin", "y_reg")
    meta = {"target": "y_multi", "target_type": "classification", "num_classes": 3, "num_features": 8,
            "num_instances": d.count(), "cat_idx": [5, 6, 7]}
    P.validate_dataset(meta, d)
    return d.agg(F.count("*").alias("num_instances")).select(
        F.lit("classification").alias("target_type"), F.lit(3).alias("num_classes"), "num_instances")


IMPUTED = "WITH p AS (" + PARTS_SQL + "), m AS (SELECT fold, " + ", ".join(
    f"avg({c}) AS m_{c}" for c in NUM) + " FROM p WHERE part = 'train' GROUP BY fold), q AS (SELECT p.* REPLACE (" + ", ".join(
    f"coalesce({c}, m_{c}, 0e0) AS {c}" for c in NUM) + ") FROM p JOIN m ON p.fold = m.fold) "


@query("i10_impute_mean", IMPUTED + "SELECT row_id, fold, part, " + ", ".join(NUM) + " FROM q", r=" ".join(NUM))
def _(t):
    return P.impute_mean(t.folds.select("row_id", "test_fold", *NUM), NUM).drop("test_fold")


@query("i11_null_column_to_zero", IMPUTED + "SELECT fold, count(*) AS n, max(abs(x3)) AS max_abs FROM q GROUP BY fold")
def _(t):
    out = P.impute_mean(t.folds.select("row_id", "test_fold", "x3"), ["x3"])
    return out.groupBy("fold").agg(F.count("*").alias("n"), F.max(F.abs("x3")).alias("max_abs"))


@query("i12_column_order", "SELECT 'row_id,x0,x1,x2,x3,x4,k0,k1,k2,y_multi,y_bin,y_reg,test_fold,fold,part' AS cols, count(*) * 10 AS n FROM v_features")
def _(t):
    out = P.impute_mean(t.folds, NUM)
    return out.agg(F.count("*").alias("n")).select(F.lit(",".join(out.columns)).alias("cols"), "n")


def scale_sql(source: str, cols, m: int) -> str:
    """Average of the left and right interpolation of each value in its fold's references, at most one per row."""
    at = "(k * (n - 1)) // (m - 1)"
    # positions in integers: a product of doubles can miss a whole position by its last digit
    refs = " UNION ALL ".join(
        f"SELECT fold, '{c}' AS feature, k, m, s[{at} + 1] + (s[least({at} + 2, n)] - s[{at} + 1]) * ((k * (n - 1)) % (m - 1)) / ((m - 1) * 1e0) AS q "
        f"FROM (SELECT *, unnest(range(m)) AS k FROM (SELECT fold, list({c} ORDER BY {c}) FILTER (WHERE {c} IS NOT NULL) AS s, count({c}) AS n, least({m}, count({c})) AS m "
        f"FROM {source} WHERE part = 'train' GROUP BY fold) AS y) AS z" for c in cols)
    values = " UNION ALL ".join(f"SELECT DISTINCT fold, '{c}' AS feature, {c} AS v FROM {source} WHERE {c} IS NOT NULL" for c in cols)
    place = """SELECT x.*, r.m, CASE WHEN x.v <= r.lo THEN 0e0 WHEN x.v >= r.hi THEN 1e0 END AS edge, lower_.k AS j, upper_.k AS i
 FROM vals AS x JOIN (SELECT fold, feature, m, min(q) AS lo, max(q) AS hi FROM refs GROUP BY ALL) AS r ON r.fold = x.fold AND r.feature = x.feature
 ASOF LEFT JOIN (SELECT fold, feature, q, max(k) AS k FROM refs GROUP BY ALL) AS lower_ ON lower_.fold = x.fold AND lower_.feature = x.feature AND x.v >= lower_.q
 ASOF LEFT JOIN (SELECT fold, feature, q, min(k) AS k FROM refs GROUP BY ALL) AS upper_ ON upper_.fold = x.fold AND upper_.feature = x.feature AND x.v <= upper_.q"""
    scaled = """SELECT p.fold, p.feature, p.v, CASE WHEN p.edge IS NOT NULL THEN p.edge ELSE
 (p.j + CASE WHEN b.q > a.q THEN (p.v - a.q) / (b.q - a.q) ELSE 0 END + p.i - CASE WHEN e.q > h.q THEN (e.q - p.v) / (e.q - h.q) ELSE 0 END) / 2e0 / (p.m - 1) END AS s
 FROM place AS p LEFT JOIN refs AS a ON a.fold = p.fold AND a.feature = p.feature AND a.k = p.j
 LEFT JOIN refs AS b ON b.fold = p.fold AND b.feature = p.feature AND b.k = p.j + 1
 LEFT JOIN refs AS e ON e.fold = p.fold AND e.feature = p.feature AND e.k = p.i
 LEFT JOIN refs AS h ON h.fold = p.fold AND h.feature = p.feature AND h.k = p.i - 1"""
    joins = " ".join(f"LEFT JOIN scaled AS s_{c} ON s_{c}.fold = x.fold AND s_{c}.feature = '{c}' AND s_{c}.v = x.{c}" for c in cols)
    return (f"refs AS MATERIALIZED ({refs}), vals AS ({values}), place AS MATERIALIZED ({place}), scaled AS MATERIALIZED ({scaled}), out AS (SELECT x.* REPLACE ("
            + ", ".join(f"s_{c}.s AS {c}" for c in cols) + f") FROM {source} AS x {joins})")


@query("i13_quantile_scale", "WITH p AS (" + PARTS_SQL + "), " + scale_sql("p", ["x0", "x1", "x2", "x4"], 1000)
       + " SELECT row_id, fold, part, x0, x1, x2, x4 FROM out", r="x0 x1 x2 x4")
def _(t):
    cols = ["x0", "x1", "x2", "x4"]
    return P.quantile_scale(t.folds.select("row_id", "test_fold", *cols), cols).drop("test_fold")


@query("i14_quantile_scale_normal")
def _(t):
    d = t.folds.select("row_id", "test_fold", "x0", "x1")
    return P.quantile_scale(d, ["x0", "x1"], 1000, output="normal", noise=0.001, seed=3)


def onehot_sql(c: str) -> str:
    return f"""(SELECT string_agg(CASE WHEN d.v = p.{c} AND d.seen THEN '1' ELSE '0' END, '' ORDER BY d.v) FROM dom_{c} AS d WHERE d.fold = p.fold)"""


DOMS = ", ".join(f"""dom_{c} AS (SELECT t.fold, d.v, EXISTS (SELECT 1 FROM v_folds AS f WHERE f.{c} = d.v AND f.test_fold <> t.fold
 AND f.test_fold <> (t.fold + 1) % 10) AS seen FROM (SELECT DISTINCT {c} AS v FROM v_features WHERE {c} IS NOT NULL) AS d, {FOLDS_T})""" for c in CAT)


@query("i15_one_hot", f"WITH p AS ({PARTS_SQL}), {DOMS}, "
       + ", ".join(f"h_{c} AS (SELECT p.fold, p.{c} AS v, {onehot_sql(c)} AS h FROM (SELECT DISTINCT fold, {c} FROM p) AS p)" for c in CAT)
       + " SELECT p.row_id, p.fold, " + ", ".join(f"h_{c}.h AS {c}" for c in CAT) + " FROM p "
       + " ".join(f"JOIN h_{c} ON h_{c}.fold = p.fold AND h_{c}.v IS NOT DISTINCT FROM p.{c}" for c in CAT))
def _(t):
    out = P.one_hot(t.folds.select("row_id", "test_fold", *CAT), CAT)
    return out.select("row_id", "fold", *[F.array_join(f"{c}_onehot", "").alias(c) for c in CAT])


@query("i15_one_hot_sparse", f"WITH p AS ({PARTS_SQL}), {DOMS}, "
       + ", ".join(f"h_{c} AS (SELECT p.fold, p.{c} AS v, {onehot_sql(c)} AS h FROM (SELECT DISTINCT fold, {c} FROM p) AS p)" for c in CAT)
       + " SELECT p.row_id, p.fold, " + ", ".join(f"CAST(instr(h_{c}.h, '1') - 1 AS INT) AS {c}, CAST(length(h_{c}.h) AS INT) AS {c}_size" for c in CAT) + " FROM p "
       + " ".join(f"JOIN h_{c} ON h_{c}.fold = p.fold AND h_{c}.v IS NOT DISTINCT FROM p.{c}" for c in CAT))
def _(t):
    out = P.one_hot_sparse(t.folds.select("row_id", "test_fold", *CAT), CAT)
    cells = {c: vector_to_array(f"{c}_onehot") for c in CAT}
    return out.select("row_id", "fold", *[e for c, a in cells.items() for e in (
        (F.array_position(a, 1.0) - 1).cast("int").alias(c), F.size(a).alias(f"{c}_size"))])


@query("i16_subset_rows", f"SELECT row_id, x1 FROM v_features ORDER BY {order_of(5)} LIMIT 1000")
def _(t):
    return P.subset_rows(t.features.select("row_id", "x1"), "row_id", 1000, "random", 5)


@query("g04_first_rows", "SELECT row_id, x0, x1 FROM v_features ORDER BY row_id LIMIT 1000")
def _(t):
    return P.subset_rows(t.features.select("row_id", *P.first_features(NUM, 2)), "row_id", 1000, "first")


@query("i17_subset_features", "SELECT row_id, {} FROM v_features".format(", ".join(P.random_features(NUM + CAT, 4, 1))))
def _(t):
    return t.features.select("row_id", *P.subset_features(t.features, NUM + CAT, 4, "random", 1))


@query("i18_make_subset", f"""SELECT row_id, part, {', '.join(P.random_features(NUM, 2, 0))} FROM (SELECT *, row_number() OVER (
 PARTITION BY part ORDER BY {order_of(0)}) AS rn FROM ({PARTS_SQL}) AS p WHERE fold = 2) AS q WHERE rn <= 500""")
def _(t):
    d = assign_parts(t.folds).filter("fold = 2").select("row_id", "part", *NUM)
    return P.make_subset(d, "row_id", 500, 2, NUM)


def edges_sql(c: str, bins: int) -> str:
    qs = ", ".join(f"{i}e0/{bins}" for i in range(bins + 1))
    return f"SELECT DISTINCT unnest(quantile_cont({c}, [{qs}])) AS e FROM v_features"


@query("i19_qcut", f"""WITH e AS ({edges_sql('x0', 32)}), b AS (SELECT v, coalesce(greatest((SELECT count(*) FROM e WHERE e.e < v) - 1, 0), 0) AS bin FROM
 (SELECT DISTINCT x0 AS v FROM v_features) AS a)
 SELECT row_id, CAST(coalesce(b.bin, 0) AS INT) AS bin FROM v_features LEFT JOIN b ON x0 = b.v""")
def _(t):
    return P.qcut(t.features.select("row_id", "x0"), "x0", 32).select("row_id", "bin")


@query("i19_qcut_ties", f"""WITH e AS ({edges_sql('x2', 200)})
 SELECT row_id, CAST(greatest((SELECT count(*) FROM e WHERE e.e < x2) - 1, 0) AS INT) AS bin FROM v_features""")
def _(t):
    return P.qcut(t.features.select("row_id", "x2"), "x2", 200).select("row_id", "bin")


def stats_sql(cols, fn: str) -> str:
    return "m AS (SELECT fold, " + ", ".join(f"avg({c}) AS m_{c}, {fn}({c}) AS s_{c}" for c in cols) + " FROM p WHERE part = 'train' GROUP BY fold)"


STD = ["x0", "x1", "x4"]
SCALED = {
    "plain": ("stddev_pop", "({c} - m_{c}) / nullif(s_{c}, 0)"), "eps": ("stddev_pop", "({c} - m_{c}) / (s_{c} + 1e-5)"),
    "centre": ("stddev_pop", "CASE WHEN s_{c} = 0 THEN {c} - m_{c} ELSE ({c} - m_{c}) / nullif(s_{c}, 0) END"),
    "sample": ("stddev_samp", "CASE WHEN s_{c} = 0 THEN {c} - m_{c} ELSE ({c} - m_{c}) / nullif(s_{c}, 0) END"),
}
for _v, (_fn, _e) in SCALED.items():
    @query(f"i20_standardize_{_v}", f"WITH p AS ({PARTS_SQL}), {stats_sql(STD, _fn)} SELECT row_id, p.fold, "
           + ", ".join(f"{_e.format(c=c)} AS {c}" for c in STD) + " FROM p JOIN m ON p.fold = m.fold", r=" ".join(STD))
    def _(t, v=_v):
        return P.standardize(t.folds.select("row_id", "test_fold", *STD), STD, v).select("row_id", "fold", *STD)


@query("i20_standardize_given", "SELECT row_id, (x1 - 1e2) / 3e0 AS x1, (x2 - 5e1) / 2e1 AS x2 FROM v_features", r="x1 x2")
def _(t):
    return P.standardize_with(t.features.select("row_id", "x1", "x2"), {"x1": 100.0, "x2": 50.0}, {"x1": 3.0, "x2": 20.0})


@query("i21_binary_encode", "SELECT row_id, code, " + ", ".join(f"CAST((code >> {i}) & 1 AS INT) AS code_bit{i}" for i in range(5))
       + " FROM (SELECT row_id, CAST(k2 AS INT) AS code FROM v_features) AS a")
def _(t):
    return P.binary_encode(t.features.select("row_id", F.col("k2").cast("int").alias("code")), "code")


@query("i22_refit_means", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, sum({c}) / 1e3 AS \"sum\", count({c}) AS \"count\", avg({c}) AS mean FROM v_features" for c in ("x0", "x1", "x2")), r="sum mean")
def _(t):
    d, cols = t.folds, ["x0", "x1", "x2"]
    out = P.refit_means(P.mean_state(d.filter("test_fold < 4"), cols), P.mean_state(d.filter("test_fold >= 4"), cols))
    return out.withColumn("sum", F.col("sum") / 1000)


@query("i23_tail_split", """SELECT row_id, CASE WHEN row_number() OVER (ORDER BY row_id DESC) <= 700 THEN 'test' ELSE 'train' END AS part FROM v_features""")
def _(t):
    return P.tail_split(t.features.select("row_id"), "row_id", 700)


@query("i24_size_split", f"""SELECT row_id, CASE WHEN i < 3000 THEN 'train' ELSE 'val' END AS part FROM (
 SELECT row_id, row_number() OVER (ORDER BY {order_of(2)}) - 1 AS i FROM v_features) AS a WHERE i < 4000""")
def _(t):
    return P.size_split(t.features.select("row_id"), "row_id", 3000, 1000, 2)


@query("i25_frac_split", f"""SELECT row_id, CASE WHEN i < round(9e-1 * n) THEN 'sample' ELSE 'rest' END AS part FROM (
 SELECT row_id, row_number() OVER (ORDER BY {order_of(4)}) - 1 AS i, count(*) OVER () AS n FROM v_features) AS a""")
def _(t):
    return P.frac_split(t.features.select("row_id"), "row_id", 0.9, 4)


@query("i26_stratified_holdout", f"""SELECT row_id, y_multi, CASE WHEN i < round(2e-1 * n) THEN 'val' ELSE 'train' END AS part FROM (
 SELECT row_id, y_multi, row_number() OVER (PARTITION BY y_multi ORDER BY {order_of(6)}) - 1 AS i, count(*) OVER (PARTITION BY y_multi) AS n FROM v_features) AS a""")
def _(t):
    return P.stratified_holdout(t.features.select("row_id", "y_multi"), "row_id", "y_multi", 0.2, 6)


@query("i27_splits_from_indicators", """SELECT 'd1' AS split, row_id FROM v_features WHERE row_id % 3 = 0
 UNION ALL SELECT 'd2', row_id FROM v_features WHERE row_id % 5 = 1""")
def _(t):
    d = t.features.select("row_id", (F.col("row_id") % 3 == 0).cast("int").alias("d1"), (F.col("row_id") % 5 == 1).cast("int").alias("d2"))
    return P.splits_from_indicators(d, "row_id", ["d1", "d2"])


@query("i28_order_by_part", f"SELECT row_id, fold, part, CASE part WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END AS part_code FROM ({PARTS_SQL}) AS p")
def _(t):
    return P.order_by_part(assign_parts(t.folds).select("row_id", "fold", "part"), keys=["fold"])


@query("i29_type_of_target", """SELECT 'y_reg' AS target, 'continuous' AS kind, count(DISTINCT y_reg) AS n_values FROM v_features
 UNION ALL SELECT 'y_bin', 'binary', count(DISTINCT y_bin) FROM v_features UNION ALL SELECT 'x2', 'multiclass', count(DISTINCT x2) FROM v_features""")
def _(t):
    d = t.features
    return P.type_of_target(d, "y_reg").unionByName(P.type_of_target(d, "y_bin")).unionByName(P.type_of_target(d, "x2"))


@query("i30_check_unique_type", "SELECT 'double' AS kind, count(*) AS n FROM v_features")
def _(t):
    kind = P.check_unique_type(t.features, ["x0", "y_reg"])
    return t.features.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")


@query("i31_normalize_label", f"WITH p AS ({PARTS_SQL}), {stats_sql(['y_reg'], 'stddev_pop')} "
       "SELECT row_id, p.fold, (y_reg - m_y_reg) / nullif(s_y_reg, 0) AS y_reg_norm, y_reg AS y_back FROM p JOIN m ON p.fold = m.fold", r="y_reg_norm y_back")
def _(t):
    out = P.normalize_label(t.folds.select("row_id", "test_fold", "y_reg"), "y_reg")
    return out.select("row_id", "fold", "y_reg_norm", P.denormalize_label("y_reg_norm").alias("y_back"))


@query("i32_missing_mask", "SELECT row_id, x0 IS NULL AS x0, x3 IS NULL AS x3, k0 IS NULL AS k0 FROM v_features")
def _(t):
    return P.missing_mask(t.features, ["x0", "x3", "k0"])


@query("i33_super_sample", "SELECT row_id, CAST(unnest(range(1, 4)) AS INT) AS copy FROM v_features")
def _(t):
    return P.super_sample(t.features.select("row_id"), 3)


@query("i34_minibatches", " UNION ALL ".join(f"""SELECT {e} AS epoch, CAST(i // 64 AS INT) AS batch, row_id FROM (SELECT row_id, count(*) OVER () AS n,
 row_number() OVER (ORDER BY {order_of(f'9-{e}')}) - 1 AS i FROM v_features) AS a WHERE i // 64 < n // 64""" for e in range(2)))
def _(t):
    return P.minibatches(t.features.select("row_id"), "row_id", 64, 2, 9, allow_incomplete=False)


@query("i35_map_chunks", "SELECT row_id, x1 * 2 + x2 AS y FROM v_features", r="y")
def _(t):
    def score(pdf):
        return pdf.assign(y=pdf.x1 * 2 + pdf.x2)[["row_id", "y"]]

    return P.map_chunks(t.features.select("row_id", "x1", "x2"), score, "row_id bigint, y double", 500)


@query("i36_offset_categories", """WITH a AS (SELECT row_id, CAST(dense_rank() OVER (ORDER BY k0 NULLS LAST) - 1 AS INT) AS k0,
 CAST(dense_rank() OVER (ORDER BY k1 NULLS LAST) - 1 AS INT) AS k1 FROM v_features)
 SELECT row_id, k0 + 1 AS k0, k1 + 1 + CAST((SELECT max(k0) + 1 FROM a) AS INT) AS k1 FROM a""")
def _(t):
    coded, dims = P.encode_categoricals(t.features.select("row_id", "k0", "k1"), ["k0", "k1"])
    return P.offset_categories(coded, dims, 1)


@query("i37_check_eval_set", "SELECT count(*) AS n_train FROM v_folds WHERE test_fold > 1")
def _(t):
    train, val = t.folds.filter("test_fold > 1"), t.folds.filter("test_fold = 1")
    P.check_eval_set(train, [val])
    return train.agg(F.count("*").alias("n_train"))


PROC = NUM


@query("i38_process_data", IMPUTED + ", " + scale_sql("q", PROC, 1000) + f", {DOMS}, "
       + ", ".join(f"h_{c} AS (SELECT p.fold, p.{c} AS v, {onehot_sql(c)} AS h FROM (SELECT DISTINCT fold, {c} FROM p) AS p)" for c in CAT)
       + " SELECT o.row_id, o.fold, o.part, " + ", ".join(f"o.{c}" for c in PROC) + ", " + ", ".join(f"h_{c}.h AS {c}" for c in CAT) + " FROM out AS o "
       + " ".join(f"JOIN h_{c} ON h_{c}.fold = o.fold AND h_{c}.v IS NOT DISTINCT FROM o.{c}" for c in CAT),
       r=" ".join(PROC))
def _(t):
    out = P.process_data(t.folds.select("row_id", "test_fold", *PROC, *CAT), PROC, CAT)
    return out.select("row_id", "fold", "part", *PROC, *[F.array_join(f"{c}_onehot", "").alias(c) for c in CAT])


@query("i39_preprocess", "SELECT row_id, test_fold, CAST(dense_rank() OVER (ORDER BY y_multi) - 1 AS INT) AS y_multi, " + ", ".join(
    f"CAST(dense_rank() OVER (ORDER BY {c} NULLS LAST) - 1 AS INT) AS {c}" for c in CAT) + ", x1 FROM v_folds")
def _(t):
    out, _meta = P.preprocess(t.features.drop("y_bin", "y_reg"), "y_multi", CAT)
    return out.select("row_id", "test_fold", "y_multi", *CAT, "x1")


@query("b19_drop_features", "SELECT row_id, x1, x2, k1, 'k1' AS categorical FROM v_features")
def _(t):
    flags = {c: c in CAT for c in NUM + CAT}
    out, left = P.drop_features(t.features.select("row_id", *NUM, *CAT), ["x0", "x3", "x4", "k0", "k2"], flags)
    return out.withColumn("categorical", F.lit(",".join(c for c, f in left.items() if f)))


@query("b20_override_types", "SELECT row_id, CAST(y_bin AS VARCHAR) AS y_bin, CAST(k2 AS DOUBLE) AS k2 FROM v_features")
def _(t):
    return P.override_types(t.features.select("row_id", "y_bin", "k2"), cat=["y_bin"], num=["k2"])
