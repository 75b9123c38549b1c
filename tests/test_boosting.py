"""Histogram boosting against a plain implementation, and what its parameters do."""
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gradus.operators import boosting as B, models as L
from gradus.operators import metrics as M


def rows_of(spark, n, label, folds=2, width=3, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x = [r.gauss(0, 1), r.randrange(5) * 1.0, float(r.random() < 0.1)][:width]
        for f in range(folds):
            part = ("test", "val", "train")[min((i + f) % 10, 2)]
            out.append((i, f, part, float(label(x, r)), x))
    df = spark.createDataFrame(out, "row_id bigint, fold int, part string, label double, x array<double>")
    return df.withColumn("features", array_to_vector("x")).withColumn("is_val", F.col("part") == "val").drop("x"), out


def plain_first_tree(out, fold, params):
    """Root split and leaf values of the first regression round, by trying every edge."""
    x = np.array([r[4] for r in out if r[1] == fold and r[2] == "train"])
    y = np.array([r[3] for r in out if r[1] == fold and r[2] == "train"])
    g, best = -(y - y.mean()) / y.std(), None

    def half(v):
        return max(abs(v.sum()) - params.l1, 0) ** 2 / (len(v) + params.l2)

    for j in range(x.shape[1]):
        edges = np.unique(np.quantile(x[:, j], np.arange(B.BINS) / B.BINS))
        for e in edges:
            low = x[:, j] <= e
            if min(low.sum(), (~low).sum()) >= max(1, params.min_rows):
                gain = half(g[low]) + half(g[~low]) - half(g)
                if best is None or gain > best[0] + 1e-6:
                    best = (gain, j, e, *[-params.step * np.sign(v.sum()) * max(abs(v.sum()) - params.l1, 0) / (len(v) + params.l2) for v in (g[low], g[~low])])
    return best


def test_first_split_is_the_best_of_all(spark):
    rows, out = rows_of(spark, 600, lambda x, r: 3 * x[1] + (x[0] > 0.4) * 5 + r.gauss(0, 1))
    for params in (B.Params(max_depth=1, rounds=1, l1=2.0, l2=7.0), B.Params(growth="symmetric", max_depth=1, rounds=1, l2=3.0), B.Params(growth="leaves", num_leaves=2, rounds=1, min_rows=20)):
        model = B.fit(rows, "regression", params)
        for f in (0, 1):
            tree = model.rounds[0][f][0]
            gain, j, edge, low, high = plain_first_tree(out, f, params)
            assert tree.feature[0] == j and model.edges[f][j][tree.bin[0]] == pytest.approx(edge)
            assert [tree.value[tree.left[0]], tree.value[tree.right[0]]] == pytest.approx([low, high], abs=1e-5)


def test_growth_bounds(spark):
    rows, _ = rows_of(spark, 800, lambda x, r: np.sin(3 * x[0]) + 0.2 * x[1] * x[0] + r.gauss(0, 0.1), folds=1)
    depth = B.fit(rows, "regression", B.Params(max_depth=3, rounds=2)).rounds
    level = B.fit(rows, "regression", B.Params(growth="symmetric", max_depth=3, rounds=2)).rounds
    leaves = B.fit(rows, "regression", B.Params(growth="leaves", num_leaves=6, rounds=2, min_rows=20)).rounds
    assert max(depth[0][0][0].depth) == 3
    assert leaves[0][0][0].leaves == 6
    for tree in (r[0][0] for r in level):
        for d in range(max(tree.depth)):
            assert len({(f, b) for f, b, at in zip(tree.feature, tree.bin, tree.depth) if at == d and f >= 0}) == 1
    assert len({tuple(r[0][0][0].feature) for r in (depth, level, leaves)}) == 3


@pytest.mark.parametrize("name, objective", [("XGBoost", "binary"), ("CatBoost", "classification"), ("LightGBM", "regression")])
def test_learns_and_stops_on_the_validation_part(spark, name, objective):
    label = {"binary": lambda x, r: (x[0] * x[0] > 0.5) != (r.random() < 0.05),
             "classification": lambda x, r: (x[0] > 0.5) + (x[1] > 2) if r.random() > 0.05 else r.randrange(3),
             "regression": lambda x, r: 100 * abs(x[0]) + r.gauss(0, 10)}[objective]
    rows, _ = rows_of(spark, 900, label)
    # steps of a third, so that the fit ends soon
    step = {"XGBoost": "eta", "CatBoost": "learning_rate", "LightGBM": "learning_rate"}[name]
    params = {step: 0.3, "n_iter": 20, "max_depth": 2, "num_leaves": 8}
    model = L.get_model(name)(params, objective).fit_folds(rows)
    assert all(len(v) - 1 - model.best[f] <= 20 and min(v) == v[model.best[f]] < v[0] for f, v in model.losses.items())
    preds, report = L.cross_validate(name, params | {"n_iter": 12}, rows, objective, (0, 1))
    assert [r["exception"] for r in report] == ["None", "None"]
    test = preds.filter("part = 'test'")
    assert test.select("fold").distinct().count() == 2
    if objective == "regression":
        ratio = test.agg(F.avg(F.pow(F.col("y_true") - F.col("y_pred"), 2)) / F.var_pop("y_true")).first()[0]
        assert ratio < 0.3
    else:
        assert test.agg(M.accuracy("y_true", "y_pred").alias("a")).first().a > 0.8


def test_a_fit_that_only_gets_worse_ends_after_the_patience(spark):
    r = random.Random(9)
    rows, _ = rows_of(spark, 200, lambda x, _: r.random() < 0.5, folds=1)
    model = B.fit(rows, "binary", B.Params(step=1.0, rounds=100, patience=3, max_depth=4, l2=0.0))
    assert len(model.losses[0]) - 1 - model.best[0] == 3 and len(model.rounds) < 100


def test_penalties_and_reruns(spark):
    rows, _ = rows_of(spark, 300, lambda x, r: x[0] + x[1] + r.gauss(0, 0.1), folds=1)
    def values(**k):
        return [t.value for r in B.fit(rows.repartition(3), "regression", B.Params(max_depth=2, rounds=2, **k)).rounds for t in r[0]]
    plain, again, heavy, none = values(), values(), values(l2=500.0), values(l1=1e6)
    assert plain == again
    assert max(map(abs, heavy[0])) < max(map(abs, plain[0]))
    assert not any(map(any, none))


def test_edges(spark):
    with pytest.raises(ValueError):
        B.Params(step=0.0)
    rows, _ = rows_of(spark, 60, lambda x, r: 1.0, folds=1)  # one label: nothing to split
    assert all(t.feature == [-1] for r in B.fit(rows, "regression", B.Params(rounds=2)).rounds for t in r[0])
    missing = rows.withColumn("features", array_to_vector(F.array(F.lit(float("nan")), F.lit(1.0))))
    out = B.fit(missing, "binary", B.Params(rounds=2)).transform(missing)
    assert out.count() == rows.count() and out.filter("isnan(prediction)").count() == 0
    preds, report = L.cross_validate("XGBoost", {"eta": -1.0}, rows, "binary", (0,))
    assert preds is None and "ValueError" in report[0]["exception"]
