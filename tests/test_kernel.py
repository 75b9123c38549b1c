"""The radial kernel by random Fourier features."""
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from gradus.operators import kernel as K, metrics as M, models as L


def test_inner_products_approximate_the_kernel(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, x array<double>").withColumn("features", array_to_vector("x"))
    gamma = K.scale_gamma(df)
    assert gamma == pytest.approx(1 / (4 * x.var()))
    got = df.select("i", vector_to_array(K.fourier(F.col("features"), *K.draws(4, gamma, 4096))).alias("z")).orderBy("i").collect()
    z = np.array([r.z for r in got])
    want = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - want).max() < 5 / np.sqrt(4096)


def rings(spark, classes):
    r = random.Random(4)
    rows = []
    for i in range(600):
        label, angle = i % classes, r.uniform(0, 2 * np.pi)
        radius = 1 + 1.5 * label + r.gauss(0, 0.1)
        rows.append((i, 0, ("test", "val", "train", "train", "train")[(i // classes) % 5], float(label), [float(radius * np.cos(angle)), float(radius * np.sin(angle))]))
    df = spark.createDataFrame(rows, "row_id bigint, fold int, part string, label double, x array<double>")
    return df.withColumn("features", array_to_vector("x")).withColumn("is_val", F.col("part") == "val").drop("x")


@pytest.mark.parametrize("classes, objective", [(2, "binary"), (3, "classification")])
def test_rings_that_no_line_separates(spark, classes, objective):
    preds, report = L.cross_validate("SVM", {"C": 10.0}, rings(spark, classes), objective, (0,))
    assert report[0]["exception"] == "None"
    assert preds.filter("part = 'test'").agg(M.accuracy("y_true", "y_pred").alias("a")).first().a >= 0.9


def test_no_training_rows_is_a_failed_trial(spark):
    rows = rings(spark, 2).filter("part = 'test'")
    preds, report = L.cross_validate("SVM", {}, rows, "binary", (0,))
    assert preds is None and report[0]["exception"] != "None"
