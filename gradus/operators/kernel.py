"""Support vector machine with a radial kernel, by random Fourier features before the linear fit.

exp(-gamma |x - y|^2) is the mean of cos(w (x - y)) over normal w of variance 2 gamma. With SIZE seeded draws every row
maps to SIZE cosines whose inner products are within about 1 / sqrt(SIZE) of the kernel, and a linear machine on them
takes the place of a table of all pairs of rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

SIZE = 256
TOLERANCE = 1e-4


def scale_gamma(rows: DataFrame, features: str = "features") -> float:
    """1 / (features * variance over all cells), or 1 / features where nothing varies."""
    x = vector_to_array(F.col(features))
    sums = rows.select(F.size(x).alias("k"), F.aggregate(x, F.lit(0.0), lambda a, v: a + v).alias("s"), F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v).alias("q"))
    r = sums.agg(F.max("k").alias("k"), F.sum("k").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).first()
    if not r.n:
        raise ValueError("no training rows")
    spread = r.q / r.n - (r.s / r.n) ** 2
    return 1.0 / (r.k * spread) if spread > 1e-12 else 1.0 / r.k


def draws(width: int, gamma: float, size: int = SIZE, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies (width x size) and phases; the same for the same seed."""
    rng = np.random.Generator(np.random.Philox(seed))
    return rng.normal(0.0, np.sqrt(2 * gamma), (width, size)), rng.uniform(0, 2 * np.pi, size)


def fourier(features: Column, frequencies: np.ndarray, phases: np.ndarray) -> Column:
    """The cosines of a vector column, as a vector."""
    norm = np.sqrt(2.0 / len(phases))

    @F.pandas_udf("array<double>")
    def cosines(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(list(norm * np.cos(np.stack(x.to_numpy()) @ frequencies + phases))) if len(x) else pd.Series([], dtype=object)

    return array_to_vector(cosines(vector_to_array(features)))


class KernelMachine:
    """An estimator of (features, label); `cost` weighs the summed loss against the penalty."""

    def __init__(self, objective: str, cost: float = 1.0, n_rows: int = 1, size: int = SIZE, gamma: float | None = None, seed: int = 0):
        self.objective, self.cost, self.n_rows, self.size, self.gamma, self.seed = objective, cost, max(1, n_rows), size, gamma, seed

    def hasParam(self, name: str) -> bool:
        return False

    def fit(self, rows: DataFrame) -> KernelModel:
        gamma = scale_gamma(rows) if self.gamma is None else self.gamma
        width = rows.select(F.size(vector_to_array("features"))).first()[0]
        mapping = draws(width, gamma, self.size, self.seed)
        svc = LinearSVC(featuresCol="fourier", labelCol="label", regParam=1.0 / (self.cost * self.n_rows), standardization=False, tol=TOLERANCE)
        learner = svc if self.objective == "binary" else OneVsRest(classifier=svc, featuresCol="fourier", labelCol="label")
        return KernelModel(learner.fit(rows.withColumn("fourier", fourier(F.col("features"), *mapping))), mapping)


class KernelModel:
    def __init__(self, model, mapping: tuple[np.ndarray, np.ndarray]):
        self.model, self.mapping = model, mapping

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(rows.withColumn("fourier", fourier(F.col("features"), *self.mapping)))
