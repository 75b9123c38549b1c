"""Dataset loaders by name."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

LOADERS: dict[str, Callable[[SparkSession], DataFrame]] = {}


def dataset(name: str):
    """Register a loader (spark) -> DataFrame; a name can be taken once."""
    def add(fn: Callable[[SparkSession], DataFrame]):
        if name in LOADERS:
            raise ValueError(f"dataset {name} is registered already")
        LOADERS[name] = fn
        return fn

    return add


def load(name: str, spark: SparkSession) -> DataFrame:
    if name not in LOADERS:
        raise KeyError(f"no dataset named {name}; have {sorted(LOADERS)}")
    return LOADERS[name](spark)
