"""Registry of named queries: a Spark function and, where SQL can say it, its oracle."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradus.catalog.views import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


DIGITS = 6
NUDGE = 1.7e-9  # moves exact ties off the rounding boundary, equally on both sides


def query(name: str, sql: str | None = None, r: str = ""):
    """Register `fn(tables) -> DataFrame` under `name`, with its oracle SQL.

    `r` lists double columns that are rounded on both sides, because sums of
    doubles depend on the order in which partitions are added.
    """
    rounded = r.split()

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(Tables(spark, sf_dir))
            return out.withColumns({c: F.round(F.col(c) + F.lit(NUDGE), DIGITS) + F.lit(0.0) for c in rounded}) if rounded else out

        QUERIES[name] = run
        if sql is not None:
            text = with_views(sql)
            if rounded:
                swaps = ", ".join(f"round({c} + {NUDGE}, {DIGITS}) + 0e0 AS {c}" for c in rounded)
                text = f"SELECT * REPLACE ({swaps}) FROM (\n{text}\n) AS q"
            ORACLES[name] = text
        return fn

    return register
