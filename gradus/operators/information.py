"""Mutual information of a numeric column and a class label by nearest neighbours (Ross 2014).

In one dimension a point's nearest neighbours of its own class stand next to it in the order of the values, and the
points of any class within their distance are a difference of two running counts. Both need order only, so the rows
are reduced to counted values, cut into ranges, and each range borrows the few values next to it from its neighbours.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gradus.plans.ordering import BUCKET, cut_points, melt, prefix_sums, value_buckets
from gradus.session import written

RANGE_ROWS = 10_000
#: The neighbour's own distance is left out of the count of nearer points.
INSIDE = 1 - 1e-12


def digamma(x: Column) -> Column:
    """Digamma of a number not below 1, to about ten digits: six steps up, then the asymptotic series."""
    z = x.cast("double") + 6
    series = F.ln(z) - 1 / (2 * z) - 1 / (12 * F.pow(z, 2.0)) + 1 / (120 * F.pow(z, 4.0)) - 1 / (252 * F.pow(z, 6.0)) + 1 / (240 * F.pow(z, 8.0))
    for j in range(6):
        series = series - 1 / (x.cast("double") + j)
    return series


def with_halo(cells: DataFrame, keys: Sequence[str], order: str, halo: int, rows: int = RANGE_ROWS) -> DataFrame:
    """Rows in ranges of `rows` consecutive ones per key, with `halo` rows of each neighbouring range.

    Adds `_range` and `_own` (false for a borrowed row). Values of `order` are distinct within a key. `halo` must not
    exceed `rows`. A range with its halo is all that a window over neighbouring rows needs.
    """
    if halo > rows:
        raise ValueError("the halo is longer than a range")
    placed = prefix_sums(value_buckets(cells, order, cut_points(cells, order)), keys, [order], {"_at": F.lit(1).cast("bigint")}, inclusive=False)
    own, at = F.floor(F.col("_at") / rows), F.pmod(F.col("_at"), F.lit(rows))
    homes = F.filter(F.array(own, F.when((at < halo) & (own > 0), own - 1), F.when(at >= rows - halo, own + 1)), lambda r: r.isNotNull())
    copies = placed.withColumn("_home", own).withColumn("_range", F.explode(homes))
    return copies.withColumn("_own", F.col("_range") == F.col("_home")).drop("_at", "_home", BUCKET)


def nearest_information(df: DataFrame, numeric: Sequence[str], y: str, k: int = 3, rows: int = RANGE_ROWS) -> DataFrame:
    """(feature, mut_inf) in bits, not below 0: each point's `k` nearest neighbours of its own class, in one column.

    A null value stands at the column's mean (0 if all are null). Rows without a label and classes of one row are left
    out; a class of fewer than k + 1 rows uses all its others. Equal values are one counted cell, so ties cost
    nothing. An empty table gives no rows; a column whose every row is left out gives none.
    """
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in numeric]).first()  # one number a column
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(float(means[c] or 0.0))).alias(c) for c in numeric]
    long = melt(df.filter(F.col(y).isNotNull()).select(F.col(y).cast("string").alias("y"), *filled), ["y"], numeric)
    counted = long.groupBy("feature", "y", "value").agg(F.count("*").alias("c"))
    classes = df.filter(F.col(y).isNotNull()).groupBy(F.col(y).cast("string").alias("y")).agg(F.count("*").alias("n_class")).filter("n_class > 1")
    cells = written(counted.join(classes, "y"), "class-values")
    ranges = with_halo(cells, ["feature", "y"], "value", k, rows)
    beside = W.partitionBy("feature", "y", "_range").orderBy("value").rowsBetween(-k, k)
    near = ranges.withColumn("near", F.collect_list(F.struct("value", "c")).over(beside)).filter("_own")
    want = F.least(F.lit(k), F.col("n_class") - 1)
    apart = F.sort_array(F.transform("near", lambda p: F.struct(F.abs(p["value"] - F.col("value")).alias("d"), p["c"].alias("c"))))
    # the cell itself is the first of the list and holds the point, so one more is wanted
    reach = F.aggregate(apart, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("d")), lambda s, p: F.when(
        s["n"] > want, s).otherwise(F.struct((s["n"] + p["c"]).alias("n"), p["d"].alias("d"))))
    inner = near.select("feature", "y", "value", "c", "n_class", want.alias("k"), (reach["d"] * INSIDE).alias("r"))
    inner = written(inner, "reaches")
    # a point counts at its value, after questions for what lies below and before those for what lies up to it
    points = cells.groupBy("feature", "value").agg(F.sum("c").alias("n")).select(
        "feature", F.col("value").alias("at"), F.lit(1).alias("kind"), "n", F.lit(None).cast("string").alias("y"), F.lit(None).cast("double").alias("value"))
    ends = F.explode(F.array(*[F.struct((F.col("value") + s * F.col("r")).alias("at"), F.lit(kind).alias("kind")) for s, kind in ((-1, 0), (1, 2))]))
    asked = inner.select("feature", "y", "value", ends.alias("e")).select("feature", "e.at", "e.kind", F.lit(0).cast("bigint").alias("n"), "y", "value")
    events = points.unionByName(asked)
    counts = prefix_sums(value_buckets(events, "at", cut_points(points, "at")), ["feature"], ["at", "kind"], {"upto": "n"})
    within = counts.filter("kind <> 1").groupBy("feature", "y", "value").agg(F.sum(F.col("upto") * (F.col("kind") - 1)).alias("m"))
    scored = inner.join(within, ["feature", "y", "value"])
    terms = F.col("c") * (digamma(F.col("k")) - digamma(F.col("n_class")) - digamma(F.col("m")))
    return scored.groupBy("feature").agg(F.greatest(F.lit(0.0), (digamma(F.sum("c")) + F.sum(terms) / F.sum("c")) / math.log(2)).alias("mut_inf"))
