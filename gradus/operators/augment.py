"""Whole-table augmentation: replayable masks, permutations and mixes.

Draws are hashes of (row, column, seed), so they do not depend on how the
table is partitioned. A permutation pairs two distributed hash orders.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gradus.operators.prep import hash_normal
from gradus.plans.ordering import hash_row_index, hash_uniform, melt


def cell_mask(row_id: str, col: str, p: float, seed: int) -> Column:
    return hash_uniform(row_id, f"{col}-{seed}") < F.lit(float(p))


def bernoulli_mask(df: DataFrame, cols: Sequence[str], p: float, seed: int = 0, row_id: str = "row_id") -> DataFrame:
    return df.select(row_id, *[cell_mask(row_id, c, p, seed).cast("int").alias(c) for c in cols])


def permute(df: DataFrame, row_id: str, seed: int) -> DataFrame:
    """(row_id, partner): a random permutation of the rows."""
    ids = df.select(row_id)
    a = hash_row_index(ids, row_id, f"{seed}-a", out="_i")
    b = hash_row_index(ids.withColumnRenamed(row_id, "partner"), "partner", f"{seed}-b", out="_i")
    return a.join(b, "_i").drop("_i")


def _with_partner(df: DataFrame, cols: Sequence[str], row_id: str, seed: int) -> DataFrame:
    """Rows with the partner's columns under an underscore prefix."""
    other = df.select(F.col(row_id).alias("partner"), *[F.col(c).alias(f"_{c}") for c in cols])
    return df.join(permute(df, row_id, seed), row_id).join(other, "partner")


def corrupt(df: DataFrame, cols: Sequence[str], p: float, seed: int = 0, row_id: str = "row_id") -> DataFrame:
    """Masked cells take the value of an independent permutation of their column.

    Long form (row_id, feature, value, corrupted, mask): `mask` marks cells
    that really changed. All columns share one join on (feature, position).
    """
    cell = lambda s: F.concat(F.col(row_id), F.lit("-"), F.col("feature"), F.lit(f"-{s}"))
    long = melt(df, [row_id], cols)
    here = hash_row_index(long.withColumn("_c", cell("a")), "_c", seed, ["feature"], out="_i").drop("_c")
    there = hash_row_index(
        long.select(row_id, "feature", F.col("value").alias("_other")).withColumn("_c", cell("b")), "_c", seed, ["feature"], out="_i"
    ).select("feature", "_i", "_other")
    masked = hash_uniform(F.concat(F.col(row_id), F.lit("-"), F.col("feature")), f"m-{seed}") < F.lit(float(p))
    out = here.join(there, ["feature", "_i"]).withColumn("corrupted", F.when(masked, F.col("_other")).otherwise(F.col("value")))
    changed = (~F.col("value").eqNullSafe(F.col("corrupted"))).cast("int")
    return out.select(row_id, "feature", "value", "corrupted", changed.alias("mask"))


def mixup(df: DataFrame, cols: Sequence[str], y: str, lam: float, seed: int = 0, row_id: str = "row_id") -> DataFrame:
    """lam * x + (1 - lam) * partner's x, with both labels kept."""
    out = _with_partner(df.select(row_id, *cols, y), [*cols, y], row_id, seed)
    mixed = [(F.lit(lam) * F.col(c) + F.lit(1.0 - lam) * F.col(f"_{c}")).alias(c) for c in cols]
    return out.select(row_id, "partner", *mixed, F.col(y).alias("y_a"), F.col(f"_{y}").alias("y_b"))


def cutmix(df: DataFrame, cols: Sequence[str], lam: float, seed: int = 0, row_id: str = "row_id") -> DataFrame:
    """Each cell is the partner's with probability lam."""
    out = _with_partner(df.select(row_id, *cols), cols, row_id, seed)
    return out.select(row_id, "partner", *[F.when(cell_mask(row_id, c, lam, seed), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in cols])


def missing_noise(df: DataFrame, cols: Sequence[str], lam: float, seed: int = 0, row_id: str = "row_id") -> DataFrame:
    """Each cell is zeroed with probability lam."""
    return df.withColumns({c: F.when(cell_mask(row_id, c, lam, seed), F.lit(0.0)).otherwise(F.col(c)) for c in cols})


def mask_noise(
    df: DataFrame, cols: Sequence[str], domains: dict[str, Sequence[str]], p_noise: float, p_mask: float, p_replace: float,
    seed: int = 0, row_id: str = "row_id",
) -> DataFrame:
    """Select cells with p_noise; of those zero p_mask and replace p_replace.

    Numeric cells are replaced by a standard normal draw, categorical cells
    (columns in `domains`) by a random category. Selected cells are flagged in
    {col}_masked; a missing cell becomes zero, or a null category, and is not
    flagged.
    """
    out: dict[str, Column] = {}
    for c in cols:
        chosen = cell_mask(row_id, c, p_noise, seed) & F.col(c).isNotNull()
        u = hash_uniform(row_id, f"{c}-kind-{seed}")
        if c in domains:
            items = F.array(*[F.lit(v) for v in domains[c]])
            draw = F.element_at(items, F.floor(hash_uniform(row_id, f"{c}-draw-{seed}") * len(domains[c])).cast("int") + 1)
            zero, base = F.lit(None).cast("string"), F.col(c)
        else:
            draw, zero, base = hash_normal(row_id, f"{c}-draw-{seed}"), F.lit(0.0), F.coalesce(F.col(c), F.lit(0.0))
        out[f"{c}_masked"] = chosen
        out[c] = F.when(chosen & (u < p_mask), zero).when(chosen & (u < p_mask + p_replace), draw).otherwise(base)
    return df.withColumns(out)
