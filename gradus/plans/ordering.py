"""Distributed order: hash order, row indices, prefix sums, exact quantiles.

No function here puts a whole table, or a whole key group, in one task. Rows
are split into ordered buckets that are a pure function of the row, each
bucket is sorted on its own, and a small table of per-bucket totals supplies
what lies before a bucket. A key that holds most of the rows is therefore
spread over as many tasks as it has buckets.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gradus.session import shuffle_partitions

BUCKET = "_bucket"


def hash_order(row_id: Column | str, seed: int | str = 0) -> Column:
    """md5(row_id:seed), a replayable shuffle key equal in every engine."""
    c = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.md5(F.concat(c.cast("string"), F.lit(f":{seed}")))


def hash_uniform(row_id: Column | str, seed: int | str = 0) -> Column:
    """Uniform double in [0, 1) from the first 13 hex digits (52 bits) of the hash."""
    digits = F.substring(hash_order(row_id, seed), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))


def _hex_digits(df: DataFrame) -> int:
    """Digits so that 16**digits is about eight buckets per shuffle partition."""
    digits, want = 2, 8 * shuffle_partitions(df.sparkSession)
    while 16**digits < want and digits < 12:
        digits += 1
    return digits


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    sums: dict[str, Column | str],
    bucket: str = BUCKET,
    inclusive: bool = True,
) -> DataFrame:
    """Running sums per key in the given order, spread over ordered buckets.

    `bucket` must not decrease along `order`; keys must not be null. The rows
    are shuffled once, on (keys, bucket), which also serves the join with the
    totals table of one row per (key, bucket).
    """
    part = [*keys, bucket]
    cols = {n: (F.col(c) if isinstance(c, str) else c) for n, c in sums.items()}
    inside = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    before = W.partitionBy(*(keys or [F.lit(0)])).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(*part).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in cols.items()])
    offsets = totals.select(*part, *[F.sum(f"_t_{n}").over(before).alias(f"_o_{n}") for n in cols])
    # materialised first, so the summed expressions see the source columns
    scanned = df.withColumns({f"_s_{n}": F.sum(c).over(inside) for n, c in cols.items()})
    zero = F.lit(0)
    kept = [c for c in df.columns if c not in cols]
    return scanned.join(offsets, part).select(
        *kept, *[(F.coalesce(F.col(f"_s_{n}"), zero) + F.coalesce(F.col(f"_o_{n}"), zero)).alias(n) for n in cols]
    )


def hash_row_index(
    df: DataFrame,
    row_id: str,
    seed: int | str = 0,
    keys: Sequence[str] = (),
    out: str = "row_index",
) -> DataFrame:
    """Zero-based position of each row (per key) in hash order."""
    digits = _hex_digits(df)
    tagged = df.withColumn("_h", hash_order(row_id, seed)).withColumn(
        BUCKET, F.conv(F.substring("_h", 1, digits), 16, 10).cast("int")
    )
    ranked = prefix_sums(tagged, keys, ["_h", row_id], {out: F.lit(1).cast("bigint")}, inclusive=False)
    return ranked.drop("_h", BUCKET)


def hash_cut(df: DataFrame, row_id: str, n: int, seed: int | str = 0, few: int = 10_000) -> str | None:
    """The n-th smallest hash_order of a table's rows (n at least 1); None if there are fewer.

    Rows with equal ids share a hash and are taken or left together; a null id has none.

    Rows are counted per hash prefix, and only the prefix that holds the wanted rank is counted again with three more
    digits, until few rows share it. Each pass reads the id column, shuffles counts of at most 4,096 prefixes and
    sends no more than these, or `few` hashes, to the driver; rows are never shuffled.
    """
    hashes = df.select(hash_order(row_id, seed).alias("_h"))
    prefix, before = "", 0
    while True:
        inside = hashes.filter(F.col("_h").startswith(prefix)) if prefix else hashes
        digits = len(prefix) + 3
        counts = inside.groupBy(F.substring("_h", 1, digits).alias("p")).agg(F.count("*").alias("n"))
        found = None
        for r in sorted(counts.filter("p IS NOT NULL").collect(), key=lambda r: r["p"]):
            if before + r["n"] >= n:
                found = r
                break
            before += r["n"]
        if found is None:
            return None
        prefix = found["p"]
        if found["n"] <= few or digits >= 32:
            break
    at = hashes.filter(F.col("_h").startswith(prefix)).orderBy("_h").limit(n - before).collect() if found["n"] <= few else [{"_h": prefix}]
    return at[-1]["_h"]


def first_in_hash_order(row_id: str, cut: str | None, seed: int | str = 0) -> Column:
    """Whether a row is among those up to hash_cut's; always if that is None."""
    return F.lit(True) if cut is None else F.coalesce(hash_order(row_id, seed) <= F.lit(cut), F.lit(False))


def _sketch(df: DataFrame, col: str, n: int | None) -> list[float]:
    n = n or max(16, 4 * shuffle_partitions(df.sparkSession))
    probs = [i / n for i in range(1, n)]
    cuts = df.agg(F.percentile_approx(F.col(col).cast("double"), probs, max(10000, 4 * n)).alias("c")).first()["c"]
    return [c for c in (cuts or []) if c == c and abs(c) != float("inf")]


def cut_points(df: DataFrame, col: str, n: int | None = None) -> list[float]:
    """At most `n` distinct cut values from a mergeable quantile sketch.

    The cuts only balance the buckets; every result built on them is exact
    whatever the sketch's error.
    """
    return sorted(set(_sketch(df, col, n)))


def value_buckets(df: DataFrame, col: str, cuts: list[float] | None = None, out: str = BUCKET) -> DataFrame:
    """Number the bucket of each non-null value, increasing with the value.

    Equal values share a bucket: count them first, or use order_buckets.
    """
    cuts = cut_points(df, col) if cuts is None else cuts
    if not cuts:
        return df.withColumn(out, F.lit(0.0))
    splits = [-float("inf"), *cuts, float("inf")]
    tagged = df.withColumn("_v", F.col(col).cast("double"))
    return Bucketizer(splits=splits, inputCol="_v", outputCol=out, handleInvalid="keep").transform(tagged).drop("_v")


def order_buckets(df: DataFrame, col: str, tie: str, out: str = BUCKET) -> DataFrame:
    """Buckets along (col, tie), both numeric, that also split a value held by many rows.

    A value the sketch meets twice gets a bucket of its own, which is cut
    again by `tie`.
    """
    raw = _sketch(df, col, None)
    hot = sorted(v for v in set(raw) if raw.count(v) > 1)
    cuts = sorted(set(raw) | {math.nextafter(v, math.inf) for v in hot})
    tagged = value_buckets(df, col, cuts, out)
    if not hot:
        return tagged
    is_hot = F.col(col).cast("double").isin(hot)
    ties = cut_points(df.filter(is_hot), tie)
    both = value_buckets(tagged, tie, ties, "_tie")
    return both.withColumn(out, F.col(out) * (len(ties) + 2) + F.when(is_hot, F.col("_tie")).otherwise(0.0)).drop("_tie")


def row_index(
    df: DataFrame,
    order: str,
    tie: Sequence[str] = (),
    keys: Sequence[str] = (),
    out: str = "row_index",
) -> DataFrame:
    """Zero-based position in ascending order of a numeric column, then `tie`.

    Use hash_row_index when the wanted order is a shuffle. A numeric `tie`
    also splits values that many rows share.
    """
    numeric = tie and dict(df.dtypes)[tie[0]] not in ("string", "boolean", "binary")
    tagged = order_buckets(df, order, tie[0]) if numeric else value_buckets(df, order)
    ranked = prefix_sums(tagged, keys, [order, *tie], {out: F.lit(1).cast("bigint")}, inclusive=False)
    return ranked.drop(BUCKET)


def exact_quantiles(
    counts: DataFrame,
    keys: Sequence[str],
    value: str,
    weights: Sequence[str],
    probs: dict[str, float],
    cuts: list[float] | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles per key under several integer weights.

    `counts` has one row per (keys, value) with one count column per weight,
    so ten folds are served by ten weight columns instead of ten copies of
    the rows. Only the buckets that hold a wanted position are sorted.

    Returns (keys, weight, q, value): `weight` is the weight column's name
    and `q` the name given to the probability.
    """
    vals = value_buckets(counts.filter(F.col(value).isNotNull()), value, cuts)
    part = [*keys, BUCKET]
    totals = vals.groupBy(*part).agg(*[F.sum(w).alias(w) for w in weights])
    key_cols = keys or [F.lit(0)]
    before = W.partitionBy(*key_cols).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*key_cols)
    placed = totals.withColumns({f"_n_{w}": F.sum(w).over(whole) for w in weights}).withColumns(
        {f"_o_{w}": F.coalesce(F.sum(w).over(before), F.lit(0)) for w in weights})
    # the wanted positions of a weight that fall into this bucket
    per = F.explode(F.array(*[
        F.struct(F.lit(w).alias("weight"), F.col(w).alias("size"), F.col(f"_n_{w}").alias("n"), F.col(f"_o_{w}").alias("off"))
        for w in weights]))
    q = F.explode(F.array(*[F.struct(F.lit(k).alias("q"), F.lit(float(p)).alias("p")) for k, p in probs.items()]))
    wanted = (
        placed.select(*part, per.alias("e")).select(*part, "e.*").filter("size > 0")
        .select("*", q.alias("e")).select(*part, "weight", "size", "n", "off", "e.*")
        .withColumn("pos", F.col("p") * (F.col("n") - 1))
        .withColumns({"lo": F.floor("pos"), "hi": F.ceil("pos")})
        .filter((F.col("off") <= F.col("hi")) & (F.col("off") + F.col("size") > F.col("lo")))
    )
    picked = vals.select(
        *part, F.col(value).alias("_x"),
        F.create_map(*[x for w in weights for x in (F.lit(w), F.col(w))]).alias("_w"),
    ).join(wanted, part).withColumn("_c", F.element_at("_w", F.col("weight"))).filter(F.col("_c") > 0)
    inside = W.partitionBy(*part, "weight", "q").orderBy("_x").rowsBetween(W.unboundedPreceding, 0)
    cum = picked.withColumn("_cum", F.sum("_c").over(inside) + F.col("off"))
    def hit(pos: str) -> Column:
        inside_row = (F.col(pos) < F.col("_cum")) & (F.col(pos) >= F.col("_cum") - F.col("_c"))
        return F.max(F.when(inside_row, F.col("_x")))

    agg = cum.groupBy(*keys, "weight", "q").agg(
        hit("lo").alias("_lo"), hit("hi").alias("_hi"), F.first("pos").alias("_pos")
    )
    frac = F.col("_pos") - F.floor("_pos")
    # interpolate only between two different order statistics
    return agg.select(
        *keys, "weight", "q", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * frac).alias("value")
    )


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """exact_quantiles with plain row counts; returns (keys, q, value)."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n_rows"))
    return exact_quantiles(counts, keys, value, ["n_rows"], probs).drop("weight")


def melt(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Numeric columns to long rows (ids, feature, value)."""
    return df.unpivot(list(ids), [F.col(c).cast("double").alias(c) for c in cols], name, value)


def text_buckets(values: DataFrame, col: str, out: str = BUCKET) -> DataFrame:
    """Ordered buckets of a string column without nulls.

    The cut points are a uniform sample of the distinct strings, those with the smallest hashes, so the buckets are
    even whatever the strings share. A bucket is the number of cut points not above the string, found by halving.
    """
    n = max(16, 4 * shuffle_partitions(values.sparkSession))
    drawn = values.select(F.col(col).alias("v")).distinct().orderBy(F.xxhash64("v"), "v").limit(n).collect()
    cuts = sorted((r["v"] for r in drawn), key=lambda v: v.encode())
    if not cuts:
        return values.withColumn(out, F.lit(0))
    tagged, points = values, F.lit(cuts)
    lo, step = F.lit(0), 1 << (len(cuts).bit_length() - 1)
    names = []
    while step:
        at = lo + step
        name = f"_at_{step}"
        tagged = tagged.withColumn(name, F.when((at <= len(cuts)) & (F.get(points, at - 1) <= F.col(col)), at).otherwise(lo))
        names.append(name)
        lo, step = F.col(name), step >> 1
    return tagged.withColumn(out, lo).drop(*names)


def sorted_codes(values: DataFrame, keys: Sequence[str], col: str, out: str = "code") -> DataFrame:
    """Zero-based code of each distinct string in byte order, per key; nulls last.

    The distinct values are numbered in ordered buckets, so a domain of any size is spread over the tasks.
    """
    pairs = values.select(*keys, col).distinct()
    known = pairs.filter(F.col(col).isNotNull())
    coded = prefix_sums(text_buckets(known, col), keys, [col], {out: F.lit(1)}, inclusive=False).drop(BUCKET)
    coded = coded.withColumn(out, F.col(out).cast("int"))
    missing = pairs.filter(F.col(col).isNull())
    if not keys:
        return coded.unionByName(missing.withColumn(out, F.lit(known.count()).cast("int")))
    sizes = known.groupBy(*keys).agg(F.count("*").cast("int").alias(out))
    return coded.unionByName(missing.join(sizes, list(keys), "left").withColumn(out, F.coalesce(out, F.lit(0))))


def quantile_grid(
    counts: DataFrame, keys: Sequence[str], value: str, weights: Sequence[str], points: int, shrink: bool = True
) -> DataFrame:
    """`points` evenly spaced quantiles per key and weight.

    With `shrink`, a key with fewer rows than points gets one per row.

    One prefix-sum pass; each value then emits the grid positions that fall
    into its rank interval, in integer arithmetic. Returns (keys, weight, k,
    m, value), k in 0..m-1.
    """
    if not keys:
        raise ValueError("give at least one key, such as the feature name")
    vals = value_buckets(counts.filter(F.col(value).isNotNull()), value)
    totals = vals.groupBy(*keys).agg(*[F.sum(w).alias(f"_n_{w}") for w in weights])
    cum = prefix_sums(vals, keys, [value], {f"_c_{w}": w for w in weights}).join(totals, list(keys))
    per = F.explode(F.array(*[
        F.struct(F.lit(w).alias("weight"), F.col(f"_c_{w}").alias("b"), F.col(w).alias("c"), F.col(f"_n_{w}").alias("n"))
        for w in weights
    ]))
    rows = (
        cum.select(*keys, F.col(value).alias("_x"), per.alias("e")).select(*keys, "_x", "e.*").filter("c > 0")
        .withColumn("a", F.col("b") - F.col("c"))
        .withColumn("m", F.least(F.col("n"), F.lit(points).cast("bigint")) if shrink else F.lit(points).cast("bigint"))
    )
    # position of k is k * (n - 1) / (m - 1); a single row holds every position
    up = lambda z: F.expr(f"({z} + n - 2) div (n - 1)")
    down = lambda z: F.expr(f"({z}) div (n - 1)")
    many = (F.col("m") > 1) & (F.col("n") > 1)
    last = F.col("m") - 1
    rows = rows.withColumns({
        "lo_from": F.when(many, up("a * (m - 1)")).otherwise(F.lit(0)),
        "lo_to": F.when(many, up("b * (m - 1)") - 1).otherwise(last),
        "hi_from": F.when(many & (F.col("a") > 0), down("(a - 1) * (m - 1)") + 1).otherwise(F.lit(0)),
        "hi_to": F.when(many, down("(b - 1) * (m - 1)")).otherwise(last),
    })

    first = F.least("lo_from", "hi_from")
    final = F.least(F.greatest("lo_to", "hi_to"), last)
    ks = rows.filter(first <= final).withColumn("k", F.explode(F.sequence(first, final)))

    def hit(side: str) -> Column:
        return F.max(F.when(F.col("k").between(F.col(f"{side}_from"), F.col(f"{side}_to")), F.col("_x")))

    agg = ks.groupBy(*keys, "weight", "n", "m", "k").agg(hit("lo").alias("lo"), hit("hi").alias("hi"))
    frac = F.when(many, F.expr("(k * (n - 1)) % (m - 1)") / (F.col("m") - 1)).otherwise(F.lit(0.0))
    return agg.select(
        *keys, "weight", F.col("k").cast("int").alias("k"), F.col("m").cast("int").alias("m"),
        (F.col("lo") + (F.col("hi") - F.col("lo")) * frac).alias("value"),
    )
