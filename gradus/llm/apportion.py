"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

The words of a source, its documents in a seeded hash order, form a line that is cut into blocks of equal length.
Blocks are seats: the source with the highest quotient target / (2 seats + 1) gets the next one. As such allocations
only grow with the number of seats, those at the bounds of the shards give each shard whole quotas. Which of its
blocks a source gives is a seeded permutation of the block numbers, which also deals them to the shards; each shard
fills its own quota from its own blocks. Blocks are arithmetic on positions and are never rows of their own.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gradus.llm.text import WORD
from gradus.plans.ordering import prefix_sums
from gradus.session import written

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 16
SHARDS = 16
SEED = 7
#: Primes; their product exceeds any block count, so one of them never divides it.
STRIDES = (999_983, 1_000_003, 1_000_033, 1_000_037)


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): words of the whole text, 0 for null."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    return docs.select("doc_id", "source", size.alias("size"))


def _name(source: str = "source") -> Column:
    """A key that is never null and sorts by code point, null last."""
    return F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """(name, source_size, weight, target): words wanted of each source, one row per source.

    All sizes together are shared by weight; a source stops at `repeats` times its size and the excess is shared by
    weight among the others. In the order of size per weight the sources that stop come first, so the level at which
    the rest shares is found by running sums over the sources.
    """
    by = sized.groupBy(_name().alias("name")).agg(F.sum("size").alias("source_size"))
    order = W.orderBy("name")
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    by = by.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), place)).withColumn("cap", F.col("source_size") * float(repeats))
    filling = W.orderBy(F.col("cap") / F.col("weight"), "name")
    before, everything = filling.rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by = by.withColumns({
        "total": F.sum("source_size").over(everything),
        "open_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "spent": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
    })
    by = by.withColumn("level", (F.col("total") - F.col("spent")) / F.col("open_weight"))
    stops = F.col("level") * F.col("weight") >= F.col("cap")
    # sources that stop are a prefix of the order, so the first that doesn't sets the level
    by = by.withColumn("shared", F.min(F.when(~stops, F.struct(F.col("cap") / F.col("weight"), "name", "level"))).over(everything)["level"])
    target = F.when(stops, F.col("cap")).otherwise(F.least(F.col("cap"), F.col("shared") * F.col("weight")))
    return by.select("name", "source_size", "weight", target.alias("target"))


def quotas(wanted: DataFrame, block: int = BLOCK_WORDS, shards: int = SHARDS, repeats: int = MAX_REPEATS) -> DataFrame:
    """(name, shard, seats_before, seats): whole blocks that each shard takes of each source.

    For the first k shards together seats are given by highest quotient. The rounded shares at the common divisor are
    at most half the number of sources away from the wanted sum; only the quotients of the seats in question are
    ranked. A source has at most `repeats` times its blocks.
    """
    wanted = wanted.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("bigint")).filter("target > 0")
    total = F.sum("target").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    wanted = wanted.withColumns({"total": total, "sources": F.count("*").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    seats = F.round(F.col("total") / block)
    ks = wanted.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(shards))))
    ks = ks.withColumn("seats_all", F.floor(seats * F.col("k") / shards).cast("bigint"))
    # all seats that every divisor near the common one gives: certain; the next ones are ranked by quotient
    ks = ks.withColumn("share", F.col("target") * F.col("seats_all") / F.col("total"))
    slack = F.ceil(F.col("sources") * F.col("target") / F.col("total")) + 1
    ks = ks.withColumn("sure", F.greatest(F.lit(0), F.floor(F.col("share")) - slack).cast("bigint"))
    ks = ks.withColumn("more", F.explode(F.sequence(F.lit(0).cast("bigint"), (2 * slack + 1).cast("bigint"))))
    ks = ks.withColumn("quotient", F.col("target") / (2 * (F.col("sure") + F.col("more")) + 1))
    by_k = W.partitionBy("k")
    ks = ks.withColumn("left", F.col("seats_all") - F.sum(F.when(F.col("more") == 0, F.col("sure"))).over(by_k))
    ks = ks.withColumn("rank", F.row_number().over(by_k.orderBy(F.desc("quotient"), "name", "more")))
    given = ks.groupBy("k", "name").agg(
        F.least(F.first("sure") + F.count(F.when(F.col("rank") <= F.col("left"), 1)), repeats * F.first("blocks")).alias("upto"))
    earlier = F.coalesce(F.lag("upto").over(W.partitionBy("name").orderBy("k")), F.lit(0))
    return given.select("name", (F.col("k") - 1).alias("shard"), earlier.alias("seats_before"), (F.col("upto") - earlier).alias("seats"))


def _stride(seed: int) -> Column:
    """A multiplier without a common factor with the block count: the first of some primes that doesn't divide it."""
    turned = STRIDES[seed % len(STRIDES) :] + STRIDES[: seed % len(STRIDES)]
    return F.coalesce(*[F.when(F.col("blocks") % p != 0, F.lit(p)) for p in turned]).cast("bigint")


def dealt(wanted: DataFrame, block: int = BLOCK_WORDS, shards: int = SHARDS, repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: the columns of `wanted`, blocks, and `shards`, an array of (shard, first, size, seats).

    Shard k holds the places first <= place < first + size of the source's permuted blocks, so sizes differ by one at
    most, and takes `seats` blocks of them. Its seats are its quota, moved to a neighbouring shard only where a shard
    would have to give a block more than `repeats` times; the source's sum stays.
    """
    seats = quotas(wanted, block, shards, repeats)
    per = wanted.withColumn("blocks", F.greatest(F.ceil(F.col("source_size") / block), F.lit(1)).cast("bigint"))
    rows = per.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(
        seats.select("name", "shard", (F.col("seats_before") + F.col("seats")).alias("upto")), ["name", "shard"], "left")
    by = W.partitionBy("name").orderBy("shard")
    bound = lambda k: F.floor(F.col("blocks") * k / F.lit(shards)).cast("bigint")
    rows = rows.withColumns({"first": bound(F.col("shard")), "last": bound(F.col("shard") + 1), "upto": F.coalesce("upto", F.lit(0).cast("bigint"))})
    # what the later shards cannot hold has to be given by here, and no more than the earlier ones can hold
    least = F.max("upto").over(W.partitionBy("name")) - repeats * (F.col("blocks") - F.col("last"))
    rows = rows.withColumn("upto", F.greatest("upto", least))
    slack = F.least(F.min(F.col("upto") - repeats * F.col("last")).over(by), F.lit(0))
    rows = rows.withColumn("upto", repeats * F.col("last") + slack)
    rows = rows.withColumn("seats", F.col("upto") - F.coalesce(F.lag("upto").over(by), F.lit(0)))
    cells = F.array_sort(F.collect_list(F.struct("shard", "first", (F.col("last") - F.col("first")).alias("size"), "seats")))
    return rows.groupBy(*wanted.columns, "blocks").agg(cells.alias("shards"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK_WORDS, repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of `docs`.

    `taken` counts the words that the mix takes of the row, repeats counted: a shard with b of a source's blocks and a
    quota of q gives every one of them q // b times and its first q % b once more. Rows without words take nothing;
    rows with equal ids are placed by (hash, id) and their order among equals does not change the sums.
    A null source is a source of its own. Reruns agree, since all order comes from hashes of ids.
    """
    base = written(sizes(docs).withColumn("name", _name()), "sizes")
    wanted = written(targets(base, weights, repeats), "targets")
    per = written(dealt(wanted, block, repeats=repeats), "quotas")
    lines = base.withColumn("order", F.xxhash64("doc_id", "size", F.lit(seed))).withColumn(
        "_bucket", F.call_function("shiftright", F.col("order"), F.lit(64 - 10)))
    ends = prefix_sums(lines.select("doc_id", "name", "size", "order", "_bucket", F.col("size").alias("end")), ["name"], ["order", "doc_id"], {"end": "end"})
    joined = ends.select("doc_id", "name", "size", "end").join(per, "name")
    joined = joined.withColumns({"start": F.col("end") - F.col("size"), "stride": _stride(seed), "shift": F.pmod(F.xxhash64("name", F.lit(seed)), F.lit(1 << 30))})
    place = lambda b: F.pmod(b * F.col("stride") + F.col("shift"), F.col("blocks"))
    shard = lambda p: F.get("shards", F.floor(((p + 1) * F.size("shards") - 1) / F.col("blocks")).cast("int"))
    given = lambda p, s: F.floor(s["seats"] / s["size"]) + F.when(p - s["first"] < F.pmod(s["seats"], s["size"]), 1).otherwise(0)
    inside = lambda b: F.least(F.col("end"), (b + 1) * block) - F.greatest(F.col("start"), b * block)
    numbers = F.sequence(F.floor(F.col("start") / block), F.floor((F.greatest("end", F.col("start") + 1) - 1) / block))
    parts = F.transform(numbers, lambda b: F.struct(inside(b).alias("words"), place(b).alias("place")))
    parts = F.transform(parts, lambda x: F.struct(x["words"], x["place"], shard(x["place"]).alias("shard")))
    words = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a + x["words"] * given(x["place"], x["shard"]))
    taken = F.when(F.col("size") > 0, words).otherwise(0)
    return joined.select("doc_id", "size", "source_size", "target", taken.cast("bigint").alias("taken"))
