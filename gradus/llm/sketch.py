"""Document fingerprints: threshold-scaled sketches of shingle hashes.

A sketch holds every distinct shingle hash below a fixed share of the hash range, so its size grows with the text,
sketches of parts merge by union, and containment between texts of very unequal length is estimated without bias.
All of it are array expressions on the row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gradus.plans.ordering import cut_points, value_buckets
from gradus.session import shuffle_partitions

BLANKS = " \t\n\x0b\x0c\r"
SHINGLE = 5
FRACTION_BITS = 2  # a quarter of all hashes is kept


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), lambda x: x != "")


def shingle_hashes(words: str, size: int) -> Column:
    """Hashes of the column's `size`-word shingles; a shorter text's whole sequence is one shingle, no words give none."""
    starts = F.slice(words, 1, F.greatest(F.size(words) - (size - 1), F.least(F.size(words), F.lit(1))))
    return F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(words, i + j) for j in range(1, size)]))


def retained(hashes: Column, bits: int) -> tuple[Column, Column]:
    """The distinct hashes in the lowest 2**-bits of the range, sorted, and the smallest of all."""
    bound = -(2**63) + 2 ** (64 - bits)
    low = F.sort_array(F.array_distinct(F.filter(hashes, lambda h: h < F.lit(bound))))
    return low, F.array_min(hashes)


def with_sketch(rows: DataFrame, text: str, out: str, size: int = SHINGLE, bits: int = FRACTION_BITS) -> DataFrame:
    """Adds the sketch of a text column as a sorted array of longs.

    A text of whose shingles none is below the threshold keeps its smallest, so that only a text without words has an
    empty sketch.
    """
    kept = rows.columns
    rows = rows.select(*kept, words_of(F.col(text)).alias("_w"))
    rows = rows.select(*kept, shingle_hashes("_w", size).alias("_h"))
    low, least = retained(F.col("_h"), bits)
    rows = rows.select(*kept, low.alias("_low"), least.alias("_least"))
    empty = F.array().cast("array<bigint>")
    sketch = F.when(F.size("_low") > 0, F.col("_low")).when(F.col("_least").isNotNull(), F.array("_least")).otherwise(empty)
    return rows.select(*kept, sketch.alias(out))


def merged(sketches: list[str], bits: int = FRACTION_BITS) -> Column:
    """The sketch of a text from those of its parts, equal to sketching the whole.

    The parts must hold all shingles of the text and no others, so neighbouring ones share the words of a shingle but
    one, and none is shorter than a shingle unless it is empty or the whole. A hash that
    a part kept only for want of one below the threshold goes if another part brings real ones; else the smallest stays.
    """
    every = F.array_sort(F.array_distinct(F.concat(*[F.col(c) for c in sketches])))
    low = F.filter(every, lambda h: h < F.lit(-(2**63) + 2 ** (64 - bits)))
    return F.when(F.size(low) > 0, low).otherwise(F.slice(every, 1, 1))


def resemblance(a: str, b: str) -> Column:
    """Estimated Jaccard similarity; 1 for two empty sketches."""
    shared = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - shared
    return F.when(every == 0, 1.0).otherwise(shared / every)


def containment(a: str, b: str) -> Column:
    """Estimated share of the first text's shingles that the second one has; 1 for an empty first."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def fingerprint(a: str) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def with_next(rows: DataFrame, order: str, carried: list[str]) -> DataFrame:
    """Adds `next_<c>` for each carried column: that of the next row by descending `order`, after the last the first.

    Rows are dealt once into ranges of `order`, whose bounds come from a quantile sketch of that column; a range's
    largest row is also dealt to the range above, where it follows that range's smallest. What reaches the driver is a
    bound and a largest value for each range, four ranges per shuffle partition. Equal values are ordered by a hash of
    the carried columns, nulls come last.
    """
    n = 4 * shuffle_partitions(rows.sparkSession)
    cuts = cut_points(rows.select(order), order, n)
    ranged = lambda df: value_buckets(df, order, cuts, "_range").withColumn("_range", F.when(F.col(order).isNull(), -1.0).otherwise(F.col("_range")))
    tops = ranged(rows.select(order)).groupBy("_range").agg(F.max(order).alias("top")).orderBy("_range").collect()
    if not tops:
        return rows.select("*", *[F.col(c).alias(f"next_{c}") for c in carried])
    above = [(tops[i]["top"], tops[(i + 1) % len(tops)]["_range"]) for i in range(len(tops))]
    kind = rows.schema[order].dataType.simpleString()
    ghosts = rows.sparkSession.createDataFrame(above, f"_top {kind}, _above double")
    dealt = ranged(rows).join(F.broadcast(ghosts), F.col(order).eqNullSafe(F.col("_top")), "left")
    copies = F.when(F.col("_above").isNull(), F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("ghost")))).otherwise(
        F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("ghost")), F.struct(F.col("_above").alias("r"), F.lit(True).alias("ghost"))))
    dealt = dealt.withColumn("_copy", F.explode(copies)).drop("_top", "_above")
    line = W.partitionBy("_copy.r").orderBy("_copy.ghost", F.desc_nulls_last(order), F.xxhash64(*carried))
    found = dealt.withColumns({f"next_{c}": F.lead(c).over(line) for c in carried})
    return found.filter("not _copy.ghost").drop("_range", "_copy")


def fingerprints(docs: DataFrame, size: int = SHINGLE, bits: int = FRACTION_BITS) -> DataFrame:
    """Sketches of every text and of its edited text, and their likeness.

    The edited text has the last half of the code points replaced by as many of the next document's first, by
    descending doc_id. A null text is empty; a text without words has an empty sketch, alike only to another empty
    one. Rows with equal ids are ordered by a hash of their text. Columns other than doc_id and text are not read.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(with_sketch(rows, "text", "sketch", size, bits), "doc_id", ["text", "sketch"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "sketch", "next_sketch", "edited", F.sha2("edited", 256).alias("edited_sha256"))
    rows = with_sketch(rows, "edited", "edited_sketch", size, bits).drop("edited")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint("sketch").alias("fingerprint"), fingerprint("edited_sketch").alias("edited_fingerprint"),
        resemblance("sketch", "edited_sketch").alias("near_edited"), resemblance("sketch", "next_sketch").alias("near_next"),
        containment("sketch", "edited_sketch").alias("within_edited"), containment("sketch", "next_sketch").alias("within_next"),
    )
