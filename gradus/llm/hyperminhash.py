"""Near-duplicate classes by HyperMinHash: compressed registers, banding, corrected estimates, exact verification.

One hash deals a text's shingles into 256 buckets; a bucket stores the leading-zero count and nine mantissa bits of
its smallest hash. A text with few shingles enters each of them under several seeds, which leaves the Jaccard
similarity of two such sets as it was, so that about four or more values fall into each bucket. The number of seeds
depends on the set's size only; a text whose partner may have the next number of seeds gets a sketch for both.

Registers are banded six by six. A text at similarity 0.8 shares a given band with probability 0.26 and none of 42
with 3e-6. In a band's group every member is held against the group's smallest id. Texts that bands connect are a family;
families that then still hold several components are compared further, in blocks, across components only. A pair whose
corrected estimate is not five standard deviations below the threshold is confirmed on the full sets.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gradus.llm.components import components
from gradus.llm.text import buffers, chunks, grouped, mix, shingle_sets
from gradus.session import written, written_keys

REGISTERS, ROWS, MANTISSA, VALUE_BITS = 256, 6, 9, 52
BANDS = REGISTERS // ROWS
FILL = 4 * REGISTERS
EMPTY = np.uint16(0xFFFF)
MIN_PERCENT = 80
BLOCK = 1000

SKETCH = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, seeds int, own boolean, sketch binary, bands array<bigint>"


def seeds_for(n: np.ndarray) -> np.ndarray:
    """Power of two of seeds under which a set of n shingles fills the buckets."""
    need = np.maximum(1.0, FILL / np.maximum(n, 1))
    return (2 ** np.ceil(np.log2(need))).astype(np.int64)


def registers(hashes: np.ndarray, row: np.ndarray, n_rows: int, seeds: np.ndarray) -> np.ndarray:
    """Registers of each row's set: leading zeros above the mantissa, EMPTY without a value."""
    low = np.full(n_rows * REGISTERS, np.uint64(1 << VALUE_BITS), np.uint64)
    own = seeds[row]
    for count in np.unique(own):
        take = np.flatnonzero(own == count)
        salt = mix(np.arange(count, dtype=np.uint64), 1000)
        step = max(1, (1 << 18) // int(count))
        for at in range(0, len(take), step):
            part = take[at : at + step]
            v = mix(hashes[part][:, None] ^ salt)
            slot = (row[part] * REGISTERS)[:, None] + (v >> np.uint64(56)).astype(np.int64)
            np.minimum.at(low, slot.ravel(), (v & np.uint64((1 << VALUE_BITS) - 1)).ravel())
    bits = np.frexp(low.astype(np.float64))[1]
    shift = bits - 1 - MANTISSA
    up, down = np.maximum(-shift, 0).astype(np.uint64), np.maximum(shift, 0).astype(np.uint64)
    mantissa = ((low >> down) << up) & np.uint64((1 << MANTISSA) - 1)
    out = ((VALUE_BITS - bits).astype(np.int64) << MANTISSA | mantissa.astype(np.int64)).astype(np.uint16)
    out[low == np.uint64(1 << VALUE_BITS)] = EMPTY
    return out.reshape(n_rows, REGISTERS)


def band_keys(reg: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each band of each row, and which bands hold a value."""
    parts = reg[:, : BANDS * ROWS].reshape(len(reg), BANDS, ROWS)
    key = np.zeros((len(reg), BANDS), np.uint64)
    for j in range(ROWS):
        key = mix(key ^ parts[:, :, j].astype(np.uint64), j + 1)
    place = np.arange(BANDS, dtype=np.uint64)[None, :] << np.uint64(32) | seeds.astype(np.uint64)[:, None]
    return mix(key ^ mix(place), 77), (parts != EMPTY).any(axis=2)


def _expected_collision() -> float:
    """Chance that the smallest values of two unrelated sets of like size share a register."""
    edges = np.concatenate([2.0 ** -(z + 1) * (1 + np.arange(2**MANTISSA) / 2**MANTISSA) for z in range(40)])
    edges = np.append(np.sort(edges), 1.0)
    tops = [np.exp(-edges[:-1] * n) - np.exp(-edges[1:] * n) for n in np.geomspace(FILL / REGISTERS, 2 * FILL / REGISTERS, 9)]
    return float(np.mean([np.sum(p * p) for p in tops]))


COLLISION = _expected_collision()


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of register rows, less the matches that unrelated sets would have."""
    full = (a != EMPTY) | (b != EMPTY)
    share = ((a == b) & full).sum(axis=-1) / np.maximum(full.sum(axis=-1), 1)
    return (share - COLLISION) / (1 - COLLISION)


def least_estimate(percent: int) -> float:
    s = percent / 100
    return s - 5 * (s * (1 - s) / REGISTERS) ** 0.5


def _sketcher(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in chunks(batch):
                h, doc = shingle_sets(data, off, size)
                n = np.bincount(doc, minlength=part.num_rows)
                set_a, set_b = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                np.add.at(set_a, doc, mix(h, 5001))
                np.add.at(set_b, doc, mix(h, 5002))
                mine, lower = seeds_for(n), seeds_for(np.maximum(1, np.ceil(n * percent / 100)))
                for own, seeds, rows in ((True, mine, np.arange(len(n))), (False, lower, np.flatnonzero((lower != mine) & (n > 0)))):
                    at = np.full(len(n), -1)
                    at[rows] = np.arange(len(rows))
                    use = at[doc] >= 0
                    reg = registers(h[use], at[doc[use]], len(rows), seeds[rows])
                    keys, held = band_keys(reg, seeds[rows])
                    offsets = np.concatenate([[0], np.cumsum(held.sum(axis=1))]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(pa.array(rows)), pa.array(n[rows]), pa.array(set_a[rows].view(np.int64)), pa.array(set_b[rows].view(np.int64)),
                            pa.array(seeds[rows].astype(np.int32)), pa.array(np.full(len(rows), own)), pa.array([r.tobytes() for r in reg], pa.binary()),
                            pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[held].view(np.int64))),
                        ],
                        names=["doc_id", "n_shingles", "set_a", "set_b", "seeds", "own", "sketch", "bands"],
                    )

    return run


def sketches(docs: DataFrame, size: int = 2, percent: int = MIN_PERCENT) -> DataFrame:
    """Registers and band keys of every text; a second row (`own` false) where partners may have fewer shingles' seeds."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_sketcher(size, percent), SKETCH)


def _close(percent: int):
    least = least_estimate(percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                a = np.frombuffer(b"".join(x["sketch_a"]), np.uint16).reshape(len(x), REGISTERS)
                b = np.frombuffer(b"".join(x["sketch_b"]), np.uint16).reshape(len(x), REGISTERS)
                yield x.loc[estimate(a, b) >= least, ["a", "b"]]

    return run


def _verifier(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in chunks(batch, "text_b"):
                other, other_off = buffers(part.column(part.schema.get_field_index("text_a")))
                ha, da = shingle_sets(other, other_off, size)
                hb, db = shingle_sets(data, off, size)
                na, nb = np.bincount(da, minlength=part.num_rows), np.bincount(db, minlength=part.num_rows)
                h, d = np.concatenate([ha, hb]), np.concatenate([da, db])
                order = np.lexsort((h, d))
                h, d = h[order], d[order]
                twice = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
                both = np.bincount(d[1:][twice], minlength=part.num_rows)
                ok = (both > 0) & (100 * both >= percent * (na + nb - both))
                yield part.select(["a", "b"]).filter(pa.array(ok))

    return run


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose full shingle sets reach the threshold."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").filter("id is not null and text is not null")
    pairs = written(pairs.select("a", "b"), "pairs")
    texts = texts.join(written_keys(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids"), "id", "left_semi")
    one = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(_verifier(size, percent), "a bigint, b bigint")


def _linker(size: int, percent: int):
    """Links between components within each group of two sides; a link that joins nothing new is not looked for.

    Two texts are estimated under the number of seeds that both have a sketch for; without one, their sizes differ too much.
    """
    least = least_estimate(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for group in grouped(batches, 3):
            side, ids, component = (group.column(n).to_numpy() for n in ("side", "doc_id", "component"))
            seeds, more = (group.column(n).to_numpy() for n in ("seeds", "more_seeds"))
            reg, more_reg = (np.frombuffer(b"".join(group.column(n).to_pylist()), np.uint16).reshape(-1, REGISTERS) for n in ("sketch", "more_sketch"))
            second = np.cumsum(more > 0) - 1  # row of a text's sketch for partners of the next number of seeds
            alone = group.column("alone")[0].as_py()
            left, right = (np.arange(len(ids)),) * 2 if alone else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
            pairs: list[tuple[float, int, int]] = []
            for x in left:
                near = np.full(len(right), -np.inf)
                same, ahead, behind = seeds[right] == seeds[x], seeds[right] == more[x], more[right] == seeds[x]
                near[same] = estimate(reg[x][None, :], reg[right[same]])
                if ahead.any():
                    near[ahead] = estimate(more_reg[second[x]][None, :], reg[right[ahead]])
                if behind.any():
                    near[behind] = estimate(reg[x][None, :], more_reg[second[right[behind]]])
                for y in np.flatnonzero((near >= least) & (component[right] != component[x])):
                    if not alone or right[y] > x:
                        pairs.append((-near[y], int(x), int(right[y])))
            if not pairs:
                continue
            used = np.unique([p[1:] for p in pairs])
            data, off = buffers(group.column("text").take(pa.array(used)))
            h, d = shingle_sets(data, off, size)
            ends = np.searchsorted(d, np.arange(len(used) + 1))
            sets = {int(u): h[ends[k] : ends[k + 1]] for k, u in enumerate(used)}
            root: dict[int, int] = {}

            def find(c: int) -> int:
                while root.get(c, c) != c:
                    c = root[c]
                return c

            for _, x, y in sorted(pairs):
                a, b = find(int(component[x])), find(int(component[y]))
                if a == b:
                    continue
                n, m = len(sets[x]), len(sets[y])
                if 100 * min(n, m) < percent * max(n, m):
                    continue
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * both >= percent * (n + m - both):
                    root[max(a, b)] = min(a, b)
                    out.append((int(ids[x]), int(ids[y])))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _open_groups(families: DataFrame, labels: DataFrame) -> DataFrame:
    """(family, i, j, side, alone, doc_id, component): which texts of a family are still to be held against each other.

    Only texts of different components are. The largest component of a family is dealt into blocks, each of which
    meets the blocks of all other texts; the blocks of the others meet each other. Families of one component, and of
    two texts, are done.
    """
    placed = families.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    parts = placed.groupBy("family", "component").agg(F.count("*").alias("n"))
    most = parts.groupBy("family").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), F.count("*").alias("components"))
    most = most.filter("components > 1 and all > 2").select(
        "family", F.col("main.component").alias("main"), F.ceil(F.col("main.n") / BLOCK).cast("int").alias("main_blocks"),
        F.ceil((F.col("all") - F.col("main.n")) / BLOCK).cast("int").alias("other_blocks"))
    rows = placed.join(most, "family").withColumn("is_main", F.col("component") == F.col("main"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.when(F.col("is_main"), F.col("main_blocks")).otherwise(F.col("other_blocks"))).cast("int"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    meets = lambda c, side, key: F.transform(upto(c), lambda k: F.struct(*key(k), F.lit(side).alias("side"), F.lit(False).alias("alone")))
    main = meets("other_blocks", 0, lambda k: (F.col("block").alias("i"), k.alias("j")))
    other = meets("main_blocks", 1, lambda k: (k.alias("i"), F.col("block").alias("j")))
    among = F.transform(upto("other_blocks"), lambda k: F.struct(
        (-1 - F.least("block", k)).alias("i"), F.greatest("block", k).alias("j"), (F.col("block") > k).cast("int").alias("side"), (F.col("block") == k).alias("alone")))
    return rows.withColumn("to", F.explode(F.when(F.col("is_main"), main).otherwise(F.concat(other, among)))).select("family", "to.*", "doc_id", "component")


def classes(docs: DataFrame, sketch: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, component) of the class representatives that are linked with another.

    `sketch` is the written table of `sketches`. Texts with equal sets are one class, held by its smallest id.
    """
    own = sketch.filter("own and n_shingles > 0 and doc_id is not null")
    heads = own.groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    heads = written(sketch.filter("n_shingles > 0").join(heads, "doc_id", "left_semi"), "heads")
    rows = heads.select("doc_id", "n_shingles", F.explode("bands").alias("band"))
    groups = rows.groupBy("band").agg(F.min("doc_id").alias("center"), F.max("doc_id").alias("last")).filter("center < last").drop("last")
    members = written(rows.join(groups, "band"), "members")
    star = members.filter("doc_id <> center").select(F.col("center").alias("a"), F.col("doc_id").alias("b")).distinct()
    size_of = heads.groupBy("doc_id").agg(F.max("n_shingles").alias("n"))
    star = star.join(size_of.withColumnsRenamed({"doc_id": "a", "n": "na"}), "a").join(size_of.withColumnsRenamed({"doc_id": "b", "n": "nb"}), "b")
    star = star.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b")
    by_seeds = heads.select("doc_id", "seeds", "sketch")
    close = (
        star.join(by_seeds.withColumnsRenamed({"doc_id": "a", "sketch": "sketch_a"}), "a")
        .join(by_seeds.withColumnsRenamed({"doc_id": "b", "sketch": "sketch_b"}), ["b", "seeds"])
        .select("a", "b", "sketch_a", "sketch_b").mapInPandas(_close(percent), "a bigint, b bigint").distinct()
    )
    first = written(verified(close, docs, size, percent), "verified")
    labels = written(components(first), "components")
    near = components(members.filter("doc_id <> center").select(F.col("center").alias("a"), F.col("doc_id").alias("b")))
    groups = written(_open_groups(near.select(F.col("node").alias("doc_id"), F.col("component").alias("family")), labels), "open")
    if groups.isEmpty():
        return labels
    ids = written_keys(groups.select("doc_id").distinct(), "ids")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    one = F.struct("seeds", "sketch")
    tops = heads.groupBy("doc_id").agg(F.max(F.when(F.col("own"), one)).alias("s"), F.max(F.when(~F.col("own"), one)).alias("t"))
    tops = tops.select("doc_id", "s.seeds", "s.sketch", F.coalesce("t.seeds", F.lit(0)).alias("more_seeds"), F.coalesce("t.sketch", F.lit(b"")).alias("more_sketch"))
    dealt = groups.join(texts, "doc_id").join(tops, "doc_id").select(
        "family", "i", "j", "side", "alone", "doc_id", "component", "seeds", "sketch", "more_seeds", "more_sketch", "text")
    dealt = dealt.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "doc_id")
    more = dealt.mapInArrow(_linker(size, percent), "a bigint, b bigint")
    return components(first.union(more))


def near_duplicates(docs: DataFrame, size: int = 2, percent: int = MIN_PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of `docs`.

    Documents are linked if 100 * |A and B| >= percent * |A or B| on their distinct `size`-word shingles, letters A-Z
    lowered; a shorter text's whole sequence is its one shingle. component_id is the smallest id reachable. A text
    without words (null, empty) is linked with nothing. Rows with equal ids are one document; a row without id has
    no component and kept is null. Other columns are not read.
    """
    sketch = written(sketches(docs, size, percent), "sketches")
    found = classes(docs, sketch, size, percent)
    own = sketch.filter("own").select("doc_id", "n_shingles", "set_a", "set_b")
    heads = own.filter("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("head"))
    joined = own.join(heads, ["n_shingles", "set_a", "set_b"], "left").join(found.withColumnRenamed("node", "head"), "head", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "head", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
