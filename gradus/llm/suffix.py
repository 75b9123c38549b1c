"""Exact substring de-duplication by per-shard suffix arrays.

A byte goes if a string of 200 bytes that covers it also starts anywhere else. Whichever 64-byte gram of a 200-byte
string has the smallest hash is its anchor; equal strings have equal anchors at equal places, so only the
neighbourhoods of anchors met more than once can hold a repeat, and nothing else is looked at again:

* anchors whose whole neighbourhoods (every 200-byte string around the anchor) are equal are repeats throughout;
* of those that share the gram but not the neighbourhood, one piece of text per distinct neighbourhood goes to a shard
  by its gram. A shard sorts all suffixes of its pieces (Larsson-Sadakane refinement, Kasai common prefixes); runs with
  common prefixes of 200 bytes are repeats;
* a gram in more different neighbourhoods than a shard takes is dealt over several; their sorted strings are then
  merged by binary search.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gradus.llm.text import buffers, chunks, mix, prefix_hash, span_hash
from gradus.session import written

LENGTH = 200
GRAM = 64
SHARD_PIECES = 4096

ANCHOR = "tid bigint, at int, left int, right int, gram bigint, around bigint"
_LOW = np.uint64(0xFFFFFFFF)


def anchors(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of all anchors, the grams' hashes there and the prefix hashes of the chunk."""
    n = len(data)
    prefix = prefix_hash(data)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), prefix
    start = np.arange(n - gram + 1)
    g = span_hash(prefix, start, start + gram)
    low = (g & ~_LOW) | start.astype(np.uint64)
    span, width = length - gram + 1, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    step = np.zeros(n + 2, np.int64)
    long = np.diff(off) >= length
    np.add.at(step, off[:-1][long], 1)
    np.add.at(step, off[1:][long] - length + 1, -1)
    inside = np.cumsum(step[: len(low)]) > 0
    chosen = np.zeros(n, bool)
    chosen[(low[inside] & _LOW).astype(np.int64)] = True
    at = np.flatnonzero(chosen)
    return at, g[at], prefix


def _anchor_rows(wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in chunks(batch):
                at, g, prefix = anchors(data, off)
                doc = np.searchsorted(off, at, "right") - 1
                tid = part.column(0).to_numpy()[doc]
                place = at - off[doc]
                gram = pa.array(g.view(np.int64))
                if not wide:
                    seen = mix(tid.view(np.uint64) ^ mix(place.astype(np.uint64)))
                    yield pa.RecordBatch.from_arrays([gram, pa.array(seen.view(np.int64))], names=["gram", "seen"])
                    continue
                lo, hi = np.maximum(at - (LENGTH - GRAM), off[doc]), np.minimum(at + LENGTH, off[doc + 1])
                around = mix(span_hash(prefix, lo, hi, 9) ^ mix((at - lo).astype(np.uint64), 10))
                ints = [pa.array(x.astype(np.int32)) for x in (place, at - lo, hi - at)]
                yield pa.RecordBatch.from_arrays([pa.array(tid), *ints, gram, pa.array(around.view(np.int64))], names=["tid", "at", "left", "right", "gram", "around"])

    return run


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of an integer string whose last symbol is unique, by Larsson-Sadakane refinement.

    Suffixes are sorted by as many first symbols as one integer holds, then only those in groups of several by the rank
    as many further on, which doubles the length.
    """
    n = len(s)
    bits = int(s.max()).bit_length()
    h = 62 // bits
    padded = np.append(s, np.zeros(h, s.dtype))
    key = s.astype(np.int64)
    for j in range(1, h):
        key = key << bits | padded[j : j + n]
    sa = np.argsort(key)
    rank = np.empty(n, np.int64)
    head = np.concatenate([[True], key[sa[1:]] != key[sa[:-1]]])
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    open_ = np.flatnonzero(~head | ~np.append(head[1:], True))
    while len(open_):
        who = sa[open_]
        key = rank[who] * (n + 1) + rank[np.minimum(who + h, n - 1)]
        order = np.argsort(key)
        who, key = who[order], key[order]
        sa[open_] = who
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[who] = np.maximum.accumulate(np.where(new, open_, 0))
        open_ = open_[~new | ~np.append(new[1:], True)]
        h *= 2
    return sa, rank


def common_prefixes(s: np.ndarray, sa: np.ndarray, rank: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Kasai's common prefix lengths with the suffix before in order, all pieces [start, end) in lock step.

    Along a piece the length falls by one at most, so what was compared is not compared again; bytes are compared
    eight at a time. No common prefix reaches over a piece's end.
    """
    n = len(s)
    words = np.ndarray((n,), "<u8", np.append(s.astype(np.uint8), np.zeros(8, np.uint8)).tobytes(), strides=(1,)).copy()
    room = np.repeat(ends, ends - starts + 1) - np.arange(len(s))
    lcp = np.zeros(n, np.int64)
    lane = np.arange(len(starts))
    k = np.zeros(len(starts), np.int64)
    for j in range(int((ends - starts).max(initial=0))):
        lane = lane[starts[lane] + j < ends[lane]]
        i = starts[lane] + j
        r = rank[i]
        before = sa[np.maximum(r - 1, 0)]
        limit = np.where(r > 0, np.minimum(room[i], room[before]), 0)
        d = np.minimum(np.maximum(k[lane] - 1, 0), limit)
        live = np.flatnonzero(d < limit)
        while len(live):
            at = d[live]
            x = words[i[live] + at] ^ words[before[live] + at]
            same = np.where(x == 0, 8, (np.frexp((x & (~x + np.uint64(1))).astype(np.float64))[1] - 1) >> 3)
            at = np.minimum(at + same, limit[live])
            d[live] = at
            live = live[(same == 8) & (at < limit[live])]
        k[lane] = d
        lcp[r] = d
    return lcp


def repeats(pieces: list[bytes], origin: list[int], offset: list[int], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Strings of `length` bytes that start at two places or more of the texts the pieces come from.

    Returns (piece, start in its text) of all of them, and in the same order a run number and whether the string's run
    has two places; pieces of one text may overlap, the same place counts once.
    """
    size = np.array([len(p) for p in pieces])
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    s = np.empty(int(ends[-1]) + 1, np.int64)
    raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    s[:] = raw
    s[ends] = 256 + np.arange(len(pieces))
    sa, rank = suffix_array(s)
    lcp = common_prefixes(s, sa, rank, starts, ends)
    piece = np.searchsorted(ends, sa)
    whole = sa + length <= ends[np.minimum(piece, len(pieces) - 1)]
    run = np.cumsum(lcp < length)
    keep = np.flatnonzero(whole)
    piece, run = piece[keep], run[keep]
    place = sa[keep] - starts[piece] + np.array(offset, np.int64)[piece]
    if not len(keep):
        return piece, place, run, np.zeros(0, bool)
    seen = mix(np.array(origin, np.int64).view(np.uint64)[piece] ^ mix(place.astype(np.uint64)))
    first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    two = np.minimum.reduceat(seen, first) != np.maximum.reduceat(seen, first)
    return piece, place, run, np.repeat(two, np.diff(np.append(first, len(run))))


def _spans(tid: np.ndarray, start: np.ndarray, length: int = LENGTH) -> pd.DataFrame:
    """Runs of bytes that the strings starting at `start` cover."""
    order = np.lexsort((start, tid))
    tid, start = tid[order], start[order]
    new = np.ones(len(tid), bool)
    new[1:] = (tid[1:] != tid[:-1]) | (start[1:] > start[:-1] + length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(tid))[: len(first)] - 1
    return pd.DataFrame({"tid": tid[first], "lo": start[first].astype(np.int32), "hi": (start[last] + length).astype(np.int32)})


def _shard(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
    piece, place, _, two = repeats(x["text"].tolist(), x["tid"].tolist(), (x["at"] - x["left"]).tolist())
    return _spans(x["tid"].to_numpy()[piece[two]], place[two])


def _sorted_strings(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
    """Each distinct string of LENGTH bytes of a shard once, in the order of its hash: where it stands, and whether it repeats in the shard."""
    piece, place, run, two = repeats(x["text"].tolist(), x["tid"].tolist(), (x["at"] - x["left"]).tolist())
    raws = x["text"].tolist()
    off = np.concatenate([[0], np.cumsum([len(r) for r in raws])])
    prefix = prefix_hash(np.frombuffer(b"".join(raws), np.uint8))
    one = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, np.int64)
    piece, place, two = piece[one], place[one], two[one]
    s = off[piece] + place - (x["at"] - x["left"]).to_numpy()[piece]
    out = pd.DataFrame({
        "string": span_hash(prefix, s, s + LENGTH, 21).view(np.int64), "check": span_hash(prefix, s, s + LENGTH, 22).view(np.int64),
        "tid": x["tid"].to_numpy()[piece], "place": place.astype(np.int32), "repeats": two, "shard": int(key[0])})
    return out.sort_values("string")


def _merge(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
    """Strings that another shard's sorted run also holds, found in it by binary search."""
    runs = [r.sort_values(["string", "check"]).reset_index(drop=True) for _, r in x.groupby("shard")]
    keys = [np.rec.fromarrays([r["string"].to_numpy(), r["check"].to_numpy()]) for r in runs]
    twice = [np.zeros(len(r), bool) for r in runs]
    everything = np.sort(np.concatenate(keys))
    for r, k, t in zip(runs, keys, twice):
        t |= np.searchsorted(everything, k, "right") - np.searchsorted(everything, k, "left") > 1
    met = pd.concat([r[t & ~r["repeats"].to_numpy()] for r, t in zip(runs, twice)])
    others = pd.concat([r[t] for r, t in zip(runs, twice)])
    places = others.drop_duplicates(["string", "check", "tid", "place"]).groupby(["string", "check"]).agg(n=("tid", "size"), again=("repeats", "max"))
    met = met.join(places, on=["string", "check"])
    met = met[(met["n"] > 1) | met["again"]]
    return _spans(met["tid"].to_numpy(), met["place"].to_numpy().astype(np.int64))


def _cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["tid", "at", "left", "shard", "hot"]
    for batch in batches:
        data, off = buffers(batch.column(batch.schema.get_field_index("text")))
        cols = {n: batch.column(batch.schema.get_field_index(n)) for n in [*names, "right"]}
        at, left, right = (cols[n].to_numpy().astype(np.int64) for n in ("at", "left", "right"))
        lo, hi = off[:-1] + at - left, off[:-1] + at + right
        texts = [data[a:b].tobytes() for a, b in zip(lo, hi)]
        yield pa.RecordBatch.from_arrays([*[cols[n] for n in names], pa.array(texts, pa.binary())], names=[*names, "text"])


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(tid, lo, hi): byte spans of the texts (tid, text), tid distinct per text, that repeated strings cover; may overlap."""
    slim = texts.mapInArrow(_anchor_rows(False), "gram bigint, seen bigint")
    grams = slim.groupBy("gram").agg(F.min("seen").alias("a"), F.max("seen").alias("b")).filter("a <> b").select("gram")
    near = written(texts.mapInArrow(_anchor_rows(True), ANCHOR).join(grams, "gram"), "anchors")
    seen = F.xxhash64("tid", "at")
    kinds = near.groupBy("gram", "around").agg(F.min(seen).alias("a"), F.max(seen).alias("b"), F.min(F.struct("tid", "at", "left", "right")).alias("one"))
    kinds = written(kinds.select("gram", "around", (F.col("a") != F.col("b")).alias("settled"), "one.*"), "neighbourhoods")
    settled = near.join(kinds.filter("settled").select("gram", "around"), ["gram", "around"]).select("tid", (F.col("at") - F.col("left")).alias("lo"), (F.col("at") + F.col("right")).alias("hi"))
    per_gram = kinds.groupBy("gram").agg(F.count("*").alias("n"), F.bool_and("settled").alias("done")).filter("n > 1 and not done").drop("done")
    pieces = written(kinds.join(per_gram, "gram").drop("settled"), "pieces")
    shards = max(1, -(-pieces.count() // (SHARD_PIECES // 2)))
    hot = F.col("n") > SHARD_PIECES
    parts = F.ceil(F.col("n") / SHARD_PIECES).cast("int")
    spread = F.when(hot, F.xxhash64("gram", F.pmod(F.xxhash64("around"), parts))).otherwise(F.xxhash64("gram"))
    dealt = pieces.select("tid", "at", "left", "right", hot.alias("hot"), F.pmod(spread, F.lit(shards)).alias("shard"))
    holders = texts.join(dealt.select("tid").distinct(), "tid", "left_semi").dropDuplicates(["tid"])
    cut = dealt.join(holders, "tid").select("tid", "at", "left", "right", "shard", "hot", "text")
    cut = written(cut.mapInArrow(_cut_pieces, "tid bigint, at int, left int, shard bigint, hot boolean, text binary"), "shards")
    found = cut.groupBy("shard").applyInPandas(_shard, "tid bigint, lo int, hi int")
    strings = cut.filter("hot").groupBy("shard").applyInPandas(_sorted_strings, "string bigint, check bigint, tid bigint, place int, repeats boolean, shard bigint")
    ranges = strings.withColumn("range", F.floor(F.col("string") / F.lit(2.0**64 / shards)))
    again = ranges.groupBy("range").applyInPandas(_merge, "tid bigint, lo int, hi int")
    return settled.unionByName(found).unionByName(again)


def merged(spans: DataFrame) -> DataFrame:
    """(tid, spans): sorted disjoint byte spans of each text."""
    one = spans.groupBy("tid").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("s"))
    empty = F.array().cast("array<struct<lo:int,hi:int>>")

    def step(acc, p):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], p["hi"]).alias("hi"))))
        return F.when(F.size(acc) == 0, F.array(p)).when(p["lo"] <= F.try_element_at(acc, F.lit(-1))["hi"], joined).otherwise(F.concat(acc, F.array(p)))

    return one.select("tid", F.aggregate("s", empty, step).alias("spans"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = buffers(batch.column(1))
        spans = batch.column(2)
        tids, removed, runs, digests, kept = batch.column(0), [], [], [], []
        for i in range(batch.num_rows):
            own = np.asarray([(x["lo"], x["hi"]) for x in spans[i].as_py()], np.int64).reshape(-1, 2)
            own = own[np.argsort(own[:, 0], kind="stable")]
            top = np.maximum.accumulate(own[:, 1]) if len(own) else own[:, 1]
            new = np.concatenate([[True], own[1:, 0] > top[:-1]])
            lo = own[new, 0]
            hi = top[np.append(np.flatnonzero(new)[1:], len(own)) - 1]
            text = data[off[i] : off[i + 1]]
            edges = np.concatenate([[0], np.stack([lo, hi], 1).ravel(), [len(text)]])
            rest = b"".join(text[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2]))
            removed.append(int((hi - lo).sum()))
            runs.append(len(lo))
            digests.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        yield pa.RecordBatch.from_arrays([tids, pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())], names=["tid", "n_removed", "n_spans", "kept_sha256", "kept"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """(tid, n_removed, n_spans, kept_sha256, kept) of every distinct text that loses bytes, `kept` what is left of it."""
    texts = _texts(docs)
    spans = written(repeated_spans(texts.filter(f"octet_length(text) >= {LENGTH}")), "spans")
    copies = texts.groupBy("tid").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("size")).filter(f"n > 1 and size >= {LENGTH}")
    spans = spans.union(copies.select("tid", F.lit(0), "size"))
    per_text = spans.groupBy("tid").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    return texts.dropDuplicates(["tid"]).join(per_text, "tid").select("tid", "text", "spans").mapInArrow(_kept, "tid bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.xxhash64(text).alias("tid"), text.alias("text"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of `docs`.

    Rows with equal texts of LENGTH bytes or more lose all of them, whatever their ids; a null text is empty, and a
    shorter text loses nothing. Texts are told apart by a 64-bit hash. Columns other than doc_id and text are not read.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.xxhash64(text).alias("tid"), F.octet_length(text).cast("bigint").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    lost = written(deduplicated(docs).drop("kept"), "removed")
    zero = F.lit(0).cast("bigint")
    return base.join(lost, "tid", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
