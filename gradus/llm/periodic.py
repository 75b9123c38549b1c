"""Periodic runs of words by online sparse diagonal dynamic programming.

A run of period q is a diagonal of equal words: word i equals word i - q all along it. Going through a text, each word's
earlier occurrences name the diagonals on which it matches; the match length of each is one more than at the word
before, and a diagonal that a word does not continue ends there and emits its run if that is long enough. Three things
keep the table of active diagonals sparse. A run of period q has 3 q matches in a row, so occurrences are those of the
last words together: five for lags below 4, 12 for those below 16, 48 below 64, and so on, a pass each. An
occurrence further back than the pass's lags is not looked at. And a diagonal is left out where a shorter one has
matched for at least its lag: there the text has the shorter period, and so has every run of the longer one that reaches
back so far. A run's first words may be missed so; they are found when it ends.
"""
from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gradus.llm.text import chunks, mix, prefix_hash, span_hash, words

LEAST_WORDS = 6
LEAST_POWERS = 4
GRAM = 5  # matches in a row that every run has: LEAST_WORDS - 1, or (LEAST_POWERS - 1) * q from q = 2 on
LAGS = 4  # a pass's lags reach so many times as far as those of the one before

RUNS = "doc_id bigint, n_words bigint, starts array<bigint>, lengths array<bigint>, periods array<bigint>, collapsed binary"


def _primitive(w: list, start: int, q: int) -> bool:
    """Whether the q words from `start` are no repetition of fewer words."""
    block, rest, d = w[start : start + q], q, 2
    while rest > 1:
        if d * d > rest:
            d = rest
        if rest % d:
            d += 1
            continue
        step = q // d
        if block[step:] == block[: q - step]:
            return False
        while rest % d == 0:
            rest //= d
    return True


def _run(w: list, low: int, first: int, end: int, q: int) -> tuple[int, int, int] | None:
    """The run whose matches on diagonal q include [first, end) and end there, if it is one; the text starts at `low`."""
    while first - q > low and w[first - 1] == w[first - 1 - q]:
        first -= 1
    start = first - q
    if end - start < max(LEAST_WORDS, LEAST_POWERS * q) or not _primitive(w, start, q):
        return None
    return start - low, end - start, q


def _diagonals(w: list, at: list[int], rank: list[int], first: list[int], places: list[int], gram: int, reach: int) -> Iterator[tuple[int, int, int]]:
    """(first match, end, lag) of the diagonals of lags below `reach`, as far as they were followed, when they end.

    The grams that end at the positions `at`, ascending, stood earlier at places[first : rank].
    """
    active: dict[int, int] = {}
    before = -2
    for i, r, low in zip(at, rank, first):
        if active and i != before + 1:
            yield from ((before + 1 - m, before + 1, q) for q, m in active.items())
            active = {}
        now: dict[int, int] = {}
        longest, k = 0, r - 1
        while k >= low and (q := i - places[k]) < reach:
            if longest >= q:  # these lags are covered by a shorter period
                k = bisect_right(places, i - longest - 1, low, k) - 1
                continue
            m = now[q] = active.get(q, gram - 1) + 1
            longest = max(longest, m)
            k -= 1
        for q, m in active.items():
            if q not in now and w[i] != w[i - q]:
                yield i - m, i, q
        active, before = now, i
    yield from ((before + 1 - m, before + 1, q) for q, m in active.items())


def planted(n: int, h: int) -> np.ndarray | None:
    """The word that stands at each place of a text of n words which the rule of hash h makes periodic, or None."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def text_runs(hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each document of a chunk, by start, then period; a word is its hash."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n_docs)]
    starts = np.searchsorted(doc, np.arange(n_docs + 1))
    most, prefix = np.diff(starts) // LEAST_POWERS, prefix_hash(hashes)
    w: list[int] = []
    least, reach, gram = 1, LAGS, GRAM
    ends = np.arange(len(hashes))
    while len(ends):
        ends = ends[ends >= gram - 1]
        ends = ends[(doc[ends - gram + 1] == doc[ends]) & (most[doc[ends]] >= least)]
        grams = mix(span_hash(prefix, ends - gram + 1, ends + 1) ^ mix(doc[ends].astype(np.uint64), 71))
        order = np.argsort(grams, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = grams[order[1:]] != grams[order[:-1]]
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        places = ends[order]
        rank = 1 + np.flatnonzero(~new[1:] & (places[1:] - places[:-1] < reach))
        if len(rank):
            rank = rank[np.argsort(places[rank])]
            w = w or hashes.tolist()
            for a, b, q in _diagonals(w, places[rank].tolist(), rank.tolist(), first[group[rank]].tolist(), places.tolist(), gram, reach):
                if least <= q <= most[d := doc[a]] and (run := _run(w, int(starts[d]), a, b, q)):
                    out[d].append(run)
        ends = np.sort(places[np.diff(np.append(first, len(order)))[group] > 1])  # a longer gram stands twice only if this one does
        least, reach, gram = reach, reach * LAGS, (LEAST_POWERS - 1) * reach
    return [sorted(r, key=lambda r: (r[0], r[2])) for r in out]


def _scan(plant: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in chunks(batch):
                ids = part.column(0).to_pylist()
                start, end, doc = words(data, off)
                hashes = span_hash(prefix_hash(data), start, end)
                at = np.searchsorted(doc, np.arange(part.num_rows + 1))
                moved: dict[int, np.ndarray] = {}
                if plant:
                    for d, i in enumerate(ids):
                        place = None if i is None else planted(int(at[d + 1] - at[d]), zlib.crc32(str(i).encode()))
                        if place is not None:
                            moved[d] = place
                            hashes[at[d] : at[d + 1]] = hashes[at[d] + place]
                found = text_runs(hashes, doc, part.num_rows)
                raw, texts = data.tobytes(), []
                for d in range(part.num_rows):
                    w = raw[off[d] : off[d + 1]].split()  # at the same separators
                    if d in moved:
                        w = [w[k] for k in moved[d].tolist()]
                    if found[d]:
                        kept = np.ones(len(w), bool)
                        for s, length, q in found[d]:
                            kept[s + q : s + length] = False
                        w = [w[k] for k in np.flatnonzero(kept).tolist()]
                    texts.append(b" ".join(w))
                columns = [pa.array(ids, pa.int64()), pa.array(np.diff(at), pa.int64())]
                columns += [pa.array([[r[j] for r in rs] for rs in found], pa.list_(pa.int64())) for j in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary())], names=["doc_id", "n_words", "starts", "lengths", "periods", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """A row per document: its runs (starts, lengths, periods; by start, then period) and the words kept, joined by a space.

    A run is a stretch of words with smallest period q, of at least LEAST_WORDS words and LEAST_POWERS * q, that neither
    neighbour extends. The words of a run after its first q are left out of `collapsed`. With `plant`, a tenth of the
    texts, chosen by the checksum of the id, are made periodic first by the rule of `planted`; a null id is never.
    A null or empty text has no words and no runs. Equal rows have a row each, extra columns are ignored, an empty table
    gives none. Rows are not shuffled; a task holds a chunk of texts or one long text.
    """
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return slim.mapInArrow(_scan(plant), RUNS)


def digest(found: DataFrame) -> DataFrame:
    """A row per document with its longest run and checksums of all runs and of the words kept."""
    order = F.transform(F.arrays_zip("starts", "lengths", "periods"), lambda r: F.struct((-r["lengths"]).alias("l"), r["starts"].alias("s"), r["periods"].alias("q")))
    lines = F.transform(F.arrays_zip("starts", "lengths", "periods"), lambda r: F.concat_ws(",", r["starts"].cast("string"), r["lengths"].cast("string"), r["periods"].cast("string")))
    listing = F.concat(F.array_join(lines, "\n"), F.when(F.size("starts") > 0, F.lit("\n")).otherwise(F.lit("")))
    best = found.withColumn("top", F.array_min(order)).withColumn("runs_sha256", F.sha2(listing, 256))
    length, q = -F.col("top.l"), F.col("top.q")
    return best.select(
        "doc_id", F.size("starts").cast("bigint").alias("n_runs"), F.col("top.s").alias("start"), length.alias("length"), q.alias("period"),
        F.floor(length * 1000 / q).cast("bigint").alias("exponent_milli"), "runs_sha256", F.sha2("collapsed", 256).alias("collapsed_sha256"))
