"""Near-duplicate passages by compact windows.

Every passage of blocks of words is represented by the smallest hash among its blocks. The Cartesian tree of the hashes
groups passages by it: the node at position c stands for all passages within [l, r] that hold c, where l and r reach to
the next smaller values. Only nodes that span a passage of the least length are kept, about 2 / 6 per word.

A passage that is alike to another holds a stretch of RUN words that stands in both: at similarity 0.8 a change costs
at least four shingles of one text, so at least four times as many are shared for each (the least is met by phrases of four
words that are doubled in place; changed, new and lost words leave 24). Both texts keep the node of the smallest block of that
stretch, so they meet in the group of its hash.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from gradus.llm.components import components
from gradus.llm.text import CHUNK_BYTES, buffers, chunks, fresh, grouped, lower_ascii, mix, shingles, word_hashes, words
from gradus.session import written, written_keys

SIZE = 5
MIN_WORDS = 50
RUN, BLOCK = 16, 12  # words of the stretch that alike passages share, and of a block
SIMILARITY = 0.8
JOIN_GAP = 2 * SIZE
SMALL = 32  # members of a group whose pairs are rows
CELL = 1000
AROUND = MIN_WORDS - SIZE
LEAST = MIN_WORDS - SIZE + 1  # shingles of a shortest passage
DENSE = -int(-SIMILARITY * LEAST // 1)  # of them shared
LOOPED = 256  # different shingles, at most, of a text that takes them along into the cells
FAR = 84  # 5 x the shingles of a shortest passage that one text has alone + 4 x the other's, near some node of alike passages; 82 at most, by one gap

PAIR = "doc_id bigint, first_id bigint, starts array<int>, ends array<int>, first_starts array<int>, first_ends array<int>"


def _nearest_smaller(v: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value to the left in the same document, or -1, by pointer jumping."""
    n = len(v)
    at = np.arange(n) - 1
    at[np.flatnonzero(doc[1:] != doc[:-1]) + 1] = -1
    at[:1] = -1
    live = np.flatnonzero(at >= 0)
    while len(live):
        live = live[v[at[live]] > v[live]]
        at[live] = at[at[live]]
        live = live[at[live] >= 0]
    return at


def compact_windows(values: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions c, l, r (inclusive) of the Cartesian tree's nodes that span at least `least` positions."""
    n = len(values)
    none = np.zeros(0, np.int64)
    if n < least:
        return none, none, none
    mask = np.uint64((1 << n.bit_length()) - 1)
    v = (values & ~mask) | np.arange(n, dtype=np.uint64)
    low, width = v, 1
    while 2 * width <= least:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if least > width:
        low = np.minimum(low[: len(low) - (least - width)], low[least - width :])
    whole = doc[: n - least + 1] == doc[least - 1 :]
    node = np.zeros(n, bool)
    node[(low[whole] & mask).astype(np.int64)] = True
    c = np.flatnonzero(node)
    d, vc = doc[c], v[c]
    first, last = np.searchsorted(doc, d, "left"), np.searchsorted(doc, d, "right") - 1
    before = _nearest_smaller(vc, d)
    after = len(c) - 1 - _nearest_smaller(vc[::-1], d[::-1])[::-1]
    l = np.where(before >= 0, c[before] + 1, first)
    r = np.where(after < len(c), c[np.minimum(after, len(c) - 1)] - 1, last)
    return c, l, r


def _text_shingles(data: np.ndarray, off: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every full shingle; position within the document is the first word's."""
    h, doc, _, _ = word_hashes(lower_ascii(data), off)
    s, d, _ = shingles(h, doc, len(off) - 1, size)
    count = np.bincount(doc, minlength=len(off) - 1)
    full = count[d] >= size
    return s[full], d[full]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, off in chunks(batch):
            s, d = _text_shingles(data, off, BLOCK)
            v = mix(s, 300)
            c = compact_windows(v, d, RUN - BLOCK + 1)[0]
            at = c - np.searchsorted(d, np.arange(part.num_rows))[d[c]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v[c].view(np.int64)), part.column(0).take(pa.array(d[c])), pa.array(at.astype(np.int32))], names=["key", "doc_id", "c"])


def fewest(s: np.ndarray) -> int:
    """A bound from below of how many different shingles a passage of this text holds: of any LEAST, those not repeated that close."""
    if len(s) < LEAST:
        return LEAST
    order = np.argsort(s, kind="stable")
    again = (s[order][1:] == s[order][:-1]) & (np.diff(order) < LEAST)
    near = np.zeros(len(s) + 1, np.int64)
    near[order[1:][again] + 1] = 1
    near = np.cumsum(near)
    return LEAST - int((near[LEAST:] - near[:-LEAST]).max())


def passages(
    mine: np.ndarray, other: np.ndarray, regions: list[tuple[int, int]], order: np.ndarray | None = None, fewest: int = 0, distinct: bool = False
) -> list[tuple[int, int, int, int]]:
    """Word spans [start, end) in a text and in the other that are alike: at least MIN_WORDS words, Jaccard of their shingles at least SIMILARITY.

    Shared shingles are chained along a diagonal over gaps that a changed word or two leave; a chain that is not alike
    enough is cut at its gaps. Beyond that, stretches over any gap are taken that are alike as a whole.

    `order` sorts `other`; `fewest` is that of `mine`. A passage shares SIMILARITY of so many different shingles at
    least. If `mine` repeats none (`distinct`), it falls into parts of LEAST to 2 * LEAST - 1 of which one shares that much.
    """
    order = np.argsort(other, kind="stable") if order is None else order
    ranked = other[order]
    found: list[tuple[int, int, int, int]] = []
    for lo, hi in regions:
        part = mine[lo:hi]
        at = np.minimum(np.searchsorted(ranked, part), len(ranked) - 1)
        hit = np.flatnonzero(ranked[at] == part)
        if len(hit) < 2 or len(hit if distinct else np.unique(part[hit])) < SIMILARITY * fewest:
            continue
        if distinct and not (hit[DENSE - 1 :] - hit[: max(len(hit) - DENSE + 1, 0)] < 2 * LEAST - 1).any():
            continue
        pos, there = hit + lo, _partners(hit + lo, at[hit], np.searchsorted(ranked, part[hit], "right"), order)
        turn = (np.diff(pos) > JOIN_GAP + 1) | (np.abs(np.diff(there - pos)) > JOIN_GAP)
        exact = (np.diff(pos) > 1) | (np.diff(there - pos) != 0)
        for a, b in _long_parts(pos, np.flatnonzero(turn) + 1, 0, len(pos)):
            whole = _alike(mine, other, pos[a:b], there[a:b])
            if whole:
                found.append(whole)
                continue
            for x, y in _long_parts(pos, np.flatnonzero(exact[a : b - 1]) + a + 1, a, b):
                found += [run for run in [_alike(mine, other, pos[x:y], there[x:y])] if run]
        steady = _steady(pos, there)
        for keep in (slice(None), steady) if not steady.all() else (slice(None),):
            found += _stretches(mine, other, pos[keep], there[keep])
    return sorted(set(found))


def _long_parts(pos: np.ndarray, cuts: np.ndarray, first: int, end: int) -> list[tuple[int, int]]:
    """The parts of [first, end) between cuts that span a shortest passage."""
    start, stop = np.append(first, cuts), np.append(cuts, end)
    long = pos[stop - 1] - pos[start] + 1 >= LEAST
    return list(zip(start[long].tolist(), stop[long].tolist()))


def _steady(pos: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Shared shingles but those of short runs that leave the diagonal to which the text around them returns."""
    shift = there - pos
    cut = np.flatnonzero(np.abs(np.diff(shift)) > JOIN_GAP) + 1
    start, end = np.append(0, cut), np.append(cut, len(pos))
    stray = end - start < SIZE
    stray[1:-1] &= np.abs(shift[start[2:]] - shift[end[:-2] - 1]) < np.abs(shift[start[1:-1]] - shift[end[:-2] - 1])
    stray[[0, -1]] = False
    return ~np.repeat(stray, end - start)


def _stretches(mine: np.ndarray, other: np.ndarray, pos: np.ndarray, there: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Spans of the longest stretches of shared shingles that are alike, whatever gaps they hold.

    Of distinct shingles a stretch is alike if it holds at least SIMILARITY / (1 - SIMILARITY) shared ones for each that
    one side alone has. The running balance of both tells how far a stretch reaches from each shared shingle.
    """
    if len(pos) < 2:
        return []
    step, jump = np.diff(pos), np.diff(there)
    alone = step - 1 + np.where(jump > 0, jump - 1, 1 - jump)
    price = SIMILARITY / (1 - SIMILARITY)
    balance = np.append(0.0, np.cumsum(1 - price * alone))
    worth = np.append(0.0, np.cumsum(1 - alone))
    best = np.maximum.accumulate(balance[::-1])[::-1]  # falls, so the last that reaches a level is found by bisection
    far = len(best) - 1 - np.searchsorted(best[::-1], balance - 1 - 1e-6, "left")
    least = MIN_WORDS - SIZE + 1
    able = pos[far] - pos + 1 >= least
    found, at = [], 0
    starts = np.flatnonzero(able)
    end = -1
    while (k := int(np.searchsorted(starts, at))) < len(starts):
        i = int(starts[k])
        if end >= 0 and i <= end:  # of the starts within the last stretch, the one that reaches farthest beyond it
            inside = starts[k : np.searchsorted(starts, end, "right")]
            i = int(inside[np.argmax(far[inside])])
            if far[i] <= end:
                at = end + 1
                continue
        i, j = _trimmed(pos, balance, worth, i, int(far[i]), least)
        got = _alike(mine, other, pos[i : j + 1], there[i : j + 1]) if j > end else None
        if got:
            found.append(got)
            at, end = i + 1, j
        elif i <= end:
            at = end + 1
        else:
            at = max(i, at) + 1
    return found


def _trimmed(pos: np.ndarray, balance: np.ndarray, worth: np.ndarray, i: int, j: int, least: int) -> tuple[int, int]:
    """A stretch without ends that share less than the wide gap before them does not, as long as it stays long enough."""
    wide = (np.flatnonzero(np.diff(pos[i : j + 1]) > JOIN_GAP + 1) + i).tolist()
    for g in wide:  # the stretch may begin at g + 1
        if worth[g + 1] > worth[i]:
            continue
        if pos[j] - pos[g + 1] + 1 >= least and balance[j] - balance[g + 1] + 1 >= 0:
            i = g + 1
    for g in reversed(wide):  # or end at g
        if g < i or worth[g] < worth[j]:
            continue
        if pos[g] - pos[i] + 1 >= least and balance[g] - balance[i] + 1 >= 0:
            j = g
    return i, j


def _partners(pos: np.ndarray, low: np.ndarray, high: np.ndarray, order: np.ndarray) -> np.ndarray:
    """A place in the other text for each shared shingle; one that stands there often goes on along the diagonal.

    The places of shingle n are order[low[n] : high[n]], in ascending order.
    """
    there = order[low]
    for n in np.flatnonzero(high - low > 1).tolist():
        if n:
            wanted = there[n - 1] + pos[n] - pos[n - 1]
            places = order[low[n] : high[n]]
            k = min(int(np.searchsorted(places, wanted)), len(places) - 1)
            if k and wanted - places[k - 1] < places[k] - wanted:
                k -= 1
            there[n] = places[k]
    return there


def _alike(mine: np.ndarray, other: np.ndarray, pos: np.ndarray, there: np.ndarray) -> tuple[int, int, int, int] | None:
    a, b, c, d = int(pos[0]), int(pos[-1]) + 1, int(there.min()), int(there.max()) + 1
    if b - a + SIZE - 1 < MIN_WORDS:
        return None
    x, y = np.unique(mine[a:b]), np.unique(other[c:d])
    both = len(np.intersect1d(x, y, assume_unique=True))
    if both < SIMILARITY * (len(x) + len(y) - both):
        return None
    return a, b + SIZE - 1, c, d + SIZE - 1


def _pair_chunks(batch: pa.RecordBatch, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of pairs whose texts together have about `limit` bytes; a first text in successive rows counts once."""
    texts = [batch.column(batch.schema.get_field_index(n)) for n in ("text", "first_text")]
    own, first = (np.diff(buffers(x)[1]) for x in texts)
    code = texts[1].dictionary_encode().indices.to_numpy()
    first[1:][code[1:] == code[:-1]] = 0
    to = np.append(0, np.cumsum(own + first))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(to, to[row] + limit, "right")) - 1)
        yield batch.slice(row, end - row)
        row = end


def _shingles_of(column: pa.Array) -> tuple[list[int], list[np.ndarray]]:
    """Which text each row has, and the shingles of each different text."""
    coded = column.dictionary_encode()
    s, d = _text_shingles(*buffers(coded.dictionary))
    return coded.indices.to_pylist(), np.split(s, np.searchsorted(d, np.arange(1, len(coded.dictionary))))


def _verifier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _pair_chunks(batch):
            (mine, owns), (firsts, others) = (_shingles_of(part.column(part.schema.get_field_index(n))) for n in ("text", "first_text"))
            orders = [np.argsort(x, kind="stable") for x in others]
            least, distinct = [fewest(x) for x in owns], [len(np.unique(x)) == len(x) for x in owns]
            rows, spans = [], []
            for i, (x, y) in enumerate(zip(mine, firsts)):
                own, theirs = owns[x], others[y]
                if len(own) >= LEAST and len(theirs) and (got := passages(own, theirs, [(0, len(own))], orders[y], least[x], distinct[x])):
                    rows.append(i)
                    spans.append(got)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(rows, pa.int64())), part.column(1).take(pa.array(rows, pa.int64()))]
                + [pa.array([[x[j] for x in got] for got in spans], pa.list_(pa.int32())) for j in range(4)],
                names=["doc_id", "first_id", "starts", "ends", "first_starts", "first_ends"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The passages of pairs (doc_id, first_id), written."""
    ids = pairs.select("doc_id").union(pairs.select("first_id")).distinct()
    texts = texts.join(written_keys(ids, "ids"), "doc_id", "left_semi")
    joined = pairs.join(texts, "doc_id").join(texts.select(F.col("doc_id").alias("first_id"), F.col("text").alias("first_text")), "first_id")
    return written(joined.select("doc_id", "first_id", "text", "first_text").mapInArrow(_verifier, PAIR), "passages")


def _spans_of(links: DataFrame) -> DataFrame:
    """(doc_id, ps): the spans of a document in which a passage was found."""
    return links.select("doc_id", F.explode(F.arrays_zip("starts", "ends")).alias("p")).groupBy("doc_id").agg(F.collect_set("p").alias("ps"))


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that equal an earlier one (doc_id, first_id, text) as passages."""
    for batch in batches:
        for part, data, off in chunks(batch):
            n = np.bincount(words(data, off)[2], minlength=part.num_rows)
            rows = np.flatnonzero(n >= MIN_WORDS)
            ids = [part.column(j).take(pa.array(rows)) for j in (0, 1)]
            none, all_ = ([[int(x)] for x in v] for v in (np.zeros(len(rows)), n[rows]))
            spans = [pa.array(x, pa.list_(pa.int32())) for x in (none, all_, none, all_)]
            yield pa.RecordBatch.from_arrays(ids + spans, names=["doc_id", "first_id", "starts", "ends", "first_starts", "first_ends"])


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc_id, around, whole, least): the shingles next to the places that a key has in a text (doc_id, w: its keys and their places, text).

    Places whose surroundings meet have one stretch in common, so a line that a text repeats is taken once. Texts that repeat few shingles take all of them along and the fewest that a passage holds. 16 bits of each suffice: different shingles that agree in them only count as shared, which loses no pair.
    """
    for batch in batches:
        for part, data, off in chunks(batch):
            s, d = _text_shingles(data, off)
            first = np.searchsorted(d, np.arange(part.num_rows + 1))
            whole, least = [], []
            for x, y in zip(first[:-1], first[1:]):
                all_ = np.unique(s[x:y])
                looped = len(all_) <= min(LOOPED, (y - x) // 2)
                whole.append(all_.astype(np.uint16).tobytes() if looped else None)
                least.append(fewest(s[x:y]) if looped else 0)
            s = s.astype(np.uint16)
            lists = part.column(1)
            row, flat = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths())), lists.flatten()
            n = np.asarray(flat.field(1).value_lengths())
            text, at = np.repeat(row, n), flat.field(1).flatten().to_numpy()
            order = np.lexsort((at, np.repeat(np.arange(len(n)), n)))
            at = first[text] + at[order]
            lo, hi = np.maximum(at - AROUND, first[text]), np.minimum(at + AROUND + 1, first[text + 1])
            around, end = [], np.cumsum(n)
            for x, y in zip((end - n).tolist(), end.tolist()):
                cuts = (np.flatnonzero(lo[x + 1 : y] > hi[x : y - 1]) + x + 1).tolist()
                around.append(b"".join(s[lo[p] : hi[q - 1]].tobytes() for p, q in zip([x, *cuts], [*cuts, y])))
            of_text = [x.take(pa.array(row)) for x in (part.column(0), pa.array(whole, pa.binary()), pa.array(least, pa.int32()))]
            yield pa.RecordBatch.from_arrays([flat.field(0), of_text[0], pa.array(around, pa.binary()), *of_text[1:]], names=["key", "doc_id", "around", "whole", "least"])


def _coded(x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each value of 16 bits that an array holds, the array's number and how often."""
    code, times = np.unique(np.repeat(np.arange(len(x)) << 16, [len(y) for y in x]) | np.concatenate(x), return_counts=True)
    return code & 0xFFFF, code >> 16, times


def _met(of: tuple[np.ndarray, np.ndarray, np.ndarray], by: tuple[np.ndarray, np.ndarray, np.ndarray], shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of two sides' arrays (value, number, weight), the weight of the values that the other holds as well, of either.

    Values that many arrays hold are counted by a matrix product, the others by the pairs that hold them.
    """
    found = [np.zeros(shape, np.float32) for _ in range(2)]
    both = np.intersect1d(of[0], by[0])
    place = np.full(1 << 16, -1, np.int32)
    place[both] = np.arange(len(both))
    of, by = ([x[place[side[0]] >= 0] for x in (place[side[0]], *side[1:])] for side in (of, by))
    n, m = (np.bincount(h, minlength=len(both)) for h, _, _ in (of, by))
    many = np.flatnonzero(n * m * 100 > shape[0] * shape[1])
    for at in range(0, len(many), 4096):
        some = np.full(len(both), -1)
        some[many[at : at + 4096]] = np.arange(len(many[at : at + 4096]))
        held, weight = [], []
        for (h, row, w), size in zip((of, by), shape):
            hit = some[h] >= 0
            for table, value in ((held, 1), (weight, w[hit])):
                table.append(np.zeros((size, len(many[at : at + 4096])), np.float32))
                table[-1][row[hit], some[h[hit]]] = value
        found[0] += weight[0] @ held[1].T
        found[1] += held[0] @ weight[1].T
    m[many] = 0
    order = np.argsort(by[0], kind="stable")
    begin = np.searchsorted(by[0][order], np.arange(len(both)))
    times = m[of[0]]
    left = np.repeat(np.arange(len(times)), times)
    right = order[np.arange(len(left)) + np.repeat(begin[of[0]] - (np.cumsum(times) - times), times)]
    pair = of[1][left] * shape[1] + by[1][right]
    for x, w in zip(found, (of[2][left], by[2][right])):
        x += np.bincount(pair, w, shape[0] * shape[1]).reshape(shape)
    return found[0], found[1]


def _alone(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """How many shingles of a shortest passage the texts next to nodes, `a` and `b`, cannot share, for each pair: those of `a`, of `b`.

    A shingle that a text repeats counts as shared.
    """
    sides = [_coded(x) for x in (a, b)]
    again = [np.bincount(row[times > 1], times[times > 1], len(x)) for (_, row, times), x in zip(sides, (a, b))]
    own, others = _met(*((h, row, times == 1) for h, row, times in sides), (len(a), len(b)))
    return np.maximum(AROUND + 1 - own - again[0][:, None], 0), np.maximum(AROUND + 1 - others - again[1][None, :], 0)


def _repeats(x: np.ndarray) -> bool:
    """Whether a shingle stands in x again, close enough for one node's surroundings to hold both."""
    order = np.argsort(x, kind="stable")
    return bool(((x[order][1:] == x[order][:-1]) & (np.diff(order) <= 2 * AROUND)).any())


def _alone_in_a_row(a: list[np.ndarray], b: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of LEAST successive shingles in a[x], how many b[y] lacks at least, for each pair (x, y)."""
    both = np.intersect1d(np.concatenate(a), np.concatenate(b))
    place = np.zeros(1 << 16, np.int32)
    place[both] = np.arange(1, len(both) + 1)
    holds = np.zeros((len(b), len(both) + 1), bool)
    for k, v in enumerate(b):
        holds[k, place[v]] = True
    holds[:, 0] = False
    least = np.zeros(len(x), np.int64)
    order = np.argsort(x, kind="stable")
    own, begin = np.unique(x[order], return_index=True)
    for k, rows in zip(own.tolist(), np.split(order, begin[1:])):
        v = a[k]
        at, step = place[v], max(1, (1 << 21) // max(len(v), 1))
        for some in (rows[i : i + step] for i in range(0, len(rows), step)):
            shared = np.zeros((len(some), len(v) + 1), np.int32)
            np.cumsum(holds[np.ix_(y[some], at)], axis=1, out=shared[:, 1:])
            width = min(LEAST, len(v))
            least[some] = LEAST - (shared[:, width:] - shared[:, : len(v) - width + 1]).max(axis=1)
    return least


def _too_few(left: pa.Table, right: pa.Table, later: np.ndarray) -> np.ndarray:
    """Pairs of texts that take all of their shingles along, which share fewer than a passage of the later one's does."""
    few = np.zeros(later.shape, bool)
    rows, whole, least = [], [], []
    for side in (left, right):
        rows.append(np.flatnonzero(side.column("whole").is_valid().to_numpy()))
        whole.append([np.frombuffer(x, np.uint16) for x in side.column("whole").to_pylist() if x is not None])
        least.append(SIMILARITY * side.column("least").to_numpy()[rows[-1]] - 1e-6)
    if len(rows[0]) and len(rows[1]):
        own, others = _met(_coded(whole[0]), _coded(whole[1]), (len(rows[0]), len(rows[1])))
        few[np.ix_(*rows)] = np.where(later[np.ix_(*rows)], own < least[0][:, None], others < least[1][None, :])
    return few


def _near_there(best: bool):
    """Open pairs of each cell that share enough around the node; `best`: of each text's, the nearest for either reason to be open.

    With `best`, a row (doc_id, null, key) tells of each text that more than these pairs are open for it in its group.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in grouped(batches, 3):
            side, ids, component, covered = (cell.column(n).to_numpy() for n in ("side", "doc_id", "component", "covered"))
            around = [np.frombuffer(x, np.uint16) for x in cell.column("around").to_pylist()]
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(left) or not len(right):
                continue
            later = ids[left][:, None] > ids[right][None, :]
            own, others = _alone([around[i] for i in left], [around[i] for i in right])
            share = np.maximum(FAR + 1 - np.where(later, 5 * own + 4 * others, 4 * own + 5 * others), 0)
            share[(ids[left][:, None] == ids[right][None, :]) | _too_few(cell.take(left), cell.take(right), later)] = 0
            foreign = component[left][:, None] != component[right][None, :]
            bare = np.where(later, ~covered[left][:, None], ~covered[right][None, :])
            share[~(foreign | bare)] = 0
            near = [[around[i] for i in side] for side in (left, right)]
            plain = [np.array([not _repeats(z) for z in side]) for side in near]  # else a passage may be shorter than a surrounding tells
            x, y = np.nonzero((share > 0) & plain[0][:, None] & plain[1][None, :])
            own, others = _alone_in_a_row(*near, x, y), _alone_in_a_row(*near[::-1], y, x)
            share[x, y] = np.maximum(FAR + 1 - np.where(later[x, y], 5 * own + 4 * others, 4 * own + 5 * others), 0)
            taken = share > 0
            if best:
                taken = np.zeros(share.shape, bool)
                for reason in (np.where(foreign, share, 0), np.where(bare, share, 0)):
                    for axis in (0, 1):
                        k, at = np.flatnonzero(reason.any(axis=axis)), reason.argmax(axis=axis)
                        taken[(at[k], k) if axis == 0 else (k, at[k])] = True
            x, y = np.nonzero(taken)
            (own, of_own), (others, of_others) = (np.unique(ids[k], return_inverse=True) for k in (left, right))
            meet = np.zeros((len(own), len(others)), bool)  # texts meet at many places
            meet[of_own[x], of_others[y]] = True
            x, y = np.nonzero(meet)
            x, y = own[x], others[y]
            x, y = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)]), axis=1)
            rest = (share > 0) & ~taken
            more = np.unique(np.concatenate([ids[left][rest.any(axis=1)], ids[right][rest.any(axis=0)]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(x, more)), pa.array([*y.tolist(), *[None] * len(more)], pa.int64()),
                 pa.array([*[None] * len(x), *[cell.column("key")[0].as_py()] * len(more)], pa.int64())], names=["doc_id", "first_id", "key"])

    return run


def _open_members(shared: DataFrame, links: DataFrame) -> DataFrame:
    """Members (key, doc_id, at: its places, component, covered, n, main) of groups that their smallest id leaves open, written.

    Two members need not be held against each other if they are of one component and the later one's windows lie in
    passages that an earlier document holds. The smallest id has met all others, so it is no member.
    """
    parts = components(links.select(F.col("doc_id").alias("a"), F.col("first_id").alias("b"))).toDF("doc_id", "component")
    inside = F.coalesce(F.forall("at", lambda c: F.exists("ps", lambda p: (c >= p["starts"]) & (c + BLOCK <= p["ends"]))), F.lit(False))
    texts = shared.filter("doc_id > first_id").groupBy("doc_id", "key").agg(F.collect_list("c").alias("at"))
    marked = texts.join(parts, "doc_id", "left").join(_spans_of(links), "doc_id", "left")
    marked = marked.select("key", "doc_id", "at", F.coalesce("component", "doc_id").alias("component"), inside.alias("covered"))
    seen = marked.groupBy("key").agg(
        F.count("*").alias("n"), F.bool_and("covered").alias("all"), F.min("component").alias("low"), F.max("component").alias("high"), F.mode("component").alias("main"))
    return written(marked.join(seen.filter("n > 1 and not (all and low = high)").select("key", "n", "main"), "key"), "open")


def _pairs_of_small(members: DataFrame) -> DataFrame:
    one = members.select("key", "doc_id", F.col("component").alias("own"), "covered")
    two = members.select("key", F.col("doc_id").alias("first_id"), "component")
    return one.join(two, "key").filter("doc_id > first_id and (not covered or own <> component)").select("doc_id", "first_id")


def _pairs_of_large(members: DataFrame, around: DataFrame, best: bool) -> DataFrame:
    """Members that are not of their group's main component or not covered meet all others in cells."""
    apart = ~F.col("covered") | (F.col("component") != F.col("main"))
    sizes = members.groupBy("key").agg(F.ceil(F.count_if(apart) / CELL).cast("int").alias("of_apart"), F.ceil(F.count("*") / CELL).cast("int").alias("of_all"))
    hash_, upto = F.xxhash64("doc_id"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = members.withColumn("apart", apart).join(sizes.filter("of_apart > 0"), "key").join(around, ["key", "doc_id"])
    left = dealt.filter("apart").withColumn("side", F.lit(0)).withColumn("i", F.pmod(hash_, "of_apart").cast("int")).withColumn("j", upto("of_all"))
    right = dealt.withColumn("side", F.lit(1)).withColumn("i", upto("of_apart")).withColumn("j", F.pmod(hash_, "of_all").cast("int"))
    cells = left.unionByName(right).select("key", "i", "j", "side", "doc_id", "component", "covered", "around", "whole", "least")
    cells = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return cells.mapInArrow(_near_there(best), "doc_id bigint, first_id bigint, key bigint")


def passage_links(docs: DataFrame) -> DataFrame:
    """Verified links (doc_id, first_id, spans in words of both): passages of doc_id that are near copies of first_id's.

    A text that equals an earlier one is linked with the smallest such id as a whole and takes no further part. All
    windows that share a hash are held against those of the group's smallest id, which costs one pair per window
    however many documents share a passage. After that, the members of a group are held against each other unless that
    can add neither a link between components nor a passage in words that none covers yet, so neither is lost. The
    pairs of a small group are rows; in a large one, the shingles around the window tell which can hold a passage, and
    each member first meets the nearest ones, which leaves few pairs.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    named = texts.select("doc_id", F.unhex(F.md5("text")).alias("digest"))
    firsts = named.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last")).filter("first_id < last").drop("last")
    equal = written(named.join(firsts, "digest").filter("doc_id > first_id").distinct(), "equal")
    same = texts.withColumn("digest", F.unhex(F.md5("text"))).join(equal, ["doc_id", "digest"])
    copies = written(same.select("doc_id", "first_id", "text").mapInArrow(_copies, PAIR), "copies")
    texts = texts.join(equal.withColumnRenamed("doc_id", "copy"), (F.col("doc_id") == F.col("copy")) & (F.unhex(F.md5("text")) == F.col("digest")), "left_anti")
    group = Window.partitionBy("key")
    wide = texts.mapInArrow(_windows, "key bigint, doc_id bigint, c int")
    wide = wide.withColumn("first_id", F.min("doc_id").over(group)).withColumn("last", F.max("doc_id").over(group))
    shared = written(wide.filter("first_id < last").drop("last"), "windows")
    met = written(shared.filter("doc_id > first_id").select("doc_id", "first_id").distinct(), "pairs")
    links = _verified(met, texts)
    members = _open_members(shared, links)
    large = members.filter(F.col("n") > SMALL)
    places = large.groupBy("doc_id").agg(F.collect_list(F.struct("key", "at")).alias("w")).join(
        texts.join(written_keys(large.select("doc_id").distinct(), "ids"), "doc_id", "left_semi"), "doc_id").select("doc_id", "w", "text")
    around = written(places.mapInArrow(_surroundings, "key bigint, doc_id bigint, around binary, whole binary, least int"), "around")
    nearest = written(_pairs_of_large(large, around, True), "nearest")
    pairs = _pairs_of_small(members.filter(F.col("n") <= SMALL)).union(nearest.filter("first_id is not null").select("doc_id", "first_id")).distinct()
    pairs = written(pairs.join(met, ["doc_id", "first_id"], "left_anti"), "pairs")
    links = links.unionByName(_verified(pairs, texts))
    more = nearest.filter("first_id is null").select("key", "doc_id").distinct()
    members = _open_members(shared.join(more, ["key", "doc_id"], "left_semi"), links)
    rest = _pairs_of_large(members, around, False).select("doc_id", "first_id").distinct()
    rest = written(rest.join(met.union(pairs), ["doc_id", "first_id"], "left_anti"), "pairs")
    return copies.unionByName(links).unionByName(_verified(rest, texts))


def removal_spans(links: DataFrame) -> DataFrame:
    """(doc_id, spans): disjoint sorted word spans that repeat an earlier document's passage."""
    one = links.select("doc_id", F.explode(F.arrays_zip("starts", "ends")).alias("p")).select("doc_id", F.struct(F.col("p.starts").alias("s"), F.col("p.ends").alias("e")).alias("p"))
    sorted_spans = one.groupBy("doc_id").agg(F.array_sort(F.collect_set("p")).alias("ps"))
    empty = F.array().cast("array<struct<s:int,e:int>>")
    def merge(acc, p):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], p["e"]).alias("e"))))
        return F.when(F.size(acc) == 0, F.array(p)).when(p["s"] <= F.try_element_at(acc, F.lit(-1))["e"], joined).otherwise(F.concat(acc, F.array(p)))
    return sorted_spans.select("doc_id", F.aggregate("ps", empty, merge).alias("spans"))


def near_passages(docs: DataFrame) -> DataFrame:
    """A row for every document that shares a near-copied passage with another; documents that share none have no row.

    class_id is the smallest document that its verified links reach, itself included; first_id the smallest document
    that it was verified against or itself, n_links how many it was verified against. Members of a group are
    verified against the group's leaders, not against each other, so the class holds links that n_links does not
    count. n_removed_words counts the words in `spans`, which repeat an earlier document's passage (none for a
    passage's first holder). Passages are alike in the order of their words; halves that change places are not found.
    Documents with null id or text, with fewer than MIN_WORDS words, or with nothing shared have no row; rows with
    equal ids are one document's versions and are not held against each other.
    """
    links = passage_links(docs)
    sides = links.select("doc_id", F.col("first_id").alias("other")).union(links.select("first_id", "doc_id"))
    per = sides.distinct().groupBy("doc_id").agg(F.count("*").alias("n_links"), F.min("other").alias("low"))
    classes = components(links.select(F.col("doc_id").alias("a"), F.col("first_id").alias("b"))).toDF("doc_id", "class_id")
    spans = removal_spans(links)
    words = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, p: a + p["e"] - p["s"])
    return per.join(classes, "doc_id").join(spans, "doc_id", "left").select(
        "doc_id", "class_id", F.least("low", "doc_id").alias("first_id"), "n_links", F.coalesce(F.size("spans"), F.lit(0)).alias("n_spans"),
        F.coalesce(words, F.lit(0)).alias("n_removed_words"), F.coalesce("spans", F.array().cast("array<struct<s:int,e:int>>")).alias("spans"))


def _cut(mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column(batch.schema.get_field_index("text")))
            spans = batch.column(batch.schema.get_field_index(mark))
            start, _, doc = words(data, off)
            first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            texts = []
            for i in range(batch.num_rows):
                at = start[first[i] : first[i + 1]]
                kept, done = [], int(off[i])
                for p in (x for x in spans[i].as_py() or [] if x["s"] < len(at)):
                    kept.append(data[done : at[p["s"]]].tobytes())
                    done = int(at[p["e"]]) if p["e"] < len(at) else int(off[i + 1])
                kept.append(data[done : off[i + 1]].tobytes())
                texts.append(b"".join(kept).decode())
            names = [n for n in batch.schema.names if n not in ("text", mark)]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in names], pa.array(texts, pa.string())], names=[*names, "text"])

    return run


def remove_passages(docs: DataFrame) -> DataFrame:
    """`docs` without the passages that repeat an earlier document's; its other columns and rows stay.

    Only the texts that lose a passage pass through Python. A text that is a near copy as a whole becomes empty.
    """
    names = docs.columns
    holder, mark = fresh(names, "_holder"), fresh(names, "_spans")
    spans = written(removal_spans(passage_links(docs)).select(F.col("doc_id").alias(holder), F.col("spans").alias(mark)), "spans")
    same, ids = F.col("doc_id") == F.col(holder), written_keys(spans.select(holder), "ids")
    fields = [docs.schema[n] for n in names if n != "text"] + [docs.schema["text"]]
    cut = docs.filter("text is not null").join(ids, same, "left_semi").join(spans, same).select(*names, mark).mapInArrow(_cut(mark), StructType(fields)).select(*names)
    return docs.join(ids, same & F.col("text").isNotNull(), "left_anti").unionByName(cut)
