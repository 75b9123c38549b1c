"""Adaptive context-mixing range coder for token ids, and the token tables written with it.

Ids are coded in blocks that know nothing of each other. In a block the ids after the last two and after the last one
predict the next id. How far each prediction has been right of late gives two probabilities, which are mixed with
weights learned on the way; the range coder then codes one of three outcomes: the order-2 prediction, the order-1
prediction, or neither. An id that neither predicts is coded by order-0 counts of its high byte, learned in the block,
and its plain low byte. The blocks of a task are coded in lock step, a numpy lane for each.

The arithmetic uses +, -, * and / on doubles and integers only, so that coder and decoder agree to the last bit.
"""
from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import LongType

from gradus.llm.text import WORD, chunks
from gradus.plans.ordering import cut_points, value_buckets
from gradus.session import shuffle_partitions, written

BLOCK_IDS = 2048
LANES = 3072
MAGIC = b"GRC1"
HEAD = struct.Struct("<4sIIIIq")
ENTRY = np.dtype([("doc_id", "<i8"), ("count", "<u4"), ("null", "u1")])

TOP, BOTTOM, WORD32 = 1 << 24, 1 << 16, (1 << 32) - 1
BITS = 12
ONE = 1 << BITS
SLOTS1, SLOTS2 = 1024, 2048
REFRESH = 32
CACHE_WORDS = 200_000


class _Mixer:
    """The models of all lanes: predictions, their probabilities, the mixing weights and the order-0 counts.

    Tables are flat; `at1`, `at2`, `at16` and `at256` hold where a lane's part starts.
    """

    def __init__(self, lanes: int):
        lane = np.arange(lanes)
        self.at1, self.at2, self.at16, self.at256 = lane * SLOTS1, lane * SLOTS2, lane * 16, lane * 257
        self.one, self.two = np.zeros(lanes * SLOTS1, np.uint16), np.zeros(lanes * SLOTS2, np.uint16)
        self.sure1, self.sure2 = np.zeros(lanes * SLOTS1, np.uint8), np.zeros(lanes * SLOTS2, np.uint8)
        start = (1.0 + np.arange(16)) / 18
        self.right1, self.right2, self.left1 = np.tile(start, lanes), np.tile(start, lanes), np.tile(start / 2, lanes)
        self.weight2, self.weight1 = np.full(lanes, 0.7), np.full(lanes, 0.4)
        self.counts = np.ones((lanes, 256), np.int32)
        self.sums = np.tile(np.arange(257, dtype=np.int32), (lanes, 1))
        self.flat_sums, self.flat_counts = self.sums.reshape(-1), self.counts.reshape(-1)
        self.prev1, self.prev2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def refresh(self, n: int) -> None:
        """Order-0 sums of the first n lanes; counts are halved before they outgrow the coder."""
        np.cumsum(self.counts[:n], axis=1, out=self.sums[:n, 1:])
        big = np.flatnonzero(self.sums[:n, 256] > 40_000)
        if len(big):
            self.counts[big] = (self.counts[big] + 1) >> 1
            self.sums[big, 1:] = np.cumsum(self.counts[big], axis=1)

    def predict(self, n: int) -> None:
        """Predictions of the first n lanes and the widths of their outcomes on a scale of ONE."""
        last = self.prev1[:n]
        self.slot1 = self.at1[:n] + (last & (SLOTS1 - 1))
        self.slot2 = self.at2[:n] + ((last * 40_503 + self.prev2[:n] * 2_654_435_761 >> 7) & (SLOTS2 - 1))
        self.guess1, self.guess2 = self.one.take(self.slot1), self.two.take(self.slot2)
        self.c1, self.c2 = self.sure1.take(self.slot1), self.sure2.take(self.slot2)
        self.row1, self.row2 = self.at16[:n] + self.c1, self.at16[:n] + self.c2
        self.same = self.guess1 == self.guess2
        self.p2, self.p1 = self.right2.take(self.row2), self.right1.take(self.row1)
        s2, s1 = 2 * self.p2 - 1, 2 * self.p1 - 1
        self.x2 = s2 / (1.001 - np.abs(s2))
        x1 = s1 / (1.001 - np.abs(s1))
        self.x1 = np.where(self.same, x1, -x1)
        x = self.weight2[:n] * self.x2 + self.weight1[:n] * self.x1
        self.p = 0.5 + 0.5 * x / (1 + np.abs(x))
        self.hit2 = np.minimum(np.maximum((self.p * ONE).astype(np.int64), 16), ONE - 64)
        rest = ONE - self.hit2
        self.q1 = self.left1.take(self.row1)
        hit1 = np.minimum(np.maximum((rest * self.q1).astype(np.int64), 1), rest - 8)
        self.hit1 = np.where(self.same, 0, hit1)

    def learn(self, ids: np.ndarray, outcome: np.ndarray) -> None:
        n = len(ids)
        hit2, hit1 = ids == self.guess2, ids == self.guess1
        wrong = 0.02 * (hit2 - self.p)
        w = self.weight2[:n]
        np.minimum(np.maximum(w + wrong * np.minimum(self.x2, 4), -1), 4, out=w)
        w = self.weight1[:n]
        np.minimum(np.maximum(w + wrong * np.minimum(np.maximum(self.x1, -4), 4), -1), 4, out=w)
        self.right2[self.row2] = self.p2 + (hit2 - self.p2) * 0.04
        self.right1[self.row1] = self.p1 + (hit1 - self.p1) * 0.04
        for table, sure, slot, c, hit, guess in ((self.two, self.sure2, self.slot2, self.c2, hit2, self.guess2), (self.one, self.sure1, self.slot1, self.c1, hit1, self.guess1)):
            keep = hit | (c > 1)
            table[slot] = np.where(keep, guess, ids)
            sure[slot] = np.where(hit, np.minimum(c + 1, 15), np.maximum(c >> 1, 1))
        past = np.flatnonzero((outcome > 0) & ~self.same)
        q = self.q1.take(past)
        self.left1[self.row1.take(past)] = q + (hit1.take(past) - q) * 0.04
        rare = np.flatnonzero(outcome == 2)
        self.flat_counts[rare * 256 + (ids.take(rare) >> 8)] += 24
        self.prev2[:n], self.prev1[:n] = self.prev1[:n], ids


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """The coded ids of each block; an id has 16 bits."""
    out: list[bytes] = [b""] * len(blocks)
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    for at in range(0, len(order), LANES):
        part = order[at : at + LANES]
        for i, data in zip(part, _encode([blocks[i] for i in part])):
            out[i] = data
    return out


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    lanes, length = len(blocks), np.array([len(b) for b in blocks])
    steps = int(length.max(initial=0))
    ids = np.zeros((steps, lanes), np.uint16)
    for k, b in enumerate(blocks):
        ids[: len(b), k] = b
    low, span = np.zeros(lanes, np.int64), np.full(lanes, WORD32, np.int64)
    width = 5 * steps + 8
    data, pos = np.zeros(lanes * width, np.uint8), np.arange(lanes) * width

    def settle(row: np.ndarray | slice, l: np.ndarray, r: np.ndarray) -> None:
        """Writes the bytes that the intervals [l, l + r) have settled and widens them."""
        who, live = None, None
        ll, rr = l, r
        while True:
            small = rr < BOTTOM
            go = np.flatnonzero(((ll ^ (ll + rr)) < TOP) | small)
            if not len(go):
                break
            live = go if live is None else live.take(go)
            who = live if isinstance(row, slice) else row.take(live)
            ll, rr, small = ll.take(go), rr.take(go), small.take(go)
            tight = small & ((ll ^ (ll + rr)) >= TOP)
            rr = np.where(tight, -ll & (BOTTOM - 1), rr)
            at = pos.take(who)
            data[at] = ll >> 24
            pos[who] = at + 1
            ll, rr = (ll << 8) & WORD32, (rr << 8) & WORD32
            l[live], r[live] = ll, rr
        low[row], span[row] = l, r

    m = _Mixer(lanes)
    active = np.searchsorted(-length, -np.arange(steps), "left")  # lanes are sorted by falling length
    for t in range(steps):
        n = int(active[t])
        if t % REFRESH == 0:
            m.refresh(n)
        now = ids[t, :n].astype(np.int64)
        m.predict(n)
        outcome = np.where(now == m.guess2, 0, np.where(now == m.guess1, 1, 2))
        past, rare_one = outcome > 0, outcome == 2
        first = np.where(past, m.hit2, 0) + np.where(rare_one, m.hit1, 0)
        size = np.where(past, np.where(rare_one, ONE - m.hit2 - m.hit1, m.hit1), m.hit2)
        part = span[:n] >> BITS
        settle(slice(0, n), low[:n] + part * first, part * size)
        rare = np.flatnonzero(rare_one)
        if len(rare):
            id_ = now.take(rare)
            at = rare * 257 + (id_ >> 8)
            first = m.flat_sums.take(at).astype(np.int64)
            part = span.take(rare) // m.flat_sums.take(rare * 257 + 256)
            settle(rare, low.take(rare) + part * first, part * (m.flat_sums.take(at + 1) - first))
            part = span.take(rare) >> 8
            settle(rare, low.take(rare) + part * (id_ & 255), part)
        m.learn(now, outcome)
    for _ in range(4):
        data[pos] = low >> 24
        pos += 1
        low = (low << 8) & WORD32
    return [data[k * width : pos[k]].tobytes() for k in range(lanes)]


def decode_blocks(blocks: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """The ids of each coded block, given how many it holds."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(blocks)
    order = sorted(range(len(blocks)), key=lambda i: -lengths[i])
    for at in range(0, len(order), LANES):
        part = order[at : at + LANES]
        for i, ids in zip(part, _decode([blocks[i] for i in part], np.array([lengths[i] for i in part]))):
            out[i] = ids
    return out


def _decode(blocks: list[bytes], length: np.ndarray) -> list[np.ndarray]:
    lanes, steps = len(blocks), int(length.max(initial=0))
    data = np.zeros((lanes, max(map(len, blocks), default=0) + 8), np.uint8)
    for k, b in enumerate(blocks):
        data[k, : len(b)] = np.frombuffer(b, np.uint8)
    width = data.shape[1]
    low, span, pos = np.zeros(lanes, np.int64), np.full(lanes, WORD32, np.int64), np.arange(lanes) * width + 4
    code = np.zeros(lanes, np.int64)
    for j in range(4):
        code = code << 8 | data[:, j]
    data = np.append(data.reshape(-1), np.zeros(64, np.uint8))

    def settle(row: np.ndarray | slice, l: np.ndarray, r: np.ndarray) -> None:
        """Reads as many bytes as the coder wrote at this point."""
        live = None
        ll, rr = l, r
        while True:
            small = rr < BOTTOM
            go = np.flatnonzero(((ll ^ (ll + rr)) < TOP) | small)
            if not len(go):
                break
            live = go if live is None else live.take(go)
            who = live if isinstance(row, slice) else row.take(live)
            ll, rr, small = ll.take(go), rr.take(go), small.take(go)
            tight = small & ((ll ^ (ll + rr)) >= TOP)
            rr = np.where(tight, -ll & (BOTTOM - 1), rr)
            at = pos.take(who)
            code[who] = (code.take(who) << 8) & WORD32 | data.take(at)
            pos[who] = at + 1
            ll, rr = (ll << 8) & WORD32, (rr << 8) & WORD32
            l[live], r[live] = ll, rr
        low[row], span[row] = l, r

    ids = np.zeros((steps, lanes), np.uint16)
    m = _Mixer(lanes)
    active = np.searchsorted(-length, -np.arange(steps), "left")
    for t in range(steps):
        n = int(active[t])
        if t % REFRESH == 0:
            m.refresh(n)
        m.predict(n)
        part = span[:n] >> BITS
        at = np.minimum(((code[:n] - low[:n]) & WORD32) // part, ONE - 1)
        past = at >= m.hit2
        rare_one = at >= m.hit2 + m.hit1
        outcome = past.astype(np.int64) + rare_one
        first = np.where(past, m.hit2, 0) + np.where(rare_one, m.hit1, 0)
        size = np.where(past, np.where(rare_one, ONE - m.hit2 - m.hit1, m.hit1), m.hit2)
        settle(slice(0, n), low[:n] + part * first, part * size)
        now = np.where(past, m.guess1, m.guess2).astype(np.int64)
        rare = np.flatnonzero(rare_one)
        if len(rare):
            row = rare * 257
            total = m.flat_sums.take(row + 256)
            part = span.take(rare) // total
            at = np.minimum(((code.take(rare) - low.take(rare)) & WORD32) // part, total - 1)
            high = row
            for step in (128, 64, 32, 16, 8, 4, 2, 1):
                high = high + step * (m.flat_sums.take(high + step) <= at)
            first = m.flat_sums.take(high).astype(np.int64)
            settle(rare, low.take(rare) + part * first, part * (m.flat_sums.take(high + 1) - first))
            part = span.take(rare) >> 8
            plain = np.minimum(((code.take(rare) - low.take(rare)) & WORD32) // part, 255)
            settle(rare, low.take(rare) + part * plain, part)
            now[rare] = (high - row) << 8 | plain
        ids[t, :n] = now
        m.learn(now, outcome)
    return [ids[: length[k], k].astype(np.int64) for k in range(lanes)]


def pack(ids: np.ndarray, coded: bytes, entries: np.ndarray, first: int) -> bytes:
    """A block as stored: magic, counts, crc of the ids, number of its first document, entries, code, crc of it all."""
    head = HEAD.pack(MAGIC, len(ids), len(entries), len(coded), zlib.crc32(ids.astype("<u4").tobytes()), first)
    body = head + entries.tobytes() + coded
    return body + struct.pack("<I", zlib.crc32(body))


def unpack(block: bytes) -> tuple[int, int, np.ndarray, bytes, int]:
    """Ids, first document's number, entries, code and crc of a stored block; raises if a byte was changed."""
    if len(block) < HEAD.size + 4 or struct.unpack("<I", block[-4:])[0] != zlib.crc32(block[:-4]):
        raise ValueError("a block's checksum is wrong")
    magic, n, docs, size, crc, first = HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    entries = np.frombuffer(block, ENTRY, docs, HEAD.size)
    start = HEAD.size + docs * ENTRY.itemsize
    return n, first, entries, block[start : start + size], crc


class _Words:
    """Encodes texts word by word, as the tokenizer never joins what white space parts; remembers words it has met."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cut = Tokenizer.from_str(spec), re.compile(WORD)
        self._clear()

    def _clear(self) -> None:
        self.known, self.ids, self.ends = {}, np.zeros(0, np.uint16), np.zeros(1, np.int64)

    def encode(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, `end_id` after each, and the offsets."""
        if len(self.known) > CACHE_WORDS:
            self._clear()
        known, codes, count, new = self.known, [], [0], []
        for t in texts:
            for w in self.cut.findall(t or ""):
                c = known.get(w)
                if c is None:
                    c = known[w] = len(known)
                    new.append(w)
                codes.append(c)
            codes.append(-1)
            count.append(len(codes))
        if new:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            self.ids = np.concatenate([self.ids, np.fromiter((i for f in found for i in f), np.uint32)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(f) for f in found])])
        code = np.array(codes, np.int64)
        stop = code < 0
        start = np.where(stop, 0, self.ends[np.maximum(code, 0)])
        length = np.where(stop, 1, self.ends[np.minimum(np.maximum(code, 0) + 1, len(self.ends) - 1)] - start)
        to = np.concatenate([[0], np.cumsum(length)])
        at = np.repeat(start - to[:-1], length) + np.arange(to[-1])
        ids = self.ids[np.minimum(at, max(len(self.ids) - 1, 0))].astype(np.int64) if len(self.ids) else np.zeros(to[-1], np.int64)
        ids[to[:-1][stop]] = end_id
        return ids, to[np.array(count)]


_ENCODERS: dict[int, _Words] = {}


def _writer(spec, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(spec.value)
        if key not in _ENCODERS:
            _ENCODERS[key] = _Words(spec.value)
        place, number, ready = None, {}, []
        left_ids, left_entries = [], []
        seq: dict[float, int] = {}

        def close() -> None:
            """The ids gathered for a block become one; `first` is the number of its first document in the range."""
            if left_entries:
                entries = np.array([(d or 0, n, d is None) for _, d, n in left_entries], ENTRY)
                ready.append((place, seq.get(place, 0), np.concatenate(left_ids), entries, left_entries[0][0]))
                seq[place] = seq.get(place, 0) + 1
                left_ids.clear()
                left_entries.clear()

        def flush() -> pa.RecordBatch:
            coded = encode_blocks([x[2] for x in ready])
            rows = [pack(x[2], c, x[3], x[4]) for x, c in zip(ready, coded)]
            out = pa.RecordBatch.from_arrays([pa.array([int(x[0]) for x in ready]), pa.array([x[1] for x in ready], pa.int64()), pa.array(rows, pa.binary())], names=["range", "block", "data"])
            ready.clear()
            return out

        held = 0
        for batch in batches:
            for part, _, _ in chunks(batch):
                ids, off = _ENCODERS[key].encode(part.column(2).to_pylist(), end_id)
                for i, (r, doc) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                    if r != place:
                        close()
                        place, held = r, 0
                    n = number[r] = number.get(r, -1) + 1
                    mine = ids[off[i] : off[i + 1]].astype(np.uint16)
                    while len(mine):
                        piece, mine = mine[: BLOCK_IDS - held], mine[BLOCK_IDS - held :]
                        left_ids.append(piece)
                        left_entries.append((n, doc, len(piece)))
                        held += len(piece)
                        if held == BLOCK_IDS:
                            close()
                            held = 0
                if len(ready) >= LANES:
                    yield flush()
        close()
        if ready:
            yield flush()

    return run


def write_token_table(docs: DataFrame, tokenizer_path: str, end_id: int = 1, label: str = "tokens") -> DataFrame:
    """Writes the ids of all texts in ascending doc_id order and returns the table of stored blocks (range, block, data).

    Documents are dealt once into ranges of doc_id, whose bounds come from a quantile sketch; a range is a file of
    blocks of BLOCK_IDS ids, numbered in order. A null text is empty, null ids come last, equal ids in the order of
    their texts' hash. Each file is one task's output under Spark's commit, so a lost task is written again whole.
    """
    spark = docs.sparkSession
    n = 4 * shuffle_partitions(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    cuts = cut_points(texts.select("doc_id"), "doc_id", n)
    ranged = value_buckets(texts, "doc_id", cuts, "range").withColumn("range", F.when(F.col("doc_id").isNull(), float(n + 2)).otherwise(F.col("range")))
    dealt = ranged.repartition(shuffle_partitions(spark), "range").sortWithinPartitions("range", F.asc_nulls_last("doc_id"), F.xxhash64("text"))
    with open(tokenizer_path) as f:
        spec = spark.sparkContext.broadcast(f.read())
    blocks = dealt.select("range", "doc_id", "text").mapInArrow(_writer(spec, end_id), "range bigint, block bigint, data binary")
    return written(blocks, label)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, LANES):
            part = batch.slice(at, LANES)
            heads = [unpack(x) for x in part.column(2).to_pylist()]
            decoded = decode_blocks([h[3] for h in heads], [h[0] for h in heads])
            rows = []
            for r, b, (_, first, entries, _, crc), ids in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), heads, decoded):
                raw = ids.astype("<u4").tobytes()
                if zlib.crc32(raw) != crc:
                    raise ValueError("a block's ids differ from those written")
                end = np.cumsum(entries["count"].astype(np.int64)) * 4
                for i, e in enumerate(entries):
                    piece = raw[end[i] - 4 * int(e["count"]) : end[i]]
                    rows.append((r, b, first + i, None if e["null"] else int(e["doc_id"]), int(e["count"]), zlib.crc32(piece), piece))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                names=["range", "block", "number", "doc_id", "n_tokens", "crc", "ids"])


def read_pieces(blocks: DataFrame) -> DataFrame:
    """Decodes stored blocks: a row for each document's piece in a block, with its ids as little-endian 32-bit integers."""
    kind = "range bigint, block bigint, number bigint, doc_id bigint, n_tokens bigint, crc bigint, ids binary"
    return blocks.select("range", "block", "data").mapInArrow(_reader, kind)


def _times(matrix: list[int], v: int) -> int:
    out = 0
    for row in matrix:
        if v & 1:
            out ^= row
        v >>= 1
    return out


@cache
def _zero_bytes(power: int) -> list[int]:
    """What 2**power zero bytes do to a crc32, as a bit matrix."""
    if power == 0:
        matrix = [0xEDB88320] + [1 << k for k in range(31)]  # one zero bit
        for _ in range(3):
            matrix = [_times(matrix, row) for row in matrix]
        return matrix
    half = _zero_bytes(power - 1)
    return [_times(half, row) for row in half]


def combine_crc32(a: int, b: int, length: int) -> int:
    """crc32 of two joined byte strings from theirs; `length` is the second's."""
    power = 0
    while length:
        if length & 1:
            a = _times(_zero_bytes(power), a)
        length >>= 1
        power += 1
    return a ^ b


@F.pandas_udf(LongType())
def _joined_crc(pieces: pd.Series) -> pd.Series:
    def one(rows) -> int:
        crc = int(rows[0]["crc"])
        for r in rows[1:]:
            crc = combine_crc32(crc, int(r["crc"]), 4 * int(r["n_tokens"]))
        return crc

    return pieces.map(one)


def documents_of(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the stored blocks."""
    pieces = read_pieces(blocks).drop("ids")
    docs = pieces.groupBy("range", "number").agg(
        F.first("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("block", "n_tokens", "crc"))).alias("pieces"))
    docs = written(docs.select("range", "number", "doc_id", "n_tokens", _joined_crc("pieces").alias("ids_crc32")), "documents")
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = docs.groupBy("range").agg(F.sum("n_tokens").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("range").orderBy("number").rowsBetween(W.unboundedPreceding, -1)
    docs = docs.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(offsets, "range")
    return docs.select("doc_id", (F.col("inside") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
