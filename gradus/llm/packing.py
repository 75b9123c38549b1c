"""Cost-balanced packing of documents into training sequences.

A sequence costs what its pieces cost: a linear part for every token and a quadratic part for attention within each
piece. Documents are dealt into blocks by hash. In a block, whole sequences are cut from long documents first; what is
left of each document goes, longest first, to the sequence of lowest cost that has room for all of it. Only when no
sequence has is it cut, and the roomiest sequence takes the first part. A block has as many tokens of room as tokens:
full sequences, and short ones whose lengths are the powers of two that add up to the rest, so nothing is padded.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gradus.llm.text import chunks
from gradus.llm.units import UnitEncoder

LENGTH = 1024
WIDTH = 768  # of the model for which costs are estimated
BLOCK_BYTES = 4 << 20
OPEN_TOKENS = 1 << 23
CHUNK = 1 << 20
MOST_PARTITIONS = 20_000

PIECE = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def cost(length: int | np.ndarray, width: int = WIDTH) -> float | np.ndarray:
    """Relative cost of a piece: 24 width^2 operations a token and 4 width a pair of tokens, in units of the former."""
    return length + length * length / (6.0 * width)


def rooms(tokens: int, length: int = LENGTH) -> np.ndarray:
    """Lengths of the sequences that hold so many tokens without padding: full ones, then powers of two."""
    rest = tokens % length
    return np.array([length] * (tokens // length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], np.int64)


def assign(lengths: list[int], length: int = LENGTH, width: int = WIDTH) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of documents of at most `length` tokens each."""
    size = rooms(sum(lengths), length)
    room, spent, out = size.copy(), np.zeros(len(size)), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[i]
        while left:
            fits = np.flatnonzero(room >= left)
            s = int(fits[np.argmin(spent[fits])]) if len(fits) else int(np.argmax(room))
            n = min(left, int(room[s]))
            out.append((i, start, n, s, int(size[s] - room[s])))
            room[s] -= n
            spent[s] += cost(n, width)
            start, left = start + n, left - n
    return out


class _Block:
    """What a block's documents leave after their whole sequences, and the pieces that are settled."""

    def __init__(self, number: int, length: int, width: int):
        self.number, self.length, self.width, self.sequences = number, length, width, 0
        self.tails: list[tuple] = []
        self.open = 0

    def add(self, doc_id, ids: bytes, out: list) -> None:
        n, whole = len(ids) // 4, len(ids) // 4 // self.length * self.length
        for start in range(0, whole, self.length):
            out.append((doc_id, start, self.length, ids[4 * start : 4 * (start + self.length)], n, self.sequence(), 0))
        if whole < n:
            self.tails.append((doc_id, whole, ids[4 * whole :], n))
            self.open += n - whole
        if self.open >= OPEN_TOKENS:
            self.close(out)

    def sequence(self) -> int:
        self.sequences += 1
        return (self.number << 32) + self.sequences - 1

    def close(self, out: list) -> None:
        first = (self.number << 32) + self.sequences
        used = 0
        for i, start, n, s, offset in assign([len(t[2]) // 4 for t in self.tails], self.length, self.width):
            doc_id, before, ids, total = self.tails[i]
            out.append((doc_id, before + start, n, ids[4 * start : 4 * (start + n)], total, first + s, offset))
            used = max(used, s + 1)
        self.sequences += used
        self.tails, self.open = [], 0


_ENCODERS: dict[int, UnitEncoder] = {}


def _packer(spec, end_id: int, length: int, width: int):
    end = np.array([end_id], "<u4").tobytes()

    def batch_of(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(spec.value)
        if key not in _ENCODERS:
            _ENCODERS[key] = UnitEncoder(spec.value)
        block, out = None, []
        for batch in batches:
            for part, data, off in chunks(batch, limit=CHUNK):
                numbers, doc_ids = part.column(0).to_pylist(), part.column(1).to_pylist()
                for number, doc_id, ids in zip(numbers, doc_ids, _ENCODERS[key].encode(data, off)):
                    if block is None or block.number != number:
                        if block is not None:
                            block.close(out)
                        block = _Block(number, length, width)
                    block.add(doc_id, ids.tobytes() + end, out)
                if out:
                    yield batch_of(out)
                    out = []
        if block is not None:
            block.close(out)
        if out:
            yield batch_of(out)

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, length: int = LENGTH, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per piece: doc_id, its start, length and ids in the document, the document's ids in all, its sequence and offset there.

    `length` is a power of two. A document's ids end with `end_id`, so that a null or empty text has one. Sequences
    belong to one block each; their number holds the block's in the upper half. The blocks depend on the number of
    bytes alone and their content on the rows, so reruns agree on any cluster; rows that are equal in id and text are
    one another's equal. Rows with null or equal ids are documents of their own. A block keeps the unsettled ids only,
    at most OPEN_TOKENS. Extra columns are ignored; an empty table gives none.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("the length of a sequence is a power of two")
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    tie = F.xxhash64("doc_id", "text")
    dealt = docs.withColumn("tie", tie).withColumn("block", F.pmod("tie", F.lit(blocks)))
    dealt = dealt.repartition(min(blocks, MOST_PARTITIONS), "block").sortWithinPartitions("block", "tie", "doc_id")
    return dealt.select("block", "doc_id", "text").mapInArrow(_packer(spec, end_id, length, width), PIECE)


def sequences(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """(sequence_id, n_tokens, padded, ids, lengths): each sequence's ids in order and the lengths of its pieces.

    A sequence is padded to `length` unless its length is a power of two; `padded` is its length then. A sequence has
    at most `length` pieces, so no group is large.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    whole = pieces.groupBy("sequence_id").agg(parts.alias("p"), F.sum("length").alias("n_tokens"))
    padded = F.when(F.bit_count("n_tokens") == 1, F.col("n_tokens")).otherwise(F.lit(length).cast("bigint"))
    ids = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return whole.select("sequence_id", "n_tokens", padded.alias("padded"), ids.alias("ids"), F.col("p.length").alias("lengths"))


def digest(pieces: DataFrame) -> DataFrame:
    """`pieces` with a checksum in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
