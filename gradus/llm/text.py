"""Text helpers shared by the operators: words, shingles and hashes of whole Arrow batches in numpy.

A word is `[^\\x20\\x09-\\x0D]+`. These separators are single bytes in UTF-8, so words are found on the bytes.
All functions take a chunk of documents at once; `chunks` bounds the bytes of a chunk, except that one long
document is a chunk of its own.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with the bytes and offsets of `column`, each of about `limit` bytes at most."""
    data, off = buffers(batch.column(batch.schema.get_field_index(column)))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
        yield batch.slice(row, end - row), data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x + np.uint64((seed * 0xD1B54A32D192ED03 + 0x8CB92BA72F3D8DD7) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes; `span_hash` takes those of spans from it."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data) + 1)[0][:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), equal for equal bytes wherever they stand."""
    inverse = _powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * inverse[start], seed)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word of a chunk."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document, start and end of every word of a chunk."""
    start, end, doc = words(data, off)
    return span_hash(prefix_hash(data), start, end), doc, start, end


def shingles(hashes: np.ndarray, doc: np.ndarray, n_docs: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and first word of every shingle; a shorter text's whole sequence is one shingle."""
    n = len(hashes)
    count = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(count) - count
    at = np.arange(n) - first[doc]
    start = np.flatnonzero((at + size <= count[doc]) | (at == 0))
    out = np.zeros(len(start), np.uint64)
    for j in range(size):
        i = np.minimum(start + j, max(n - 1, 0))
        same = (start + j < n) & (doc[i] == doc[start])
        out += np.where(same, mix(hashes[i], j + 1), np.uint64(0))
    return mix(out, size), doc[start], start


def distinct_sets(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each document, sorted by document and hash."""
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[keep], d[keep]


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their documents, sorted by both."""
    h, doc, _, _ = word_hashes(lower_ascii(data) if lower else data, off)
    s, d, _ = shingles(h, doc, len(off) - 1, size)
    return distinct_sets(s, d)


def grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """The rows of each key of a partition that is sorted by its first columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(n_keys)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            now = tuple(keys[:, a])
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def fresh(columns: list[str], name: str) -> str:
    """`name`, with underscores added until no column (in any case) has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
