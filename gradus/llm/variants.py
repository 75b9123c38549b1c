"""Spelling variants: words one edit apart, by k-d trees over letter counts.

A word is a point: its length and how often it has each letter. One inserted letter moves the point up by one in one
letter and in length; one replaced letter moves it up by one in one letter and down by one in another, at equal length.
So a word's near words lie in two small boxes, one per length pair (equal, one longer), and a k-d tree prunes whatever
a box cannot reach. The top of the tree deals the vocabulary into cells; each word is a point in one cell and a query in
every cell that its boxes reach. In a cell a tree of its own narrows the search down to a few points, whose letters
are then compared in order.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gradus.llm.text import buffers
from gradus.session import written

LETTERS = r"[A-Za-zÀ-ÿ]+"
LEAST_LENGTH = 5
LEAST_COUNT = 3
DROP_ONE_IN = 97
CELL_WORDS = 8_192
LEAF_WORDS = 24
SAMPLE_WORDS = 50_000
QUERY_WORDS = 20_000
MOST_PARTITIONS = 20_000
DIMS = 1 + 26 + 16  # length, a to z, and the letters from U+00C0 on folded into sixteen

LINK = "word string, other string, other_n bigint"


def noisy_words(docs: DataFrame) -> DataFrame:
    """(word): every run of letters, A-Z lower-cased, of at least LEAST_LENGTH before an edit.

    Where the checksum h of `<doc_id>:<run>` is divisible by DROP_ONE_IN, the run loses its letter h % length. A null id
    counts as an empty string there; a null text has no runs.
    """
    run = F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit("")).alias("id"), run.alias("run")).filter(F.length("run") >= LEAST_LENGTH)
    ascii_only = F.octet_length("run") == F.length("run")
    low = runs.select("id", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).alias("run"))
    hashed = low.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % DROP_ONE_IN == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame) -> DataFrame:
    """(word, n) of the words of at least LEAST_LENGTH letters that occur LEAST_COUNT times or more."""
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter((F.col("n") >= LEAST_COUNT) & (F.length("word") >= LEAST_LENGTH))


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of each word, a byte each (all are below U+0100), and the words' offsets."""
    data, off = buffers(column)
    lead = data == 0xC3  # the only lead byte: U+00C0 to U+00FF
    tail = np.zeros(len(data), bool)
    tail[1:] = lead[:-1]
    codes = (data + (tail * 0x40).astype(np.uint8))[~lead]
    return codes, off - np.append(0, np.cumsum(lead))[off]


def points(codes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of DIMS per word; a count is at most 32,767, which keeps a box's bounds right."""
    dim = np.where(codes < 0x80, codes.astype(np.int64) - 0x60, 27 + (codes & 15))
    n, size = len(off) - 1, np.diff(off)
    out = np.bincount(np.repeat(np.arange(n), size) * DIMS + dim, minlength=n * DIMS).reshape(n, DIMS)
    out[:, 0] = size
    return np.minimum(out, 32_767).astype(np.int16)


class Tree:
    """Splits (dimension, bound, left, right) of a k-d tree; a child below 0 is leaf ~child. Left holds values <= bound."""

    def __init__(self, vectors: np.ndarray, leaf: int, keep: bool = True):
        self.splits: list[tuple[int, int, int, int]] = []
        self.leaves: list[np.ndarray] = []
        self.leaf, self.keep = leaf, keep
        self.root = self._grow(vectors, np.arange(len(vectors)))

    def _grow(self, vectors: np.ndarray, rows: np.ndarray) -> int:
        best = self._best(vectors[rows]) if len(rows) > self.leaf else None
        if best is None:
            self.leaves.append(rows if self.keep else rows[:0])
            return ~(len(self.leaves) - 1)
        dim, bound = best
        at, low = len(self.splits), vectors[rows, dim] <= bound
        self.splits.append((dim, bound, 0, 0))
        left, right = self._grow(vectors, rows[low]), self._grow(vectors, rows[~low])
        self.splits[at] = (dim, bound, left, right)
        return at

    @staticmethod
    def _best(v: np.ndarray) -> tuple[int, int] | None:
        """The split that comes nearest to halves: at the median of the length, or between counts of a letter."""
        middle = np.median(v, axis=0).astype(v.dtype)
        worth, found = 0, None
        for bound in (middle, middle - 1):
            low = (v <= bound).sum(axis=0)
            even = np.minimum(low, len(v) - low)
            dim = int(np.argmax(even))
            if even[dim] > worth:
                worth, found = int(even[dim]), (dim, int(bound[dim]))
        return found

    def reached(self, vectors: np.ndarray, longer: int | None) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of `vectors`): the leaves that hold points of a box; longer is 0 or 1 for the length pair, None for the points themselves.

        A box allows one step up in a letter and, at equal length, one step down in another, whatever was crossed before.
        """
        none = np.zeros(len(vectors), bool)
        todo = [(self.root, np.arange(len(vectors)), none, none)]
        while todo:
            node, rows, up, down = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                yield ~node, rows
                continue
            dim, bound, left, right = self.splits[node]
            away = vectors[rows, dim] - bound
            if dim == 0 or longer is None:
                high = away + (longer or 0) > 0
                todo += [(left, rows[~high], up[~high], down[~high]), (right, rows[high], up[high], down[high])]
                continue
            step = away == 0  # a letter more leads to the right
            to = (away > 0) | step & ~up
            todo.append((right, rows[to], (up | step)[to], down[to]))
            step = away == 1  # a letter less leads to the left
            to = away <= 0 if longer else (away <= 0) | step & ~down
            todo.append((left, rows[to], up[to], (down | step)[to]))


def _ragged(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions start, start + 1, ... of each row in one array, and where each row's begin."""
    first = np.append(0, np.cumsum(size))
    return np.repeat(start - first[:-1], size) + np.arange(first[-1]), first[:-1]


def one_edit(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, size: np.ndarray, longer: int) -> np.ndarray:
    """Whether words of `size` letters at a_at are one edit from those at b_at: a replaced letter, or a letter more in b.

    Of a pair one letter apart in length, equal letters from the left and from the right must meet.
    """
    if not len(size):
        return np.zeros(0, bool)
    i, first = _ragged(a_at, size)
    j, _ = _ragged(b_at, size)
    differ = a[i] != b[j]
    if not longer:
        return np.add.reduceat(differ, first, dtype=np.int64) == 1
    place = np.arange(len(i)) - np.repeat(first, size)
    left = np.minimum.reduceat(np.where(differ, place, 1 << 30), first)
    right = np.maximum.reduceat(np.where(a[i] != b[j + 1], place, -1), first)
    return right < left


class Cell:
    """The words of a cell, searched by a tree of their own."""

    def __init__(self, words: pa.Array, counts: np.ndarray):
        self.words, self.counts = words, counts
        self.codes, self.off = letters(words)
        self.vectors = points(self.codes, self.off)
        self.parity = _parity(self.vectors)
        self.tree = Tree(self.vectors, LEAF_WORDS)

    def near(self, words: pa.Array, longer: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of `words`, point) of every pair one edit apart."""
        codes, off = letters(words)
        vectors, found = points(codes, off), []
        parity, size, own = _parity(vectors), np.diff(off), np.diff(self.off)
        for leaf, rows in self.tree.reached(vectors, longer):
            at = self.tree.leaves[leaf]
            for block in range(0, len(at), QUERY_WORDS):  # words that no count tells apart stay in one leaf
                some = at[block : block + QUERY_WORDS]
                step = max(1, (1 << 22) // len(some))
                for lo in range(0, len(rows), step):
                    odd = np.bitwise_count(parity[rows[lo : lo + step], None] ^ self.parity[some][None, :])
                    q, p = np.nonzero(odd <= 2 - longer)
                    q, p = rows[lo : lo + step][q], some[p]
                    apart = np.abs(self.vectors[p].astype(np.int32)[:, 1:] - vectors[q, 1:]).sum(axis=1)
                    ok = (apart <= 2 - longer) & (own[p] == size[q] + longer)
                    q, p = q[ok], p[ok]
                    ok = one_edit(codes, off[q], self.codes, self.off[p], size[q], longer)
                    found.append((q[ok], p[ok]))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([f[i] for f in found] or [none]) for i in (0, 1))


def _parity(vectors: np.ndarray) -> np.ndarray:
    """A bit per letter: whether its count is odd."""
    bits = (vectors[:, 1:] & 1).astype(np.uint64) << np.arange(DIMS - 1, dtype=np.uint64)
    return np.bitwise_or.reduce(bits, axis=1)


def _router(tree):
    """Rows (cell, role, word, n): role 0 is the word as a point, 1 and 2 as a query for words of equal length and longer ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = batch.column(0), batch.column(1)
            vectors = points(*letters(words))
            for role, longer in ((0, None), (1, 0), (2, 1)):
                found = list(tree.value.reached(vectors, longer))
                if not found:
                    continue
                rows = pa.array(np.concatenate([rows for _, rows in found]))
                cells = np.repeat([cell for cell, _ in found], [len(rows) for _, rows in found]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.full(len(rows), role, np.int32)), words.take(rows), counts.take(rows)], names=["cell", "role", "word", "n"])

    return run


def _searcher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows sorted by cell and role, so that a cell's points come before its queries."""
    held, number, cell = [], None, None
    for batch in batches:
        key = batch.column(0).to_numpy().astype(np.int64) * 4 + batch.column(1).to_numpy()
        for lo in np.flatnonzero(np.diff(key, prepend=-1)).tolist():
            part = batch.slice(lo, int(np.searchsorted(key, key[lo], "right")) - lo).select(["word", "n"])
            at, role = divmod(int(key[lo]), 4)
            if at != number:
                held, number, cell = [], at, None
            if role == 0:
                held.append(part)
                continue
            if not held:
                continue
            if cell is None:
                points_of = pa.Table.from_batches(held).combine_chunks()
                cell = Cell(points_of.column(0).chunk(0), points_of.column(1).to_numpy())
            for lo_query in range(0, part.num_rows, QUERY_WORDS):
                queries = part.slice(lo_query, QUERY_WORDS)
                q, p = cell.near(queries.column(0), role - 1)
                mine, other = queries.column(0).take(pa.array(q)), cell.words.take(pa.array(p))
                yield pa.RecordBatch.from_arrays([mine, other, pa.array(cell.counts[p])], names=["word", "other", "other_n"])
                if role == 2:
                    yield pa.RecordBatch.from_arrays([other, mine, queries.column(1).take(pa.array(q))], names=["word", "other", "other_n"])


def near_words(words: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, other, other_n), both ways, of all words of (word, n) that are one edit apart.

    The top of the tree is fitted on about SAMPLE_WORDS words, chosen by hash; it decides only how even the cells are,
    every word is placed and searched for in all cells that it can reach. A task holds one cell's points and streams the
    queries past them. Words are distinct and made of a-z and U+00C0 to U+00FF.
    """
    total = words.count()
    sample = [r.word for r in words.filter(F.pmod(F.xxhash64("word"), F.lit(max(1, total // SAMPLE_WORDS))) == 0).select("word").collect()]
    cells = max(1, -(-total // cell_words))
    top = Tree(points(*letters(pa.array(sample, pa.string()))), max(1, len(sample) // cells), keep=False)
    routed = words.select("word", "n").mapInArrow(_router(words.sparkSession.sparkContext.broadcast(top)), "cell int, role int, word string, n bigint")
    dealt = routed.repartition(min(len(top.leaves), MOST_PARTITIONS), "cell").sortWithinPartitions("cell", "role")
    return dealt.mapInArrow(_searcher, LINK)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of (word, form); a form occurs at least twice as often as its word.

    Each round doubles the steps behind every word, so a chain of 2^k forms takes k rounds.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        after = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = written(now.join(after, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.drop("moved")


def variants(words: DataFrame) -> DataFrame:
    """A row per word of (word, n): n_near, and the form and root that it is a variant of.

    The form is the near word that occurs most often (ties: the smallest by code points), if it occurs at least twice as
    often; the root is the last of the chain of forms, or the word itself.
    """
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("top"))
    strong: Column = -F.col("top.less") >= 2 * F.col("n")
    joined = words.join(near, "word", "left").select(
        "word", F.when(strong, F.col("top.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, -F.col("top.less")).alias("form_n"))
    joined = written(joined, "variants")
    ends = roots(joined.filter("form is not null"))
    return joined.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """`variants` of the words of whole texts, after the edits of `noisy_words`.

    Equal rows count each; null and empty texts have no words; extra columns are ignored; an empty table gives no rows.
    """
    return variants(written(vocabulary(noisy_words(docs)), "vocabulary"))
