"""Ids of whole texts by a byte-level BPE tokenizer, from units that it never joins.

The tokenizer splits a text before it merges anything: at white space, where the last space of a run goes with the word
behind it, and wherever a run of letters ends. Cutting there first gives units whose ids do not depend on what
stands around them, so a unit is encoded once and remembered by its hash. Units are found and looked up a chunk of
texts at a time in numpy.
"""
from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from gradus.llm.text import prefix_hash, span_hash

KNOWN_UNITS = 400_000
JOINED = 64
SPACE = "\u0120"  # a space byte in the model's alphabet; other ASCII signs stand for themselves

#: White space beyond ASCII, in UTF-8. Texts that hold some are not cut.
_WIDE_WHITE = rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"


def unit_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where each unit of a chunk of texts begins."""
    n = len(data)
    white = (data == 0x20) | (data - np.uint8(0x09) < 5)
    letter = (data | np.uint8(0x20)) - np.uint8(0x61) < 26
    first = np.zeros(n + 1, bool)
    first[off] = True
    ends_run = np.zeros(n, bool)  # the last white space before a word of the same text
    ends_run[:-1] = white[:-1] & ~white[1:] & ~first[1:n]
    before, here = white[:-1], white[1:]
    word_turn = letter[:-1] & ~letter[1:] & (data[1:] < 0x80)
    start = np.zeros(n + 1, bool)
    start[1:n] = here & (~before | ends_run[1:]) | ~here & (before & (data[:-1] != 0x20) | ~before & word_turn)
    start[off] = True
    return np.flatnonzero(start[:n])


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions begin, begin + 1, ... of each row in one array."""
    to = np.cumsum(size)
    return np.repeat(begin - (to - size), size) + np.arange(to[-1] if len(to) else 0)


class _Generation:
    """Ids of units in one flat array, found by the units' sorted hashes."""

    def __init__(self):
        self.hashes, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of sorted hashes, and which of them are known."""
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == hashes[inside]
        return at, known

    def add(self, hashes: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Adds sorted, unknown hashes, whose units have `size` ids each."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        at = np.searchsorted(self.hashes, hashes)
        begin = self.used + np.cumsum(size) - size
        self.hashes, self.begin, self.size = (np.insert(x, at, y) for x, y in ((self.hashes, hashes), (self.begin, begin), (self.size, size)))
        self.used += len(ids)


class UnitEncoder:
    """Encodes chunks of texts; remembers units in two generations of at most KNOWN_UNITS and a chunk's."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        added = [re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile(b"|".join([_WIDE_WHITE, *added]))
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.young, self.old = _Generation(), _Generation()

    def encode(self, data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """The ids of each text of a chunk of UTF-8."""
        raw, n_docs = data.tobytes(), len(off) - 1
        apart = np.unique(np.searchsorted(off, [m.start() for m in self.whole.finditer(raw)], "right") - 1).tolist()
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * n_docs
        if len(data):
            start = unit_starts(data, off)
            end = np.append(start[1:], len(data))
            hashes = span_hash(prefix_hash(data), start, end)
            order = np.argsort(hashes)
            ranked = hashes[order]
            new = np.ones(len(ranked), bool)
            new[1:] = ranked[1:] != ranked[:-1]
            first = order[new]
            place = np.empty(len(order), np.int64)
            place[order] = self._places(ranked[new], raw, start[first], end[first])[np.cumsum(new) - 1]
            begin, size = self.young.begin[place], self.young.size[place]
            to = np.append(0, np.cumsum(size))
            ids = self.young.ids[_ragged(begin, size)]
            bounds = to[np.searchsorted(start, off, "left")].tolist()
            out = [ids[bounds[d] : bounds[d + 1]] for d in range(n_docs)]
        for d in apart:
            out[d] = np.array(self.tokenizer.encode(raw[off[d] : off[d + 1]].decode(), add_special_tokens=False).ids, np.uint32)
        return out

    def _places(self, hashes: np.ndarray, raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(self.young.hashes) > KNOWN_UNITS:
            self.young, self.old = _Generation(), self.young
        at, known = self.young.find(hashes)
        if known.all():
            return at
        missing = np.flatnonzero(~known)
        at, older = self.old.find(hashes[missing])
        size = self.old.size[at[older]]
        self.young.add(hashes[missing[older]], self.old.ids[_ragged(self.old.begin[at[older]], size)], size)
        new = missing[~older]
        if len(new):
            self.young.add(hashes[new], *self._encoded(raw, start[new], end[new]))
        return self.young.find(hashes)[0]

    def _encoded(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units raw[start:end] in a row, and how many each has.

        ASCII letters with at most a space before them are one piece of the tokenizer's split, which its model takes as
        it is; other words are encoded many to a string, a line end before each.
        """
        data = np.frombuffer(raw, np.uint8)
        letters = np.append(0, np.cumsum((data | np.uint8(0x20)) - np.uint8(0x61) < 26))
        first = start + (data[start] == 0x20)
        plain = (first < end) & (letters[end] - letters[first] == end - first)
        out: list = [None] * len(start)
        merge, signs = self.tokenizer.model.tokenize, raw.decode("latin-1")
        at = np.flatnonzero(plain)
        for i, a, f, b in zip(at.tolist(), start[at].tolist(), first[at].tolist(), end[at].tolist()):
            out[i] = [t.id for t in merge(signs[a:b] if a == f else SPACE + signs[f:b])]
        at = np.flatnonzero(~plain)
        units = {i: raw[a:b] for i, a, b in zip(at.tolist(), start[at].tolist(), end[at].tolist())}
        texts = {i: u.decode() for i, u in units.items()}
        words = [i for i, u in units.items() if not texts[i].isspace() and not self.whole.search(u)]
        groups = [words[k : k + JOINED] for k in range(0, len(words), JOINED)]
        joined = ["".join(["\n" + texts[i] for i in g]) for g in groups]
        for g, e in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = e.ids
            cut = [k for k, x in enumerate(ids) if x == self.line]
            for i, a, b in zip(g, cut, [*cut[1:], len(ids)]):
                out[i] = ids[a + 1 : b]
        rest = [i for i in units if out[i] is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return np.fromiter(chain.from_iterable(out), np.uint32), np.fromiter(map(len, out), np.int64, len(out))
