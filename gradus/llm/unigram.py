"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

A text is given a leading white-space marker, its spaces become markers, and the segmentation into pieces with the
highest sum of log scores is taken; a character that no piece starts with falls back to its bytes' pieces. No piece of
the usual vocabularies has a marker after another character, so the best path breaks before every run of markers, and
each distinct segment is solved once per task; the segments of one length are solved in lock step in numpy.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from gradus.llm.text import chunks

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_SEGMENTS = 150_000
LANES = 2048
ROUND_TRIP_BYTES = 1 << 19
LONG = 96


@dataclass
class Model:
    """Pieces by id (bytes with markers as spaces), their scores and the double-array trie of those that segments use."""

    pieces: list[bytes]
    scores: np.ndarray
    byte_ids: np.ndarray
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    unknown: float
    breaks: bool


def double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value of a trie over bytes: from state s, byte c leads to base[s] + c if check there is s."""
    root: dict = {}
    for key, number in keys.items():
        node = root
        for c in key:
            node = node.setdefault(c, {})
        node[-1] = number
    base, check, value = [0] * 512, [-1] * 512, [-1] * 512
    check[0] = 0
    todo, free = [(0, root)], 1
    for state, node in todo:
        value[state] = node.get(-1, -1)
        children = sorted(c for c in node if c >= 0)
        if not children:
            continue
        while check[free] >= 0:
            free += 1
            if free + 600 > len(check):
                base, check, value = (x + [f] * len(x) for x, f in ((base, 0), (check, -1), (value, -1)))
        begun = at = max(free, children[0] + 1)
        while True:
            if at + 600 > len(check):
                base, check, value = (x + [f] * len(x) for x, f in ((base, 0), (check, -1), (value, -1)))
            shift = at - children[0]
            if all(check[shift + c] < 0 for c in children):
                break
            at += 1
        if at - begun > 64:  # what lies before is nearly full: look there no more
            free = at
        base[state] = shift
        for c in children:
            check[shift + c] = state
            todo.append((shift + c, node[c]))
    return np.array(base, np.int32), np.array(check, np.int32), np.array(value, np.int32)


def load_model(path: str) -> Model:
    """Reads a SentencePiece model file on the driver; its arrays go to the tasks with the function."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    names = [sp.id_to_piece(i) for i in range(n)]
    plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    byte_ids = np.full(256, sp.unk_id(), np.int32)
    for i in range(n):
        if sp.is_byte(i):
            byte_ids[int(names[i][3:5], 16)] = i
    scores = np.array([sp.get_score(i) for i in range(n)])
    return make_model({names[i]: i for i in plain}, scores, byte_ids, [bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else names[i].replace(MARK, " ").encode() for i in range(n)])


def make_model(names: dict[str, int], scores: np.ndarray, byte_ids: np.ndarray, pieces: list[bytes]) -> Model:
    base, check, value = double_array({k.encode(): i for k, i in names.items()})
    unknown = float(scores[list(names.values())].min()) - UNKNOWN_PENALTY
    return Model(pieces, scores, byte_ids, base, check, value, unknown, not any(MARK in k.lstrip(MARK) for k in names))


def _char_bytes(lead: np.ndarray) -> np.ndarray:
    return np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))


def best_path(m: Model, raw: bytes, base: list, check: list, value: list, scores: list) -> list[int]:
    """Ids of one segment's best path."""
    n = len(raw)
    best, start, piece = [None] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    for i in range(n):
        if best[i] is None:
            continue
        lead = raw[i]
        char = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        state, single = 0, False
        for j in range(i, n):
            to = base[state] + raw[j]
            if check[to] != state or to == 0:
                break
            state = to
            if value[state] >= 0:
                single |= j + 1 - i == char
                score = best[i] + scores[value[state]]
                if best[j + 1] is None or score > best[j + 1]:
                    best[j + 1], start[j + 1], piece[j + 1] = score, i, value[state]
        if not single and (best[i + char] is None or best[i] + m.unknown > best[i + char]):
            best[i + char], start[i + char], piece[i + char] = best[i] + m.unknown, i, -1
    out, at = [], n
    while at:
        out += [piece[at]] if piece[at] >= 0 else [int(m.byte_ids[c]) for c in reversed(raw[start[at] : at])]
        at = start[at]
    return out[::-1]


def best_paths(m: Model, raws: list[bytes]) -> list[list[int]]:
    """Ids of the best paths of segments of like length, position by position for all of them at once."""
    lanes, n = len(raws), max(map(len, raws))
    length = np.array([len(r) for r in raws])
    text = np.zeros((lanes, n + 4), np.uint8)
    for k, r in enumerate(raws):
        text[k, : len(r)] = np.frombuffer(r, np.uint8)
    best = np.full((lanes, n + 5), -np.inf)
    start, piece = np.zeros((lanes, n + 5), np.int32), np.full((lanes, n + 5), -1, np.int32)
    best[:, 0] = 0
    for i in range(n):
        row = np.flatnonzero((length > i) & (best[:, i] > -np.inf))
        char = _char_bytes(text[row, i])
        single, from_here = np.zeros(lanes, bool), best[:, i]
        char_of = np.zeros(lanes, np.int64)
        char_of[row] = char
        live, state = row, np.zeros(len(row), np.int32)
        for j in range(i, n):
            to = m.base[state] + text[live, j]
            go = (m.check[to] == state) & (to > 0) & (length[live] > j)
            live, state = live[go], to[go]
            if not len(live):
                break
            number = m.value[state]
            has = number >= 0
            who, number = live[has], number[has]
            single[who] |= char_of[who] == j + 1 - i
            score = from_here[who] + m.scores[number]
            better = score > best[who, j + 1]
            who, number, score = who[better], number[better], score[better]
            best[who, j + 1], start[who, j + 1], piece[who, j + 1] = score, i, number
        need = ~single[row]
        who, to = row[need], i + char[need]
        score = from_here[who] + m.unknown
        better = score > best[who, to]
        who, to, score = who[better], to[better], score[better]
        best[who, to], start[who, to], piece[who, to] = score, i, -1
    out = []
    starts, pieces = start.tolist(), piece.tolist()
    for k, r in enumerate(raws):
        ids, at = [], len(r)
        while at:
            ids += [pieces[k][at]] if pieces[k][at] >= 0 else [int(m.byte_ids[c]) for c in reversed(r[starts[k][at] : at])]
            at = starts[k][at]
        out.append(ids[::-1])
    return out


class Encoder:
    """Encodes texts; remembers the ids of the segments it has met, up to CACHE_SEGMENTS."""

    def __init__(self, model: Model):
        self.model = model
        self.cut = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+") if model.breaks else re.compile("(?s).+")
        self.lists = [model.base.tolist(), model.check.tolist(), model.value.tolist(), model.scores.tolist()]
        self._clear()

    def _clear(self) -> None:
        self.known, self.ids, self.ends = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _solve(self, segments: list[str]) -> None:
        raws = [s.encode() for s in segments]
        solved: list[list[int]] = [[]] * len(raws)
        order = sorted(range(len(raws)), key=lambda k: len(raws[k]))
        short = [k for k in order if len(raws[k]) <= LONG]
        for at in range(0, len(short), LANES):
            part = short[at : at + LANES]
            for k, ids in zip(part, best_paths(self.model, [raws[k] for k in part])):
                solved[k] = ids
        for k in order[len(short) :]:
            solved[k] = best_path(self.model, raws[k], *self.lists)
        flat = np.fromiter((i for ids in solved for i in ids), np.int32)
        self.ids = np.concatenate([self.ids, flat])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(ids) for ids in solved])])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts and the offsets of each text's."""
        if len(self.known) > CACHE_SEGMENTS:
            self._clear()
        known, codes, count, new = self.known, [], [0], []
        for t in texts:
            if t:
                for s in self.cut.findall(MARK + t.replace(" ", MARK)):
                    c = known.get(s)
                    if c is None:
                        c = known[s] = len(known)
                        new.append(s)
                    codes.append(c)
            count.append(len(codes))
        if new:
            self._solve(new)
        code = np.array(codes, np.int64)
        start = self.ends[code]
        length = self.ends[code + 1] - start
        ends = np.concatenate([[0], np.cumsum(length)])
        at = np.repeat(start - ends[:-1], length) + np.arange(ends[-1])
        return self.ids[at], ends[np.array(count)]


def decode_bytes(m: Model, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
    """UTF-8 of each row of ids; the leading marker goes."""
    size = np.array([len(p) for p in m.pieces])
    ends = np.cumsum(size)
    flat = np.frombuffer(b"".join(m.pieces), np.uint8)
    length = size[ids]
    to = np.concatenate([[0], np.cumsum(length)])
    data = flat[np.repeat(ends[ids] - length - to[:-1], length) + np.arange(to[-1])].tobytes()
    return [data[to[a] : to[b]].removeprefix(b" ") for a, b in zip(off[:-1], off[1:])]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(model: Model, path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(model)
    return _ENCODERS[path]


def _schema(rows: DataFrame, out: str, kind) -> StructType:
    return StructType([f for f in rows.schema.fields if f.name != out] + [StructField(out, kind)])


def encode(rows: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds the ids of a text column under the model file at `path` (read on the driver); null and empty give none."""
    model = rows.sparkSession.sparkContext.broadcast(load_model(path))
    names = [c for c in rows.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model.value, path)
        for batch in batches:
            for part, _, _ in chunks(batch, text):
                column = part.column(part.schema.get_field_index(text))
                ids, off = encoder.encode(column.to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*names, out])

    return rows.select(*names).mapInArrow(run, _schema(rows, out, ArrayType(IntegerType())))


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of an id column: markers become spaces, the leading one goes, byte pieces join to UTF-8.

    Null ids give an empty text, bytes that are no UTF-8 the replacement character.
    """
    model = rows.sparkSession.sparkContext.broadcast(load_model(path))
    names = [c for c in rows.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                column = part.column(part.schema.get_field_index(ids))
                size = np.array([len(x) if x.is_valid else 0 for x in column])
                flat = column.flatten().to_numpy(zero_copy_only=False)
                texts = [x.decode(errors="replace") for x in decode_bytes(model.value, flat, np.concatenate([[0], np.cumsum(size)]))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*names, out])

    return rows.select(*names).mapInArrow(run, _schema(rows, out, StringType()))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, n_chars, round_trip): every text's ids, and whether decoding them gives it back.

    Encoding and decoding share one Python worker. A text that holds the marker character itself comes back with a
    space for it, all others exactly; a null text is empty.
    """
    model = docs.sparkSession.sparkContext.broadcast(load_model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model.value, path)
        for batch in batches:
            for part, data, off in chunks(batch, "text", ROUND_TRIP_BYTES):
                ids, at = encoder.encode(part.column(1).to_pylist())
                back = decode_bytes(model.value, ids, at)
                same = [b == data[x:y].tobytes() for b, x, y in zip(back, off[:-1], off[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)),
                     pa.array([len(b.decode(errors="replace")) for b in back], pa.int64()), pa.array(same, pa.bool_())],
                    names=["doc_id", "n_tokens", "ids", "n_chars", "round_trip"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids array<int>, n_chars bigint, round_trip boolean")
