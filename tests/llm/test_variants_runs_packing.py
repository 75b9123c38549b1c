"""Packing, spelling variants and periodic runs against brute force."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from gradus.llm import packing, periodic, units, variants
from gradus.llm.queries import ORACLES, QUERIES
from tests.conftest import SF
from tests.llm.common import WORD, edge_rows, frame, prose

BPE = public_tokenizers.path("byte_bpe_50k.json")


# packing

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def check_packing(pieces, ids_of, length=1024):
    """Every id lies in one piece, sequences have no gap and need no padding."""
    documents, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        documents[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(documents) == set(ids_of)
    for doc_id, rows in documents.items():
        rows.sort(key=lambda r: r.start)
        ids, at = ids_of[doc_id], 0
        for r in rows:
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == length or at < length and at & (at - 1) == 0
    return documents, sequences


def test_packing_covers_every_id(spark, tokenizer):
    r = random.Random(3)
    texts = [" ".join(prose(i, r.randrange(0, 700))) for i in range(120)] + [None, "", " \t\n", "é梦 𝄞 ▁x  y\n" * 30, "a  <|endoftext|> b<|endoftext|>", "x " * 20_000, "don't  \xa0stop  \n\n it's\x85 ok\x1c\x1dz​y"]
    docs = frame(spark, texts)
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    first = packing.pack(docs, BPE, block_bytes=50_000)
    _, sequences = check_packing(packing.digest(first).collect(), ids)
    total = sum(map(len, ids.values()))
    assert len(sequences) < total / 1024 + 12 * 10  # ten short ones a block at most
    again = packing.pack(docs.repartition(7), BPE, block_bytes=50_000)
    assert sorted(packing.digest(first).collect()) == sorted(packing.digest(again).collect())
    whole = packing.sequences(first).collect()
    assert all(s.padded == s.n_tokens and len(s.ids) == 4 * s.n_tokens and sum(s.lengths) == s.n_tokens for s in whole)
    assert sum(s.n_tokens for s in whole) == total


def test_units_encode_like_the_tokenizer(tokenizer):
    encoder = units.UnitEncoder(open(BPE, encoding="utf-8").read())
    r = random.Random(5)
    for letters in ("ab'sé梦 \t\n\r\x0b\x0c\x1c\x85\xa0   ​　1,.<|>🙂e", "abzT's 1,.\n \t-é🙂_<", "a b\n"):
        texts = ["".join(r.choice(letters) for _ in range(r.randrange(0, 60))) for _ in range(3000)] + ["", "a<|endoftext|>  b", "x  <|endoftext|>", "don't 'they 's we'LL", " "]
        for part in (texts[:1500], texts[1500:], texts):
            raw = [t.encode() for t in part]
            got = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(x) for x in raw]))
            assert [g.tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in part]


def test_units_of_earlier_generations(tokenizer, monkeypatch):
    monkeypatch.setattr(units, "KNOWN_UNITS", 40)
    encoder = units.UnitEncoder(open(BPE, encoding="utf-8").read())
    for i in range(30):
        text = " ".join(prose(i % 7, 60, 300))
        got = encoder.encode(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        assert got[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_assignment_is_the_greedy_rule():
    r = random.Random(7)
    for _ in range(60):
        lengths = [r.randrange(1, 65) for _ in range(r.randrange(1, 60))]
        got = packing.assign(lengths, 64, 8)
        size = packing.rooms(sum(lengths), 64).tolist()
        assert sum(size) == sum(lengths) and all(s == 64 or s & (s - 1) == 0 for s in size)
        room, spent, want = list(size), [0.0] * len(size), []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            done = 0
            while done < lengths[i]:
                fits = [s for s in range(len(size)) if room[s] >= lengths[i] - done]
                s = min(fits, key=lambda s: (spent[s], s)) if fits else max(range(len(size)), key=lambda s: (room[s], -s))
                n = min(lengths[i] - done, room[s])
                want.append((i, done, n, s, size[s] - room[s]))
                room[s] -= n
                spent[s] += packing.cost(n, 8)
                done += n
        assert got == want and not any(room)


def test_costs_are_balanced():
    r = random.Random(8)
    lengths = [int(min(400, 20 + r.expovariate(1 / 100))) for _ in range(2000)]

    def spread(pieces):
        costs = Counter()
        for i, _, n, s, _ in pieces:
            costs[s] += packing.cost(n, 64)
        whole = [costs[s] for s in range(sum(lengths) // 1024)]
        return np.std(whole) / np.mean(whole)

    in_order, at = [], 0
    for i, n in enumerate(lengths):  # documents one after the other, cut every 1024
        done = 0
        while done < n:
            step = min(n - done, 1024 - at % 1024)
            in_order.append((i, done, step, at // 1024, at % 1024))
            done, at = done + step, at + step
    assert spread(packing.assign(lengths, 1024, 64)) < 0.7 * spread(in_order)


def test_packing_edges(spark, tokenizer):
    rows = edge_rows(spark)
    got = packing.digest(packing.pack(rows, BPE)).collect()
    want = Counter()
    for r in rows.collect():
        want[r.doc_id] += len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
    have = Counter()
    for r in got:
        have[r.doc_id] += r.length
    assert have == want
    assert packing.pack(rows.limit(0), BPE).count() == 0
    with pytest.raises(ValueError):
        packing.pack(rows, BPE, length=1000)


# spelling variants

def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words):
    near = {w: [o for o in words if one_edit(w, o)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] is not None else None))
    return sorted(out)


def brute_words(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if n >= 3 and len(w) >= 5}


def test_letter_trees_match_brute_force(spark):
    r = random.Random(11)
    words = {}
    for _ in range(1500):
        w = "".join(r.choice("abcéÉÿ÷z") for _ in range(r.choice([5, 5, 6, 6, 7, 9])))
        words[w] = int(3 * 2 ** r.expovariate(0.5))
    words |= {"a" * 300: 3, "a" * 301: 9, "a" * 300 + "b": 40, "b" * 70 + "é" * 90: 5, "b" * 70 + "é" * 91: 10}
    table = spark.createDataFrame(list(words.items()), "word string, n bigint").repartition(3)
    for cell in (60, 8192):
        links = variants.near_words(table, cell).collect()
        assert len(links) == len(set(links))
        want = {(w, o, n) for w in words for o, n in words.items() if one_edit(w, o)}
        assert {tuple(x) for x in links} == want
    got = sorted(tuple(x) for x in variants.variants(table).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == brute_variants(words)


def test_variants_of_texts(spark):
    r = random.Random(12)
    base = ["colour", "Étude", "façade", "harbour", "thinking", "naïveté", "mull×er"]
    texts = []
    for _ in range(300):
        w = [r.choice(base) for _ in range(12)]
        k = r.randrange(12)
        w[k] = w[k][:3] + r.choice("xyzÀ") + w[k][r.choice([3, 4]) :]
        texts.append(r.choice([" ", "-", "\n", "1"]).join(w).upper() if r.random() < 0.2 else " ".join(w))
    docs = frame(spark, texts + [None, "", "thinking " * 50]).unionByName(edge_rows(spark))
    got = sorted(tuple(x) for x in variants.spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect())
    want = brute_variants(brute_words([(x.doc_id, x.text) for x in docs.collect()]))
    assert got == want and any(w[2] != w[0] and w[2] != w[1] for w in want) | any(w[1] for w in want)
    assert variants.spelling_variants(docs.limit(0)).count() == 0


def test_chains_of_forms(spark):
    words = {"aaaaa" + "b" * k: 3 * 2**k for k in range(12)}
    table = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = {x.word: x.root for x in variants.variants(table).collect()}
    assert set(got.values()) == {"aaaaa" + "b" * 11}


def test_variants_oracle(spark, duck):
    names = ["word", "form", "root", "n", "n_near", "form_n"]
    got = sorted(map(tuple, QUERIES["op12_letter_trees"](spark, SF).select(*names).collect()), key=str)
    want = sorted(duck.execute(f"SELECT {', '.join(names)} FROM ({ORACLES['op12_letter_trees']})").fetchall(), key=str)
    assert got == want and len(got) > 1000


# periodic runs

def brute_runs(w):
    found = set()
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            s = w[i - q : j]
            if len(s) >= max(6, 4 * q) and not any(s[d:] == s[:-d] for d in range(1, q)):
                found.add((i - q, len(s), q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_digest(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    rs = brute_runs(w)
    dropped = {i for s, length, q in rs for i in range(s + q, s + length)}
    top = min(rs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    listing = "".join(f"{s},{length},{q}\n" for s, length, q in rs)
    kept = " ".join(x for i, x in enumerate(w) if i not in dropped)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (listing, kept)]
    return (doc_id, len(rs), *top, top[1] * 1000 // top[2] if rs else None, *sha)


def patched(r, k, n):
    out = []
    while len(out) < n:
        if r.random() < 0.4:
            out += [f"w{r.randrange(k)}" for _ in range(r.randrange(1, 12))]
        else:
            unit = [f"w{r.randrange(k)}" for _ in range(r.randrange(1, r.choice([4, 8, 40])))]
            out += unit * r.randrange(2, 9) + unit[: r.randrange(len(unit))]
    return out


def test_runs_match_brute_force(spark):
    r = random.Random(21)
    texts = [r.choice([" ", "\n", "\t "]).join(patched(r, r.choice([1, 2, 3, 10, 400]), r.randrange(0, 500))) for _ in range(400)]
    texts += [None, "", "x " * 3000, "a b c " * 4, "a a a a a", "a a a a a a", "1 2 " * 3 + "1 2", " ".join(prose(4, 900) * 5), "é梦 x\x0b" * 9]
    got = sorted(map(tuple, periodic.digest(periodic.periodic_runs(frame(spark, texts), plant=True)).collect()))
    want = [brute_digest(i, t) for i, t in enumerate(texts)]
    assert got == want and sum(w[1] for w in want) > 1000
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))) > 20


def test_long_texts_of_few_words_end(spark):
    r = random.Random(22)
    blocks = [w for _ in range(60) for w in ["la"] * r.randrange(900, 1100) + [f"x{r.randrange(10**6)}"]]
    rows = periodic.periodic_runs(frame(spark, [" ".join(blocks), "la " * 200_000])).orderBy("doc_id").collect()
    assert len(rows[0].starts) == 60 and set(rows[0].periods) == {1}
    assert (rows[1].starts, rows[1].lengths, rows[1].collapsed) == ([0], [200_000], b"la")


def test_run_edges(spark):
    rows = edge_rows(spark)
    got = sorted(map(tuple, periodic.digest(periodic.periodic_runs(rows, plant=True)).collect()), key=str)
    assert len(got) == rows.count()
    small = {str(g) for g in got if g[0] not in (7, 9)}
    assert small == {str(brute_digest(x.doc_id, x.text)) for x in rows.collect() if x.doc_id not in (7, 9)}
    assert periodic.periodic_runs(rows.limit(0)).count() == 0


def test_new_units_encode_from_spans(tokenizer):
    encoder = units.UnitEncoder(open(BPE, encoding="utf-8").read())
    texts = ["word", " Word", "é", " né", "   ", "\n", " 12", "don", "'t", " x", "a\xc1", " ", "<|endoftext|>", "Z"]
    raw = [t.encode() for t in texts]
    end = np.cumsum([len(x) for x in raw])
    ids, size = encoder._encoded(b"".join(raw), end - [len(x) for x in raw], end)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert size.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
