import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradus.llm import hyperminhash, suffix, windows
from gradus.llm.components import components
from gradus.llm.text import buffers
from tests.llm.common import KINDS, WORD, changed, edge_rows, frame, prose


def family(seed, shares, n=300):
    base = prose(seed, n)
    return [" ".join(base)] + [" ".join(changed(base, seed * 100 + i, s)) for i, s in enumerate(shares)]


def brute_components(texts, size=2, percent=80):
    sets = []
    for t in texts:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(t or "")]
        sets.append({tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1 if w else 0))})
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return [(i, len(s), root[i], i == root[i]) for i, s in enumerate(sets)]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_match_brute_force(spark, size):
    texts = [t for s in range(12) for t in family(s, [0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.2])]
    texts += [" ".join(prose(1000 + i, n)) for i, n in enumerate((1, 2, 3, 4, 5, 6, 7, 8, 9))] + ["A b c d e", "a B c d e f", "a b", None, ""]
    texts += [" ".join(prose(7, n)) for n in range(4, 40)]
    got = hyperminhash.near_duplicates(frame(spark, texts), size=size).collect()
    assert sorted(tuple(r) for r in got) == brute_components(texts, size)


def test_chain_beyond_a_groups_center(spark):
    base = prose(3, 400)
    texts, now = [], base
    for i in range(30):  # each alike to the one before, the ends not to each other
        texts.append(" ".join(now))
        now = now[12:] + prose(500 + i, 12)
    random.Random(1).shuffle(texts)
    got = hyperminhash.near_duplicates(frame(spark, texts)).collect()
    assert sorted(tuple(r) for r in got) == brute_components(texts)


@pytest.mark.parametrize("n", [1010, 505])
def test_open_pairs_across_numbers_of_seeds(spark, n):
    base = prose(n, n, 10**9)
    texts = []
    for i in range(120):  # lead every band that the last two share, and are alike to nothing
        at, new = random.Random(i).randrange(n), prose(100 + i, n // 7, 10**9)
        turned = base[at:] + base[:at]
        texts.append(" ".join((new + turned[n // 7 :])[n - at :] + (new + turned[n // 7 :])[: n - at]))
    texts += [" ".join(base), " ".join(base + prose(99, n // 25, 10**9))]
    assert (hyperminhash.seeds_for(np.array([n - 1])) == 2 * hyperminhash.seeds_for(np.array([n + n // 25 - 1]))).all()
    want = brute_components(texts)
    assert want[-1][2] == 120 and all(kept for *_, kept in want[:-1])
    got = hyperminhash.near_duplicates(frame(spark, texts)).collect()
    assert sorted(tuple(r) for r in got) == want


def test_estimate_is_corrected():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 2**63, (2, 40_000)).astype(np.uint64)
    for share in (0.0, 0.5, 0.8):
        k = int(40_000 * share)
        other = np.concatenate([a[:k], b[k:]])
        one = hyperminhash.registers(a, np.zeros(len(a), int), 1, np.array([1]))
        two = hyperminhash.registers(other, np.zeros(len(a), int), 1, np.array([1]))
        assert abs(float(hyperminhash.estimate(one, two)[0]) - k / (80_000 - k)) < 0.12


def test_components(spark):
    links = [(5, 4), (4, 3), (10, 11), (11, 12), (12, 10), (3, 20), (30, 31)]
    got = dict(components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert got == {3: 3, 4: 3, 5: 3, 20: 3, 10: 10, 11: 10, 12: 10, 30: 30, 31: 30}


def test_near_duplicates_edges(spark):
    got = hyperminhash.near_duplicates(edge_rows(spark)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == 12 and len(by[5]) == 2
    assert all(r.component_id is None and r.kept is None for r in by[None])
    assert by[6][0].component_id == 5 and not by[6][0].kept and by[9][0].component_id == 7
    assert [by[i][0].n_shingles for i in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert hyperminhash.near_duplicates(spark.createDataFrame([], KINDS)).count() == 0


def brute_repeats(texts, length=200):
    seen = {}
    raws = [(t or "").encode() for t in texts]
    for i, r in enumerate(raws):
        for p in range(len(r) - length + 1):
            seen.setdefault(r[p : p + length], []).append((i, p))
    out = []
    for i, r in enumerate(raws):
        gone = np.zeros(len(r) + 1, bool)
        for p in range(len(r) - length + 1):
            if len(seen[r[p : p + length]]) > 1:
                gone[p : p + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + (gone[:1].sum()))
        kept = bytes(c for c, g in zip(r, gone) if not g)
        out.append((i, len(r), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def passages_between(n=40):
    shared = [" ".join(prose(900 + i, 60)) for i in range(4)]
    texts = []
    for i in range(n):
        words = prose(i, 80 + 7 * i)
        texts.append(" ".join(words[:40]) + " " + shared[i % 4][i : 300 - i] + " " + " ".join(words[40:]))
    return texts


@pytest.mark.parametrize("limit", [4096, 3])
def test_repeats_match_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(suffix, "SHARD_PIECES", limit)
    line = " ".join(prose(5000, 22))[:120]
    texts = passages_between() + [f"{line} {i} {' '.join(prose(700 + i, 60))}" for i in range(20)]
    texts += ["ab" * 300, "a" * 700, "é" * 150 + "x", "é" * 99, None, "", "z" * 199, texts[0], texts[0], texts[3][:250], "q" + texts[3][10:240]]
    got = suffix.remove_repeats(frame(spark, texts)).collect()
    assert sorted(tuple(r) for r in got) == brute_repeats(texts)


def test_repeats_edges(spark):
    got = {(r.doc_id, r.n_bytes): r for r in suffix.remove_repeats(edge_rows(spark)).collect()}
    assert got[(5, 400)].n_removed == got[(6, 400)].n_removed == 400
    assert got[(1, 0)].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[(7, next(n for i, n in got if i == 7))].n_spans == 1
    assert suffix.remove_repeats(spark.createDataFrame([], KINDS)).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(2)
    pieces = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in (0, 1, 30, 200)] + [b"abab" * 20]
    ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
    s = np.concatenate([np.append(np.frombuffer(p, np.uint8).astype(np.int64), 256 + i) for i, p in enumerate(pieces)])
    sa, rank = suffix.suffix_array(s)
    want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
    assert sa.tolist() == want and (sa[rank] == np.arange(len(s))).all()
    lcp = suffix.common_prefixes(s, sa, rank, ends - [len(p) for p in pieces], ends)
    for r in range(1, len(s)):
        a, b = s[sa[r - 1] :].tolist(), s[sa[r] :].tolist()
        n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        if s[sa[r]] < 256:
            assert lcp[r] == n


def test_compact_windows_match_brute_force():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 2**63, 300).astype(np.uint64)
    doc = np.repeat([0, 1, 2, 4], [120, 20, 100, 60])
    got = set(zip(*(x.tolist() for x in windows.compact_windows(v, doc, 30))))
    want = set()
    for d in np.unique(doc):
        lo, hi = np.flatnonzero(doc == d)[[0, -1]]
        for c in range(lo, hi + 1):
            l = c
            while l > lo and v[l - 1] > v[c]:
                l -= 1
            r = c
            while r < hi and v[r + 1] > v[c]:
                r += 1
            if r - l + 1 >= 30:
                want.add((c, l, r))
    assert got == want


def test_passages(spark):
    shared = prose(77, 70)
    near = shared[:30] + ["other"] + shared[31:]
    texts = [" ".join(prose(i, 120)) for i in range(12)]
    texts[2] = " ".join(prose(2, 60) + shared + prose(22, 50))
    texts[7] = " ".join(prose(7, 20) + shared)
    texts[9] = " ".join(prose(9, 200) + near + prose(99, 10))
    texts[4] = " ".join(prose(4, 20) + shared[:40] + prose(44, 30))  # too short a passage
    docs = frame(spark, texts + [None, ""])
    got = {r.doc_id: r for r in windows.near_passages(docs).collect()}
    assert set(got) == {2, 7, 9}
    assert got[2].n_removed_words == 0 and got[2].n_links == 2
    assert [(s.s, s.e) for s in got[7].spans] == [(20, 90)]
    assert got[9].first_id == 2 and 50 <= got[9].n_removed_words <= 74
    left = {r.doc_id: r for r in windows.remove_passages(docs).collect()}
    assert left[7].text == " ".join(prose(7, 20)) + " " and left[2].text == texts[2] and left[4].kept == "x"
    assert len(left) == len(texts) + 2


def test_passages_edges(spark):
    got = {r.doc_id: r for r in windows.near_passages(edge_rows(spark)).collect()}
    assert {7, 9} <= set(got) and got[9].n_removed_words >= 30_000
    assert windows.remove_passages(edge_rows(spark)).count() == 12
    assert windows.near_passages(spark.createDataFrame([], KINDS)).count() == 0


def test_passages_of_repeated_words(spark):
    loops = " ".join(w for w in prose(3, 9) for _ in range(17))
    texts = [loops, " ".join(prose(4, 80)), loops + " more words", " ".join(prose(5, 60)) + " " + loops]
    got = {r.doc_id: [(s.s, s.e) for s in r.spans] for r in windows.near_passages(frame(spark, texts)).collect()}
    assert got == {0: [], 2: [(0, 153)], 3: [(60, 213)]}


def test_passages_of_families_that_share_a_phrase(spark):
    phrase = prose(1000, 45)
    copied = [prose(1100 + i, 6) + phrase + prose(1200 + i, 6) for i in range(10)]
    texts = [" ".join(prose(1300 + i, 60) + copied[i % 10] + prose(1400 + i, 60)) for i in range(20)]
    got = {r.doc_id: [(s.s, s.e) for s in r.spans] for r in windows.near_passages(frame(spark, texts)).collect()}
    assert got == {i: [(60, 117)] if i >= 10 else [] for i in range(20)}


def test_passages_in_a_chain_are_one_class(spark):
    one, two = prose(2100, 60), prose(2200, 60)
    held = [one, one + prose(2300, 30) + two, two, one, prose(2400, 90), prose(2500, 30) + two[:20]]
    texts = [" ".join(prose(2600 + i, 40) + x + prose(2700 + i, 40)) for i, x in enumerate(held)]
    got = {r.doc_id: r for r in windows.near_passages(frame(spark, texts)).collect()}
    assert {i: r.class_id for i, r in got.items()} == {0: 0, 1: 0, 2: 0, 3: 0}
    assert got[2].first_id == 1


def test_passages_alike_to_a_copy_alone_are_linked(spark):
    """The third text of each family is alike to the second alone, whose passage the first holds; earlier texts hold most of it."""
    texts, families = [], [prose(2800 + i, 60) for i in range(8)]
    for part in (slice(0, 42), slice(18, 60), slice(0, 42), slice(18, 60)):
        for x in families:
            texts.append(" ".join(prose(28_200 + len(texts), 30) + x[part] + prose(28_600 + len(texts), 30)))
    for change in (15, None, 44):
        for x in families:
            x = [w if k != change else f"new{len(texts)}" for k, w in enumerate(x)]
            texts.append(" ".join(prose(2910 + len(texts), 40) + x + prose(2980 + len(texts), 40)))
    got = {r.doc_id: (r.class_id, [(s.s, s.e) for s in r.spans]) for r in windows.near_passages(frame(spark, texts)).collect()}
    assert got == {32 + 8 * k + i: (32 + i, [(40, 100)] if k else []) for k in range(3) for i in range(8)}


def test_passages_of_many_families_that_share_a_line(spark):
    """More texts than a small group holds; a third text of each family is alike to the second alone."""
    line, texts = prose(2900, 24), []
    copied = [prose(3100 + i, 18) + line + prose(3200 + i, 18) for i in range(16)]
    for change in (4, None, 55):
        for i, x in enumerate(copied):
            x = [w if k != change else f"new{i}" for k, w in enumerate(x)]
            x = x if change is None else [w if k != 30 + (change > 30) * 8 else f"inner{i}" for k, w in enumerate(x)] if i % 2 else x
            texts.append(" ".join(prose(3300 + len(texts), 60) + x + prose(3400 + len(texts), 60)))
    got = {r.doc_id: r for r in windows.near_passages(frame(spark, texts)).collect()}
    assert len(texts) > 32 + 1  # windows.SMALL
    assert all(got[i].class_id == got[16 + i].class_id == i for i in range(0, 16, 2))
    assert all(got[32 + i].class_id == i for i in range(0, 16, 2))


def test_equal_texts_with_passages(spark):
    shared = " ".join(prose(2950, 70))
    texts = [" ".join(prose(2960, 30)) + " " + shared, "short text", shared, "short text", shared, " ".join(prose(2970, 30)) + " " + shared]
    got = {r.doc_id: r for r in windows.near_passages(frame(spark, texts)).collect()}
    assert {i: r.class_id for i, r in got.items()} == {0: 0, 2: 0, 4: 0, 5: 0}
    assert [(s.s, s.e) for s in got[4].spans] == [(0, 70)] and [(s.s, s.e) for s in got[5].spans] == [(30, 100)]


def test_passages_are_alike_in_both_directions():
    mine = np.arange(50, dtype=np.uint64)
    other = np.concatenate([mine, np.tile(mine[10:15], 30), mine])
    for a, b in ((mine, other), (other, mine)):
        assert windows._alike(a, b, np.arange(len(a)), np.array([int(np.flatnonzero(b == x)[0 if i < 50 else -1]) for i, x in enumerate(a)]))


def edited(rng, words, changes, clustered):
    words, at = list(words), rng.integers(0, len(words) - 8)
    places = at + rng.permutation(8)[:changes] if clustered else rng.permutation(len(words))[:changes]
    for i in sorted(places, reverse=True):
        words[i : i + 1] = [[f"new{i}"], [], [words[i], f"more{i}"]][rng.integers(0, 3)]
    return words


def test_planted_passages_are_found(spark):
    """Edits spread or clustered, among documents that share lines: the whole search against Jaccard on the spans."""
    rng = np.random.default_rng(5)
    lines = [prose(3000 + i, n) for i, n in enumerate((8, 13, 20, 30))]
    texts, planted = [], {}
    for i in range(200):
        words = prose(4000 + i, 60 + int(rng.integers(0, 100)))
        first = words + lines[i % 4] + prose(5000 + i, 30)
        shared = prose(6000 + i, int(rng.integers(54, 150)))
        other = edited(rng, shared, 1 + len(shared) // 70, bool(i % 2))
        a, b = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (shared, other))
        if len(other) >= 50 and len(a & b) >= 0.8 * len(a | b):
            planted[200 + i] = (len(first) - 30, len(other))
        texts.append(" ".join(first[:-30] + shared + first[-30:]))
        planted_text = prose(7000 + i, len(first) - 30 - len(lines[i % 4])) + lines[i % 4] + other + prose(8000 + i, 30)
        texts.append(" ".join(planted_text))
    texts = texts[::2] + texts[1::2]
    got = {r.doc_id: {w for s in r.spans for w in range(s.s, s.e)} for r in windows.near_passages(frame(spark, texts)).collect()}
    hit = [len(got.get(i, set()) & set(range(s, s + n))) >= 0.8 * n for i, (s, n) in planted.items()]
    assert len(hit) > 100 and sum(hit) >= 0.98 * len(hit)


def shingle_numbers(*texts):
    known = {}
    return [np.array([known.setdefault(tuple(t[i : i + 5]), len(known)) for i in range(len(t) - 4)], np.uint64) for t in texts]


def brute_passages(mine, other):
    """Spans of shingles from one shared one to another that are at least 50 words and alike, in texts without repeated shingles."""
    place = {int(x): i for i, x in enumerate(other)}
    hits = [(i, place[int(x)]) for i, x in enumerate(mine) if int(x) in place]
    out = []
    for a, c in hits:
        for b, d in hits:
            if b - a + 5 >= 50 and d > c:
                x, y = set(mine[a : b + 1].tolist()), set(other[c : d + 1].tolist())
                if len(x & y) >= 0.8 * len(x | y):
                    out.append((a, b + 5))
    return out


def covered(spans):
    return {w for s in spans for w in range(s[0], s[1])}


def test_passages_with_an_inserted_block():
    old = prose(1, 80, 10**9)
    new = prose(2, 30, 10**9) + old[:40] + prose(3, 7, 10**9) + old[40:] + prose(4, 30, 10**9)
    mine, other = shingle_numbers(new, old)
    assert windows.passages(mine, other, [(0, len(mine))]) == [(30, 117, 0, 80)]


def test_passages_before_a_weaker_tail():
    old = prose(5, 500, 10**9)
    new = [f"y{i}" if (i % 50 == 49 if i < 250 else i % 9 == 0) else w for i, w in enumerate(old)]
    mine, other = shingle_numbers(new, old)
    assert covered(windows.passages(mine, other, [(0, len(mine))])) >= set(range(249))


@pytest.mark.parametrize("seed", range(12))
def test_passages_match_brute_force(seed):
    r = random.Random(seed)
    old = prose(seed, 160, 10**9)
    new, at = [], 0
    while at < len(old):  # exact pieces with a changed, an inserted or a dropped block between
        n = r.randrange(12, 60)
        new += old[at : at + n]
        at += n + r.choice([0, 0, 1, 5])
        new += prose(1000 * seed + at, r.choice([0, 1, 6, 12]), 10**9)
    mine, other = shingle_numbers(new, old)
    want, got = brute_passages(mine, other), windows.passages(mine, other, [(0, len(mine))])
    assert bool(got) == bool(want)
    for a, b, c, d in got:
        x, y = set(mine[a : b - 4].tolist()), set(other[c : d - 4].tolist())
        assert b - a >= 50 and len(x & y) >= 0.8 * len(x | y)
    if want:
        a, b = max(want, key=lambda s: s[1] - s[0])
        assert len(covered(got) & set(range(a, b))) >= 0.8 * (b - a)


def test_a_stray_shingle_does_not_stretch_a_passage():
    old = prose(6, 200, 10**9)
    new = old[:150] + prose(7, 20, 10**9) + old[180:185] + prose(8, 20, 10**9)
    mine, other = shingle_numbers(new, old)
    assert windows.passages(mine, other, [(0, len(mine))]) == [(0, 150, 0, 150)]


def test_pairs_are_cut_by_the_bytes_of_both_texts():
    rows = [{"doc_id": i + 1, "first_id": 0, "text": "a b", "first_text": f"{i // 4} " + "word " * 10_000} for i in range(40)]
    parts = list(windows._pair_chunks(pa.RecordBatch.from_pylist(rows), 1 << 17))
    assert [x.num_rows for x in parts] == [8] * 5
    assert sum(x.num_rows for x in windows._verifier(iter([pa.RecordBatch.from_pylist(rows)]))) == 0


def test_a_cell_gives_each_open_pair_once_and_no_hopeless_one():
    """Two texts meet at many places; texts of short loops share one loop, which is no passage."""
    def looped(*names, times):
        return np.concatenate([np.full(times, x, np.uint64) for x in names])

    texts = {1: np.arange(91, dtype=np.uint64), 2: np.arange(91, dtype=np.uint64), 3: looped(500, 501, 502, 503, 504, 505, times=16), 4: looped(600, 500, 601, 602, 603, 604, times=16), 5: looped(500, 700, times=60)}
    rows = []
    for side in (0, 1):
        for i, s in texts.items():
            whole = np.unique(s).astype(np.uint16).tobytes() if i > 2 else None
            rows += 6 * [{"key": 7, "i": 0, "j": 0, "side": side, "doc_id": i, "component": i, "covered": False, "around": s[:91].astype(np.uint16).tobytes(), "whole": whole, "least": windows.fewest(s) if i > 2 else 0}]
    got = [(r["doc_id"], r["first_id"]) for b in windows._near_there(False)(iter([pa.RecordBatch.from_pylist(rows)])) for r in b.to_pylist()]
    assert sorted(x for x in got if x[0] < 3) == [(2, 1)]
    assert len(set(got)) == len(got) and (4, 3) not in got and (5, 3) in got and (5, 4) in got


@pytest.mark.parametrize("seed", range(20))
def test_hopeless_pairs_hold_no_passage(seed):
    """What is set aside unsearched, for texts with and without repeated shingles."""
    rng = np.random.default_rng(seed)
    shared = rng.integers(0, 400, rng.integers(30, 70)).astype(np.uint64)
    if seed % 2:
        shared = np.repeat(shared[:8], rng.integers(1, 30, 8))
    mine, other = (np.concatenate([rng.permutation(1000)[:40].astype(np.uint64) + 1000 * k, shared[rng.integers(0, 12) :], rng.permutation(1000)[:40].astype(np.uint64) + 1000 * k + 10_000]) for k in (1, 3))
    distinct = len(np.unique(mine)) == len(mine)
    least = windows.fewest(mine)
    assert least <= min(len(np.unique(mine[i : i + 46])) for i in range(len(mine) - 45))
    assert windows.passages(mine, other, [(0, len(mine))], None, least, distinct) == windows.passages(mine, other, [(0, len(mine))])


def cell(texts, **more):
    """A cell in which all `texts` (id to shingles near its node) meet, of components of their own."""
    row = {"key": 7, "i": 0, "j": 0, "covered": False, "whole": None, "least": 0}
    return pa.RecordBatch.from_pylist([row | {"side": side, "doc_id": i, "component": i, "around": s.astype(np.uint16).tobytes()} for side in (0, 1) for i, s in texts.items()])


def test_a_cell_leaves_out_texts_that_share_much_but_nothing_long():
    """Of 91 shingles, 61 are shared by both pairs: 1 to 46 but one word's five in a row, 3 to 4 of each three successive ones two."""
    old = np.arange(1, 92, dtype=np.uint64)
    near, spread = old.copy(), old.copy()
    near[[*range(20, 25), *range(66, 91)]] += 1000
    spread[::3] += 2000
    for other, pairs in ((near, [(2, 1)]), (spread, [])):
        assert 60 <= (old == other).sum() <= 61
        for best in (False, True):
            got = [r for b in windows._near_there(best)(iter([cell({1: old, 2: other})])) for r in b.to_pylist()]
            assert [(r["doc_id"], r["first_id"]) for r in got if r["first_id"]] == pairs and all(r["first_id"] for r in got)


def test_a_cell_tells_which_texts_have_more_open_pairs():
    texts = {i: np.arange(91, dtype=np.uint64) + np.uint64(1000 * (i == 9)) for i in range(1, 10)}
    got = [r for b in windows._near_there(True)(iter([cell(texts)])) for r in b.to_pylist()]
    met = {(r["doc_id"], r["first_id"]) for r in got if r["first_id"] is not None}
    more = {r["doc_id"] for r in got if r["first_id"] is None}
    assert all(r["key"] == 7 for r in got if r["first_id"] is None)
    assert len(met) < 28 and all({a, b} <= more for a in range(2, 9) for b in range(1, a) if (a, b) not in met) and 9 not in more


def test_a_repeated_line_is_one_member(spark):
    """Each of 40 texts repeats one line 30 times: a key is one place of a text, whatever its number of places."""
    line = prose(5100, 20)
    texts = frame(spark, [" ".join(prose(5200 + i, 60) + line * 30 + prose(5300 + i, 60)) for i in range(40)]).select("doc_id", "text")
    places = texts.mapInArrow(windows._windows, "key bigint, doc_id bigint, c int").groupBy("doc_id", "key").agg({"c": "collect_list"}).toDF("doc_id", "key", "at")
    lists = places.groupBy("doc_id").agg(F.collect_list(F.struct("key", "at")).alias("w")).join(texts, "doc_id").select("doc_id", "w", "text")
    rows = lists.mapInArrow(windows._surroundings, "key bigint, doc_id bigint, around binary, whole binary, least int").collect()
    assert len(rows) == places.count() and places.selectExpr("max(size(at))").first()[0] >= 29
    text = {r.doc_id: windows._text_shingles(*buffers(pa.array([r.text])))[0].astype(np.uint16) for r in texts.collect()}
    at = {(r.doc_id, r.key): sorted(r.at) for r in places.collect()}
    for r in rows:
        s, near = text[r.doc_id], [range(max(c - 45, 0), min(c + 46, len(text[r.doc_id]))) for c in at[r.doc_id, r.key]]
        assert r.around == s[sorted({i for x in near for i in x})].tobytes()
