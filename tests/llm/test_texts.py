import hashlib
import html
import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gradus.llm import apportion, codec, htmldiff, maglev, robust, sketch, unigram
from tests.llm.common import KINDS, WORD, edge_rows, frame, prose

EMPTY = hashlib.sha256(b"").hexdigest()


# main text of pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a = "</p><article>";</script></head><body class="post">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use <b>cookies</b></div>
<article><header><h1>{title}</h1></header><p>First <b>bo</b>ld &amp; &eacute;&#8212;x<br>second
   line</p><aside>Side</aside><p>Third<div class="ad">Buy</div><form><input><button>Go</button></form>
<ul><li>one<li>two</ul><!-- no --><section id="comments"><p>Reader says</p></section></article>
<div role="complementary">more</div><footer>&copy; x</footer></body></html>"""


def test_article_text(spark):
    text = " ".join(t for t, z in htmldiff.lines(PAGE.format(title="Head line")) if z == htmldiff.ARTICLE)
    assert text == "Head line First bold & é—x second line Third one two"


def test_pages(spark):
    plain = "<body><div>Welcome to us</div><p>{}</p><div>All rights</div></body>"
    rows = [
        (1, "http://a.org/x/1", PAGE.format(title="A")), (2, "http://a.org/x/2", PAGE.format(title="A")), (3, "http://b.org/p/1", plain.format("body one")),
        (4, "http://b.org/p/2?q=1", plain.format("body two")), (5, "http://c.org/only", "<p>alone &lt;b&gt;</p>"), (6, None, None), (7, "x", ""), (None, "x", "text < 5 <"),
        (1, "http://a.org/x/1", PAGE.format(title="A")), (8, "http://d.org/1", "<article>unclosed <b>one" + " two" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS row", "'n' AS numbers", "0 AS near_id")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in htmldiff.extract(pages).collect())
    article = "A First bold & é—x second line Third one two"
    want = [(0, "text < 5 <"), (1, article), (1, article), (2, article), (3, "body one"), (4, "body two"), (5, "alone <b>"), (6, ""), (7, ""), (8, "unclosed one" + " two" * 50_000)]
    assert got == [(i, t, len(t)) for i, t in want]
    assert htmldiff.extract(pages.limit(0)).count() == 0


def test_alignment_matches_dynamic_programming():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a, b = (rng.integers(0, 5, rng.integers(0, 14)).tolist() for _ in range(2))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
        got = htmldiff.aligned(a, b)
        rest = iter(b)
        assert got == sorted(set(got)) and len(got) == best[-1, -1] and all(a[i] in rest for i in got)


# quality rules

def brute_statistics(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = {x for x in windows if windows.count(x) > 1}
    covered = {j for i, x in enumerate(windows) if x in many for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_text_statistics(spark):
    texts = ["a b c a b c a", "x\ny\n x\nx\n\n  \nx", "#a *b$ %c & | <>", " \x0b\x0c\r\t ", None, "", "a a a a a", "é é é 梦", " ".join(prose(1, 400, 12)), "a b c d a b\nb c d"]
    texts += [" ".join(prose(i, 150, 30)) for i in range(20)]
    got = robust.text_statistics(frame(spark, texts)).orderBy("doc_id").collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got] == [brute_statistics(t) for t in texts]


def test_quality_rejects_outliers_and_keeps_clean(spark):
    clean = [" ".join(prose(i, 60 + 5 * i)) for i in range(150)]
    junk = [" ".join(w + "###" for w in prose(1000 + i, 80)) for i in range(25)]
    got = {r.doc_id: r for r in robust.quality(frame(spark, clean + junk + ["short one", "la la " * 100])).collect()}
    assert all(got[i].kept for i in range(150)) and not any(got[i].kept for i in range(150, 177))
    assert [got[i].base_failed for i in (0, 150, 175, 176)] == [False, False, True, True]


def test_quality_rejects_an_outlier_in_each_coordinate(spark):
    clean = ["\n".join(" ".join(prose(50 * i + j, 15 + i % 9)) for j in range(7)) for i in range(200)]
    words = prose(9001, 110)
    phrase = prose(9002, 9)
    longer = " ".join(w + "xyz" for w in words)
    symbols = " ".join(w + "#" if i % 10 == 0 else w for i, w in enumerate(words))
    lines = "\n".join([" ".join(prose(9003, 12)), " ".join(prose(9004, 25)) + " " + " ".join(prose(9005, 20))] + ["a b"] * 6)
    repeats = " ".join(prose(9006, 60) + phrase + prose(9007, 10) + phrase + prose(9008, 9) + phrase + prose(9009, 12) + phrase + phrase + phrase)
    share = brute_statistics(repeats)
    assert 0.3 < share[4] / share[0] < 0.5
    got = {r.doc_id: r for r in robust.quality(frame(spark, clean + [longer, symbols, lines, repeats])).collect()}
    assert all(got[i].kept for i in range(200))
    assert [got[i].base_failed for i in range(200, 204)] == [False] * 4 and not any(got[i].kept for i in range(200, 204))


def test_estimates_match_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4)) * [0.3, 0.2, 0.4, 0.5] + [1, 2, 3, 4]
    x[:60] += 3
    rows = spark.createDataFrame([(0, *map(float, r)) for r in x], "g int, " + ", ".join(f"{v} double" for v in robust.VECTOR))
    model = robust.estimates(rows, ["g"]).first()
    mean = np.array([model[f"m{i}"] for i in range(4)])
    center, scale = np.median(x, axis=0), np.median(np.abs(x - np.median(x, axis=0)), axis=0) * 1.4826
    floor = np.diag(np.square(robust.FLOOR))
    inverse = np.diag(1 / (scale**2 + np.diag(floor)))
    factor = robust.SUBSET / (1 - robust.chi2_tail(robust.chi2_point(1 - robust.SUBSET, 4), 6))
    for _ in range(robust.STEPS):
        d = np.einsum("ij,jk,ik->i", x - center, inverse, x - center)
        core = x[np.argsort(d)[:300]]
        center, inverse = core.mean(axis=0), np.linalg.inv(np.cov(core.T, bias=True) * factor + floor)
    assert np.allclose(mean, center, atol=0.02) and abs(model["p00"] - inverse[0, 0]) < 0.05 * inverse[0, 0]


def test_quality_edges(spark):
    got = robust.quality(edge_rows(spark)).collect()
    assert len(got) == 12 and all(r.kept is not None and r.n_words is not None for r in got)
    assert robust.quality(spark.createDataFrame([], KINDS)).count() == 0


# range coder

def test_coder_round_trip():
    rng = np.random.default_rng(1)
    zipf = lambda n: np.minimum(rng.zipf(1.3, n), 49_407)
    blocks = [zipf(n) for n in (4096, 4096, 1, 0, 37, 3000)] + [np.full(4096, 5), rng.integers(0, 49_408, 2000), np.arange(500) % 7 * 256, np.tile([65_535, 0], 50)]
    coded = codec.encode_blocks(blocks)
    back = codec.decode_blocks(coded, [len(b) for b in blocks])
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, back))
    assert len(coded[6]) < 200 and len(coded[0]) < 2 * 4096


def test_block_checksum():
    ids = np.arange(20)
    stored = codec.pack(ids, codec.encode_blocks([ids])[0], np.array([(3, 20, 0)], codec.ENTRY), 0)
    assert codec.unpack(stored)[0] == 20
    for at in (0, 9, 30, len(stored) - 1):
        with pytest.raises(ValueError):
            codec.unpack(stored[:at] + bytes([stored[at] ^ 1]) + stored[at + 1 :])


def test_combined_crc():
    a, b = b"some bytes", b"and others"
    assert codec.combine_crc32(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def brute_tokens(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out, start = [], 0
    for doc, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_table(spark):
    texts = [" ".join(prose(i, 5 + 40 * i)) for i in range(60)] + ["It's 42 Élan é 梦 <|endoftext|> x", None, "", " \n", "don't \x1c stop\x85 ", " ".join(prose(9, 9000))]
    docs = frame(spark, texts).repartition(5)
    blocks = codec.write_token_table(docs, public_tokenizers.path("word_bpe_49k.json"))
    got = codec.documents_of(blocks).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute_tokens(list(enumerate(texts)))


def test_token_table_edges(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = codec.documents_of(codec.write_token_table(edge_rows(spark), path)).orderBy("start").collect()
    assert len(got) == 12 and [r.doc_id for r in got] == [1, 2, 3, 4, 5, 5, 6, 7, 8, 9, None, None]
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got[:-1])]
    assert codec.documents_of(codec.write_token_table(spark.createDataFrame([], KINDS), path)).count() == 0


# unigram pieces

def library_as_unigram(path):
    """The public library with the same pieces and its unigram method: the model type in the trainer's settings is 1."""
    import sentencepiece

    data = bytearray(open(path, "rb").read())

    def varint(at):
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift += 7
            at += 1
            if data[at - 1] < 128:
                return value, at

    def fields(at, end):
        while at < end:
            tag, at = varint(at)
            if tag & 7 == 2:
                n, start = varint(at)
                yield tag >> 3, start, start + n
                at = start + n
            elif tag & 7 == 0:
                _, nxt = varint(at)
                yield tag >> 3, at, nxt
                at = nxt
            else:
                at += 4 if tag & 7 == 5 else 8

    for number, start, end in fields(0, len(data)):
        if number == 2:
            for inner, a, _ in fields(start, end):
                if inner == 3:
                    data[a] = 1
    return sentencepiece.SentencePieceProcessor(model_proto=bytes(data))


PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_match_the_library():
    sp, model = library_as_unigram(PIECES), unigram.load_model(PIECES)
    texts = [" ".join(prose(i, 30)) for i in range(20)] + ["Hello world, the quick brown fox", "Größe über naïve", "a  b   c\n\td", "梦 𝄞 é", " lead", "trail ", "x" * 300, "unbelievably " * 30]
    ids, off = unigram.Encoder(model).encode(texts)
    score = lambda x: sum(model.scores[i] for i in x if model.pieces[i])
    for k, t in enumerate(texts):
        mine, theirs = ids[off[k] : off[k + 1]].tolist(), sp.encode(t)
        assert mine == theirs or abs(score(mine) - score(theirs)) <= 1e-6 * abs(score(theirs)), t


def test_best_paths_match_brute_force():
    names = {"a": 3, "b": 4, "ab": 5, "abc": 6, "c": 7, "▁": 8, "▁a": 9, "bc": 10, "é": 11}
    scores = np.log([1, 1, 1, 0.1, 0.1, 0.05, 0.012, 0.02, 0.1, 0.03, 0.06, 0.04])
    byte_ids = np.arange(256, dtype=np.int32) + 100
    model = unigram.make_model(names, scores, byte_ids, [b""] * 400)

    def brute(s):
        if not s:
            return [(0.0, [])]
        out = [(x + scores[i], [i, *p]) for n, i in names.items() if s.startswith(n) for x, p in [max(brute(s[len(n) :]))]]
        if s[0] not in names:
            x, p = max(brute(s[1:]))
            out.append((x + model.unknown, [*(100 + c for c in s[0].encode()), *p]))
        return out

    lists = [model.base.tolist(), model.check.tolist(), model.value.tolist(), model.scores.tolist()]
    words = ["▁" + "".join(x) for n in range(6) for x in itertools.product("abcéz"[: 3 + (n < 5) + (n < 4)], repeat=n)]
    want = [max(brute(w))[0] for w in words]
    for w, ids, best in zip(words, unigram.best_paths(model, [w.encode() for w in words]), want):
        total = lambda p: sum(scores[i] for i in p if i < 100) + model.unknown * w.count("z")
        assert abs(total(ids) - best) < 1e-9 and abs(total(unigram.best_path(model, w.encode(), *lists)) - best) < 1e-9


def test_pieces_round_trip(spark):
    got = {(r.doc_id, r.n_chars): r for r in unigram.round_trip(edge_rows(spark), PIECES).collect()}
    assert len(got) == 11 and all(r.round_trip for (i, _), r in got.items() if i != 8)
    assert got[(1, 0)].n_tokens == 0 and unigram.round_trip(spark.createDataFrame([], KINDS), PIECES).count() == 0


# mixing

def test_mix(spark):
    sources = [None, "a", "b", "c", "é", "z"]
    rows = [(i, " ".join(["w"] * (3 + i * 7 % 90)), "en", sources[i * i % 6] if i > 30 else "a", 0, "x", "y") for i in range(400)]
    docs = spark.createDataFrame(rows, KINDS)
    got = apportion.mix(docs).collect()
    size, taken = {}, {}
    by_id = {r[0]: r for r in rows}
    for r in got:
        s = by_id[r.doc_id][3]
        assert r.size == len(by_id[r.doc_id][1].split()) and 0 <= r.taken <= 3 * r.size
        size[s], taken[s] = size.get(s, 0) + r.size, taken.get(s, 0) + r.taken
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in size else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, open_, left = {}, set(names), float(sum(size.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * size[s]}
        if not full:
            want |= {s: level * weight[s] for s in open_}
            break
        want |= {s: 3.0 * size[s] for s in full}
        left -= sum(3 * size[s] for s in full)
        open_ -= full
    for r in got:
        s = by_id[r.doc_id][3]
        assert abs(r.target - want[s]) < 1e-6 * want[s] and r.source_size == size[s]
    assert all(abs(taken[s] - want[s]) <= 3 * apportion.BLOCK_WORDS for s in names)
    assert sorted(map(tuple, got)) == sorted(map(tuple, apportion.mix(docs.repartition(7)).collect()))


def test_quotas_are_sainte_lague(spark):
    want = {"0a": 5300.0, "0b": 2100.0, "0c": 990.0, "1": 17.0}
    rows = [(k, 10**6, 1.0, v) for k, v in want.items()]
    got = apportion.quotas(spark.createDataFrame(rows, "name string, source_size bigint, weight double, target double"), block=10, shards=4).collect()
    seats, at = dict.fromkeys(want, 0), {}
    for n in range(1, round(sum(want.values()) / 10) + 1):
        seats[max(want, key=lambda s: want[s] / (2 * seats[s] + 1))] += 1
        at[n] = dict(seats)
    total = round(sum(want.values()) / 10)
    for k in range(4):
        before, after = at.get(total * k // 4, dict.fromkeys(want, 0)), at[total * (k + 1) // 4]
        for s in want:
            assert sum(r.seats for r in got if r.name == s and r.shard == k) == after[s] - before[s]


def test_shards_meet_their_quotas(spark):
    want = [("0a", 16 * 997, 5300.0), ("0b", 16 * 40 + 3, 1900.0), ("0c", 16 * 333, 16 * 333 * 3.0), ("0d", 5, 15.0), ("1", 0, 0.0)]
    wanted = spark.createDataFrame([(n, s, 1.0, t) for n, s, t in want], "name string, source_size bigint, weight double, target double")
    quota = {}
    for r in apportion.quotas(wanted).collect():
        quota[r.name, r.shard] = r.seats
    got = {r.name: r for r in apportion.dealt(wanted).collect()}
    assert set(got) == {n for n, _, _ in want}
    for name, r in got.items():
        sizes, seats = [s["size"] for s in r.shards], [s["seats"] for s in r.shards]
        assert sum(sizes) == r.blocks and max(sizes) - min(sizes) <= 1 and [s["first"] for s in r.shards] == [sum(sizes[:k]) for k in range(16)]
        assert all(0 <= q <= 3 * s for q, s in zip(seats, sizes)) and sum(seats) == sum(quota.get((name, k), 0) for k in range(16))
    assert [s["seats"] for s in got["0a"].shards] == [quota["0a", k] for k in range(16)]


def test_mix_takes_each_shards_quota(spark):
    rows = [(i, " ".join(["w"] * 16), "en", "ab"[i % 3 == 0], 0, "x", "y") for i in range(960)]
    docs = spark.createDataFrame(rows, KINDS)
    plan = {r.name: r for r in apportion.dealt(apportion.targets(apportion.sizes(docs).withColumn("name", apportion._name()))).collect()}
    got = apportion.mix(docs).collect()
    for source in "ab":
        # documents of one block each: how often blocks are given follows from the shards' seats alone
        times = sorted(r.taken // 16 for r in got if rows[r.doc_id][3] == source)
        want = sorted(t for s in plan["0" + source].shards for t in
                      [s["seats"] // s["size"] + (i < s["seats"] % s["size"]) for i in range(s["size"])])
        assert times == want


def test_mix_edges(spark):
    got = apportion.mix(edge_rows(spark)).collect()
    assert len(got) == 12 and all(r.taken <= 3 * r.size for r in got)
    assert apportion.mix(spark.createDataFrame([], KINDS)).count() == 0


# fingerprints

def test_fingerprints(spark):
    texts = [" ".join(prose(i, 40 + 11 * i)) for i in range(60)] + [None, "", "a b", "one two three four five six"]
    got = {r.doc_id: r for r in sketch.fingerprints(frame(spark, texts).repartition(4)).collect()}
    n, plain = len(texts), [t or "" for t in texts]
    for i in range(n):
        nxt, half = plain[i - 1] if i else plain[n - 1], len(plain[i]) // 2
        edited = plain[i][: len(plain[i]) - half] + nxt[:half]
        assert got[i].n_chars == len(plain[i]) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[60].fingerprint == got[61].fingerprint == "" and got[0].fingerprint != got[1].fingerprint
    big = [i for i in range(25, 60)]
    assert sum(abs(got[i].near_edited - 1 / 3) < 0.2 for i in big) > 30 and all(got[i].near_next < 0.1 for i in big)


def test_containment_of_unequal_texts(spark):
    base = prose(1, 6000)
    rows = spark.createDataFrame([(" ".join(base[1000:1600]), " ".join(base))], "a string, b string")
    rows = sketch.with_sketch(sketch.with_sketch(rows, "a", "x"), "b", "y")
    inside, back = rows.select(sketch.containment("x", "y"), sketch.containment("y", "x")).first()
    assert inside == 1.0 and abs(back - 0.1) < 0.03


def test_fingerprints_edges(spark):
    got = sketch.fingerprints(edge_rows(spark)).collect()
    assert len(got) == 12 and len({r.fingerprint for r in got if r.doc_id in (5, 6)}) == 1
    assert sketch.fingerprints(spark.createDataFrame([], KINDS)).count() == 0
    alone = sketch.fingerprints(frame(spark, ["abcdef"])).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()


# sharding

def brute_lookup(shards, slots):
    order = [[(maglev._number(f"{s}:offset") + j * (maglev._number(f"{s}:skip") % (slots - 1) + 1)) % slots for j in range(slots)] for s in shards]
    owner, at = {}, [0] * len(shards)
    while len(owner) < slots:
        for i in range(len(shards)):
            while len(owner) < slots and order[i][at[i]] in owner:
                at[i] += 1
            if len(owner) < slots:
                owner[order[i][at[i]]] = i
    return [owner[k] for k in range(slots)]


def test_lookup_table():
    names = [f"s{i}" for i in range(7)]
    assert maglev.lookup_table(names, 251).tolist() == brute_lookup(names, 251)
    table = maglev.lookup_table(names)
    share = np.bincount(table) / maglev.SLOTS
    assert share.max() - share.min() < 2e-4
    rest = maglev.lookup_table(names[1:])
    kept = table > 0
    assert (table[kept] != rest[kept] + 1).mean() < 0.1
    for bad in ([], names):
        with pytest.raises(ValueError):
            maglev.lookup_table(bad, 6)


def test_placement(spark, tmp_path):
    names = [f"s{i}" for i in range(5)]
    table = maglev.lookup_table(names, 1009)
    got = maglev.place(edge_rows(spark).withColumnRenamed("_times", "shard"), "doc_id", names, 1009, lost="s0").collect()
    for r in got:
        slot = int(hashlib.md5(str("" if r.doc_id is None else r.doc_id).encode()).hexdigest()[:15], 16) % 1009
        assert (r.slot, r.shard, r.shard_name) == (slot, table[slot], names[table[slot]]) and r.shard_after_loss != 0
    assert len(got) == 12 and maglev.place(spark.createDataFrame([], KINDS), "doc_id", names, 1009).count() == 0
    maglev.write_shards(frame(spark, ["a"] * 50), "doc_id", str(tmp_path / "out"), names, 1009)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50


def test_sketches_of_parts_merge_to_that_of_the_whole(spark):
    rows = []
    for i in range(60):
        words = prose(700 + i, 20 + i)
        a, b = len(words) // 3, 2 * len(words) // 3
        over = sketch.SHINGLE - 1
        rows.append((" ".join(words), " ".join(words[: a + over]), " ".join(words[a : b + over]), " ".join(words[b:])))
    rows += [("", "", "", ""), ("one two", "one two", "", None)]
    df = spark.createDataFrame(rows, "whole string, a string, b string, c string")
    for c in "abc":
        df = sketch.with_sketch(df, c, f"s_{c}")
    df = sketch.with_sketch(df, "whole", "s").withColumn("m", sketch.merged(["s_a", "s_b", "s_c"]))
    got = df.select("s", "m", F.size("s_a").alias("n")).collect()
    assert len(got) == 62 and all(r.s == r.m for r in got)
