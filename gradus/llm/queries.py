"""The registered queries of the operators and, where SQL can express them, their oracle SQL."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gradus.llm import apportion, codec, htmldiff, hyperminhash, maglev, packing, periodic, robust, sketch, suffix, unigram, variants, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


OP6_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
    FROM documents),
sh AS (
    SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
        ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS s
    FROM w),
classes AS (SELECT min(doc_id) AS head, list_sort(s) AS s FROM sh WHERE len(s) > 0 GROUP BY ALL),
ranked AS (SELECT head, len(s) AS n, x, count(*) OVER (PARTITION BY x) AS df FROM (SELECT head, s, unnest(s) AS x FROM classes)),
placed AS (SELECT *, row_number() OVER (PARTITION BY head ORDER BY df, x) AS pos FROM ranked),
prefix AS (SELECT * FROM placed WHERE pos <= n - ceil(0.8 * n) + 1),
cand AS (SELECT DISTINCT a.head AS a, b.head AS b FROM prefix a JOIN prefix b ON a.x = b.x AND a.head < b.head
    WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
links AS (
    SELECT a, b FROM (SELECT c.a, c.b, len(list_intersect(p.s, q.s)) AS i, len(p.s) AS n, len(q.s) AS m
        FROM cand c JOIN classes p ON p.head = c.a JOIN classes q ON q.head = c.b)
    WHERE 100 * i >= 80 * (n + m - i)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT head AS node, head AS r FROM classes UNION SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.node),
comp AS (SELECT node, min(r) AS component FROM reach GROUP BY node)
SELECT sh.doc_id, len(sh.s) AS n_shingles, coalesce(comp.component, sh.doc_id) AS component_id,
    sh.doc_id = coalesce(comp.component, sh.doc_id) AS kept
FROM sh LEFT JOIN classes ON classes.s = list_sort(sh.s) LEFT JOIN comp ON comp.node = classes.head
"""


@query("op6_hyperminhash", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


@query("op2_robust_outliers")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.quality(table(spark, sf_dir, "documents"))


@query("op7_sainte_lague")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apportion.mix(table(spark, sf_dir, "documents"))


@query("op9_scaled_sketch")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(table(spark, sf_dir, "documents"))


@query("op10_lookup_sharding")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document, and its shard once the first shard is gone, with the size of its text."""
    names = [f"shard-{i:03d}" for i in range(maglev.SHARDS)]
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"))
    return maglev.place(docs, "doc_id", names, lost=names[0])


@query("op8_compact_windows")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.near_passages(table(spark, sf_dir, "documents"))


@query("op5_unigram_pieces")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op3_range_coder")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = codec.write_token_table(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return codec.documents_of(blocks)


@query("op4_suffix_arrays")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


@query("op1_page_differencing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmldiff.extract(table(spark, sf_dir, "pages"))


@query("op11_cost_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


# The checksum goes bit by bit over a list of bits; letters from U+00C0 to U+00FF are 0xC3 and their code less 64.
# Near words share a word with one letter left out, or one is the other with a letter left out.
OP12_SQL = r"""
WITH RECURSIVE runs AS (
    SELECT doc_id, run, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents)
    WHERE length(run) >= 5 GROUP BY ALL),
bytes AS (
    SELECT doc_id, run, times, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
        lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS bs FROM runs),
sums AS (
    SELECT doc_id, run, times, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT],
        flatten(list_transform(bs, lambda b: [(b & 1)::BIGINT, (b >> 1) & 1, (b >> 2) & 1, (b >> 3) & 1, (b >> 4) & 1, (b >> 5) & 1, (b >> 6) & 1, (b >> 7) & 1]))),
        lambda c, b: xor(c >> 1, 3988292384::BIGINT * (xor(c, b) & 1)))) AS h FROM bytes),
words AS (
    SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, times FROM sums),
vocab AS (SELECT word, sum(times)::BIGINT AS n FROM words WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
cuts AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
pairs AS (
    SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cuts a JOIN vocab b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM cuts a JOIN vocab b ON a.rest = b.word),
near AS (SELECT word, count(*) AS n_near, min((-other_n, other)) AS top FROM pairs GROUP BY word),
formed AS (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -top[1] >= 2 * n THEN top[2] END AS form, CASE WHEN -top[1] >= 2 * n THEN -top[1] END AS form_n
    FROM vocab LEFT JOIN near USING (word)),
chain AS (
    SELECT word, word AS at FROM formed
    UNION ALL SELECT chain.word, f.form FROM chain JOIN formed f ON f.word = chain.at WHERE f.form IS NOT NULL),
ends AS (SELECT chain.word, chain.at AS root FROM chain JOIN formed f ON f.word = chain.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""


@query("op12_letter_trees", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


@query("op13_diagonal_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every text, a tenth of them made periodic by the rule of `periodic.planted`."""
    return periodic.digest(periodic.periodic_runs(table(spark, sf_dir, "documents"), plant=True))
