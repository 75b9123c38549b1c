import corpus_pipeline
from tests.conftest import SF
from tests.llm.common import KINDS, WORD, edge_rows, frame, prose
from pyspark.sql import functions as F

from gradus import session
from gradus.session import written


def run(spark, docs):
    tables = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        tables.append(docs)
    return tables


def test_stages_take_effect(spark):
    passage = prose(500, 60)
    texts = [" ".join(prose(i, 150)) for i in range(80)]
    texts[10] = texts[3] + " tail"
    texts[11] = texts[3]
    texts[20] = " ".join(prose(20, 100) + passage)
    texts[30] = " ".join(passage + prose(30, 90))
    texts += [" ".join(w + "###" for w in prose(900, 90)), "too short"]
    quality, once, cut, mixed, ids = run(spark, frame(spark, texts))
    assert {r.doc_id for r in quality.collect()} == set(range(80))
    assert {r.doc_id for r in once.collect()} == set(range(80)) - {10, 11}
    left = {r.doc_id: r for r in cut.collect()}
    assert set(left) == set(range(80)) - {10, 11} and left[20].text == texts[20]
    assert left[30].text == " ".join(prose(30, 90)) and left[30].n_chars == len(left[30].text)
    assert all(left[i].text == texts[i] for i in left if i != 30)
    assert all(t.columns == quality.columns for t in (once, cut, mixed))
    counts = {}
    for r in mixed.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert counts and max(counts.values()) <= 3 and set(counts) <= set(left)
    assert ids.count() == mixed.count() and all(r.round_trip for r in ids.collect())


def test_pipeline_edges(spark):
    tables = run(spark, edge_rows(spark))
    assert all(t.columns == edge_rows(spark).columns for t in tables[:4])
    assert [t.count() for t in run(spark, spark.createDataFrame([], KINDS))] == [0] * 5


def test_pipeline_on_the_small_table(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(r.round_trip for r in rows) and all(len(r.ids) == r.n_tokens for r in rows)


def test_few_keys_leave_the_texts_where_they_are(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id bigint, text string")
    keys = docs.filter("doc_id % 5 = 0").select("doc_id")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows, joined in ((10, "BroadcastHashJoin"), (9, "SortMergeJoin")):
            monkeypatch.setattr(session, "BROADCAST_ROWS", rows)
            for how, n in (("left_anti", 40), ("left_semi", 10)):
                got = corpus_pipeline._matching(docs, keys, F.col("doc_id"), how)
                assert joined in got._jdf.queryExecution().executedPlan().toString()
                assert len({r.doc_id for r in got.collect()}) == got.count() == n
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
