"""Queries over sources, sinks and streams: written, read back, compared."""
from __future__ import annotations

from pyspark.sql import functions as F

from gradus.catalog.registry import query
from gradus.catalog.results import LOG_SQL
from gradus.operators import analysis as A
from gradus.operators import prep as P
from gradus.sources import listing as S
from gradus.sources import results as R
from gradus.sources import tables as T
from gradus.session import work_dir, written
from gradus.streaming import ingest as N

VALUES = ["accuracy__val", "accuracy__test", "auc__val", "auc__test", "f1__val", "f1__test", "log_loss__val", "log_loss__test",
          "time__train", "time__val", "time__test"]
FAILED = "trial_number = 6 AND target_type = 'binary'"
FLAT = "dataset_fold_id, dataset_name, target_type, alg_name, hparam_source, CAST(trial_number AS INT) AS trial_number, alg_hparam_id, " + ", ".join(VALUES)
OK_SQL = f"SELECT {FLAT} FROM v_results WHERE NOT ({FAILED})"
ERR_SQL = f"""SELECT DISTINCT dataset_name, alg_name, hparam_source, CAST(trial_number AS INT) AS trial_number, alg_hparam_id,
 'ValueError: bad input' AS exception FROM v_results WHERE {FAILED}"""


def documents(t):
    """One document per trial; some trials failed."""
    exc = F.when(F.expr(FAILED), "ValueError: bad input").otherwise("None")
    return R.nest_results(t.results.select("dataset_name", "target_type", "alg_name", "hparam_source", "trial_number", "fold", *VALUES), exc)


def rows_only(results):
    """A fold that a trial did not run has no times."""
    return results.filter("time__train IS NOT NULL").select(*R.KEYS, *VALUES)


def written_documents(t, compress=False):
    path = work_dir(t.spark, "docs")
    R.write_results_json(documents(t), path, compress)
    return path


@query("a01_read_results", OK_SQL)
def _(t):
    return rows_only(R.read_results(t.spark, written_documents(t), "*.json")[0])


@query("a01_read_errors", ERR_SQL)
def _(t):
    return R.read_results(t.spark, written_documents(t), "*.json")[1].drop("results_bucket_path")


@query("a02_with_path_keys", """SELECT path, split_part(path, '/', 2) AS path_dataset, split_part(path, '/', 3) AS path_alg,
 replace(split_part(path, '/', 4), '.zip', '') AS path_expt FROM v_listing""")
def _(t):
    return R.with_path_keys(t.listing, "path")


@query("a03_flatten_results", OK_SQL)
def _(t):
    ok, _bad = A.split_errors(documents(t))
    return rows_only(R.flatten_results(ok))


@query("a04_read_results_zip", OK_SQL)
def _(t):
    docs = documents(t)
    path = F.concat(F.lit("results/"), F.col("dataset.name"), F.lit("/"), F.col("model.name"), F.lit("/t"), F.col("trial_number"), F.lit(".zip"))
    bundles = written(R.zip_documents(docs, path), "zips")
    return rows_only(R.read_results_zip(bundles)[0])


@query("a05_ingest_new", "SELECT DISTINCT path FROM v_listing WHERE NOT contains(path, '/alg1/') AND NOT contains(path, '/alg3/')")
def _(t):
    ls = t.listing.distinct()
    done = ls.withColumnRenamed("path", "results_bucket_path")
    return S.ingest_new(ls, done.filter(F.col("results_bucket_path").contains("/alg1/")), done.filter(F.col("results_bucket_path").contains("/alg3/")))


@query("a06_filter_paths", "SELECT path FROM v_listing WHERE contains(path, 'd_13')")
def _(t):
    return S.filter_paths(t.listing, "d_13")


@query("a07_read_metadata", "SELECT * FROM v_metafeatures")
def _(t):
    mf, path = t.metafeatures, work_dir(t.spark, "mf-csv")
    T.write_table(mf, path, "csv")
    return T.read_metadata(t.spark, path, mf.schema)


@query("a08_write_table", "SELECT * FROM v_results")
def _(t):
    path = work_dir(t.spark, "results-parquet")
    T.write_table(t.results, path, "parquet")
    return t.spark.read.schema(t.results.schema).parquet(path)


@query("a09_append_consolidated", """SELECT dataset_fold_id, alg_hparam_id, accuracy__test, NULL AS auc__test FROM v_results WHERE fold < 5
 UNION ALL SELECT dataset_fold_id, alg_hparam_id, NULL, auc__test FROM v_results WHERE fold >= 5""")
def _(t):
    r = t.results
    old = r.filter("fold < 5").select("dataset_fold_id", "alg_hparam_id", "accuracy__test")
    return R.append_consolidated(old, r.filter("fold >= 5").select("dataset_fold_id", "alg_hparam_id", "auc__test"))


DATASET = "SELECT row_id, x0, x1, k1, y_multi, test_fold FROM v_folds"


@query("a10_read_dataset", DATASET)
def _(t):
    path = work_dir(t.spark, "dataset")
    T.write_dataset(t.folds.select("row_id", "x0", "x1", "k1", "y_multi", "test_fold"), {"target": "y_multi"}, path)
    return T.read_dataset(t.spark, path)[0]


@query("a11_write_dataset", "SELECT 'exists' AS second_write, count(*) AS n FROM v_folds")
def _(t):
    from pyspark.errors import AnalysisException

    path = work_dir(t.spark, "dataset")
    d, meta = t.folds.select("row_id", "x1", "y_multi", "test_fold"), {"target": "y_multi"}
    T.write_dataset(d, meta, path)
    try:
        T.write_dataset(d, meta, path)
        second = "written"
    except AnalysisException:
        second = "exists"
    T.write_dataset(d, meta, path, overwrite=True)
    return T.read_dataset(t.spark, path)[0].agg(F.count("*").alias("n")).select(F.lit(second).alias("second_write"), "n")


@query("a12_read_libsvm", "SELECT CAST(y_bin AS DOUBLE) AS label, x2 AS a, coalesce(x0, 0e0) AS b FROM v_features")
def _(t):
    path = work_dir(t.spark, "libsvm")
    T.write_libsvm(t.features, "y_bin", ["x2", "x0"], path)
    out = T.read_libsvm(t.spark, path, 2)
    return out.select("label", F.col("features")[0].alias("a"), F.col("features")[1].alias("b"))


@query("a13_read_typed_csv", "SELECT CAST(y_bin AS INT) AS label, CAST(x2 AS FLOAT) AS f0, CAST(x4 AS FLOAT) AS f1 FROM v_features")
def _(t):
    path = work_dir(t.spark, "typed-csv")
    t.features.select("y_bin", "x2", "x4").write.csv(path)
    return T.read_typed_csv(t.spark, path, 2)


@query("a14_read_ltr_tsv", "SELECT CAST(y_bin AS INT) AS label, row_id // 10 AS query_id, CAST(x2 AS FLOAT) AS f0, CAST(x4 AS FLOAT) AS f1 FROM v_features")
def _(t):
    path = work_dir(t.spark, "ltr")
    # every third line has the tab spelled out
    sep = F.when(F.col("row_id") % 3 == 0, F.lit("\\t")).otherwise(F.lit("\t"))
    line = F.concat(F.col("y_bin"), sep, F.floor(F.col("row_id") / 10), sep, F.col("x2"), sep, F.col("x4"))
    t.features.select(line.alias("line")).write.option("header", True).option("quote", "\u0000").option("sep", "\u0001").csv(path)
    return T.read_ltr_tsv(t.spark, path, 2)


@query("a15_compressed_text", " UNION ALL ".join(f"SELECT '{c}' AS codec, CAST(y_bin AS INT) AS label, CAST(x2 AS FLOAT) AS f0 FROM v_features" for c in ("gzip", "bzip2")))
def _(t):
    frames = []
    for codec in ("gzip", "bzip2"):
        path = work_dir(t.spark, codec)
        t.features.select("y_bin", "x2").write.option("compression", codec).csv(path)
        frames.append(T.read_typed_csv(t.spark, path, 1).withColumn("codec", F.lit(codec)))
    return frames[0].unionByName(frames[1])


@query("a16_read_index", "SELECT row_id FROM v_folds WHERE test_fold > 1")
def _(t):
    path = work_dir(t.spark, "index")
    t.folds.filter("test_fold > 1").select("row_id").write.csv(path)
    return T.read_index(t.spark, path)


@query("a17_zip_by_position", "SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_index, CAST(row_id AS VARCHAR) AS \"left\", y_multi AS \"right\" FROM v_features")
def _(t):
    x, y = work_dir(t.spark, "zip-x"), work_dir(t.spark, "zip-y")
    d = written(t.features.select("row_id", "y_multi"), "zip-src")
    # range-sorted files: their names keep the order
    d.orderBy("row_id").select(F.col("row_id").cast("string")).write.text(x)
    d.orderBy("row_id").select("y_multi").write.text(y)
    return T.zip_by_position(T.read_text_indexed(t.spark, x), T.read_text_indexed(t.spark, y))


@query("a18_read_csv_skip", "SELECT row_id, x2 FROM v_features")
def _(t):
    path = work_dir(t.spark, "skip")
    t.features.select("row_id", "x2").write.option("header", True).csv(path)
    return T.read_csv_skip(t.spark, path, 1, "row_id BIGINT, x2 DOUBLE")


@query("a18_read_csv_skip_lines", """SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY row_id % 4 ORDER BY row_id) AS rn FROM v_features) AS a WHERE rn > 3""")
def _(t):
    path = work_dir(t.spark, "skip-lines")
    files = t.features.select("row_id", (F.col("row_id") % 4).alias("k"))
    # one file per key, sorted inside
    files.repartition(8, "k").sortWithinPartitions("k", "row_id").write.partitionBy("k").csv(path)
    frames = [T.read_csv_skip(t.spark, f"{path}/k={k}", 3, "row_id BIGINT") for k in range(4)]
    return frames[0].union(frames[1]).union(frames[2]).union(frames[3])


@query("a19_read_task_ids", "SELECT CAST(l_partkey AS INT) AS task_id FROM lineitem WHERE l_linenumber <> 3")
def _(t):
    path = work_dir(t.spark, "tasks")
    line = F.when(F.col("l_linenumber") == 3, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("l_partkey"), F.lit("  ")))
    t.table("lineitem").select(line.alias("value")).write.text(path)
    return S.read_task_ids(t.spark, path)


@query("a20_write_results_json", OK_SQL)
def _(t):
    return rows_only(R.read_results(t.spark, written_documents(t, compress=True), "*.json.gz")[0])


@query("a21_write_predictions", "SELECT alg_name, fold, row_id, y_true, w0 / (w0 + w1 + w2) AS p0 FROM v_preds", r="p0")
def _(t):
    path, w = work_dir(t.spark, "preds"), F.col("w0") + F.col("w1") + F.col("w2")
    d = t.preds.select("alg_name", "fold", "row_id", "y_true", F.array(F.col("w0") / w, F.col("w1") / w, F.col("w2") / w).alias("proba"))
    R.write_predictions(d, path)
    out = t.spark.read.schema(d.schema).parquet(path)
    return out.select("alg_name", "fold", "row_id", "y_true", F.col("proba")[0].alias("p0"))


@query("a22_experiment_log", LOG_SQL)
def _(t):
    return S.experiment_log(t.listing)


@query("a23_export_split_csv", "SELECT row_id, x1, y_multi FROM v_folds WHERE test_fold NOT IN (2)")
def _(t):
    path = work_dir(t.spark, "export")
    d = t.folds.withColumn("part", P.part_of(F.lit(2))).select("row_id", "x1", "y_multi", "part")
    T.export_split_csv(d, path, ["x1"], "y_multi")
    read = lambda n, s: t.spark.read.schema(s).csv([f"{path}/{n}_train", f"{path}/{n}_val"])
    return read("X", "row_id BIGINT, x1 DOUBLE").join(read("y", "row_id BIGINT, y_multi STRING"), "row_id")


@query("a24_list_datasets", "SELECT CAST(row_number() OVER (ORDER BY dataset_name) AS INT) AS number, dataset_name FROM (SELECT DISTINCT dataset_name FROM v_results) AS a")
def _(t):
    return S.list_datasets(t.results)


@query("a25_pending_datasets", """SELECT DISTINCT dataset_name FROM v_results WHERE dataset_name NOT IN (
 SELECT concat('openml__d_', r_regionkey, '__', 100 + r_regionkey) FROM region)""")
def _(t):
    done = t.table("region").select(F.concat(F.lit("openml__d_"), "r_regionkey", F.lit("__"), F.lit(100) + F.col("r_regionkey")).alias("dataset_name"))
    return S.pending_datasets(t.results.select("dataset_name").distinct(), done)


METRICS = [(p, m) for m in ("accuracy", "auc", "f1", "log_loss") for p in ("val", "test")]


@query("n01_stream_ingest", OK_SQL)
def _(t):
    src, out, cp = (work_dir(t.spark, x) for x in ("stream-src", "stream-out", "stream-cp"))
    docs = written(documents(t), "stream-docs")
    # two uploads, two runs; the second run must take only the new files
    for part in ("trial_number < 3", "trial_number >= 3"):
        docs.filter(part).write.mode("append").json(src)
        N.ingest_documents(t.spark, src, out, cp, METRICS)
    return rows_only(N.read_ingested(t.spark, out, "results"))


@query("n02_running_meters", """SELECT event_type, sum(value * (event_id % 5 + 1)) AS "sum", CAST(sum(event_id % 5 + 1) AS BIGINT) AS "count",
 sum(value * (event_id % 5 + 1)) / sum(event_id % 5 + 1) AS "avg" FROM events GROUP BY event_type""", r="sum avg")
def _(t):
    out, cp = work_dir(t.spark, "meters"), work_dir(t.spark, "meters-cp")
    ev = t.table("events")
    N.running_meters(t.spark, t.sf_dir, ev.schema, out, cp, "event_type", "value", "event_id % 5 + 1", glob="events.parquet")
    return N.latest_meters(t.spark, out, "event_type")


@query("n03_drop_duplicate_uploads", "SELECT dataset_fold_id, alg_hparam_id, alg_name, accuracy__test FROM v_results")
def _(t):
    d = t.results.select("dataset_fold_id", "alg_hparam_id", "alg_name", "accuracy__test")
    again = d.filter(F.col("alg_hparam_id").contains("trial_1"))
    return N.drop_duplicate_uploads(d.unionByName(again))


@query("n03_stream_distinct", "SELECT dataset_fold_id, alg_hparam_id, alg_name, accuracy__test FROM v_results")
def _(t):
    src, out, cp = (work_dir(t.spark, x) for x in ("dup-src", "dup-out", "dup-cp"))
    d = t.results.select("dataset_fold_id", "alg_hparam_id", "alg_name", "accuracy__test")
    d.write.parquet(src)
    d.filter(F.col("alg_hparam_id").contains("trial_1")).write.mode("append").parquet(src)
    N.ingest_distinct(t.spark, src, d.schema, out, cp)
    return t.spark.read.parquet(out).drop("batch")


@query("u02_dataset_registry", "SELECT 'orders' AS dataset, count(*) AS n FROM v_features")
def _(t):
    from gradus.sources import registry as G

    if "orders" not in G.LOADERS:
        G.dataset("orders")(lambda spark: t.features)
    return G.load("orders", t.spark).agg(F.count("*").alias("n")).select(F.lit("orders").alias("dataset"), "n")


@query("u05_vectorised_function", "SELECT row_id, sqrt(x2) + 1 AS y FROM v_features", r="y")
def _(t):
    @F.pandas_udf("double")
    def root(x):
        return x.pow(0.5) + 1

    return t.features.select("row_id", root("x2").alias("y"))


@query("u06_archive_rows", "SELECT count(DISTINCT concat(dataset_name, alg_hparam_id)) AS n_documents, 'trial_results.json' AS member FROM v_results")
def _(t):
    bundles = R.zip_documents(documents(t), F.concat("dataset.name", F.lit("/"), "model.name", F.lit("/"), "trial_number"))
    return R.unzip_members(bundles).groupBy("member").agg(F.count("*").alias("n_documents"))
