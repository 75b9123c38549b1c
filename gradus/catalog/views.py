"""Benchmark-shaped views over the given tables.

Each view is one portable SQL text: Spark runs it on the parquet tables and
the check runs the same text in DuckDB, so both start from equal rows. Only
`curve` differs: Spark numbers the epochs with the distributed row index.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradus.functions import names
from gradus.session import written

TABLES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
                "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
}

VIEWS: dict[str, str] = {}

VIEWS["v_alg"] = """
SELECT * FROM (VALUES (0,'LinearModel'),(1,'KNN'),(2,'SVM'),(3,'DecisionTree'),(4,'RandomForest'),
 (5,'XGBoost'),(6,'CatBoost'),(7,'LightGBM'),(8,'MLP'),(9,'TabNet'),(10,'VIME'),(11,'TabTransformer'),(12,'NODE'),
 (13,'STG'),(14,'NAM'),(15,'DeepFM'),(16,'SAINT'),(17,'DANet'),(18,'TabPFNModel'),(19,'rtdl_MLP'),(20,'rtdl_ResNet'),
 (21,'rtdl_FTTransformer')) AS t(alg_idx, alg_name)"""

VIEWS["v_results"] = """
SELECT concat('openml__d_', g.ds, '__', 100 + g.ds, '__fold_', g.fold) AS dataset_fold_id,
  concat('openml__d_', g.ds, '__', 100 + g.ds) AS dataset_name, g.fold AS fold,
  CASE WHEN g.ds < 12 THEN 'binary' WHEN g.ds < 18 THEN 'classification' ELSE 'regression' END AS target_type,
  a.alg_name AS alg_name,
  CASE WHEN g.trial_number = 0 THEN 'default' ELSE concat('random_', g.trial_number, '_s0') END AS hparam_source,
  g.trial_number AS trial_number, concat(a.alg_name, '__seed_0__trial_', g.trial_number) AS alg_hparam_id,
  5e-1 + 4e0 * g.a AS accuracy__val, 5e-1 + 4e0 * g.b AS accuracy__test,
  5e-1 + 5e0 * g.c AS auc__val, 5e-1 + 5e0 * g.d AS auc__test,
  g.q / 5e1 AS f1__val, g.r / 5e1 AS f1__test,
  CASE WHEN (g.ds + g.fold + g.trial_number) % 13 = 0 THEN NULL ELSE g.lo / 1e5 END AS log_loss__val,
  g.hi / 1e5 AS log_loss__test, g.q AS time__train, g.c AS time__val, g.d AS time__test
FROM (SELECT l_partkey % 20 AS ds, l_orderkey % 10 AS fold, l_suppkey % 22 AS alg_idx, l_linenumber - 1 AS trial_number,
  min(l_discount) AS a, max(l_discount) AS b, min(l_tax) AS c, max(l_tax) AS d,
  min(l_quantity) AS q, max(l_quantity) AS r, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi
  FROM lineitem GROUP BY 1, 2, 3, 4) AS g JOIN v_alg AS a ON g.alg_idx = a.alg_idx"""

VIEWS["v_metafeatures"] = """
SELECT concat('openml__d_', l_partkey % 20, '__', 100 + l_partkey % 20, '__fold_', l_orderkey % 10) AS dataset_name,
  CAST(count(*) AS DOUBLE) AS f__general_nr_inst, CAST(count(DISTINCT l_returnflag) AS DOUBLE) AS f__general_nr_class,
  min(l_quantity) AS f__statistical_min, max(l_extendedprice) AS f__statistical_max,
  CASE WHEN (l_partkey % 20) % 6 = 0 THEN NULL ELSE max(l_tax) END AS f__infotheory_x
FROM lineitem GROUP BY l_partkey % 20, l_orderkey % 10"""

VIEWS["v_features"] = """
SELECT o_orderkey AS row_id,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS x0, c_acctbal AS x1,
  CAST((o_orderkey * 37) % 101 AS DOUBLE) AS x2, CAST(NULL AS DOUBLE) AS x3, 5e0 AS x4,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS k0, o_orderpriority AS k1,
  CAST(c_nationkey AS STRING) AS k2, o_orderstatus AS y_multi,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y_bin, o_totalprice AS y_reg
FROM orders JOIN customer ON o_custkey = c_custkey"""

VIEWS["v_folds"] = """
SELECT f.*, CAST((row_number() OVER (PARTITION BY y_multi ORDER BY md5(concat(row_id, ':0')), row_id) - 1) % 10 AS INT)
  AS test_fold FROM v_features AS f"""

VIEWS["v_preds"] = """
SELECT o_orderkey AS row_id, concat('alg', o_custkey % 5) AS alg_name, o_orderkey % 10 AS fold,
  CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y_true,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y_bin,
  ((o_orderkey * 37) % 101) / 1e2 AS score,
  1e0 + (o_orderkey * 37) % 101 AS w0, 1e0 + (o_orderkey * 53) % 89 AS w1, 1e0 + (o_custkey * 17) % 97 AS w2,
  o_totalprice AS y_reg, o_totalprice + ((o_orderkey * 53) % 89) - 44 AS yhat_reg
FROM orders"""

VIEWS["v_survival"] = """
SELECT o_orderkey AS row_id, o_totalprice AS t, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS e,
  c_acctbal / 1e4 AS risk FROM orders JOIN customer ON o_custkey = c_custkey"""

VIEWS["v_curve"] = """
SELECT user_id AS run_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS epoch,
  value AS val_loss FROM events"""

VIEWS["v_knn"] = "SELECT vec_id, embedding, label, vec_id % 10 AS fold FROM embeddings"

VIEWS["v_listing"] = """
SELECT concat('results/openml__d_', p_partkey % 20, '/alg', p_size % 5, '/expt-', p_partkey % 3, '_010224_101112_',
  CASE WHEN p_partkey % 2 = 0 THEN 'ab12' ELSE 'cd34' END, '.zip') AS path FROM part"""

# Views that only the oracle texts use; Spark gets them from its operators.
VIEWS["v_names"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{raw}', '{shown}', '{names.FAMILIES[shown]}')" for raw, shown in names.DISPLAY_NAMES.items()
) + ") AS t(raw, shown, family)"

VIEWS["v_analysis"] = """
SELECT r.* EXCLUDE (alg_name), n.shown AS alg_name, n.family AS alg_type, m.f__general_nr_inst AS num_inst,
  1e3 * r.time__train / nullif(m.f__general_nr_inst, 0) AS train_per_1000_inst
FROM v_results AS r JOIN v_names AS n ON r.alg_name = n.raw
LEFT JOIN v_metafeatures AS m ON r.dataset_fold_id = m.dataset_name
WHERE r.target_type IN ('binary', 'classification')"""

VIEWS["v_with_default"] = """
SELECT * FROM v_analysis UNION ALL BY NAME
SELECT * EXCLUDE (alg_name), concat(alg_name, ' (default)') AS alg_name FROM v_analysis
WHERE hparam_source = 'default' AND NOT contains(alg_name, 'LinearModel') AND NOT contains(alg_name, 'TabPFNModel')"""


def tuned_sql(source: str, metric: str) -> str:
    """Tuned rows of a source view."""
    way = "DESC" if names.MAXIMIZE[metric] else "ASC"
    return (
        f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY alg_name, dataset_fold_id "
        f"ORDER BY {metric}__val {way}, alg_hparam_id, trial_number) AS rn FROM {source} "
        f"WHERE {metric}__val IS NOT NULL) AS t WHERE rn = 1"
    )


def folds_sql(source: str, m: str) -> str:
    """Tuned rows with bounds, normalised metric and rank per dataset fold."""
    way = "DESC" if names.MAXIMIZE[m] else "ASC"
    t = f"{m}__test"
    return (
        f"SELECT *, ({t} - {t}_min) / nullif({t}_max - {t}_min, 0) AS normalized_{t} FROM (SELECT *, "
        f"min({t}) OVER (PARTITION BY dataset_fold_id) AS {t}_min, max({t}) OVER (PARTITION BY dataset_fold_id) AS {t}_max, "
        f"rank() OVER (PARTITION BY dataset_fold_id ORDER BY {t} {way}) AS {m}_rank FROM ({tuned_sql(source, m)}) AS a) AS b"
    )


def datasets_sql(source: str, m: str) -> str:
    """Fold averages per (algorithm, dataset) with bounds, spread and rank.

    Ranks and bounds use means rounded to 9 digits, as sums depend on order.
    """
    way = "DESC" if names.MAXIMIZE[m] else "ASC"
    t = f"{m}__test"
    return f"""SELECT g.*, s.normalized_{t}_std FROM (
 SELECT *, ({t}_mean - {t}_mean_min) / nullif({t}_mean_max - {t}_mean_min, 0) AS normalized_{t}_mean,
  rank() OVER (PARTITION BY dataset_name ORDER BY {t}_mean {way}) AS {m}_rank_mean FROM (
  SELECT *, min({t}_mean) OVER (PARTITION BY dataset_name) AS {t}_mean_min,
   max({t}_mean) OVER (PARTITION BY dataset_name) AS {t}_mean_max FROM (
   SELECT alg_name, dataset_name, median({t}) AS {t}_median, round(avg({t}), 9) AS {t}_mean,
    median(time__train) AS time__train_median, avg(time__train) AS time__train_mean,
    median(train_per_1000_inst) AS train_per_1000_inst_median_{m}, avg(train_per_1000_inst) AS train_per_1000_inst_mean_{m}
   FROM ({tuned_sql(source, m)}) AS a GROUP BY alg_name, dataset_name) AS b) AS c) AS g
 LEFT JOIN (
  SELECT x.alg_name, x.dataset_name, stddev_samp((x.{t} - y.lo) / nullif(y.hi - y.lo, 0)) AS normalized_{t}_std
  FROM ({tuned_sql(source, m)}) AS x JOIN (
   SELECT dataset_name, min(v) AS lo, max(v) AS hi FROM (
    SELECT alg_name, dataset_name, round(avg({t}), 9) AS v FROM ({tuned_sql(source, m)}) AS a GROUP BY 1, 2) AS z
   GROUP BY dataset_name) AS y ON x.dataset_name = y.dataset_name GROUP BY 1, 2) AS s
 ON g.alg_name = s.alg_name AND g.dataset_name = s.dataset_name"""


_FOLDS: dict[tuple[str, str], DataFrame] = {}
_TABLE = re.compile(r"\b(FROM|JOIN)\s+(" + "|".join(TABLES) + r")\b")
_WORD = re.compile(r"\bv_[a-z_]+\b")


def _needed(sql: str) -> list[str]:
    """Views a text uses, each after the views it builds on."""
    order: list[str] = []
    for name in dict.fromkeys(_WORD.findall(sql)):
        if name in VIEWS:
            for dep in [*_needed(VIEWS[name]), name]:
                if dep not in order:
                    order.append(dep)
    return order


def with_views(sql: str) -> str:
    """Prefix a query with the views it names, as common table expressions."""
    body = sql.strip()
    ctes = [f"{n} AS ({VIEWS[n].strip()})" for n in _needed(body)]
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ",\n".join([*ctes, body[15:]])
    if body[:5].upper() == "WITH ":
        ctes.append(body[5:])
        return "WITH " + ",\n".join(ctes)
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


class Tables:
    """Lazy access to the tables and views of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Run portable SQL over the tables and views it names, leaving no temporary view behind."""
        used: set[str] = set()

        def slot(m: re.Match) -> str:
            used.add(m.group(2))
            return f"{m.group(1)} {{{m.group(2)}}}"

        body = _TABLE.sub(slot, with_views(text))
        return self.spark.sql(body, **{n: self.table(n) for n in used})

    def _view(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {name}")

    @property
    def algs(self) -> DataFrame:
        return self._view("v_alg")

    @property
    def results(self) -> DataFrame:
        return self._view("v_results")

    @property
    def metafeatures(self) -> DataFrame:
        return self._view("v_metafeatures")

    @property
    def features(self) -> DataFrame:
        return self._view("v_features")

    @property
    def folds(self) -> DataFrame:
        """Features with their stratified test fold, prepared once per session and folder."""
        from gradus.operators.prep import stratified_kfold

        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _FOLDS:
            _FOLDS[key] = written(stratified_kfold(self.features, "row_id", "y_multi"), "folds")
        return _FOLDS[key]

    @property
    def preds(self) -> DataFrame:
        return self._view("v_preds")

    @property
    def survival(self) -> DataFrame:
        return self._view("v_survival")

    @property
    def knn(self) -> DataFrame:
        return self._view("v_knn")

    @property
    def listing(self) -> DataFrame:
        return self._view("v_listing")

    @property
    def curve(self) -> DataFrame:
        """Epoch = position of the event in its run; days are the order buckets."""
        from gradus.plans.ordering import prefix_sums

        ev = self.table("events").select(
            F.col("user_id").alias("run_id"), F.col("value").alias("val_loss"), "ts", "event_id",
            F.date_trunc("hour", "ts").alias("_bucket"),
        )
        out = prefix_sums(ev, ["run_id"], ["ts", "event_id"], {"epoch": F.lit(1)}, inclusive=False)
        return out.select("run_id", F.col("epoch").cast("int").alias("epoch"), "val_loss")
