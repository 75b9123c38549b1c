"""Files on disk: zip bundles, documents, dataset folders, streams, learners."""
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from gradus.operators import metrics as M
from gradus.operators import models as L
from gradus.operators import prep as P
from gradus.sources import results as R
from gradus.sources import tables as T
from gradus.streaming import ingest as N


def document(trial, exception="None"):
    folds = [0.1 * (i + 1) for i in range(3)]
    return {
        "dataset": {"name": "openml__a__1", "target_type": "binary", "num_classes": 1}, "model": {"name": "KNN", "params": {"k": "9"}},
        "experiemnt_args": {"hparam_seed": 4}, "hparam_source": "default", "trial_number": trial, "exception": exception,
        "timers": {p: folds for p in ("train", "val", "test", "train-eval")},
        "scorers": {p: {"Log Loss": folds, "AUC": folds} for p in ("train", "val", "test")}}


def test_zip_bundles_and_documents(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        z.writestr("trial0_results.json", json.dumps(document(0)))
        z.writestr("trial1_results.json", json.dumps(document(1, "ValueError: x")))
        z.writestr("notes.txt", "not json")
    results, errors = R.read_results_zip(R.read_zip_files(spark, str(tmp_path)))
    rows = sorted(results.collect(), key=lambda r: r.dataset_fold_id)
    assert [r.dataset_fold_id for r in rows] == [f"openml__a__1__fold_{i}" for i in range(3)]
    assert rows[1].alg_hparam_id == "KNN__seed_4__trial_0" and rows[1].log_loss__val == 0.2 and rows[2]["time__train-eval"] == pytest.approx(0.3)
    assert [e.exception for e in errors.collect()] == ["ValueError: x"]
    folder = tmp_path / "res" / "openml__a__1" / "KNN"
    folder.mkdir(parents=True)
    (folder / "e_results.json").write_text(json.dumps(document(0), indent=2))
    got, _ = R.read_results(spark, str(tmp_path / "res"), multi_line=True)
    keyed = R.with_path_keys(got).first()
    assert got.count() == 3 and (keyed.path_dataset, keyed.path_alg) == ("openml__a__1", "KNN")


def test_documents_are_ingested_once(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    (tmp_path / "in").mkdir()
    metrics = [("val", "AUC")]
    (tmp_path / "in" / "a.json").write_text(json.dumps(document(0)))
    N.ingest_documents(spark, src, out, cp, metrics)
    N.ingest_documents(spark, src, out, cp, metrics)
    assert N.read_ingested(spark, out, "results").count() == 3
    (tmp_path / "in" / "b.json").write_text(json.dumps(document(1, "boom")))
    N.ingest_documents(spark, src, out, cp, metrics)
    assert N.read_ingested(spark, out, "results").count() == 3 and N.read_ingested(spark, out, "errors").count() == 1


def test_dataset_folder_needs_all_parts(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, "a", 0)], "row_id bigint, x double, y string, test_fold int")
    path = str(tmp_path / "ds")
    df.drop("y", "test_fold").write.parquet(f"{path}/X")
    with pytest.raises(FileNotFoundError, match="part y"):
        T.read_dataset(spark, path)
    T.write_dataset(df, {"target": "y", "name": "d"}, path, overwrite=True)
    rows, meta = T.read_dataset(spark, path)
    assert meta["name"] == "d" and rows.first().x == 2.0


def test_json_writer_refuses_to_overwrite(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a int")
    R.write_results_json(df, str(tmp_path / "o"))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        R.write_results_json(df, str(tmp_path / "o"))


@pytest.mark.parametrize("name", ["LinearModel", "DecisionTree"])
def test_learner_beats_the_majority_class(spark, name):
    df = spark.range(400).select(
        F.col("id").alias("row_id"), (F.col("id") % 10).cast("int").alias("test_fold"), (F.col("id") % 7).cast("double").alias("x"),
        F.sin(F.col("id")).alias("z"), ((F.col("id") % 7) > 3).cast("int").alias("y"))
    rows = L.assemble(P.process_data(df, ["x", "z"], [], scaler=None), ["x", "z"], [], "y")
    preds, report = L.cross_validate(name, {}, rows, "binary", (0,))
    assert report[0]["exception"] == "None"
    acc = preds.filter("part = 'test'").agg(M.accuracy("y_true", "y_pred").alias("a")).first().a
    assert acc > 0.9


def test_failed_trial_is_reported(spark):
    rows = spark.createDataFrame([(1, 0, "train", 1.0)], "row_id bigint, fold int, part string, label double")
    preds, report = L.cross_validate("SVM", {}, rows, "regression", (0,))
    assert preds is None and "NotImplementedError" in report[0]["exception"]
