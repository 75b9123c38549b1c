"""Explicit schemas of documents and tables."""
from pyspark.sql import types as T

DATASET = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("cat_idx", T.ArrayType(T.IntegerType())),
    T.StructField("cat_dims", T.ArrayType(T.IntegerType())), T.StructField("target_type", T.StringType()),
    T.StructField("num_classes", T.IntegerType()), T.StructField("num_features", T.IntegerType()),
    T.StructField("num_instances", T.LongType()), T.StructField("split_source", T.StringType()),
])

# the key "experiemnt_args" is spelled so in the documents
RESULT_DOC = T.StructType([
    T.StructField("dataset", DATASET),
    T.StructField("model", T.StructType([
        T.StructField("name", T.StringType()), T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("args", T.MapType(T.StringType(), T.StringType()))])),
    T.StructField("experiemnt_args", T.StructType([T.StructField("hparam_seed", T.IntegerType())])),
    T.StructField("hparam_source", T.StringType()), T.StructField("trial_number", T.IntegerType()),
    T.StructField("exception", T.StringType()),
    T.StructField("timers", T.MapType(T.StringType(), T.ArrayType(T.DoubleType()))),
    T.StructField("scorers", T.MapType(T.StringType(), T.MapType(T.StringType(), T.ArrayType(T.DoubleType())))),
])

SPLITS = "fold INT, part STRING, row_id BIGINT"
PREDICTIONS = ("alg_name STRING, trial_number INT, fold INT, part STRING, row_id BIGINT, y_true DOUBLE, y_pred DOUBLE, "
               "proba ARRAY<DOUBLE>")
ERRORS = ("dataset_name STRING, alg_name STRING, hparam_source STRING, trial_number INT, alg_hparam_id STRING, "
          "exception STRING")
