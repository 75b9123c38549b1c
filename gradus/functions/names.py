"""Algorithm names, families, metric directions, plot styles."""

# Display name by raw algorithm name.
DISPLAY_NAMES = {
    "MLP": "MLP", "TabNet": "TabNet", "VIME": "VIME", "TabTransformer": "TabTransformer", "NODE": "NODE",
    "STG": "STG", "NAM": "NAM", "DeepFM": "DeepFM", "SAINT": "SAINT", "DANet": "DANet",
    "rtdl_MLP": "MLP-rtdl", "rtdl_ResNet": "ResNet", "rtdl_FTTransformer": "FTTransformer",
    "TabPFNModel": "TabPFN", "LightGBM": "LightGBM", "XGBoost": "XGBoost", "CatBoost": "CatBoost",
    "DecisionTree": "DecisionTree", "LinearModel": "LinearModel", "KNN": "KNN", "SVM": "SVM",
    "RandomForest": "RandomForest",
}

# Family by display name.
FAMILIES = {
    "MLP": "neural", "TabNet": "neural", "VIME": "neural", "TabTransformer": "neural", "NODE": "neural",
    "STG": "neural", "NAM": "neural", "DeepFM": "neural", "SAINT": "neural", "DANet": "neural",
    "MLP-rtdl": "neural", "ResNet": "neural", "FTTransformer": "neural", "TabPFN": "pfn",
    "LightGBM": "gbdt", "XGBoost": "gbdt", "CatBoost": "gbdt", "DecisionTree": "baseline",
    "LinearModel": "baseline", "KNN": "baseline", "SVM": "baseline", "RandomForest": "baseline",
}

# True where a larger metric is better.
MAXIMIZE = {"log_loss": False, "auc": True, "accuracy": True, "f1": True, "mse": False, "r2": True}

# Plot marker by display name; any other name is drawn as "x".
MARKERS = {
    "XGBoost": "star", "CatBoost": "circle", "LightGBM": "square", "DANet": "hex", "SAINT": "triangle",
    "DeepFM": "cross", "ResNet": "inverted_triangle", "FTTransformer": "square", "TabTransformer": "asterisk",
    "TabNet": "plus", "MLP-rtdl": "circle", "MLP": "cross", "NODE": "diamond", "STG": "star", "NAM": "square",
    "VIME": "circle", "DecisionTree": "square", "KNN": "circle", "RandomForest": "cross", "LinearModel": "diamond",
    "SVM": "triangle", "TabPFN": "star",
}

# Plot colour by family; any other family is gray.
COLORS = {"neural": "red", "gbdt": "green"}

# Axis label by performance column.
PERFORMANCE_AXES = {
    "log_loss__test_mean": "Log Loss", "accuracy__test_mean": "Accuracy", "f1__test_mean": "F1",
    "auc__test_mean": "AUC", "normalized_log_loss__test_mean": "Log Loss (Normalized 0-1)",
    "normalized_accuracy__test_mean": "Accuracy (Normalized 0-1)", "normalized_f1__test_mean": "F1 (Normalized 0-1)",
    "normalized_auc__test_mean": "AUC (Normalized 0-1)", "time__train_median": "Train time (s)",
    "train_per_1000_inst_median_accuracy": "Train time per 1000 inst.",
}

# Axis label by metafeature column.
DATASET_AXES = {
    "f__general_attr_to_inst": "Ratio: Features to Instances",
    "f__general_cat_to_num": "Ratio: Cat. Features to Num. Features",
    "f__general_freq_class_max": "Max. class frequency", "f__general_freq_class_mean": "Mean class frequency",
    "f__general_freq_class_median": "Median class frequency", "f__general_freq_class_min": "Min class frequency",
    "f__general_freq_class_range": "Range of class frequency", "f__general_nr_attr": "Num. features",
    "f__general_nr_bin": "Num. binary features", "f__general_nr_cat": "Num. categorical features",
    "f__general_nr_class": "Num. target classes", "f__general_total_num_instances": "Num. instances",
    "f__general_nr_num": "Num. numerical features",
}

# Metrics of the result tables in their merge order.
RESULT_METRICS = ("accuracy", "f1", "log_loss", "auc")

# Target kinds an algorithm does not support.
UNSUPPORTED = {
    "DeepFM": ("classification",), "DeepGBM": ("classification",), "ModelTree": ("classification",),
    "NAM": ("classification",), "DNFNet": ("regression",), "rtdl_MLP": ("regression",),
    "rtdl_ResNet": ("regression",), "rtdl_FTTransformer": ("regression",),
}
