"""Fitting, comparing, tuning and diagnosing models with Spark ML."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import (
    BinaryClassificationEvaluator,
    MulticlassClassificationEvaluator,
    RegressionEvaluator,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..schema import as_double, col, dtype, is_numeric, quoted, require_columns
from ..session import settle, shared_dir
from .cleaning import columns_with_gaps, label_encode
from .grouped import column_levels, confusion
from .ordering import BROADCAST_BYTES
from .scoring import (
    calibration,
    classification_metrics,
    regression_metrics,
    residual_histogram,
    residual_rows,
    residual_summary,
    roc_pr_points,
    roc_pr_summary,
)

SEED = 42
MAX_CURVES = 8
CLASSIFICATION_LEVELS = 10
TEST_PERCENT = 20
ALGORITHMS = {
    True: ("RandomForest", "LogisticRegression", "XGBoost"),
    False: ("RandomForest", "LinearRegression", "XGBoost"),
}


@dataclass(frozen=True)
class TreeSize:
    """How far trees grow: by default as in the reference, whose forests have no limit (Spark's is 30)."""

    forest_depth: int = 30
    rounds: int = 100
    boosted_depth: int = 6


FULL = TreeSize()


@dataclass(frozen=True)
class Prepared:
    """A model table: ``features`` vector, ``label`` and a stable row hash."""

    frame: DataFrame
    features: tuple[str, ...]
    classes: tuple[str, ...] | None

    @property
    def is_classification(self) -> bool:
        return self.classes is not None

    def share(self, salt: str, parts: int) -> Column:
        """A stable part number per row; different salts give independent parts."""
        return F.pmod(F.xxhash64("__row", F.lit(salt)), F.lit(parts))

    def train(self) -> DataFrame:
        return self.frame.where(self.share("split", 100) >= TEST_PERCENT)

    def test(self) -> DataFrame:
        return self.frame.where(self.share("split", 100) < TEST_PERCENT)


def is_classification(df: DataFrame, target: str, max_levels: int = CLASSIFICATION_LEVELS) -> bool:
    """M2: text targets, and numbers with at most ``max_levels`` distinct values."""
    require_columns(df, target)
    if not is_numeric(dtype(df, target)):
        return True
    present = df.select(as_double(df, target).alias("y")).where(F.col("y").isNotNull())
    return present.distinct().limit(max_levels + 1).count() <= max_levels


def prepare(df: DataFrame, target: str, features: Sequence[str] | None = None, row_id: str | None = None,
            max_levels: int = CLASSIFICATION_LEVELS) -> Prepared:
    """M1: rows without missing values, text features as codes, one feature vector.

    The train/test split hashes ``row_id`` where given, else the row's values.
    """
    names = list(features) if features else [c for c in df.columns if c not in (target, row_id)]
    require_columns(df, target, *names, row_id)
    used = df.select(*map(quoted, dict.fromkeys([*names, target, *([row_id] if row_id else [])])))
    used = used.na.drop(subset=[*names, target])
    classified = is_classification(used, target, max_levels)
    classes: list | None = None
    label = as_double(used, target) if is_numeric(dtype(used, target)) else None
    if classified:
        classes = column_levels(used, target)
        if len(classes) < 2:
            raise ValueError(f"'{target}' needs at least 2 classes, found {len(classes)}.")
        label = col(_CODE)
        used = with_class_codes(used, target, classes)
    key = [col(row_id)] if row_id else [col(c) for c in used.columns if c != _CODE]
    rows = used.withColumns({"label": label, "__row": F.xxhash64(F.lit(SEED), *key)})
    texts = [c for c in names if not _plain_number(dtype(df, c))]
    coded = label_encode(rows, texts)
    inputs = [as_double(coded, c).alias(f"f{i}") for i, c in enumerate(names)]
    flat = coded.select("label", "__row", *inputs)
    assembler = VectorAssembler(inputCols=[f"f{i}" for i in range(len(names))], outputCol="features")
    frame = assembler.transform(flat).select("features", "label", "__row")
    return Prepared(frame, tuple(names), tuple(map(str, classes)) if classes is not None else None)


_CODE = "__class_code"


def with_class_codes(df: DataFrame, target: str, classes: Sequence) -> DataFrame:
    """Each row's class number as a double, by a join with the table of classes: one hash look-up a row."""
    kind = df.schema[target].dataType
    schema = T.StructType([T.StructField("__class", kind), T.StructField(_CODE, T.DoubleType())])
    table = df.sparkSession.createDataFrame([(c, float(i)) for i, c in enumerate(classes)], schema)
    size = sum(len(c.encode()) if isinstance(c, str) else 8 for c in classes) + 8 * len(classes)
    table = F.broadcast(table) if size <= BROADCAST_BYTES else table
    return df.join(table, col(target) == F.col("__class"), "left").drop("__class")


def _plain_number(kind: T.DataType) -> bool:
    return is_numeric(kind) or isinstance(kind, T.BooleanType)


@contextmanager
def kept(prepared: Prepared) -> Iterator[Prepared]:
    """Hold the model table in executor storage for the passes of a fit."""
    prepared.frame.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield prepared
    finally:
        prepared.frame.unpersist()


# Memory, in MB, for the statistics of the nodes split in one pass over the data. With Spark's 256 a forest whose
# levels have hundreds of thousands of nodes reads the data many times a level.
NODE_MEMORY = 1024
_FOREST = dict(seed=SEED, cacheNodeIds=True, maxMemoryInMB=NODE_MEMORY)
_FOLDED_PARTITION_ROWS = 50_000


def folded(train: DataFrame, classified: bool) -> DataFrame:
    """Rows of equal features as one row with a ``weight``: a tree can't part them anyway.

    Squared errors of rows that share a prediction are least where that of
    their mean label is, so regression keeps the mean; classes stay apart.
    Boosting is the same on either. A regression forest draws its bootstrap
    samples from the distinct feature rows, each with all its weight.
    """
    keys = ["features", "label"] if classified else ["features"]
    sums = [F.count(F.lit(1)).cast("double").alias("weight")] + ([] if classified else [F.avg("label").alias("label")])
    return settle(train.groupBy(*keys).agg(*sums))


def _train(estimator: Estimator, train: DataFrame, classified: bool):
    """Fit; the rows of boosted models and regression forests are folded first, for boosting into as few tasks as they fill."""
    inner = estimator.getClassifier() if isinstance(estimator, OneVsRest) else estimator
    if not isinstance(inner, (GBTClassifier, GBTRegressor, RandomForestRegressor)):
        return estimator.fit(train)
    rows = folded(train, classified)
    if not isinstance(inner, RandomForestRegressor):
        # A hundred rounds read the rows several times each.
        rows = rows.coalesce(max(1, math.ceil(rows.count() / _FOLDED_PARTITION_ROWS)))
    held = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return estimator.copy({estimator.weightCol: "weight"}).fit(held)
    finally:
        held.unpersist()


def build(algorithm: str, prepared: Prepared, rows: int, size: TreeSize = FULL) -> Estimator:
    """An untrained estimator; ``XGBoost`` is served by gradient-boosted trees."""
    classified = prepared.is_classification
    if algorithm not in ALGORITHMS[classified]:
        task = "classification" if classified else "regression"
        raise ValueError(f"There is no {task} model named '{algorithm}'.")
    if algorithm == "RandomForest":
        forest = RandomForestClassifier if classified else RandomForestRegressor
        return forest(numTrees=100, maxDepth=size.forest_depth, featureSubsetStrategy="sqrt" if classified else "all", **_FOREST)
    if algorithm == "LogisticRegression":
        return LogisticRegression(maxIter=1000, regParam=1.0 / max(rows, 1), standardization=False)
    if algorithm == "LinearRegression":
        return LinearRegression(maxIter=1000, regParam=0.0)
    settings = dict(maxIter=size.rounds, maxDepth=size.boosted_depth, stepSize=0.3, seed=SEED)
    if not classified:
        return GBTRegressor(**settings)
    trees = GBTClassifier(**settings)
    return trees if len(prepared.classes) == 2 else OneVsRest(classifier=trees)


def _fit(prepared: Prepared, algorithm: str, size: TreeSize = FULL):
    train = prepared.train()
    rows = train.count()
    if rows == 0:
        raise ValueError("No rows are left to train on.")
    # Node ids are kept in checkpoints.
    shared_dir(train.sparkSession)
    return _train(build(algorithm, prepared, rows, size), train, prepared.is_classification)


def compare_models(df: DataFrame, target: str, features: Sequence[str] | None = None, row_id: str | None = None,
                   algorithms: Sequence[str] | None = None, size: TreeSize = FULL) -> DataFrame:
    """M3: test accuracy (or RMSE) of each model, best first."""
    with kept(prepare(df, target, features, row_id)) as prepared:
        def score(name: str) -> tuple[str, str, float]:
            scored = _fit(prepared, name, size).transform(prepared.test())
            if prepared.is_classification:
                return name, "accuracy", classification_metrics(scored).first()["accuracy"]
            return name, "rmse", regression_metrics(scored).first()["rmse"]

        names = list(algorithms or ALGORITHMS[prepared.is_classification])
        prepared.frame.count()
        # Models are independent: the short jobs of one fill the gaps of another.
        with ThreadPool(len(names)) as pool:
            results = pool.map(inheritable_thread_target(df.sparkSession)(score), names, chunksize=1)
    results.sort(key=lambda r: (r[2] is None, -r[2] if prepared.is_classification else r[2]))
    task = "classification" if prepared.is_classification else "regression"
    rows = [(task, *r, place, place == 1) for place, r in enumerate(results, 1)]
    schema = "task string, model string, metric string, score double, rank int, is_best boolean"
    return df.sparkSession.createDataFrame(rows, schema)


def importance_values(model, prepared: Prepared) -> tuple[str, list[float]]:
    """Tree importances, or absolute coefficients averaged over classes."""
    if isinstance(getattr(model, "models", None), list):
        parts = [importance_values(m, prepared) for m in model.models]
        width = len(prepared.features)
        return parts[0][0], [sum(p[1][i] for p in parts) / len(parts) for i in range(width)]
    if hasattr(model, "featureImportances"):
        return "feature_importances", [float(v) for v in model.featureImportances.toArray()]
    if hasattr(model, "coefficientMatrix"):
        return "abs_coefficients", [float(v) for v in abs(model.coefficientMatrix.toArray()).mean(axis=0)]
    return "abs_coefficients", [float(v) for v in abs(model.coefficients.toArray())]


def _importance_table(df: DataFrame, model, prepared: Prepared, top_n: int | None) -> DataFrame:
    kind, values = importance_values(model, prepared)
    ordered = sorted(zip(prepared.features, values), key=lambda p: (-p[1], p[0]))[:top_n]
    rows = [(i, name, round(value, 4), kind) for i, (name, value) in enumerate(ordered, 1)]
    return df.sparkSession.createDataFrame(rows, "rank int, feature string, importance double, kind string")


@dataclass(frozen=True)
class Evaluation:
    metrics: DataFrame
    importance: DataFrame
    confusion: DataFrame | None


def evaluate_model(df: DataFrame, target: str, features: Sequence[str] | None = None,
                   algorithm: str = "RandomForest", row_id: str | None = None,
                   size: TreeSize = FULL) -> Evaluation:
    """Test metrics, confusion counts and feature importances."""
    spark = df.sparkSession
    with kept(prepare(df, target, features, row_id)) as prepared:
        model = _fit(prepared, algorithm, size)
        scored = model.transform(prepared.test())
        measure = classification_metrics if prepared.is_classification else regression_metrics
        metrics = _settled(measure(scored))
        cells = None
        if prepared.is_classification:
            # Bounded by the number of classes squared.
            counted = confusion(scored).collect()
            names = prepared.classes
            cells = spark.createDataFrame(
                [(names[int(r["label"])], names[int(r["prediction"])], r["count"]) for r in counted],
                "label string, prediction string, count long",
            )
        importance = _importance_table(df, model, prepared, None)
    return Evaluation(metrics, importance, cells)


def feature_importance(df: DataFrame, target: str, features: Sequence[str] | None = None,
                       algorithm: str = "RandomForest", top_n: int = 15, row_id: str | None = None,
                       size: TreeSize = FULL) -> DataFrame:
    """The ``top_n`` features by importance or absolute coefficient."""
    with kept(prepare(df, target, features, row_id)) as prepared:
        return _importance_table(df, _fit(prepared, algorithm, size), prepared, top_n)


def scored_test_rows(prepared: Prepared, algorithm: str, need: str | None = None, size: TreeSize = FULL) -> DataFrame:
    """M7: fit and score the test rows, after checking that the task suits the diagnostic."""
    if need == "classification" and not prepared.is_classification:
        raise ValueError("The target is continuous; this needs a classification target.")
    if need == "regression" and prepared.is_classification:
        raise ValueError("The target looks categorical; this needs a regression target.")
    return _fit(prepared, algorithm, size).transform(prepared.test())


def class_scores(prepared: Prepared, algorithm: str, size: TreeSize = FULL) -> DataFrame:
    """One row per test row and class: ``class``, ``label`` 0/1 and ``score``.

    A binary target gives the second class only.
    """
    classes = prepared.classes
    if classes is not None and len(classes) > MAX_CURVES:
        raise ValueError(f"{len(classes)} classes; at most {MAX_CURVES} curves can be read. Reduce classes first.")
    scored = scored_test_rows(prepared, algorithm, "classification", size)
    if "probability" not in scored.columns:
        raise ValueError(f"{algorithm} gives no class probabilities for this target.")
    wanted = [1] if len(classes) == 2 else range(len(classes))
    probability = vector_to_array("probability")
    entries = [
        F.struct(F.lit(classes[k]).alias("class"), (F.col("label") == k).cast("int").alias("label"),
                 probability[k].alias("score"))
        for k in wanted
    ]
    return scored.select(F.inline(F.array(*entries)))


def roc_pr(df: DataFrame, target: str, features: Sequence[str] | None = None, algorithm: str = "RandomForest",
           row_id: str | None = None, size: TreeSize = FULL) -> DataFrame:
    """M8/M9: ROC AUC, average precision and base rate per class."""
    with kept(prepare(df, target, features, row_id)) as prepared:
        return _settled(roc_pr_summary(class_scores(prepared, algorithm, size), by=["class"]))


def _settled(table: DataFrame) -> DataFrame:
    """A table of a handful of rows, computed now while the model table is held."""
    return table.sparkSession.createDataFrame(table.collect(), table.schema)


def roc_pr_curves(df: DataFrame, target: str, features: Sequence[str] | None = None,
                  algorithm: str = "RandomForest", row_id: str | None = None,
                  size: TreeSize = FULL) -> DataFrame:
    """M8: the curve points per class."""
    with kept(prepare(df, target, features, row_id)) as prepared:
        scored = settle(class_scores(prepared, algorithm, size))
    return roc_pr_points(scored, by=["class"])


def calibration_curve(df: DataFrame, target: str, features: Sequence[str] | None = None,
                      algorithm: str = "RandomForest", bins: int = 10, row_id: str | None = None,
                      size: TreeSize = FULL) -> DataFrame:
    """Calibration of a binary classifier."""
    prepared = prepare(df, target, features, row_id)
    if prepared.classes is not None and len(prepared.classes) != 2:
        raise ValueError(f"Calibration curves need a binary target (got {len(prepared.classes)} classes).")
    with kept(prepared):
        return _settled(calibration(class_scores(prepared, algorithm, size), bins=bins))


@dataclass(frozen=True)
class Residuals:
    summary: DataFrame
    rows: DataFrame
    histogram: DataFrame


def residuals(df: DataFrame, target: str, features: Sequence[str] | None = None, algorithm: str = "RandomForest",
              row_id: str | None = None, size: TreeSize = FULL) -> Residuals:
    """Residual summary, rows and histogram of a regression model."""
    with kept(prepare(df, target, features, row_id)) as prepared:
        scored = settle(scored_test_rows(prepared, algorithm, "regression", size).select("label", "prediction"))
    return Residuals(residual_summary(scored), residual_rows(scored), residual_histogram(scored))


def learning_curve(df: DataFrame, target: str, features: Sequence[str] | None = None,
                   algorithm: str = "RandomForest", cv: int = 5, steps: int = 6,
                   row_id: str | None = None, size: TreeSize = FULL, parallelism: int = 4) -> DataFrame:
    """Train and validation score at growing training sizes, over ``cv`` folds.

    Folds and nested training parts come from row hashes, so each larger part
    contains the smaller ones.
    """
    shares = [0.1 + 0.9 * i / (steps - 1) for i in range(steps)]
    resolution = 1_000_000
    with kept(prepare(df, target, features, row_id)) as prepared:
        fold = prepared.share("fold", cv)
        measure = classification_metrics if prepared.is_classification else regression_metrics
        metric = "accuracy" if prepared.is_classification else "r2_score"

        def fitted(point: tuple[float, int]) -> tuple | None:
            share, k = point
            inside = prepared.share("part", resolution) < int(share * resolution)
            train = prepared.frame.where((fold != k) & inside)
            rows = train.count()
            if rows == 0:
                return None
            model = _train(build(algorithm, prepared, rows, size), train, prepared.is_classification)
            scores = [measure(model.transform(part)).first()[metric]
                      for part in (train, prepared.frame.where(fold == k))]
            return share, k, rows, *scores

        # The points don't depend on each other; a few at a time keep the executors busy between a fit's short jobs.
        with ThreadPool(parallelism) as pool:
            run = inheritable_thread_target(df.sparkSession)(fitted)
            results = [r for r in pool.map(run, product(shares, range(cv)), chunksize=1) if r is not None]
    table = df.sparkSession.createDataFrame(
        results, "share double, fold int, rows long, train double, validation double"
    )
    return table.groupBy("share").agg(
        F.lit("accuracy" if prepared.is_classification else "r2").alias("scoring"),
        F.avg("rows").alias("train_size"),
        F.round(F.avg("train"), 4).alias("train_mean"),
        F.round(F.stddev_pop("train"), 4).alias("train_std"),
        F.round(F.avg("validation"), 4).alias("validation_mean"),
        F.round(F.stddev_pop("validation"), 4).alias("validation_std"),
        F.round(F.avg("train") - F.avg("validation"), 4).alias("gap"),
    )


# --- Tuning -------------------------------------------------------------------

# The default search grids.
GRIDS: dict[str, dict[str, list]] = {
    "RandomForest": {
        "n_estimators": [50, 100, 200],
        "max_depth": [None, 10, 20, 30],
        "min_samples_split": [2, 5, 10],
    },
    "XGBoost": {"n_estimators": [100, 200], "learning_rate": [0.01, 0.1, 0.3], "max_depth": [3, 5, 7]},
    "LogisticRegression": {"C": [0.1, 1.0, 10.0]},
    "SVM": {"C": [0.1, 1, 10], "kernel": ["linear"]},
}
GRID_LIMIT = 20
_DEEPEST = 30
_TASK_LEVELS = 2 * CLASSIFICATION_LEVELS


def dummies(df: DataFrame, target: str, max_levels: int | None = None) -> DataFrame:
    """M6 inputs: numbers as they are, text as 0/1 columns without the first level."""
    kept_columns, made = [], []
    for c in df.columns:
        if c == target:
            continue
        if _plain_number(dtype(df, c)):
            kept_columns.append(as_double(df, c).alias(c))
            continue
        for level in column_levels(df, c, max_levels)[1:]:
            made.append(F.coalesce((col(c) == F.lit(level)).cast("double"), F.lit(0.0)).alias(f"{c}_{level}"))
    return df.select(*kept_columns, *made, col(target))


def _tuned(model_type: str, classes: int | None, rows: int, params: Mapping) -> Estimator:
    """An estimator with the given settings under Spark ML's names."""
    known = {name for grid in GRIDS.values() for name in grid}
    unknown = set(params) - known
    if unknown:
        raise ValueError(f"Unknown parameter(s): {sorted(unknown)}")
    if params.get("kernel", "linear") != "linear":
        raise ValueError("Only the linear kernel is available.")
    depth = params.get("max_depth", 6 if model_type == "XGBoost" else None)
    depth = _DEEPEST if depth is None else min(int(depth), _DEEPEST)
    penalty = 1.0 / (float(params.get("C", 1.0)) * max(rows, 1))
    if model_type == "RandomForest":
        forest = RandomForestClassifier if classes else RandomForestRegressor
        leaf = max(1, int(params.get("min_samples_split", 2)) // 2)
        return forest(numTrees=int(params.get("n_estimators", 100)), maxDepth=depth, minInstancesPerNode=leaf, **_FOREST)
    if model_type == "XGBoost":
        settings = dict(maxIter=int(params.get("n_estimators", 100)), maxDepth=depth,
                        stepSize=float(params.get("learning_rate", 0.3)), seed=SEED)
        if not classes:
            return GBTRegressor(**settings)
        trees = GBTClassifier(**settings)
        return trees if classes == 2 else OneVsRest(classifier=trees)
    if model_type == "LogisticRegression":
        if not classes:
            raise ValueError("LogisticRegression is for classification only.")
        return LogisticRegression(maxIter=1000, regParam=penalty, standardization=False)
    if model_type == "SVM":
        if not classes:
            raise ValueError("SVM regression has no distributed counterpart.")
        machine = LinearSVC(maxIter=100, regParam=penalty)
        return machine if classes == 2 else OneVsRest(classifier=machine)
    raise ValueError(f"'{model_type}' is not a known model type.")


_REGRESSION_SCORES = {
    "neg_mean_squared_error": ("mse", -1.0), "neg_root_mean_squared_error": ("rmse", -1.0),
    "neg_mean_absolute_error": ("mae", -1.0), "r2": ("r2", 1.0),
}
_CLASS_SCORES = {
    "accuracy": "accuracy", "f1": "f1", "f1_weighted": "f1",
    "precision_weighted": "weightedPrecision", "recall_weighted": "weightedRecall",
}


def _evaluator(scoring: str):
    if scoring in _REGRESSION_SCORES:
        name, sign = _REGRESSION_SCORES[scoring]
        return RegressionEvaluator(metricName=name), sign
    if scoring == "roc_auc":
        return BinaryClassificationEvaluator(metricName="areaUnderROC"), 1.0
    if scoring in _CLASS_SCORES:
        return MulticlassClassificationEvaluator(metricName=_CLASS_SCORES[scoring]), 1.0
    raise ValueError(f"Unknown scoring '{scoring}'.")


def tune(df: DataFrame, target: str, model_type: str = "RandomForest", grid: Mapping[str, Sequence] | None = None,
         cv: int = 5, scoring: str = "accuracy", row_id: str | None = None, parallelism: int = 4) -> DataFrame:
    """M6: cross-validated search; every combination with its mean score, best first.

    More than 20 combinations are reduced to a seeded random 20.
    """
    require_columns(df, target, row_id)
    data = df.drop(row_id) if row_id else df
    classified = is_classification(data, target, _TASK_LEVELS - 1)
    if not classified and scoring == "accuracy":
        scoring = "neg_mean_squared_error"
    evaluator, sign = _evaluator(scoring)
    chosen = dict(grid or GRIDS.get(model_type) or {})
    if not chosen:
        raise ValueError(f"No search grid is known for '{model_type}'; give one.")
    combinations = [dict(zip(chosen, values)) for values in product(*chosen.values())]
    method = "grid"
    if len(combinations) > GRID_LIMIT:
        combinations, method = random.Random(SEED).sample(combinations, GRID_LIMIT), "random"

    wide = dummies(data, target)
    inputs = [c for c in wide.columns if c != target]
    gaps = columns_with_gaps(wide, wide.columns)
    if gaps:
        raise ValueError(f"The search takes no missing values; there are some in {gaps}.")
    classes = column_levels(wide, target) if classified else None
    if classes is not None and len(classes) < 2:
        raise ValueError(f"The search needs two classes; '{target}' has one.")
    label = as_double(wide, target)
    if classified:
        wide, label = with_class_codes(wide, target, classes), col(_CODE)
    flat = wide.select(label.alias("label"), *[col(c).alias(f"f{i}") for i, c in enumerate(inputs)])
    hashed = flat.withColumn("fold", F.pmod(F.xxhash64(F.lit(SEED), *map(F.col, flat.columns)), F.lit(cv)).cast("int"))
    assembler = VectorAssembler(inputCols=[f"f{i}" for i in range(len(inputs))], outputCol="features")
    frame = assembler.transform(hashed).select("features", "label", "fold").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = frame.count()
        shared_dir(df.sparkSession)
        estimators = [_tuned(model_type, len(classes) if classes else None, rows, params) for params in combinations]

        def fold_score(task: tuple[Estimator, int]) -> float:
            estimator, fold = task
            model = _train(estimator, frame.where(F.col("fold") != fold), classified)
            return evaluator.evaluate(model.transform(frame.where(F.col("fold") == fold)))

        # Settings and folds are independent fits, run side by side.
        with ThreadPool(parallelism) as pool:
            run = inheritable_thread_target(df.sparkSession)(fold_score)
            found = pool.map(run, list(product(estimators, range(cv))), chunksize=1)
        scores = [sign * sum(found[i : i + cv]) / cv for i in range(0, len(found), cv)]
    finally:
        frame.unpersist()
    ordered = sorted(zip(combinations, scores), key=lambda p: -p[1])
    table = [
        (place, ", ".join(f"{k}={v}" for k, v in params.items()), round(float(score), 4), scoring, method,
         model_type, classified)
        for place, (params, score) in enumerate(ordered, 1)
    ]
    schema = ("rank int, params string, score double, scoring string, method string, model_type string, "
              "is_classification boolean")
    return df.sparkSession.createDataFrame(table, schema)
