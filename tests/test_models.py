from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import models, scoring

FEATURES = ["x1", "x2"]


def test_text_target_is_classified(churn):
    out = models.compare_models(churn, "churn", ["tenure", "charges"], row_id="id",
                                algorithms=["RandomForest", "LogisticRegression"]).collect()
    assert {r["task"] for r in out} == {"classification"} and sum(r["is_best"] for r in out) == 1
    assert out[0]["score"] >= out[1]["score"] > 0.5


def test_evaluation(churn):
    done = models.evaluate_model(churn, "churn", ["tenure", "charges", "contract"], row_id="id")
    assert set(done.metrics.columns) == {"accuracy", "precision", "recall", "f1_score"}
    assert done.confusion.agg(F.sum("count")).first()[0] > 50
    assert done.importance.first()["feature"] == "tenure"


def test_one_class_is_refused(spark):
    df = spark.range(40).select(F.rand(1).alias("f"), F.lit("yes").alias("target"))
    with pytest.raises(ValueError, match="2 classes"):
        models.compare_models(df, "target")


def test_planted_signal(planted):
    summary = models.roc_pr(planted, "target_bin", FEATURES, "LogisticRegression", "id").collect()
    assert len(summary) == 1 and summary[0]["roc_auc"] > 0.7
    curve = models.calibration_curve(planted, "target_bin", FEATURES, "LogisticRegression", row_id="id")
    assert 0 <= curve.first()["mean_gap"] <= 1
    done = models.residuals(planted, "target_reg", FEATURES, "LinearRegression", "id")
    assert abs(done.summary.first()["mean_residual"]) < 1.0 and done.histogram.count() == 30
    weights = models.feature_importance(planted, "target_reg", FEATURES, "LinearRegression", row_id="id").collect()
    assert [r["feature"] for r in weights] == ["x1", "x2"] and abs(weights[0]["importance"] - 3) < 0.3


def test_wrong_task_is_refused(planted):
    with pytest.raises(ValueError, match="classification"):
        models.roc_pr(planted, "target_reg", FEATURES)
    with pytest.raises(ValueError, match="regression"):
        models.residuals(planted, "target_bin", FEATURES)
    with pytest.raises(ValueError, match="There is no"):
        models.evaluate_model(planted, "target_reg", FEATURES, "LogisticRegression")


def test_learning_curve(planted):
    out = models.learning_curve(planted, "target_bin", FEATURES, "LogisticRegression", cv=3, row_id="id").toPandas()
    last = out.sort_values("share").iloc[-1]
    assert len(out) == 6 and last["validation_mean"] > 0.5 and last["train_size"] == 200


def test_tuning(house, planted):
    out = models.tune(house, "price", grid={"n_estimators": [5]}, cv=2, row_id="id").collect()
    assert out[0]["params"] == "n_estimators=5" and out[0]["scoring"] == "neg_mean_squared_error"
    assert out[0]["score"] < 0 and not out[0]["is_classification"]
    many = {"C": [10.0**k for k in range(-3, 4)], "max_depth": [1, 2, 3]}
    assert len(models.GRIDS["RandomForest"]) == 3
    table = planted.select("x1", "x2", "target_bin")
    fitted = models.tune(table, "target_bin", "LogisticRegression", {"C": [0.1, 1.0]}, cv=2).collect()
    assert fitted[0]["score"] > 0.7 and fitted[0]["method"] == "grid"
    with pytest.raises(ValueError, match="not a known"):
        models.tune(table, "target_bin", "Oracle", many, cv=2)
    with pytest.raises(ValueError, match="linear"):
        models.tune(table, "target_bin", "SVM", {"kernel": ["rbf"]}, cv=2)


def test_dummies_leave_out_the_first_level(churn):
    assert models.dummies(churn, "churn").columns == ["id", "tenure", "charges", "contract_Yearly", "churn"]


@pytest.mark.parametrize("path", ["small", "ranged"])
def test_curves_match_pair_counting(spark, request, path):
    if path == "ranged":
        request.getfixturevalue("ranged")
    rng = np.random.default_rng(2)
    y, s = rng.integers(0, 2, 500), np.round(rng.random(500), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean())
    row = scoring.roc_pr_summary(df).first()
    assert np.isclose(row["roc_auc"], auc, atol=1e-4) and np.isclose(row["base_rate"], y.mean(), atol=1e-4)
    assert scoring.roc_pr_points(df).count() == len(set(s))


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 0)], "label int, prediction int")
    row = scoring.classification_metrics(df).first()
    assert row["accuracy"] == 0.6 and row["recall"] == 0.6
    assert row["precision"] == round((2 * 0.5 + 2 * 2 / 3) / 5, 4)
    fit = scoring.regression_metrics(spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "label double, prediction double"))
    assert tuple(fit.first()) == (0.7071, 0.5, 0.5)


def test_trees_grow_to_the_references_size(spark):
    rng = np.random.default_rng(7)
    cells = [(i, float(i % 32), float(i // 32), float(v)) for i, v in enumerate(rng.random(1024))]
    df = spark.createDataFrame(cells, "id long, x1 double, x2 double, y double")
    prepared = models.prepare(df, "y", FEATURES, "id")
    forest = models.build("RandomForest", prepared, 1024)
    assert forest.getMaxDepth() == 30
    forest = forest.setNumTrees(3).fit(prepared.frame.coalesce(1))
    assert max(tree.depth for tree in forest.trees) > 10
    boosted = models.build("XGBoost", prepared, 1024)
    assert (boosted.getMaxIter(), boosted.getMaxDepth()) == (100, 6)
    small = models.TreeSize(forest_depth=3, rounds=2, boosted_depth=1)
    assert models.build("RandomForest", prepared, 1024, small).getMaxDepth() == 3


def test_entries_leave_no_model_or_fold_out(spark, monkeypatch):
    from lumenframe.plans import catalog

    seen = {}
    for name in ("compare_models", "tune", "learning_curve"):
        def record(*a, _name=name, **k):
            seen[_name] = k
            return spark.range(1)
        monkeypatch.setattr(models, name, record)
    for entry in ("M3_compare_regressors", "M6_tune", "M13_learning_curve"):
        catalog.QUERIES[entry](spark, "/root/testdata/sf0.001")
    assert seen["compare_models"].get("algorithms") is None
    assert seen["tune"].get("cv", 5) == 5 and seen["learning_curve"].get("cv", 5) == 5
