"""Model quality measured on tables of labels and predictions.

Nothing here fits a model; the input is any table with a label and a
prediction or score column, and all work is aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import col, quoted, require_columns
from .distribution import histogram
from .grouped import confusion
from .ordering import Order, quantiles, running_sums


def classification_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """M4: accuracy and support-weighted precision, recall and F1 from the confusion counts."""
    counts = confusion(scored, label, prediction)
    truth, guess = col(label), col(prediction)
    per_truth = counts.groupBy(truth.alias("c")).agg(
        F.sum("count").alias("support"), F.sum(F.when(truth == guess, F.col("count")).otherwise(0)).alias("hits")
    )
    per_guess = counts.groupBy(guess.alias("c")).agg(F.sum("count").alias("called"))
    precision = F.coalesce(F.try_divide(F.col("hits"), F.col("called")), F.lit(0.0))
    recall = F.col("hits") / F.col("support")
    f1 = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    classes = per_truth.join(per_guess, "c", "left").withColumns({"p": precision, "r": recall}).withColumn("f", f1)

    def weighted(name: str) -> Column:
        return F.sum(F.col("support") * F.col(name)) / F.sum("support")

    return classes.agg(
        F.round(F.sum("hits") / F.sum("support"), 4).alias("accuracy"),
        F.round(weighted("p"), 4).alias("precision"),
        F.round(weighted("r"), 4).alias("recall"),
        F.round(weighted("f"), 4).alias("f1_score"),
    )


def regression_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """M5: root mean squared error, mean absolute error and R²."""
    require_columns(scored, label, prediction)
    y = col(label).cast("double")
    gap = y - col(prediction).cast("double")
    mse = F.avg(gap * gap)
    return scored.agg(
        F.round(F.sqrt(mse), 4).alias("rmse"),
        F.round(F.avg(F.abs(gap)), 4).alias("mae"),
        F.round(1 - F.try_divide(mse, F.var_pop(y)), 4).alias("r2_score"),
    )


def threshold_curve(scored: DataFrame, positive: str = "label", score: str = "score",
                    by: Sequence[str] = ()) -> DataFrame:
    """M8: ROC and precision-recall points, one per distinct score, highest score first."""
    require_columns(scored, positive, score, *by)
    named = scored.na.drop(subset=list(by)) if by else scored
    rows = named.select(
        *map(quoted, by), col(score).cast("double").alias("threshold"), col(positive).cast("long").alias("__hit")
    )
    counts = rows.groupBy(*map(quoted, by), "threshold").agg(
        F.sum("__hit").alias("__pos"), F.sum(1 - F.col("__hit")).alias("__neg")
    )
    order = Order(("threshold",), descending=("threshold",))
    curve = running_sums(
        counts, order, {"tp": F.col("__pos"), "fp": F.col("__neg")}, by, totals={"tp": "__p", "fp": "__n"},
        source=rows,
    )
    return curve.select(
        *map(quoted, by), "threshold", "tp", "fp",
        F.try_divide(F.col("tp"), F.col("__p")).alias("tpr"),
        F.try_divide(F.col("fp"), F.col("__n")).alias("fpr"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        "__pos", "__neg", "__p", "__n",
    )


def roc_pr_points(scored: DataFrame, positive: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """M8: the points to draw."""
    return threshold_curve(scored, positive, score, by).drop("__pos", "__neg", "__p", "__n")


def roc_pr_summary(scored: DataFrame, positive: str = "label", score: str = "score",
                   by: Sequence[str] = ()) -> DataFrame:
    """M8/M9: area under ROC (trapezoids), average precision (steps) and base rate."""
    curve = threshold_curve(scored, positive, score, by)
    area = F.col("__neg") * (F.col("tp") - F.col("__pos") / 2) / (F.col("__p") * F.col("__n"))
    step = F.col("__pos") / F.col("__p") * F.col("precision")
    both = (F.col("__p") > 0) & (F.col("__n") > 0)
    return curve.groupBy(*map(quoted, by)).agg(
        F.round(F.sum(F.when(both, area)), 4).alias("roc_auc"),
        F.round(F.sum(F.when(F.col("__p") > 0, step)), 4).alias("average_precision"),
        F.round(F.max(F.col("__p") / (F.col("__p") + F.col("__n"))), 4).alias("base_rate"),
    )


def calibration(scored: DataFrame, positive: str = "label", score: str = "score", bins: int = 10) -> DataFrame:
    """Mean score and observed rate per quantile bin, with the mean absolute gap."""
    require_columns(scored, positive, score)
    inner = [i / bins for i in range(1, bins)]
    edges = quantiles(scored, [score], inner, names=[f"e{i}" for i in range(len(inner))]).drop("column", "n")
    s = col(score).cast("double")
    number = F.lit(0)
    for i in range(len(inner)):
        number = number + (s > F.col(f"e{i}")).cast("int")
    table = scored.crossJoin(F.broadcast(edges)).groupBy(number.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(s).alias("mean_score"),
        F.avg(col(positive).cast("double")).alias("observed_rate"),
    )
    gap = F.avg(F.abs(F.col("observed_rate") - F.col("mean_score"))).over(Window.partitionBy())
    # At most `bins` rows here.
    return table.withColumn("mean_gap", gap)


def residual_rows(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Predicted value and residual of every row."""
    require_columns(scored, label, prediction)
    y, guess = col(label).cast("double"), col(prediction).cast("double")
    return scored.select(guess.alias("predicted"), (y - guess).alias("residual"))


def residual_summary(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Root mean squared and mean residual."""
    rows = residual_rows(scored, label, prediction)
    return rows.agg(
        F.round(F.sqrt(F.avg(F.col("residual") * F.col("residual"))), 4).alias("rmse"),
        F.round(F.avg("residual"), 4).alias("mean_residual"),
    )


def residual_histogram(scored: DataFrame, label: str = "label", prediction: str = "prediction",
                       bins: int = 30) -> DataFrame:
    """The residuals in 30 equal-width bins."""
    return histogram(residual_rows(scored, label, prediction), "residual", bins)
