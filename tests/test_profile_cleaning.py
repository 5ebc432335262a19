from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.functions.expressions import arithmetic
from lumenframe.operators import cleaning, features, profile


def roles_of(df) -> dict:
    return {r["column"]: r["role"] for r in profile.column_roles(df).collect()}


def test_one_column_per_role(spark):
    df = spark.range(100).select(
        F.randn(0).alias("value"), (F.col("id") % 3 + 1).alias("level"),
        F.when(F.col("id") % 2 == 0, "서울").otherwise("부산").alias("city"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("when"),
        F.concat(F.lit("u"), F.col("id")).alias("user_id"),
        F.concat(F.lit("free text "), F.floor(F.col("id") / 1.5)).alias("note"), F.lit("same").alias("fixed"),
        F.lit(None).cast("double").alias("nothing"), (F.col("id") % 2 == 0).alias("flag"), F.col("id").alias("item key"),
    )
    assert roles_of(df) == {
        "value": "numeric", "level": "discrete", "city": "categorical", "when": "datetime", "user_id": "id",
        "note": "text", "fixed": "constant", "nothing": "empty", "flag": "categorical", "item key": "id",
    }
    buckets = {r["column"]: r["bucket"] for r in profile.type_buckets(df).collect()}
    assert buckets["when"] == "datetime" and buckets["note"] == "text" and buckets["fixed"] == "categorical"


def test_number_texts_are_not_dates(spark):
    df = spark.createDataFrame([(v,) for v in ["10", "20", "30"] * 20], "n string")
    assert roles_of(df)["n"] == "categorical"


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, b string")
    assert {r["rows"] for r in profile.dataset_info(df).collect()} == {0}
    assert profile.missing_summary(df).first().asDict() == {"total_missing": 0, "missing_percentage": 0.0}
    assert profile.duplicate_summary(df).first()["duplicate_percentage"] == 0.0
    assert set(roles_of(df).values()) == {"empty"}
    assert profile.describe_text(df).first()["frequency"] == 0


def test_describe_matches_pandas(spark, house):
    ours = profile.describe(house.select("price", "bedrooms")).toPandas().set_index("column")
    theirs = house.select("price", "bedrooms").toPandas().describe().T
    assert np.allclose(ours.loc[theirs.index].to_numpy(dtype=float), theirs.to_numpy())


def test_profile_parts(house, spark):
    done = profile.profile(house)
    assert done.numeric.count() == 4 and done.text.count() == 1 and done.high_correlations.count() == 0
    assert done.size.first()["bytes"] > 2000 * 32
    texts_only = profile.profile(spark.createDataFrame([("a",)], "t string"))
    assert texts_only.numeric is None and texts_only.high_correlations is None


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert profile.dataset_info(df).first()["missing"] == 2
    assert profile.describe(df).first()["mean"] == 1.0


def test_duplicates_keep_the_first(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, None), (6, "a")], "id int, v string")
    assert profile.duplicate_summary(df, ["v"]).first()["duplicate_count"] == 3
    assert [r["id"] for r in profile.duplicate_preview(df, "id", ["v"]).collect()] == [3, 5, 6]


def test_long_texts_are_told_apart(spark):
    df = spark.createDataFrame([("x" * 500 + str(i % 3),) for i in range(9)], "t string")
    assert profile.duplicate_summary(df, ["t"]).first()["duplicate_count"] == 6


def test_missingness(spark, house):
    assert profile.missingness(house).count() == 0
    gappy = house.withColumn("price", F.when(F.col("id") % 4 != 0, F.col("price")))
    assert [tuple(r) for r in profile.missingness(gappy).collect()] == [("price", 25.0, 2000, 1)]


@pytest.mark.parametrize("n", [5, 2000, 2001, 7777])
def test_matrix_is_thinned_evenly(spark, ranged, n):
    df = spark.range(n).select("id", F.when(F.col("id") % 3 != 0, 1).alias("v"))
    out = profile.missingness_matrix(df, "id").toPandas().sort_values("position")
    expected = np.arange(n) if n <= 2000 else np.linspace(0, n - 1, 2000).astype(int)
    assert out["position"].tolist() == expected.tolist()
    assert (out["v"] == (out["position"] % 3 == 0)).all()


def test_outliers_are_all_removed(house):
    summary = cleaning.outlier_summary(house, "price").first()
    assert summary["outlier_count"] > 100
    left = cleaning.remove_outliers(house, "price")
    assert left.count() == 2000 - summary["outlier_count"]
    with pytest.raises(ValueError, match="iqr"):
        cleaning.outlier_bounds(house, "price", "nope")
    with pytest.raises(ValueError, match="numeric"):
        cleaning.remove_outliers(house, "aircon")


def test_removing_outliers_reveals_the_correlation(house):
    before = house.corr("area", "price")
    after = cleaning.remove_outliers(house, "price").corr("area", "price")
    assert before < 0.6 < 0.9 < after


def test_impute_strategies(spark):
    rows = [(1, 1.0, "b"), (2, None, None), (3, 3.0, "a"), (4, 3.0, "b"), (5, None, "a"), (6, 2.5, None)]
    df = spark.createDataFrame(rows, "id int, x double, t string")

    def done(numeric, text="mode"):
        out = cleaning.impute(df, numeric, text, row_id="id").orderBy("id").collect()
        return [r["x"] for r in out], [r["t"] for r in out]

    assert done("mean") == ([1.0, 2.375, 3.0, 3.0, 2.375, 2.5], ["b", "a", "a", "b", "a", "a"])
    assert done("median")[0] == [1.0, 2.75, 3.0, 3.0, 2.75, 2.5]
    assert done("mode")[0] == [1.0, 3.0, 3.0, 3.0, 3.0, 2.5]
    assert done("ffill", "ffill") == ([1.0, 1.0, 3.0, 3.0, 3.0, 2.5], ["b", "b", "a", "b", "a", "a"])
    assert done("mean", "drop")[0] == [1.0, 3.0, 3.0, 2.375]
    with pytest.raises(ValueError):
        cleaning.impute(df, "magic")
    with pytest.raises(ValueError, match="row_id"):
        cleaning.impute(df, "ffill")


def test_all_missing_and_constant_columns(spark):
    df = spark.range(20).select("id", F.lit(None).cast("double").alias("x"), F.lit(7.0).alias("k"),
                                F.lit(None).cast("string").alias("t"))
    mean = cleaning.impute(df)
    assert mean.where("x is not null").count() == 0 and mean.where("t = 'Unknown'").count() == 20
    assert cleaning.impute(df, "mode").where("x = 0").count() == 20
    scaled = cleaning.scale(df, ["x", "k"]).first()
    assert scaled["k"] == 0.0 and scaled["x"] is None
    assert cleaning.scale(df, ["k"], "minmax").first()["k"] == 0.0


@pytest.mark.parametrize("small", [True, False])
def test_label_codes(spark, request, small):
    if not small:
        request.getfixturevalue("ranged")
    values = ["b", None, "a", "c", "a", "zeta"] * 300
    df = spark.createDataFrame(list(enumerate(values)), "id int, v string")
    out = cleaning.label_encode(df, ["v"]).toPandas().sort_values("id")
    codes = {"a": 0, "b": 1, "c": 2, "nan": 3, "zeta": 4}
    assert out["v"].tolist() == [codes[v or "nan"] for v in values]


def test_one_hot(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "id int, v string")
    out = cleaning.one_hot(df, ["v"])
    assert out.columns == ["id", "v_x", "v_y"]
    assert [tuple(r)[1:] for r in out.orderBy("id").collect()] == [(True, False), (False, False), (False, True)]
    with pytest.raises(ValueError, match="levels"):
        cleaning.one_hot(df, ["v"], max_levels=1)


def test_expressions(spark):
    df = spark.createDataFrame([(6, 3.0, 0.0)], "`a b` int, x double, z double")

    def value(text):
        return df.select(arithmetic(df, text).alias("v")).first()["v"]

    assert value("`a b` / x + 2 ** 3") == 10.0
    assert value("-(x - 1) * 2") == -4.0
    assert value("x / z") is None and value("x // z") is None
    for bad in ("x +", "nope * 2", "__import__('os')", "x.real", "[1]"):
        with pytest.raises(ValueError):
            value(bad)


def test_polynomial_names_and_missing_input(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "a double, b double")
    full = features.polynomial(df, ["a", "b"], 2)
    assert full.columns == ["a", "b", "a^2", "a b", "b^2"] and tuple(full.first()) == (2.0, 3.0, 4.0, 6.0, 9.0)
    assert features.polynomial(df, ["a", "b"], 2, True).columns == ["a", "b", "a b"]
    with pytest.raises(Exception, match="need a value"):
        features.polynomial(spark.createDataFrame([(None, 1.0)], "a double, b double"), ["a", "b"]).collect()


def test_datetime_parts_match_pandas(spark):
    texts = ["2024-02-29 23:59:58", "2023-12-31", "2024-01-06", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = features.datetime_parts(df, "t", ["year", "quarter", "dayofweek", "hour", "is_weekend"]).toPandas()
    times = pd.to_datetime(pd.Series(texts), format="mixed")
    assert out["t_dayofweek"].tolist()[:3] == times.dt.dayofweek.tolist()[:3]
    assert out["t_is_weekend"].tolist() == [0, 1, 1, 0]
    assert out["t_hour"].tolist()[0] == 23
    with pytest.raises(ValueError, match="Unsupported"):
        features.datetime_parts(df, "t", ["century"])
    with pytest.raises(Exception, match="Not a date"):
        features.datetime_parts(spark.createDataFrame([("soon",)], "t string"), "t").collect()


def test_columns_are_checked(house):
    for call in (lambda: profile.duplicate_summary(house, ["nope"]), lambda: cleaning.one_hot(house, ["nope"]),
                 lambda: features.polynomial(house, ["nope"]), lambda: cleaning.scale(house, ["nope"])):
        with pytest.raises(ValueError, match="not found"):
            call()
