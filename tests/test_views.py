from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.functions.aggregates import NAMES, grouped_aggregate
from lumenframe.functions.temporal import as_time_axis
from lumenframe.operators import distribution, grouped, timeseries


def letters(spark, text: str):
    return spark.createDataFrame([(c,) for c in text], "c string")


def test_named_aggregates_match_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": range(200), "g": rng.integers(0, 5, 200).astype(str),
                        "x": np.where(rng.random(200) < 0.2, np.nan, rng.normal(1, 0.1, 200))})
    pdf.loc[pdf["g"] == "4", "x"] = np.nan
    df = spark.createDataFrame(pdf)
    for name in NAMES:
        ours = grouped_aggregate(df, ["g"], "x", name, "id").toPandas().set_index("g")["value"].astype(float)
        groups = pdf.groupby("g")["x"]
        theirs = (groups.apply(pd.Series.kurt) if name == "kurt" else groups.agg(name)).astype(float)
        assert np.allclose(ours.reindex(theirs.index), theirs, equal_nan=True), name
    with pytest.raises(ValueError, match="Unknown aggregate"):
        grouped_aggregate(df, ["g"], "x", "magic")


def test_constant_and_tiny_groups(spark):
    df = spark.createDataFrame([("a", 2.0)] * 5 + [("b", 1.0)], "g string, x double")
    skew = {r["g"]: r["value"] for r in grouped_aggregate(df, ["g"], "x", "skew").collect()}
    assert skew == {"a": 0.0, "b": None}
    assert {r["g"]: r["value"] for r in grouped_aggregate(df, ["g"], "x", "std").collect()} == {"a": 0.0, "b": None}


def test_folding(spark):
    small = grouped.fold_rare(letters(spark, "aabbcc"), "c")
    assert small.distinct().count() == 3
    big = grouped.fold_rare(letters(spark, "abcdefghij" * 3 + "aaj"), "c")
    levels = {r[0] for r in big.distinct().collect()}
    assert levels == {"a", "j", "b", "c", "d", "e", "f", "Other"}
    gaps = spark.createDataFrame([(None,), ("x",)], "c string")
    assert {r[0] for r in grouped.fold_rare(gaps, "c").collect()} == {"nan", "x"}


def test_pareto_marks_the_head(spark, ranged):
    counts = {"a": 50, "b": 30, "c": 15, "d": 5}
    df = letters(spark, "".join(k * n for k, n in counts.items()))
    rows = grouped.pareto(df, "c").orderBy("rank").collect()
    assert [(r["c"], r["share"], r["in_80"]) for r in rows] == [
        ("a", 50.0, True), ("b", 30.0, True), ("c", 15.0, False), ("d", 5.0, False)]
    valued = spark.createDataFrame([("a", 5.0), ("b", -2.0), ("c", 0.0)], "c string, v double")
    assert [r["c"] for r in grouped.pareto(valued, "c", "v").collect()] == ["a"]


def test_pareto_with_many_equal_totals(spark, ranged):
    df = spark.range(3000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("c"))
    rows = grouped.pareto(df, "c").orderBy("rank").toPandas()
    assert rows["c"].is_monotonic_increasing and np.allclose(rows["cumulative"], (np.arange(3000) + 1) / 30)
    assert rows["in_80"].sum() == 2400


def test_waterfall_adds_up_and_keeps_a_real_other(spark):
    rows = [(f"k{i:02d}", float(100 - i) * (-1) ** i) for i in range(20)] + [("Other", 500.0)]
    out = grouped.waterfall(spark.createDataFrame(rows, "c string, v double"), "c", "v").orderBy("position").toPandas()
    assert len(out) == 13 and out["category"].tolist().count("Other") == 2
    assert np.isclose(out["contribution"].sum(), sum(v for _, v in rows))
    assert np.allclose(out["end"], out["contribution"].cumsum()) and np.allclose(out["total"], out["end"].iloc[-1])


def test_slope(spark):
    rows = [("a", "2024", 1.0), ("a", "2025", 4.0), ("b", "2024", 9.0), ("b", "2025", 1.0), ("c", "2024", 5.0)]
    df = spark.createDataFrame(rows, "c string, p string, v double")
    assert [(r["c"], r["change"]) for r in grouped.slope(df, "c", "v", "p").collect()] == [("b", -8.0), ("a", 3.0)]
    with pytest.raises(ValueError, match="distinct periods"):
        grouped.slope(df.where("p = '2024'"), "c", "v", "p")
    with pytest.raises(ValueError, match="differ"):
        grouped.slope(df, "c", "v", "p", "2024", "2024")


def test_stacked_shares_add_up(spark, churn):
    out = grouped.stacked(churn, "contract", "churn", normalize=True).groupBy("contract").agg(F.sum("value").alias("s"))
    assert all(abs(r["s"] - 100) < 1e-9 for r in out.collect())


def test_histogram_matches_numpy(house):
    values = house.select("price").toPandas()["price"]
    density, edges = np.histogram(values, bins=10, density=True)
    out = distribution.histogram(house, "price").toPandas().sort_values("bin")
    assert np.allclose(out["density"], density) and np.allclose(out["left"], edges[:-1])


def test_histogram_of_a_constant_and_of_nothing(spark):
    flat = distribution.histogram(spark.createDataFrame([(5.0,)] * 4, "x double"), "x").toPandas()
    assert flat["count"].sum() == 4 and flat["left"].min() == 4.5 and flat["right"].max() == 5.5
    assert distribution.histogram(spark.createDataFrame([], "x double"), "x").count() == 0


def test_density_matches_the_formula(house):
    x = house.select("area").toPandas()["area"].to_numpy()
    h = x.std(ddof=1) * len(x) ** -0.2
    out = distribution.kde(house, "area").toPandas().sort_values("point")
    grid = np.linspace(x.min(), x.max(), 200)
    expected = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(axis=1) / (len(x) * h * np.sqrt(2 * np.pi))
    assert np.allclose(out["density"], expected)


def test_box(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [*range(1, 10), 100]], "g string, v double")
    row = distribution.box(df, "v", "g").first()
    assert (row["q1"], row["median"], row["q3"]) == (3.25, 5.5, 7.75)
    assert (row["whisker_low"], row["whisker_high"], row["n_outliers"]) == (1.0, 9.0, 1)
    assert [tuple(r) for r in distribution.box_outliers(df, "v", "g").collect()] == [("a", 100.0)]


@pytest.mark.parametrize("group", [None, "aircon"])
def test_ecdf_ends_at_one(house, ranged, group):
    out = distribution.ecdf(house, "bedrooms", group)
    assert out.agg(F.max("share")).first()[0] == 1.0
    assert out.count() == (8 if group else 4)


def test_qq_of_a_normal_sample(spark, ranged):
    df = spark.range(3000).select((5 + 2 * F.randn(1)).alias("x"))
    fit = distribution.qq_fit(df, "x").first()
    assert abs(fit["slope"] - 2) < 0.1 and abs(fit["intercept"] - 5) < 0.15 and fit["r"] > 0.99
    with pytest.raises(Exception, match="at least 3"):
        distribution.qq_fit(df.limit(2), "x").collect()


def test_hexbin_counts_every_point(house):
    assert distribution.hexbin(house, "area", "price").agg(F.sum("count")).first()[0] == 2000


def test_before_after(house):
    same = distribution.before_after(house, house, "price").toPandas()
    assert same["unchanged"].all() and set(same["n"]) == {2000}
    changed = distribution.before_after(house, house.where("price < 1000"), "price").toPandas()
    assert not changed["unchanged"].any() and len(changed) == 60


def test_small_multiples(spark):
    df = spark.createDataFrame([(f"k{i % 14}", float(i)) for i in range(280)], "g string, v double")
    out = distribution.small_multiples(df, "v", "g")
    assert out.select("g").distinct().count() == 12 and out.first()["dropped"] == 2
    assert out.agg(F.sum("count")).first()[0] == 240


def test_resampling_fills_and_labels_like_pandas(spark):
    pdf = pd.DataFrame({"t": pd.to_datetime(["2024-01-01 05:00", "2024-01-04 07:00", "2024-01-09 00:00", "2024-03-02 00:00"]),
                        "v": [1.0, 2.0, 3.0, 4.0]})
    df = spark.createDataFrame(pdf)
    for freq in ("D", "W", "ME", "MS", "QE", "YE", "12h", "7h", "2D"):
        for agg in ("sum", "mean", "count", "median"):
            ours = timeseries.resample(df, "t", "v", freq, agg).toPandas().sort_values("t")
            theirs = pdf.groupby(pd.Grouper(key="t", freq=freq))["v"].agg(agg).reset_index()
            assert ours["t"].tolist() == theirs["t"].tolist(), freq
            assert np.allclose(ours["value"].astype(float), theirs["v"], equal_nan=True), (freq, agg)
    with pytest.raises(ValueError, match="frequency"):
        timeseries.resample(df, "t", "v", "fortnight")
    with pytest.raises(ValueError, match="datetime"):
        timeseries.resample(df, "v", "v", "D")


def test_text_dates_become_an_axis(spark, daily):
    assert dict(as_time_axis(daily, "date").dtypes)["date"] == "timestamp"
    half = spark.createDataFrame([("2024-01-01",), ("soon",)], "d string")
    assert dict(as_time_axis(half, "d").dtypes)["d"] == "string"
    assert timeseries.line(daily, "date", "sales", "store").count() == 180


def test_area_shares(daily):
    out = timeseries.area(daily, "date", "sales", "store", "W", normalize=True).toPandas()
    assert np.allclose(out.groupby("date")["value"].sum(), 100)


@pytest.mark.parametrize("agg", ["mean", "median", "std", "skew", "kurt", "sum", "count", "sem"])
def test_rolling_matches_pandas(spark, ranged, monkeypatch, agg):
    monkeypatch.setattr(timeseries, "_CHUNK", 25)
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"t": rng.permutation(200), "v": rng.normal(size=200)})
    out = timeseries.rolling(spark.createDataFrame(pdf), "t", "v", 9, agg).toPandas().sort_values("t")
    expected = pdf.sort_values("t")["v"].rolling(9, min_periods=4).agg(agg)
    assert np.allclose(out["rolled"].astype(float), expected, equal_nan=True)


def test_rolling_limits(daily):
    with pytest.raises(ValueError, match="window"):
        timeseries.rolling(daily, "date", "sales", 1)
    with pytest.raises(ValueError, match="rolling aggregate"):
        timeseries.rolling(daily, "date", "sales", 7, "magic")
