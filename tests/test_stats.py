from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import special
from lumenframe.functions.normal import with_normal_quantile
from lumenframe.operators import stats


def sample(n: int = 400) -> pd.DataFrame:
    rng = np.random.default_rng(11)
    a = np.where(rng.random(n) < 0.35, 0.0, rng.normal(size=n))
    return pd.DataFrame({"a": a, "b": a + rng.normal(size=n), "c": rng.integers(0, 6, n).astype(float),
                         "k": 1.0, "d": np.where(rng.random(n) < 0.2, np.nan, a - rng.normal(size=n))})


def brute_tau(x: np.ndarray, y: np.ndarray) -> float:
    sx, sy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    return (sx * sy).sum() / np.sqrt((sx**2).sum() * (sy**2).sum())


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlation_matches_pandas(spark, ranged, method):
    pdf = sample()
    out = stats.correlation_matrix(spark.createDataFrame(pdf), method=method).toPandas()
    ours = out.pivot(index="x", columns="y", values="r").astype(float)
    ranks = pdf if method == "pearson" else None
    for x in pdf:
        for y in pdf:
            pair = pdf[[x, y]].dropna() if x != y else pdf[[x]].dropna()
            columns = [pair.iloc[:, 0], pair.iloc[:, -1]]
            if ranks is None:
                columns = [c.rank() for c in columns]
            expected = np.corrcoef(*columns)[0, 1] if min(c.std() for c in columns) > 0 else np.nan
            assert np.isclose(ours.loc[x, y], expected, equal_nan=True), (x, y)


@pytest.mark.parametrize("block,grid", [(200_000, 256), (60, 4), (12, 4)])
def test_kendall_matches_brute_force(spark, ranged, monkeypatch, block, grid):
    monkeypatch.setattr(stats, "BLOCK_POINTS", block)
    monkeypatch.setattr(stats, "GRID", grid)
    pdf = sample(150)[["a", "b", "c"]]
    out = stats.correlation_pairs(spark.createDataFrame(pdf), method="kendall").collect()
    for r in out:
        assert np.isclose(r["r"], brute_tau(pdf[r["x"]].to_numpy(), pdf[r["y"]].to_numpy())), r


def test_block_surplus_with_weights():
    rng = np.random.default_rng(0)
    x, y, w = rng.integers(0, 9, 60), rng.integers(0, 9, 60), rng.integers(1, 5, 60)
    sign = np.sign(x[:, None] - x) * np.sign(y[:, None] - y) * w[:, None] * w
    assert stats.block_surplus(x, y, w) == sign.sum() / 2


def test_method_is_checked(house):
    with pytest.raises(ValueError):
        stats.correlation_pairs(house, method="magic")


def test_tails_match_commons_math(spark):
    base = spark._jvm.org.apache.commons.math3.distribution
    for t, dof in ((0.3, 1.0), (2.0, 10.0), (4.5, 200.0)):
        assert np.isclose(special.student_two_sided(t, dof), 2 * (1 - base.TDistribution(dof).cumulativeProbability(t)))
    for f, a, b in ((0.5, 2.0, 9.0), (3.1, 4.0, 9995.0), (1.0, 1.0, 1.0)):
        assert np.isclose(special.fisher_sf(f, a, b), 1 - base.FDistribution(a, b).cumulativeProbability(f))
    for x, dof in ((0.01, 1.0), (5.0, 3.0), (80.0, 60.0)):
        assert np.isclose(special.chi_square_sf(x, dof), 1 - base.ChiSquaredDistribution(dof).cumulativeProbability(x))
    for p, dof in ((0.975, 5.0), (0.9, 1.0), (0.6, 1499.0)):
        assert np.isclose(special.student_quantile(p, dof), base.TDistribution(dof).inverseCumulativeProbability(p))


def test_normal_quantile(spark):
    from statistics import NormalDist

    places = [1e-12, 1e-4, 0.02, 0.3, 0.5, 0.8, 0.999, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in places], "p double")
    out = with_normal_quantile(df, F.col("p"), "z").collect()
    assert np.allclose([r["z"] for r in out], [NormalDist().inv_cdf(p) for p in places], atol=1e-9)


def test_shapiro_published_example(spark, ranged):
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    row = stats.check_normality(spark.createDataFrame([(float(w),) for w in weights], "x double"), "x").first()
    assert (row["statistic"], row["p_value"], row["is_normal"]) == (0.7888, 0.0067, False)


def test_shapiro_accepts_a_normal_sample(spark):
    row = stats.check_normality(spark.range(4000).select(F.randn(5).alias("x")), "x").first()
    assert row["statistic"] > 0.99 and row["is_normal"]


def test_group_tests(spark, churn):
    anova = stats.anova(churn, "charges", "contract").first()
    t = stats.t_test(churn, "charges", "contract", row_id="id").first()
    assert anova["is_significant"] and t["is_significant"]
    assert np.isclose(anova["statistic"], t["statistic"] ** 2, rtol=1e-3)
    assert t["group1"] == churn.orderBy("id").first()["contract"]
    chi = stats.chi_square(churn, "contract", "churn").first()
    assert chi["dof"] == 1
    ci = stats.mean_interval(churn, "tenure").first()
    assert ci["lower_bound"] < ci["mean"] < ci["upper_bound"]


def test_chi_square_with_empty_cells(spark):
    wide = spark.createDataFrame([("a", "x")] * 30 + [("b", "y")] * 20 + [("c", "x")] * 10, "g string, h string")
    row = stats.chi_square(wide, "g", "h").first()
    assert (row["statistic"], row["dof"]) == (60.0, 2)
    square = stats.chi_square(wide.where("g <> 'c'"), "g", "h").first()
    e = np.array([[18.0, 12.0], [12.0, 8.0]])
    expected = ((np.abs(np.array([[30, 0], [0, 20]]) - e) - 0.5) ** 2 / e).sum()
    assert np.isclose(square["statistic"], expected, atol=1e-4) and square["dof"] == 1


def test_inputs_are_checked(spark, churn):
    one = spark.createDataFrame([(5.0, "a")], "x double, g string")
    for call in (
        lambda: stats.check_normality(churn, "contract"), lambda: stats.t_test(churn, "charges", "tenure"),
        lambda: stats.check_normality(one, "x"), lambda: stats.mean_interval(one, "x"),
        lambda: stats.anova(one, "x", "g"),
    ):
        with pytest.raises(ValueError):
            call()


def test_non_ascii_names(spark):
    df = spark.range(60).select((F.col("id") % 50).alias("나이"),
                                F.element_at(F.array(*map(F.lit, ["서울", "부산", "제주"])), (F.col("id") % 3 + 1).cast("int")).alias("지역"),
                                (F.rand(1) * 100).alias("매출"))
    assert stats.anova(df, "매출", "지역").first()["num_groups"] == 3
