"""Per-group quantiles, correlations, level counts, text ranges and tails on the paths meant for large tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import special
from lumenframe.operators import cleaning, models, ordering, profile, stats


def two_groups(n=6000, seed=4):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({
        "g": np.where(rng.random(n) < 0.9, "big", np.where(rng.random(n) < 0.5, "small", "tiny")),
        "x": np.where(rng.random(n) < 0.3, 7.0, np.where(rng.random(n) < 0.02, np.inf, rng.normal(size=n) * 1e3)),
        "flat": 2.5, "sparse": np.where(rng.random(n) < 0.999, np.nan, rng.normal(size=n)),
    })


@pytest.mark.parametrize("limit", [1_000_000, 400])
def test_group_quantiles_are_exact(spark, monkeypatch, limit):
    """With brackets as the sketches draw them, and narrowed until they hold a few rows or one value."""
    monkeypatch.setattr(ordering, "BRACKET_VALUES", limit)
    if limit < 1000:
        # And with the groups as a stored, joined table.
        monkeypatch.setattr(ordering, "_LISTED_GROUPS", 1)
        monkeypatch.setattr(ordering, "BROADCAST_BYTES", 0)
    pdf, wanted = two_groups(), [0.0, 0.3, 0.5, 0.99]
    out = ordering.quantiles(spark.createDataFrame(pdf).repartition(5), ["x", "flat", "sparse"], wanted, by=["g"]).toPandas()
    for _, row in out.iterrows():
        values = np.sort(pdf.loc[pdf["g"] == row["g"], row["column"]].dropna().to_numpy())
        places = [p * (len(values) - 1) for p in wanted]
        pairs = [(values[math.floor(p)], values[math.ceil(p)], p - math.floor(p)) for p in places]
        expected = [a if a == b else a + (b - a) * share for a, b, share in pairs]
        assert row["n"] == len(values) and np.allclose([row[f"q{i}"] for i in range(len(wanted))], expected)
    assert {(r.g, r.column) for r in out.itertuples()} >= {(g, c) for g in ("big", "small", "tiny") for c in ("x", "flat")}


def test_sketches_that_mislead_are_corrected(spark, monkeypatch):
    """Brackets far from their ranks are opened and then narrowed."""
    honest, calls = ordering._sketch_points, []

    def first_call_off(name, ranks):
        calls.append(name)
        return honest(name, [min(1.0, r / 2 + 0.4) for r in ranks] if len(calls) == 1 else ranks)

    monkeypatch.setattr(ordering, "_sketch_points", first_call_off)
    monkeypatch.setattr(ordering, "BRACKET_VALUES", 500)
    pdf = pd.DataFrame({"g": ["a", "b"] * 3000, "x": np.random.default_rng(1).normal(size=6000)})
    out = ordering.quantiles(spark.createDataFrame(pdf), ["x"], [0.02, 0.5], by=["g"]).toPandas().set_index("g")
    for g in ("a", "b"):
        assert np.allclose(out.loc[g, ["q0", "q1"]].astype(float), pdf.loc[pdf["g"] == g, "x"].quantile([0.02, 0.5]))


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlations_of_many_columns_with_gaps(spark, method):
    rng = np.random.default_rng(3)
    n, k = 400, 40 if method == "pearson" else 6
    base = rng.normal(size=(n, k)) + rng.normal(size=(n, 1))
    base[:, 1] = np.round(base[:, 1])
    base[:, 2] = 5.0
    gaps = rng.random((n, k)) < np.where(np.arange(k) % 3 == 0, 0.2, 0.0)
    pdf = pd.DataFrame(np.where(gaps, np.nan, base), columns=[f"c{i}" for i in range(k)])
    expected = pdf.corr(method)
    out = stats.correlation_pairs(spark.createDataFrame(pdf).repartition(3), method=method).toPandas()
    assert len(out) == k * (k - 1) // 2
    for r in out.itertuples():
        assert r.n == pdf[[r.x, r.y]].dropna().shape[0]
        assert (r.r is None or math.isnan(r.r)) if "c2" in (r.x, r.y) else r.r == pytest.approx(expected.loc[r.x, r.y], abs=1e-12)


def test_kendall_over_two_levels_of_grids(spark, monkeypatch):
    monkeypatch.setattr(stats, "BLOCK_POINTS", 12)
    monkeypatch.setattr(stats, "GRID", 6)
    made = []
    honest = stats._grid_surplus
    monkeypatch.setattr(stats, "_grid_surplus", lambda cells, *rest: (made.append(cells.count()), honest(cells, *rest))[1])
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"x": rng.integers(0, 90, 350).astype(float), "y": rng.normal(size=350).round(1)})
    out = stats.correlation_pairs(spark.createDataFrame(pdf), method="kendall").first()
    dx, dy = (np.sign(pdf[c].to_numpy()[:, None] - pdf[c].to_numpy()) for c in ("x", "y"))
    tau = (dx * dy).sum() / np.sqrt((dx**2).sum() * (dy**2).sum())
    assert out["r"] == pytest.approx(tau, abs=1e-12)
    # Two levels, and nowhere more cells than points.
    assert len(made) >= 4 and max(made) <= 350


def test_texts_with_long_common_beginnings_spread(spark):
    table = spark.range(3000).select(F.concat(F.repeat(F.lit("licence "), 200), F.when(F.col("id") % 2 == 0, F.repeat(F.lit("b"), 500)).otherwise("a"),
                                              F.format_string("%05d", "id")).alias("t"))
    order = ordering.Order(("t",))
    cuts = ordering.find_cuts(table, order, ranges=32)
    sizes = [r["count"] for r in ordering.assign_range(table, order, cuts).groupBy(ordering.BUCKET).count().collect()]
    assert len(sizes) > 20 and max(sizes) < 4 * 3000 / 32


def test_level_counts_and_texts(spark):
    rows = [(i, f"k{i % 3}", "2024-01-%02d" % (i % 28 + 1), float(i % 2) * -1, None, "x" * 70 + str(i % 5), i % 2 == 0, [i]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, k string, day string, zero double, none string, long string, flag boolean, list array<long>")
    roles = {r["column"]: r for r in profile.column_roles(df).collect()}
    assert {c: r["role"] for c, r in roles.items()} == {
        "id": "id", "k": "categorical", "day": "datetime", "zero": "discrete", "none": "empty", "long": "categorical", "flag": "categorical", "list": "id"} or \
        roles["list"]["nunique"] == 60
    assert [roles[c]["nunique"] for c in ("id", "k", "day", "zero", "none", "long", "flag")] == [60, 3, 28, 2, 0, 5, 2]
    assert {r["column"]: r["role"] for r in profile.column_roles(df, exact=False).collect()} == {c: r["role"] for c, r in roles.items()}
    assert profile.column_roles(df.limit(0)).count() == 8
    text = {r["column"]: tuple(r)[1:] for r in profile.describe_text(df.withColumn("own", F.concat(F.repeat(F.lit("y"), 80), F.col("id").cast("string")))).collect()}
    assert text["long"] == (5, "x" * 70 + "0", 12) and text["none"] == (0, None, 0) and text["own"] == (60, "y" * 80 + "0", 1) and text["k"] == (3, "k0", 20)


def test_sparse_one_hot(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 7 != 0, F.concat(F.lit("v"), "id")).alias("a"), (F.col("id") % 3).cast("string").alias("b"))
    coded, levels = cleaning.one_hot_sparse(df, ["a", "b"])
    names = {r["position"]: (r["column"], r["level"]) for r in levels.collect()}
    assert coded.columns == ["id", "positions"] and sorted(names) == list(range(len(names)))
    for r in coded.where("id < 40").collect():
        assert [names[p] for p in r["positions"]] == ([("a", f"v{r['id']}")] if r["id"] % 7 else []) + [("b", str(r["id"] % 3))]


def test_tails():
    assert special.student_two_sided(1.96, 1e12) == pytest.approx(math.erfc(1.96 / math.sqrt(2)), rel=1e-9)
    # Both forms where they meet.
    for t in (0.1, 1.0, 3.0, 8.0):
        many = special.student_two_sided(t, special._MANY)
        assert special.beta_cdf(special._MANY / (special._MANY + t * t), special._MANY / 2, 0.5) == pytest.approx(many, rel=1e-8)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(special, "_STEPS", 3)
        with pytest.raises(ArithmeticError):
            special.gamma_sf(50.0, 60.0)


def test_boosting_on_folded_rows_is_boosting_on_all_rows(spark):
    df = spark.range(900).select((F.col("id") % 6).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), F.col("id"))
    df = df.withColumn("y", F.col("a") * 2 - F.col("b") + F.sin("id"))
    prepared = models.prepare(df, "y", ["a", "b"], "id")
    size = models.TreeSize(rounds=5, boosted_depth=3)
    train = prepared.train()
    plain = models.build("XGBoost", prepared, 1, size).fit(train)
    folded = models._train(models.build("XGBoost", prepared, 1, size), train, False)
    assert models.folded(train, False).count() == 30
    both = zip(plain.transform(prepared.test()).orderBy("__row").collect(), folded.transform(prepared.test()).orderBy("__row").collect())
    assert all(abs(p["prediction"] - q["prediction"]) < 1e-9 for p, q in both)
