from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import ordering
from lumenframe.operators.ordering import Order


def frame(n: int = 3000) -> pd.DataFrame:
    rng = np.random.default_rng(7)
    return pd.DataFrame({
        "id": rng.permutation(n),
        "hot": np.where(rng.random(n) < 0.4, 5, rng.integers(0, 1000, n)),
        "x": np.where(rng.random(n) < 0.35, 0.0, rng.exponential(10, n)),
        "gap": np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n)),
        "g": np.where(rng.random(n) < 0.4, "big", rng.integers(0, 6, n).astype(str)),
    })


@pytest.mark.parametrize("descending", [(), ("hot",)])
def test_running_sums_split_a_hot_order_key(spark, ranged, descending):
    pdf = frame()
    out = ordering.running_sums(
        spark.createDataFrame(pdf), Order(("hot", "id"), descending), {"upto": F.col("x")}, totals={"upto": "all"}
    ).toPandas()
    ordered = pdf.sort_values(["hot", "id"], ascending=[not descending, True])
    expected = dict(zip(ordered["id"], ordered["x"].cumsum()))
    assert np.allclose(out["upto"], out["id"].map(expected))
    assert np.allclose(out["all"], pdf["x"].sum())


def test_hot_key_is_cut_into_several_ranges(spark):
    df = spark.createDataFrame(frame())
    order = Order(("hot", "id"))
    cuts = ordering.find_cuts(df, order)
    sizes = ordering.assign_range(df, order, cuts).where("hot = 5").groupBy(ordering.BUCKET).count().toPandas()
    assert len(sizes) > 5


def test_running_sums_by_group(spark, ranged):
    pdf = frame()
    out = ordering.running_sums(spark.createDataFrame(pdf), Order(("id",)), {"k": F.lit(1)}, by=["g"]).toPandas()
    expected = pdf.sort_values("id").groupby("g").cumcount() + 1
    assert dict(zip(out["id"], out["k"])) == dict(zip(pdf["id"], expected.reindex(pdf.index)))


def test_text_and_time_keys_keep_their_order(spark, ranged):
    df = spark.range(2000).select(
        F.concat(F.lit("ä"), F.lpad(F.pmod(F.col("id") * 7919, F.lit(2000)).cast("string"), 5, "0")).alias("t"),
        F.timestamp_seconds(F.col("id") * 37).alias("ts"), "id",
    )
    by_text = ordering.row_positions(df, Order(("t",))).orderBy("position").toPandas()["t"].tolist()
    assert by_text == sorted(by_text)
    by_time = ordering.row_positions(df, Order(("ts",))).toPandas()
    assert (by_time["position"] == by_time["id"] + 1).all()


def test_carry_forward(spark):
    pdf = frame()
    out = ordering.carry_forward(spark.createDataFrame(pdf), ["gap"], "id").toPandas().sort_values("id")
    expected = pdf.sort_values("id")["gap"].ffill()
    assert np.allclose(out["gap"].astype(float), expected, equal_nan=True)


@pytest.mark.parametrize("n", [1, 2, 10, 5000])
def test_whole_column_quantiles(spark, ranged, n):
    pdf = frame(n)
    pdf["flat"] = 3.0
    wanted = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    found = ordering.column_quantiles(spark.createDataFrame(pdf), ["x", "hot", "gap", "flat"], wanted)
    for c in ("x", "hot", "gap", "flat"):
        present = pdf[c].dropna()
        if len(present):
            assert found[c][0] == len(present)
            assert np.allclose(found[c][1], present.quantile(wanted))
        else:
            assert c not in found


def test_bracket_that_misses_its_rank_is_moved(spark):
    pdf = frame(5000)
    values = spark.createDataFrame(pdf[["x"]].rename(columns={"x": "x0"}))
    ranks = pdf["x"].sort_values().to_numpy()
    for low, high in ((ranks[4000], ranks[4100]), (ranks[2600], ranks[2700])):
        brackets = {(0, 0): ordering._Bracket(0, 3500, 3501, float(low), float(high))}
        while brackets:
            settled, narrow = ordering._prove(values, brackets)
            brackets = ordering._narrow(values, narrow) if narrow else {}
        assert ordering._pick(values, settled) == {(0, 0): (ranks[3500], ranks[3501])}


def test_grouped_quantiles_with_a_big_group(spark, ranged):
    pdf = frame()
    out = ordering.quantiles(spark.createDataFrame(pdf), ["x", "gap"], [0.25, 0.5, 0.99], by=["g"]).toPandas()
    for _, row in out.iterrows():
        expected = pdf.loc[pdf["g"] == row["g"], row["column"]].quantile([0.25, 0.5, 0.99])
        assert np.allclose([row["q0"], row["q1"], row["q2"]], expected)
    assert len(out) == 2 * pdf["g"].nunique()


def test_look_up_serves_hot_and_cold_values(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _check_look_up(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def _check_look_up(spark):
    pdf = frame()
    df = spark.createDataFrame(pdf)
    table = df.groupBy("hot").agg(F.count(F.lit(1)).alias("n"), (F.min("hot") * 10).alias("pay"))
    out = ordering.look_up(df, table, "hot", "n", distinct=10**9)
    plain = out.toPandas()
    assert len(plain) == len(pdf) and (plain["pay"] == plain["hot"] * 10).all()
    # The salted lane must stay a shuffle key of its own.
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(hot#\d+L?, __lane#\d+", plan)


def test_spread_range_covers_every_number(spark):
    first, last = F.lit(5).cast("long"), F.lit(200_007).cast("long")
    starts, numbers = ordering.spread_range(first, last)
    out = spark.range(1).select(F.explode(starts).alias("__start")).select(F.explode(numbers).alias("i"))
    assert out.agg(F.count("i"), F.min("i"), F.max("i"), F.count_distinct("i")).first() == (200_003, 5, 200_007, 200_003)
