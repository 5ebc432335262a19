"""Faults of scale and edges: text ranges, many levels, workers without the package, signs and constants."""

from __future__ import annotations

import os
import subprocess
import sys

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import expressions
from lumenframe.operators import cleaning, distribution, grouped, models, ordering, profile, stats, timeseries
from lumenframe.sources import readers


@pytest.mark.parametrize("name", ["format_string('Customer#%09d', id)", "concat('https://host.example/', id)"])
def test_texts_with_a_common_beginning_spread_over_the_ranges(spark, name):
    table = spark.range(4000).select(F.expr(name).alias("name"))
    order = ordering.Order(("name",))
    cuts = ordering.find_cuts(table, order, ranges=32)
    sizes = [r["count"] for r in ordering.assign_range(table, order, cuts).groupBy(ordering.BUCKET).count().collect()]
    assert len(sizes) > 20 and max(sizes) < 4 * 4000 / 32


def test_text_positions_follow_the_order(spark, ranged):
    table = spark.range(500).select(F.format_string("käse-%05d", F.col("id") * 7 % 500).alias("name"))
    got = [r["name"] for r in ordering.row_positions(table, ordering.Order(("name",))).orderBy("position").collect()]
    assert got == sorted(got, key=str.encode) and len(got) == 500


def test_levels_have_no_limit(spark):
    table = spark.range(1500).select(F.concat(F.lit("k"), "id").alias("k"), (F.col("id") % 2).alias("two"))
    assert grouped.crosstab(table, "two", "k").count() == 3000
    assert len(cleaning.one_hot(table, ["k"]).columns) == 1501


def test_remainder_and_roots(spark):
    row = spark.range(1).select(F.lit(7).alias("a"), F.lit(-3).alias("b"))
    value = lambda text: row.select(expressions.arithmetic(row, text).alias("v")).first()["v"]
    assert value("a % b") == 7 % -3 and value("b % a") == -3 % 7 and value("b ** 0.5") is None


def test_hexagons_of_a_constant_column(spark):
    assert distribution.hexbin(spark.range(10).select(F.lit(2.0).alias("x"), F.col("id").alias("y")), "x", "y").agg(F.sum("count")).first()[0] == 10


def test_duplicates_need_row_ids(spark):
    table = spark.createDataFrame([(1, "a"), (None, "b")], "id int, v string")
    with pytest.raises(ValueError):
        profile.duplicate_rows(table, "id")


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Statistics that use Python workers run away from the repository."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from lumenframe.session import local_session
from lumenframe.operators import stats
from pyspark.sql import functions as F
spark = local_session(2, memory="2g")
t = spark.range(40).select("id", F.randn(1).alias("x"), F.randn(2).alias("y"), (F.col("id") % 2).cast("string").alias("g"))
print(*[r.collect() for r in (stats.anova(t, "x", "g"), stats.shapiro(t, "x"), stats.t_test(t, "x", "g"), stats.chi_square(t, "g", "g"))])
print(stats.correlation_matrix(t.select("x", "y"), method="kendall").collect())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


@pytest.mark.parametrize("infer", [True, False])
@pytest.mark.parametrize("line", ["3,4,5", "3"])
def test_csv_rows_of_another_width_are_an_error(spark, tmp_path, line, infer):
    path = tmp_path / "ragged.csv"
    path.write_text(f"a,b\n1,2\n{line}\n")
    with pytest.raises(ValueError, match="1 rows"):
        readers.read_csv(spark, str(path), infer=infer)


def test_csv_fields_may_hold_line_breaks(spark, tmp_path):
    path = tmp_path / "breaks.csv"
    path.write_text('a,b\n1,"x\ny"\n2,z\n')
    assert [tuple(r) for r in readers.read_csv(spark, str(path)).orderBy("a").collect()] == [(1, "x\ny"), (2, "z")]


@pytest.mark.parametrize("freq", ["2W", "3W", "2ME", "3MS", "2QE", "2QS", "2YE", "2YS"])
def test_multiples_of_calendar_units(spark, freq):
    days = pd.date_range("2021-02-17", "2024-11-05", freq="9D")
    want = pd.Series(1.0, index=days).resample(freq).sum()
    table = spark.createDataFrame([(str(d), 1.0) for d in days], "t string, v double").withColumn("t", F.to_timestamp("t"))
    got = timeseries.resample(table, "t", "v", freq, "sum").orderBy("t").toPandas()
    assert list(got["t"]) == list(want.index) and list(got["value"]) == list(want)


def test_modes_of_several_types(spark):
    table = spark.createDataFrame([(1, "b", 2.0), (2, "a", float("nan")), (2, "b", 2.0), (1, "a", None)], "i int, s string, x double")
    table = table.withColumn("none", F.lit(None).cast("string"))
    assert cleaning.modes(table, ["s", "i", "none", "x"]) == ["a", 1, None, 2.0]


def test_nothing_to_test_is_an_error(spark):
    table = spark.range(4).select((F.col("id") % 2).cast("string").alias("g"), F.lit(None).cast("double").alias("x"),
                                  F.lit(None).cast("string").alias("h"))
    with pytest.raises(ValueError):
        stats.t_test(table, "x", "g")
    with pytest.raises(ValueError):
        stats.chi_square(table, "g", "h")


def test_random_search_over_large_grids(spark, planted):
    table = planted.select("x1", "x2", "target_bin")
    found = models.tune(table, "target_bin", "LogisticRegression", {"C": [0.01 * k for k in range(1, 31)]}, cv=2).collect()
    assert len(found) == models.GRID_LIMIT and {r["method"] for r in found} == {"random"}
    assert found[0]["score"] > 0.7 and [r["score"] for r in found] == sorted((r["score"] for r in found), reverse=True)


def test_crosstab_keeps_its_levels_as_a_table(spark):
    from lumenframe.operators import grouped

    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x"), ("c", "z")], "r string, c string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = grouped.crosstab(df, "r", "c")
        plan = out._jdf.queryExecution().toString()
        assert "collect_set" not in plan and "Broadcast" not in plan
        got = {(x["r"], x["c"]): x["count"] for x in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert got == {(r, c): {"ax": 1, "ay": 1, "bx": 2, "cz": 1}.get(r + c, 0) for r in "abc" for c in "xyz"}
