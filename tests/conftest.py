from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lumenframe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    session = local_session(8, memory="8g", app="tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture
def ranged(monkeypatch):
    """Send even tiny tables down the paths meant for big ones."""
    from lumenframe.operators import ordering

    monkeypatch.setattr(ordering, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(ordering, "BRACKET_VALUES", 20)


@pytest.fixture(scope="session")
def house(spark) -> DataFrame:
    """Price rises with area, and 120 of 2000 prices are extreme."""
    base = spark.range(2000).withColumn("area", 50 + 150 * F.rand(1))
    extreme = F.when(F.col("id") < 120, 1500.0).otherwise(0.0)
    return base.select(
        "id", "area", (F.col("area") * 3 + 20 * F.randn(2) + extreme).alias("price"),
        (1 + F.floor(F.rand(3) * 4)).cast("long").alias("bedrooms"),
        F.when(F.rand(4) < 0.5, "yes").otherwise("no").alias("aircon"),
    ).persist()


@pytest.fixture(scope="session")
def churn(spark) -> DataFrame:
    base = spark.range(400).withColumns(
        {"tenure": F.floor(F.rand(1) * 72).cast("long"),
         "contract": F.when(F.rand(2) < 0.5, "Monthly").otherwise("Yearly"), "u": F.rand(3), "e": F.randn(4)}
    )
    charges = 60 + 5 * F.col("e") + F.when(F.col("contract") == "Monthly", 10).otherwise(0)
    leaves = F.col("u") < F.when(F.col("tenure") < 12, 0.8).otherwise(0.2)
    return base.select(
        "id", "tenure", "contract", F.when(F.col("id") >= 10, charges).alias("charges"),
        F.when(leaves, "Yes").otherwise("No").alias("churn"),
    ).persist()


@pytest.fixture(scope="session")
def daily(spark) -> DataFrame:
    return spark.range(180).select(
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("date"),
        (100 + F.col("id") + 10 * F.randn(5)).alias("sales"),
        F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("store"),
    ).persist()


@pytest.fixture(scope="session")
def planted(spark) -> DataFrame:
    base = spark.range(300).withColumns({"x1": F.randn(1), "x2": F.randn(2), "e1": F.randn(3), "e2": F.randn(4)})
    return base.select(
        "id", "x1", "x2",
        (F.col("x1") + F.col("x2") + 0.5 * F.col("e1") > 0).cast("long").alias("target_bin"),
        (3 * F.col("x1") - 2 * F.col("x2") + 0.5 * F.col("e2")).alias("target_reg"),
    ).persist()
