"""Seeded demonstration tables with a planted signal, generated in parallel.

Three tables of the kinds an analyst meets: subscribers who may leave, flats with a few mispriced ones, and daily
sales. Each plants one property that a test or a demonstration can find again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _pick(u: Column, names: list[str]) -> Column:
    """One of the names, each as likely, for a number drawn from [0, 1)."""
    return F.element_at(F.array(*map(F.lit, names)), (F.floor(u * len(names)) + 1).cast("int"))


def customer_churn(spark: SparkSession, rows: int = 5000, seed: int = 1) -> DataFrame:
    """Subscribers; monthly plans and the first year are left more readily.

    The chance of leaving is 10 %, plus 25 points on a monthly plan and 20 points in the first year.
    """
    drawn = spark.range(rows).select(
        "id", F.rand(seed).alias("u_plan"), F.rand(seed + 1).alias("u_age"), F.rand(seed + 2).alias("u_pay"),
        F.randn(seed + 3).alias("noise"), F.rand(seed + 4).alias("u_leave"))
    named = drawn.select(
        "id", _pick(F.col("u_plan"), ["monthly", "yearly", "family"]).alias("contract_type"),
        F.floor(F.col("u_age") * 60).cast("long").alias("tenure"),
        _pick(F.col("u_pay"), ["card", "invoice", "transfer"]).alias("payment_method"), "noise", "u_leave")
    charge = F.round(30 + 10 * (F.col("contract_type") == "family").cast("int") + 4 * F.col("noise"), 2)
    chance = 0.1 + 0.25 * (F.col("contract_type") == "monthly").cast("int") + 0.2 * (F.col("tenure") < 12).cast("int")
    return named.select(
        F.col("id").alias("customer_id"), "contract_type", "tenure", "payment_method",
        F.greatest(charge, F.lit(5.0)).alias("monthly_charges"),
        F.when(F.col("u_leave") < chance, "Yes").otherwise("No").alias("churn"))


def house_price(spark: SparkSession, rows: int = 500, seed: int = 1) -> DataFrame:
    """Flats whose price follows the area, but for one in twenty that is marked at five times its price."""
    drawn = spark.range(rows).select(
        F.rand(seed).alias("u"), F.randn(seed + 1).alias("noise"), F.rand(seed + 2).alias("u_rooms"),
        F.rand(seed + 3).alias("u_lift"), F.rand(seed + 4).alias("u_odd"))
    area = F.round(25 + 125 * F.col("u"), 1)
    fair = 3000 * area + 20000 * F.col("noise") + 15000 * (F.col("u_lift") < 0.5).cast("int")
    return drawn.select(
        area.alias("area"), (F.floor(F.col("u_rooms") * 5) + 1).cast("long").alias("rooms"),
        F.when(F.col("u_lift") < 0.5, "yes").otherwise("no").alias("lift"),
        F.round(F.when(F.col("u_odd") < 0.05, 5 * fair).otherwise(fair)).cast("long").alias("price"))


def sales_timeseries(spark: SparkSession, days: int = 730, seed: int = 1) -> DataFrame:
    """Daily sales of two shops that grow by a tenth a month; the first of every month is a holiday that doubles them."""
    date = F.date_add(F.lit("2021-03-01").cast("date"), F.col("id").cast("int"))
    base = spark.range(days).select("id", date.alias("day"), F.rand(seed).alias("u"), F.randn(seed + 1).alias("noise"))
    holiday = F.dayofmonth("day") == 1
    level = 400 * F.pow(F.lit(1.1), F.col("id") / 30.0) * (1 + 0.05 * F.col("noise"))
    return base.select(
        F.col("day").cast("timestamp").alias("date"), _pick(F.col("u"), ["north", "south"]).alias("shop"),
        F.round(F.when(holiday, 2 * level).otherwise(level)).cast("long").alias("sales"), holiday.cast("long").alias("holiday"))
