"""Every operator as a named query over the given tables, with its SQL twin where SQL can say it."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import temporal
from ..functions.aggregates import NAMES
from ..operators import cleaning, distribution, features, grouped, models, profile, scoring, stats, timeseries
from ..schema import col
from ..session import apply_defaults, shared_dir
from ..sources import readers, sensor
from . import recommend
from .catalog_sql import SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


class Tables:
    """The given Parquet tables by attribute."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = apply_defaults(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        return readers.read_parquet(self.spark, os.path.join(self.folder, f"{name}.parquet"))

    @property
    def gappy_events(self) -> DataFrame:
        """Events with every tenth value and every seventh type missing."""
        return self.events.withColumns(
            {
                "value": F.when(col("event_id") % 10 != 0, col("value")),
                "event_type": F.when(col("event_id") % 7 != 0, col("event_type")),
            }
        )

    @property
    def scored_lines(self) -> DataFrame:
        """Line items with a 0/1 label, a score in [0, 1] and a 0/1 prediction computed from their columns."""
        score = F.round((col("l_quantity") + col("l_discount") * 100 + col("l_linenumber")) / 70, 4)
        noisy = col("l_quantity") + F.pmod(col("l_partkey"), F.lit(40)) > 45
        return self.lineitem.withColumns({"score": score, "label": noisy.cast("int")}).withColumn(
            "prediction", (col("score") >= 0.5).cast("int")
        )


def query(name: str):
    """Register a function of the tables under ``name``."""

    def register(function: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, folder: function(Tables(spark, folder))
        return function

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, so that summation order does not show."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(col(c), digits).alias(c) if kinds[c] == "double" else col(c) for c in df.columns])


def day(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


# --- Sources and sinks ----------------------------------------------------------

def _scratch(t: Tables, name: str) -> str:
    return os.path.join(shared_dir(t.spark), f"{name}-{uuid.uuid4().hex}")


@query("S1_csv_scan")
def _(t: Tables) -> DataFrame:
    path = readers.write_csv(t.orders, _scratch(t, "orders-csv"))
    return rounded(
        readers.read_csv(t.spark, path).groupBy("o_orderstatus").agg(
            F.count("o_orderkey").alias("orders"), F.sum("o_totalprice").alias("total"), F.max("o_custkey").alias("top")
        ), 2,
    )


@query("S3_csv_round_trip")
def _(t: Tables) -> DataFrame:
    cleaned = cleaning.remove_outliers(t.events.select("event_id", "event_type", "value"), "value")
    path = readers.write_csv(cleaned, _scratch(t, "events-csv"))
    return rounded(readers.read_csv(t.spark, path))


@query("S3_parquet_round_trip")
def _(t: Tables) -> DataFrame:
    path = readers.write_parquet(t.customer, _scratch(t, "customer"), partition_by=["c_mktsegment"])
    return rounded(readers.read_parquet(t.spark, path).select("c_custkey", "c_acctbal", "c_mktsegment"))


@query("S4_sensor_text")
def _(t: Tables) -> DataFrame:
    bad = col("event_id") % 10 == 0
    number = F.format_string("%.2f", col("value"))
    line = F.concat_ws(
        "  ", F.date_format("ts", "yyyy MM dd HH mm"), (col("user_id") % 360).cast("string"),
        F.when(bad, "99.0").otherwise(F.format_string("%.4f", col("value") / 100)),
        F.lit("99.0"), number, F.lit("99.0"), F.lit("99.0"), F.lit("999"),
        F.when(bad, "9999.0").otherwise(number), F.lit("999.0"), number, F.lit("999.0"), F.lit("99.0"), F.lit("99.00"),
    )
    parsed = sensor.parse_observations(t.events.select(line.alias("value")))
    return rounded(
        parsed.groupBy(day("datetime").alias("day")).agg(
            F.count(F.lit(1)).alias("n"), F.count("wind_speed").alias("speeds"), F.count("wave_height").alias("waves"),
            F.count("pressure").alias("pressures"), F.avg("pressure").alias("mean_pressure"),
            F.sum("wind_dir").alias("directions"),
        ), 4,
    )


# --- Profiling ------------------------------------------------------------------

@query("P1_dataset_info")
def _(t: Tables) -> DataFrame:
    return profile.dataset_info(t.gappy_events)


@query("P2_numeric_describe")
def _(t: Tables) -> DataFrame:
    return rounded(profile.describe(t.lineitem), 4)


@query("P3_text_describe")
def _(t: Tables) -> DataFrame:
    return profile.describe_text(t.gappy_events.select("event_type", "props"))


@query("P4_missing_summary")
def _(t: Tables) -> DataFrame:
    return profile.missing_summary(t.gappy_events)


@query("P5_high_correlations")
def _(t: Tables) -> DataFrame:
    return profile.high_correlations(features.derive(t.lineitem, "l_extendedprice * (1 - l_discount)", "revenue"))


def _role_table(t: Tables) -> DataFrame:
    return t.orders.withColumns(
        {"o_day": day("o_orderdate"), "o_fixed": F.lit("x"), "o_empty": F.lit(None).cast("string"),
         "o_year": F.year("o_orderdate"), "row_id": col("o_orderkey"),
         "o_half": F.when(col("o_orderkey") % 2 == 0, col("o_orderstatus")),
         "o_note": F.concat(F.lit("note "), F.floor(col("o_orderkey") / 1.5).cast("string")),
         "o_code": F.concat(F.lit("c"), (col("o_custkey") % 60).cast("string"))}
    )


@query("P6_column_roles")
def _(t: Tables) -> DataFrame:
    return profile.column_roles(_role_table(t)).drop("position")


@query("P7_type_buckets")
def _(t: Tables) -> DataFrame:
    return profile.type_buckets(_role_table(t))


@query("P8_duplicate_summary")
def _(t: Tables) -> DataFrame:
    return profile.duplicate_summary(t.documents, ["text"])


@query("P8_duplicate_rows")
def _(t: Tables) -> DataFrame:
    return profile.duplicate_rows(t.documents, "doc_id", ["text"]).select("doc_id")


@query("P8_duplicate_preview")
def _(t: Tables) -> DataFrame:
    return profile.duplicate_preview(t.orders, "o_orderkey", ["o_custkey", "o_orderstatus"])


@query("P9_missingness")
def _(t: Tables) -> DataFrame:
    return profile.missingness(t.gappy_events)


@query("P10_missingness_matrix")
def _(t: Tables) -> DataFrame:
    return profile.missingness_matrix(t.gappy_events, "event_id", ["event_type", "value", "props"])


@query("P11_date_likeness")
def _(t: Tables) -> DataFrame:
    mixed = F.when(col("o_orderkey") % 20 == 0, "n/a").otherwise(day("o_orderdate"))
    return rounded(temporal.date_likeness(t.orders.withColumn("o_day", mixed), "o_day"))


@query("P12_data_size")
def _(t: Tables) -> DataFrame:
    return profile.data_size(t.documents)


# --- Cleaning -------------------------------------------------------------------

def _imputed(t: Tables, numeric: str, text: str) -> DataFrame:
    gappy = t.gappy_events.select("event_id", "event_type", "value")
    return rounded(cleaning.impute(gappy, numeric, text, row_id="event_id"))


for _name, _numeric, _text in (
    ("C1_impute_mean", "mean", "mode"), ("C2_impute_median", "median", "mode"), ("C3_impute_mode", "mode", "mode"),
    ("C4_forward_fill", "ffill", "ffill"), ("C5_drop_missing", "drop", "drop"), ("C5_fill_then_drop", "median", "drop"),
):
    query(_name)(partial(_imputed, numeric=_numeric, text=_text))


@query("L3_drop_missing_subset")
def _(t: Tables) -> DataFrame:
    return cleaning.drop_missing(t.gappy_events, ["value"]).select("event_id", "event_type", "value")


for _method in ("iqr", "zscore"):

    @query(f"C6_outlier_flags_{_method}")
    def _(t: Tables, method: str = _method) -> DataFrame:
        return cleaning.flag_outliers(t.gappy_events, "value", method).select("event_id", "is_outlier")

    @query(f"C7_outlier_summary_{_method}")
    def _(t: Tables, method: str = _method) -> DataFrame:
        return rounded(cleaning.outlier_summary(t.gappy_events, "value", method), 4)

    @query(f"C7_outlier_preview_{_method}")
    def _(t: Tables, method: str = _method) -> DataFrame:
        return cleaning.outlier_preview(t.gappy_events, "value", "event_id", method)

    @query(f"C8_remove_outliers_{_method}")
    def _(t: Tables, method: str = _method) -> DataFrame:
        return cleaning.remove_outliers(t.gappy_events, "value", method).select("event_id", "value")


@query("C9_label_encode")
def _(t: Tables) -> DataFrame:
    return cleaning.label_encode(t.gappy_events, ["event_type"]).select("event_id", "event_type")


@query("C9_label_classes")
def _(t: Tables) -> DataFrame:
    return cleaning.label_classes(t.part, "p_name")


@query("C10_one_hot")
def _(t: Tables) -> DataFrame:
    return cleaning.one_hot(t.gappy_events.select("event_id", "event_type"), ["event_type"])


@query("C10_one_hot_sparse")
def _(t: Tables) -> DataFrame:
    coded, levels = cleaning.one_hot_sparse(t.gappy_events.select("event_id", "event_type"), ["event_type"])
    named = coded.select("event_id", F.explode_outer("positions").alias("position")).join(F.broadcast(levels), "position", "left")
    return named.select("event_id", "position", "level")


for _method in ("standard", "minmax"):

    @query(f"{'C11' if _method == 'standard' else 'C12'}_scale_{_method}")
    def _(t: Tables, method: str = _method) -> DataFrame:
        scaled = cleaning.scale(t.gappy_events, ["value", "user_id"], method)
        return rounded(scaled.select("event_id", "value", "user_id"))

    @query(f"{'C11' if _method == 'standard' else 'C12'}_scale_{_method}_info")
    def _(t: Tables, method: str = _method) -> DataFrame:
        return rounded(cleaning.scaling_info(t.gappy_events, ["value", "user_id"], method))


# --- Features -------------------------------------------------------------------

def _line_key(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[col(c) for c in columns])


@query("F1_derived_column")
def _(t: Tables) -> DataFrame:
    text = "l_extendedprice ** 0.5 * (1 - l_discount) / (l_quantity - 1) + l_tax"
    return rounded(_line_key(features.derive(t.lineitem, text, "derived"), "derived"))


@query("F2_polynomial")
def _(t: Tables) -> DataFrame:
    made = features.polynomial(t.lineitem, ["l_quantity", "l_discount"], 3)
    names = ["l_quantity^2", "l_quantity l_discount", "l_discount^2", "l_quantity^3", "l_quantity^2 l_discount",
             "l_quantity l_discount^2", "l_discount^3"]
    return rounded(_line_key(made, *names))


@query("F3_interactions")
def _(t: Tables) -> DataFrame:
    made = features.polynomial(t.lineitem, ["l_quantity", "l_discount", "l_tax"], 3, interaction_only=True)
    return rounded(_line_key(made, "l_quantity l_discount", "l_quantity l_tax", "l_discount l_tax",
                             "l_quantity l_discount l_tax"))


@query("F4_datetime_parts")
def _(t: Tables) -> DataFrame:
    gaps = t.events.withColumn("ts", F.when(col("event_id") % 10 != 0, col("ts")))
    made = features.datetime_parts(gaps, "ts", list(temporal.PARTS))
    # Doubles, since whole numbers with gaps read differently from engine to engine.
    return made.select("event_id", *[col(f"ts_{p}").cast("double").alias(f"ts_{p}") for p in temporal.PARTS])


@query("F5_preview")
def _(t: Tables) -> DataFrame:
    made = features.derive(t.orders, "o_totalprice / 1000", "thousands")
    return rounded(features.preview(made, ["thousands"], "o_orderkey"))


# --- Grouped aggregates -----------------------------------------------------------

def _named_aggregate(t: Tables, agg: str) -> DataFrame:
    source = t.gappy_events
    if agg == "prod":
        source = source.withColumn("value", 1 + col("value") / 1e6)
    return rounded(grouped.aggregate(source, "value", agg, ["event_type"], row_id="event_id"), 4)


for _name in NAMES:
    query(f"A1_{_name}")(partial(_named_aggregate, agg=_name))


@query("A1_global_median")
def _(t: Tables) -> DataFrame:
    return rounded(grouped.aggregate(t.lineitem, "l_extendedprice", "median"), 4)


@query("A2_value_counts")
def _(t: Tables) -> DataFrame:
    return rounded(grouped.category_shares(t.gappy_events, "event_type"))


@query("A3_target_distribution")
def _(t: Tables) -> DataFrame:
    return grouped.target_distribution(t.orders, "o_orderpriority")


@query("A4_bar_counts")
def _(t: Tables) -> DataFrame:
    return grouped.bar(t.part, "p_brand")


@query("A4_bar_median")
def _(t: Tables) -> DataFrame:
    return rounded(grouped.bar(t.part, "p_brand", "p_retailprice", "median"), 4)


@query("A5_crosstab")
def _(t: Tables) -> DataFrame:
    return grouped.crosstab(t.part, "p_brand", "p_type")


@query("A5_crosstab_wide")
def _(t: Tables) -> DataFrame:
    return grouped.crosstab_wide(t.lineitem, "l_returnflag", "l_linestatus")


@query("A6_pivot")
def _(t: Tables) -> DataFrame:
    return rounded(grouped.pivot(t.part, "p_brand", "p_type", "p_retailprice"), 4)


@query("A6_pivot_wide")
def _(t: Tables) -> DataFrame:
    return rounded(grouped.pivot_wide(t.lineitem, "l_returnflag", "l_linestatus", "l_quantity", "median"), 4)


@query("A7_stacked_values")
def _(t: Tables) -> DataFrame:
    return rounded(grouped.stacked(t.part, "p_type", "p_brand", "p_retailprice"), 4)


@query("A7_stacked_shares")
def _(t: Tables) -> DataFrame:
    return rounded(grouped.stacked(t.part, "p_brand", "p_type", normalize=True, top_n=12), 4)


@query("A8_pareto_counts")
def _(t: Tables) -> DataFrame:
    return rounded(grouped.pareto(t.orders, "o_custkey"), 4)


@query("A8_pareto_values")
def _(t: Tables) -> DataFrame:
    return rounded(grouped.pareto(t.customer, "c_nationkey", "c_acctbal"), 4)


@query("A9_waterfall")
def _(t: Tables) -> DataFrame:
    return rounded(grouped.waterfall(t.customer, "c_nationkey", "c_acctbal"), 4)


@query("A10_slope")
def _(t: Tables) -> DataFrame:
    dated = t.orders.withColumn("year", F.year("o_orderdate"))
    return rounded(grouped.slope(dated, "o_orderpriority", "o_totalprice", "year"), 4)


@query("A11_stat_tile")
def _(t: Tables) -> DataFrame:
    return grouped.stat_tile(t.lineitem, "l_extendedprice", "mean", "median")


@query("A12_fold_rare")
def _(t: Tables) -> DataFrame:
    return grouped.fold_rare(t.part, "p_brand").select("p_partkey", "p_brand")


@query("A13_confusion")
def _(t: Tables) -> DataFrame:
    return grouped.confusion(t.scored_lines)


# --- Distributions ------------------------------------------------------------------

@query("D1_histogram")
def _(t: Tables) -> DataFrame:
    return rounded(distribution.histogram(t.lineitem, "l_extendedprice"), 8)


@query("D2_kde")
def _(t: Tables) -> DataFrame:
    return rounded(distribution.kde(t.events, "value"), 8)


@query("D3_grouped_histogram")
def _(t: Tables) -> DataFrame:
    return rounded(distribution.grouped_histogram(t.lineitem, "l_quantity", "l_returnflag", 15))


@query("D4_box")
def _(t: Tables) -> DataFrame:
    return rounded(distribution.box(t.gappy_events, "value", "event_type"), 4)


@query("D4_box_folded")
def _(t: Tables) -> DataFrame:
    return rounded(distribution.box(t.part, "p_retailprice", "p_brand"), 4)


@query("D5_box_two_keys")
def _(t: Tables) -> DataFrame:
    return rounded(distribution.box(t.lineitem, "l_extendedprice", ["l_returnflag", "l_linestatus"], fold=False), 4)


@query("D5_box_outliers")
def _(t: Tables) -> DataFrame:
    return distribution.box_outliers(t.events, "value", "event_type")


@query("D6_violin")
def _(t: Tables) -> DataFrame:
    return rounded(distribution.violin(t.events, "value", "event_type"), 6)


@query("D7_ecdf")
def _(t: Tables) -> DataFrame:
    return rounded(distribution.ecdf(t.events, "value"), 8)


@query("D7_ecdf_grouped")
def _(t: Tables) -> DataFrame:
    return rounded(distribution.ecdf(t.part, "p_retailprice", "p_brand"), 8)


@query("D8_qq_fit")
def _(t: Tables) -> DataFrame:
    return distribution.qq_fit(t.events, "value")


@query("D8_qq_points")
def _(t: Tables) -> DataFrame:
    return rounded(distribution.qq_points(t.customer, "c_acctbal"))


@query("D9_hexbin")
def _(t: Tables) -> DataFrame:
    return rounded(distribution.hexbin(t.lineitem, "l_quantity", "l_extendedprice"), 4)


@query("D10_small_multiples")
def _(t: Tables) -> DataFrame:
    return rounded(distribution.small_multiples(t.part, "p_retailprice", "p_brand"))


@query("D11_small_multiple_lines")
def _(t: Tables) -> DataFrame:
    return distribution.small_multiple_lines(t.part, "p_retailprice", "p_brand", "p_partkey")


@query("D12_before_after")
def _(t: Tables) -> DataFrame:
    return rounded(distribution.before_after(t.events, cleaning.remove_outliers(t.events, "value"), "value"))


@query("D13_before_after_box")
def _(t: Tables) -> DataFrame:
    return rounded(distribution.before_after_box(t.events, cleaning.remove_outliers(t.events, "value"), "value"), 4)


@query("D14_scatter")
def _(t: Tables) -> DataFrame:
    return distribution.scatter(t.gappy_events, "user_id", "value", ["event_type"])


# --- Time series ----------------------------------------------------------------------

@query("T1_time_axis")
def _(t: Tables) -> DataFrame:
    texts = t.orders.withColumn("o_day", day("o_orderdate"))
    return temporal.as_time_axis(texts, "o_day").select("o_orderkey", day("o_day").alias("o_day"),
                                                        F.dayofyear("o_day").alias("day_of_year"))


@query("T2_line")
def _(t: Tables) -> DataFrame:
    table = timeseries.line(t.orders, "o_orderdate", "o_totalprice")
    return rounded(table.withColumn("o_orderdate", day("o_orderdate")), 8)


@query("T3_line_by_group")
def _(t: Tables) -> DataFrame:
    table = timeseries.line(t.orders, "o_orderdate", "o_totalprice", "o_orderstatus", agg="sum")
    return rounded(table.withColumn("o_orderdate", day("o_orderdate")), 2)


def _resampled(t: Tables, freq: str, agg: str) -> DataFrame:
    # Events of three days happen three days later, so that buckets without rows appear.
    moved = F.when(F.dayofmonth("ts").between(10, 12), col("ts") + F.expr("INTERVAL 3 DAYS")).otherwise(col("ts"))
    gaps = t.events.withColumn("ts", moved)
    table = timeseries.resample(gaps, "ts", "value", freq, agg)
    return rounded(table.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm")), 4)


for _name, _freq, _agg in (
    ("T4_resample_daily_mean", "D", "mean"), ("T4_resample_daily_sum", "D", "sum"),
    ("T4_resample_weekly_median", "W", "median"), ("T4_resample_six_hours", "6h", "count"),
):
    query(_name)(partial(_resampled, freq=_freq, agg=_agg))


@query("T4_resample_monthly")
def _(t: Tables) -> DataFrame:
    table = timeseries.resample(t.orders, "o_orderdate", "o_totalprice", "ME", "mean")
    return rounded(table.withColumn("o_orderdate", day("o_orderdate")), 4)


@query("T5_resample_by_group")
def _(t: Tables) -> DataFrame:
    table = timeseries.resample(t.gappy_events, "ts", "value", "D", "sum", "event_type")
    return rounded(table.withColumn("ts", day("ts")), 4)


@query("T6_area")
def _(t: Tables) -> DataFrame:
    joined = t.lineitem.select(col("l_shipdate"), col("l_quantity"), (col("l_suppkey") % 12).alias("lane"))
    table = timeseries.area(joined, "l_shipdate", "l_quantity", "lane", "ME")
    return rounded(table.withColumn("l_shipdate", day("l_shipdate")), 2)


@query("T6_area_shares")
def _(t: Tables) -> DataFrame:
    table = timeseries.area(t.events, "ts", "value", "event_type", "D", normalize=True)
    return rounded(table.withColumn("ts", day("ts")), 4)


def _rolled(t: Tables, agg: str) -> DataFrame:
    table = timeseries.rolling(t.orders, "o_orderdate", "o_totalprice", 7, agg)
    return table.select(day("o_orderdate").alias("o_orderdate"), F.round("raw", 8).alias("raw"),
                        F.round("rolled", 5 if agg == "std" else 8).alias("rolled"))


for _name in ("mean", "median", "std"):
    query(f"T7_rolling_{_name}")(partial(_rolled, agg=_name))


@query("T7_rolling_events")
def _(t: Tables) -> DataFrame:
    table = timeseries.rolling(t.gappy_events, "event_id", "value", 50, "sum")
    return rounded(table, 4)


# --- Correlation, tests, intervals --------------------------------------------------------

@query("H1_pearson")
def _(t: Tables) -> DataFrame:
    return rounded(stats.correlation_pairs(t.lineitem))


@query("H1_pearson_gaps")
def _(t: Tables) -> DataFrame:
    return rounded(stats.correlation_matrix(t.gappy_events))


@query("H2_spearman")
def _(t: Tables) -> DataFrame:
    return rounded(stats.correlation_pairs(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"], "spearman"))


@query("H2_spearman_gaps")
def _(t: Tables) -> DataFrame:
    return rounded(stats.correlation_pairs(t.gappy_events, ["user_id", "value"], "spearman"))


@query("H3_kendall")
def _(t: Tables) -> DataFrame:
    return rounded(stats.correlation_pairs(t.lineitem, ["l_quantity", "l_discount", "l_tax"], "kendall"))


@query("H3_kendall_continuous")
def _(t: Tables) -> DataFrame:
    return rounded(stats.correlation_pairs(t.customer, ["c_custkey", "c_acctbal"], "kendall"))


@query("H4_shapiro")
def _(t: Tables) -> DataFrame:
    return stats.check_normality(t.customer, "c_acctbal")


@query("H5_t_test")
def _(t: Tables) -> DataFrame:
    return stats.t_test(t.lineitem, "l_extendedprice", "l_linestatus")


@query("H6_anova")
def _(t: Tables) -> DataFrame:
    return stats.anova(t.events, "value", "event_type")


@query("H7_chi_square")
def _(t: Tables) -> DataFrame:
    return stats.chi_square(t.lineitem, "l_returnflag", "l_linestatus")


@query("H7_chi_square_yates")
def _(t: Tables) -> DataFrame:
    halves = t.lineitem.withColumn("returned", col("l_returnflag") == "R")
    return stats.chi_square(halves, "returned", "l_linestatus").select("statistic", "dof")


@query("H8_mean_interval")
def _(t: Tables) -> DataFrame:
    return stats.mean_interval(t.customer, "c_acctbal")


# --- Models --------------------------------------------------------------------------------

def _labelled_documents(t: Tables) -> DataFrame:
    """Document features with their quality label."""
    words = F.size(F.split(F.trim("text"), r"\s+"))
    lines = F.size(F.split("text", "\n"))
    letters = F.length(F.regexp_replace("text", r"\P{L}", ""))
    table = t.documents.select(
        "doc_id", "lang", "n_chars", words.alias("words"), lines.alias("lines"),
        F.try_divide(letters, F.length("text")).alias("letter_share"),
    )
    return table.join(t.labels, "doc_id")


DOC_FEATURES = ["n_chars", "words", "lines", "letter_share", "lang"]
LINE_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_returnflag"]


def _lines_with_revenue(t: Tables) -> DataFrame:
    return features.derive(t.lineitem, "l_quantity * 1000 * (1 - l_discount) + l_tax * 100", "revenue")


@query("M1_prepare")
def _(t: Tables) -> DataFrame:
    prepared = models.prepare(t.gappy_events, "value", ["user_id", "event_type"], row_id="event_id")
    test = prepared.share("split", 100) < models.TEST_PERCENT
    return prepared.frame.groupBy(test.alias("is_test")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("label"), 4).alias("mean_label")
    )


@query("M2_task")
def _(t: Tables) -> DataFrame:
    targets = ["l_linenumber", "l_quantity", "l_returnflag"]
    rows = [(c, models.is_classification(t.lineitem, c)) for c in targets]
    return t.spark.createDataFrame(rows, "target string, is_classification boolean")


@query("M3_compare_classifiers")
def _(t: Tables) -> DataFrame:
    return models.compare_models(_labelled_documents(t), "quality", DOC_FEATURES, row_id="doc_id")


@query("M3_compare_regressors")
def _(t: Tables) -> DataFrame:
    return models.compare_models(_lines_with_revenue(t), "revenue", LINE_FEATURES)


@query("M4_evaluate_classifier")
def _(t: Tables) -> DataFrame:
    return models.evaluate_model(_labelled_documents(t), "quality", DOC_FEATURES, row_id="doc_id").metrics


@query("M4_metrics_on_scores")
def _(t: Tables) -> DataFrame:
    return scoring.classification_metrics(t.scored_lines)


@query("M5_evaluate_regressor")
def _(t: Tables) -> DataFrame:
    return models.evaluate_model(_lines_with_revenue(t), "revenue", LINE_FEATURES, "LinearRegression").metrics


def _predicted_lines(t: Tables) -> DataFrame:
    return t.lineitem.withColumn("predicted_price", col("l_quantity") * 2100)


@query("M5_metrics_on_scores")
def _(t: Tables) -> DataFrame:
    return scoring.regression_metrics(_predicted_lines(t), "l_extendedprice", "predicted_price")


@query("M6_tune")
def _(t: Tables) -> DataFrame:
    table = _labelled_documents(t).drop("toxic")
    return models.tune(table, "quality", "LogisticRegression", row_id="doc_id")


@query("M7_scored_test_rows")
def _(t: Tables) -> DataFrame:
    prepared = models.prepare(_lines_with_revenue(t), "revenue", LINE_FEATURES)
    return models.scored_test_rows(prepared, "LinearRegression", "regression").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.corr("label", "prediction"), 4).alias("r")
    )


@query("M8_roc_pr_model")
def _(t: Tables) -> DataFrame:
    return models.roc_pr(_labelled_documents(t), "quality", DOC_FEATURES, "LogisticRegression", "doc_id")


@query("M8_roc_pr_points")
def _(t: Tables) -> DataFrame:
    return rounded(scoring.roc_pr_points(t.scored_lines))


@query("M8_M9_roc_pr_summary")
def _(t: Tables) -> DataFrame:
    return scoring.roc_pr_summary(t.scored_lines)


@query("M8_roc_pr_summary_by_class")
def _(t: Tables) -> DataFrame:
    return scoring.roc_pr_summary(t.scored_lines, by=["l_returnflag"])


@query("M10_calibration")
def _(t: Tables) -> DataFrame:
    return rounded(scoring.calibration(t.scored_lines))


@query("M10_calibration_model")
def _(t: Tables) -> DataFrame:
    return models.calibration_curve(_labelled_documents(t), "quality", DOC_FEATURES, "LogisticRegression",
                                    row_id="doc_id")


@query("M11_feature_importance")
def _(t: Tables) -> DataFrame:
    return models.feature_importance(_labelled_documents(t), "quality", DOC_FEATURES, row_id="doc_id")


@query("M11_coefficients")
def _(t: Tables) -> DataFrame:
    return models.feature_importance(_lines_with_revenue(t), "revenue", LINE_FEATURES, "LinearRegression")


@query("M12_residuals_model")
def _(t: Tables) -> DataFrame:
    return models.residuals(_lines_with_revenue(t), "revenue", LINE_FEATURES, "LinearRegression").summary


@query("M12_residual_summary")
def _(t: Tables) -> DataFrame:
    return scoring.residual_summary(_predicted_lines(t), "l_extendedprice", "predicted_price")


@query("M12_residual_histogram")
def _(t: Tables) -> DataFrame:
    return rounded(scoring.residual_histogram(_predicted_lines(t), "l_extendedprice", "predicted_price"), 8)


@query("M13_learning_curve")
def _(t: Tables) -> DataFrame:
    return models.learning_curve(_lines_with_revenue(t), "revenue", LINE_FEATURES, "LinearRegression")


# --- Recommendation ---------------------------------------------------------------------------

@query("R1_recommend")
def _(t: Tables) -> DataFrame:
    return recommend.recommend(t.gappy_events, target="event_type")


@query("R2_auto_number")
def _(t: Tables) -> DataFrame:
    return rounded(recommend.auto_view(t.lineitem, ["l_extendedprice"]), 8)


@query("R2_auto_category")
def _(t: Tables) -> DataFrame:
    return recommend.auto_view(t.part, ["p_brand"])


@query("R2_auto_number_by_category")
def _(t: Tables) -> DataFrame:
    return rounded(recommend.auto_view(t.gappy_events, ["value", "event_type"]), 4)


@query("R2_auto_two_categories")
def _(t: Tables) -> DataFrame:
    return recommend.auto_view(t.part, ["p_brand", "p_type"])


@query("R2_auto_time_by_group")
def _(t: Tables) -> DataFrame:
    table = recommend.auto_view(t.orders, ["o_orderdate", "o_totalprice", "o_orderstatus"])
    return rounded(table.withColumn("o_orderdate", day("o_orderdate")), 4)


def sql() -> dict[str, str]:
    return {name: text for name, text in SQL.items() if name in QUERIES}
