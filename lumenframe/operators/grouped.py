"""Grouped, pivoted and ranked aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.aggregates import check_name, expression, grouped_aggregate
from ..schema import as_label, col, is_missing, quoted, require_columns, require_numeric
from .ordering import Order, running_sums, value_counts

MAX_SERIES = 8
OTHER = "Other"
IMBALANCE_PERCENT = 30.0


def aggregate(df: DataFrame, value: str, agg: str, keys=(), row_id: str | None = None) -> DataFrame:
    """A1: a named aggregate over the table or per group."""
    require_columns(df, value, *keys, row_id)
    return grouped_aggregate(df, list(keys), value, agg, row_id)


def category_shares(df: DataFrame, column: str) -> DataFrame:
    """A2: value counts with their share of the non-missing rows, in percent."""
    require_columns(df, column)
    counts = grouped_aggregate(df, [column], None, "size", name="count")
    total = F.broadcast(counts.agg(F.sum("count").alias("__all")))
    return counts.crossJoin(total).select(
        quoted(column), "count", (F.col("count") * 100.0 / F.col("__all")).alias("percent")
    )


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """A3: class counts, rounded percentages and the imbalance flag."""
    require_columns(df, target)
    shares = category_shares(df, target)
    rows = F.broadcast(df.agg(F.count(F.lit(1)).alias("total_samples")))
    smallest = F.broadcast(shares.agg((F.min("percent") < IMBALANCE_PERCENT).alias("is_imbalanced")))
    return (
        shares.crossJoin(smallest)
        .crossJoin(rows)
        .withColumn("percent", F.round("percent", 2))
    )


def bar(df: DataFrame, column: str, value: str | None = None, agg: str = "mean", top_n: int = 20,
        row_id: str | None = None) -> DataFrame:
    """A4: the ``top_n`` largest categories, with the number of all categories."""
    require_columns(df, column, value)
    if value:
        require_numeric(df, value)
    groups = grouped_aggregate(df, [column], value, agg, row_id)
    total = F.broadcast(groups.agg(F.count(F.lit(1)).alias("n_categories")))
    best = groups.orderBy(F.desc_nulls_last("value"), col(column)).limit(top_n)
    return best.crossJoin(total)


def crosstab(df: DataFrame, row: str, column: str, fill: bool = True) -> DataFrame:
    """A5: joint counts in long form; absent cells are 0, or left out with ``fill=False``."""
    require_columns(df, row, column)
    counts = grouped_aggregate(df, [row, column], None, "size", name="count")
    if not fill:
        return counts
    # Every level of one key beside every level of the other is the result asked for; Spark deals large sides in blocks.
    rows = counts.select(quoted(row)).distinct()
    levels = counts.select(quoted(column)).where(col(column).isNotNull()).distinct()
    grid = rows.crossJoin(levels)
    return grid.join(counts, [row, column], "left").withColumn("count", F.coalesce("count", F.lit(0)))


def crosstab_wide(df: DataFrame, row: str, column: str, max_levels: int | None = None) -> DataFrame:
    """A5, wide: one column per level; the level list is read first."""
    require_columns(df, row, column)
    levels = column_levels(df, column, max_levels)
    present = df.where(~is_missing(df, row) & ~is_missing(df, column))
    return present.groupBy(quoted(row)).pivot(quoted(column), levels).agg(F.count(F.lit(1))).fillna(0)


def column_levels(df: DataFrame, column: str, max_levels: int | None = None) -> list:
    """The sorted distinct values, needed where levels become columns; an error if there are more than allowed."""
    found = df.where(~is_missing(df, column)).select(col(column)).distinct()
    found = (found if max_levels is None else found.limit(max_levels + 1)).collect()
    if max_levels is not None and len(found) > max_levels:
        raise ValueError(f"'{column}' has more than {max_levels} levels; use the long form.")
    return sorted(r[0] for r in found)


def pivot(df: DataFrame, index: str, column: str, value: str, agg: str = "mean",
          row_id: str | None = None) -> DataFrame:
    """``agg(value)`` per index × column, in long form."""
    require_columns(df, index, column, value)
    require_numeric(df, value)
    return grouped_aggregate(df, [index, column], value, agg, row_id).where(F.col("value").isNotNull())


def pivot_wide(df: DataFrame, index: str, column: str, value: str, agg: str = "mean",
               row_id: str | None = None, max_levels: int | None = None) -> DataFrame:
    """A6 as a matrix, one column per level."""
    cells = pivot(df, index, column, value, agg, row_id)
    levels = column_levels(df, column, max_levels)
    return cells.groupBy(quoted(index)).pivot(quoted(column), levels).agg(F.first("value"))


def most_frequent(df: DataFrame, column: str, limit: int) -> list:
    """The ``limit`` most frequent values on the driver, ties by value."""
    counts = value_counts(df, column, name="__times")
    return [r[0] for r in counts.orderBy(F.desc("__times"), col(column)).limit(limit).collect()]


def fold_rare(df: DataFrame, column: str, max_levels: int = MAX_SERIES) -> DataFrame:
    """Keep the ``max_levels - 1`` largest levels as text, the rest as 'Other'.

    Nothing is folded while the column has at most ``max_levels`` levels;
    missing values form the level ``nan``. The few kept levels are read first,
    so the fold itself is a projection.
    """
    require_columns(df, column)
    labelled = df.withColumn(column, as_label(column))
    head = most_frequent(labelled, column, max_levels + 1)
    if len(head) <= max_levels:
        return labelled
    kept = col(column).isin(head[: max_levels - 1])
    return labelled.withColumn(column, F.when(kept, col(column)).otherwise(F.lit(OTHER)))


def stacked(df: DataFrame, category: str, stack: str, value: str | None = None, agg: str = "sum",
            normalize: bool = False, top_n: int = 12, row_id: str | None = None) -> DataFrame:
    """Composition of ``stack`` within the ``top_n`` largest categories."""
    require_columns(df, category, stack, value)
    if value:
        require_numeric(df, value)
    folded = fold_rare(df.select(*{category: 0, stack: 0, **({value: 0} if value else {}),
                                   **({row_id: 0} if row_id else {})}), stack)
    cells = grouped_aggregate(folded, [category, stack], value, agg, row_id)
    if value:
        cells = cells.where(F.col("value").isNotNull())
    cells = cells.withColumn("value", F.col("value").cast("double"))
    totals = cells.groupBy(quoted(category)).agg(F.sum("value").alias("total"))
    best = totals.orderBy(F.desc("total"), col(category)).limit(top_n)
    grid = best.crossJoin(F.broadcast(cells.select(quoted(stack)).distinct()))
    filled = grid.join(cells, [category, stack], "left").withColumn(
        "value", F.coalesce("value", F.lit(0.0))
    )
    if normalize:
        filled = filled.withColumn("value", F.try_divide(F.col("value"), F.col("total")) * 100)
    return filled.select(quoted(category), quoted(stack), "value", "total")


def pareto(df: DataFrame, column: str, value: str | None = None, agg: str = "sum",
           row_id: str | None = None) -> DataFrame:
    """Every category with its rank, share, cumulative share and 80 % flag.

    ``in_80`` marks the leading categories up to and including the one that
    reaches 80 %. Keep ``rank <= 15`` for the usual chart.
    """
    require_columns(df, column, value)
    if value:
        require_numeric(df, value)
    totals = grouped_aggregate(df, [column], value, agg, row_id, name="total")
    totals = totals.withColumn("total", F.col("total").cast("double"))
    if value:
        totals = totals.where(F.col("total") > 0)
    order = Order(("total", column), descending=("total",))
    ranked = running_sums(
        totals, order, {"__upto": F.col("total"), "rank": F.lit(1).cast("long")}, totals={"__upto": "__all"}
    )
    before = (F.col("__upto") - F.col("total")) / F.col("__all") * 100
    return ranked.select(
        quoted(column),
        "rank",
        "total",
        (F.col("total") / F.col("__all") * 100).alias("share"),
        (F.col("__upto") / F.col("__all") * 100).alias("cumulative"),
        ((F.col("rank") == 1) | (before < 80.0)).alias("in_80"),
    )


def waterfall(df: DataFrame, category: str, value: str, agg: str = "sum", top_n: int = 12,
              row_id: str | None = None) -> DataFrame:
    """Contributions by size, the tail as 'Other', with running start and end."""
    require_columns(df, category, value)
    require_numeric(df, value)
    parts = grouped_aggregate(df, [category], value, agg, row_id, name="contribution")
    parts = parts.select(col(category).cast("string").alias("category"),
                         F.col("contribution").cast("double").alias("contribution"))
    best = parts.orderBy(F.abs("contribution").desc_nulls_last(), "category").limit(top_n)
    head = best.withColumn(
        "position", F.row_number().over(Window.orderBy(F.abs("contribution").desc_nulls_last(), "category"))
    )
    rest = (
        parts.join(F.broadcast(head.select("category")), "category", "left_anti")
        .agg(F.sum("contribution").alias("contribution"), F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > 0)
        .select(F.lit(OTHER).alias("category"), "contribution", F.lit(top_n + 1).alias("position"))
    )
    bars = head.select("category", "contribution", "position").unionByName(rest)
    # At most top_n + 1 rows from here on.
    so_far = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    end = F.sum("contribution").over(so_far)
    return bars.select(
        "position",
        "category",
        "contribution",
        (end - F.coalesce("contribution", F.lit(0.0))).alias("start"),
        end.alias("end"),
        F.sum("contribution").over(everything).alias("total"),
    )


def slope(df: DataFrame, category: str, value: str, period: str, start=None, end=None,
          agg: str = "mean", top_n: int = 8, row_id: str | None = None) -> DataFrame:
    """A10: each category's change between two periods, largest movement first."""
    require_columns(df, category, value, period)
    require_numeric(df, value)
    label = col(period).cast("string")
    seen = df.where(~is_missing(df, period)).agg(F.min(label), F.max(label)).first()
    if seen[0] is None or seen[0] == seen[1]:
        raise ValueError(f"'{period}' needs at least 2 distinct periods.")
    first = str(start) if start is not None else seen[0]
    last = str(end) if end is not None else seen[1]
    if first == last:
        raise ValueError("start and end must differ.")
    chosen = df.where(label.isin(first, last)).withColumn("__period", label)
    cells = grouped_aggregate(chosen, [category, "__period"], value, agg, row_id)
    wide = cells.groupBy(quoted(category)).agg(
        F.max(F.when(F.col("__period") == first, F.col("value"))).alias("start_value"),
        F.max(F.when(F.col("__period") == last, F.col("value"))).alias("end_value"),
    )
    change = F.col("end_value") - F.col("start_value")
    return (
        wide.where(F.col("start_value").isNotNull() & F.col("end_value").isNotNull())
        .withColumns({"start_period": F.lit(first), "end_period": F.lit(last), "change": change})
        .orderBy(F.abs("change").desc(), col(category))
        .limit(top_n)
    )


def stat_tile(df: DataFrame, column: str, agg: str = "mean", compare: str | None = None,
              row_id: str | None = None) -> DataFrame:
    """One aggregate of a column, with an optional second one."""
    require_numeric(df, column)
    names = {"value": check_name(agg), **({"compare_value": check_name(compare)} if compare else {})}
    single = {k: expression(df, column, a, row_id) for k, a in names.items() if a != "median"}
    tiles = [df.agg(*[e.cast("double").alias(k) for k, e in single.items()])] if single else []
    tiles += [
        grouped_aggregate(df, [], column, "median", name=k) for k, a in names.items() if a == "median"
    ]
    out = tiles[0]
    for extra in tiles[1:]:
        out = out.crossJoin(F.broadcast(extra))
    return out.select(*[F.round(k, 6).alias(k) for k in names])


def confusion(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Counts per (label, prediction)."""
    require_columns(scored, label, prediction)
    return scored.groupBy(quoted(label), quoted(prediction)).agg(F.count(F.lit(1)).alias("count"))
