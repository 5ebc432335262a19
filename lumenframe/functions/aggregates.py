"""The vocabulary of named aggregates, with the missing-value rules of a data frame.

Every name maps to one or more built-in partial aggregates, except ``median``,
which is computed by the distributed quantile operator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordering import quantiles
from ..schema import as_double, col, is_missing, is_numeric, dtype, quoted

ROW_ORDERED = ("first", "last")
NAMES = (
    "sum", "mean", "median", "min", "max", "count", "size", "std", "var",
    "nunique", "first", "last", "prod", "sem", "skew", "kurt",
)


def check_name(agg: str) -> str:
    if agg not in NAMES:
        raise ValueError(f"Unknown aggregate '{agg}'; choose one of {', '.join(NAMES)}.")
    return agg


def expression(df: DataFrame, value: str, agg: str, row_id: str | None = None) -> Column:
    """The aggregate as a column; ``median`` has no single-pass form."""
    check_name(agg)
    x = as_double(df, value) if is_numeric(dtype(df, value)) else col(value)
    n = F.count(x)
    if agg in ROW_ORDERED:
        if row_id is None:
            raise ValueError(f"'{agg}' needs a row_id column that states the row order.")
        place = F.when(x.isNotNull(), col(row_id))
        return F.min_by(x, place) if agg == "first" else F.max_by(x, place)
    simple = {
        "mean": lambda: F.avg(x),
        "min": lambda: F.min(x),
        "max": lambda: F.max(x),
        "count": lambda: n,
        "size": lambda: F.count(F.lit(1)),
        "std": lambda: F.stddev_samp(x),
        "var": lambda: F.var_samp(x),
        "nunique": lambda: F.count_distinct(x),
        "sum": lambda: F.coalesce(F.sum(x), F.lit(0.0)),
        "prod": lambda: F.coalesce(F.product(x), F.lit(1.0)),
        "sem": lambda: F.try_divide(F.stddev_samp(x), F.sqrt(n)),
        "skew": lambda: _skew(x, n),
        "kurt": lambda: _kurt(x, n),
    }
    if agg not in simple:
        raise ValueError("'median' needs grouped_aggregate().")
    return simple[agg]()


def _skew(x: Column, n: Column) -> Column:
    """Bias-corrected skewness; zero for a constant, null below three values."""
    flat = F.var_pop(x) == 0
    correction = F.try_divide(F.sqrt((n * (n - 1)).cast("double")), n - 2)
    return F.when(n >= 3, F.when(flat, 0.0).otherwise(F.skewness(x) * correction))


def _kurt(x: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis; zero for a constant, null below four values."""
    flat = F.var_pop(x) == 0
    count = n.cast("double")
    scale = F.try_divide(count - 1, (count - 2) * (count - 3))
    return F.when(
        n >= 4, F.when(flat, 0.0).otherwise(scale * ((count + 1) * F.kurtosis(x) + F.lit(6.0)))
    )


def grouped_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    value: str | None,
    agg: str,
    row_id: str | None = None,
    name: str = "value",
) -> DataFrame:
    """``agg(value)`` per key; rows with a missing key drop out, as in a data frame."""
    present = df
    for k in keys:
        present = present.where(~is_missing(df, k))
    grouped = [quoted(k) for k in keys]
    if value is None:
        return present.groupBy(*grouped).agg(F.count(F.lit(1)).alias(name))
    if check_name(agg) != "median":
        return present.groupBy(*grouped).agg(expression(df, value, agg, row_id).alias(name))
    middle = quantiles(present, [value], [0.5], by=keys, names=[name]).drop("column", "n")
    if not keys:
        # One row even when there is no value at all.
        return df.sparkSession.range(1).join(middle, how="left").select(name)
    # Groups whose values are all missing keep their row.
    groups = present.groupBy(*grouped).agg(F.count(F.lit(1)).alias("__n")).drop("__n")
    return groups.join(middle, list(keys), "left").select(*grouped, name)
