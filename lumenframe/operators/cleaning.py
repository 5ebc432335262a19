"""Missing values, outliers, encoding and scaling. Every operator returns a new table."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import (
    as_double,
    as_label,
    col,
    dtype,
    fresh_name,
    is_missing,
    numeric_columns,
    quoted,
    require_columns,
    require_numeric,
    string_columns,
)
from ..session import settle
from .grouped import column_levels
from .ordering import Order, carry_forward, column_quantiles, look_up, running_sums

NUMERIC_STRATEGIES = ("mean", "median", "mode", "ffill", "drop")
TEXT_STRATEGIES = ("mode", "ffill", "drop")


# The statistics below are read once, a bounded handful of numbers, and enter
# the next plan as constants. A chain of cleaning steps therefore stays a chain
# of projections and filters over the source.


def modes(df: DataFrame, columns: Sequence[str]) -> list:
    """The most frequent value of each column, smallest on ties; ``None`` without values."""
    found: dict[int, object] = {}
    kinds: dict[str, list[int]] = {}
    for i, c in enumerate(columns):
        kinds.setdefault(dtype(df, c).simpleString(), []).append(i)
    # Columns of one type are counted together.
    for places in kinds.values():
        entries = [F.struct(F.lit(i).alias("i"), F.when(~is_missing(df, columns[i]), col(columns[i])).alias("v")) for i in places]
        values = df.select(F.inline(F.array(*entries))).where(F.col("v").isNotNull())
        counts = values.groupBy("i", "v").agg((-F.count(F.lit(1))).alias("minus_n"))
        found |= {r["i"]: r["best"]["v"] for r in counts.groupBy("i").agg(F.min(F.struct("minus_n", "v")).alias("best")).collect()}
    return [found.get(i) for i in range(len(columns))]


def columns_with_gaps(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns that miss a value somewhere: one aggregate, one flag per column."""
    if not columns:
        return []
    flags = df.agg(*[F.bool_or(is_missing(df, c)).alias(f"f{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if flags[i]]


def impute(df: DataFrame, numeric: str = "mean", text: str = "mode", row_id: str | None = None) -> DataFrame:
    """Fill missing values by column kind, or drop the rows that still miss one.

    Columns without a gap are left as they are. ``drop`` for either kind drops every row with a missing value after the
    other kind was filled. Forward fill follows ``row_id``.
    """
    if numeric not in NUMERIC_STRATEGIES:
        raise ValueError(f"Unknown numeric strategy '{numeric}'; choose one of {NUMERIC_STRATEGIES}.")
    if text not in TEXT_STRATEGIES:
        raise ValueError(f"Unknown text strategy '{text}'; choose one of {TEXT_STRATEGIES}.")
    gaps = columns_with_gaps(df, [c for c in [*numeric_columns(df), *string_columns(df)] if c != row_id])
    numbers = [c for c in numeric_columns(df) if c in gaps]
    texts = [c for c in string_columns(df) if c in gaps]
    filled_forward = (numbers if numeric == "ffill" else []) + (texts if text == "ffill" else [])
    if filled_forward and row_id is None:
        raise ValueError("'ffill' needs a row_id column that states the row order.")

    fills: dict[str, object] = {}
    if numeric == "mean" and numbers:
        fills |= dict(zip(numbers, df.agg(*[F.avg(as_double(df, c)) for c in numbers]).first()))
    elif numeric == "median" and numbers:
        fills |= {c: values[0] for c, (_, values) in column_quantiles(df, numbers, [0.5]).items()}
    elif numeric == "mode":
        fills |= {c: 0 if m is None else m for c, m in zip(numbers, modes(df, numbers))}
    if text == "mode":
        fills |= {c: "Unknown" if m is None else m for c, m in zip(texts, modes(df, texts))}

    def filled(c: str) -> Column:
        if fills.get(c) is None:
            return col(c)
        if c in texts:
            return F.coalesce(col(c), F.lit(fills[c])).alias(c)
        # A fractional fill turns a whole-number column into doubles.
        value = as_double(df, c) if isinstance(fills[c], float) else F.when(~is_missing(df, c), col(c))
        return F.coalesce(value, F.lit(fills[c])).alias(c)

    out = df.select(*[filled(c) for c in df.columns])
    if filled_forward:
        out = carry_forward(out, filled_forward, row_id)
    if "drop" in (numeric, text):
        out = drop_missing(out)
    return out


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows without a missing value in the given columns (default all)."""
    require_columns(df, *(subset or []))
    return df.na.drop(subset=list(subset) if subset else None)


def outlier_bounds(df: DataFrame, column: str, method: str = "iqr") -> tuple[float | None, float | None]:
    """The lower and upper bound; ``None`` where the column holds no value."""
    require_numeric(df, column)
    if method == "iqr":
        found = column_quantiles(df, [column], [0.25, 0.75]).get(column)
        if found is None:
            return None, None
        (q1, q3) = found[1]
        return q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    if method == "zscore":
        x = as_double(df, column)
        mean, deviation = df.agg(F.avg(x), F.stddev_samp(x)).first()
        if deviation is None:
            return None, None
        return mean - 3 * deviation, mean + 3 * deviation
    raise ValueError("Method must be 'iqr' or 'zscore'.")


def _outside(df: DataFrame, column: str, bounds: tuple[float | None, float | None]) -> Column:
    """Whether a value is an outlier; a missing value never is."""
    if bounds[0] is None:
        return F.lit(False)
    x = as_double(df, column)
    return F.coalesce((x < F.lit(bounds[0])) | (x > F.lit(bounds[1])), F.lit(False))


def flag_outliers(df: DataFrame, column: str, method: str = "iqr", flag: str = "is_outlier") -> DataFrame:
    """Every row with an outlier flag."""
    return df.withColumn(flag, _outside(df, column, outlier_bounds(df, column, method)))


def outlier_summary(df: DataFrame, column: str, method: str = "iqr") -> DataFrame:
    """Count, percentage of all rows and bounds."""
    bounds = outlier_bounds(df, column, method)
    hits = F.count_if(_outside(df, column, bounds))
    return df.agg(
        hits.alias("outlier_count"),
        F.coalesce(F.round(F.try_divide(hits * 100.0, F.count(F.lit(1))), 2), F.lit(0.0)).alias("outlier_percentage"),
    ).withColumns(
        {name: F.lit(b).cast("double") for name, b in zip(("lower_bound", "upper_bound"), bounds)}
    )


def outlier_preview(df: DataFrame, column: str, row_id: str, method: str = "iqr", limit: int = 100) -> DataFrame:
    """The first outliers in row order."""
    require_columns(df, row_id)
    found = df.where(_outside(df, column, outlier_bounds(df, column, method)))
    return found.select(quoted(row_id), quoted(column)).orderBy(col(row_id)).limit(limit)


def remove_outliers(df: DataFrame, column: str, method: str = "iqr") -> DataFrame:
    """All rows but the outliers; rows with a missing value stay."""
    return df.where(~_outside(df, column, outlier_bounds(df, column, method)))


def label_classes(df: DataFrame, column: str) -> DataFrame:
    """The classes of a column in text order with their code and row count."""
    require_columns(df, column)
    labels = df.select(as_label(column).alias("level"))
    levels = labels.groupBy("level").agg(F.count(F.lit(1)).alias("rows"))
    coded = running_sums(levels, Order(("level",)), {"code": F.lit(1).cast("long")}, source=labels)
    return coded.withColumn("code", F.col("code") - 1)


def label_encode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace each column by the code of its text form; missing is the class ``nan``."""
    require_columns(df, *columns)
    if not columns:
        return df
    distinct = df.agg(*[F.approx_count_distinct(as_label(c)).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    out = df
    for i, c in enumerate(columns):
        table = label_classes(df, c).withColumnsRenamed({"code": "__code", "level": "__level"})
        coded = look_up(out.withColumn("__level", as_label(c)), table, "__level", "rows", distinct[i])
        out = coded.select(*[F.col("__code").alias(c) if n == c else col(n) for n in df.columns])
    return out


def one_hot(df: DataFrame, columns: Sequence[str], max_levels: int | None = None) -> DataFrame:
    """One boolean column ``<column>_<level>`` per sorted level; missing is all false."""
    require_columns(df, *columns)
    kept = [col(c) for c in df.columns if c not in columns]
    made = []
    for c in columns:
        for level in column_levels(df, c, max_levels):
            hit = F.coalesce(col(c) == F.lit(level), F.lit(False))
            made.append(hit.alias(f"{c}_{level}"))
    return df.select(*kept, *made)


def one_hot_sparse(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """C10 for any number of levels: the table with ``positions`` in place of the columns, and the dictionary of positions.

    A level is a position (0, 1, …, columns in turn, levels in order) instead of a
    column of its own; ``positions`` lists those that are true in a row, and the
    dictionary, itself a table of ``position, column, level``, names them. Missing
    is no position. Levels stay on the executors throughout: the driver learns
    their number per column.
    """
    require_columns(df, *columns)
    place = {c: fresh_name(df.columns, f"__position{i}") for i, c in enumerate(columns)}
    out, parts, start = df, [], 0
    for c in columns:
        present = df.where(~is_missing(df, c))
        levels = settle(label_classes(present, c))
        many = levels.count()
        numbered = levels.withColumn("position", F.col("code") + F.lit(start))
        parts.append(numbered.select("position", F.lit(c).alias("column"), "level"))
        level = fresh_name(out.columns, "__level")
        keyed = out.withColumn(level, F.when(~is_missing(df, c), col(c).cast("string")))
        table = numbered.select(F.col("level").alias(level), F.col("position").alias(place[c]), "rows")
        out = look_up(keyed, table, level, "rows", many).drop(level)
        start += many
    kept = [col(c) for c in df.columns if c not in columns]
    found = out.select(*kept, F.array_compact(F.array(*[F.col(p) for p in place.values()])).alias("positions"))
    return found, functools.reduce(DataFrame.unionByName, parts)


def scale(df: DataFrame, columns: Sequence[str] | None = None, method: str = "standard") -> DataFrame:
    """Standard scores (population deviation) or the range mapped to [0, 1]."""
    if method not in ("standard", "minmax"):
        raise ValueError("Method must be 'standard' or 'minmax'.")
    columns = list(columns) if columns is not None else numeric_columns(df)
    require_numeric(df, *columns)
    if not columns:
        return df
    row = df.agg(*_scale_parameters(df, columns, method)).first()
    scaled = {}
    for i, c in enumerate(columns):
        centre, width = row[2 * i], row[2 * i + 1]
        if centre is not None:
            scaled[c] = (as_double(df, c) - F.lit(centre)) / F.lit(width if width else 1.0)
    return df.select(*[scaled[c].alias(c) if c in scaled else col(c) for c in df.columns])


def _scale_parameters(df: DataFrame, columns: Sequence[str], method: str) -> list[Column]:
    """Centre and width per column, in turn."""
    out = []
    for c in columns:
        x = as_double(df, c)
        out += [F.avg(x), F.stddev_pop(x)] if method == "standard" else [F.min(x), F.max(x) - F.min(x)]
    return out


def scaling_info(df: DataFrame, columns: Sequence[str] | None = None, method: str = "standard") -> DataFrame:
    """The fitted parameters behind :func:`scale`, one row per column."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    require_numeric(df, *columns)
    entries = []
    for c in columns:
        x = as_double(df, c)
        if method == "standard":
            pair = [F.avg(x).alias("mean"), F.stddev_pop(x).alias("std")]
        elif method == "minmax":
            pair = [F.min(x).alias("min"), F.max(x).alias("max")]
        else:
            raise ValueError("Method must be 'standard' or 'minmax'.")
        entries.append(F.struct(F.lit(c).alias("column"), *pair))
    return df.agg(F.array(*entries).alias("e")).select(F.inline("e"))


def before_after_shape(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row and column counts of two versions of a table."""
    def shape(df: DataFrame, tag: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(f"{tag}_rows"), F.lit(len(df.columns)).alias(f"{tag}_columns"))

    return shape(before, "original").crossJoin(F.broadcast(shape(after, "new")))
