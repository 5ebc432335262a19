"""Derived columns: expressions, polynomials and calendar parts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expressions import arithmetic
from ..functions.temporal import DEFAULT_PARTS, PARTS, is_time, parse_time
from ..schema import as_double, col, quoted, require_columns, require_numeric


def derive(df: DataFrame, expression: str, name: str) -> DataFrame:
    """a new column from an arithmetic expression over columns."""
    return df.withColumn(name, arithmetic(df, expression))


def polynomial(df: DataFrame, columns: Sequence[str], degree: int = 2, interaction_only: bool = False) -> DataFrame:
    """products of the columns up to ``degree``, named like ``a^2`` and ``a b``.

    Columns that already exist are not made again. A missing input is an error.
    """
    require_numeric(df, *columns)
    if degree < 1:
        raise ValueError("degree must be at least 1.")
    pick = combinations if interaction_only else combinations_with_replacement
    made: dict[str, Column] = {}
    for power in range(1, degree + 1):
        for term in pick(columns, power):
            counts = Counter(term)
            name = " ".join(c if k == 1 else f"{c}^{k}" for c, k in counts.items())
            if name in df.columns:
                continue
            product = F.lit(1.0)
            for c in term:
                product = product * _present(df, c)
            made[name] = product
    return df.withColumns(made) if made else df


def _present(df: DataFrame, column: str) -> Column:
    value = as_double(df, column)
    failure = F.raise_error(F.lit(f"Polynomial features need a value in every row of '{column}'."))
    return F.when(value.isNull(), failure.cast("double")).otherwise(value)


def datetime_parts(df: DataFrame, column: str, parts: Sequence[str] = DEFAULT_PARTS) -> DataFrame:
    """calendar parts as ``<column>_<part>``; the source column becomes a time.

    A text value that is not a date is an error.
    """
    require_columns(df, column)
    unknown = [p for p in parts if p not in PARTS]
    if unknown:
        raise ValueError(f"Unsupported datetime feature: {unknown}")
    out = df
    if not is_time(df, column):
        text = col(column).cast("string")
        parsed = parse_time(text)
        failure = F.raise_error(F.concat(F.lit("Not a date: "), text)).cast("timestamp")
        out = df.withColumn(column, F.when(text.isNotNull() & parsed.isNull(), failure).otherwise(parsed))
    return out.withColumns({f"{column}_{p}": PARTS[p](col(column)) for p in parts})


def preview(df: DataFrame, columns: Sequence[str], row_id: str, limit: int = 5) -> DataFrame:
    """the first rows of some columns in row order."""
    require_columns(df, *columns, row_id)
    return df.orderBy(col(row_id)).limit(limit).select(*map(quoted, {row_id: 0, **dict.fromkeys(columns)}))
