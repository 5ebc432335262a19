"""Schema checks and type-based column selection (no job is started here)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T


def quoted(name: str) -> str:
    """Back-quote a column name so that dots and spaces are taken literally."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def require_columns(df: DataFrame, *columns: str | None) -> None:
    """``ValueError`` for absent columns; ``None`` stands for an unused option."""
    absent = [c for c in columns if c is not None and c not in df.columns]
    if absent:
        raise ValueError(f"Column(s) not found: {absent}")


def dtype(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def is_temporal(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_string(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.StringType)


def require_numeric(df: DataFrame, *columns: str | None) -> None:
    """Numeric or boolean columns pass; everything else is a ``ValueError``."""
    require_columns(df, *columns)
    for c in columns:
        if c is None:
            continue
        if not (is_numeric(dtype(df, c)) or isinstance(dtype(df, c), T.BooleanType)):
            raise ValueError(f"Column '{c}' must be numeric.")


def numeric_columns(df: DataFrame) -> list[str]:
    """Numbers only; booleans are left out of default column lists."""
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_string(f.dataType)]


def as_double(df: DataFrame, column: str) -> Column:
    """The column as a double with NaN turned into null."""
    kind = dtype(df, column)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.nanvl(col(column).cast("double"), F.lit(None).cast("double"))
    return col(column).cast("double")


def is_missing(df: DataFrame, column: str) -> Column:
    """Null, or NaN in a floating-point column."""
    if isinstance(dtype(df, column), (T.DoubleType, T.FloatType)):
        return col(column).isNull() | F.isnan(col(column))
    return col(column).isNull()


def as_label(column: str) -> Column:
    """Text form of a value with missing shown as ``nan``."""
    return F.coalesce(col(column).cast("string"), F.lit("nan"))


def fresh_name(taken: Iterable[str], stem: str) -> str:
    """A column name starting with ``stem`` that is not in use yet."""
    taken = set(taken)
    name = stem
    while name in taken:
        name += "_"
    return name
