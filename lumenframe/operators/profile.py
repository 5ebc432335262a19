"""Profiling: shape, missing values, column statistics, roles and duplicates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.temporal import looks_like_date, parse_time
from ..schema import (
    as_double,
    col,
    dtype,
    is_missing,
    is_numeric,
    is_string,
    is_temporal,
    numeric_columns,
    quoted,
    require_columns,
    string_columns,
)
from ..session import settle
from .ordering import BROADCAST_BYTES, Order, quantiles, row_positions, table_bytes
from .stats import correlation_pairs

HIGH_CORRELATION = 0.7
PREVIEW = 100
MATRIX_ROWS = 2000

# Fixed value: column names that read like identifiers (case is ignored).
ID_NAME = r"(^|[_\s])(id|uuid|key|code)s?$"

# Longer texts are compared by digest, so that a distinct count does not
# shuffle whole documents.
_DIGEST_ABOVE = 64


def compact(df: DataFrame, column: str) -> Column:
    """A value that is equal exactly where the column is equal, and never long."""
    if not is_string(dtype(df, column)):
        return F.when(~is_missing(df, column), col(column))
    value = col(column)
    return F.when(F.length(value) > _DIGEST_ABOVE, F.concat(F.lit("sha:"), F.sha2(value, 256))).otherwise(value)


def _stacked_row(df: DataFrame, columns: Sequence[str], fields: dict[str, list[Column]]) -> DataFrame:
    """One wide aggregate turned into one row per column."""
    flat = [e.alias(f"{name}_{i}") for name, es in fields.items() for i, e in enumerate(es)]
    entries = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"{name}_{i}").alias(name) for name in fields])
        for i, c in enumerate(columns)
    ]
    return df.agg(*flat).select(F.inline(F.array(*entries)))


def dataset_info(df: DataFrame) -> DataFrame:
    """One row per column with its type, missing count and the row count."""
    columns = df.columns
    types = dict(df.dtypes)
    return _stacked_row(
        df,
        columns,
        {
            "dtype": [F.max(F.lit(types[c])) for c in columns],
            "missing": [F.count_if(is_missing(df, c)) for c in columns],
            "rows": [F.count(F.lit(1)) for _ in columns],
        },
    ).withColumn("dtype", F.coalesce("dtype", F.lit("")))


def describe(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Count, mean, std, min, quartiles and max per numeric column."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    if not columns:
        raise ValueError("No numeric columns found.")
    x = {c: as_double(df, c) for c in columns}
    moments = _stacked_row(
        df,
        columns,
        {
            "count": [F.count(x[c]) for c in columns],
            "mean": [F.avg(x[c]) for c in columns],
            "std": [F.stddev_samp(x[c]) for c in columns],
            "min": [F.min(x[c]) for c in columns],
            "max": [F.max(x[c]) for c in columns],
        },
    )
    quartiles = quantiles(df, columns, [0.25, 0.5, 0.75], names=["p25", "p50", "p75"], exact=exact)
    return moments.join(F.broadcast(quartiles.drop("n")), "column", "left").select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def describe_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct count, most frequent value (smallest on ties) and its frequency."""
    columns = list(columns) if columns is not None else string_columns(df)
    if not columns:
        raise ValueError("No text columns found.")
    # Only digests are counted and shuffled; short texts stand for themselves.
    texts = {c: col(c).cast("string") for c in columns}
    key = {c: F.when(F.octet_length(v) <= _DIGEST_ABOVE, v).otherwise(F.concat(F.lit("#"), F.sha2(v, 256))) for c, v in texts.items()}
    entries = [F.struct(F.lit(c).alias("column"), k.alias("k")) for c, k in key.items()]
    counts = settle(df.select(F.inline(F.array(*entries))).where("k is not null").groupBy("column", "k").agg(F.count(F.lit(1)).alias("n")))
    most = counts.groupBy("column").agg(F.count(F.lit(1)).alias("levels"), F.max("n").alias("n"))
    found = {r["column"]: (r["levels"], r["n"]) for r in most.collect()}
    # Of equally frequent texts the smallest counts. Where all texts differ, that is the smallest of all; elsewhere the
    # texts of the most frequent digests are fetched.
    best: dict[str, str] = {}
    alone = [c for c, (_, n) in found.items() if n == 1]
    if alone:
        best |= zip(alone, df.agg(*[F.min(texts[c]).alias(c) for c in alone]).first())
    common = [c for c in found if c not in alone]
    if common:
        of = F.coalesce(*[F.when(F.col("column") == c, F.lit(found[c][1])) for c in common])
        top = settle(counts.where(F.col("n") == of).select("column", "k"))
        pairs = [F.struct(F.lit(c).alias("column"), key[c].alias("k"), texts[c].alias("v")) for c in common]
        rows = df.select(F.inline(F.array(*pairs))).join(
            F.broadcast(top) if table_bytes(top) <= BROADCAST_BYTES else top, ["column", "k"], "left_semi")
        best |= {r["column"]: r["v"] for r in rows.groupBy("column").agg(F.min("v").alias("v")).collect()}
    # A row for every column, also when the table is empty.
    rows = [(c, found[c][0] if c in found else 0, best.get(c), found[c][1] if c in found else 0) for c in columns]
    return df.sparkSession.createDataFrame(rows, "column string, unique_count long, most_frequent string, frequency long")


def missing_summary(df: DataFrame) -> DataFrame:
    """Missing cells and their share of all cells."""
    total = F.lit(0).cast("long")
    for c in df.columns:
        total = total + F.count_if(is_missing(df, c))
    cells = F.count(F.lit(1)) * len(df.columns)
    return df.agg(
        total.alias("total_missing"),
        F.coalesce(F.round(F.try_divide(total * 100.0, cells), 2), F.lit(0.0)).alias("missing_percentage"),
    )


def high_correlations(df: DataFrame, threshold: float = HIGH_CORRELATION) -> DataFrame:
    """P5: numeric column pairs with ``|r|`` above the threshold."""
    pairs = correlation_pairs(df, numeric_columns(df))
    return pairs.where(F.abs("r") > threshold).select(
        F.col("x").alias("feature1"), F.col("y").alias("feature2"), F.round("r", 3).alias("correlation")
    )


@dataclass(frozen=True)
class Profile:
    """The parts of a table profile, each a lazy table; parts without columns are ``None``."""

    info: DataFrame
    size: DataFrame
    missing: DataFrame
    numeric: DataFrame | None
    text: DataFrame | None
    high_correlations: DataFrame | None


def profile(df: DataFrame, exact: bool = True) -> Profile:
    """P2–P5 and P12 together."""
    numbers, texts = numeric_columns(df), string_columns(df)
    return Profile(
        dataset_info(df), data_size(df), missing_summary(df),
        describe(df, numbers, exact) if numbers else None,
        describe_text(df, texts) if texts else None,
        high_correlations(df) if len(numbers) > 1 else None,
    )


def column_roles(df: DataFrame, exact: bool = True) -> DataFrame:
    """Role, distinct count and missing percentage of every column.

    The rules run in the order empty, constant, datetime, categorical (boolean),
    then numbers (id, discrete, numeric), then text (datetime, id, text,
    categorical, high_cardinality). Date-likeness is judged on all rows.
    """
    columns = df.columns
    counted = _level_counts(df) if exact else _estimated_levels(df)
    entries = []
    for i, c in enumerate(columns):
        role = _role(df, c, F.col("n"), F.col("levels"), F.col("present"), "shaped", "parsed")
        entries.append(F.when(F.col("i") == i, F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), role.alias("role"))))
    share = F.coalesce(F.round(F.try_divide((F.col("n") - F.col("present")) * 100.0, F.col("n")), 2), F.lit(0.0))
    # A row for every column, also when the table is empty.
    listed = F.broadcast(df.sparkSession.createDataFrame([(i,) for i in range(len(columns))], "i int"))
    zero = ["n", "present", "levels", "shaped", "parsed"]
    return listed.join(counted, "i", "left").na.fill(0, zero).select(
        F.coalesce(*entries).alias("r"), F.col("levels").alias("nunique"), share.alias("missing_pct")
    ).select("r.*", "nunique", "missing_pct")


def _level_counts(df: DataFrame) -> DataFrame:
    """Per column ``i``: rows, present values, exact distinct values, and how many are shaped like and parse as dates.

    One pass turns the table into rows (column, value) and counts each value;
    dates are tried on the distinct values of text columns only. Numbers and
    times are compared as integers where they are, long texts by digest.
    """
    entries = []
    for i, c in enumerate(df.columns):
        number, text = F.lit(None).cast("long"), F.lit(None).cast("string")
        kind, present = dtype(df, c), ~is_missing(df, c)
        if _is_nested(kind):
            text = F.lit("")
        elif isinstance(kind, (T.IntegralType, T.BooleanType)):
            number = col(c).cast("long")
        elif isinstance(kind, T.TimestampType):
            number = F.unix_micros(col(c))
        elif isinstance(kind, T.TimestampNTZType):
            number = F.unix_micros(col(c).cast("timestamp"))
        elif isinstance(kind, T.DateType):
            number = F.unix_date(col(c)).cast("long")
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            text = (col(c) + F.lit(0.0)).cast("string")
        else:
            text = compact(df, c).cast("string")
        entries.append(F.struct(F.lit(i).alias("i"), F.when(present, number).alias("number"), F.when(present, text).alias("text")))
    values = df.select(F.inline(F.array(*entries))).groupBy("i", "number", "text").agg(F.count(F.lit(1)).alias("times"))
    present = F.col("number").isNotNull() | F.col("text").isNotNull()
    texts = [i for i, c in enumerate(df.columns) if is_string(dtype(df, c))]
    # Only texts that look like dates are parsed.
    shaped = F.when(F.col("i").isin(texts) & looks_like_date(F.col("text")), F.col("text")) if texts else F.lit(None).cast("string")
    values = values.withColumn("shaped", shaped)
    nested = [i for i, c in enumerate(df.columns) if _is_nested(dtype(df, c))]
    times = F.col("times")
    counted = values.groupBy("i").agg(
        F.sum(times).alias("n"), F.coalesce(F.sum(F.when(present, times)), F.lit(0)).alias("present"), F.count_if(present).alias("levels"),
        F.coalesce(F.sum(F.when(F.col("shaped").isNotNull(), times)), F.lit(0)).alias("shaped"),
        F.coalesce(F.sum(F.when(parse_time(F.col("shaped")).isNotNull(), times)), F.lit(0)).alias("parsed"))
    # Nested values are not compared: each counts as a level of its own.
    return counted.withColumn("levels", F.when(F.col("i").isin(nested), F.col("present")).otherwise(F.col("levels"))) if nested else counted


def _estimated_levels(df: DataFrame) -> DataFrame:
    """The same with sketched distinct counts."""
    columns = df.columns
    text = [c for c in columns if is_string(dtype(df, c))]
    fields = {
        "n": [F.count(F.lit(1)) for _ in columns],
        "present": [F.count_if(~is_missing(df, c)) for c in columns],
        "levels": [F.count_if(~is_missing(df, c)) if _is_nested(dtype(df, c)) else F.approx_count_distinct(compact(df, c)) for c in columns],
        "shaped": [F.count_if(looks_like_date(col(c))) if c in text else F.lit(0).cast("long") for c in columns],
        "parsed": [F.count(parse_time(col(c))) if c in text else F.lit(0).cast("long") for c in columns],
    }
    # Columns by number, as names may repeat those of the fields.
    place = F.array_position(F.array(*map(F.lit, columns)), F.col("column")) - 1
    return _stacked_row(df, columns, fields).select(place.cast("int").alias("i"), *fields)


def _is_nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))


def _role(df: DataFrame, column: str, n: Column, unique: Column, present: Column, shaped: str, parsed: str) -> Column:
    kind = dtype(df, column)
    share = F.try_divide(unique.cast("double"), n)
    first = F.when((n == 0) | (unique == 0), "empty").when(unique == 1, "constant")
    if is_temporal(kind):
        return first.otherwise("datetime")
    if isinstance(kind, T.BooleanType):
        return first.otherwise("categorical")
    if is_numeric(kind):
        named_id = F.lit(column).rlike("(?i)" + ID_NAME)
        return first.when(named_id & (share > 0.9), "id").when(unique <= 15, "discrete").otherwise("numeric")
    out = first
    if is_string(kind):
        dated = (F.col(shaped) >= present * 0.9) & (F.col(parsed) >= present * 0.9)
        out = out.when(dated, "datetime")
    return (
        out.when(share >= 0.95, "id").when(share >= 0.5, "text")
        .when(unique <= 50, "categorical").otherwise("high_cardinality")
    )


def type_buckets(df: DataFrame, exact: bool = True) -> DataFrame:
    """Which list each column belongs to, beside its role."""
    numbers, texts = numeric_columns(df), string_columns(df)
    roles = column_roles(df, exact)
    is_text = F.col("column").isin(texts) if texts else F.lit(False)
    is_number = F.col("column").isin(numbers) if numbers else F.lit(False)
    times = [c for c in df.columns if is_temporal(dtype(df, c))]
    is_time = (F.col("role") == "datetime") | (F.col("column").isin(times) if times else F.lit(False))
    bucket = (
        F.when(is_time, "datetime")
        .when(is_number, "numeric")
        .when(is_text & F.col("role").isin("categorical", "high_cardinality", "constant"), "categorical")
        .when(is_text & F.col("role").isin("text", "id"), "text")
        .otherwise("other")
    )
    return roles.select("column", "role", bucket.alias("bucket"))


def _duplicate_key(df: DataFrame, subset: Sequence[str]) -> list[Column]:
    return [compact(df, c).alias(f"__k{i}") for i, c in enumerate(subset)]


def duplicate_summary(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier row, in number and percent."""
    subset = list(subset or df.columns)
    require_columns(df, *subset)
    groups = df.groupBy(*_duplicate_key(df, subset)).agg(F.count(F.lit(1)).alias("__n"))
    extra = F.coalesce(F.sum(F.col("__n") - 1), F.lit(0))
    rows = F.coalesce(F.sum("__n"), F.lit(0))
    return groups.agg(
        extra.alias("duplicate_count"),
        F.coalesce(F.round(F.try_divide(extra * 100.0, rows), 2), F.lit(0.0)).alias("duplicate_percentage"),
        rows.alias("total_rows"),
    )


def duplicate_rows(df: DataFrame, row_id: str, subset: Sequence[str] | None = None) -> DataFrame:
    """The rows that equal an earlier row, by ``row_id``.

    Only the first row id of each group is aggregated, and the rest is an anti
    join on the unique ids, so a huge group of copies never meets in one task.
    """
    subset = list(subset or [c for c in df.columns if c != row_id])
    require_columns(df, *subset, row_id)
    named = df.agg(F.count(F.lit(1)).alias("rows"), F.count(col(row_id)).alias("ids")).first()
    if named["rows"] != named["ids"]:
        raise ValueError(f"'{row_id}' must name every row, but {named['rows'] - named['ids']} rows have none.")
    firsts = df.groupBy(*_duplicate_key(df, subset)).agg(F.min(col(row_id)).alias("__first")).select("__first")
    return df.join(firsts, col(row_id) == F.col("__first"), "left_anti")


def duplicate_preview(df: DataFrame, row_id: str, subset: Sequence[str] | None = None, limit: int = PREVIEW) -> DataFrame:
    """The ids of the first duplicates in row order."""
    return duplicate_rows(df, row_id, subset).select(quoted(row_id)).orderBy(col(row_id)).limit(limit)


def missingness(df: DataFrame, max_columns: int = 30) -> DataFrame:
    """Columns with missing values, worst first."""
    info = dataset_info(df).where(F.col("missing") > 0)
    all_columns = F.count(F.lit(1)).over(Window.partitionBy())
    # One row per column of the table, so the window below is small.
    return (
        info.withColumn("columns_with_missing", all_columns)
        .select(
            "column",
            F.round(F.col("missing") * 100.0 / F.col("rows"), 2).alias("missing_pct"),
            F.col("rows").alias("total_rows"),
            "columns_with_missing",
            (F.col("missing") / F.col("rows")).alias("__share"),
        )
        .orderBy(F.desc("__share"), "column")
        .limit(max_columns)
        .drop("__share")
    )


def missingness_matrix(df: DataFrame, row_id: str, columns: Sequence[str] | None = None,
                       rows: int = MATRIX_ROWS) -> DataFrame:
    """P10: 0/1 flags of missing cells in row order, thinned evenly to ``rows`` rows."""
    columns = list(columns or [c for c in df.columns if c != row_id])
    require_columns(df, *columns, row_id)
    flags = df.select(quoted(row_id), *[is_missing(df, c).cast("int").alias(c) for c in columns])
    placed = row_positions(flags, Order((row_id,)), "position", total="__n")
    # Position p is kept when some step k lands on it: floor(k (n - 1) / (rows - 1)) = p.
    last, steps = F.col("__n") - 1, F.lit(rows - 1)
    place = F.col("position") - 1
    step = F.ceil(place * steps / last)
    landing = F.floor(step * last / steps)
    kept = (F.col("__n") <= rows) | ((step <= steps) & (landing == place))
    return placed.where(kept).select((F.col("position") - 1).alias("position"), *map(quoted, columns))


def data_size(df: DataFrame) -> DataFrame:
    """Bytes of the values: text by length, other types by their fixed width."""
    width = {T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}
    parts = []
    for c in df.columns:
        kind = dtype(df, c)
        if isinstance(kind, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.sum(F.octet_length(col(c))), F.lit(0)))
        elif isinstance(kind, T.ArrayType):
            parts.append(F.coalesce(F.sum(F.size(col(c)) * width.get(type(kind.elementType), 8)), F.lit(0)))
        else:
            parts.append(F.count(col(c)) * width.get(type(kind), 8))
    total = sum(parts[1:], parts[0])
    return df.agg(total.alias("bytes"), F.round(total / F.lit(1024.0**2), 2).alias("megabytes"))
