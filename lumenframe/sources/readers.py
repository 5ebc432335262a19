"""Reading and writing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..schema import col
from .csv_records import needs_records, records

# Texts that a CSV reader of data frames takes for a missing value.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
_TRUE, _FALSE = ("True", "TRUE", "true"), ("False", "FALSE", "false")
_INTEGER = r"^\s*[+-]?\d+\s*$"
_MALFORMED = "malformed"


def missing_as_null(df: DataFrame) -> DataFrame:
    """Turn NaN into null, the one notion of missing used everywhere."""
    def clean(field: T.StructField) -> Column:
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return F.nanvl(col(field.name), F.lit(None).cast(field.dataType)).alias(field.name)
        return col(field.name)

    if not any(isinstance(f.dataType, (T.DoubleType, T.FloatType)) for f in df.schema.fields):
        return df
    return df.select(*[clean(f) for f in df.schema.fields])


def read_parquet(spark: SparkSession, path: str, clean: bool = False) -> DataFrame:
    """A Parquet table; missing paths raise ``FileNotFoundError``.

    Every operator takes NaN for missing by itself, so the scan is left bare and
    filters reach the files; ``clean`` turns NaN into null at once.
    """
    table = _load(spark.read, path, "parquet")
    return missing_as_null(table) if clean else table


def _load(reader, path: str, kind: str) -> DataFrame:
    try:
        return reader.format(kind).load(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error.getCondition() or ""):
            raise FileNotFoundError(f"File not found: {path}") from error
        raise ValueError(f"Error loading {kind}: {error.getMessage()}") from error


def read_csv(spark: SparkSession, path: str, sep: str = ",", infer: bool = True, multi_line: bool = True) -> DataFrame:
    """A CSV file or folder with a header line and inferred column types.

    All columns are read as text, missing tokens become null, and one aggregate
    over the file decides per column between boolean, long, double and text.
    Dates stay text, as a data frame's reader leaves them. Rows with more or
    fewer fields than the header raise ``ValueError``.

    With ``multi_line`` quoted fields may hold line breaks; without it a quoted
    line break is an error. Large files are split either way. Only files in which
    a line holds a carriage return before its end are one task each.
    """
    options = dict(sep=sep, inferSchema=False, multiLine=multi_line, escape='"')
    raw = _load(spark.read.options(header=True, **options), path, "csv")
    if not raw.columns:
        raise ValueError(f"Error loading csv: no columns in {path}")
    names = _plain_names(raw.columns)
    places = [f"c{i}" for i in range(len(names))]
    fields = ", ".join(f"{c} string" for c in [*places, _MALFORMED])
    options["columnNameOfCorruptRecord"] = _MALFORMED
    kind, outcomes = needs_records(spark, path, sep) if multi_line else ("lines", None)
    if kind == "records":
        parsed = F.from_csv("record", fields, {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()})
        lines = records(spark, path, sep, outcomes).select(parsed.alias("fields")).select("fields.*")
    else:
        options["multiLine"] = kind == "whole"
        lines = _load(spark.read.options(header=True, **options).schema(fields), path, "csv")
    texts = lines.select(
        *[F.when(~F.col(c).isin(*NULL_TOKENS), F.col(c)).alias(c) for c in places], _MALFORMED
    )
    if not infer:
        # Malformed rows show only where every field is read.
        _require_whole_rows(texts.agg(F.count(_MALFORMED).alias("bad"), *[F.count(c) for c in places]).first()["bad"], path)
        return texts.drop(_MALFORMED).toDF(*names)
    checks = []
    for c in places:
        present = F.col(c).isNotNull()
        long = F.col(c).rlike(_INTEGER) & F.trim(c).try_cast("long").isNotNull()
        double = F.trim(c).try_cast("double").isNotNull()
        truth = F.col(c).isin(*_TRUE, *_FALSE)
        checks += [
            F.bool_or(present).alias(f"any_{c}"),
            F.bool_or(~present).alias(f"gap_{c}"),
            F.bool_and(F.when(present, long)).alias(f"long_{c}"),
            F.bool_and(F.when(present, double)).alias(f"double_{c}"),
            F.bool_and(F.when(present, truth)).alias(f"bool_{c}"),
        ]
    found = texts.agg(*checks, F.count(_MALFORMED).alias("bad")).first()
    _require_whole_rows(found["bad"], path)
    typed = []
    for c, name in zip(places, names):
        if not found[f"any_{c}"]:
            typed.append(F.col(c).cast("double").alias(name))
        elif found[f"bool_{c}"] and not found[f"gap_{c}"]:
            typed.append(F.col(c).isin(*_TRUE).alias(name))
        elif found[f"long_{c}"]:
            typed.append(F.trim(c).cast("long").alias(name))
        elif found[f"double_{c}"]:
            typed.append(F.trim(c).cast("double").alias(name))
        else:
            typed.append(F.col(c).alias(name))
    return texts.select(*typed)


def _require_whole_rows(bad: int, path: str) -> None:
    if bad:
        raise ValueError(f"Error loading csv: {bad} rows of {path} do not have the header's number of fields.")


def _plain_names(columns: Sequence[str]) -> list[str]:
    """Header names, repeated ones numbered ``a``, ``a.1``, ``a.2``.

    Spark marks a repeated header by adding its position; that mark is undone.
    """
    out: list[str] = []
    for i, name in enumerate(columns):
        base = name.removesuffix(str(i))
        twin = name != base and base and sum(
            other == f"{base}{j}" for j, other in enumerate(columns)
        ) > 1
        plain = base if twin else name
        number, label = 0, plain
        while label in out:
            number += 1
            label = f"{plain}.{number}"
        out.append(label)
    return out


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """S3: a folder of CSV parts with headers and without an index column."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> str:
    """S3: a folder of Parquet parts, optionally partitioned by columns."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return path
