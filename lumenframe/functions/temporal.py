"""Date parsing, calendar parts and time buckets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import col, dtype, is_missing, is_string, is_temporal

# The text shapes that count as date-like.
DATE_HINT = r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}|\d{4}[-/]\d{1,2}\b|\d{1,2}:\d{2}"

# Tried in order; the first that fits wins.
DATE_FORMATS = (
    "yyyy/M/d", "yyyy/M/d H:m", "yyyy/M/d H:m:s",
    "yyyy.M.d", "yyyy.M.d H:m", "yyyy.M.d H:m:s",
    "M/d/yyyy", "M/d/yyyy H:m", "M/d/yyyy H:m:s",
    "M-d-yyyy", "d-M-yyyy", "d/M/yyyy", "d.M.yyyy", "yyyy-M", "yyyy/M",
)
# No supported date text is longer; longer values cannot parse.
_LONGEST_DATE = 40


def parse_time(text: Column) -> Column:
    """The text as a timestamp, or null where no known form fits."""
    trimmed = F.trim(text)
    short = F.when((F.length(trimmed) <= _LONGEST_DATE) & trimmed.rlike(DATE_HINT), trimmed)
    return F.coalesce(short.try_cast("timestamp"), *[F.try_to_timestamp(short, F.lit(f)) for f in DATE_FORMATS])


def looks_like_date(text: Column) -> Column:
    return F.coalesce((F.length(text) <= _LONGEST_DATE) & text.rlike(DATE_HINT), F.lit(False))


def date_likeness(df: DataFrame, column: str) -> DataFrame:
    """Shares of the non-missing values that look like, and parse as, dates.

    All rows are read rather than the first hundred.
    """
    text = F.when(~is_missing(df, column), col(column).cast("string"))
    n = F.count(text)
    return df.agg(
        n.alias("n"),
        F.try_divide(F.count_if(looks_like_date(text)), n).alias("date_shaped"),
        F.try_divide(F.count(parse_time(text)), n).alias("parsed"),
    ).withColumn(
        "is_datetime", F.coalesce((F.col("date_shaped") >= 0.9) & (F.col("parsed") >= 0.9), F.lit(False))
    )


def as_time_axis(df: DataFrame, column: str) -> DataFrame:
    """Turn a text column into timestamps when over 90 % of all rows parse."""
    if not is_string(dtype(df, column)):
        return df
    parsed = parse_time(col(column))
    share = df.agg(F.try_divide(F.count(parsed), F.count(F.lit(1)))).first()[0]
    return df.withColumn(column, parsed) if share is not None and share > 0.9 else df


PARTS = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "hour": F.hour,
    "minute": F.minute,
    "second": F.second,
    "dayofweek": F.weekday,
    "quarter": F.quarter,
    "is_weekend": lambda t: F.coalesce((F.weekday(t) >= 5).cast("int"), F.lit(0)),
}
DEFAULT_PARTS = ("year", "month", "day", "dayofweek")

# --- Time buckets: an integer index per row, and a label per index ------------

_TICK_SECONDS = {"s": 1, "min": 60, "h": 3600, "D": 86400}
_ALIASES = {"S": "s", "T": "min", "H": "h", "M": "ME", "Q": "QE", "Y": "YE", "A": "YE", "W-SUN": "W"}
_CALENDAR = ("W", "ME", "MS", "QE", "QS", "YE", "YS")
_FREQUENCY = re.compile(r"^(\d*)([A-Za-z-]+)$")


def frequency(text: str) -> tuple[int, str]:
    """Multiple and unit of a frequency such as ``D``, ``W``, ``ME``, ``15min``."""
    match = _FREQUENCY.match(text.strip())
    unit = match and _ALIASES.get(match.group(2), match.group(2))
    if not match or (unit not in _TICK_SECONDS and unit not in _CALENDAR):
        raise ValueError(f"Unknown frequency '{text}'.")
    many = int(match.group(1) or 1)
    if many < 1:
        raise ValueError(f"Unsupported frequency '{text}': the multiple must be at least 1.")
    return many, unit


def bucket_index(time: Column, freq: str, origin: Column | None = None) -> Column:
    """The number of the bucket that holds ``time``.

    Multiples count from ``origin``, midnight of the first day. Buckets named by
    their last day (W, ME, QE, YE) end with the first period, so the first one
    holds that period alone; the others start with it.
    """
    many, unit = frequency(freq)
    if unit in _TICK_SECONDS:
        seconds = F.unix_seconds(time.cast("timestamp"))
        start = F.unix_seconds(origin.cast("timestamp")) if origin is not None else F.lit(0).cast("long")
        return F.floor((seconds - start) / F.lit(many * _TICK_SECONDS[unit])).cast("long")
    if many > 1:
        steps = (_period(time, unit) - _period(origin, unit)) / F.lit(many)
        return (F.floor(steps) if unit.endswith("S") else F.ceil(steps)).cast("long")
    return _period(time, unit)


def _period(time: Column, unit: str) -> Column:
    """The number of the calendar week, month, quarter or year."""
    months = F.year(time).cast("long") * 12 + F.month(time) - 1
    if unit == "W":
        # Weeks run Monday to Sunday; 1970-01-01 was a Thursday.
        return F.floor((F.unix_date(time.cast("date")) + 3) / F.lit(7)).cast("long")
    if unit in ("ME", "MS"):
        return months
    if unit in ("QE", "QS"):
        return F.floor(months / F.lit(3)).cast("long")
    return F.year(time).cast("long")


def bucket_label(index: Column, freq: str, origin: Column | None = None) -> Column:
    """The timestamp that names a bucket: its start, or its last day for W, ME, QE, YE."""
    many, unit = frequency(freq)
    if unit in _TICK_SECONDS:
        start = F.unix_seconds(origin.cast("timestamp")) if origin is not None else F.lit(0).cast("long")
        return F.timestamp_seconds(index * F.lit(many * _TICK_SECONDS[unit]) + start)
    if many > 1:
        index = _period(origin, unit) + index * many
    if unit == "W":
        return F.date_from_unix_date((index * 7 + 3).cast("int")).cast("timestamp")
    width = {"M": 1, "Q": 3, "Y": 12}[unit[0]]
    first = index * width + (width - 1 if unit[1] == "E" else 0)
    month = F.make_date(F.floor(first / F.lit(12)).cast("int"), (F.pmod(first, F.lit(12)) + 1).cast("int"), F.lit(1))
    return (F.last_day(month) if unit[1] == "E" else month).cast("timestamp")


def needs_origin(freq: str) -> bool:
    """Whether buckets depend on the first day: steps that do not divide a day, and multiples of calendar units."""
    many, unit = frequency(freq)
    return 86400 % (many * _TICK_SECONDS[unit]) != 0 if unit in _TICK_SECONDS else many > 1


def is_time(df: DataFrame, column: str) -> bool:
    return is_temporal(dtype(df, column))

