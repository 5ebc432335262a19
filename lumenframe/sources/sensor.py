"""Whitespace-separated buoy observations as published by a weather service."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Published column order, the value from which a reading means
# "missing", and the names given to the readings.
LAYOUT = (
    "YY", "MM", "DD", "hh", "mm", "WDIR", "WSPD", "GST", "WVHT", "DPD", "APD", "MWD",
    "PRES", "ATMP", "WTMP", "DEWP", "VIS", "TIDE",
)
SENTINELS = {
    "WDIR": 999, "WSPD": 99, "GST": 99, "WVHT": 99, "DPD": 99, "APD": 99, "PRES": 9999, "ATMP": 999, "WTMP": 999,
}
READINGS = {
    "WDIR": "wind_dir", "WSPD": "wind_speed", "GST": "gust", "WVHT": "wave_height", "DPD": "dominant_period",
    "APD": "avg_period", "PRES": "pressure", "ATMP": "air_temp", "WTMP": "water_temp",
}


def parse_observations(lines: DataFrame, column: str = "value") -> DataFrame:
    """A time and nine readings per line; header and unit lines start with ``#``."""
    body = lines.where(~F.col(column).startswith("#") & (F.trim(column) != ""))
    part = F.split(F.trim(F.col(column)), r"\s+")
    parts = body.select(part.alias("p"))
    at = {name: F.get("p", F.lit(i)) for i, name in enumerate(LAYOUT)}
    time = F.make_timestamp(
        *[at[n].cast("int") for n in ("YY", "MM", "DD", "hh", "mm")], F.lit(0).cast("decimal(8,6)")
    )
    readings = []
    for name, limit in SENTINELS.items():
        value = at[name].try_cast("double")
        readings.append(F.when(value < limit, value).alias(READINGS[name]))
    return parts.select(time.alias("datetime"), *readings)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """S4 from files."""
    return parse_observations(spark.read.text(path))
