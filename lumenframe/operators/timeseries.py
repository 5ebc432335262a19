"""Lines, resampling, stacked areas and rolling aggregates over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.aggregates import grouped_aggregate
from ..functions.temporal import as_time_axis, bucket_index, bucket_label, frequency, is_time, needs_origin
from ..schema import as_double, col, quoted, require_columns, require_numeric
from .grouped import fold_rare
from .ordering import Order, row_positions, scatter, spread_range

ROLLING = ("mean", "sum", "min", "max", "std", "var", "count", "median", "skew", "kurt", "sem")
_CHUNK = 65536


def _bucketed(df: DataFrame, x: str, freq: str) -> tuple[DataFrame, Column | None]:
    """Add the bucket number; the origin column is given where the step needs one."""
    frequency(freq)
    present = df.where(col(x).isNotNull())
    if not needs_origin(freq):
        return present.withColumn("__bucket_no", bucket_index(col(x), freq)), None
    first = present.agg(F.date_trunc("day", F.min(col(x)).cast("timestamp")).alias("__origin"))
    placed = present.crossJoin(F.broadcast(first))
    return placed.withColumn("__bucket_no", bucket_index(col(x), freq, F.col("__origin"))), F.col("__origin")


def _with_labels(df: DataFrame, freq: str, name: str, origin_row: DataFrame | None) -> DataFrame:
    if origin_row is None:
        labelled = df.withColumn(name, bucket_label(F.col("__bucket_no"), freq))
    else:
        labelled = df.crossJoin(F.broadcast(origin_row)).withColumn(
            name, bucket_label(F.col("__bucket_no"), freq, F.col("__origin"))
        ).drop("__origin")
    return labelled.drop("__bucket_no")


def resample(df: DataFrame, x: str, value: str, freq: str, agg: str = "mean", group: str | None = None,
             row_id: str | None = None) -> DataFrame:
    """T4/T5: ``agg(value)`` per time bucket.

    Without a group every bucket between the first and the last is present: an
    empty one has sum and count 0 and is null otherwise. With a group only
    observed (group, bucket) pairs appear.
    """
    require_columns(df, x, value, group)
    require_numeric(df, value)
    if not is_time(df, x):
        raise ValueError("resample requires a datetime x column.")
    placed, origin = _bucketed(df, x, freq)
    origin_row = placed.select("__origin").limit(1) if origin is not None else None
    keys = ([group] if group else []) + ["__bucket_no"]
    table = grouped_aggregate(placed, keys, value, agg, row_id)
    if group is None:
        table = _fill_buckets(table, agg)
    return _with_labels(table, freq, x, origin_row).select(*([quoted(group)] if group else []), quoted(x), "value")


def _fill_buckets(table: DataFrame, agg: str) -> DataFrame:
    """Add the buckets without rows."""
    span = table.agg(F.min("__bucket_no").alias("a"), F.max("__bucket_no").alias("b")).where(F.col("a").isNotNull())
    starts, numbers = spread_range(F.col("a"), F.col("b"))
    blocks = scatter(span.withColumn("__start", F.explode(starts)), F.col("__start"))
    spine = blocks.select(F.explode(numbers).alias("__bucket_no"))
    filled = spine.join(table, "__bucket_no", "left")
    empty = {"sum": 0.0, "count": 0, "size": 0, "nunique": 0, "prod": 1.0}
    if agg in empty:
        filled = filled.withColumn("value", F.coalesce("value", F.lit(empty[agg])))
    return filled


def line(df: DataFrame, x: str, value: str, group: str | None = None, freq: str | None = None,
         agg: str = "mean", row_id: str | None = None) -> DataFrame:
    """``agg(value)`` per x (or time bucket) and group, in x order."""
    require_columns(df, x, value, group)
    require_numeric(df, value)
    timed = as_time_axis(df, x)
    if freq:
        table = resample(timed, x, value, freq, agg, group, row_id)
    else:
        table = grouped_aggregate(timed, [*([group] if group else []), x], value, agg, row_id)
    return table.orderBy(col(x), *([col(group)] if group else []))


def area(df: DataFrame, x: str, value: str, group: str | None = None, freq: str | None = None,
         agg: str = "sum", normalize: bool = False, row_id: str | None = None) -> DataFrame:
    """Totals per x and folded group, 0 where a group is absent; shares on request.

    A frequency is ignored on an axis that is not a time.
    """
    require_columns(df, x, value, group)
    require_numeric(df, value)
    timed = as_time_axis(df, x)
    freq = freq if is_time(timed, x) else None
    if group is None:
        table = line(timed, x, value, None, freq, agg, row_id).withColumn("value", F.col("value").cast("double"))
        if normalize:
            table = table.withColumn("value", F.try_divide(F.col("value"), F.col("value")) * 100)
        return table
    folded = fold_rare(timed, group)
    if freq:
        cells = resample(folded, x, value, freq, agg, group, row_id)
    else:
        cells = grouped_aggregate(folded, [group, x], value, agg, row_id)
    # At most eight levels after folding.
    levels = F.broadcast(cells.select(quoted(group)).distinct())
    grid = cells.select(quoted(x)).distinct().crossJoin(levels)
    filled = grid.join(cells, [x, group], "left").withColumn(
        "value", F.coalesce(F.col("value").cast("double"), F.lit(0.0))
    )
    if normalize:
        total = F.sum("value").over(Window.partitionBy(quoted(x)))
        filled = filled.withColumn("value", F.try_divide(F.col("value"), total) * 100)
    return filled.select(quoted(x), quoted(group), "value").orderBy(col(x), col(group))


def _rolled(agg: str, frame) -> Column:
    y = F.col("raw")
    n = F.count(y).over(frame)
    if agg == "median":
        ordered = F.array_sort(F.collect_list(y).over(frame))
        low = F.get(ordered, F.floor((F.size(ordered) - 1) / F.lit(2)).cast("int"))
        high = F.get(ordered, F.floor(F.size(ordered) / F.lit(2)).cast("int"))
        return (low + high) / 2
    if agg == "sem":
        # As a data frame's rolling window has it: divided by the root of n - 1.
        return F.try_divide(F.stddev_samp(y).over(frame), F.sqrt(n - F.lit(1)))
    if agg in ("skew", "kurt"):
        count = n.cast("double")
        flat = F.var_pop(y).over(frame) == 0
        if agg == "skew":
            raw = F.skewness(y).over(frame) * F.try_divide(F.sqrt(count * (count - 1)), count - 2)
            return F.when(n >= 3, F.when(flat, 0.0).otherwise(raw))
        scale = F.try_divide(count - 1, (count - 2) * (count - 3))
        raw = scale * ((count + 1) * F.kurtosis(y).over(frame) + 6.0)
        return F.when(n >= 4, F.when(flat, -3.0).otherwise(raw))
    function = {
        "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp,
        "count": F.count,
    }[agg]
    return function(y).over(frame).cast("double")


def rolling(df: DataFrame, x: str, value: str, window: int = 7, agg: str = "mean") -> DataFrame:
    """Mean per x in x order, then a trailing aggregate over ``window`` rows.

    Fewer than ``max(2, window // 2)`` rows give null. Rows are numbered and
    cut into chunks; the last ``window - 1`` rows of a chunk are copied into the
    next one, so every frame is complete within its chunk.
    """
    require_columns(df, x, value)
    require_numeric(df, value)
    if window < 2:
        raise ValueError("window must be >= 2.")
    if agg not in ROLLING:
        raise ValueError(f"Unknown rolling aggregate '{agg}'; choose one of {', '.join(ROLLING)}.")
    timed = as_time_axis(df, x)
    points = timed.select(quoted(x), as_double(timed, value).alias("y")).na.drop()
    series = points.groupBy(quoted(x)).agg(F.avg("y").alias("raw"))
    placed = row_positions(series, Order((x,)), "__i")
    size = max(_CHUNK, window)
    place = F.col("__i") - 1
    chunk = F.floor(place / F.lit(size))
    copies = F.when(place - chunk * size >= size - (window - 1), F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    chunked = placed.withColumn("__own", chunk).withColumn("__chunk", F.explode(copies))
    frame = Window.partitionBy("__chunk").orderBy("__i").rowsBetween(-(window - 1), 0)
    enough = F.count("raw").over(frame) >= max(2, window // 2)
    return (
        chunked.withColumn("rolled", F.when(enough, _rolled(agg, frame)))
        .where(F.col("__chunk") == F.col("__own"))
        .select(quoted(x), "raw", "rolled")
    )
