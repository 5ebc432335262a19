"""Distribution summaries: bins, density curves, boxes, ECDF, Q-Q, hexagons, small multiples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.normal import with_normal_quantile
from ..schema import as_double, as_label, col, quoted, require_columns, require_numeric
from .grouped import fold_rare, most_frequent
from .ordering import Order, quantiles, running_sums, value_counts
from .stats import normal_scores

MAX_FACETS = 12
# Kernel terms further out than this many bandwidths are below 3e-18 of the peak.
_KERNEL_REACH = 9.0


def _bin_number(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Index of the equal-width bin; the last one is closed on the right."""
    width = (high - low) / F.lit(float(bins))
    raw = F.least(F.floor((x - low) / width), F.lit(bins - 1))
    # Rounding may put a value just beside its edge; compare with the edge itself.
    down = F.when((raw > 0) & (x < low + raw * width), raw - 1).otherwise(raw)
    return F.when((down < bins - 1) & (x >= low + (down + 1) * width), down + 1).otherwise(down).cast("int")


def _limits(values: DataFrame) -> tuple[float, float] | None:
    """Range of column ``x``; a constant gets half a unit on either side."""
    low, high = values.agg(F.min("x"), F.max("x")).first()
    if low is None:
        return None
    return (low - 0.5, high + 0.5) if low == high else (low, high)


def binned(values: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """Counts per key and bin of column ``x`` on edges shared by all keys, empty bins included."""
    if bins < 1:
        raise ValueError("bins must be at least 1.")
    present = values.where(F.col("x").isNotNull())
    limits = _limits(present)
    low, high = map(F.lit, limits or (0.0, 1.0))
    number = _bin_number(F.col("x"), low, high, bins)
    counts = present.groupBy(*map(quoted, keys), number.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    places = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    if keys:
        spine = counts.select(*map(quoted, keys)).distinct().select(*map(quoted, keys), places)
    else:
        spine = values.sparkSession.range(1 if limits else 0).select(places)
    width = (high - low) / F.lit(float(bins))
    return spine.join(counts, [*keys, "bin"], "left").select(
        *map(quoted, keys),
        "bin",
        (low + F.col("bin") * width).alias("left"),
        (low + (F.col("bin") + 1) * width).alias("right"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Counts and density per bin."""
    require_numeric(df, column)
    table = binned(df.select(as_double(df, column).alias("x")), [], bins)
    total = F.sum("count").over(Window.partitionBy())
    # At most `bins` rows here.
    return table.withColumn("density", F.try_divide(F.col("count"), total * (F.col("right") - F.col("left"))))


def grouped_histogram(df: DataFrame, column: str, color: str | None = None, bins: int = 10) -> DataFrame:
    """D3: counts per colour level on shared edges; :func:`box` gives the margin."""
    require_numeric(df, column)
    require_columns(df, color)
    if color is None:
        return histogram(df, column, bins)
    rows = df.select(as_label(color).alias(color), as_double(df, column).alias("x"))
    return binned(rows, [color], bins)


def kde(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """Gaussian density with Scott's bandwidth on an even grid over the data range."""
    require_numeric(df, column)
    rows = df.select(F.lit(0).alias("__all"), as_double(df, column).alias("x"))
    return kde_by(rows, ["__all"], points).drop("__all")


def kde_by(rows: DataFrame, keys: Sequence[str], points: int) -> DataFrame:
    """Density of ``x`` per key, for a handful of keys (folded groups).

    Each row adds to the grid points within its kernel's reach, and the sums are
    formed before the shuffle: one number per key and grid point leaves a task.
    Repeated values are counted first where that at least halves the rows.
    """
    present = rows.where(F.col("x").isNotNull())
    seen = present.agg(F.count("x"), F.approx_count_distinct("x")).first()
    stats = present.groupBy(*map(quoted, keys)).agg(
        F.count("x").alias("n"), F.stddev_samp("x").alias("s"), F.min("x").alias("low"), F.max("x").alias("high")
    )
    bandwidth = F.col("s") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    stats = stats.withColumn("h", bandwidth).where(F.col("h") > 0).withColumn(
        "step", (F.col("high") - F.col("low")) / F.lit(points - 1.0)
    )
    near = F.lit(_KERNEL_REACH) * F.col("h")
    first = F.greatest(F.lit(0), F.ceil((F.col("x") - near - F.col("low")) / F.col("step")).cast("int"))
    last = F.least(F.lit(points - 1), F.floor((F.col("x") + near - F.col("low")) / F.col("step")).cast("int"))
    z = (F.col("low") + F.col("k") * F.col("step") - F.col("x")) / F.col("h")
    if 2 * seen[1] < seen[0]:
        counted = present.groupBy(*map(quoted, keys), "x").agg(F.count(F.lit(1)).alias("__times"))
    else:
        counted = present.withColumn("__times", F.lit(1))
    sums = (
        counted.join(F.broadcast(stats), list(keys))
        .withColumn("k", F.explode(F.sequence(first, last)))
        .groupBy(*map(quoted, keys), "k")
        .agg(F.sum(F.col("__times") * F.exp(F.lit(-0.5) * z * z)).alias("__sum"))
    )
    grid = stats.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    norm = F.col("n") * F.col("h") * F.sqrt(F.lit(2.0) * F.pi())
    return grid.join(sums, [*keys, "k"], "left").select(
        *map(quoted, keys),
        F.col("k").alias("point"),
        (F.col("low") + F.col("k") * F.col("step")).alias("x"),
        (F.coalesce("__sum", F.lit(0.0)) / norm).alias("density"),
    )


def box(df: DataFrame, column: str, by: Sequence[str] | str | None = None, fold: bool = True) -> DataFrame:
    """Quartiles, whiskers and outlier count per group.

    Whiskers are the extreme values within 1.5 interquartile ranges. One group
    column is folded to at most eight levels; with ``fold=False`` any number of
    group columns keeps all levels.
    """
    require_numeric(df, column)
    rows, keys = _box_rows(df, column, by, fold)
    fences = _fences(rows, keys)
    if fold and len(keys) == 1:
        # At most eight folded levels.
        fences = F.broadcast(fences)
    return _whiskers(rows, fences, keys).drop("__all")


def _box_rows(df: DataFrame, column: str, by: Sequence[str] | str | None, fold: bool) -> tuple[DataFrame, list[str]]:
    keys = [by] if isinstance(by, str) else list(by or [])
    require_columns(df, *keys)
    labelled = [as_label(k).alias(k) for k in keys] or [F.lit(0).alias("__all")]
    rows = df.select(*labelled, as_double(df, column).alias("x"))
    if fold and len(keys) == 1:
        rows = fold_rare(rows, keys[0])
    return rows, keys or ["__all"]


def _fences(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    quartiles = quantiles(rows, ["x"], [0.25, 0.5, 0.75], by=keys, names=["q1", "median", "q3"]).drop("column")
    spread = F.col("q3") - F.col("q1")
    return quartiles.withColumns(
        {"__low": F.col("q1") - 1.5 * spread, "__high": F.col("q3") + 1.5 * spread}
    )


def _whiskers(rows: DataFrame, fences: DataFrame, keys: Sequence[str]) -> DataFrame:
    x = F.col("x")
    inside = (x >= F.col("__low")) & (x <= F.col("__high"))
    marked = rows.where(x.isNotNull()).join(fences, list(keys))
    kept = [F.max(c).alias(c) for c in ("n", "q1", "median", "q3")]
    return marked.groupBy(*map(quoted, keys)).agg(
        *kept,
        F.least(F.min(F.when(inside, x)), F.max("q1")).alias("whisker_low"),
        F.greatest(F.max(F.when(inside, x)), F.max("q3")).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )


def box_outliers(df: DataFrame, column: str, by: Sequence[str] | str | None = None, fold: bool = False) -> DataFrame:
    """The values outside the whiskers, with their group."""
    require_numeric(df, column)
    rows, keys = _box_rows(df, column, by, fold)
    marked = rows.join(_fences(rows, keys), list(keys))
    outside = (F.col("x") < F.col("__low")) | (F.col("x") > F.col("__high"))
    shown = [k for k in keys if k != "__all"]
    return marked.where(outside).select(*map(quoted, shown), F.col("x").alias("value"))


def violin(df: DataFrame, column: str, by: str | None = None, points: int = 100) -> DataFrame:
    """Density curve per folded group, trimmed to its data range, with quartiles."""
    require_numeric(df, column)
    rows, keys = _box_rows(df, column, by, fold=True)
    quartiles = _fences(rows, keys).drop("__low", "__high", "n")
    return kde_by(rows, keys, points).join(quartiles, keys).drop("__all")


def ecdf(df: DataFrame, column: str, group: str | None = None) -> DataFrame:
    """Share of rows at or below each distinct value, per folded group."""
    require_numeric(df, column)
    require_columns(df, group)
    rows = df.select(*([as_label(group).alias(group)] if group else []), as_double(df, column).alias("x"))
    keys = [group] if group else []
    if group:
        rows = fold_rare(rows, group)
    counts = value_counts(rows, "x", keys, name="__times")
    upto = running_sums(
        counts, Order(("x",)), {"__upto": F.col("__times")}, keys, totals={"__upto": "__all"}, source=rows
    )
    return upto.select(*map(quoted, keys), F.col("x").alias("value"), (F.col("__upto") / F.col("__all")).alias("share"))


def qq_points(df: DataFrame, column: str) -> DataFrame:
    """Every value with its normal order-statistic median (Filliben's plotting positions)."""
    require_numeric(df, column)
    i, n = F.col("i").cast("double"), F.col("n").cast("double")
    end = F.pow(F.lit(0.5), 1 / n)
    place = F.when(i == n, end).when(i == 1, 1 - end).otherwise((i - 0.3175) / (n + 0.365))
    scored = with_normal_quantile(normal_scores(df, column), place, "theoretical")
    return scored.select("i", "theoretical", F.col("x").alias("observed"))


def qq_fit(df: DataFrame, column: str) -> DataFrame:
    """Least-squares slope, intercept and r of the Q-Q points; needs three values."""
    points = qq_points(df, column)
    fit = points.agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("observed", "theoretical").alias("slope"),
        F.avg("theoretical").alias("mx"),
        F.avg("observed").alias("my"),
        F.try_divide(
            F.covar_pop("observed", "theoretical"), F.stddev_pop("observed") * F.stddev_pop("theoretical")
        ).alias("r"),
    )
    size_error = F.raise_error(F.lit(f"Column '{column}' needs at least 3 non-null values.")).cast("double")
    slope = F.when(F.col("n") < 3, size_error).otherwise(F.col("slope"))
    return fit.select(
        "n", F.round(slope, 4).alias("slope"),
        F.round(F.col("my") - F.col("slope") * F.col("mx"), 4).alias("intercept"), F.round("r", 4).alias("r"),
    )


def hexbin(df: DataFrame, x_column: str, y_column: str, gridsize: int = 40) -> DataFrame:
    """Counts per hexagon; centres lie on two lattices shifted by half a cell."""
    require_numeric(df, x_column, y_column)
    nx, ny = gridsize, int(gridsize / 3**0.5)
    points = df.select(as_double(df, x_column).alias("x"), as_double(df, y_column).alias("y")).na.drop()
    # A hair of padding keeps the extreme points inside the lattice.
    pad = 1e-9
    edges = points.agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for f, n in ((F.min, "lo"), (F.max, "hi"))])
    # A constant column gets a range of one unit around it.
    edges = edges.select(*[F.when(F.col("lo_" + c) == F.col("hi_" + c), F.col(f"{n}_{c}") + half).otherwise(F.col(f"{n}_{c}")).alias(f"{n}_{c}")
                           for c in "xy" for n, half in (("lo", -0.5), ("hi", 0.5))])
    steps = edges.select(
        *[F.expr(f"lo_{c} - (hi_{c} - lo_{c}) * {pad}D").alias(f"o{c}") for c in "xy"],
        *[F.expr(f"(hi_{c} - lo_{c}) * (1 + 2 * {pad}D) / {k}").alias(f"s{c}") for c, k in (("x", nx), ("y", ny))],
    )
    u = (F.col("x") - F.col("ox")) / F.col("sx")
    v = (F.col("y") - F.col("oy")) / F.col("sy")
    even = (F.rint(u), F.rint(v))
    odd = (F.floor(u) + 0.5, F.floor(v) + 0.5)
    # Rows of hexagons are √3 closer together than columns, hence the factor 3.
    to_even = (u - even[0]) ** 2 + 3 * (v - even[1]) ** 2
    to_odd = (u - odd[0]) ** 2 + 3 * (v - odd[1]) ** 2
    near = to_even < to_odd
    cells = points.crossJoin(F.broadcast(steps)).groupBy(
        F.when(near, even[0]).otherwise(odd[0]).alias("column"),
        F.when(near, even[1]).otherwise(odd[1]).alias("row"),
    ).agg(F.count(F.lit(1)).alias("count"))
    return cells.crossJoin(F.broadcast(steps)).select(
        (F.col("column") * F.col("sx") + F.col("ox")).alias("x"),
        (F.col("row") * F.col("sy") + F.col("oy")).alias("y"),
        "count",
    )


def _facet_rows(df: DataFrame, column: str, by: str, max_facets: int, extra: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """Rows of the largest levels, and the number of levels left out."""
    labelled = df.select(as_label(by).alias(by), as_double(df, column).alias("x"), *map(quoted, extra))
    levels = most_frequent(labelled, by, max_facets)
    total = labelled.agg(F.count_distinct(col(by))).first()[0]
    return labelled.where(col(by).isin(levels)), total - len(levels)


def small_multiples(df: DataFrame, column: str, by: str, max_facets: int = MAX_FACETS, bins: int = 20) -> DataFrame:
    """One histogram per level on shared edges, largest levels first."""
    require_numeric(df, column)
    require_columns(df, by)
    rows, dropped = _facet_rows(df, column, by, max_facets)
    return binned(rows, [by], bins).withColumn("dropped", F.lit(dropped))


def small_multiple_lines(df: DataFrame, column: str, by: str, x: str, max_facets: int = MAX_FACETS) -> DataFrame:
    """The ``(x, column)`` points per level, in level and x order."""
    require_numeric(df, column)
    require_columns(df, by, x)
    renamed = df.select(quoted(by), quoted(column), col(x).alias("__axis"))
    rows, dropped = _facet_rows(renamed, column, by, max_facets, ["__axis"])
    points = rows.where(F.col("x").isNotNull() & F.col("__axis").isNotNull())
    return points.select(
        quoted(by), F.col("__axis").alias("axis"), F.col("x").alias("value"), F.lit(dropped).alias("dropped")
    ).orderBy(col(by), "axis")


def _versions(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    for df in (before, after):
        require_numeric(df, column)
    return before.select(F.lit("before").alias("version"), as_double(before, column).alias("x")).unionByName(
        after.select(F.lit("after").alias("version"), as_double(after, column).alias("x"))
    )


def unchanged(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Whether both versions hold the same values equally often."""
    rows = _versions(before, after, column).where(F.col("x").isNotNull())
    sign = F.when(F.col("version") == "before", 1).otherwise(-1)
    surplus = rows.groupBy("x").agg(F.sum(sign).alias("d")).where(F.col("d") != 0)
    return surplus.limit(1).agg((F.count(F.lit(1)) == 0).alias("unchanged"))


def before_after(before: DataFrame, after: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Histograms of two versions on shared edges, with sizes and the unchanged flag."""
    rows = _versions(before, after, column)
    table = binned(rows, ["version"], bins)
    n = F.sum("count").over(Window.partitionBy("version"))
    return table.withColumn("n", n).crossJoin(F.broadcast(unchanged(before, after, column)))


def before_after_box(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Box summaries of two versions."""
    return box(_versions(before, after, column), "x", "version")


def scatter(df: DataFrame, x: str, y: str, extra: Sequence[str] = (), max_rows: int | None = None,
            seed: int = 42) -> DataFrame:
    """The points to draw with hue, size or hover columns.

    All rows by default; ``max_rows`` asks for a seeded random extract of about
    that size where a picture cannot hold more (:func:`hexbin` shows all rows).
    """
    require_columns(df, x, y, *extra)
    points = df.select(*map(quoted, dict.fromkeys([x, y, *extra]))).na.drop(subset=[x, y])
    if max_rows is None:
        return points
    rows = points.count()
    return points if rows <= max_rows else points.sample(max_rows / rows, seed)
