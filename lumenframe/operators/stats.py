"""Correlation, hypothesis tests and intervals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import special
from ..functions.normal import polynomial, with_normal_quantile
from ..schema import as_double, col, is_missing, numeric_columns, quoted, require_columns, require_numeric
from ..session import settle
from .grouped import crosstab
from .ordering import Order, look_up, running_sums, scatter, spread_range

ALPHA = 0.05
METHODS = ("pearson", "spearman", "kendall")


# --- Correlation --------------------------------------------------------------

def _numbers(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    chosen = list(columns) if columns is not None else numeric_columns(df)
    require_columns(df, *chosen)
    chosen = [c for c in chosen if c in numeric_columns(df)]
    if not chosen:
        raise ValueError("No numeric columns found.")
    return chosen


def _pair_rows(df: DataFrame, columns: Sequence[str], values: Sequence[Column]) -> tuple[DataFrame, Column]:
    """Rows ``(i, j, u, v)`` per column pair where neither side is missing, and the name array."""
    packed = df.select(F.array(*values).alias("__v"))
    listed = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in combinations(range(len(columns)), 2)])
    names = F.array(*map(F.lit, columns))
    rows = packed.select("__v", F.inline(listed)).select(
        "i", "j", F.get("__v", F.col("i")).alias("u"), F.get("__v", F.col("j")).alias("v")
    )
    return rows.where(F.col("u").isNotNull() & F.col("v").isNotNull()), names


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """H1–H3 in long form: ``x, y, r, n`` for every column pair, pairwise complete."""
    if method not in METHODS:
        raise ValueError(f"Method must be one of {METHODS}.")
    columns = _numbers(df, columns)
    if len(columns) < 2:
        empty = "x string, y string, r double, n long"
        return df.sparkSession.createDataFrame([], empty)
    if method == "spearman":
        return _spearman(df, columns)
    if method == "kendall":
        return _kendall(df, columns)
    return _pearson(df, columns, [as_double(df, c) for c in columns])


def _pearson(df: DataFrame, columns: Sequence[str], values: Sequence[Column]) -> DataFrame:
    """All pairs by one aggregate of masked products, whatever the gaps and the number of columns."""
    table = df.select(*[v.alias(f"c{i}") for i, v in enumerate(values)])
    means = table.agg(*[F.avg(c) for c in table.columns]).first()
    r, n = _masked_products(table, [m if m is not None else 0.0 for m in means])
    rows = [(columns[i], columns[j], r.get((i, j)), n[i, j]) for i, j in combinations(range(len(columns)), 2) if n.get((i, j))]
    return df.sparkSession.createDataFrame(rows, "x string, y string, r double, n long")


def _masked_products(table: DataFrame, means: Sequence[float]) -> tuple[dict, dict]:
    """Pearson's r and the number of complete rows per pair (i < j) of columns; null for a constant side.

    Each task adds up, over its rows, the products of the columns' values (less
    ``means``, which only keeps the sums small), of their squares and of the
    masks of present values: four matrices of columns by columns, which are all
    that is shuffled. A pair's sums so hold just the rows where both are present.
    """
    k = len(means)
    centre = np.array([m if np.isfinite(m) else 0.0 for m in means])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares, products = np.zeros((4, k, k))
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(k)]
            x = np.stack([np.asarray(c, dtype=np.float64) for c in columns], axis=1)
            there = ~np.isnan(x)
            x = np.where(there, x - centre, 0.0)
            mask = there.astype(np.float64)
            n += mask.T @ mask
            sums += x.T @ mask
            squares += (x * x).T @ mask
            products += x.T @ x
        at_i, at_j = np.triu_indices(k, 1)
        found = [n[at_i, at_j], sums[at_i, at_j], sums[at_j, at_i], squares[at_i, at_j], squares[at_j, at_i], products[at_i, at_j]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(at_i.astype(np.int32)), pa.array(at_j.astype(np.int32)), *map(pa.array, found)], names=["i", "j", "n", "u", "v", "uu", "vv", "uv"])

    sums = ["n", "u", "v", "uu", "vv", "uv"]
    parts = table.mapInArrow(add_up, "i int, j int, " + ", ".join(f"{c} double" for c in sums))
    r, n = {}, {}
    # One row a pair of columns.
    for row in parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in sums]).collect():
        pair = row["i"], row["j"]
        n[pair] = int(row["n"])
        if n[pair]:
            uu, vv = row["uu"] - row["u"] ** 2 / row["n"], row["vv"] - row["v"] ** 2 / row["n"]
            uv = row["uv"] - row["u"] * row["v"] / row["n"]
            # What rounding leaves of a constant side.
            if uu > 1e-13 * row["uu"] and vv > 1e-13 * row["vv"]:
                r[pair] = uv / (uu**0.5 * vv**0.5)
    return r, n


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """H1–H3 as a full matrix in long form, diagonal included."""
    columns = _numbers(df, columns)
    pairs = correlation_pairs(df, columns, method).select("x", "y", "r")
    spread = df.agg(*[F.stddev_pop(as_double(df, c)).alias(f"s{i}") for i, c in enumerate(columns)])
    entries = [
        F.struct(F.lit(c).alias("x"), F.lit(c).alias("y"), F.when(F.col(f"s{i}") > 0, 1.0).alias("r"))
        for i, c in enumerate(columns)
    ]
    diagonal = spread.select(F.inline(F.array(*entries)))
    return pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"), "r")).unionByName(diagonal)


def average_ranks(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values with their count and average rank."""
    counts = df.groupBy(*map(quoted, [*by, column])).agg(F.count(F.lit(1)).alias("__times"))
    upto = running_sums(counts, Order((column,)), {"__upto": F.col("__times")}, by, source=df)
    return upto.withColumn("rank", F.col("__upto") - (F.col("__times") - 1) / 2.0).drop("__upto")


def _spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson on average ranks. Ranks are taken per column where no value is
    missing, and per pair of columns otherwise, since a pair drops its own rows.

    A column to rank is a number in one long table of counted values, and one
    keyed prefix sum ranks them all.
    """
    values = df.select(*[as_double(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    seen = values.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.bool_or(F.col(c).isNull()).alias(f"gap_{c}") for c in values.columns],
        *[F.approx_count_distinct(c).alias(f"distinct_{c}") for c in values.columns],
    ).first()
    whole = [i for i in range(len(columns)) if not seen[f"gap_c{i}"]] if seen["n"] else []
    gappy = [(i, j) for i, j in combinations(range(len(columns)), 2) if not (i in whole and j in whole)]
    # (column whose value counts, column that must be present too): one series each.
    series = ([(i, i) for i in whole] if len(whole) > 1 else []) + [s for i, j in gappy for s in ((i, j), (j, i))]
    value = lambda s: F.when(F.col(f"c{s[1]}").isNotNull(), F.col(f"c{s[0]}"))
    long = values.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), value(s).alias("x")) for k, s in enumerate(series)])))
    ranks = settle(average_ranks(long.where("x is not null"), "x", ["k"]))
    ranked = values.select(*[value(s).alias(f"v{k}") for k, s in enumerate(series)])
    for k, (i, _) in enumerate(series):
        table = ranks.where(F.col("k") == k).select(F.col("x").alias(f"v{k}"), F.col("rank").alias(f"r{k}"), "__times")
        ranked = look_up(ranked, table, f"v{k}", "__times", seen[f"distinct_c{i}"])
    means = ranks.groupBy("k").agg((F.sum(F.col("rank") * F.col("__times")) / F.sum("__times")).alias("m")).collect()
    mean_of = {row["k"]: row["m"] for row in means}
    r, n = _masked_products(ranked.select(*[F.col(f"r{k}") for k in range(len(series))]), [mean_of.get(k, 0.0) for k in range(len(series))])
    place = {s: k for k, s in enumerate(series)}
    rows = []
    for i, j in combinations(range(len(columns)), 2):
        pair = (place[i, j], place[j, i]) if (i, j) in gappy else (place[i, i], place[j, j])
        if n.get(pair):
            rows.append((columns[i], columns[j], r.get(pair), n[pair]))
    return df.sparkSession.createDataFrame(rows, "x string, y string, r double, n long")


# Kendall: points per numpy call, and blocks per side of one grid.
BLOCK_POINTS = 200_000
GRID = 256


def _kendall(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Tau-b from counted distinct value pairs.

    Concordant minus discordant weight is split by a grid of value blocks. Pairs
    of points in different block rows and columns follow from the cell counts
    alone; pairs that share a block are counted inside that block, which stays
    small however large the table is.
    """
    rows, names = _pair_rows(df, columns, [as_double(df, c) for c in columns])
    rows = rows.withColumn("pair", F.col("i") * len(columns) + F.col("j"))
    points = rows.groupBy("pair", "u", "v").agg(F.count(F.lit(1)).alias("w"))
    largest = points.groupBy("pair").agg(F.count(F.lit(1)).alias("m")).agg(F.max("m")).first()[0] or 0
    levels, reach = 0, BLOCK_POINTS
    while reach < largest:
        levels, reach = levels + 1, reach * GRID
    if levels:
        points = settle(points)
    surplus = _surplus(points, ["pair"], levels).groupBy("pair").agg(F.sum("s").alias("s"))

    def ties(side: str) -> DataFrame:
        counts = points.groupBy("pair", side).agg(F.sum("w").cast("double").alias("t"))
        return counts.groupBy("pair").agg(
            F.sum(F.col("t") * (F.col("t") - 1) / 2).alias(f"ties_{side}"), F.sum("t").alias(f"n_{side}")
        )

    table = ties("u").join(ties("v"), "pair").join(surplus, "pair", "left")
    n = F.col("n_u")
    pairs = n * (n - 1) / 2
    scale = F.sqrt(pairs - F.col("ties_u")) * F.sqrt(pairs - F.col("ties_v"))
    return table.select(
        F.get(names, F.floor(F.col("pair") / F.lit(len(columns))).cast("int")).alias("x"),
        F.get(names, F.pmod(F.col("pair"), F.lit(len(columns))).cast("int")).alias("y"),
        F.try_divide(F.coalesce("s", F.lit(0.0)), scale).alias("r"),
        n.cast("long").alias("n"),
    )


def _surplus(points: DataFrame, by: list[str], levels: int) -> DataFrame:
    """Concordant minus discordant weight, as partial sums ``(pair, s)``."""
    if levels == 0:
        schema = "pair int, s double"
        return points.groupBy(*by).applyInPandas(
            lambda block: pd.DataFrame(
                {"pair": [block["pair"].iloc[0]],
                 "s": [block_surplus(block["u"].to_numpy(), block["v"].to_numpy(), block["w"].to_numpy())]}
            ),
            schema,
        )
    one = F.lit(1).cast("long")
    blocked = points
    for side, block in (("u", f"bu{levels}"), ("v", f"bv{levels}")):
        counts = blocked.groupBy(*by, side).agg(F.count(one).alias("__m"))
        placed = running_sums(
            counts, Order((side,)), {"__upto": F.col("__m")}, by, totals={"__upto": "__all"}, source=blocked
        )
        # A value holding a whole block's share gets an odd block of its own. All
        # its points tie on this side, so nothing is left to count inside it.
        lone = (F.col("__m") * GRID >= F.col("__all")).cast("int")
        start = F.floor((F.col("__upto") - F.col("__m")) * GRID / F.col("__all")).cast("int")
        number = start * 2 + lone
        lookup = placed.select(*by, side, number.alias(block))
        blocked = blocked.join(lookup, [*by, side])
    # Used four times below.
    blocked = settle(blocked)
    bu, bv = f"bu{levels}", f"bv{levels}"
    cells = blocked.groupBy(*by, bu, bv).agg(F.sum("w").cast("double").alias("n"))
    mixed_u, mixed_v = F.col(bu) % 2 == 0, F.col(bv) % 2 == 0
    inner_u = _surplus(blocked.where(mixed_u), [*by, bu], levels - 1)
    inner_v = _surplus(blocked.where(mixed_v), [*by, bv], levels - 1)
    inner_cell = _surplus(blocked.where(mixed_u & mixed_v), [*by, bu, bv], levels - 1)
    return (
        _grid_surplus(cells, by, bu, bv)
        .unionByName(inner_u)
        .unionByName(inner_v)
        .unionByName(inner_cell.withColumn("s", -F.col("s")))
    )


def _grid_surplus(cells: DataFrame, by: list[str], bu: str, bv: str) -> DataFrame:
    """Signed weight between cells that differ in both block numbers: observed cells are points of the block numbers.

    A grid has at most (2 * GRID) ** 2 of them, and never more than it has points.
    """
    return _surplus(cells.select(*by, F.col(bu).alias("u"), F.col(bv).alias("v"), F.col("n").alias("w")), by, 0)


def block_surplus(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Σ wᵢ wⱼ sign(xᵢ − xⱼ) sign(yᵢ − yⱼ) over the pairs of one block.

    Points are separated bit by bit of their x rank; at each bit the weight
    with lower y in the zero half is accumulated along y.
    """
    rank = np.unique(x, return_inverse=True)[1]
    _, level = np.unique(y, return_inverse=True)
    weight = w.astype("float64")
    total = 0.0
    for bit in range(int(rank.max()).bit_length() if len(rank) else 0):
        group, upper = rank >> (bit + 1), (rank >> bit) & 1
        order = np.lexsort((level, group))
        g, y_sorted = group[order], level[order]
        low = np.where(upper[order] == 0, weight[order], 0.0)
        high = np.where(upper[order] == 1, weight[order], 0.0)
        run = np.concatenate(([0.0], np.cumsum(low)))
        new_group = np.concatenate(([True], g[1:] != g[:-1]))
        new_tie = new_group | np.concatenate(([True], y_sorted[1:] != y_sorted[:-1]))
        size = np.arange(len(g))
        tie_start = np.maximum.accumulate(np.where(new_tie, size, 0))
        group_start = np.maximum.accumulate(np.where(new_group, size, 0))
        tie_end = _next_start(new_tie)
        group_end = _next_start(new_group)
        below = run[tie_start] - run[group_start]
        above = run[group_end] - run[tie_end]
        total += float(np.sum(high * (below - above)))
    return total


def _next_start(starts: np.ndarray) -> np.ndarray:
    """For each place, the place where the next run starts."""
    n = len(starts)
    ahead = np.where(np.concatenate((starts[1:], [True])), np.arange(1, n + 1), n)
    return np.minimum.accumulate(ahead[::-1])[::-1]


# --- Tests and intervals ------------------------------------------------------

def normal_scores(df: DataFrame, column: str) -> DataFrame:
    """Every value with its rank ``i`` and the count ``n``, from counted distinct values.

    Equal values are expanded in blocks, so a value held by a third of the rows
    is produced by many tasks.
    """
    x = as_double(df, column)
    rows = df.select(x.alias("x")).where(F.col("x").isNotNull())
    counts = rows.groupBy("x").agg(F.count(F.lit(1)).alias("__times"))
    placed = running_sums(counts, Order(("x",)), {"__upto": F.col("__times")}, totals={"__upto": "n"}, source=rows)
    starts, numbers = spread_range(F.col("__upto") - F.col("__times") + 1, F.col("__upto"))
    blocks = placed.withColumn("__start", F.explode(starts))
    return scatter(blocks, F.xxhash64("x", "__start")).select("x", "n", F.explode(numbers).alias("i"))


# Royston's published polynomials (AS R94, 1995), constant term first.
_A_LAST = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
_A_NEXT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_SMALL_MEAN = (0.5440, -0.39978, 0.025054, -6.714e-4)
_SMALL_SPREAD = (1.3822, -0.77857, 0.062767, -0.0020322)
_LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
_LARGE_SPREAD = (-0.4803, -0.082676, 0.0030302)
_SMALL_SHIFT = (-2.273, 0.459)


def shapiro(df: DataFrame, column: str) -> DataFrame:
    """H4: Shapiro–Wilk W and p over all values (Royston's approximation).

    Any number of values is used; the p-value is calibrated up to 5000.
    """
    require_numeric(df, column)
    place = (F.col("i") - F.lit(0.375)) / (F.col("n") + F.lit(0.25))
    ranked = with_normal_quantile(normal_scores(df, column), place, "m")
    i, n, x, m = F.col("i"), F.col("n"), F.col("x"), F.col("m")
    edge = (i <= 2) | (i > n - 2)
    sums = ranked.agg(
        F.max("n").alias("n"),
        F.sum(m * m).alias("mm"),
        F.sum(F.when(~edge, m * x)).alias("mx"),
        F.var_pop("x").alias("v"),
        F.max(F.when(i == 1, x)).alias("x1"),
        F.max(F.when(i == 2, x)).alias("x2"),
        F.max(F.when(i == n - 1, x)).alias("y2"),
        F.max(F.when(i == n, x)).alias("y1"),
        F.max(F.when(i == n, m)).alias("m1"),
        F.max(F.when(i == n - 1, m)).alias("m2"),
    )
    size = n.cast("double")
    root = F.sqrt(1.0 / size)
    norm = F.sqrt("mm")
    a1 = polynomial(root, _A_LAST) + F.col("m1") / norm
    a2 = polynomial(root, _A_NEXT) + F.col("m2") / norm
    shrink_two = F.sqrt((F.col("mm") - 2 * F.col("m1") ** 2 - 2 * F.col("m2") ** 2) / (1 - 2 * a1**2 - 2 * a2**2))
    shrink_one = F.sqrt((F.col("mm") - 2 * F.col("m1") ** 2) / (1 - 2 * a1**2))
    outer, inner = F.col("y1") - F.col("x1"), F.col("y2") - F.col("x2")
    middle = F.coalesce("mx", F.lit(0.0))
    top = (
        F.when(n == 3, F.lit(0.5**0.5) * outer)
        .when(n <= 5, a1 * outer + (middle + F.when(n > 3, F.col("m2") * inner).otherwise(0.0)) / shrink_one)
        .otherwise(a1 * outer + a2 * inner + middle / shrink_two)
    )
    w = F.least(F.try_divide(top * top, F.col("v") * size), F.lit(1.0))
    statistic = sums.where(n >= 3).withColumn("w", F.when(F.col("v") > 0, w).otherwise(1.0))
    log_n = F.ln(size)
    gamma = polynomial(size, _SMALL_SHIFT)
    distance = F.ln(F.greatest(1.0 - F.col("w"), F.lit(1e-300)))
    z = F.when(
        (n <= 11) & (distance >= gamma), F.lit(40.0)
    ).when(
        n <= 11, (-F.ln(gamma - distance) - polynomial(size, _SMALL_MEAN)) / F.exp(polynomial(size, _SMALL_SPREAD))
    ).otherwise((distance - polynomial(log_n, _LARGE_MEAN)) / F.exp(polynomial(log_n, _LARGE_SPREAD)))
    three = F.greatest(F.lit(6.0 / np.pi) * (F.asin(F.sqrt("w")) - F.asin(F.lit(0.75**0.5))), F.lit(0.0))
    statistic = special.with_tail(statistic.select("*", z.alias("z"), three.alias("three")), "tail", special.normal_sf, F.col("z"))
    p = F.when(n == 3, F.col("three")).otherwise(F.col("tail"))
    p = F.when(F.col("v") > 0, p).otherwise(1.0)
    return statistic.select(
        F.lit(column).alias("column"),
        n.cast("long").alias("n"),
        F.round("w", 4).alias("statistic"),
        F.round(p, 4).alias("p_value"),
        (p > ALPHA).alias("is_normal"),
    )


def check_normality(df: DataFrame, column: str) -> DataFrame:
    """H4 with the size check: fewer than three values are an error."""
    require_numeric(df, column)
    if df.where(~is_missing(df, column)).limit(3).count() < 3:
        raise ValueError("Need at least 3 samples for normality test.")
    return shapiro(df, column)


def group_moments(df: DataFrame, column: str, group: str, row_id: str | None = None) -> DataFrame:
    """Count, mean and squared deviations of a column per group (missing groups left out)."""
    require_numeric(df, column)
    require_columns(df, group, row_id)
    x = as_double(df, column)
    first = F.min(col(row_id)) if row_id else F.min(col(group))
    return df.where(~is_missing(df, group)).groupBy(col(group).cast("string").alias("group")).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("var"), first.alias("first_seen")
    )


def t_test(df: DataFrame, column: str, group: str, row_id: str | None = None) -> DataFrame:
    """H5: pooled two-sample t test; the first group to appear comes first."""
    # Three rows at most: enough to know whether there are exactly two groups.
    found = group_moments(df, column, group, row_id).limit(3)
    rows = found.collect()
    if len(rows) != 2:
        raise ValueError(
            f"A t test compares two groups; the column holds {'more than 2' if len(rows) > 2 else len(rows)}"
        )
    if min(r["n"] for r in rows) == 0 or sum(r["n"] for r in rows) < 3:
        raise ValueError(f"'{column}' needs values in both groups, three at least, for a t test.")
    place = F.row_number().over(Window.orderBy("first_seen"))
    numbered = df.sparkSession.createDataFrame(rows, found.schema).withColumn("k", place)

    def side(k: int, name: str) -> Column:
        return F.max(F.when(F.col("k") == k, F.col(name)))

    row = numbered.agg(
        *[side(k, name).alias(f"{name}{k}") for k in (1, 2) for name in ("group", "n", "mean", "var")]
    )
    dof = F.col("n1") + F.col("n2") - 2
    pooled = ((F.col("n1") - 1) * F.col("var1") + (F.col("n2") - 1) * F.col("var2")) / dof
    t = F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2"))))
    row = row.withColumn("dof", dof).withColumn("t", t)
    return special.with_tail(row, "p", special.student_two_sided, F.col("t"), F.col("dof")).select(
        F.col("group1"), F.col("group2"), F.round("t", 4).alias("statistic"), F.col("dof").cast("long").alias("dof"),
        F.round("p", 4).alias("p_value"), (F.col("p") < ALPHA).alias("is_significant"),
    )


def anova(df: DataFrame, column: str, group: str) -> DataFrame:
    """H6: one-way analysis of variance over two or more groups."""
    found = group_moments(df, column, group)
    # Between-group variation as a weighted variance of the group means.
    grand = F.broadcast(found.agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand")))
    row = found.crossJoin(grand).agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * (F.col("mean") - F.col("grand")) ** 2).alias("between"),
        F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0))).alias("within"),
    )
    sums = row.first()
    if sums["k"] < 2:
        raise ValueError("An analysis of variance compares two groups or more.")
    row = df.sparkSession.createDataFrame([sums], row.schema)
    f = F.try_divide(F.col("between") / F.col("dof1"), F.try_divide(F.col("within"), F.col("dof2")))
    row = row.withColumns({"dof1": F.col("k") - 1, "dof2": F.col("n") - F.col("k")}).withColumn("f", f)
    return (
        special.with_tail(row, "p", special.fisher_sf, F.col("f"), F.col("dof1"), F.col("dof2"))
        .select(
            F.col("k").alias("num_groups"), F.round("f", 4).alias("statistic"), F.round("p", 4).alias("p_value"),
            (F.col("p") < ALPHA).alias("is_significant"),
        )
    )


def chi_square(df: DataFrame, first: str, second: str) -> DataFrame:
    """H7: independence test; Yates' correction with one degree of freedom.

    Empty cells contribute exactly their expected count, so only observed cells
    are needed: the expected counts of all cells add up to the row count.
    """
    cells = crosstab(df, first, second, fill=False).withColumnRenamed("count", "o")
    rows = cells.groupBy(quoted(first)).agg(F.sum("o").cast("double").alias("a"))
    columns = cells.groupBy(quoted(second)).agg(F.sum("o").cast("double").alias("b"))
    sizes = rows.agg(
        F.count(F.lit(1)).alias("r"), F.sum("a").alias("n"), F.sum(1 / F.col("a")).alias("inverse_a")
    ).crossJoin(F.broadcast(columns.agg(F.count(F.lit(1)).alias("c"), F.sum(1 / F.col("b")).alias("inverse_b"))))
    joined = cells.join(rows, first).join(columns, second).crossJoin(F.broadcast(sizes))
    expected = joined.withColumn("e", F.col("a") * F.col("b") / F.col("n"))
    gap = F.abs(F.col("o") - F.col("e"))
    one = [F.max(c).alias(c) for c in ("r", "c", "n", "inverse_a", "inverse_b")]
    row = expected.agg(
        *one, F.sum(gap * gap / F.col("e")).alias("seen"), F.sum("e").alias("seen_expected"),
        F.count(F.lit(1)).alias("cells"), F.max(gap).alias("gap"),
    )
    sums = row.first()
    if not sums["cells"]:
        raise ValueError(f"No row has values of both '{first}' and '{second}'.")
    row = df.sparkSession.createDataFrame([sums], row.schema).withColumn("dof", (F.col("r") - 1) * (F.col("c") - 1))
    unseen = F.when(F.col("cells") < F.col("r") * F.col("c"), F.col("n") - F.col("seen_expected")).otherwise(0.0)
    # In a 2 x 2 table all four cells have the same |O - E|.
    corrected = F.greatest(F.col("gap") - 0.5, F.lit(0.0))
    yates = corrected * corrected * F.col("n") * F.col("inverse_a") * F.col("inverse_b")
    x2 = F.when(F.col("dof") == 1, yates).when(F.col("dof") == 0, 0.0).otherwise(F.col("seen") + unseen)
    return special.with_tail(row.withColumn("x2", x2), "p", special.chi_square_sf, F.col("x2"), F.col("dof")).select(
        F.round("x2", 4).alias("statistic"), F.col("dof").cast("long").alias("dof"),
        F.round("p", 4).alias("p_value"), (F.col("p") > ALPHA).alias("is_independent"),
    )


def mean_interval(df: DataFrame, column: str, confidence: float = 0.95) -> DataFrame:
    """H8: Student interval for the mean; needs two values."""
    require_numeric(df, column)
    x = as_double(df, column)
    row = df.agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"))
    sums = row.first()
    if sums["n"] < 2:
        raise ValueError("An interval for the mean takes two values or more.")
    row = df.sparkSession.createDataFrame([sums], row.schema)
    reach = F.lit(special.student_quantile(0.5 + confidence / 2, sums["n"] - 1)) * F.col("s") / F.sqrt("n")
    return row.select(
        F.lit(column).alias("column"),
        F.round("m", 4).alias("mean"),
        F.lit(float(confidence)).alias("confidence_level"),
        F.round(F.col("m") - reach, 4).alias("lower_bound"),
        F.round(F.col("m") + reach, 4).alias("upper_bound"),
        F.round(reach, 4).alias("margin_of_error"),
        F.col("n").alias("sample_size"),
    )
