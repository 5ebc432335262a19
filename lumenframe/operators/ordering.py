"""Ordered computations without a single-task window.

A window ordered over a whole table runs in one task. Every ordered operator
here first cuts the order column into ranges of about equal size, works inside
each range in parallel, and adds what the earlier ranges contribute: one small
row per range. The cut points come from a mergeable quantile sketch, so they
only steer the balance; the results are exact whatever the cut points are.
"""

from __future__ import annotations

import itertools
import json
import math
import os
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..schema import as_double, col, dtype, fresh_name, is_missing, is_numeric, quoted
from ..session import settle

BUCKET = "__bucket"
# Longs beyond this are not told apart as doubles.
_EXACT_DOUBLE = float(2**53)
# Side tables are broadcast up to this (estimated) number of short rows.
BROADCAST_ROWS = 100_000
# Share of the rows above which a single value counts as hot: at most this many.
_HOT_LEVELS = 256


def range_count(df: DataFrame) -> int:
    """How many ranges to cut: a few per shuffle partition."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(32, min(8192, 4 * partitions))


# Texts that divide a text key into ranges, at most, and their bytes together.
_TEXT_MARKS = 2304
_MARK_BYTES = 1 << 20


def _shortest_distinguishing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted texts, each one's beginning up to the first byte that tells it from the one before."""
    before = ""
    for batch in batches:
        marks = []
        for value in batch.column(0).to_pylist():
            common = os.path.commonprefix([before, value])
            marks.append(value[: len(common) + 1])
            before = value
        yield pa.RecordBatch.from_arrays([pa.array(marks, pa.string())], names=["m"])


def text_marks(df: DataFrame, order: Order, column: str, keys: int) -> tuple[str, ...]:
    """Sorted texts that divide the column about evenly, from a bounded sample of its values taken by hash of the keys.

    ``keys`` estimates the distinct keys, a share of which is sampled. A mark is the shortest beginning
    of a sampled text that tells it from the sample's next lower one, so texts
    with a long common beginning are told apart behind it, and marks stay short
    otherwise. Marks of more than a bounded size together are thinned out evenly.
    """
    share = min(1.0, _TEXT_MARKS / max(keys, 1))
    chosen = F.pmod(F.xxhash64(*map(quoted, order.columns)), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = df.where(col(column).isNotNull() & chosen).select(col(column).alias("v")).distinct()
    # One task sorts the sample.
    ordered = sample.coalesce(1).sortWithinPartitions("v")
    marks = sorted({r["m"] for r in ordered.mapInArrow(_shortest_distinguishing, "m string").collect()}, key=str.encode)
    while len(marks) > 32 and sum(len(m.encode()) for m in marks) > _MARK_BYTES:
        marks = marks[1::2]
    return tuple(marks)


def marks_passed(value: Column, marks: Sequence[str]) -> Column:
    """How many of the sorted marks are not above the value, found in two steps of about the root of their number."""
    if not marks:
        return F.lit(0)
    step = max(1, math.isqrt(len(marks)))
    chunks = [list(marks[i : i + step]) for i in range(0, len(marks), step)]
    literal = lambda v, kind: F.from_json(F.lit(json.dumps(v)), kind)
    heads = literal([c[0] for c in chunks], "array<string>")
    chunk = F.size(F.filter(heads, lambda m: m <= value))
    inside = F.filter(F.element_at(literal(chunks, "array<array<string>>"), F.greatest(chunk, F.lit(1))), lambda m: m <= value)
    return F.when(chunk == 0, 0).otherwise((chunk - 1) * step + F.size(inside))


def order_number(df: DataFrame, column: str, marks: Sequence[str] = ()) -> Column:
    """A double that never decreases while the column increases; for texts, the number of marks passed."""
    kind = dtype(df, column)
    value = col(column)
    if isinstance(kind, T.TimestampNTZType):
        value = F.unix_micros(value.cast("timestamp"))
    elif isinstance(kind, T.TimestampType):
        value = F.unix_micros(value)
    elif isinstance(kind, T.DateType):
        value = F.unix_date(value)
    elif isinstance(kind, T.StringType):
        value = F.when(value.isNotNull(), marks_passed(value, marks))
    elif not (is_numeric(kind) or isinstance(kind, T.BooleanType)):
        raise ValueError(f"Column '{column}' cannot be ordered.")
    return F.coalesce(F.nanvl(value.cast("double"), F.lit(None).cast("double")), F.lit(float("-inf")))


@dataclass(frozen=True)
class Order:
    """Order keys: column names, and which of them run downwards."""

    columns: tuple[str, ...]
    descending: tuple[str, ...] = ()

    def keys(self) -> list[Column]:
        return [col(c).desc() if c in self.descending else col(c).asc() for c in self.columns]

    def marks(self, df: DataFrame, keys: int) -> tuple[tuple[str, ...], ...]:
        """For the keys that divide the table, the marks of those that are texts."""
        return tuple(text_marks(df, self, c, keys) if isinstance(dtype(df, c), T.StringType) else () for c in self.columns[:2])

    def numbers(self, df: DataFrame, marks: Sequence[Sequence[str]]) -> list[Column]:
        found = [order_number(df, c, m) for c, m in zip(self.columns, marks)]
        return [-n if c in self.descending else n for c, n in zip(self.columns, found)]


@dataclass(frozen=True)
class Cuts:
    """Cut points for the first order key, and for the second inside hot values.

    ``rows`` estimates the distinct keys, which is the size of a table that has
    one row per key.
    """

    edges: tuple[float, ...]
    rows: int
    tie_edges: tuple[float, ...] = ()
    hot: tuple[float, ...] = ()
    marks: tuple[tuple[str, ...], ...] = ()

    @property
    def small(self) -> bool:
        """Few enough rows for one task."""
        return self.rows <= BROADCAST_ROWS


# Size of the quantile sketches: a rank error well below a thousandth.
_SKETCH = 4000
_RANK_MARGIN = 0.003
# Points of a sketch among which a bracket's new ends are chosen.
_NARROW_STEPS = 512
# Rounds in which brackets are narrowed, each to about a hundredth.
_NARROW_TURNS = 12


def _sketch(number: Column) -> Column:
    finite = F.when(F.abs(number) < F.lit(float("inf")), number)
    return F.kll_sketch_agg_double(finite, F.lit(_SKETCH))


def _sketch_points(name: str, ranks: Sequence[float]) -> Column:
    """Sketch quantiles as an array; null for a sketch without values."""
    wanted = F.array(*[F.lit(float(r)) for r in ranks])
    return F.when(F.kll_sketch_get_n_double(name) > 0, F.kll_sketch_get_quantile_double(name, wanted))


def find_cuts(df: DataFrame, order: Order, by: Sequence[str] = (), ranges: int | None = None, for_large: bool = False) -> Cuts:
    """One aggregate job; the driver receives a bounded list of numbers.

    ``for_large``: no cut points are needed if the table turns out small.
    """
    ranges = ranges or range_count(df)
    keys = F.approx_count_distinct(F.xxhash64(*map(quoted, [*by, *order.columns])))
    marks: tuple[tuple[str, ...], ...] = ((),) * len(order.columns[:2])
    if any(isinstance(dtype(df, c), T.StringType) for c in order.columns[:2]):
        rows = df.agg(keys).first()[0]
        # Sampling texts is worth it for a large table only.
        if for_large and rows <= BROADCAST_ROWS:
            return Cuts((), rows)
        marks = order.marks(df, rows)
    numbers = order.numbers(df, marks)
    sketches = df.agg(keys.alias("rows"), *[_sketch(n).alias(f"s{i}") for i, n in enumerate(numbers)])
    steps = [i / ranges for i in range(1, ranges)]
    row = sketches.select("rows", *[_sketch_points(f"s{i}", steps) for i in range(len(numbers))]).first()
    points = list(row[1] or [])
    edges = sorted(set(points))
    repeated = sorted({a for a, b in zip(points, points[1:]) if a == b and abs(a) < _EXACT_DOUBLE})
    # Different texts may pass the same marks, so such a range can't be divided by the second key.
    if len(numbers) == 1 or not repeated or isinstance(dtype(df, order.columns[0]), T.StringType):
        return Cuts(tuple(edges), row["rows"], marks=marks)
    # A value holding several quantiles gets a range of its own, which the
    # second key then divides further.
    edges = sorted({*edges, *repeated, *(math.nextafter(v, math.inf) for v in repeated)})
    return Cuts(tuple(edges), row["rows"], tuple(sorted(set(row[2] or []))), tuple(repeated), marks)


def _range_of(df: DataFrame, number: Column, edges: Sequence[float], name: str) -> DataFrame:
    if not edges:
        return df.withColumn(name, F.lit(0.0))
    source = fresh_name(df.columns, "__number")
    splits = [float("-inf"), *edges, float("inf")]
    cutter = Bucketizer(splits=splits, inputCol=source, outputCol=name, handleInvalid="keep")
    return cutter.transform(df.withColumn(source, number)).drop(source)


def assign_range(df: DataFrame, order: Order, cuts: Cuts) -> DataFrame:
    """Add the range number; equal order keys always share a range."""
    numbers = order.numbers(df, cuts.marks)
    out = _range_of(df, numbers[0], cuts.edges, BUCKET)
    # Never null, so that joining on it adds no filter to one side only and both
    # sides share one shuffle.
    if not cuts.tie_edges:
        return out.withColumn(BUCKET, F.coalesce(F.col(BUCKET).cast("long"), F.lit(0)))
    out = _range_of(out, numbers[1], cuts.tie_edges, "__tie")
    hot = numbers[0].isin([float(v) for v in cuts.hot])
    width = len(cuts.tie_edges) + 2
    number = F.col(BUCKET).cast("long") * width + F.when(hot, F.col("__tie").cast("long")).otherwise(0)
    return out.withColumn(BUCKET, F.coalesce(number, F.lit(0))).drop("__tie")


def running_sums(
    df: DataFrame,
    order: Order,
    sums: Mapping[str, Column],
    by: Sequence[str] = (),
    totals: Mapping[str, str] | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Running sums up to and including each row, along ``order`` within ``by``.

    The table has one row per ``by`` and order key. ``totals`` names, per running
    sum, an extra column holding the whole sum of the group. ``source`` is a
    cheaper table with the same keys to take the cut points from. Group keys
    must not be null. A table that is found to be small is summed by one window.
    """
    totals = dict(totals or {})
    cuts = find_cuts(df if source is None else source, order, by, for_large=True)
    group = Window.partitionBy(*map(quoted, by))
    if cuts.small:
        so_far = group.orderBy(*order.keys()).rowsBetween(Window.unboundedPreceding, 0)
        return df.select(
            "*",
            *[F.sum(c).over(so_far).alias(k) for k, c in sums.items()],
            *[F.sum(sums[k]).over(group).alias(name) for k, name in totals.items()],
        )
    ranged = assign_range(df, order, cuts)
    keys = [*by, BUCKET]
    per_range = ranged.groupBy(*map(quoted, keys)).agg(
        *[F.sum(c).alias(f"__part_{k}") for k, c in sums.items()]
    )
    earlier = group.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *map(quoted, keys),
        *[F.sum(f"__part_{k}").over(earlier).alias(f"__off_{k}") for k in sums],
        *[F.sum(f"__part_{k}").over(group).alias(name) for k, name in totals.items()],
    )
    inside = (
        Window.partitionBy(*map(quoted, keys))
        .orderBy(*order.keys())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    local = ranged.withColumns({f"__run_{k}": F.sum(c).over(inside) for k, c in sums.items()})
    return local.join(offsets, keys).select(
        *map(quoted, df.columns),
        *[
            (F.col(f"__run_{k}") + F.coalesce(F.col(f"__off_{k}"), F.lit(0))).alias(k)
            for k in sums
        ],
        *[F.col(name) for name in totals.values()],
    )


def row_positions(df: DataFrame, order: Order, name: str = "position", total: str | None = None) -> DataFrame:
    """Number the rows 1, 2, … along ``order`` (which must not tie)."""
    return running_sums(df, order, {name: F.lit(1).cast("long")}, totals={name: total} if total else None)


def carry_forward(df: DataFrame, columns: Sequence[str], row_id: str) -> DataFrame:
    """Fill nulls with the last non-null value before them in ``row_id`` order."""
    order = Order((row_id,))
    cuts = find_cuts(df, order)
    ranged = assign_range(df, order, cuts)
    present = {c: ~is_missing(df, c) for c in columns}
    ends = ranged.groupBy(BUCKET).agg(
        *[F.max_by(F.when(present[c], col(c)), F.when(present[c], col(row_id))).alias(f"__end_{i}")
          for i, c in enumerate(columns)]
    )
    earlier = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        BUCKET,
        *[F.last(f"__end_{i}", ignorenulls=True).over(earlier).alias(f"__carry_{i}") for i in range(len(columns))],
    )
    inside = Window.partitionBy(BUCKET).orderBy(col(row_id)).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns(
        {f"__local_{i}": F.last(F.when(present[c], col(c)), ignorenulls=True).over(inside)
         for i, c in enumerate(columns)}
    )
    filled = {c: F.coalesce(F.col(f"__local_{i}"), F.col(f"__carry_{i}")) for i, c in enumerate(columns)}
    return local.join(carried, BUCKET).select(
        *[filled[c].alias(c) if c in filled else col(c) for c in df.columns]
    )


# A bracket is refined until it holds at most this many distinct values.
BRACKET_VALUES = 1_000_000
_BATCH = 24


@dataclass
class _Bracket:
    """Where the two ranks around one quantile of one column lie."""

    column: int
    low_rank: int
    high_rank: int
    low: float
    high: float
    before: int = 0
    inside: int = 0

    def holds(self, x: Column) -> Column:
        return (x >= F.lit(self.low)) & (x <= F.lit(self.high))

    def shares(self, size: int) -> list[float]:
        """Relative ranks of both ends inside the bracket, with a safety margin."""
        margin = max(_RANK_MARGIN, 2.0 / size)
        first = (self.low_rank - self.before) / size - margin
        last = (self.high_rank - self.before + 1) / size + margin
        return [min(max(first, 0.0), 1.0), min(max(last, 0.0), 1.0)]


def column_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]
) -> dict[str, tuple[int, list[float]]]:
    """Exact quantiles of whole columns: ``{column: (n, values)}``.

    A sketch brackets every wanted rank; one counting pass proves that the rank
    lies in its bracket (and otherwise moves the bracket); only the values in
    the brackets, well under a hundredth of the rows, are then counted and
    ranked. Brackets with too many distinct values are narrowed again first.
    The driver receives a few numbers per column. A column without values is absent.
    """
    out: dict[str, tuple[int, list[float]]] = {}
    for start in range(0, len(columns), _BATCH):
        out |= _column_quantiles(df, columns[start:start + _BATCH], probabilities)
    return out


def _column_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> dict:
    values = df.select(*[as_double(df, c).alias(f"x{i}") for i, c in enumerate(columns)])
    inputs = [F.col(f"x{i}") for i in range(len(columns))]
    sketches = values.agg(
        *[F.kll_sketch_agg_double(x, F.lit(_SKETCH)).alias(f"s{i}") for i, x in enumerate(inputs)]
    )
    ranks = [min(max(p + side * _RANK_MARGIN, 0.0), 1.0) for p in probabilities for side in (-1, 1)]
    guesses = sketches.select(
        *[F.kll_sketch_get_n_double(f"s{i}").alias(f"n{i}") for i in range(len(columns))],
        *[_sketch_points(f"s{i}", ranks).alias(f"q{i}") for i in range(len(columns))],
    ).first()
    brackets: dict[tuple[int, int], _Bracket] = {}
    for i in range(len(columns)):
        n, points = guesses[f"n{i}"], guesses[f"q{i}"]
        for j, p in enumerate(probabilities if n else ()):
            place = p * (n - 1)
            # The margin means less than two rows in a small table: take them all.
            few = n * _RANK_MARGIN < 2
            low, high = (float("-inf"), float("inf")) if few else points[2 * j:2 * j + 2]
            brackets[i, j] = _Bracket(i, math.floor(place), math.ceil(place), low, high)

    found: dict[tuple[int, int], tuple[float, float]] = {}
    ready: dict[tuple[int, int], _Bracket] = {}
    while brackets:
        settled, narrow = _prove(values, brackets)
        found |= {k: (b.low, b.low) for k, b in settled.items() if b.low == b.high}
        ready |= {k: b for k, b in settled.items() if b.low < b.high}
        brackets = _narrow(values, narrow) if narrow else {}
    if ready:
        found |= _pick(values, ready)
    out = {}
    for i, c in enumerate(columns):
        n = guesses[f"n{i}"]
        if n:
            pairs = [(found[i, j], p * (n - 1)) for j, p in enumerate(probabilities)]
            out[c] = (n, [low + (high - low) * (place - math.floor(place)) for (low, high), place in pairs])
    return out


def _prove(values: DataFrame, brackets: Mapping) -> tuple[dict, dict]:
    """Count around each bracket; split them into proven ones and ones to narrow."""
    counts = []
    for k, b in enumerate(brackets.values()):
        x = F.col(f"x{b.column}")
        counts += [F.count_if(x < F.lit(b.low)).alias(f"before{k}"), F.count_if(b.holds(x)).alias(f"inside{k}")]
    row = values.agg(*counts).first()
    settled, narrow = {}, {}
    for k, (key, b) in enumerate(brackets.items()):
        before, inside = row[f"before{k}"], row[f"inside{k}"]
        if b.low_rank < before:
            # The sketch was off: the rank lies further down.
            narrow[key] = _Bracket(b.column, b.low_rank, b.high_rank, float("-inf"), b.high, 0, before + inside)
        elif b.high_rank >= before + inside:
            narrow[key] = _Bracket(b.column, b.low_rank, b.high_rank, b.low, float("inf"), before, -1)
        else:
            settled[key] = _Bracket(b.column, b.low_rank, b.high_rank, b.low, b.high, before, inside)
    wide = {k: b for k, b in settled.items() if b.inside > BRACKET_VALUES and b.low < b.high}
    if wide:
        # Many rows may still be few values.
        x = {k: F.col(f"x{b.column}") for k, b in wide.items()}
        distinct = values.agg(*[F.approx_count_distinct(F.when(b.holds(x[k]), x[k])) for k, b in wide.items()]).first()
        for (k, b), many in zip(wide.items(), distinct):
            if many > BRACKET_VALUES:
                narrow[k] = settled.pop(k)
    return settled, narrow


def _narrow(values: DataFrame, brackets: Mapping) -> dict:
    """Sketch the values inside each bracket to draw it tighter."""
    inside = [F.when(b.holds(F.col(f"x{b.column}")), F.col(f"x{b.column}")) for b in brackets.values()]
    sketches = values.agg(*[F.kll_sketch_agg_double(x, F.lit(_SKETCH)).alias(f"s{k}") for k, x in enumerate(inside)])
    # An open bracket learns its size here.
    sizes = sketches.select(*[F.kll_sketch_get_n_double(f"s{k}") for k in range(len(brackets))])
    known = sizes.first() if any(b.inside < 0 for b in brackets.values()) else None
    points = []
    for k, b in enumerate(brackets.values()):
        size = known[k] if b.inside < 0 else b.inside
        points.append(_sketch_points(f"s{k}", b.shares(size)))
    row = sketches.select(*points).first()
    return {
        key: _Bracket(b.column, b.low_rank, b.high_rank, *row[k])
        for k, (key, b) in enumerate(brackets.items())
    }


def _pick(values: DataFrame, brackets: Mapping) -> dict:
    """The values at the wanted ranks: the brackets' rows are counted, ranked and matched."""
    keys, items = list(brackets), list(brackets.values())
    # Each value meets the brackets of its own column only, and most rows lie in none.
    hits = [b.holds(F.col(f"x{b.column}")) for b in items]
    touched = F.lit(False)
    for hit in hits:
        touched |= F.coalesce(hit, F.lit(False))
    owners = F.array_compact(F.array(*[
        F.when(hit, F.struct(F.lit(k).alias("k"), F.col(f"x{b.column}").alias("x"))) for k, (hit, b) in enumerate(zip(hits, items))]))
    rows = values.where(touched).select(F.inline(owners))
    counted = rows.groupBy("k", "x").agg(F.count(F.lit(1)).alias("times"))
    upto = F.sum("times").over(Window.partitionBy("k").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))

    def of(name: str) -> Column:
        return F.get(F.array(*[F.lit(getattr(b, name)).cast("long") for b in items]), F.col("k"))

    ranked = counted.withColumn("upto", upto + of("before")).withColumn("from", F.col("upto") - F.col("times"))

    def at(rank: str) -> Column:
        return F.max(F.when((F.col("from") <= of(rank)) & (of(rank) < F.col("upto")), F.col("x")))

    picked = ranked.groupBy("k").agg(at("low_rank").alias("low"), at("high_rank").alias("high")).collect()
    return {keys[r["k"]]: (r["low"], r["high"]) for r in picked}


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    names: Sequence[str] | None = None,
    exact: bool = True,
) -> DataFrame:
    """Linearly interpolated quantiles per ``by`` group and column, in long form.

    Output: ``by`` keys, ``column``, ``n`` (non-null values) and one column per
    probability. Group keys must not be null.
    """
    names = list(names or [f"q{i}" for i in range(len(probabilities))])
    if exact and not by:
        found = column_quantiles(df, columns, probabilities)
        rows = [(c, n, *qs) for c, (n, qs) in found.items()]
        schema = T.StructType(
            [T.StructField("column", T.StringType()), T.StructField("n", T.LongType())]
            + [T.StructField(name, T.DoubleType()) for name in names]
        )
        return df.sparkSession.createDataFrame(rows, schema)
    long = melted(df, columns, by)
    keys = [*by, "column"]
    if not exact:
        return long.groupBy(*map(quoted, keys)).agg(
            F.count("x").alias("n"),
            *[F.percentile_approx("x", p, 10000).alias(n) for p, n in zip(probabilities, names)],
        )
    return group_quantiles(long, keys, probabilities, names)


def melted(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows ``(by…, column, x)`` of the columns' values as doubles, without missing ones."""
    values = df.select(*map(quoted, by), *[as_double(df, c).alias(f"__x{i}") for i, c in enumerate(columns)])
    return _melt(values, by, columns, [[f"__x{i}"] for i in range(len(columns))], ["x"])


# A table of at most this many bytes may be broadcast.
BROADCAST_BYTES = 32 << 20


def table_bytes(df: DataFrame) -> int:
    """About the size of the rows: texts by their bytes, other values as eight each."""
    size = F.lit(8 * len(df.columns)).cast("long")
    for c in df.columns:
        if isinstance(dtype(df, c), T.StringType):
            size = size + F.coalesce(F.octet_length(col(c)), F.lit(0))
    return df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]


# Up to this many groups, their brackets are a table in the plan.
_LISTED_GROUPS = 4096


def _brackets_kept(state: DataFrame, few: bool) -> tuple[DataFrame, bool]:
    """The table of groups, computed now, and whether it has at most _LISTED_GROUPS rows of bounded size."""
    if few:
        rows = state.limit(_LISTED_GROUPS + 1).collect()
        if len(rows) <= _LISTED_GROUPS:
            return state.sparkSession.createDataFrame(rows, state.schema), True
    return settle(state), False


def group_quantiles(
    long: DataFrame,
    keys: Sequence[str],
    probabilities: Sequence[float],
    names: Sequence[str],
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Exact quantiles of ``x`` per group of ``(keys…, x)`` rows, with ``n`` and further aggregates ``extra``.

    Every group has a mergeable sketch of its own, whose points bracket each
    wanted rank. A counting pass proves the brackets: a rank outside its bracket
    opens it, and a bracket that still holds many rows is narrowed by a sketch of
    its own values, as long as that more than halves it (else its rows are few
    values). Only the values inside the brackets, under a hundredth of a group,
    are then counted and ranked, so no task meets a share of a group that grows
    with it, whatever the number of groups. ``x`` and the keys must not be null.
    """
    group, extra = list(map(quoted, keys)), dict(extra or {})
    number = range(len(probabilities))
    ranks = [min(max(p + side * _RANK_MARGIN, 0.0), 1.0) for p in probabilities for side in (-1, 1)]
    infinite = float("inf")

    def rank(i: int) -> tuple[Column, Column]:
        place = F.lit(float(probabilities[i])) * (F.col("n") - 1)
        return F.floor(place), F.ceil(place)

    sketched = long.groupBy(*group).agg(
        F.count("x").alias("n"), _sketch(F.col("x")).alias("__s"), *[c.alias(k) for k, c in extra.items()])
    pointed = sketched.withColumn("__p", _sketch_points("__s", ranks)).drop("__s")
    # The margin means less than two rows in a small group: take them all. So does a group without finite values.
    few = (F.col("n") * _RANK_MARGIN < 2) | F.col("__p").isNull()
    state, listed = _brackets_kept(pointed.select(
        *group, "n", *extra,
        *[F.when(few, -infinite).otherwise(F.get("__p", F.lit(2 * i))).alias(f"low{i}") for i in number],
        *[F.when(few, infinite).otherwise(F.get("__p", F.lit(2 * i + 1))).alias(f"high{i}") for i in number],
        *[F.lit(None).cast("long").alias(f"was{i}") for i in number],
    ), few=True)
    small = table_bytes(state) <= BROADCAST_BYTES

    def with_state(columns: Sequence[str]) -> DataFrame:
        side = state.select(*group, *columns)
        return long.join(F.broadcast(side) if small else side, list(keys))

    def holds(i: int) -> Column:
        return (F.col("x") >= F.col(f"low{i}")) & (F.col("x") <= F.col(f"high{i}"))

    bounds = [f"{side}{i}" for i in number for side in ("low", "high")]
    for turn in itertools.count():
        counted = with_state(bounds).groupBy(*group).agg(
            *[F.count_if(F.col("x") < F.col(f"low{i}")).alias(f"before{i}") for i in number],
            *[F.count_if(holds(i)).alias(f"inside{i}") for i in number])
        bare = state.drop(*[f"{c}{i}" for c in ("before", "inside") for i in number])
        state, listed = _brackets_kept(F.broadcast(bare).join(counted, list(keys)) if listed else bare.join(counted, list(keys)), listed)
        below = [rank(i)[0] < F.col(f"before{i}") for i in number]
        above = [rank(i)[1] >= F.col(f"before{i}") + F.col(f"inside{i}") for i in number]
        shrinks = [F.col(f"was{i}").isNull() | (2 * F.col(f"inside{i}") < F.col(f"was{i}")) for i in number]
        # Sketches that fail again and again are not asked further: brackets are then ranked as they are.
        wide = [F.lit(turn < _NARROW_TURNS) & ~below[i] & ~above[i] & (F.col(f"inside{i}") > BRACKET_VALUES) & (F.col(f"low{i}") < F.col(f"high{i}")) & shrinks[i]
                for i in number]
        missed, large = state.agg(
            F.count_if(F.array_max(F.array(*[b | a for b, a in zip(below, above)]))),
            F.count_if(F.array_max(F.array(*wide)))).first()
        if not missed and not large:
            break
        narrowed = state
        if large:
            marked = state.select(*group, "n", *bounds, *[f"{c}{i}" for i in number for c in ("before", "inside")],
                                  *[w.alias(f"wide{i}") for i, w in enumerate(wide)])
            inside = long.join(F.broadcast(marked) if small else marked, list(keys)).groupBy(*group).agg(
                *[_sketch(F.when(F.col(f"wide{i}") & holds(i), F.col("x"))).alias(f"s{i}") for i in number])
            grid = [k / _NARROW_STEPS for k in range(_NARROW_STEPS + 1)]
            inside = inside.select(*group, *[_sketch_points(f"s{i}", grid).alias(f"s{i}") for i in number])
            narrowed = state.join(inside, list(keys), "left")
        columns = {}
        for i in number:
            low, high, size = F.col(f"low{i}"), F.col(f"high{i}"), F.col(f"inside{i}")
            new_low = F.when(below[i], -infinite).otherwise(low)
            new_high = F.when(above[i], infinite).otherwise(high)
            if large:
                margin = F.greatest(F.lit(_RANK_MARGIN), 2.0 / size)
                share = lambda place: F.least(F.greatest(place, F.lit(0.0)), F.lit(1.0))
                first = share((rank(i)[0] - F.col(f"before{i}")) / size - margin)
                last = share((rank(i)[1] - F.col(f"before{i}") + 1) / size + margin)
                has = wide[i] & F.col(f"s{i}").isNotNull()
                # The grid's points around both ends.
                new_low = F.when(has, F.get(f"s{i}", F.floor(first * _NARROW_STEPS).cast("int"))).otherwise(new_low)
                new_high = F.when(has, F.get(f"s{i}", F.ceil(last * _NARROW_STEPS).cast("int"))).otherwise(new_high)
            columns |= {f"low{i}": new_low, f"high{i}": new_high, f"was{i}": F.when(wide[i], size)}
        state, listed = _brackets_kept(narrowed.select(*group, "n", *extra, *[c.alias(k) for k, c in columns.items()]), listed)

    owners = F.array_compact(F.array(*[
        F.when(holds(i), F.struct(F.lit(i).alias("i"), F.col(f"before{i}").alias("before"))) for i in number]))
    owned = F.lit(False)
    for i in number:
        owned |= holds(i)
    rows = with_state(["n", *bounds, *[f"before{i}" for i in number]]).where(owned)
    counts = rows.select(*group, "n", "x", F.inline(owners)).groupBy(*group, "n", "i", "before", "x").agg(F.count(F.lit(1)).alias("times"))
    order = Window.partitionBy(*group, "i").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    spans = counts.withColumn("upto", F.col("before") + F.sum("times").over(order)).withColumn("from", F.col("upto") - F.col("times"))

    def at(i: int, place: Column) -> Column:
        return F.max(F.when((F.col("i") == i) & (F.col("from") <= place) & (place < F.col("upto")), F.col("x")))

    found = spans.groupBy(*group, "n").agg(*[at(i, rank(i)[side]).alias(f"{'lh'[side]}{i}") for i in number for side in (0, 1)])
    interpolated = []
    for i, name in enumerate(names):
        place = F.lit(float(probabilities[i])) * (F.col("n") - 1)
        low, high = F.col(f"l{i}"), F.col(f"h{i}")
        # Equal neighbours first: infinite ones have no difference.
        interpolated.append(F.when(low == high, low).otherwise(low + (high - low) * (place - F.floor(place))).alias(name))
    found = found.select(*group, "n", *interpolated)
    return found.join(state.select(*group, *extra), list(keys)) if extra else found


def _melt(
    df: DataFrame, by: Sequence[str], columns: Sequence[str], groups: Sequence[Sequence[str]], names: Sequence[str]
) -> DataFrame:
    """Turn several value columns into rows ``(by…, column, names…)`` without nulls."""
    if len(columns) == 1:
        out = df.select(
            *map(quoted, by), F.lit(columns[0]).alias("column"),
            *[F.col(c).alias(n) for c, n in zip(groups[0], names)],
        )
    else:
        entries = [
            F.struct(F.lit(c).alias("column"), *[F.col(g).alias(n) for g, n in zip(group, names)])
            for c, group in zip(columns, groups)
        ]
        out = df.select(*map(quoted, by), F.inline(F.array(*entries)))
    return out.where(F.col(names[0]).isNotNull())


def value_counts(df: DataFrame, column: str, by: Sequence[str] = (), name: str = "count") -> DataFrame:
    """Distinct values with their counts, nulls left out."""
    return (
        df.where(~is_missing(df, column))
        .groupBy(*map(quoted, [*by, column]))
        .agg(F.count(F.lit(1)).alias(name))
    )


def look_up(df: DataFrame, table: DataFrame, key: str, count: str, distinct: int) -> DataFrame:
    """Join a table that holds one row per value of ``key`` and the value's count.

    ``distinct`` is the (estimated) size of the table. A small table is
    broadcast. Beyond that the values holding at least 1/256 of the rows are
    read first, at most 256 rows, and broadcast; the rows they serve are spread
    over the shuffle by a hash of their own, so no value, however frequent,
    meets in one task.
    """
    payload = [c for c in table.columns if c not in (key, count)]
    small = distinct <= BROADCAST_ROWS
    if small and any(isinstance(dtype(table, c), T.StringType) for c in table.columns):
        small = table_bytes(table) <= BROADCAST_BYTES
    if small:
        renamed = table.select(col(key).alias("__key"), *map(quoted, payload))
        return df.join(F.broadcast(renamed), col(key) == F.col("__key"), "left").drop("__key")
    rows = df.agg(F.count(F.lit(1))).first()[0]
    frequent = F.col(count) * _HOT_LEVELS >= rows
    hot_rows = table.where(frequent).select(quoted(key), *map(quoted, payload)).collect()
    cold = table.where(~frequent).select(
        col(key).alias("__key"), F.xxhash64(col(key)).alias("__lane_of"), *map(quoted, payload)
    )
    lane = F.xxhash64(col(key))
    out = df
    if hot_rows:
        named = table.select(col(key).alias("__hot_key"), *[col(c).alias(f"__hot_{c}") for c in payload])
        hot = df.sparkSession.createDataFrame(hot_rows, named.schema).withColumn("__served", F.lit(True))
        out = df.join(F.broadcast(hot), col(key) == F.col("__hot_key"), "left")
        lane = F.when(F.col("__served"), F.xxhash64(*[col(c) for c in df.columns], F.lit(1))).otherwise(lane)
    joined = out.withColumn("__lane", lane).join(
        cold, (col(key) == F.col("__key")) & (F.col("__lane") == F.col("__lane_of")), "left"
    )
    found = {c: F.coalesce(col(f"__hot_{c}"), col(c)) if hot_rows else col(c) for c in payload}
    return joined.select(*map(quoted, df.columns), *[found[c].alias(c) for c in payload])


def scatter(df: DataFrame, *keys: Column) -> DataFrame:
    """Spread rows that each stand for much work; the fixed number of partitions
    keeps adaptive execution from merging them again for their small size."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.repartition(partitions, *keys)


def spread_range(first: Column, last: Column, block: int = 65536) -> tuple[Column, Column]:
    """Two explode steps for a long run of integers: blocks, then numbers in a block.

    Returns the array of block starts and, given a column ``__start`` exploded
    from it, the array of numbers of that block up to ``last``.
    """
    starts = F.sequence(first, last, F.lit(block).cast("long"))
    numbers = F.sequence(F.col("__start"), F.least(F.col("__start") + F.lit(block - 1), last))
    return starts, numbers
