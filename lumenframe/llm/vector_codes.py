"""Vector compression: each vector as one byte a part, by codebooks learned from all vectors.

Vectors are integers (4096 times the components, rounded down) cut into ``PARTS`` equal parts; each part position has a
codebook of ``ENTRIES`` entries, refined over ``ROUNDS`` rounds. The nearest entry is found by slicing and intersecting:
in every dimension the entries' coordinates are sorted, and each place in that order carries the mask of the entries
before it. A part within a radius of an entry is within it in each dimension, so two look-ups a dimension give the mask
of the entries in that dimension's slice, and the masks of all dimensions, ANDed, leave the candidates. The first radius
is a guess from the codebook. Where the best candidate is not within the radius, its distance is the next radius; where
there is none, the radius doubles. So the entry found is the nearest one, whatever the first radius was.

A round is one pass over the table: each task adds up its own parts by entry, and only those sums, of a size set by the
codebooks, are shuffled and read by the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenframe.llm.common import shared, stored

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Parts looked up at once.
BLOCK_ROWS = 8192

_FAR = np.iinfo(np.int64).max


class Slices:
    """One part position's codebook, of at most 64 entries, for look-ups by slices."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        order = np.argsort(entries, axis=0, kind="stable")
        self.coordinates = np.take_along_axis(entries, order, axis=0)
        none = np.zeros((1, entries.shape[1]), dtype=np.uint64)
        self.before = np.concatenate([none, np.bitwise_or.accumulate(np.uint64(1) << order.astype(np.uint64), axis=0)])
        self.radius = self._guess()

    def _guess(self) -> int:
        """About the distance at which an entry's slice begins to hold its neighbours."""
        if len(self.entries) < 2:
            return 1
        between = ((self.entries[:, None] - self.entries) ** 2).sum(axis=2)
        np.fill_diagonal(between, _FAR)
        return math.isqrt(int(np.median(between.min(axis=1)))) // 2 + 1

    def masks(self, parts: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """For each part, the entries that differ from it by at most its radius in every dimension."""
        mask = np.full(len(parts), ~np.uint64(0))
        for j in range(parts.shape[1]):
            low = np.searchsorted(self.coordinates[:, j], parts[:, j] - radius, side="left")
            high = np.searchsorted(self.coordinates[:, j], parts[:, j] + radius, side="right")
            mask &= self.before[high, j] & ~self.before[low, j]
        return mask

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each part's nearest entry (of equally near ones the first) and squared distance."""
        codes, errors = np.empty(len(parts), dtype=np.int64), np.empty(len(parts), dtype=np.int64)
        open_rows, radius = np.arange(len(parts)), np.full(len(parts), self.radius, dtype=np.int64)
        numbers = np.arange(len(self.entries), dtype=np.uint64)
        while len(open_rows):
            own = parts[open_rows]
            row, entry = np.nonzero((self.masks(own, radius)[:, None] >> numbers) & np.uint64(1))
            away = np.full((len(own), len(numbers)), _FAR)
            away[row, entry] = ((own[row] - self.entries[entry]) ** 2).sum(axis=1)
            best = away.argmin(axis=1)
            low = away[np.arange(len(own)), best]
            codes[open_rows], errors[open_rows] = best, low
            # An entry outside the box is farther than the radius in one dimension alone.
            unsure = low > radius**2
            # The root of the best distance, rounded up, holds every entry at most as far; without candidates try twice the radius.
            bound = np.sqrt(np.where(low == _FAR, 0, low).astype(np.float64)).astype(np.int64) + 2
            radius = np.where(low == _FAR, 2 * radius, bound)[unsure]
            open_rows = open_rows[unsure]
        return codes, errors


def _parts_of(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """(rows, parts, width) from a column of lists that all have parts * width values."""
    column = batch.column("x")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), PARTS, width)


def _sums_by_entry(books, width: int):
    """Per task, the number and the sums of the parts nearest to each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in books()]
        count = np.zeros((PARTS, ENTRIES), dtype=np.int64)
        sums = np.zeros((PARTS, ENTRIES, width), dtype=np.int64)
        for batch in batches:
            parts = _parts_of(batch, width)
            for start in range(0, len(parts), BLOCK_ROWS):
                for p, one in enumerate(slices):
                    own = parts[start : start + BLOCK_ROWS, p]
                    codes, _ = one.nearest(own)
                    count[p] += np.bincount(codes, minlength=ENTRIES)
                    np.add.at(sums[p], codes, own)
        part, entry = np.nonzero(count)
        values = pa.array(list(np.concatenate([count[part, entry, None], sums[part, entry]], axis=1)), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), values], names=["part", "entry", "values"])

    return run


def _coded(books, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in books()]
        for batch in batches:
            parts = _parts_of(batch, width)
            codes, error = np.empty((len(parts), PARTS), dtype=np.uint8), np.zeros(len(parts), dtype=np.int64)
            for start in range(0, len(parts), BLOCK_ROWS):
                at = slice(start, start + BLOCK_ROWS)
                for p, one in enumerate(slices):
                    codes[at, p], away = one.nearest(parts[at, p])
                    error[at] += away
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)],
                names=["vec_id", "label", "code", "error"])

    return run


def integer_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, x) of the vectors that are not null and hold only finite components; x holds longs."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    scaled = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE))
    return embeddings.where(v.isNotNull() & finite).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), scaled.alias("x"))


def learn(rows: DataFrame, width: int) -> list[np.ndarray]:
    """The codebooks, one (entries, width) array a part position, from all rows of (vec_id, label, x)."""
    first = rows.where("vec_id is not null").orderBy("vec_id", "x").limit(ENTRIES).select("x").collect()
    start = np.array([r.x for r in first], dtype=np.int64).reshape(len(first), PARTS, width)
    books = [start[:, p].copy() for p in range(PARTS)]
    for _ in range(ROUNDS if len(first) else 0):
        local = rows.select("x").mapInArrow(_sums_by_entry(shared(rows.sparkSession, books), width), "part int, entry int, values array<long>")
        total = local.select("part", "entry", F.posexplode("values").alias("place", "value")).groupBy("part", "entry", "place").agg(F.sum("value").alias("value"))
        sums = np.zeros((PARTS, ENTRIES, width + 1), dtype=np.int64)
        # Parts x entries x (width + 1) numbers.
        for r in total.collect():
            sums[r.part, r.entry, r.place] = r.value
        for p, book in enumerate(books):
            used = np.flatnonzero(sums[p, :, 0])
            books[p] = book.copy()
            books[p][used] = sums[p, used, 1:] // sums[p, used, :1]
    return books


def codebooks_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(c) for book in books for c in book.ravel().tolist()).encode()).hexdigest()


def compress(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """One row per kept vector, (vec_id, label, code binary, error long), and the codebooks.

    Vectors that are null or hold a null or non-finite component are left out. The codebooks start from the smallest
    ids; rows without an id take no part in that start but in everything else. Rows repeated with one id are vectors of
    their own, ordered by their components. With fewer than ``ENTRIES`` vectors the codebooks are that much smaller; an
    empty table has empty codebooks and no rows. Vectors must have the length of the one with the smallest id, which must
    be a multiple of ``PARTS``, and components whose squared distances fit 64 bits: any other vector teaches nothing and
    has a null code and error. Other columns are not read.
    """
    rows = stored(integer_vectors(embeddings, id_col, vector_col, label_col), "vectors")
    schema = rows.select("vec_id", "label").schema.simpleString()[len("struct<"):-1].replace(":", " ")
    fits = rows.where((F.size("x") > 0) & (F.size("x") % PARTS == 0))
    head = fits.where("vec_id is not null").orderBy("vec_id", "x").select(F.size("x").alias("n")).first()
    size = head.n if head else PARTS
    limit = math.isqrt((1 << 61) // size) // 2
    usable = (F.size("x") == size) & F.forall("x", lambda c: F.abs(c) <= limit)
    width = size // PARTS
    books = learn(rows.where(usable), width)
    if not len(books[0]):
        return rows.select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")), books
    coded = rows.where(usable).mapInArrow(_coded(shared(rows.sparkSession, books), width), f"{schema}, code binary, error long")
    return coded.unionByName(rows.where(~usable), allowMissingColumns=True).drop("x"), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kept row of embeddings with its code, error, its label's error and the codebooks' digest."""
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    coded = stored(coded, "codes")
    by_label = stored(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of_label"), "errors")
    # One row a label on the right: frequent labels on the left can be split over tasks.
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("of_label")), "left")
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds one after another; each is a table of part, entry, place, value."""
    kept = ("SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(4096 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings "
            "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0")
    steps = [f"v AS MATERIALIZED ({kept})",
             f"parts AS MATERIALIZED (SELECT v.vec_id, v.x, p, x[p * (len(x) // {PARTS}) + 1 : (p + 1) * (len(x) // {PARTS})] AS part FROM v, range({PARTS}) AS r(p))",
             f"first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id, x) - 1 AS e FROM v ORDER BY vec_id, x LIMIT {ENTRIES})",
             "b0 AS MATERIALIZED (SELECT p, e, part AS entry FROM parts JOIN first USING (vec_id))"]
    distance = "list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, p, part, min_by(e, (d, e)) AS e, min(d) AS d FROM "
                     f"(SELECT vec_id, parts.p, part, e, CAST({distance} AS BIGINT) AS d FROM parts JOIN b{k} ON parts.p = b{k}.p) GROUP BY vec_id, p, part)")
        if k < ROUNDS:
            steps.append(f"s{k} AS (SELECT p, e, j, CAST(sum(part[j]) AS BIGINT) AS s, count(*) AS n FROM a{k}, (SELECT unnest(range(1, (SELECT max(len(part)) FROM parts) + 1)) AS j) GROUP BY p, e, j)")
            steps.append(f"m{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS entry FROM s{k} GROUP BY p, e)")
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b{k}.p, b{k}.e, coalesce(m{k}.entry, b{k}.entry) AS entry FROM b{k} LEFT JOIN m{k} ON b{k}.p = m{k}.p AND b{k}.e = m{k}.e)")
    last = f"a{ROUNDS}"
    steps.append(f"o AS (SELECT vec_id, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM {last} GROUP BY vec_id)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) AS digest FROM b{ROUNDS})")
    return ("WITH " + ",\n".join(steps) + "\nSELECT o.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, "
            "digest AS codebooks_sha256 FROM o JOIN v USING (vec_id), h")


SQL = _sql()
