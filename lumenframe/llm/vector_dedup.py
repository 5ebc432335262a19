"""Near duplicates among vectors of one label: product quantisation with inverted lists and an exact rerank.

Equal vectors are one class before anything else. An index, learned from a bounded sample, deals the classes into coarse
lists (the nearest of up to ``MAX_LISTS`` centroids) and codes what remains of each vector in ``SUBSPACES`` bytes. Every
class is an entry of its own list and visits further lists; queries and entries meet by label and list.

No link is lost on the way, whatever the sample was:

* Vectors are compared on the unit sphere, where a cosine of at least ``MIN_COSINE`` is a distance of at most ``REACH``.
  If the nearest centroids of two such vectors differ, the plane halfway between the two centroids parts them, so their
  distances from it add up to at most ``REACH``, and one of them is at most half of it away. So every vector visits the
  lists whose plane is at most ``REACH / 2`` away, and the pair meets in one of the two lists. These are the probes that
  suffice. A pair that meets in both counts in the one with the smaller number.
* A look-up table a query gives its distance to each entry's code. The entry itself lies its own, stored error away from
  the code, so entries whose code is farther than ``REACH`` plus that error are out; the others are candidates.
* Candidates are confirmed by their cosine in double precision.

A list of one label that holds more than a block is dealt into blocks of entries and of queries, and every block of
queries meets every block of entries. Tasks give back the number of links of each vector and a spanning forest, never
the pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf

from lumenframe.llm.common import components, shared, stored

MIN_COSINE = 0.98
REACH = math.sqrt(2 - 2 * MIN_COSINE)
#: The index is learned from about this many numbers (vectors x dimensions), taken by hash; all vectors are indexed.
SAMPLE_VALUES = 1 << 21
#: Dimensions that the index looks at. Distances in the first dimensions never exceed the whole ones.
INDEX_DIMENSIONS = 1024
#: Classes a list, as far as MAX_LISTS allows.
LIST_ROWS = 1024
MIN_LISTS, MAX_LISTS = 8, 2048
SUBSPACES = 8
CODEWORDS = 64
LEARNING_ROUNDS = 8
#: Numbers in a block of entries or queries of one bucket: 16,384 vectors of 64 dimensions.
BLOCK_VALUES = 1 << 20
#: Queries compared with a block at once.
QUERY_ROWS = 256
#: More than rounding can change a distance by.
SLACK = 1e-4


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(points @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)


def centroids(points: np.ndarray, k: int) -> np.ndarray:
    """At most k distinct centroids of a sample, refined a few rounds from its first points."""
    centres = np.unique(points, axis=0) if len(points) <= k else np.unique(points[:k], axis=0)
    for _ in range(LEARNING_ROUNDS):
        own = nearest(points, centres)
        count = np.bincount(own, minlength=len(centres))
        order = np.argsort(own, kind="stable")
        starts = np.searchsorted(own[order], np.flatnonzero(count))
        centres = centres.copy()
        centres[count > 0] = np.add.reduceat(points[order], starts) / count[count > 0, None]
    return np.unique(centres, axis=0)


def unit_rows(lists: pa.Array) -> np.ndarray:
    """Vectors of one length, none of them zero, on the unit sphere."""
    v = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


@dataclass(frozen=True)
class Index:
    """Coarse centroids, and a codebook a subspace for what remains of a vector after its centroid."""

    coarse: np.ndarray
    words: np.ndarray  # (SUBSPACES, codewords, width)

    def view(self, units: np.ndarray) -> np.ndarray:
        """The dimensions that the index looks at, filled up with zeros."""
        width = self.coarse.shape[1]
        if units.shape[1] >= width:
            return units[:, :width]
        return np.pad(units, ((0, 0), (0, width - units.shape[1])))

    def lists(self, view: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's own list, and a table of the lists it visits."""
        fit = view @ self.coarse.T - 0.5 * (self.coarse**2).sum(axis=1)
        own = fit.argmax(axis=1)
        between = np.sqrt(np.maximum(((self.coarse**2).sum(axis=1)[:, None] + (self.coarse**2).sum(axis=1) - 2 * self.coarse @ self.coarse.T), 0))
        gap = fit[np.arange(len(view)), own][:, None] - fit
        visits = gap <= (REACH / 2 + SLACK) * between[own] + 1e-9
        visits[np.arange(len(view)), own] = False
        return own, visits

    def codes(self, view: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's code after its list's centroid, and how far the vector is from it."""
        rest = (view - self.coarse[own]).reshape(len(view), SUBSPACES, -1)
        codes = np.stack([nearest(rest[:, m], self.words[m]) for m in range(SUBSPACES)], axis=1)
        missed = rest - self.words[np.arange(SUBSPACES), codes]
        return codes.astype(np.uint8), np.sqrt((missed**2).sum(axis=(1, 2)))

    def tables(self, view: np.ndarray, number: int) -> np.ndarray:
        """(subspace, query, codeword): squared distances of queries, seen from a list, to the codewords."""
        rest = (view - self.coarse[number]).reshape(len(view), SUBSPACES, -1)
        return np.stack([(rest[:, m] ** 2).sum(axis=1)[:, None] - 2 * rest[:, m] @ self.words[m].T + (self.words[m] ** 2).sum(axis=1)
                         for m in range(SUBSPACES)]).astype(np.float32)


def learn(sample: np.ndarray, lists: int) -> Index:
    """An index from unit vectors whose length is a multiple of SUBSPACES."""
    coarse = centroids(sample, lists)
    rest = (sample - coarse[nearest(sample, coarse)]).reshape(len(sample), SUBSPACES, -1)
    books = [centroids(rest[:, m], CODEWORDS) for m in range(SUBSPACES)]
    most = max(map(len, books))
    # Repeating a codeword changes nothing.
    return Index(coarse, np.stack([np.concatenate([b, np.repeat(b[:1], most - len(b), axis=0)]) for b in books]))


def _digest_udf():
    @arrow_udf("binary")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for value in batch:
                row = value.values.to_numpy(zero_copy_only=False).astype(np.float64) if value.is_valid else np.empty(0)
                usable = len(row) and np.isfinite(row).all() and row.any()
                out.append(hashlib.blake2b((row + 0.0).tobytes(), digest_size=16).digest() if usable else None)
            yield pa.array(out, pa.binary())

    return digest


def _encoded(index):
    """Classes with their list, visited lists, code and error, from rows of any vector lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_index = index()
        for batch in batches:
            n = batch.column("n").to_numpy()
            for length in np.unique(n):
                part = batch.filter(pa.array(n == length))
                view = own_index.view(unit_rows(part.column("vector")))
                own, visits = own_index.lists(view)
                codes, error = own_index.codes(view, own)
                visited = pa.array([np.flatnonzero(row).astype(np.int32) for row in visits], pa.list_(pa.int32()))
                columns = [part.column(c) for c in part.schema.names]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(own.astype(np.int32)), visited, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)],
                    names=[*part.schema.names, "list", "visits", "code", "error"])

    return run


def _joined_up(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each member's component, after the links (a, b)."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


def _bucket_links(table: pa.Table, index: Index) -> pa.RecordBatch:
    """(node, links, to): the number of linked rows, and the first node of the component within the bucket."""
    node, number = table["node"].to_numpy(), int(table["list"][0].as_py())
    times, home = table["times"].to_numpy(), table["home"].to_numpy()
    entry, query = np.flatnonzero(table["is_entry"].to_numpy()), np.flatnonzero(table["is_query"].to_numpy())
    units = unit_rows(table["vector"].combine_chunks())
    codes = np.frombuffer(b"".join(table["code"].to_pylist()), dtype=np.uint8).reshape(-1, SUBSPACES)[entry]
    limit = ((REACH + SLACK + table["error"].to_numpy()[entry]) ** 2 + SLACK).astype(np.float32)
    lists = len(index.coarse)
    visits = table["visits"].combine_chunks()
    visits = visits.take(pa.array(entry))
    visitor_pairs = np.repeat(np.arange(len(entry)), pa.compute.list_value_length(visits).to_numpy(zero_copy_only=False)) * lists + visits.flatten().to_numpy()
    links, label = np.zeros(len(node), dtype=np.int64), np.arange(len(node))
    for start in range(0, len(query), QUERY_ROWS):
        own = query[start : start + QUERY_ROWS]
        look = index.tables(index.view(units[own]), number)
        away = look[0][:, codes[:, 0]]
        for m in range(1, SUBSPACES):
            away += look[m][:, codes[:, m]]
        candidate = away <= limit
        some = np.flatnonzero(candidate.any(axis=0))
        if not len(some):
            continue
        linked = candidate[:, some] & (units[own] @ units[entry[some]].T >= MIN_COSINE)
        q, e = np.nonzero(linked)
        e = some[e]
        a, b = own[q], entry[e]
        # Within the list each pair once. A visitor's pair goes to the other list if that has the smaller number and the entry visits it.
        elsewhere = (home[a] < number) & np.isin(e * lists + home[a], visitor_pairs)
        keep = np.where(home[a] == number, node[b] < node[a], ~elsewhere)
        a, b = a[keep], b[keep]
        np.add.at(links, a, times[b])
        np.add.at(links, b, times[a])
        label = _joined_up(label, a, b)
    found = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(node[found]), pa.array(links[found]), pa.array(node[label[found]])], names=["node", "links", "to"])


def _links_by_bucket(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_index = index()
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = np.stack([held[c].to_numpy() for c in ("number", "part", "turn")])
            ends = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            # The last bucket may go on in the next batch.
            for start, end in zip([0, *ends[:-1].tolist()], ends.tolist()):
                yield _bucket_links(held.slice(start, end - start), own_index)
            held = held.slice(int(ends[-1])) if len(ends) else held
        if held is not None and held.num_rows:
            yield _bucket_links(held, own_index)

    return run


def _fitted(classes: DataFrame, rows: int) -> Index:
    """The index, from about SAMPLE_VALUES numbers of vectors taken by hash."""
    longest = classes.agg(F.max("n")).first()[0]
    width = -(-min(longest, INDEX_DIMENSIONS) // SUBSPACES) * SUBSPACES
    wanted = max(1, SAMPLE_VALUES // width)
    share = min(1.0, wanted / rows)
    taken = classes if share == 1.0 else classes.where(F.pmod(F.xxhash64("digest", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))
    # In the order of their hashes, so that the centroids start from any of them.
    vectors = F.slice(F.col("vector"), 1, width).alias("view")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + (x / F.col("high")) * (x / F.col("high"))))
    scaled = taken.withColumn("high", F.array_max(F.transform("vector", lambda x: F.abs(x)))).select(
        vectors, (norm * F.col("high")).alias("norm"), F.xxhash64("digest", F.lit("order")).alias("h"))
    table = scaled.toArrow().sort_by("h")
    views, sample = table["view"].combine_chunks(), np.zeros((table.num_rows, width))
    lengths = pa.compute.list_value_length(views).to_numpy(zero_copy_only=False)
    sample[np.arange(width) < lengths[:, None]] = views.flatten().to_numpy()
    sample /= table["norm"].to_numpy()[:, None]
    return learn(sample, min(MAX_LISTS, max(MIN_LISTS, rows // LIST_ROWS)))


def near_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per input row: the id, n_links, component_id and kept.

    Vectors of equal, non-null labels and equal lengths are linked when their cosine, in double precision, is at least
    ``MIN_COSINE``. ``n_links`` is the number of other rows linked directly; ``component_id`` the smallest id that links
    reach, the own one included; ``kept`` says whether the row has it. A vector that is null, empty or zero or holds null
    or non-finite components is linked with nothing, and so is a row without a label. A row without an id is linked with
    nothing, has a null component and is kept. Repeated rows, and different vectors under one id, are rows of their own.
    Ids are integers. An empty table gives an empty result; other columns are not read.
    """
    base = embeddings.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = base.withColumn("digest", F.when(F.col("vec_id").isNotNull() & F.col("label").isNotNull(), _digest_udf()("vector")))
    held = rows.where(F.col("digest").isNotNull()).groupBy("label", "digest").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("times"), F.any_value("vector").alias("vector"))
    classes = stored(held.select(F.monotonically_increasing_id().alias("node"), "*", F.size("vector").alias("n")), "classes")
    spark, count = embeddings.sparkSession, classes.count()
    index = shared(spark, _fitted(classes, count) if count else None)

    columns = "node long, label {}, digest binary, rep long, times long, vector array<double>, n int".format(
        classes.schema["label"].dataType.simpleString())
    encoded = stored(
        classes.mapInArrow(_encoded(index), f"{columns}, list int, visits array<int>, code binary, error double").drop("digest", "rep"), "encoded")
    groups = encoded.groupBy("label", "n", "list").agg(F.count(F.lit(1)).alias("entries"))
    visitors = encoded.select("label", "n", F.explode("visits").alias("list")).groupBy("label", "n", "list").agg(F.count(F.lit(1)).alias("visitors"))
    block = F.greatest(F.lit(64), F.floor(F.lit(BLOCK_VALUES) / F.col("n")))
    groups = groups.join(visitors, ["label", "n", "list"], "left").withColumn("queries", F.col("entries") + F.coalesce("visitors", F.lit(0)))
    groups = stored(groups.where("queries > 1").select(
        F.monotonically_increasing_id().alias("number"), "label", "n", "list",
        F.ceil(F.col("entries") / block).alias("parts"), F.ceil(F.col("queries") / block).alias("turns")), "groups")

    # Entries take their own list's place in its queries, too.
    kinds = F.concat(F.array(F.struct("list", F.lit(True).alias("own"))), F.transform("visits", lambda x: F.struct(x.alias("list"), F.lit(False).alias("own"))))
    meet = encoded.withColumnRenamed("list", "home").withColumn("list", F.col("home"))
    meet = meet.select("node", "label", "n", "times", "vector", "home", "visits", "code", "error", F.explode(kinds).alias("k"))
    meet = meet.select("*", "k.list", "k.own").drop("k").join(groups, ["label", "n", "list"])
    part, turn = F.pmod(F.xxhash64("node"), F.col("parts")), F.pmod(F.xxhash64("node", F.lit("turn")), F.col("turns"))
    numbers = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    place = lambda i, j, entry, query: F.struct(
        i.alias("part"), j.alias("turn"), F.lit(entry).alias("is_entry"), F.lit(query).alias("is_query"))
    one_task = (F.col("parts") == 1) & (F.col("turns") == 1)
    as_query = F.transform(numbers("parts"), lambda i: place(i, turn, False, True))
    as_entry = F.transform(numbers("turns"), lambda j: place(part, j, True, False))
    zero = F.lit(0).cast("long")
    places = (F.when(one_task & F.col("own"), F.array(place(zero, zero, True, True)))
              .when(F.col("own"), F.concat(as_entry, as_query)).otherwise(as_query))
    meet = meet.select("number", "node", "times", "vector", "list", "home", "visits", "code", "error", F.explode(places).alias("p")).select("*", "p.*").drop("p")
    keys = ["number", "part", "turn"]
    found = stored(meet.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_links_by_bucket(index), "node long, links long, to long"), "links")

    labels = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    linked = found.groupBy("node").agg(F.sum("links").alias("links")).join(labels, "node")
    linked = stored(classes.select("node", "label", "digest", "rep", "times").join(linked, "node", "left"), "linked")
    least = linked.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    named = stored(linked.join(least, "component", "left").select(
        F.col("label").alias("of_label"), F.col("digest").alias("of_digest"), F.coalesce("least", "rep").alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links")), "named")
    # One row a class on the right: classes of many copies on the left can be split over tasks.
    out = rows.join(named, (F.col("label") == F.col("of_label")) & (F.col("digest") == F.col("of_digest")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(F.col("vec_id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of embeddings with its number of links and its near-duplicate component."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = f"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= {MIN_COSINE}),
reached AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, (SELECT min(b) FROM reached WHERE a = vec_id) AS component_id,
       vec_id = (SELECT min(b) FROM reached WHERE a = vec_id) AS kept
FROM embeddings
"""
