"""Near duplicates by MinHash signatures and a multi-index Hamming join.

A signature has ``POSITIONS`` b-bit symbols, one per MinHash function; two documents' signatures differ in about
``POSITIONS * (1 - similarity)`` places. Pairs that differ in at most ``MAX_DISTANCE`` places are candidates, and the
join finds every one of them: the signature is cut into ``BANDS`` chunks, and by the pigeonhole principle such a pair
has at least ``BANDS - MAX_DISTANCE`` (6) chunks without an error, so it meets in the bucket of one of them. No error is
left to allow within a chunk. This holds for distances in the 16-bit symbols that chunks are cut from; distances are counted
in their low 8 bits, where unlike symbols agree once in 256, so a pair near the limit may have fewer clean chunks.
Candidates are confirmed on their full shingle sets.

Work in large buckets stays bounded. Documents with equal sets are one class before the join. Buckets above
``BUCKET_ROWS`` are refined: the six clean chunks fall into five groups of chunks, so two lie in one group and the pair
also meets in a bucket keyed by two chunks of a group. Buckets that are still large hold thousands of near copies; they
are dealt into random blocks. The first pass only asks each bucket or block for a spanning forest by distance, which
joins up groups of copies at a linear number of pairs. All other near pairs lie inside the clusters that these forests
span. The second pass takes the clusters that still hold several components and compares all members of different
components there, block by block, on signatures and then on full sets, and returns only links that join components up.
So no link between components is lost, and a cluster that is one component costs nothing more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf

from lumenframe.llm.common import components, stored, structs, texts_of
from lumenframe.llm.shingles import shingle_sets
from lumenframe.schema import fresh_name

WORDS = 5
MIN_SIMILARITY_PERCENT = 80
POSITIONS = 64
#: Two symbols a chunk.
BANDS = 32
#: Pairs at a similarity of 0.8 differ in 12.8 places on average with a deviation of 3.2: 26 is over four deviations up.
MAX_DISTANCE = 26
BANDS_IN_GROUP = 7
BUCKET_ROWS = 2048
#: Documents of a cluster, with their full sets, that one task of the second pass compares.
CLUSTER_ROWS = 512
#: Random dealings of a large bucket in the first pass.
DEALINGS = 2
#: Ids that a broadcast holds to pick texts by; with more, the join is left to Spark, which may shuffle the texts.
BROADCAST_IDS = 1 << 20

_SET = "struct<n:int,digest:binary,signature:binary,bands:array<long>>"


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20240607)
    return (random.integers(1, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            random.integers(0, 1 << 63, POSITIONS, dtype=np.uint64))


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The 16-bit symbols of a non-empty set."""
    low = np.full(POSITIONS, 0xFFFFFFFF, dtype=np.uint64)
    for start in range(0, len(shingles), 4096):
        part = shingles[start : start + 4096, None] * a
        part += b
        part >>= np.uint64(32)
        np.minimum(low, part.min(axis=0), out=low)
    return (low & np.uint64(0xFFFF)).astype(np.uint16)


def _sets_udf(words: int):
    @arrow_udf(_SET)
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        a, b = _permutations()
        places = np.arange(BANDS, dtype=np.int64) << 32
        for batch in batches:
            n, digest, symbols, bands = [], [], [], []
            for own in shingle_sets((t.encode() for t in texts_of(batch)), words):
                n.append(len(own))
                if not len(own):
                    digest.append(None), symbols.append(None), bands.append(None)
                    continue
                digest.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                s = signature(own, a, b)
                symbols.append((s & np.uint16(0xFF)).astype(np.uint8).tobytes())
                pairs = s.astype(np.int64).reshape(BANDS, 2)
                bands.append(places | (pairs[:, 0] << 16) | pairs[:, 1])
            yield structs(n=pa.array(n, pa.int32()), digest=pa.array(digest, pa.binary()),
                          signature=pa.array(symbols, pa.binary()), bands=pa.array(bands, pa.list_(pa.int64())))

    return sets


def _full_sets_udf(words: int):
    @arrow_udf("array<long>")
    def full(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([s.view(np.int64) for s in shingle_sets((t.encode() for t in texts_of(batch)), words)],
                           pa.list_(pa.int64()))

    return full


def _forest(signatures: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges of at most MAX_DISTANCE of a minimum spanning forest."""
    n = len(signatures)
    nearest = (signatures != signatures[0]).sum(axis=1)
    parent = np.zeros(n, dtype=np.int64)
    outside = np.ones(n, dtype=bool)
    outside[0] = False
    for _ in range(n - 1):
        k = int(np.argmin(np.where(outside, nearest, POSITIONS + 1)))
        if nearest[k] <= MAX_DISTANCE:
            yield int(parent[k]), k
        outside[k] = False
        away = (signatures != signatures[k]).sum(axis=1)
        closer = outside & (away < nearest)
        nearest[closer] = away[closer]
        parent[closer] = k


def _by_bucket(batches: Iterator[pa.RecordBatch], pairs) -> Iterator[pa.RecordBatch]:
    """``pairs`` of whole buckets, from rows sorted by bucket; a bucket has a bounded number of rows."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def found(table: pa.Table) -> pa.RecordBatch:
        edges = pairs(table.combine_chunks())
        edges = np.unique(np.sort(edges, axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], schema=schema)

    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        bucket = held["bucket"].to_numpy()
        if not len(bucket):
            continue
        # The last bucket may go on in the next batch.
        whole = int(np.searchsorted(bucket, bucket[-1], side="left"))
        if whole:
            yield found(held.slice(0, whole))
            held = held.slice(whole)
    if held is not None and held.num_rows:
        yield found(held)


def _opened(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """The representatives, their signatures, and each bucket's first and last row."""
    bucket = table["bucket"].to_numpy()
    signatures = np.frombuffer(b"".join(table["signature"].to_pylist()), dtype=np.uint8).reshape(-1, POSITIONS)
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    return table["rep"].to_numpy(), signatures, list(zip(starts.tolist(), np.append(starts[1:], len(bucket)).tolist()))


def _forests(table: pa.Table) -> np.ndarray:
    rep, signatures, buckets = _opened(table)
    two = np.array([start for start, end in buckets if end - start == 2], dtype=np.int64)
    two = two[(signatures[two] != signatures[two + 1]).sum(axis=1) <= MAX_DISTANCE]
    found = [np.stack([rep[two], rep[two + 1]], axis=1)]
    for start, end in buckets:
        if end - start > 2:
            edges = np.array(list(_forest(signatures[start:end])), dtype=np.int64).reshape(-1, 2)
            found.append(rep[start:end][edges])
    return np.concatenate(found)


def _confirmed_across(table: pa.Table) -> np.ndarray:
    """Confirmed links between components, as many as it takes to join them up."""
    rep, signatures, buckets = _opened(table)
    component = table["component"].to_numpy()
    lists = table["shingles"].combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    sets = [np.sort(lists[k].values.to_numpy()) for k in range(len(lists))]
    sizes = np.array([len(s) for s in sets])
    found = []
    for start, end in buckets:
        root = {int(c): int(c) for c in component[start:end]}

        def top(c: int, root=root) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        for k in range(start, end - 1):
            rest = slice(k + 1, end)
            away = (signatures[rest] != signatures[k]).sum(axis=1)
            fit = (component[rest] != component[k]) & (away <= MAX_DISTANCE)
            fit &= 100 * np.minimum(sizes[rest], sizes[k]) >= MIN_SIMILARITY_PERCENT * np.maximum(sizes[rest], sizes[k])
            at = np.flatnonzero(fit)
            for j in (at[np.argsort(away[at], kind="stable")] + k + 1).tolist():
                left, right = top(int(component[k])), top(int(component[j]))
                if left != right:
                    common = len(np.intersect1d(sets[k], sets[j], assume_unique=True))
                    if 100 * common >= MIN_SIMILARITY_PERCENT * (sizes[k] + sizes[j] - common):
                        root[max(left, right)] = min(left, right)
                        found.append((rep[k], rep[j]))
    return np.array(found, dtype=np.int64).reshape(-1, 2)


def _pairs_of(rows: DataFrame, pairs) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _by_bucket(batches, pairs)

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long").where("a < b").distinct()


def _open_rows(members: DataFrame) -> DataFrame:
    """(bucket, rep, component) such that any two members of a cluster but of different components share a bucket.

    Clusters of one component are left out. A cluster above CLUSTER_ROWS is cut into blocks: those of its largest
    component meet the others, and the others meet each other too.
    """
    parts = members.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = parts.groupBy("cluster").agg(
        F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("parts"))
    sizes = stored(sizes.where("parts > 1").select(
        "cluster", "all", F.col("top.component").alias("main"),
        F.ceil(2 * F.col("top.n") / CLUSTER_ROWS).alias("main_blocks"),
        F.ceil(2 * (F.col("all") - F.col("top.n")) / CLUSTER_ROWS).alias("other_blocks")), "clusters")
    rows = members.join(sizes, "cluster")
    small = rows.where(F.col("all") <= CLUSTER_ROWS).select(F.xxhash64("cluster").alias("bucket"), "rep", "component")
    big = rows.where(F.col("all") > CLUSTER_ROWS)
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    in_main = F.pmod(F.xxhash64("rep"), F.col("main_blocks"))
    in_other = F.pmod(F.xxhash64("rep"), F.col("other_blocks"))
    main = F.transform(numbers("other_blocks"), lambda i: F.xxhash64("cluster", F.lit("main"), i, in_main))
    other = F.concat(
        F.transform(numbers("main_blocks"), lambda j: F.xxhash64("cluster", F.lit("main"), in_other, j)),
        F.transform(numbers("other_blocks"), lambda k: F.xxhash64("cluster", F.lit("other"), F.least(k, in_other), F.greatest(k, in_other))))
    big = big.select(F.explode(F.when(F.col("component") == F.col("main"), main).otherwise(other)).alias("bucket"), "rep", "component")
    return small.unionByName(big)


def _missing_links(rows: DataFrame) -> DataFrame:
    return stored(_pairs_of(rows.select("bucket", "rep", "component", "signature", "shingles"), _confirmed_across), "missing")


def _counted(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key occurs more than once, with how often as ``times``."""
    counts = stored(rows.groupBy(key).agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "counts")
    return rows.join(counts, key)


def _beside_texts(ids: DataFrame) -> DataFrame:
    """A stored table of ids, to be sent to the texts if its size allows it, so that the texts stay where they are.

    Spark's own limit is on bytes, and a step above it costs a shuffle of all texts.
    """
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per input row: the id, n_shingles, component_id and kept.

    Documents are linked when 100 * |A & B| >= 80 * |A | B| for their sets of distinct ``words``-word shingles;
    ``component_id`` is the smallest id that can be reached over links, the own one included, and ``kept`` says
    whether the row has it. With fewer words, all words are one shingle. Null, empty and blank texts have the empty
    set and are linked with nothing. Ids must be integers; a row whose id is null is linked with nothing, has a null
    component and is kept. Rows repeated with one id count as one document; the last of several texts under one id
    does not replace the others: all of them link. An empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets = stored(base.select("id", _sets_udf(words)("text").alias("s")).select("id", "s.*"), "sets")
    classes = stored(
        sets.where("id is not null and n > 0").groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    held = sets.join(classes, "digest")
    reps = stored(held.where("id = rep").select("rep", "digest", "n", "signature", "bands").dropDuplicates(["digest"]), "reps")
    # Different sets under one id share the representative's name and are linked by it.
    twins = held.select("id", "rep").where("id <> rep")

    bands = reps.select("rep", "digest", F.explode("bands").alias("band"))
    first = stored(_counted(bands, "band"), "bands")
    normal = first.where(f"times <= {BUCKET_ROWS}").select(F.col("band").alias("bucket"), "rep", "digest")
    hot = first.where(f"times > {BUCKET_ROWS}").select("band", "rep", "digest")
    # A pair with two clean chunks in one group meets in the lower one's bucket or, where that is hot, under both.
    group = lambda c: F.floor(F.shiftrightunsigned(c, 32) / BANDS_IN_GROUP)
    mates = F.filter("bands", lambda other: (other > F.col("band")) & (group(other) == group(F.col("band"))))
    refined = hot.join(reps.select("digest", "bands"), "digest").select("rep", "digest", "band", F.explode(mates).alias("other"))
    refined = refined.select("rep", "digest", F.xxhash64("band", "other").alias("fine"))
    fine = stored(_counted(refined, "fine"), "fine")
    normal = normal.unionByName(
        fine.where(f"times <= {BUCKET_ROWS}").select(F.col("fine").alias("bucket"), "rep", "digest"))
    large = fine.where(f"times > {BUCKET_ROWS}")
    # For the forests, a document takes part in one of its large buckets, dealt into blocks.
    block = lambda seed: F.pmod(F.xxhash64("digest", F.lit(seed)), F.ceil(2 * F.col("times") / BUCKET_ROWS))
    once = large.groupBy("rep", "digest").agg(F.min(F.struct("fine", "times")).alias("f")).select("rep", "digest", "f.fine", "f.times")
    rows = normal
    for seed in range(DEALINGS):
        rows = rows.unionByName(once.select(F.xxhash64("fine", F.lit(seed), block(seed)).alias("bucket"), "rep", "digest"))
    signed = reps.select("digest", "signature")

    tried = stored(_pairs_of(rows.join(signed, "digest").select("bucket", "rep", "signature"), _forests), "tried")
    nodes = tried.select(F.col("a").alias("rep")).unionByName(tried.select(F.col("b").alias("rep"))).unionByName(
        large.select("rep")).distinct()
    chosen = reps.join(nodes, "rep", "left_semi").select("rep", "digest", "n")
    # A table of ids alone, so that the texts are not shuffled. Empty sets go after the sets are written, since a
    # filter on them would be moved before the join and hash every text.
    named = stored(chosen.select(F.col("rep").alias("id")).distinct(), "chosen")
    full = base.join(_beside_texts(named), "id", "left_semi").select(F.col("id").alias("rep"), _full_sets_udf(words)("text").alias("shingles"))
    full = stored(full, "full").where(F.size("shingles") > 0)
    if not sets.groupBy("id").count().where("count > 1").isEmpty():
        full = stored(full.dropDuplicates(["rep", "shingles"]), "full")

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = full.select(F.col("rep").alias("a"), F.col("shingles").alias("left"))
        right = full.select(F.col("rep").alias("b"), F.col("shingles").alias("right"))
        both = pairs.join(left, "a").join(right, "b")
        common = F.size(F.array_intersect("left", "right"))
        union = F.size("left") + F.size("right") - common
        return stored(both.where(100 * common >= MIN_SIMILARITY_PERCENT * union).select("a", "b"), "links")

    same_id = twins.select(F.col("rep").alias("a"), F.col("id").alias("b"))
    links = stored(confirmed(tried).unionByName(same_id.join(reps.select(F.col("rep").alias("b")), "b", "left_semi").select("a", "b")), "links")
    labels = components(links)

    # Clusters of everything that could still be linked: the forests span each bucket's near pairs.
    stars = large.groupBy("fine").agg(F.min("rep").alias("a")).join(large.select("fine", F.col("rep").alias("b")), "fine")
    clusters = components(tried.unionByName(stars.select("a", "b"))).withColumnRenamed("component", "cluster")
    members = clusters.withColumnRenamed("node", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    members = stored(members.select("rep", "cluster", F.coalesce("component", "rep").alias("component")), "members")
    rows = _open_rows(members).join(full, "rep").join(reps.select("rep", "signature"), "rep")
    labels = components(links.unionByName(_missing_links(rows)))

    named = stored(
        classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        .select("digest", F.coalesce("component", "rep").alias("component_id")), "named")
    out = sets.join(named, "digest", "left")
    component = F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component_id", "id"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The documents of which one of each group stays, the one with the smallest id, with all their columns.

    Rows without an id stay; rows repeated with one id and text leave one of them. Different texts under one id are
    documents of their own: they are near copies of each other only by their texts, ordered by the texts' hashes.
    """
    own = lambda stem: fresh_name(docs.columns, stem)
    own_id, digest, of_id, of_digest = own("__id"), own("__digest"), own("__of_id"), own("__of_digest")
    ids = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).count()
    if ids.where("count > 1").isEmpty():
        # Those that go are far fewer than those that stay; a null id equals none of them.
        going = stored(near_groups(docs, id_col, text_col, words).where("not kept").select(F.col(id_col).alias(of_id)), "going")
        return docs.join(_beside_texts(going), F.col(id_col).cast("long") == F.col(of_id), "left_anti")
    lone = docs.where(F.col(id_col).isNull())
    rows = docs.where(F.col(id_col).isNotNull()).withColumn(digest, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    texts = rows.select(F.col(id_col).cast("long").alias(own_id), digest, F.col(text_col).alias("text"))
    texts = texts.dropDuplicates([own_id, digest])
    # Numbers in the order of id and hash stand for the ids.
    ranged = texts.repartitionByRange(own_id, digest).sortWithinPartitions(own_id, digest)
    ranged = stored(ranged.withColumn("number", F.monotonically_increasing_id()), "numbered")
    winners = near_groups(ranged, "number", "text", words).where("kept").select("number")
    kept = stored(ranged.join(winners, "number", "left_semi").select(F.col(own_id).alias(of_id), F.col(digest).alias(of_digest)), "kept")
    out = rows.join(kept, (F.col(id_col).cast("long") == F.col(of_id)) & (F.col(digest) == F.col(of_digest)), "left_semi")
    return out.dropDuplicates([id_col, digest]).drop(digest).unionByName(lone)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its near-duplicate component, on four-word shingles."""
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)
