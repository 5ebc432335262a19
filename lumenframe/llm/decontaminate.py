"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

A test item is short and a document may be long, so the Jaccard similarity of the two says nothing; what counts is the
share of the item's word shingles that the document holds. Items are partitioned by size, in powers of two. In a
partition, an item's sketch is the part of its shingle hashes below a limit that belongs to the partition (all of them
for small items), so that every sketch has about ``SKETCH`` hashes whatever the item's length, and a document, of any
length, is probed with its own hashes below the largest limit. An item is a candidate if the document holds at least
half of its sketch; candidates are verified on their whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf

from lumenframe.llm.common import release, shared, stored, structs, texts_of
from lumenframe.llm.shingles import Powers, joined, shingle_sets, word_hashes
from lumenframe.schema import quoted

WORDS = 5
MIN_CONTAINMENT_PERCENT = 80
#: Hashes in a sketch, about: items with up to twice as many shingles are kept whole.
SKETCH = 64
#: Share of a sketch that a candidate's document holds at least. At a containment of 0.8 a sketch of 64 falls short of
#: it with a chance below 1e-7; sketches that hold the whole item never do.
CANDIDATE_PERCENT = 50
#: Shingles of the items that are broadcast at once (8 bytes each); more items are worked off in blocks.
BLOCK_SHINGLES = 2_000_000


class ItemIndex:
    """The items of one block: for each shingle width, sorted sketch hashes with the items that hold them."""

    def __init__(self, sets: list[np.ndarray], widths: list[int]) -> None:
        self.sets = sets
        self.by_width = {}
        self.sketch = np.zeros(len(sets), dtype=np.int64)
        for width in sorted(set(widths)):
            hashes, owners = [], []
            for k, (own, w) in enumerate(zip(sets, widths)):
                if w == width and len(own):
                    part = own[own <= np.uint64(self.limit(len(own)))]
                    part = part if len(part) else own
                    self.sketch[k] = len(part)
                    hashes.append(part)
                    owners.append(np.full(len(part), k))
            if hashes:
                h, o = np.concatenate(hashes), np.concatenate(owners)
                order = np.argsort(h, kind="stable")
                h, o = h[order], o[order]
                distinct, first = np.unique(h, return_index=True)
                bits = np.zeros(1 << max(12, (4 * len(distinct)).bit_length()), dtype=bool)
                bits[distinct & np.uint64(len(bits) - 1)] = True
                self.by_width[width] = (distinct, np.append(first, len(h)), o, bits)

    @staticmethod
    def limit(size: int) -> int:
        """Largest hash in the sketches of items of this size: 1 for sizes up to 2 * SKETCH, then halved per power of two."""
        partition = max(0, (max(size, 1) - 1).bit_length() - (2 * SKETCH - 1).bit_length())
        return ((1 << 64) - 1) >> partition

    def found(self, words: np.ndarray, firsts: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """For the texts of a chunk that hold items: (item, shingles in common)."""
        out: dict[int, list[tuple[int, int]]] = {}
        for width, (distinct, first, owners, bits) in self.by_width.items():
            runs = joined(words, width)
            at = np.flatnonzero(bits[runs & np.uint64(len(bits) - 1)])
            place = np.searchsorted(distinct, runs[at])
            hit = distinct[np.minimum(place, len(distinct) - 1)] == runs[at]
            at, place = at[hit], place[hit]
            text = np.searchsorted(firsts, at, side="right") - 1
            whole = at + width <= firsts[text + 1]
            text, place = text[whole], place[whole]
            for t in np.unique(text):
                places = np.unique(place[text == t])
                held = np.concatenate([owners[first[p] : first[p + 1]] for p in places])
                items, counts = np.unique(held, return_counts=True)
                for k, count in zip(items, counts):
                    own = self.sets[k]
                    if 100 * count < CANDIDATE_PERCENT * self.sketch[k]:
                        continue
                    if self.sketch[k] < len(own):
                        mine = runs[firsts[t] : max(firsts[t], firsts[t + 1] - width + 1)]
                        count = int(np.isin(own, mine).sum())
                    if 100 * count >= MIN_CONTAINMENT_PERCENT * len(own):
                        out.setdefault(int(t), []).append((int(k), int(count)))
        return out


def _item_sets(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The items that hold words: id, shingle width and hashes, and the number of their block."""
    @arrow_udf("struct<width:int,hashes:array<long>>")
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        powers = Powers()
        for batch in batches:
            texts = [t.encode() for t in texts_of(batch)]
            widths = [min(WORDS, len(t.split())) for t in texts]
            hashes = [s.view(np.int64) for s in shingle_sets(texts, WORDS, powers)]
            yield structs(width=pa.array(widths, pa.int32()), hashes=pa.array(hashes, pa.list_(pa.int64())))

    return stored(items.select(F.col(id_col).cast("string").alias("id"), sets(F.col(text_col)).alias("s"))
                  .select("id", "s.width", "s.hashes").where("width > 0"), "items")


def _blocks(table: DataFrame) -> list[Column]:
    """A condition for each block of items; a block holds about ``BLOCK_SHINGLES``."""
    total = table.agg(F.sum(F.size("hashes"))).first()[0] or 0
    blocks = -(-total // BLOCK_SHINGLES)
    return [F.pmod(F.xxhash64("id", "hashes"), F.lit(blocks)) == b for b in range(blocks)]


def _finder(table: DataFrame, block: Column):
    """A function of a text that finds the items of the block, which are sent to the executors now."""
    rows = table.where(block).collect()
    sets = [np.sort(np.array(r.hashes, dtype=np.int64).view(np.uint64)) for r in rows]
    given = shared(table.sparkSession, ([r.id for r in rows], ItemIndex(sets, [r.width for r in rows])))

    @arrow_udf("array<struct<item:string,n_item:int,n_common:int>>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names, own = given()
        powers = Powers()
        kind = pa.list_(pa.struct([("item", pa.string()), ("n_item", pa.int32()), ("n_common", pa.int32())]))
        for batch in batches:
            rows: list[list[dict]] = []
            for words, firsts in word_hashes((t.encode() for t in texts_of(batch)), powers):
                hits = own.found(words, firsts)
                rows += [[{"item": names[k], "n_item": len(own.sets[k]), "n_common": c} for k, c in hits.get(t, ())]
                         for t in range(len(firsts) - 1)]
            yield pa.array(rows, kind)

    return found


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs of a document and an item of which it holds at least 80 % of the five-word shingles.

    Returns the document's id, the item's id, n_item (shingles of the item), n_common and containment. An item of
    fewer than five words is one shingle of all its words. Null and empty texts and items without words match
    nothing; a null id stays null; repeated rows give repeated pairs; an empty table on either side gives none.
    Only the named columns are read. Items are broadcast in blocks of bounded size, documents are never shuffled.
    """
    spark = docs.sparkSession
    kind = items.schema[item_col].dataType
    out = spark.createDataFrame(
        [], f"{quoted(id_col)} {docs.schema[id_col].dataType.simpleString()}, {quoted(item_col)} {kind.simpleString()}, "
            "n_item int, n_common int, containment double")
    table = _item_sets(items, item_col, item_text)
    for block in _blocks(table):
        found = _finder(table, block)
        pairs = docs.select(F.col(id_col).alias("id"), F.explode(found(F.col(text_col))).alias("hit")).select(
            F.col("id").alias(id_col), F.col("hit.item").cast(kind).alias(item_col), "hit.n_item", "hit.n_common",
            (F.col("hit.n_common") / F.col("hit.n_item")).alias("containment"))
        out = out.unionByName(stored(pairs, "contained"))
        # The block's broadcast goes before the next one is made.
        del found, pairs
        release(spark)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns.

    Rows are judged by their own text alone: null ids, repeated rows and further columns pass as they are, null and
    empty texts hold nothing and stay, and an empty table on either side leaves the documents as they were. Between two
    blocks of items the documents that are left are written, so that one block is held at a time.
    """
    table = _item_sets(items, item_col, item_text)
    blocks = _blocks(table)
    for k, block in enumerate(blocks):
        found = _finder(table, block)
        docs = docs.where(F.size(found(F.col(text_col))) == 0)
        if k < len(blocks) - 1:
            docs = stored(docs, "clean")
            del found
            release(docs.sparkSession)
    return docs


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of documents that holds an item of benchmark, with the item."""
    return contained_items(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                           spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH d AS (
  SELECT doc_id AS id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
i AS (
  SELECT item_id AS id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM benchmark),
item AS (
  SELECT DISTINCT id, least(5, len(w)) AS width, array_to_string(w[k : k + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
doc AS (
  SELECT DISTINCT id, width, array_to_string(w[k : k + width - 1], ' ') AS s
  FROM (SELECT id, w, width, unnest(range(1, len(w) - width + 2)) AS k
        FROM d CROSS JOIN (SELECT DISTINCT width FROM item) WHERE len(w) >= width)),
size AS (SELECT id, count(*) AS n_item FROM item GROUP BY id),
pair AS (SELECT doc.id AS doc_id, item.id AS item_id, count(*) AS n_common
         FROM doc JOIN item USING (width, s) GROUP BY ALL)
SELECT doc_id, item_id, n_item::INTEGER AS n_item, n_common::INTEGER AS n_common, n_common / n_item AS containment
FROM pair JOIN size ON item_id = size.id WHERE 100 * n_common >= 80 * n_item
"""
