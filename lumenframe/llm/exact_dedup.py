"""Exact duplicates by progressive refinement: length, then a hash of the beginning, then a hash of the whole text.

Texts are equal when they are identical after every run of ``[\\x20\\x09-\\x0D]`` became one space. Each step passes on
only rows that still share their key with another row, and only short keys are ever shuffled, never a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenframe.llm.common import stored
from lumenframe.schema import fresh_name

#: Characters of the normalised text that the second step hashes.
PREFIX_CHARS = 256


def normalised(text: Column) -> Column:
    """Null as empty, and each run of white space as one space. A lone space needs no replacement."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per input row: the id, keep_id, group_size, kept and text_sha256.

    ``keep_id`` is the smallest id among the rows with an equal text, ``kept`` says whether the row has it.
    ``text_sha256`` is the whole text's hash: for all rows if ``digests``, else only where length and beginning were
    shared (elsewhere null: the text is known to be unique without it).

    A null text counts as empty. A null id is never the smallest; if a group has no other, keep_id is null and its
    rows are kept. Rows repeated with the same id and text count each in group_size and share one verdict. An empty
    table gives an empty result; other columns are not read.
    """
    text = normalised(F.col(text_col))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("t")).select(
        "id", F.length("t").alias("n"), F.xxhash64(F.substring("t", 1, PREFIX_CHARS)).alias("start"),
        F.unhex(F.sha2("t", 256)).alias("whole") if digests else F.lit(None).cast("binary").alias("whole"),
    )
    light = stored(keyed, "keys")
    same_length = light.groupBy("n").count().where("count > 1").select("n")
    same_start = stored(
        light.join(same_length, "n", "left_semi").groupBy("n", "start").count().where("count > 1").select("n", "start"),
        "starts",
    )
    if digests:
        survivors = light.join(same_start, ["n", "start"], "left_semi").select("id", "n", "start", "whole")
    else:
        again = docs.select(F.col(id_col).alias("id"), text.alias("t")).select(
            "id", "t", F.length("t").alias("n"), F.xxhash64(F.substring("t", 1, PREFIX_CHARS)).alias("start"))
        survivors = again.join(same_start, ["n", "start"], "left_semi").select(
            "id", "n", "start", F.unhex(F.sha2("t", 256)).alias("whole"))
        survivors = stored(survivors, "survivors")
    groups = stored(
        survivors.groupBy("whole").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1"), "groups")
    if digests:
        found = light.select("id", "whole")
    else:
        alone = light.join(same_start, ["n", "start"], "left_anti").select("id", "whole")
        found = alone.unionByName(survivors.select("id", "whole"))
    # A large group is one key with many rows on the left; groups has one row a key, so its side can be repeated.
    out = found.join(groups, "whole", "left")
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), size.alias("group_size"),
        F.coalesce(F.col("id") == keep, keep.isNull()).alias("kept"), F.lower(F.hex("whole")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without exact copies, with all their columns.

    Of equal texts the row with the smallest id stays; rows repeated with the same id and text leave one of them. Null
    texts count as empty, so they are copies of each other; a row without an id goes if a copy has one, and is a copy of
    its like otherwise. Whole texts are hashed only where length and beginning are shared. An empty table stays empty.
    """
    id_name, whole = fresh_name(docs.columns, "__id"), fresh_name(docs.columns, "__whole")
    groups = exact_groups(docs, id_col, text_col).where("text_sha256 is not null").select(
        F.col(id_col).alias(id_name), F.unhex("text_sha256").alias(whole), "kept")
    counted = stored(groups.groupBy(id_name, whole, "kept").agg(F.count(F.lit(1)).alias("times")), "verdicts")
    going = counted.where("not kept")
    named = stored(counted.where("not kept or times > 1").select(id_name).distinct(), "suspects")
    same_id = F.col(id_col).eqNullSafe(F.col(id_name))
    passed = docs.join(named, same_id, "left_anti")
    # Of the few rows that share such an id, the text decides.
    suspects = docs.join(named, same_id, "left_semi")
    digest = fresh_name([*docs.columns, id_name, whole], "__digest")
    suspects = suspects.withColumn(digest, F.unhex(F.sha2(normalised(F.col(text_col)), 256)))
    stay = suspects.join(going, same_id & (F.col(digest) == F.col(whole)), "left_anti")
    return passed.unionByName(stay.dropDuplicates([id_col, digest]).drop(digest))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its group of equal texts."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
h AS (SELECT doc_id, sha256(body) AS text_sha256 FROM t)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM h
"""
