"""CSV files cut at any byte, whose quoted fields may hold line breaks.

Files are read as lines, split by bytes as any text is. What a block of lines does to the reader's state, inside or
outside of a quoted field, depends only on the state it starts in, so each block tells where it ends from either start.
A prefix scan over the blocks of a file (one short row each) gives the true start of every block. Then lines are put
together to records block by block; the records that a cut divides, at most two pieces a block, meet by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import settle

#: Blocks whose start states are broadcast (some 20 bytes each); beyond, blocks and lines meet by a shuffle.
BROADCAST_BLOCKS = 1_000_000


def ends_inside(line: str, inside: bool, sep: str) -> bool:
    """Whether a line ends inside a quoted field, from the state it starts in; a doubled quote stands for one."""
    at, opening = 0, sep + '"'
    if not inside and line.startswith('"'):
        inside, at = True, 1
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
                continue
            inside = False
        # Quotes within an unquoted field are plain characters.
        at = line.find(opening, at)
        if at < 0:
            return False
        inside, at = True, at + len(opening)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in file order within each partition, with their file and their block's first byte."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def _outcomes(sep: str):
    """For each block: the states it ends in from either start, and whether a quoted field closes if one is open."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("from_out", pa.bool_()), ("from_in", pa.bool_()),
                        ("opens", pa.bool_()), ("closes", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        row = lambda: pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, *state)))], schema=schema)
        for batch in batches:
            if not batch.num_rows:
                continue
            files, blocks = batch["file"].dictionary_encode(), batch["block"].to_numpy()
            of = files.indices.to_numpy()
            bounds = np.flatnonzero((np.diff(of) != 0) | (np.diff(blocks) != 0)) + 1
            for a, b in zip([0, *bounds.tolist()], [*bounds.tolist(), batch.num_rows]):
                own = (files.dictionary[int(of[a])].as_py(), int(blocks[a]))
                if own != key:
                    if key:
                        yield row()
                    key, state = own, [False, True, False, False]
                for line in batch["line"].slice(a, b - a).drop_null().to_pylist():
                    state[0] = ends_inside(line, state[0], sep)
                    state[1] = ends_inside(line, state[1], sep)
                    state[2] |= state[0]
                    state[3] |= not state[1]
        if key:
            yield row()

    return run


def _starts(outcomes: DataFrame) -> DataFrame:
    """For each block, whether it starts inside a quoted field, and the piece in which that record began.

    A block's effect is constant, none or a swap; the state after it is the last constant, swapped as often as since.
    """
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("file").orderBy("block")
    constant = F.when(F.col("from_out") == F.col("from_in"), F.col("from_out").cast("int"))
    swaps = F.sum(F.when(F.col("from_out") & ~F.col("from_in"), 1).otherwise(0)).over(upto)
    scanned = outcomes.withColumn("piece", F.monotonically_increasing_id()).withColumn("constant", constant).withColumn("swaps", swaps)
    since = F.col("swaps") - F.coalesce(F.last(F.when(F.col("constant").isNotNull(), F.col("swaps")), True).over(upto), F.lit(0))
    after = (F.coalesce(F.last("constant", True).over(upto), F.lit(0)) + since) % 2 == 1
    scanned = scanned.withColumn("after", after).withColumn("inside", F.lag("after", 1, False).over(before))
    begins = F.col("after") & (~F.col("inside") | F.col("closes"))
    scanned = scanned.withColumn("begun", F.last(F.when(begins, F.col("piece")), True).over(upto))
    return scanned.select("file", "block", "piece", "inside", F.lag("begun").over(before).alias("begun"))


def _records(sep: str):
    """Records of lines; those cut by a block's end have the piece in which they began as ``chain``."""
    schema = pa.schema([("record", pa.string()), ("chain", pa.int64()), ("block", pa.int64()), ("first", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside, fresh, held, chain, at = None, False, False, [], None, 0
        for batch in batches:
            out: list[tuple] = []
            for piece, block, starts_inside, begun, line in zip(*(batch[c].to_pylist() for c in ("piece", "block", "inside", "begun", "line"))):
                if piece != now:
                    if held:
                        out.append(("\n".join(held), now if chain is None else chain, at, fresh))
                    now, inside, fresh, held, at = piece, starts_inside, block == 0, [], block
                    chain = begun if inside else None
                if not held and not inside and line in ("", "\r"):
                    continue
                held.append(line)
                inside = ends_inside(line, inside, sep)
                if not inside:
                    out.append(("\n".join(held), chain, at, fresh))
                    held, chain, fresh = [], None, False
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, schema.types)], schema=schema)
        if held:
            yield pa.RecordBatch.from_pylist(
                [{"record": "\n".join(held), "chain": now if chain is None else chain, "block": at, "first": fresh}], schema=schema)

    return run


def needs_records(spark: SparkSession, path: str, sep: str) -> tuple[str, DataFrame | None]:
    """How a file or folder can be read, and its blocks' outcomes where they are known.

    ``lines``: no quoted field holds a line break, so every line is a record. ``records``: some do. ``whole``: some
    line holds a carriage return before its end, which only a reader of whole files tells from a line's end.
    """
    lines = _lines(spark, path)
    seen = lines.agg(F.bool_or(F.col("line").contains('"')).alias("quoted"), F.bool_or(F.col("line").rlike(r"\r(?!\z)")).alias("returns")).first()
    if seen["returns"]:
        return "whole", None
    if not seen["quoted"]:
        return "lines", None
    marked = lines.withColumn("line", F.when(F.col("line").contains('"'), F.col("line")))
    outcomes = settle(marked.mapInArrow(_outcomes(sep), "file string, block long, from_out boolean, from_in boolean, opens boolean, closes boolean"))
    return ("records", outcomes) if outcomes.agg(F.bool_or("opens")).first()[0] else ("lines", None)


def records(spark: SparkSession, path: str, sep: str, outcomes: DataFrame) -> DataFrame:
    """``record``: the text of every record but each file's header, without the line end; empty lines are no records."""
    starts = settle(_starts(outcomes))
    lines = _lines(spark, path)
    if starts.count() <= BROADCAST_BLOCKS:
        placed = lines.join(F.broadcast(starts), ["file", "block"])
    else:
        placed = lines.withColumn("place", F.monotonically_increasing_id()).join(starts.hint("merge"), ["file", "block"]).repartition(
            "piece").sortWithinPartitions("piece", "place")
    pieces = placed.select("piece", "block", "inside", "begun", "line").mapInArrow(
        _records(sep), "record string, chain long, block long, first boolean")
    parts = F.array_sort(F.collect_list(F.struct("block", "record")))
    cut = settle(pieces.where("chain IS NOT NULL").groupBy("chain").agg(
        F.array_join(F.transform(parts, lambda x: x["record"]), "\n").alias("record"), F.bool_or("first").alias("first")))
    whole = pieces.where("chain IS NULL").select("record", "first").unionByName(cut.select("record", "first"))
    return whole.where(~F.col("first")).select(F.regexp_replace("record", r"\r\z", "").alias("record"))
