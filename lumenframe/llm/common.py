"""Helpers shared by the text operators: scratch tables, folds, components."""

from __future__ import annotations

import gc
import pickle
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenframe.session import shared_dir

#: Bytes of an Arrow batch between Spark and Python in the corpus pipeline.
BATCH_BYTES = 1 << 21


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write the table to the shared folder and go on from the files.

    Later steps read the files, so the work is done once, the plan stays short, a lost executor costs nothing
    that was finished, and the planner knows the size.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared(spark: SparkSession, value) -> Callable:
    """A function that gives the value, of bounded size, in tasks; the classes it needs travel with it."""
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(packed.value)


def release(spark: SparkSession) -> None:
    """Let go of what finished steps left on the driver.

    Spark drops broadcasts and shuffle files once the driver's objects for them are collected, which may be long after.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """Rows travel to and from Python in batches of ``limit`` bytes at most, or of one row; a smaller limit that is set stays.

    Spark counts 10,000 rows a batch, which is tens of MB of documents outside the heap, and as much again in the Python
    worker, for every task. The setting stays, as a returned table is computed later.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name, None)
    if held is None or not held.isdigit() or not 0 < int(held) <= limit:
        spark.conf.set(name, limit)


@contextmanager
def short_plans(spark: SparkSession, characters: int = 1 << 14) -> Iterator[None]:
    """Descriptions of plans are cut while plans with large literals run: the driver keeps one for every step of a query."""
    name = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(name)
    spark.conf.set(name, characters)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fold_of(id_col: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(column.cast("string").cast("binary")) % folds


def texts_of(column: pa.Array) -> Iterator[str]:
    """The column's texts, null as empty, one at a time."""
    for value in column:
        yield value.as_py() or ""


def structs(**columns) -> pa.StructArray:
    """A struct column from named value lists or arrays."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.StructArray.from_arrays(arrays, names=list(columns))


def components(edges: DataFrame) -> DataFrame:
    """Connected components: (node, component), the component named by its smallest node.

    ``edges`` has integer columns a and b; self loops and repeats are harmless, edges with a null end are ignored.
    Every round points each node to its smallest neighbour, follows the pointers one step further, and contracts the
    edges to those nodes, which leaves fewer and fewer of them. Minima are combined before the shuffle, so a hub costs
    one row a task.
    """
    def between(df: DataFrame) -> DataFrame:
        return stored(df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")

    edges = between(edges.select(F.col("a").cast("long"), F.col("b").cast("long")))
    mapping = None
    while mapping is None or not edges.isEmpty():
        ends = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = stored(ends.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("to")), "first")
        second = first.select(F.col("node").alias("to"), F.col("to").alias("far"))
        step = stored(first.join(second, "to").select("node", F.col("far").alias("to")), "step")
        if mapping is None:
            mapping = step.withColumnRenamed("to", "component")
        else:
            onward = step.select(F.col("node").alias("component"), "to")
            mapping = stored(mapping.join(onward, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        edges = between(edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
                        .join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
                        .select(F.col("x").alias("a"), F.col("y").alias("b")))
    return mapping
