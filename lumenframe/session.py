"""Session defaults shared by the library, the tests and the bench."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every operator relies on. Results must not depend on the
# machine's time zone, and adaptive execution does the run-time re-planning
# (partition coalescing, skewed-join splitting, join strategy by real size).
RUNTIME_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Set the run-time defaults on an existing session and return it."""
    for key, value in RUNTIME_DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, memory: str = "16g", app: str = "lumenframe") -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in RUNTIME_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for files that all executors must see.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset
    (a local test session) is a scratch folder made and set.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if not current:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster.")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lumenframe-", dir=os.environ.get("TMPDIR")))
    return spark.sparkContext.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write the table to the shared checkpoint folder and go on from there.

    For tables that several later steps read: the work is done once, the plan
    stays short, and a lost executor does not bring the work back.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
