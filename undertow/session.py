"""Session settings and the shared folder that iterative jobs write their rounds to."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot join key is worth one extra exchange; without this a skewed join that sits under
    # an aggregate on the same key would be left in one task.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Batches between the engine and Python workers: long texts would fill a task with ten thousand. Both sides hold
    # a batch or two, outside the engine's heap.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4194304b",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every job here relies on; sizing stays with the cluster.

    Python workers look for this package where the driver has it, if they are told no other place;
    a cluster whose machines have it elsewhere gets it as a file of the job.
    """
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    spark.sparkContext.environment.setdefault("PYTHONPATH", here)
    for name, value in _SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def local_session(cpus: str | int = 8, name: str = "undertow", shuffle: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Only a local master may fall back to a folder of its own: on a cluster a machine-local
    path would be lost with the executor that wrote it.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder to run iterative jobs")
    folder = tempfile.mkdtemp(prefix="undertow-rounds-")
    context.setCheckpointDir(folder)
    return folder


def pin(df: DataFrame, label: str = "round", compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and read it back, cutting its lineage.

    A written table survives the loss of any executor, is computed exactly once, and gives the
    optimizer real file sizes for the next round's join choice.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pin_counting(df: DataFrame, flag: str, label: str = "round") -> tuple[DataFrame, int]:
    """As :func:`pin`, and how many rows have ``flag`` set, counted by the same write."""
    seen = Observation()
    pinned = pin(df.observe(seen, F.count_if(F.col(flag)).alias("n")), label)
    return pinned, seen.get["n"]
