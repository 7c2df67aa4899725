"""Session plumbing shared by every operator: tables, lineage cuts, sizing."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers find this package where it isn't installed: add its folder to their path."""
    env = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parent.parent)
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, env.get("PYTHONPATH"))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir``."""
    ensure_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(df: DataFrame) -> str:
    """The session's checkpoint folder; the setting is read where no folder has been set yet.

    A temporary folder serves only where driver and executors are one process. On a cluster without the
    setting there is no folder that all of them see, and this raises.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="loomgraph-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder named by ``spark.checkpoint.dir``."""
    ensure_importable(df.sparkSession)
    _shared_folder(df)
    return df.checkpoint(eager=True)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back; the session's end removes it."""
    ensure_importable(df.sparkSession)
    path = f"{_shared_folder(df)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = df.sparkSession.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return df.sparkSession.read.parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files of what runs inside go as soon as it has run; frames made inside are for one action each."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with its 0-based place in a total order, without gathering the rows in one task.

    Rows are sorted over partitions and checkpointed; offsets come from one row for each partition.
    """
    placed = checkpoint(df.orderBy(*order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    k = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + k).drop("_part", "_before")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
