"""Shared working folder for written tables and streams."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    Taken from ``spark.checkpoint.dir``. Only a local-mode session without that
    setting (tests) gets a folder of its own.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if not root:
        root = context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="gleaner-")
        context.setCheckpointDir(root)  # the next call finds the same folder
    return root


def fresh_dir(spark: SparkSession, label: str) -> str:
    """Path of a folder under the shared root that nobody has used yet."""
    return os.path.join(shared_root(spark), f"{label}-{uuid.uuid4().hex}")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back.

    Cuts the lineage at a place that outlives executors. Columnar, so later
    readers still get column pruning and filter pushdown.
    """
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop_path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a finished job has written ``path`` (its success marker exists)."""
    fs, marker = _hadoop_path(spark, os.path.join(path, "_SUCCESS"))
    return bool(fs.exists(marker))


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _hadoop_path(spark, path)
    return bool(fs.exists(target))
