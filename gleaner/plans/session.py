"""Session settings for local runs and a starting point for cluster runs."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Vectors are wide rows: small batches bound the memory of Python workers.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("gleaner")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of a session that was started without it.

    Equivalent to submitting the job with ``--py-files``; done once per application.
    """
    context = spark.sparkContext
    if getattr(context, "_gleaner_shipped", False):
        return
    base = Path(tempfile.mkdtemp(prefix="gleaner-code-")) / "gleaner"
    archive = shutil.make_archive(str(base), "zip", PACKAGE.parent, PACKAGE.name)
    context.addPyFile(archive)
    context._gleaner_shipped = True
