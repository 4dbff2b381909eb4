"""Incremental load, encoding and search.

Every job reads a stream, processes what is available in micro-batches and
keeps its progress in a checkpoint folder, so a restart continues where it
stopped. Batch outputs are named by batch id: a repeated batch replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from gleaner.functions.constants import MAX_HITS
from gleaner.operators.encode import Encoder, encode_corpus
from gleaner.operators.positions import assign_positions, cap_rows
from gleaner.plans.experiment import Collection, check_query_types, search
from gleaner.plans.workspace import exists

REPORT_SCHEMA = "n_rows bigint, error string, batch_id bigint"


def read_stream(
    spark: SparkSession, path: str, schema: ST.StructType, files_per_batch: int = 1, fmt: str = "parquet"
) -> DataFrame:
    """Files of a folder as a stream, a few per micro-batch."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .format(fmt)
        .load(path)
    )


def _run(writer, checkpoint: str) -> None:
    """Process everything that is available, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_report(spark: SparkSession, out: str) -> DataFrame:
    """``(batch_id, n_rows, error)`` of a finished :func:`stream_load`."""
    return spark.read.schema(REPORT_SCHEMA).parquet(f"{out}/report").select(
        "batch_id", "n_rows", "error"
    )


def read_loaded(spark: SparkSession, out: str, schema: ST.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{out}/rows")


def _loaded_before(spark: SparkSession, out: str, batch_id: int) -> int:
    if not exists(spark, f"{out}/report"):
        return 0
    earlier = read_report(spark, out).where(F.col("batch_id") < batch_id)
    return earlier.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]


def stream_load(
    stream: DataFrame,
    vectors: DataFrame,
    out: str,
    max_rows: int | None = None,
    check: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """Load ``(docid, text, ...)`` as it arrives, joined to its vector by docid.

    Rows go to ``out/rows``, one report row per batch to ``out/report``; the
    report is returned. A batch that ``check`` refuses is reported with its error and
    skipped whole. Any other error - storage, memory, a lost executor - fails the micro-batch,
    which the stream repeats from its checkpoint. Loading stops at ``max_rows``.
    """
    spark = stream.sparkSession

    def _write_batch(rows: DataFrame, target: str, batch_id: int) -> int:
        if max_rows is not None:
            room = max(0, max_rows - _loaded_before(spark, out, batch_id))
            if rows.count() > room:
                rows = cap_rows(assign_positions(rows, "docid"), room).drop("pos")
        rows.write.mode("overwrite").parquet(target)
        return spark.read.parquet(target).count()

    def load(batch: DataFrame, batch_id: int) -> None:
        rows = batch.join(vectors, "docid")
        target = f"{out}/rows/batch_id={batch_id}"
        loaded, error = 0, None
        # Checked, counted and written: kept for the micro-batch, recomputable if lost.
        batch.persist()
        try:
            if check is not None:
                try:
                    check(batch)
                except (PySparkException, Py4JError, OSError, MemoryError):
                    raise  # the platform's, not the batch's
                except Exception as problem:  # one bad batch must not stop the load
                    error = f"{type(problem).__name__}: {problem}".splitlines()[0]
            if error is None:
                loaded = _write_batch(rows, target, batch_id)
        finally:
            batch.unpersist()
        report = spark.createDataFrame([(loaded, error)], "n_rows bigint, error string")
        report.write.mode("overwrite").parquet(f"{out}/report/batch_id={batch_id}")

    _run(stream.writeStream.foreachBatch(load), f"{out}/checkpoint")
    return read_report(spark, out)


def stream_encode(
    stream: DataFrame,
    col: str,
    encoder_factory: Callable[[], Encoder],
    out: str,
    batch_size: int = 32,
) -> DataFrame:
    """Encode ``col`` as it arrives, append vectors to ``out/rows`` and return them."""
    encoded = encode_corpus(stream, col, encoder_factory, batch_size)
    writer = encoded.writeStream.format("parquet").option("path", f"{out}/rows")
    _run(writer, f"{out}/checkpoint")
    return stream.sparkSession.read.schema(encoded.schema).parquet(f"{out}/rows")


def stream_search(
    stream: DataFrame, collection: Collection, query_type: str, out: str, k: int = MAX_HITS
) -> DataFrame:
    """Answer queries as they arrive from a static collection; returns the run table."""
    check_query_types(query_type)
    spark = stream.sparkSession

    def answer(batch: DataFrame, batch_id: int) -> None:
        # The batch is read several times by a search; keep it for the micro-batch.
        batch.persist()
        try:
            run = search(batch, collection, query_type, k).withColumn("query_type", F.lit(query_type))
            run.write.mode("overwrite").parquet(f"{out}/rows/batch_id={batch_id}")
        finally:
            batch.unpersist()

    _run(stream.writeStream.foreachBatch(answer), f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows").drop("batch_id")
