"""Loading documents and vectors into the collection table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.constants import LOAD_BATCH_SIZE
from gleaner.operators.positions import assign_base_id, cap_rows, zip_join

COLLECTION_COLUMNS = ["id", "base_id", "docid_col", "fulltext_col", "dense_col", "lang", "batch_num"]


def batch_number(batch_size: int) -> Column:
    """1-based number of the load batch a position falls in."""
    return (F.floor(F.col("pos") / F.lit(batch_size)) + 1).cast("bigint")


def batch_report(
    df: DataFrame, batch_size: int = LOAD_BATCH_SIZE, is_bad: Column | None = None
) -> DataFrame:
    """``(lang, batch_num, n_rows, n_bad, ok)`` per batch; one bad row fails its batch."""
    bad = F.coalesce(is_bad, F.lit(False)) if is_bad is not None else F.lit(False)
    lang = ["lang"] if "lang" in df.columns else []
    return (
        df.withColumn("batch_num", batch_number(batch_size))
        .groupBy(*lang, "batch_num")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_bad"))
        .withColumn("ok", F.col("n_bad") == 0)
    )


def good_batches(
    df: DataFrame, batch_size: int = LOAD_BATCH_SIZE, is_bad: Column | None = None
) -> DataFrame:
    """Rows of batches without a bad row; the other batches are left out whole."""
    if is_bad is None:
        return df
    lang = ["lang"] if "lang" in df.columns else []
    numbered = df.withColumn("batch_num", batch_number(batch_size))
    failed = numbered.where(F.coalesce(is_bad, F.lit(False))).select(*lang, "batch_num").distinct()
    return numbered.join(failed, [*lang, "batch_num"], "left_anti").drop("batch_num")


def collection_rows(
    docs: DataFrame,
    vectors: DataFrame,
    lang: str,
    max_rows: int | None = None,
    batch_size: int = LOAD_BATCH_SIZE,
) -> DataFrame:
    """Rows of the collection table from ``(pos, docid, text)`` and ``(pos, vec)``.

    Documents and vectors meet by position; whatever one side has more is dropped.
    """
    paired = zip_join(docs.select("pos", "docid", "text"), vectors.select("pos", "vec"))
    if max_rows is not None:
        paired = cap_rows(paired, max_rows)
    return assign_base_id(paired).select(
        "pos",
        (F.col("pos") + 1).alias("id"),
        "base_id",
        F.col("docid").alias("docid_col"),
        F.col("text").alias("fulltext_col"),
        F.col("vec").alias("dense_col"),
        F.lit(lang).alias("lang"),
    )


def load_collection(
    docs: DataFrame,
    vectors: DataFrame,
    path: str,
    lang: str,
    max_rows: int | None = None,
    batch_size: int = LOAD_BATCH_SIZE,
    is_bad: Column | None = None,
) -> DataFrame:
    """Replace the collection of one language under ``path`` and return the batch report.

    ``is_bad`` marks rows a load cannot take, over the columns of
    :func:`collection_rows`. Batches with such rows are reported and skipped.
    The table is partitioned by ``lang``; only that partition is rewritten.
    """
    rows = collection_rows(docs, vectors, lang, max_rows, batch_size)
    good = good_batches(rows, batch_size, is_bad).drop("pos")
    (
        good.withColumn("created_at", F.current_timestamp())
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("lang")
        .parquet(path)
    )
    return batch_report(rows, batch_size, is_bad)


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def reconcile_counts(source: DataFrame, table: DataFrame) -> DataFrame:
    """``(lang, expected, actual, ok)``: rows that should be and are in the table."""
    expected = source.groupBy("lang").agg(F.count(F.lit(1)).alias("expected"))
    actual = table.groupBy("lang").agg(F.count(F.lit(1)).alias("actual"))
    zero = F.lit(0).cast("bigint")
    return (
        expected.join(actual, "lang", "full")
        .select(
            "lang",
            F.coalesce("expected", zero).alias("expected"),
            F.coalesce("actual", zero).alias("actual"),
        )
        .withColumn("ok", F.col("expected") == F.col("actual"))
    )
