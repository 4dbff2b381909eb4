"""Statistics, compaction and reuse of written tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from gleaner.plans.workspace import is_complete


def analyze_table(spark: SparkSession, table: str) -> None:
    """Column statistics of a catalog table for the cost-based optimiser."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")


def collect_table_stats(df: DataFrame, exact: bool = False) -> DataFrame:
    """Per scalar column: rows, nulls, distinct values, extremes, mean length of its text.

    All columns are profiled in one scan. ``exact`` counts distinct values by shuffling
    a 64-bit hash per column and value, never the values, otherwise a fixed-size sketch estimates them.
    """
    columns = [f.name for f in df.schema.fields if isinstance(f.dataType, ST.AtomicType)]
    per_column = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col(c).isNull()).alias("n_nulls"),
            F.approx_count_distinct(F.col(c)).alias("n_distinct"),
            F.min(c).cast("string").alias("min_value"),
            F.max(c).cast("string").alias("max_value"),
            F.round(F.avg(F.char_length(F.col(c).cast("string"))), 6).alias("avg_length"),
        ).alias(f"s{i}")
        for i, c in enumerate(columns)
    ]
    stats = df.agg(*per_column)
    stats = stats.select(
        F.explode(F.array(*[F.col(f"s{i}") for i in range(len(columns))])).alias("s")
    ).select("s.*")
    if not exact:
        return stats
    # One narrow row per column and value, summed up within tasks before it is shuffled.
    hashed = [
        F.struct(F.lit(c).alias("column"), F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias("h")) for c in columns
    ]
    values = df.select(F.explode(F.array(*hashed)).alias("v")).select("v.*").where(F.col("h").isNotNull())
    counts = values.distinct().groupBy("column").agg(F.count("*").alias("n"))
    order = stats.columns
    stats = stats.drop("n_distinct").join(counts, "column", "left")
    return stats.withColumn("n_distinct", F.coalesce("n", F.lit(0).cast("bigint"))).select(*order)


def compact_table(
    spark: SparkSession, path: str, out: str, target_files: int, order_by: list[str]
) -> DataFrame:
    """Rewrite the table at ``path`` into ``target_files`` files under ``out``.

    Rows are range-partitioned and sorted by ``order_by``, so file statistics
    prune scans and a crowded language spreads over several files.
    """
    rows = spark.read.parquet(path)
    # An explicit number of ranges is kept by adaptive execution.
    ranged = rows.repartitionByRange(target_files, *order_by)
    ranged.sortWithinPartitions(*order_by).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def file_count(df: DataFrame) -> int:
    """Number of files with rows that ``df`` reads."""
    return df.select(F.col("_metadata.file_path").alias("f")).distinct().count()


def artifact_path(
    root: str, kind: str, lang: str, model: str, begin: int | None = None, end: int | None = None,
    count: int | None = None,
) -> str:
    """Path that names language, model and rows, so that no stale artifact is reused."""
    if begin is None and end is None:
        rows = str(count if count is not None else "all")
    else:
        rows = f"{begin or 0}-{end if end is not None else 'end'}"
    return f"{root}/{kind}_{lang}_{rows}_{model.replace('/', '-')}"


def materialize(
    spark: SparkSession, make: Callable[[], DataFrame], path: str, overwrite: bool = False
) -> DataFrame:
    """Table at ``path``; computed only when no finished job has written it, or on demand.

    A folder that a failed job left behind has no success marker and is rewritten.
    """
    if overwrite or not is_complete(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
