"""Size checks that decide whether a side may be broadcast."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows a side may have to be sent to every executor.
BROADCAST_ROWS = 200_000


def fits(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; stops counting beyond that."""
    return df.limit(max_rows + 1).count() <= max_rows


def local_rows(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame | None:
    """``df`` evaluated once to a local table of at most ``max_rows`` rows, else ``None``.

    Spark knows the exact size of a local table and broadcasts it on its own.
    """
    head = small_table(df, max_rows)
    return None if head is None else df.sparkSession.createDataFrame(head, df.schema)


def small_table(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> pa.Table | None:
    """Rows of ``df`` when there are at most ``max_rows``, else ``None``."""
    head = df.limit(max_rows + 1).toArrow()
    return head if head.num_rows <= max_rows else None


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint when a count proves it small, else unchanged.

    Unchanged sides are joined by shuffle, where adaptive execution splits hot keys.
    """
    return F.broadcast(df) if fits(df, max_rows) else df


# Tasks over which the rows of one join key are spread where its rows aren't counted.
SALTS = 16
# Rows of a key that one task takes where they are.
ROWS_PER_SALT = 1_000_000


def salted_join(
    rows: DataFrame,
    side: DataFrame,
    keys: list[str],
    spread_by: str,
    salts: int = SALTS,
    counted: str | None = None,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Equi-join for keys that may hold a large part of ``rows``.

    Rows of a key are spread by a hash of ``spread_by``, and the smaller ``side`` is repeated once per
    salt, so every pair still meets exactly once. ``counted`` names a column of ``side`` that
    holds the number of ``rows`` of its key: then a key has a salt per ``rows_per_salt`` rows, and only
    keys with more than one are repeated.
    """
    hashed = F.xxhash64(spread_by)
    if counted is None:
        side = side.withColumn("__salts", F.lit(salts))
        rows = rows.withColumn("__salt", F.pmod(hashed, F.lit(salts)).cast("int"))
    else:
        side = side.withColumn("__salts", F.greatest(F.lit(1), F.ceil(F.col(counted) / F.lit(rows_per_salt))).cast("int"))
        hot = broadcast_if_small(side.where("__salts > 1").select(*keys, "__salts").distinct())
        salt = F.pmod(hashed, F.coalesce("__salts", F.lit(1))).cast("int")
        rows = rows.join(hot, keys, "left").withColumn("__salt", salt).drop("__salts")
    repeated = F.explode(F.sequence(F.lit(0), F.col("__salts") - 1)).alias("__salt")
    side = side.select(*[c for c in side.columns if c != "__salts"], repeated)
    return rows.join(side, [*keys, "__salt"]).drop("__salt")


# Bytes a task may scan before its result is handed on.
TASK_BYTES = 4 << 30


def scan_tasks(df: DataFrame, per_core: int) -> int:
    """Tasks for a scan whose results are small but come from every task: some per core, more for a large table."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(per_core * df.sparkSession.sparkContext.defaultParallelism, min(size // TASK_BYTES, 1 << 20))
