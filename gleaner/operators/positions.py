"""Row positions and the operators that rely on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.functions.constants import BASE_ID_GROUP
from gleaner.plans.workspace import stored
from gleaner.sources.files import natural_key

ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def assign_positions(
    df: DataFrame, order_by: str | list[str], partitions: int | None = None
) -> DataFrame:
    """``df`` with a gap-free 0-based ``pos`` in the order of ``order_by``.

    ``order_by`` must identify a row and hold no nulls. Only the order columns are sorted: they are
    range-partitioned and written once, so a lost executor cannot change the
    ranges; the start of every range comes from one count per range; the
    positions then join back to the wide rows.
    """
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    narrow = df.select(*keys)
    ranged = narrow.repartitionByRange(partitions, *keys) if partitions else narrow.repartitionByRange(*keys)
    row_id = F.monotonically_increasing_id()
    part, place = "__part", "__place"  # names no caller uses
    located = stored(
        ranged.sortWithinPartitions(*keys).select(
            *keys,
            F.shiftright(row_id, ROW_BITS).alias(part),
            row_id.bitwiseAND((1 << ROW_BITS) - 1).alias(place),
        ),
        "positions",
    )
    # One row per range partition, a number this job chose itself.
    sizes = sorted((r[part], r["count"]) for r in located.groupBy(part).count().collect())
    starts, total = [], 0
    for number, size in sizes:
        starts.append((number, total))
        total += size
    offsets = df.sparkSession.createDataFrame(starts, f"{part} bigint, __start bigint")
    pos = located.join(F.broadcast(offsets), part).select(
        *keys, (F.col("__start") + F.col(place)).alias("pos")
    )
    if set(df.columns) == set(keys):
        return pos
    return df.join(pos, keys)


def assign_source_positions(df: DataFrame) -> DataFrame:
    """``df``, a scan of files, with the gap-free 0-based ``pos`` of each row in its files.

    Files count in the order of their names, numbers in them by value. Nothing is sorted and no row moves: a row's place
    in its split is its place in the task, and the starts of the splits come from one
    count per split. ``df`` may have projections and computed columns, but no filter and no shuffle.
    """
    file, start, row = "__file", "__start", "__row"  # names no caller uses
    first = df.columns[0]
    located = df.select(
        "*",
        F.col("_metadata.file_path").alias(file),
        F.col("_metadata.file_block_start").alias(start),
        F.monotonically_increasing_id().alias(row),
    )
    # The first column is counted as well, so that this scan parses rows as the other one does.
    splits = located.groupBy(file, start).agg(F.count("*").alias("n"), F.min(row).alias("low"), F.count(first)).collect()
    offsets, total = [], 0
    for split in sorted(splits, key=lambda s: (natural_key(s[file]), s[start])):
        offsets.append((split[file], split[start], total - split["low"]))
        total += split["n"]
    table = df.sparkSession.createDataFrame(offsets, f"{file} string, {start} bigint, __shift bigint")
    placed = located.join(F.broadcast(table), [file, start])  # a row per split of the input
    return placed.select(*df.columns, (F.col(row) + F.col("__shift")).alias("pos"))


def assign_base_id(df: DataFrame, group: int = BASE_ID_GROUP) -> DataFrame:
    """``base_id_{pos div group + 1}``."""
    return df.withColumn("base_id", T.base_id(F.col("pos"), group))


def cap_rows(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` positions."""
    return df.where(F.col("pos") < n)


def slice_range(df: DataFrame, begin: int, end: int) -> DataFrame:
    """Positions ``begin`` (included) to ``end`` (excluded)."""
    return df.where((F.col("pos") >= begin) & (F.col("pos") < end))


def check_ends(ends: list[int], total: int) -> list[int]:
    """End positions of consecutive parts of ``[0, total)``; they must increase and end at ``total``."""
    previous = 0
    for end in ends:
        if end <= previous or end > total:
            raise ValueError(f"invalid part end {end} after {previous} of {total} rows")
        previous = end
    if previous != total:
        raise ValueError(f"parts end at {previous}, rows at {total}")
    return ends


def part_of(pos: Column, ends: list[int]) -> Column:
    """Number of the part ``pos`` falls in, from 0."""
    bounds = F.array(*[F.lit(e).cast("bigint") for e in ends])
    return F.size(F.filter(bounds, lambda e: e <= pos)).cast("bigint")


def split_ranges(df: DataFrame, ends: list[int]) -> DataFrame:
    """``part_id`` and the range ``[part_begin, part_end)`` of every position."""
    check_ends(ends, df.count())
    bounds = F.array(F.lit(0).cast("bigint"), *[F.lit(e).cast("bigint") for e in ends])
    return df.withColumn("part_id", part_of(F.col("pos"), ends)).withColumns(
        {
            "part_begin": F.get(bounds, F.col("part_id").cast("int")),
            "part_end": F.get(bounds, F.col("part_id").cast("int") + 1),
        }
    )


def zip_join(left: DataFrame, right: DataFrame, strict: bool = False) -> DataFrame:
    """The i-th row of ``left`` with the i-th row of ``right``; surplus rows are dropped.

    ``strict`` demands equal numbers of rows.
    """
    if strict:
        n_left, n_right = left.count(), right.count()
        if n_left != n_right:
            raise ValueError(f"{n_left} rows cannot be paired with {n_right} rows")
    return left.join(right, "pos")
