"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BROADCAST_ROWS = 200_000  # narrow rows of ids: some ten MB


def checked_broadcast(written: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of narrow rows, with a broadcast hint when its row count proves it small.

    Beyond that it is joined by shuffle, where adaptive execution splits hot keys.
    The count of a written table comes from its file footers.
    """
    return F.broadcast(written) if written.count() <= max_rows else written


def ascii_lower(column):
    """A-Z to a-z and nothing else. ``lower`` does the same, faster, on a text of ASCII characters alone."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    column = F.col(column) if isinstance(column, str) else column
    plain = F.octet_length(column) == F.char_length(column)
    return F.when(plain, F.lower(column)).otherwise(F.translate(column, upper, upper.lower()))
