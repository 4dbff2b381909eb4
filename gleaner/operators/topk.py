"""Ranking: first hits per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.constants import MAX_HITS, SCORE_DECIMALS


def query_keys(df: DataFrame) -> list[str]:
    """Columns that identify a query: ``qid``, plus ``lang`` for routed queries."""
    return ["lang", "qid"] if "lang" in df.columns else ["qid"]


def rounded(score: Column) -> Column:
    return F.round(score, SCORE_DECIMALS)


def top_k(
    df: DataFrame,
    k: int = MAX_HITS,
    score: str = "score",
    docid: str = "docid",
    ascending: bool = False,
    by: list[str] | None = None,
) -> DataFrame:
    """First ``k`` rows per query by score, ties by docid; adds ``rank`` from 1.

    ``row_number() <= k`` lets Spark drop all but ``k`` rows per query in every
    partition before the shuffle, so a query that matches everything stays small.
    """
    if k < 1:
        raise ValueError("k must be positive")
    keys = by or query_keys(df)
    order = F.col(score).asc() if ascending else F.col(score).desc()
    window = Window.partitionBy(*keys).orderBy(order, F.col(docid).asc())
    return (
        df.withColumn("rank", F.row_number().over(window).cast("bigint"))
        .where(F.col("rank") <= k)
    )
