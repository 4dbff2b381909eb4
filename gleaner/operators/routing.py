"""Pairing queries with their vectors and their collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.functions.constants import COLLECTION_PREFIX
from gleaner.operators.positions import zip_join


def zip_queries(queries: DataFrame, vectors: DataFrame, strict: bool = True) -> DataFrame:
    """``(pos, qid, query, target, qvec)``: text, sanitised text and vector by position."""
    paired = zip_join(queries, vectors.select("pos", F.col("vec").alias("qvec")), strict)
    return paired.select("pos", "qid", "query", T.sanitized(F.col("query")).alias("target"), "qvec")


def route_by_language(queries: DataFrame, collection: DataFrame) -> DataFrame:
    """Name and size of the collection that answers each query.

    The collection is counted per language first, so no query meets its documents
    here; the searches route by joining on ``lang`` together with the term or cell.
    """
    sizes = collection.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"))
    return queries.join(sizes, "lang", "left").select(
        *queries.columns,
        F.concat(F.lit(COLLECTION_PREFIX), F.col("lang")).alias("collection"),
        F.coalesce("n_docs", F.lit(0).cast("bigint")).alias("n_docs"),
    )
