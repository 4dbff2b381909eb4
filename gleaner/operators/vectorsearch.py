"""Dense, sparse and late-interaction search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from gleaner.functions.constants import MAX_HITS
from gleaner.operators.blocksearch import QUERY_BROADCAST_ROWS, block_search
from gleaner.operators.bounds import salted_join, small_table
from gleaner.operators.sparsesearch import sparse_hits
from gleaner.operators.topk import query_keys, rounded, top_k


# Between language and query id in the key of a routed query.
KEY_MARK = "\0"


def _keyed(queries: DataFrame) -> DataFrame:
    """Routed queries named by language and id: the same id may ask in several languages."""
    return queries.withColumn("qid", F.concat("lang", F.lit(KEY_MARK), F.col("qid").cast("string")))


def _routed(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits of ``_keyed`` queries with ``lang`` and ``qid`` apart again."""
    key = F.split("qid", KEY_MARK, 2)
    return hits.select(
        key[0].alias("lang"), key[1].cast(queries.schema["qid"].dataType).alias("qid"), "docid", "score", "rank"
    )


def dense_search(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = MAX_HITS,
    metric: str = "l2",
    query_broadcast_rows: int = QUERY_BROADCAST_ROWS,
) -> DataFrame:
    """The ``k`` nearest vectors per query: smallest ``l2`` or largest ``ip``.

    ``queries`` has ``qid, qvec``, ``vectors`` has ``docid, vec``. Queries with a
    ``lang`` column only meet vectors of that language. A null or empty query
    vector has no hits.
    """
    if metric not in ("l2", "ip"):
        raise ValueError(f"unknown metric {metric!r}; use l2 or ip")
    routed = "lang" in queries.columns
    docs = vectors.withColumnRenamed("vec", "dvec")
    asked = _keyed(queries) if routed else queries
    hits = block_search(asked, docs, k, metric, "lang" if routed else None, query_broadcast_rows)
    if routed:
        return _routed(hits, queries)
    return hits.select("qid", "docid", "score", "rank")


def knn_join(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Every query with its ``k`` nearest vectors and their place in the order."""
    return dense_search(queries, vectors, k, metric).withColumnRenamed("score", "distance")


def maxsim_search(
    queries: DataFrame,
    multivecs: DataFrame,
    k: int = MAX_HITS,
    query_broadcast_rows: int = QUERY_BROADCAST_ROWS,
) -> DataFrame:
    """Late interaction: sum over query tokens of the best inner product.

    ``queries`` has ``qid, qvecs``, ``multivecs`` has ``docid, vecs``; both are
    arrays of token vectors. Queries with a ``lang`` column stay in their language.
    """
    routed = "lang" in queries.columns
    asked = _keyed(queries) if routed else queries
    hits = block_search(
        asked.withColumnRenamed("qvecs", "qvec"),
        multivecs.withColumnRenamed("vecs", "dvec"),
        k,
        "maxsim",
        "lang" if routed else None,
        query_broadcast_rows,
    )
    if routed:
        return _routed(hits, queries)
    return hits.select("qid", "docid", "score", "rank")


def sparse_search(queries: DataFrame, docs: DataFrame, k: int = MAX_HITS) -> DataFrame:
    """Inner product over shared indices of sparse vectors.

    ``queries`` has ``qid, sparse`` and ``docs`` has ``docid, sparse``, both maps
    from index to weight. A document is one row: with few query entries it is scored where it
    lies, and only the best hits of each task are shuffled. More query entries than may be
    broadcast meet the documents' entries in a salted join.
    """
    keys = query_keys(queries)
    routed = [c for c in ("lang",) if c in queries.columns]
    query_entries = queries.select(*keys, F.explode("sparse").alias("idx", "qval"))
    few = small_table(query_entries)
    if few is not None:
        schema = ST.StructType([*(queries.schema[c] for c in keys), docs.schema["docid"], ST.StructField("score", ST.DoubleType())])
        return top_k(sparse_hits(few, keys, docs, k, schema), k)
    doc_entries = docs.select(
        *routed, "docid", F.explode("sparse").alias("idx", "dval")
    )
    rows = salted_join(doc_entries, query_entries, [*routed, "idx"], "docid")
    scores = rows.groupBy(*keys, "docid").agg(
        rounded(F.sum(F.col("qval").cast("double") * F.col("dval").cast("double"))).alias("score")
    )
    return top_k(scores, k)
