"""Where the score of a hit comes from."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.constants import BM25_B, BM25_K1, MAX_HITS
from gleaner.operators.bounds import broadcast_if_small
from gleaner.operators.fulltext import (
    FullTextIndex,
    bm25_search,
    bm25_weight,
    postings_join,
    query_terms,
)
from gleaner.operators.fusion import merge_hybrid, similarity_run
from gleaner.operators.topk import query_keys, rounded
from gleaner.operators.vectorsearch import dense_search
from gleaner.plans.workspace import stored


def explain_query(
    queries: DataFrame,
    index: FullTextIndex,
    vectors: DataFrame | None = None,
    k: int = MAX_HITS,
    qid: str | None = None,
    boost: float = 1.0,
    k1: float = BM25_K1,
    b: float = BM25_B,
) -> DataFrame:
    """``(qid, docid, rank, leg, part, contribution)`` of every hit.

    ``leg`` is ``keyword`` with one row per term, or ``vector`` with one row.
    ``qid`` restricts the report to one query.
    """
    if qid is not None:
        queries = queries.where(F.col("qid") == qid)
    keys = [*query_keys(queries), "docid"]
    # An index that isn't saved is derived from the texts by every read: what both searches need of it is written.
    asked = query_terms(queries)
    known = broadcast_if_small(asked.select("lang", "term").distinct())
    doc_freqs = stored(index.doc_freqs.join(known, ["lang", "term"], "left_semi"), "query-freqs")
    index = replace(index, doc_freqs=doc_freqs, corpus_stats=stored(index.corpus_stats, "collections"))
    # Runs hold k hits per query; written once, they serve the ranking and the parts.
    keyword = stored(bm25_search(queries, index, k, boost, k1, b), "keyword-run")
    hits = keyword
    if vectors is not None:
        dense = stored(dense_search(queries, vectors, k), "dense-run")
        hits = merge_hybrid(keyword, dense, k)
    hits = hits.select(*keys, "rank")
    terms = (
        postings_join(asked, index)
        .join(keyword, keys, "left_semi")
        .select(
            *keys,
            F.lit("keyword").alias("leg"),
            F.col("term").alias("part"),
            rounded(boost * bm25_weight(k1, b)).alias("contribution"),
        )
    )
    rows = terms
    if vectors is not None:
        legs = similarity_run(dense).select(
            *keys, F.lit("vector").alias("leg"), F.lit("l2").alias("part"),
            rounded(F.col("score")).alias("contribution"),
        )
        rows = terms.unionByName(legs)
    return hits.join(rows, keys)
