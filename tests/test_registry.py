import pytest

import __spark_entry__ as entry
from checks.compare import compare, views

# One query per family; `python -m checks.compare` covers all of them.
FAMILIES = [
    "read_all_languages", "read_sparse_json", "load_collection", "tokenize", "parse_hits", "zip_join",
    "postings", "concat_chunk_vectors", "bm25_search_by_language", "dense_search_ip", "sparse_search",
    "maxsim_search", "hybrid_fallback", "ann_search", "fusion_normalized", "bit_rerank", "recall_at_k",
    "encode_corpus", "stream_load",
]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["qid", "docid", "score", "rank"] and df.count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", FAMILIES)
def test_query_agrees_with_sql(spark, sf, name):
    assert compare(spark, views(sf), sf, name) is None
