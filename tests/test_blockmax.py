"""Pruned search against the exhaustive one."""

import random

import pytest

from gleaner.operators import blockmax, fulltext
from tests.conftest import rows

COLUMNS = ("qid", "docid", "score", "rank")


@pytest.fixture(scope="module")
def texts():
    """Subjects with words of their own in short and long documents, and words that all share."""
    rnd = random.Random(11)
    common = [f"common{i}" for i in range(40)]
    subjects = [[f"word{s}x{i}" for i in range(25)] for s in range(60)]
    docs = []
    for i in range(6000):
        subject = subjects[rnd.randrange(60)]
        size = rnd.choice([8, 20, 60, 200])
        docs.append((f"d{i}", " ".join(rnd.choice(subject if rnd.random() < 0.3 else common) for _ in range(size))))
    queries = [(f"q{i}", " ".join(rnd.sample(subjects[i], 4) + rnd.sample(common, 2))) for i in range(30)]
    return docs, queries


@pytest.fixture(scope="module")
def index(spark, texts):
    docs = spark.createDataFrame(texts[0], "docid string, text string")
    return fulltext.save_fulltext_index(fulltext.build_fulltext_index(docs), "blockmax_test")


def test_hits_are_exact_and_most_postings_stay_unread(spark, texts, index):
    queries = spark.createDataFrame(texts[1], "qid string, query string")
    blocks = blockmax.save_block_index(blockmax.build_block_index(index, range_docs=8))
    found = blockmax.pruned_search(queries, blocks, 10)
    assert rows(found.hits, *COLUMNS) == rows(fulltext.bm25_search(queries, index, 10), *COLUMNS)
    everything = fulltext.postings_join(fulltext.query_terms(queries), index).count()
    assert found.read.count() < 0.5 * everything


@pytest.mark.parametrize(("k", "first"), [(1, 1), (3, 200), (2000, None)])
def test_other_sizes(spark, texts, index, k, first):
    asked = [*texts[1][:6], ("none", "nothing"), ("rare", "word1x1"), ("null", None), ("all", " ".join(f"common{i}" for i in range(40)))]
    queries = spark.createDataFrame(asked, "qid string, query string")
    found = blockmax.pruned_search(queries, blockmax.build_block_index(index), k, first)
    assert rows(found.hits, *COLUMNS) == rows(fulltext.bm25_search(queries, index, k), *COLUMNS)


def test_ties_languages_and_nothing(spark):
    docs = spark.createDataFrame([(lang, f"{i:03}", "same words here" + " more" * (i % 2)) for lang in ("en", "fr") for i in range(90)], "lang string, docid string, text string")
    index = fulltext.build_fulltext_index(docs)
    blocks = blockmax.build_block_index(index, range_docs=4)
    queries = spark.createDataFrame([("en", "q", "same words"), ("fr", "q", "here more"), ("de", "q", "same")], "lang string, qid string, query string")
    got = blockmax.block_max_search(queries, blocks, 10)
    assert rows(got, "lang", *COLUMNS) == rows(fulltext.bm25_search(queries, index, 10), "lang", *COLUMNS)
    assert blockmax.block_max_search(queries.limit(0), blocks, 10).count() == 0


def test_saving_reads_the_postings_once(spark, tmp_path):
    from dataclasses import replace

    docs = spark.createDataFrame([("a", "red fish"), ("b", "red sky")], "docid string, text string")
    built = blockmax.build_block_index(fulltext.build_fulltext_index(docs))
    saved = blockmax.save_block_index(replace(built, maxima=None, doc_freqs=None), str(tmp_path))
    assert {(r.term, r.df) for r in saved.doc_freqs.collect()} == {("red", 2), ("fish", 1), ("sky", 1)}
    assert rows(saved.maxima, *built.maxima.columns) == rows(built.maxima, *built.maxima.columns)


def test_texts_are_cut_once_and_ranges_travel_in_parts(spark, texts, monkeypatch):
    """An index that isn't saved is made of written segments; the numbers of the queries of a range are broadcast in parts of bounded size."""
    docs = spark.createDataFrame([*texts[0][:1500], ("d1", "common1 twice"), ("none", None)], "docid string, text string")
    queries = spark.createDataFrame(texts[1][:12], "qid string, query string")
    built = fulltext.build_fulltext_index(docs)
    blocks = blockmax.build_block_index(built, range_docs=8)
    assert "lower(" not in blocks.postings._jdf.queryExecution().analyzed().toString()
    saved = blockmax.save_block_index(blocks)
    assert saved.maxima.select("lang", "term", "range").distinct().count() == saved.maxima.count()
    expected = rows(fulltext.bm25_search(queries, built, 10), *COLUMNS)
    monkeypatch.setattr(blockmax, "BROADCAST_PAIRS", 200)
    found = blockmax.pruned_search(queries, saved, 10, 4)
    assert rows(found.hits, *COLUMNS) == expected
    assert "Exchange hashpartitioning" not in found.read._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(blockmax, "BROADCAST_ROWS", 5)  # query terms are many: joined by shuffle
    assert rows(blockmax.block_max_search(queries, saved, 10), *COLUMNS) == expected
