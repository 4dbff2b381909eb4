import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks import inputs as I
from gleaner.functions.constants import QUERY_RESERVED_CHARS
from gleaner.operators import fulltext, textblocks
from gleaner.operators.explain import explain_query
from gleaner.operators.topk import top_k
from tests.conftest import rows

DOCS = [
    ("d1", "red fish blue fish"),
    ("d2", "blue sky"),
    ("d3", "red red red sky, a b"),
    ("d4", "x y"),  # no token of length 3
    ("d5", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "docid string, text string")


def brute_bm25(query_terms, docs, k1=1.2, b=0.75):
    bags = {d: [t for t in text.replace(",", " ").split() if len(t) >= 3] for d, text in docs if text}
    bags = {d: t for d, t in bags.items() if t}
    n, avgdl = len(bags), sum(map(len, bags.values())) / len(bags)
    out = {}
    for d, terms in bags.items():
        score = 0.0
        for t in set(query_terms):
            df = sum(t in other for other in bags.values())
            tf = terms.count(t)
            if tf:
                idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                score += idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(terms) / avgdl))
        if score:
            out[d] = round(score, 6)
    return out


def test_bm25_equals_brute_force(spark, docs):
    queries = spark.createDataFrame(
        [("q1", "red fish"), ("q2", "sky?"), ("q3", "a b"), ("q4", None)], "qid string, query string"
    )
    index = fulltext.build_fulltext_index(docs)
    got = rows(fulltext.bm25_search(queries, index, 10), "qid", "docid", "score")
    want = [("q1", d, s) for d, s in brute_bm25(["red", "fish"], DOCS).items()]
    want += [("q2", d, s) for d, s in brute_bm25(["sky"], DOCS).items()]
    assert got == sorted(want)


def test_large_query_sets_take_the_salted_join(spark, docs, monkeypatch):
    queries = spark.createDataFrame([("q1", "red fish"), ("q2", "sky")], "qid string, query string")
    index = fulltext.build_fulltext_index(docs)
    small = rows(fulltext.bm25_search(queries, index), "qid", "docid", "score", "rank")
    monkeypatch.setattr(fulltext, "small_table", lambda df: None)
    salted = fulltext.bm25_search(queries, index)
    assert rows(salted, "qid", "docid", "score", "rank") == small


def test_long_vocabularies_are_not_listed(spark, docs, monkeypatch):
    queries = spark.createDataFrame([("q1", "red fish")], "qid string, query string")
    index = fulltext.build_fulltext_index(docs)
    listed = rows(fulltext.bm25_search(queries, index), "qid", "docid", "score")
    monkeypatch.setattr(fulltext, "PUSHED_TERMS", 1)
    assert rows(fulltext.bm25_search(queries, index), "qid", "docid", "score") == listed


def test_partitioning_of_the_input_does_not_matter(spark, sf):
    queries = I.queries(spark, sf)
    one = fulltext.bm25_search(queries, fulltext.build_fulltext_index(I.corpus(spark, sf)), 5)
    many = I.corpus(spark, sf).repartition(13, "text")
    two = fulltext.bm25_search(queries.repartition(3), fulltext.build_fulltext_index(many, partitions=5), 5)
    cols = ("qid", "docid", "score", "rank")
    assert rows(one, *cols) == rows(two, *cols)


def test_documents_are_shuffled_once(spark, sf):
    """Scoring needs no shuffle by (query, document): the text move is the only big one."""
    index = fulltext.build_fulltext_index(I.corpus(spark, sf))
    scores = fulltext.postings_join(fulltext.query_terms(I.queries(spark, sf)), index)
    scores = scores.groupBy("qid", "docid").count()
    plan = scores._jdf.queryExecution().executedPlan().toString()
    scoring_side = plan.split("BroadcastExchange")[0]
    assert scoring_side.count("Exchange hashpartitioning") == 1


def test_saved_index_keeps_buckets_and_needs_no_exchange(spark, sf):
    index = fulltext.build_fulltext_index(I.corpus(spark, sf), partitions=4)
    saved = fulltext.save_fulltext_index(index, "test_saved")
    counted = saved.postings.groupBy("docid", "term").count()
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    assert rows(saved.corpus_stats, "n") == rows(index.corpus_stats, "n")


def test_normalize_keeps_length(spark):
    text = f"a{QUERY_RESERVED_CHARS}b"
    df = spark.createDataFrame([("q", text)], "qid string, query string")
    [(query,)] = rows(fulltext.normalize_query(df), "query")
    assert query == "a" + " " * 14 + "b"


def test_sanitised_and_raw_queries_have_the_same_terms(spark):
    df = spark.createDataFrame([("q", "don't (stop) me–now ~x^yes")], "qid string, query string")
    raw = rows(fulltext.query_terms(df), "term")
    assert rows(fulltext.query_terms(fulltext.normalize_query(df)), "term") == raw


def test_token_length_limits(spark):
    df = spark.createDataFrame([("d", "ab abc " + "x" * 84 + " " + "y" * 85)], "docid string, text string")
    got = rows(fulltext.tokenize(df), "pos", "term")
    assert got == [(1, "abc"), (2, "x" * 84)]


def test_top_k_breaks_ties_by_docid_and_rejects_nonsense(spark):
    df = spark.createDataFrame(
        [("q", "b", 1.0), ("q", "a", 1.0), ("q", "c", 2.0)], "qid string, docid string, score double"
    )
    assert rows(top_k(df, 2), "rank", "docid") == [(1, "c"), (2, "a")]
    with pytest.raises(ValueError):
        top_k(df, 0)


def test_contributions_add_up_to_the_score(spark, docs):
    queries = spark.createDataFrame([("q1", "red fish sky"), ("q2", "sky")], "qid string, query string")
    index = fulltext.build_fulltext_index(docs)
    parts = explain_query(queries, index, k=10, qid="q1").groupBy("docid").agg(F.sum("contribution").alias("s"))
    got = {d: s for d, s in rows(parts, "docid", "s")}
    want = brute_bm25(["red", "fish", "sky"], DOCS)
    assert got.keys() == want.keys()
    assert all(abs(got[d] - want[d]) < 1e-5 for d in want)


def test_planted_passages_are_found(spark, sf):
    """Documents that contain a benchmark passage rank first for it."""
    import duckdb

    pairs = duckdb.sql(
        f"SELECT CAST(item_id AS VARCHAR), CAST(doc_id AS VARCHAR) FROM '{sf}/benchmark.parquet' b "
        f"JOIN '{sf}/documents.parquet' d ON contains(d.text, b.text)"
    ).fetchall()
    run = fulltext.bm25_search(I.queries(spark, sf), fulltext.build_fulltext_index(I.corpus(spark, sf)), 10)
    found = {(q, d) for q, d in rows(run, "qid", "docid")}
    assert pairs and set(pairs) <= found


def test_a_third_of_all_documents_being_copies_changes_nothing(spark):
    """Hot terms and tied scores: all copies score alike and rank by docid."""
    copies = [(f"c{i:03d}", "red fish red") for i in range(60)]
    others = [(f"o{i:03d}", f"blue sky word{i}" + (" red" if i % 7 == 0 else "")) for i in range(120)]
    docs = spark.createDataFrame(copies + others, "docid string, text string").repartition(9)
    queries = spark.createDataFrame([("q1", "red fish"), ("q2", "word7 red")], "qid string, query string")
    index = fulltext.build_fulltext_index(docs)
    got = rows(fulltext.bm25_search(queries, index, 200), "qid", "docid", "score")
    want = [("q1", d, s) for d, s in brute_bm25(["red", "fish"], copies + others).items()]
    want += [("q2", d, s) for d, s in brute_bm25(["word7", "red"], copies + others).items()]
    assert got == sorted(want)
    top = rows(fulltext.bm25_search(queries.where("qid = 'q1'"), index, 10), "rank", "docid")
    assert sorted(top) == [(i + 1, f"c{i:03d}") for i in range(10)]


def test_only_counted_hot_keys_are_repeated(spark):
    from gleaner.operators.bounds import salted_join

    rows_ = spark.range(1000).selectExpr("case when id % 4 = 0 then concat('t', id) else 'hot' end as term", "id as docid")
    side = rows_.groupBy("term").count().withColumnRenamed("count", "df")
    joined = salted_join(rows_, side, ["term"], "docid", counted="df", rows_per_salt=100)
    assert joined.count() == 1000 and joined.columns == ["term", "docid", "df"]
    assert rows(joined.where("term = 'hot'").select("docid"), "docid") == rows(rows_.where("term = 'hot'"), "docid")
    assert {r.df for r in joined.collect()} == {1, 750}


def test_many_queries_meet_blocks_of_documents(spark, monkeypatch):
    """Several blocks of both, equal scores at the cut, repeated ids, languages."""
    words = ["red", "fish", "blue", "sky", "the"]
    texts = [("en" if i % 3 else "de", i % 70, " ".join(words[j] for j in range(5) if i >> j & 1)) for i in range(90)]
    docs = spark.createDataFrame(texts, "lang string, docid long, text string")
    asked = [(lang, f"q{i}", " ".join(words[i % 5 :])) for i in range(12) for lang in ("de", "en", "xx")]
    queries = spark.createDataFrame([*asked, ("en", "none", None), ("en", "twice", "red"), ("en", "twice", "red sky")], "lang string, qid string, query string")
    index = fulltext.build_fulltext_index(docs)
    cols = ("lang", "qid", "docid", "score", "rank")
    paired = rows(fulltext.bm25_search(queries, index, 7), *cols)
    monkeypatch.setattr(fulltext, "PAIRED_QUERIES", 0)
    monkeypatch.setattr(textblocks, "DOC_BLOCK_ROWS", 10)
    monkeypatch.setattr(textblocks, "QUERY_BLOCK_ROWS", 5)
    monkeypatch.setattr(textblocks, "HIT_ROWS", 3)
    blocked = fulltext.bm25_search(queries, index, 7)
    assert "FlatMapGroupsInArrow" in blocked._jdf.queryExecution().toString()
    assert rows(blocked, *cols) == paired
    alone = queries.where("lang = 'en'").drop("lang")
    assert rows(fulltext.bm25_search(alone, fulltext.build_fulltext_index(docs.drop("lang")), 7, boost=2.0), *cols[1:])


def test_partitions_grow_with_the_text(spark, docs, monkeypatch):
    monkeypatch.setattr(fulltext, "TEXT_BYTES", 4)
    assert fulltext.build_fulltext_index(docs, partitions=2).partitions == 13  # 49 bytes
    saved = fulltext.save_fulltext_index(fulltext.build_fulltext_index(docs, partitions=2), "grown")
    assert spark.sql("describe extended grown_postings").where("col_name = 'Num Buckets'").first().data_type == "13"
    monkeypatch.setattr(fulltext, "TEXT_BYTES", 1 << 20)
    assert fulltext.build_fulltext_index(docs, partitions=2).partitions == 2
    assert saved.postings.count() == 7


def test_explaining_reads_the_texts_for_the_postings_only(spark, docs):
    queries = spark.createDataFrame([("q1", "red fish"), ("q2", "sky")], "qid string, query string")
    plan = explain_query(queries, fulltext.build_fulltext_index(docs), k=1)._jdf.queryExecution().analyzed().toString()
    assert plan.count("AS terms#") == 1  # not for frequencies and statistics as well


def test_large_query_sets_leave_documents_where_they_are(spark, monkeypatch):
    """Hits equal those of the paired way with thresholds, looked-up lists and ties; only the best of a few chains are moved."""
    rnd = random.Random(5)
    common, rare = [f"common{i}" for i in range(6)], [f"rare{i}" for i in range(150)]
    texts = [(i, " ".join(rnd.choice(common if rnd.random() < 0.8 else rare) for _ in range(rnd.choice([5, 12, 40])))) for i in range(1500)]
    texts += [(5000 + i, texts[i % 40][1]) for i in range(400)]  # equal scores
    docs = spark.createDataFrame(texts, "docid long, text string")
    queries = spark.createDataFrame([(f"q{i}", " ".join([*rnd.sample(common, 3), *rnd.sample(rare, i % 4)])) for i in range(60)], "qid string, query string")
    built = fulltext.build_fulltext_index(docs)
    cols = ("qid", "docid", "score", "rank")
    paired = rows(fulltext.bm25_search(queries, built, 6), *cols)
    monkeypatch.setattr(fulltext, "PAIRED_QUERIES", 0)
    monkeypatch.setattr(textblocks, "DOC_BLOCK_ROWS", 60)
    for index in (built, fulltext.save_fulltext_index(built, "large_query_sets")):
        blocked = fulltext.bm25_search(queries, index, 6)
        assert blocked._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1  # no postings or texts beside the written segments
        assert rows(blocked, *cols) == paired
        plan = blocked._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hash") == 1 and "Exchange hashpartitioning(block" in plan


BAGS = pa.list_(pa.struct([("dl", pa.int64()), ("words", pa.string()), ("tfs", pa.list_(pa.int32()))]))


def test_a_chain_hands_on_k_hits_of_a_query_however_many_its_documents():
    asked = pa.table({"lang": [""], "qid": ["q"], "words": ["red sky"], "idfs": [[1.0, 2.0]], "avgdl": [2.0]})
    chain = textblocks._Chain(asked, 3, 1.0, 1.2, 0.75)
    for start in range(0, 50, 10):
        bags = textblocks._Bags()
        ids = [f"d{i:02}" for i in range(start, start + 10)]
        words = [[{"dl": 2, "words": "red sky" if i % 20 == 7 else "red fish", "tfs": None}] for i in range(start, start + 10)]
        bags.add(pa.RecordBatch.from_arrays([pa.array(ids), pa.array(words, BAGS)], ["docid", "bags"]))
        chain.meet("", [textblocks._arrays(bags.segment())])
    [blob] = chain.hits(10)
    assert sorted(textblocks._arrays(blob)["docid"].to_pylist()) == ["d07", "d27", "d47"]
