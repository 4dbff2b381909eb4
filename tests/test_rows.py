import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.functions.encoders import HashingEncoder
from gleaner.operators import chunking, encode, positions, routing
from gleaner.operators.hits import parse_hits
from gleaner.plans import load
from gleaner.plans.workspace import fresh_dir
from tests.conftest import rows


def test_positions_are_gap_free_for_any_partitioning(spark):
    df = spark.range(0, 3000, 3).withColumn("group", F.col("id") % 2).repartition(11)
    got = positions.assign_positions(df, ["group", "id"], partitions=6)
    want = sorted((i % 2, i) for i in range(0, 3000, 3))
    assert [(r.group, r.id) for r in got.orderBy("pos").collect()] == want
    assert rows(got.agg(F.min("pos"), F.max("pos"), F.count_distinct("pos")), "*") == [(0, 999, 1000)]


def test_positions_of_nothing(spark):
    assert positions.assign_positions(spark.range(0), "id").count() == 0


def test_base_ids(spark):
    df = spark.createDataFrame([(0,), (499,), (500,)], "pos bigint")
    assert rows(positions.assign_base_id(df), "pos", "base_id") == [(0, "base_id_1"), (499, "base_id_1"), (500, "base_id_2")]


def test_parts(spark):
    df = spark.range(10).withColumnRenamed("id", "pos")
    got = rows(positions.split_ranges(df, [3, 10]), "pos", "part_id", "part_begin", "part_end")
    assert got[2] == (2, 0, 0, 3) and got[3] == (3, 1, 3, 10)
    for ends in ([3, 3, 10], [5, 4, 10], [11], [5]):
        with pytest.raises(ValueError):
            positions.split_ranges(df, ends)


def test_zip_join_drops_the_surplus_or_refuses(spark):
    docs = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "pos bigint, docid string")
    vecs = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "pos bigint, vec array<float>")
    assert rows(positions.zip_join(docs, vecs), "docid", "vec") == [("a", [1.0]), ("b", [2.0])]
    with pytest.raises(ValueError):
        positions.zip_join(docs, vecs, strict=True)


def test_routing_reports_missing_collections(spark):
    q = spark.createDataFrame([("q1", "en"), ("q2", "th")], "qid string, lang string")
    docs = spark.createDataFrame([("a", "en"), ("b", "en")], "docid string, lang string")
    got = rows(routing.route_by_language(q, docs), "qid", "collection", "n_docs")
    assert got == [("q1", "test_insert_en", 2), ("q2", "test_insert_th", 0)]


RESPONSES = {
    "flat": '[{"docid_col":"a","_score":1.5},{"docid_col":"","_score":9},{"docid_col":"b","_keyword_score":2,"_semantic_score":7,"_score":1},{"docid_col":"c","_keyword_score":null,"_semantic_score":"3.5"}]',
    "nested": '{"hits":{"hits":[{"_score":4,"_source":{"docid_col":"a"}},{"_score":1,"_source":{"docid_col":"","_semantic_score":2.5}},{"_score":1,"_source":{}},{"_score":null,"_source":{"docid_col":"z"}}]}}',
    "mixed": '[1, "x", null, {"docid_col":"m","_score":1}]',
    "broken": '[{"docid_col":"a"',
    "trailing": '[{"docid_col":"a","_score":1}]]',
    "bad_score": '[{"docid_col":"a","_score":1},{"docid_col":"b","_score":"much"}]',
    "other": '{"took": 3}',
    "empty": "",
    "none": None,
    "no_hits": "[]",
}


def test_parse_hits(spark):
    df = spark.createDataFrame(list(RESPONSES.items()), "qid string, response string")
    got = rows(parse_hits(df), "qid", "rank", "docid", "score")
    assert got == [
        ("flat", 1, "a", 1.5), ("flat", 2, "b", 2.0), ("flat", 3, "c", 3.5),
        ("mixed", 1, "m", 1.0),
        ("nested", 1, "a", 4.0), ("nested", 2, "", 2.5), ("nested", 3, "z", 0.0),
    ]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=300), st.integers(2, 40))
def test_recursive_chunks_lose_nothing_but_whitespace(text, size):
    chunks = chunking.recursive_chunks(text, size)
    assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
    assert "".join("".join(chunks).split()) == "".join(text.split())


def test_recursive_chunks_prefer_paragraphs():
    text = "one two\n\nthree four five\nsix\n\n" + "x" * 25
    # A break counts with the piece it precedes.
    assert chunking.recursive_chunks(text, 22) == ["one two", "three four five\nsix", "x" * 21, "x" * 4]
    assert chunking.recursive_chunks(text, 20) == ["one two", "three four five", "six", "x" * 19, "x" * 6]


def test_chunk_modes(spark):
    df = spark.createDataFrame([("a", "abcdefgh"), ("b", ""), ("c", None)], "docid string, text string")
    fixed = chunking.chunk_documents(df, 3, 1, mode="fixed")
    assert rows(fixed, "docid", "chunk_no", "chunk") == [("a", 0, "abc"), ("a", 1, "cde"), ("a", 2, "efg"), ("a", 3, "gh")]
    assert rows(chunking.chunk_documents(df, 5), "docid", "chunk_no", "chunk") == [("a", 0, "abcde"), ("a", 1, "fgh")]
    for size, overlap, mode in ((3, 3, "fixed"), (3, 0, "other")):
        with pytest.raises(ValueError):
            chunking.chunk_documents(df, size, overlap, mode)


def test_truncation(spark):
    df = spark.createDataFrame([("a", "x  y\nz"), ("b", "one")], "docid string, text string")
    assert rows(chunking.truncate_text(df, 2), "docid", "text") == [("a", "x y"), ("b", "one")]


def test_encoder_gets_batches_of_the_asked_size(spark):
    class Recorder:
        def encode(self, texts):
            return [[float(len(texts)), float(len(t))] for t in texts]

    df = spark.createDataFrame([(i, "x" * i) for i in range(7)], "docid bigint, text string").coalesce(1)
    got = encode.encode_corpus(df, "text", Recorder, batch_size=3).orderBy("docid").collect()
    assert [r.vec for r in got] == [[3.0, 0.0], [3.0, 1.0], [3.0, 2.0], [3.0, 3.0], [3.0, 4.0], [3.0, 5.0], [1.0, 6.0]]


@pytest.mark.parametrize("budget", [1, 7, 64, 1000])
def test_budget_batches_hold_their_budget(budget):
    lengths = np.random.default_rng(budget).integers(0, 40, 500)
    made = encode.budget_batches(lengths, budget, 32)
    assert sorted(np.concatenate(made).tolist()) == list(range(500))
    for some in made:
        assert len(some) <= 32 and (len(some) == 1 or len(some) * lengths[some].max() <= budget)
    assert encode.budget_batches(lengths[:0], budget, 32) == []
    with pytest.raises(ValueError):
        encode.budget_batches(lengths, 0, 32)


def test_budget_encoding_gives_the_same_vectors_with_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("docid"), "text")
    docs = docs.union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "a " * 50_000), (-3, "a " * 50_000)], docs.schema)).coalesce(2)
    plain = encode.encode_corpus(docs, "text", HashingEncoder)
    packed = encode.encode_corpus(docs, "text", HashingEncoder, token_budget=8192)
    assert rows(packed, "docid", "vec") == rows(plain, "docid", "vec")
    report = encode.padding_report(docs, "text", HashingEncoder, token_budget=8192).first()
    naive = encode.padding_report(docs, "text", HashingEncoder).first()
    assert report.tokens == naive.tokens and report.padding < 0.1 < naive.padding
    assert encode.padding_report(docs.limit(0), "text", HashingEncoder, token_budget=10).first().padding == 0.0


def test_hashing_encoder_is_additive():
    e = HashingEncoder(16)
    assert (e.encode(["a b"])[0] == e.encode(["a"])[0] + e.encode(["b"])[0]).all()
    assert (e.encode([""])[0] == 0).all()


def docs_and_vectors(spark, n_docs, n_vecs):
    docs = spark.createDataFrame([(i, f"d{i}", f"text {i}") for i in range(n_docs)], "pos bigint, docid string, text string")
    vecs = spark.createDataFrame([(i, [float(i)]) for i in range(n_vecs)], "pos bigint, vec array<float>")
    return docs, vecs


def test_bad_batches_are_reported_and_skipped(spark):
    docs, vecs = docs_and_vectors(spark, 10, 9)
    path = fresh_dir(spark, "t")
    report = load.load_collection(docs, vecs, path, "en", batch_size=3, is_bad=F.col("docid_col") == "d4")
    assert rows(report, "batch_num", "n_rows", "n_bad", "ok") == [(1, 3, 0, True), (2, 3, 1, False), (3, 3, 0, True)]
    table = load.read_collection(spark, path)
    assert [i for (i,) in rows(table, "id")] == [1, 2, 3, 7, 8, 9]
    source = docs.withColumn("lang", F.lit("en"))
    assert rows(load.reconcile_counts(source, table), "lang", "expected", "actual", "ok") == [("en", 10, 6, False)]


def test_reload_replaces_one_language_only(spark):
    path = fresh_dir(spark, "t")
    docs, vecs = docs_and_vectors(spark, 5, 5)
    load.load_collection(docs, vecs, path, "en")
    load.load_collection(docs, vecs, path, "fr")
    load.load_collection(docs, vecs, path, "en", max_rows=2)
    table = load.read_collection(spark, path).groupBy("lang").count()
    assert rows(table, "lang", "count") == [("en", 2), ("fr", 5)]


def test_concat_chunk_vectors_follows_the_chunk_order(spark):
    df = spark.createDataFrame(
        [("a", 1, [[3.0]]), ("a", 0, [[1.0], [2.0]]), ("b", 0, [])], "docid string, chunk_no int, vecs array<array<float>>"
    )
    assert rows(encode.concat_chunk_vectors(df), "docid", "vecs") == [("a", [[1.0], [2.0], [3.0]]), ("b", [])]
