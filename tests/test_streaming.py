import pytest
from pyspark.sql import functions as F

from checks import inputs as I
from checks.queries import streamed
from gleaner.functions.encoders import HashingEncoder
from gleaner.operators import encode, fulltext
from gleaner.plans.experiment import Collection, search
from gleaner.plans.workspace import fresh_dir
from gleaner.streaming import jobs
from tests.conftest import rows


def parts(spark, n=5):
    """Documents in ``n`` files, ten rows each, as a stream of one file per batch."""
    schema = "docid string, text string"
    path = fresh_dir(spark, "t")
    for part in range(n):
        docs = [(f"d{part}{i}", f"text {part} {i}") for i in range(10)]
        spark.createDataFrame(docs, schema).coalesce(1).write.mode("append").parquet(path)
    vectors = spark.createDataFrame(
        [(f"d{p}{i}", [float(p), float(i)]) for p in range(n) for i in range(10)], "docid string, vec array<float>"
    )
    stream = jobs.read_stream(spark, path, spark.read.parquet(path).schema, 1)
    return stream, vectors


def test_a_bad_batch_is_reported_and_the_rest_lands(spark):
    stream, vectors = parts(spark)

    def check(batch):
        if batch.where(F.col("docid") == "d23").count():
            raise ValueError("unusable record")

    out = fresh_dir(spark, "t")
    report = jobs.stream_load(stream, vectors, out, check=check)
    got = rows(report, "n_rows", "error")
    assert len(got) == 5 and got.count((10, None)) == 4 and (0, "ValueError: unusable record") in got
    loaded = jobs.read_loaded(spark, out, vectors.join(spark.createDataFrame([], "docid string, text string"), "docid").schema)
    assert loaded.count() == 40 and loaded.where(F.col("docid").startswith("d2")).count() == 0


def test_a_platform_error_fails_the_batch(spark):
    stream, vectors = parts(spark, 1)

    def check(batch):
        raise OSError("storage is away")

    out = fresh_dir(spark, "t")
    with pytest.raises(Exception, match="storage is away"):
        jobs.stream_load(stream, vectors, out, check=check)
    assert jobs.stream_load(stream, vectors, out).agg(F.sum("n_rows")).first()[0] == 10  # repeated, nothing lost


def test_load_stops_at_the_cap_and_a_restart_adds_nothing(spark):
    stream, vectors = parts(spark)
    out = fresh_dir(spark, "t")
    report = jobs.stream_load(stream, vectors, out, max_rows=23)
    assert report.agg(F.sum("n_rows")).first()[0] == 23
    again = jobs.stream_load(stream, vectors, out, max_rows=23)
    assert again.agg(F.sum("n_rows")).first()[0] == 23


def test_stream_encoding_equals_batch_encoding(spark, sf):
    stream = streamed(spark, I.corpus(spark, sf), "t", 4, 1)
    got = jobs.stream_encode(stream, "text", HashingEncoder, fresh_dir(spark, "t"))
    want = encode.encode_corpus(I.corpus(spark, sf), "text", HashingEncoder)
    assert rows(got, "docid", "vec") == rows(want, "docid", "vec")


def test_stream_search_equals_batch_search(spark, sf):
    index = fulltext.build_fulltext_index(I.corpus(spark, sf), partitions=4)
    context = Collection(fulltext.save_fulltext_index(index, "test_stream"), I.vectors(spark, sf))
    queries = I.query_vectors(spark, sf)
    stream = streamed(spark, queries, "t", 2, 1)
    got = jobs.stream_search(stream, context, "hybrid_dense_bm25", fresh_dir(spark, "t"), 20)
    want = search(queries, context, "hybrid_dense_bm25", 20)
    cols = ("qid", "docid", "score", "rank")
    assert rows(got, *cols) == rows(want, *cols)
