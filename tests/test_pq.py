"""Product-quantised codes: recall, size and edge cases."""

import numpy as np
from pyspark.sql import functions as F

from gleaner.operators import evaluate, pq, vectorsearch
from gleaner.plans.workspace import fresh_dir
from tests.conftest import rows


def test_recall_and_size_on_many_vectors(spark):
    path = fresh_dir(spark, "pq")

    def make(batches):
        import pyarrow as pa

        centres = np.random.default_rng(0).normal(size=(500, 64))
        for batch in batches:
            ids = batch.column(0).to_numpy()
            vectors = np.stack([centres[i % 500] + 0.6 * np.random.default_rng(int(i)).normal(size=64) for i in ids]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(list(vectors), pa.list_(pa.float32()))], ["docid", "vec"])

    spark.range(200_000).repartition(8).mapInArrow(make, "docid string, vec array<float>").write.parquet(path)
    vectors = spark.read.parquet(path)
    queries = vectors.where("cast(docid as int) % 4000 = 7").select(F.col("docid").alias("qid"), F.col("vec").alias("qvec"))
    index = pq.save_code_index(pq.build_code_index(vectors), fresh_dir(spark, "pq"))
    size = index.codes.agg(F.sum(F.length("code")), F.count("*")).first()
    assert size[1] == 200_000 and size[0] < 0.1 * 4 * 64 * size[1]
    found = pq.pq_search(queries, index, 10)
    exact = vectorsearch.dense_search(queries, vectors, 10)
    assert found.count() == 10 * queries.count()
    both = exact.join(found.select("qid", "docid", F.col("score").alias("other")), ["qid", "docid"])
    assert both.count() >= 0.9 * exact.count() and both.where("score != other").count() == 0
    assert evaluate.ann_recall(found, exact, 10).first() is not None


def test_few_odd_and_no_vectors(spark, monkeypatch):
    data = [(f"d{i}", [float(i), float(i % 3), 1.0, 0.0, float(-i)]) for i in range(40)] + [("none", None), ("empty", [])]
    vectors = spark.createDataFrame(data, "docid string, vec array<float>")
    queries = spark.createDataFrame([("q", [3.0, 0.0, 1.0, 0.0, -3.0]), ("null", None), ("empty", [])], "qid string, qvec array<float>")
    index = pq.build_code_index(vectors, subspaces=3)
    want = rows(vectorsearch.dense_search(queries, vectors, 4), "qid", "docid", "score", "rank")
    assert rows(pq.pq_search(queries, index, 4), "qid", "docid", "score", "rank") == want
    assert pq.pq_search(queries.limit(0), index, 4).count() == 0
    assert pq.pq_search(queries, pq.build_code_index(vectors.limit(0)), 4).count() == 0
    monkeypatch.setattr(pq, "small_table", lambda df, rows: None)
    assert rows(pq.pq_search(queries, index, 4), "qid", "docid", "score", "rank") == want
