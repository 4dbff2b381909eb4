"""Search pruned by cell radii against the exhaustive search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import blocksearch, radii, vectorsearch
from tests.conftest import rows

HITS = ("qid", "docid", "score", "rank")


@pytest.fixture(scope="module")
def clustered(spark):
    """3,000 vectors in 30 clusters, copies and odd ones among them."""
    rnd = np.random.default_rng(11)
    centres = rnd.normal(size=(30, 12)) * 4
    data = [(f"d{i}", (centres[i % 30] + 0.5 * rnd.normal(size=12)).tolist()) for i in range(3000)]
    data += [(f"copy{i}", data[7][1]) for i in range(20)] + [("empty", []), ("none", None), ("far", [900.0] * 12)]
    asked = [(f"q{i}", (centres[i % 30] + rnd.normal(size=12)).tolist()) for i in range(60)]
    asked += [("same", data[7][1]), ("between", [0.0] * 12), ("empty", []), ("none", None)]
    return (
        spark.createDataFrame(asked, "qid string, qvec array<double>"),
        spark.createDataFrame(data, "docid string, vec array<double>").repartition(6),
    )


@pytest.mark.parametrize("k", [1, 10, 250])
def test_pruned_search_equals_the_exhaustive_one(clustered, k):
    queries, vectors = clustered
    index = radii.build_ball_index(vectors, 40)
    got = radii.pruned_dense_search(queries, index, k)
    assert rows(got, *HITS) == rows(vectorsearch.dense_search(queries, vectors, k), *HITS)


def test_few_pairs_meet_on_clustered_vectors(clustered):
    queries, vectors = clustered
    index = radii.build_ball_index(vectors, 40)
    row = radii.pairs_met(queries, index, 10).first()
    assert row.possible == 62 * 3021 and 0 < row.share < 0.5


def test_many_queries_meet_cells_in_blocks(clustered, monkeypatch):
    queries, vectors = clustered
    index = radii.build_ball_index(vectors, 25)
    want = rows(vectorsearch.dense_search(queries, vectors, 10), *HITS)
    monkeypatch.setattr(blocksearch.block_scores, "__defaults__", (None, 5))
    monkeypatch.setattr(blocksearch.block_search, "__defaults__", (None, 5))
    assert rows(radii.pruned_dense_search(queries, index, 10), *HITS) == want


def test_balls_hold_their_vectors(clustered):
    _, vectors = clustered
    index = radii.build_ball_index(vectors, 10)
    away = F.sqrt(F.aggregate(F.zip_with("vec", "centroid", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))
    both = index.cells.join(index.balls, "cell").groupBy("cell", "radius", "n").agg(F.max(away).alias("far"), F.count("*").alias("m"))
    found = both.collect()
    assert sum(r.n for r in found) == 3021 and all(r.n == r.m and abs(r.far - r.radius) < 1e-9 for r in found)


def test_empty_sides_and_given_centroids(spark, clustered):
    queries, vectors = clustered
    centroids = spark.createDataFrame([(3, [0.0] * 12), (8, [5.0] * 12), (9, [-9.0] * 12)], "cell bigint, centroid array<double>")
    index = radii.build_ball_index(vectors, centroids=centroids)
    assert radii.pruned_dense_search(queries.limit(0), index, 5).count() == 0
    assert rows(radii.pruned_dense_search(queries, index, 5), *HITS) == rows(vectorsearch.dense_search(queries, vectors, 5), *HITS)
    none = radii.build_ball_index(vectors.limit(0), centroids=centroids)
    assert radii.pruned_dense_search(queries, none, 5).count() == 0
    everything = radii.pruned_knn_join(queries.where("qid = 'between'"), index, 5000)
    assert everything.count() == 3021 and "distance" in everything.columns
