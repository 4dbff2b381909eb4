"""Exact nearest neighbours pruned by the radii of cells.

Vectors lie in cells around centroids, and each cell knows its radius: no member of it is nearer to a
query than the centroid's distance less the radius. A first pass answers each query from its nearest
cells that together hold ``k`` vectors, which bounds the distance of the ``k``-th hit. A second pass visits
only the other cells that can hold something nearer. The result is that of the exhaustive search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.blocks import l2_distances, matrix, round6
from gleaner.functions.constants import MAX_HITS
from gleaner.operators.ann import assign_cells, kmeans_centroids
from gleaner.operators.blocksearch import block_search
from gleaner.operators.topk import top_k
from gleaner.plans.workspace import stored

# Balls are sent to every task: 32 MB of 1024-dimensional doubles.
MAX_BALLS = 4096
# Matrix elements of queries by cells, at once.
STEP_ELEMENTS = 4_000_000
# Scores are rounded to six decimals and distances to centroids carry rounding errors: bounds give way by this share.
SLACK = 1e-5


@dataclass(frozen=True)
class BallIndex:
    """``cells(docid, vec, cell)`` and ``balls(cell, centroid, radius, n)``, both written."""

    cells: DataFrame
    balls: DataFrame


def build_ball_index(
    vectors: DataFrame, n_cells: int | None = None, centroids: DataFrame | None = None, seed: int = 42
) -> BallIndex:
    """Cells of ``(docid, vec)`` with their radii; given ``centroids(cell, centroid)`` replace the training.

    Without ``n_cells`` there are as many as the square root of the number of vectors, at most ``MAX_BALLS``. Centroids learn from a
    bounded share of the vectors, and change no result. Null and empty vectors are left out.
    """
    if centroids is None:
        if n_cells is None:
            n_cells = min(MAX_BALLS, max(1, round(vectors.count() ** 0.5)))
        centroids = kmeans_centroids(vectors, n_cells, seed)
    centroids = stored(centroids.select("cell", "centroid"), "centroids")
    assigned = assign_cells(vectors.select("docid", "vec"), centroids)
    # Together by cell, so that a search skips row groups; a crowded cell is split between tasks.
    cells = stored(assigned.hint("rebalance", "cell").sortWithinPartitions("cell"), "cells")
    shared = _shared(centroids)

    def extents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, centers = shared.value["cell"], shared.value["centroid"]
        far, count = np.zeros(len(numbers)), np.zeros(len(numbers), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                at = np.searchsorted(numbers, batch.column("cell").to_numpy())
                away = matrix(batch.column("vec")).astype(np.float64) - centers[at]
                np.maximum.at(far, at, np.sqrt((away * away).sum(axis=1)))
                np.add.at(count, at, 1)
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers[held]), pa.array(far[held]), pa.array(count[held])], ["cell", "radius", "n"]
        )

    sizes = cells.select("vec", "cell").mapInArrow(extents, "cell bigint, radius double, n bigint")
    sizes = sizes.groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("n").alias("n"))
    return BallIndex(cells, stored(centroids.join(sizes, "cell"), "balls"))


def _shared(balls: DataFrame):
    """Columns of the balls or centroids, by cell, as a broadcast variable, after a check of their number."""
    listed = balls.limit(MAX_BALLS + 1).toArrow()
    if listed.num_rows > MAX_BALLS:
        raise ValueError(f"more than {MAX_BALLS} cells")
    listed = listed.sort_by("cell").combine_chunks()
    columns = {c: listed.column(c).to_numpy() for c in listed.column_names if c != "centroid"}
    columns["centroid"] = matrix(listed.column("centroid").combine_chunks()).astype(np.float64)
    return balls.sparkSession.sparkContext.broadcast(columns)


def _first_cells(distances: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Whether a query (row) meets a cell (column) first: its nearest cells, until they hold ``k`` vectors."""
    order = np.argsort(distances, axis=1, kind="stable")
    before = np.cumsum(sizes[order], axis=1) - sizes[order]
    met = np.empty(distances.shape, dtype=bool)
    np.put_along_axis(met, order, before < k, axis=1)
    return met


def _probes(queries: DataFrame, balls, k: int, second: bool) -> DataFrame:
    """``(qid, qvec, cell)`` of the cells that queries meet first; with ``second``, of all others within their ``bound``."""
    kind = {f.name: f.dataType.simpleString() for f in queries.schema.fields}

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, centers, radii, sizes = (balls.value[c] for c in ("cell", "centroid", "radius", "n"))
        step = max(1, STEP_ELEMENTS // max(1, len(cells)))
        for whole in batches:
            for start in range(0, whole.num_rows if len(cells) else 0, step):
                batch = whole.slice(start, step)
                points = matrix(batch.column("qvec")).astype(np.float64)
                distances = l2_distances(points, centers)
                met = _first_cells(round6(distances), sizes, k)
                if second:
                    bound = batch.column("bound").to_numpy(zero_copy_only=False)[:, None]
                    give = SLACK * (1 + distances + np.sqrt((points * points).sum(axis=1))[:, None])
                    met = ~met & (distances - radii <= bound + give)
                row, cell = np.nonzero(met)
                taken = [batch.column(c).take(pa.array(row)) for c in ("qid", "qvec")]
                yield pa.RecordBatch.from_arrays([*taken, pa.array(cells[cell], pa.int64())], ["qid", "qvec", "cell"])

    return queries.mapInArrow(meet, f"qid {kind['qid']}, qvec {kind['qvec']}, cell bigint")


def _passes(queries: DataFrame, index: BallIndex, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Probes of the first pass, its written hits, and probes of the second pass."""
    asked = queries.select("qid", "qvec").where(F.size("qvec") > 0)
    balls, docs = _shared(index.balls), index.cells.withColumnRenamed("vec", "dvec")
    first = stored(_probes(asked, balls, k, False), "probes")
    hits = stored(block_search(first, docs, k, "l2", cell="cell"), "first-hits")
    bound = F.when(F.count("*") < k, F.lit(float("inf"))).otherwise(F.max("score")).alias("bound")
    bounded = asked.join(hits.groupBy("qid").agg(bound), "qid")
    return first, hits, stored(_probes(bounded, balls, k, True), "probes")


def pruned_dense_search(queries: DataFrame, index: BallIndex, k: int = MAX_HITS) -> DataFrame:
    """``(qid, docid, score, rank)``: the hits of ``dense_search`` by L2 distance, from the cells that can hold them.

    Null and empty query vectors have no hits, an empty index none for any query; ties go to the smaller id, and ``qid`` is unique.
    """
    first, hits, second = _passes(queries, index, k)
    docs = index.cells.withColumnRenamed("vec", "dvec")
    more = block_search(second, docs, k, "l2", cell="cell")
    both = hits.select("qid", "docid", "score").union(more.select("qid", "docid", "score"))
    return top_k(both, k, ascending=True, by=["qid"]).select("qid", "docid", "score", "rank")


def pruned_knn_join(queries: DataFrame, index: BallIndex, k: int) -> DataFrame:
    """Every query with its ``k`` nearest vectors and their place in the order."""
    return pruned_dense_search(queries, index, k).withColumnRenamed("score", "distance")


def pairs_met(queries: DataFrame, index: BallIndex, k: int) -> DataFrame:
    """One row ``(met, possible, share)``: pairs of a query and a vector that :func:`pruned_dense_search` compares, of all there are."""
    first, _, second = _passes(queries, index, k)
    sizes = index.balls.select("cell", "n")
    met = first.union(second).select("cell").join(sizes, "cell").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("met"))
    asked = queries.where(F.size("qvec") > 0).agg(F.count("*").alias("asked"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    row = met.join(asked, F.lit(True)).join(total, F.lit(True))  # one row each
    possible = F.col("asked") * F.col("total")
    return row.select("met", possible.alias("possible"), (F.col("met") / F.nullif(possible, F.lit(0))).alias("share"))
