"""Approximate nearest neighbours over cells of a coarse quantiser."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.blocks import l2_distances, matrix, round6
from gleaner.functions.constants import MAX_HITS
from gleaner.operators.blocksearch import block_search

# A cell list is sent to every task: at most this many centroids.
MAX_CELLS = 65_536
# Vectors that teach a cell, on average: the training doesn't grow with the table.
TRAIN_PER_CELL = 256


@dataclass(frozen=True)
class VectorIndex:
    """``cells(docid, vec, cell)`` and ``centroids(cell, centroid)``."""

    cells: DataFrame
    centroids: DataFrame


def kmeans_centroids(
    vectors: DataFrame,
    n_cells: int,
    seed: int = 42,
    max_iter: int = 20,
    train_fraction: float = 1.0,
    train_per_cell: int = TRAIN_PER_CELL,
) -> DataFrame:
    """``(cell, centroid)`` of a k-means quantiser trained on ``vectors``.

    The model holds ``n_cells`` centroids, a number the caller bounds. It learns from some
    ``train_per_cell`` vectors a cell, those with a small hash of their id (from all, if there are no more); a
    smaller ``train_fraction`` takes that share of them. Null and empty vectors teach nothing. Every vector is indexed.
    """
    if not 0 < n_cells <= MAX_CELLS:
        raise ValueError(f"n_cells must be between 1 and {MAX_CELLS}")
    vectors = vectors.where(F.size("vec") > 0)
    share = min(1.0, n_cells * train_per_cell / max(1, vectors.count())) * min(1.0, train_fraction)
    chosen = F.pmod(F.xxhash64(F.lit(seed), F.col("docid")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    trained = vectors if share >= 1.0 else vectors.where(chosen)
    points = trained.select(array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    model = KMeans(k=n_cells, seed=seed, maxIter=max_iter).fit(points)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(rows, "cell bigint, centroid array<double>")


def _shared_centroids(centroids: DataFrame):
    """Cell numbers and centroids as a broadcast variable, after a check of their number."""
    listed = centroids.select("cell", "centroid").limit(MAX_CELLS + 1).toArrow()
    if listed.num_rows > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells")
    listed = listed.sort_by("cell").combine_chunks()
    numbers = listed.column("cell").to_numpy()
    centers = matrix(listed.column("centroid").combine_chunks()).astype(np.float64)
    return centroids.sparkSession.sparkContext.broadcast((numbers, centers))


def _first_places(distances: np.ndarray, n: int) -> np.ndarray:
    """Columns of the ``n`` smallest values per row, ties to the smaller column, without sorting whole rows."""
    if n < distances.shape[1]:
        limit = np.partition(distances, n - 1, axis=1)[:, n - 1 : n]
        kept = np.where(distances <= limit, distances, np.inf)
        rest = int((distances <= limit).sum(axis=1).max())
        some = np.argpartition(kept, rest - 1, axis=1)[:, :rest] if rest < distances.shape[1] else None
        if some is not None:
            some.sort(axis=1)
            order = np.argsort(np.take_along_axis(kept, some, axis=1), axis=1, kind="stable")[:, :n]
            return np.take_along_axis(some, order, axis=1)
    # Stable: equal distances keep the order of the cell numbers.
    return np.argsort(distances, axis=1, kind="stable")[:, :n]


def nearest_cells(
    points: DataFrame, centroids: DataFrame, n: int, id_col: str, vec_col: str
) -> DataFrame:
    """``(id, cell, place)`` of the ``n`` nearest centroids per point, ties by cell.

    Centroids are the query side of an exhaustive block search turned around:
    they are broadcast and every point keeps its own few cells, so points are
    not shuffled.
    """
    table = _shared_centroids(centroids)
    n = min(n, len(table.value[0]))
    id_type = points.schema[id_col].dataType.simpleString()

    def assign(batches):
        cells, centers = table.value
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, picks = matrix(batch.column(vec_col)), []
            step = max(1, 4_000_000 // len(cells))
            for start in range(0, len(vectors), step):
                distances = round6(l2_distances(vectors[start : start + step], centers))
                picks.append(_first_places(distances, n))
            order = np.concatenate(picks)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_col).take(pa.array(np.repeat(np.arange(len(order)), n))),
                    pa.array(cells[order.ravel()], pa.int64()),
                    pa.array(np.tile(np.arange(n), len(order)), pa.int64()),
                ],
                names=[id_col, "cell", "place"],
            )

    kept = points.select(id_col, vec_col).where(F.size(vec_col) > 0)
    return kept.mapInArrow(assign, f"{id_col} {id_type}, cell bigint, place bigint")


def assign_cells(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """``(docid, vec, cell)``: every vector with its nearest cell, in one pass."""
    table = _shared_centroids(centroids)

    def assign(batches):
        cells, centers = table.value
        for batch in batches:
            if not batch.num_rows:
                continue
            points, nearest = matrix(batch.column("vec")), []
            step = max(1, 4_000_000 // len(cells))
            for start in range(0, len(points), step):
                distances = round6(l2_distances(points[start : start + step], centers))
                nearest.append(cells[distances.argmin(axis=1)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(nearest), pa.int64())],
                names=[*batch.schema.names, "cell"],
            )

    kept = vectors.where(F.size("vec") > 0)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(assign, f"{ddl}, cell bigint")


def build_vector_index(
    vectors: DataFrame,
    n_cells: int | None = None,
    centroids: DataFrame | None = None,
    seed: int = 42,
    train_fraction: float = 1.0,
) -> VectorIndex:
    """Inverted-file index of ``(docid, vec)``; given ``centroids`` replace the training.

    Without ``n_cells`` there are as many cells as the square root of the number of
    vectors, so that neither the cells nor the vectors of a cell become many.
    """
    centers = centroids
    if centers is None:
        if n_cells is None:
            n_cells = min(MAX_CELLS, max(1, round(vectors.count() ** 0.5)))
        centers = kmeans_centroids(vectors, n_cells, seed, train_fraction=train_fraction)
    return VectorIndex(assign_cells(vectors, centers), centers)


def save_vector_index(index: VectorIndex, path: str, rows_per_file: int = 1_000_000) -> VectorIndex:
    """Write the index partitioned by cell, so a search reads the probed cells only.

    Rebalancing gathers a cell in few files and splits a crowded cell between tasks.
    """
    spark = index.cells.sparkSession
    (
        index.cells.hint("rebalance", "cell")
        .write.mode("overwrite")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy("cell")
        .parquet(f"{path}/cells")
    )
    index.centroids.write.mode("overwrite").parquet(f"{path}/centroids")
    return open_vector_index(spark, path)


def open_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    cells = spark.read.parquet(f"{path}/cells").withColumn("cell", F.col("cell").cast("bigint"))
    return VectorIndex(cells, spark.read.parquet(f"{path}/centroids"))


def approx_knn_join(
    queries: DataFrame, index: VectorIndex, k: int = MAX_HITS, nprobe: int = 8
) -> DataFrame:
    """``(qid, docid, score, rank)`` by exact L2 distance among the ``nprobe`` nearest cells."""
    probes = nearest_cells(queries, index.centroids, nprobe, "qid", "qvec")
    probing = queries.select("qid", "qvec").join(probes.select("qid", "cell"), "qid")
    docs = index.cells.withColumnRenamed("vec", "dvec")
    return block_search(probing, docs, k, "l2", cell="cell").select("qid", "docid", "score", "rank")


def ann_search(
    queries: DataFrame, index: VectorIndex, k: int = MAX_HITS, nprobe: int = 8
) -> DataFrame:
    """Approximate :func:`dense_search`; more probed cells find more of the exact hits."""
    return approx_knn_join(queries, index, k, nprobe)
