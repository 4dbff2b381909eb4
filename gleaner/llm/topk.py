"""Exact top-k inner-product search by pivot-table elimination.

Every vector's distances to a few pivots are a table computed once. For a query, the
largest difference of its own distances from a row's bounds the distance of the two from
below, and so their inner product from above: ``(|q|^2 + |x|^2 - bound^2) / 2``. Rows are
evaluated in the order of these bounds until the next bound lies below the k-th best
score, which is exact. A query starts with the k-th best score over a small seed sample,
so most of the collection is eliminated without being evaluated.

Queries travel in blocks of bounded size; each block is one scan of all rows, and a
task keeps ``k`` rows per query whatever the size of the collection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gleaner.plans.workspace import stored

PIVOTS = 24
SEEDS = 1024
QUERY_BLOCK = 8192
CHUNK = 128  # rows evaluated between two looks at the bounds
EXACT = float(1 << 53)


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, factor: int = 256) -> DataFrame:
    """``(id, v)`` with ``v = floor(factor * x)``; without null ids or vectors, and vectors with null or non-finite components."""
    x = F.col(vector_col)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.col(id_col).isNotNull() & x.isNotNull()).where(fine).select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(factor * c.cast("double"))).alias("v")
    )


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of all vectors and their components end to end."""
    lengths = np.diff(column.offsets.to_numpy())
    return lengths, column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _dots(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where no sum can pass 2**53."""
    if not x.size or not q.size or float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1] < EXACT:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return x @ q


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - p).astype(np.float64) ** 2).sum(axis=1)) for p in pivots], axis=1)


class Best:
    """The ``k`` best rows of each query so far, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = [np.empty(0, np.int64)] * n
        self.ids = [np.empty(0, np.int64)] * n

    def offer(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.r_[self.ids[q], ids], np.r_[self.scores[q], scores]
        top = np.lexsort((ids, -scores))[: self.k]
        self.ids[q], self.scores[q] = ids[top], scores[top]

    def floor(self, q: int, least: float) -> float:
        """No row below this score can be among the best."""
        return max(least, float(self.scores[q][-1])) if len(self.scores[q]) == self.k else least


def search_block(ids: np.ndarray, x: np.ndarray, queries: dict, best: Best) -> int:
    """Offer the rows ``x`` that can matter to each query; the number of rows evaluated."""
    pivots, evaluated = queries["pivots"], 0
    table, norms = _distances(x, pivots), (x.astype(np.float64) ** 2).sum(axis=1)
    for i, (qid, q) in enumerate(zip(queries["ids"], queries["vectors"])):
        apart = np.abs(table - queries["table"][i]).max(axis=1)
        square = norms + queries["norms"][i]
        bound = (square - apart**2) / 2 + 1e-9 * square + 1e-6  # room for the rounding of doubles
        floor = best.floor(i, queries["least"][i])
        able = np.flatnonzero((bound >= floor) & (ids != qid))
        able = able[np.argsort(-bound[able], kind="stable")]
        for at in range(0, len(able), CHUNK):
            some = able[at : at + CHUNK]
            if bound[some[0]] < best.floor(i, queries["least"][i]):
                break
            best.offer(i, ids[some], _dots(x[some], q))
            evaluated += len(some)
    return evaluated


def _prepare(block: pa.Table, seeds: pa.Table, k: int, pivots: int) -> list[dict]:
    """Queries of one block by dimension, with pivots, their tables and the scores they start from."""
    lengths, flat = _matrix(block.column("v").combine_chunks())
    ends, ids = np.cumsum(lengths), block.column("id").to_numpy()
    s_lengths, s_flat = _matrix(seeds.column("v").combine_chunks())
    s_ends, s_ids = np.cumsum(s_lengths), seeds.column("id").to_numpy()
    out = []
    for dim in np.unique(lengths):
        mine = np.flatnonzero(lengths == dim)
        vectors = np.stack([flat[ends[i] - dim : ends[i]] for i in mine])
        near = np.flatnonzero(s_lengths == dim)
        sample = np.stack([s_flat[s_ends[i] - dim : s_ends[i]] for i in near]) if len(near) else vectors[:1]
        chosen = sample[:pivots]
        least = np.full(len(mine), -np.inf)
        if len(near) > k:
            scores = _dots(vectors, sample.T).astype(np.float64)
            scores[ids[mine][:, None] == s_ids[near][None, :]] = -np.inf
            least = np.sort(scores, axis=1)[:, -k]
        norms = (vectors.astype(np.float64) ** 2).sum(axis=1)
        out.append({"dim": int(dim), "at": mine, "ids": ids[mine], "vectors": vectors, "pivots": chosen,
                    "table": _distances(vectors, chosen), "norms": norms, "least": least})
    return out


def top_k(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    pivots: int = PIVOTS,
    seeds: int = SEEDS,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``queries`` its ``k`` best rows of ``rows`` but its own id.

    Scores are inner products of the vectors of ``integer_vectors``; ties go to the smaller id. A query with
    fewer candidates gets all of them, one without none. Only vectors of the query's length are candidates. Rows that
    repeat are candidates each; a query row that repeats is answered once for each distinct vector of its id.
    """
    spark = rows.sparkSession
    data = stored(integer_vectors(rows, id_col, vector_col), "topk-rows")
    asked = integer_vectors(queries, id_col, vector_col).distinct()
    asked = stored(asked.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(max(1, -(-asked.count() * 2 // QUERY_BLOCK))))), "topk-queries")
    sample = data.orderBy(F.xxhash64("id"), "id").limit(seeds).toArrow()  # a bounded sample; it sets where queries start, not what they find
    results = None
    for (block,) in asked.select("block").distinct().orderBy("block").collect():
        mine = asked.where(F.col("block") == block).select("id", "v").toArrow()  # about half of QUERY_BLOCK rows
        shared = spark.sparkContext.broadcast(_prepare(mine, sample, k, pivots))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = [Best(len(g["ids"]), k) for g in shared.value]
            for batch in batches:
                lengths, flat = _matrix(batch.column(1))
                ends, ids = np.cumsum(lengths), batch.column(0).to_numpy()
                for group, held in zip(shared.value, best):
                    fit = np.flatnonzero(lengths == group["dim"])
                    if len(fit):
                        spans = ends[fit][:, None] - group["dim"] + np.arange(group["dim"])
                        search_block(ids[fit], flat[spans], group, held)
            for group, held in zip(shared.value, best):
                sizes = [len(x) for x in held.ids]
                if sum(sizes):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(group["at"], sizes)), pa.array(np.repeat(group["ids"], sizes)),
                         pa.array(np.concatenate(held.ids)), pa.array(np.concatenate(held.scores))],
                        ["at", "query_id", "vec_id", "score"],
                    )

        found = data.mapInArrow(run, "at long, query_id long, vec_id long, score long").withColumn("block", F.lit(block))
        results = found if results is None else results.union(found)
    if results is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("block", "at").orderBy(F.desc("score"), "vec_id")
    ranked = results.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
