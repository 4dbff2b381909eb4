"""Approximate nearest neighbours over product-quantised codes.

A vector is cut into subspaces and each part replaced by the number of its nearest centre there, a byte: some sixteen
bytes instead of hundreds. A query's squared distances to all centres make a table, and the sum of its entries at a
document's codes is nearly the distance to it. The best documents by that sum are ranked again by their vectors.

Centres come from a bounded sample, the vectors with the smallest hash of their id; a task each trains one subspace. All
vectors are coded, and a scan reads codes only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from gleaner.functions.blocks import LocalTopK, matrix
from gleaner.functions.constants import MAX_HITS
from gleaner.operators.blocksearch import QUERY_BROADCAST_ROWS
from gleaner.operators.bounds import broadcast_if_small, small_table
from gleaner.operators.topk import rounded, top_k
from gleaner.operators.vectorsearch import dense_search
from gleaner.plans.workspace import stored

TRAIN_ROWS = 20_000  # vectors that teach the centres
SUBSPACES, CENTRES = 16, 256
ROUNDS = 12
RERANK = 20  # vectors read again for each hit


@dataclass(frozen=True)
class CodeIndex:
    """``codes(docid, code binary)``, ``centres(sub, centres array<array<float>>)`` with a row per subspace, and the vectors."""

    codes: DataFrame
    centres: DataFrame
    vectors: DataFrame


def _parts(dim: int, subspaces: int) -> list[tuple[int, int]]:
    """Beginnings and ends of the subspaces; their sizes differ by one at most."""
    ends = [dim * (i + 1) // subspaces for i in range(subspaces)]
    return list(zip([0, *ends[:-1]], ends))


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None] - 2 * points @ centres.T).argmin(1)


def _kmeans(points: np.ndarray, n: int, seed: int) -> np.ndarray:
    """At most ``n`` centres of one subspace of the sample; a centre without points takes the place of a far one."""
    rnd = np.random.default_rng(seed)
    kinds = np.unique(points, axis=0)
    if len(kinds) <= n:
        return kinds
    centres = kinds[rnd.choice(len(kinds), n, replace=False)].copy()
    for _ in range(ROUNDS):
        own = _nearest(points, centres)
        size = np.bincount(own, minlength=n)
        for d in range(points.shape[1]):
            centres[:, d] = np.where(size > 0, np.bincount(own, points[:, d], n) / np.maximum(size, 1), centres[:, d])
        empty = np.flatnonzero(size == 0)
        far = ((points - centres[own]) ** 2).sum(1).argsort()[::-1][: len(empty)]
        centres[empty[: len(far)]] = points[far]
    return centres


def train_centres(vectors: DataFrame, subspaces: int = SUBSPACES, rows: int = TRAIN_ROWS, seed: int = 42) -> DataFrame:
    """``(sub, centres)``: up to 256 centres of each subspace, trained on ``rows`` vectors, a task for each subspace."""
    usable = vectors.where(F.size("vec") > 0)
    sample = stored(usable.orderBy(F.xxhash64("docid"), "docid").limit(rows).select("vec"), "pq-sample")
    dim = sample.select(F.size("vec").alias("n")).first()
    if dim is None:
        return vectors.sparkSession.createDataFrame([], "sub int, centres array<array<float>>")
    parts = _parts(dim.n, min(subspaces, dim.n))
    cut = F.array(*[F.slice("vec", low + 1, high - low) for low, high in parts])
    pieces = sample.select(F.posexplode(cut).alias("sub", "part"))

    def train(key: tuple, group: pa.Table) -> pa.Table:
        points = matrix(group.column("part"))
        centres = _kmeans(points, CENTRES, seed + key[0].as_py()).astype(np.float32)
        return pa.table({"sub": pa.array([key[0].as_py()], pa.int32()), "centres": pa.array([list(map(list, centres))], pa.list_(pa.list_(pa.float32())))})

    return stored(pieces.groupBy("sub").applyInArrow(train, "sub int, centres array<array<float>>"), "pq-centres")


def _read_centres(centres: DataFrame) -> list[np.ndarray]:
    """Centres per subspace on the driver: some hundred numbers a dimension."""
    return [np.array(r.centres, np.float64) for r in centres.orderBy("sub").collect()]


def build_code_index(vectors: DataFrame, subspaces: int = SUBSPACES, train_rows: int = TRAIN_ROWS, centres: DataFrame | None = None) -> CodeIndex:
    """Codes of all ``(docid, vec)``; given ``centres`` replace the training. Null and empty vectors have no code."""
    centres = train_centres(vectors, subspaces, train_rows) if centres is None else centres
    shared = vectors.sparkSession.sparkContext.broadcast(_read_centres(centres))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points, at, codes = matrix(batch.column("vec")), 0, []
                for part in shared.value:
                    codes.append(_nearest(points[:, at : at + part.shape[1]], part).astype(np.uint8))
                    at += part.shape[1]
                rows = np.stack(codes, axis=1)
                code = [r.tobytes() for r in rows]
                yield pa.RecordBatch.from_arrays([batch.column("docid"), pa.array(code, pa.binary())], ["docid", "code"])

    schema = ST.StructType([vectors.schema["docid"], ST.StructField("code", ST.BinaryType())])
    codes = vectors.where(F.size("vec") > 0).select("docid", "vec").mapInArrow(encode, schema)
    return CodeIndex(codes, centres, vectors)


def save_code_index(index: CodeIndex, path: str) -> CodeIndex:
    index.codes.write.mode("overwrite").parquet(f"{path}/codes")
    index.centres.write.mode("overwrite").parquet(f"{path}/centres")
    return open_code_index(index.vectors, path)


def open_code_index(vectors: DataFrame, path: str) -> CodeIndex:
    spark: SparkSession = vectors.sparkSession
    return CodeIndex(spark.read.parquet(f"{path}/codes"), spark.read.parquet(f"{path}/centres"), vectors)


def code_candidates(queries: DataFrame, index: CodeIndex, n: int) -> DataFrame | None:
    """``(qid, docid, score, rank)`` of the ``n`` nearest documents by their codes; ``None`` for more queries than may be broadcast."""
    head = small_table(queries.select("qid", "qvec").where(F.size("qvec") > 0), QUERY_BROADCAST_ROWS)
    if head is None:
        return None
    parts, points, at, tables = _read_centres(index.centres), matrix(head.column("qvec")), 0, []
    if len(head) and parts:
        for part in parts:
            own = points[:, at : at + part.shape[1]]
            tables.append(((own**2).sum(1)[:, None] + (part**2).sum(1)[None] - 2 * own @ part.T).astype(np.float32))
            at += part.shape[1]
    shared = queries.sparkSession.sparkContext.broadcast((head.column("qid").to_pylist(), tables))
    schema = ST.StructType([queries.schema["qid"], index.codes.schema["docid"], ST.StructField("score", ST.DoubleType())])
    kind = lambda f: pa.int64() if isinstance(f.dataType, ST.LongType) else pa.string()
    kinds = kind(schema["qid"]), kind(schema["docid"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, tables = shared.value
        best = LocalTopK(len(qids), n)
        for batch in batches:
            for start in range(0, batch.num_rows if tables else 0, 8192):
                rows = batch.slice(start, 8192)
                code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(rows.num_rows, len(tables))
                ids = np.array(rows.column("docid").to_pylist(), dtype=object)
                for q in range(len(qids)):
                    distance = tables[0][q][code[:, 0]].astype(np.float64)
                    for j in range(1, len(tables)):
                        distance += tables[j][q][code[:, j]]
                    best.offer(q, -distance, ids)
        for numbers, ids, scores in best.results():
            yield pa.RecordBatch.from_arrays([pa.array([qids[i] for i in numbers], kinds[0]), pa.array(ids, kinds[1]), pa.array(-scores)], ["qid", "docid", "score"])

    return top_k(index.codes.mapInArrow(scan, schema), n, ascending=True, by=["qid"])


def pq_search(queries: DataFrame, index: CodeIndex, k: int = MAX_HITS, rerank: int = RERANK) -> DataFrame:
    """``(qid, docid, score, rank)``: approximate :func:`dense_search` by L2 distance; ``rerank * k`` vectors a query are read.

    More queries than may be broadcast are answered exactly.
    """
    found = code_candidates(queries, index, rerank * k)
    if found is None:
        return dense_search(queries, index.vectors, k)
    found = stored(found.select("qid", "docid"), "pq-candidates")
    near = index.vectors.select("docid", "vec").join(broadcast_if_small(found), "docid")
    near = near.join(broadcast_if_small(queries.select("qid", "qvec")), "qid")
    square = F.aggregate(F.zip_with("vec", "qvec", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return top_k(near.select("qid", "docid", rounded(F.sqrt(square)).alias("score")), k, ascending=True, by=["qid"]).select("qid", "docid", "score", "rank")
