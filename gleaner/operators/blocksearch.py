"""Exhaustive vector scoring of a whole collection against a set of queries.

Documents stay where the scan put them. A query set that is proven small is
broadcast and every task keeps its best ``k`` hits per query; only those are
shuffled. A larger query set is split into blocks and met with document blocks
in grouped tasks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from gleaner.functions.blocks import MATRIX_ELEMENTS, LocalTopK, QueryBlock
from gleaner.operators.bounds import broadcast_if_small, scan_tasks
from gleaner.operators.topk import top_k

METRICS = ("l2", "ip", "maxsim", "equal_bits")

# Query rows that may be broadcast (32 MB of 1024-dimensional doubles).
QUERY_BROADCAST_ROWS = 4096
TASKS_PER_CORE = 4
# Rows of one document block and one query block beyond that.
DOC_BLOCK_ROWS = 65_536
QUERY_BLOCK_ROWS = 8192


def _hits(scored: LocalTopK, qids: list, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for numbers, ids, scores in scored.results():
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([qids[n] for n in numbers], schema.field("qid").type),
                pa.array(ids, schema.field("docid").type),
                pa.array(scores, pa.float64()),
            ],
            schema=schema,
        )


def _offer_batch(scored: LocalTopK, block: QueryBlock, batch, metric: str) -> None:
    """Score one batch, in slices that bound the (documents x queries) matrix."""
    if block.cells is None and metric in ("l2", "ip"):
        ids = np.array(batch.column("docid").to_pylist(), dtype=object)
        scored.offer_near(block.vectors, block.matching(batch.column("dvec")), ids, metric)
        return
    rows = max(1, MATRIX_ELEMENTS // max(1, len(block.vectors)))
    for start in range(0, batch.num_rows, rows):
        _offer_slice(scored, block, batch.slice(start, rows), metric)


def _offer_slice(scored: LocalTopK, block: QueryBlock, batch, metric: str) -> None:
    """Score rows with the queries that look at their cells."""
    ids = np.array(batch.column("docid").to_pylist(), dtype=object)
    vectors = batch.column("dvec")
    if block.cells is None:
        scored.offer_all(block.scores(vectors, metric), ids)
        return
    cells = np.array(batch.column("cell").to_pylist(), dtype=object)
    for cell in set(cells.tolist()):
        wanted = np.flatnonzero(block.cells == cell)
        rows = np.flatnonzero(cells == cell)
        if len(wanted) and len(rows):
            part = _columns(block, wanted)
            scored.offer_all(part.scores(vectors.take(pa.array(rows)), metric), ids[rows], wanted)


def _columns(block: QueryBlock, wanted: np.ndarray) -> QueryBlock:
    if block.offsets is None:
        return QueryBlock([block.qids[i] for i in wanted], block.vectors[wanted])
    spans = [np.arange(block.offsets[i], block.offsets[i + 1]) for i in wanted]
    lengths = np.array([len(s) for s in spans])
    return QueryBlock(
        [block.qids[i] for i in wanted],
        block.vectors[np.concatenate(spans)],
        np.concatenate([[0], np.cumsum(lengths)]),
    )


def _arrow_type(field: ST.StructField) -> pa.DataType:
    return pa.int64() if isinstance(field.dataType, ST.LongType) else pa.string()


def block_scores(
    queries: DataFrame,
    docs: DataFrame,
    k: int,
    metric: str,
    cell: str | None = None,
    query_broadcast_rows: int = QUERY_BROADCAST_ROWS,
) -> DataFrame:
    """Hits ``(qid, docid, score)`` that contain the best ``k`` per query and partition.

    ``queries`` has ``qid`` and ``qvec``, ``docs`` has ``docid`` and ``dvec``.
    With ``cell``, a query row only meets documents of the same cell; a query may
    have several rows. For ``l2`` the score is the negative distance.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; use one of {METRICS}")
    routed = cell is not None
    multi = metric in ("maxsim", "equal_bits")
    extra = [F.col(cell).alias("cell")] if routed else []
    # A query may bring columns of the other kind of vector; only these are read.
    queries = queries.select("qid", "qvec", *extra).where(F.size("qvec") > 0)
    docs = docs.select("docid", "dvec", *extra).where(F.size("dvec") > 0)
    qid_type, docid_type = queries.schema["qid"], docs.schema["docid"]
    out = ST.StructType(
        [
            ST.StructField("qid", qid_type.dataType),
            ST.StructField("docid", docid_type.dataType),
            ST.StructField("score", ST.DoubleType()),
        ]
    )
    arrow_out = pa.schema(
        [
            ("qid", _arrow_type(qid_type)),
            ("docid", _arrow_type(docid_type)),
            ("score", pa.float64()),
        ]
    )

    head = queries.limit(query_broadcast_rows + 1).toArrow()
    if head.num_rows == 0:
        return docs.sparkSession.createDataFrame([], out)
    if head.num_rows <= query_broadcast_rows:
        block = QueryBlock.from_arrow(head, multi, routed)
        shared = docs.sparkSession.sparkContext.broadcast(block)
        if routed:
            # Cells nobody asks for are never read.
            docs = docs.where(F.col("cell").isin(sorted(set(block.cells.tolist()))))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scored = LocalTopK(len(shared.value.qids), k)
            for batch in batches:
                if batch.num_rows:
                    _offer_batch(scored, shared.value, batch, metric)
            yield from _hits(scored, shared.value.qids, arrow_out)

        # Every task hands on up to k hits per query: a few long tasks per core keep
        # that volume independent of the number of input splits. No shuffle here.
        # A large table has a task for some gigabytes, so that a lost one repeats no more than that.
        return docs.coalesce(scan_tasks(docs, TASKS_PER_CORE)).mapInArrow(score, out)

    return _blocked(queries, docs, k, metric, multi, routed, out, arrow_out)


def _blocked(queries, docs, k, metric, multi, routed, out, arrow_out) -> DataFrame:
    """Document blocks met with query blocks, both of bounded size."""
    if not routed:
        queries, docs = queries.withColumn("cell", F.lit(0)), docs.withColumn("cell", F.lit(0))
    # A cell is cut into as many document blocks as its size asks for.
    shape = (
        docs.groupBy("cell")
        .agg(F.ceil(F.count(F.lit(1)) / F.lit(DOC_BLOCK_ROWS)).cast("int").alias("dblocks"))
        .join(
            queries.groupBy("cell").agg(
                F.ceil(F.count(F.lit(1)) / F.lit(QUERY_BLOCK_ROWS)).cast("int").alias("qblocks")
            ),
            "cell",
        )
    )
    shape = broadcast_if_small(shape)

    def numbers(n: str, alias: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(alias)

    doc_side = (
        docs.join(shape, "cell")
        .withColumn("dblock", F.pmod(F.xxhash64("docid"), F.col("dblocks")).cast("int"))
        .select("cell", "dblock", "docid", "dvec", numbers("qblocks", "qblock"))
    )
    query_side = (
        queries.join(shape, "cell")
        .withColumn("qblock", F.pmod(F.xxhash64("qid"), F.col("qblocks")).cast("int"))
        .select("cell", "qblock", "qid", "qvec", numbers("dblocks", "dblock"))
    )

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return arrow_out.empty_table()
        block = QueryBlock.from_arrow(right.combine_chunks(), multi, False)
        scored = LocalTopK(len(block.qids), k)
        for batch in left.to_batches(max_chunksize=4096):
            _offer_batch(scored, block, batch, metric)
        return pa.Table.from_batches(_hits(scored, block.qids, arrow_out), schema=arrow_out)

    keys = ["cell", "dblock", "qblock"]
    return (
        doc_side.groupBy(*keys).cogroup(query_side.groupBy(*keys)).applyInArrow(score, out)
    )


def block_search(
    queries: DataFrame,
    docs: DataFrame,
    k: int,
    metric: str,
    cell: str | None = None,
    query_broadcast_rows: int = QUERY_BROADCAST_ROWS,
) -> DataFrame:
    """``(qid, docid, score, rank)`` of the best ``k`` documents per query.

    A document met through several cells of one query counts once.
    """
    hits = block_scores(queries, docs, k, metric, cell, query_broadcast_rows)
    if metric == "l2":
        hits = hits.withColumn("score", F.abs("score"))
    return top_k(hits, k, ascending=(metric == "l2"), by=["qid"])
