"""Second-stage ranking of the first hits by late interaction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from gleaner.functions.blocks import equal_bit_scores, maxsim_scores, nested, round6
from gleaner.operators.bounds import local_rows
from gleaner.operators.topk import top_k
from gleaner.plans.workspace import stored


def _rerank(
    run: DataFrame, queries: DataFrame, multivecs: DataFrame, n: int, score_pair
) -> DataFrame:
    """Score the first ``n`` hits of ``run`` only; hits without vectors keep score 0."""
    candidates = run.where(F.col("rank") <= n).select("qid", "docid")
    few = local_rows(candidates)  # one evaluation of the first stage instead of several
    candidates = stored(candidates, "candidates") if few is None else few
    docs = multivecs.select("docid", F.col("vecs").alias("dvecs"))
    # Vectors of documents nobody retrieved are dropped before they are moved.
    wanted = docs.join(candidates.select("docid").distinct(), "docid", "left_semi")
    pairs = (
        candidates.join(wanted, "docid")
        .join(queries.select("qid", "qvecs"), "qid")
        .where((F.size("dvecs") > 0) & (F.size("qvecs") > 0))
        .select("qid", "docid", "qvecs", "dvecs")
    )
    out = ST.StructType(
        [run.schema["qid"], run.schema["docid"], ST.StructField("pair_score", ST.DoubleType())]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q, q_off = nested(batch.column("qvecs"))
            d, d_off = nested(batch.column("dvecs"))
            values = [
                score_pair(
                    d[d_off[i] : d_off[i + 1]], np.array([0, d_off[i + 1] - d_off[i]]),
                    q[q_off[i] : q_off[i + 1]], np.array([0, q_off[i + 1] - q_off[i]]),
                )[0, 0]
                for i in range(batch.num_rows)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("qid"), batch.column("docid"), pa.array(round6(np.array(values)))],
                names=["qid", "docid", "pair_score"],
            )

    scored = pairs.mapInArrow(score, out)
    merged = candidates.join(scored, ["qid", "docid"], "left").select(
        "qid", "docid", F.coalesce("pair_score", F.lit(0.0)).alias("score")
    )
    return top_k(merged, n)


def maxsim_rerank(run: DataFrame, queries: DataFrame, multivecs: DataFrame, n: int) -> DataFrame:
    """First ``n`` hits of ``run`` re-ordered by their late-interaction score."""
    return _rerank(run, queries, multivecs, n, maxsim_scores)


def bit_rerank(run: DataFrame, queries: DataFrame, multivecs: DataFrame, n: int) -> DataFrame:
    """Same with sign bits: two tokens are as similar as they have equal bits."""
    return _rerank(run, queries, multivecs, n, equal_bit_scores)
