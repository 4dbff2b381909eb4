"""Labelled learning rows, and the logistic fits both classifiers use."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gleaner.operators.bounds import broadcast_if_small
from gleaner.plans.workspace import stored

FOLDS = 5
BROADCAST_LABELS = 1_000_000  # ids and labels of so many rows


def held_out(id_col: str | Column) -> Column:
    """Whether a row is kept for checking: crc32 of the id as text is divisible by ``FOLDS``. A null id is not."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, rows: int | None = None) -> DataFrame:
    """``(id, text, y)`` of all labelled documents outside the held-out fold.

    With ``rows`` only of those with the smallest hash of their id, so the choice doesn't depend on the
    order of rows. A document labelled both ways counts as 1; null labels and ids are left out.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("y"))
    if rows is not None:
        known = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return texts.join(broadcast_if_small(known, BROADCAST_LABELS), "id").select("id", "text", "y")


def learning_rows(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, rows: int | None = None) -> DataFrame:
    """``(text, y)`` of :func:`labelled_rows`, written."""
    return stored(labelled_rows(docs, labels, label, id_col, text_col, rows).select("text", "y"), "labelled")


def summed(rows: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """Sum over the written ``rows(y, x)`` of a vector that ``of(x, y)`` gives for a part of them; a row per task reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                part = of(x, batch.column(0).to_numpy().astype(float))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["total"])

    parts = rows.select("y", "x").mapInArrow(run, "total array<double>").toArrow().column("total").to_pylist()
    # Sorted: the order in which tasks end doesn't matter.
    return np.sum(sorted(parts), axis=0) if parts else None


def fit_logistic_rows(rows: DataFrame, prior: np.ndarray, strength: float, steps: int = 30) -> np.ndarray:
    """:func:`fit_logistic` on all written ``rows(y, x)``, each step a job over them."""
    w, d = prior.astype(float).copy(), len(prior)
    for _ in range(steps):
        now = w.copy()

        def sums(x: np.ndarray, y: np.ndarray, now: np.ndarray = now) -> np.ndarray:
            p = 1 / (1 + np.exp(-np.clip(x @ now, -30, 30)))
            return np.concatenate([x.T @ (p - y), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])

        total = summed(rows, sums)
        if total is None:
            break
        step = np.linalg.solve(total[d:].reshape(d, d) + strength * np.eye(d), total[:d] + strength * (w - prior))
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float, steps: int = 30) -> np.ndarray:
    """Weights by Newton steps on the logistic loss, drawn towards ``prior`` (which holds where there are no rows)."""
    w = prior.astype(float).copy()
    ridge = strength * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + strength * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, gradient)
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
