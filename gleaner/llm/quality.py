"""Quality scores by Bradley-Terry pairwise ranking.

A document's score is linear in features of its whole text. The weights come from
preference pairs - a document labelled 1 is preferred to one labelled 0 - by the
logistic loss on the difference of their features. The cut between good and bad is a
quantile of the learning rows' scores: the share of label 0 lies below it. A
logistic curve then maps scores to 0..1 with the cut at ``threshold``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleaner.llm.labelled import fit_logistic, fit_logistic_rows, held_out, labelled_rows, summed
from gleaner.llm.wordhash import BLANKS, cut_words, hash_words, text_slices
from gleaner.plans.workspace import stored

PAIRS = 100_000  # preference pairs at least
GROUP_ROWS = 5_000  # rows of each label that are paired by one task
BINS = 4_096  # of a step towards the quantile
THRESHOLD = 0.3

_KINDS = [b"\n", b" \t\r\x0b\x0c", bytes(range(0x30, 0x3A)), bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)), b".", b",", b"!", b"%", b"&", b"#", b"$", b"*", b"|", b"<>{}[]=\\/_~^@+", b";:?()'\"-", bytes(range(0x80, 0x100))]
_KIND = np.full(256, len(_KINDS), dtype=np.uint8)
for _i, _group in enumerate(_KINDS):
    _KIND[list(_group)] = _i
N_KINDS = len(_KINDS) + 1
#: Besides the kinds of bytes: sizes, words, repetition, lines.
N_FEATURES = N_KINDS + 9


def features(column: pa.Array) -> np.ndarray:
    """One row of features per text; null and empty texts share one row of defaults."""
    out = np.zeros((len(column), N_FEATURES))
    for row, data, offsets in text_slices(column):
        kinds = _KIND[data]
        starts, ends, first = cut_words(data, offsets, BLANKS)
        words, lengths = hash_words(data, starts, ends), ends - starts
        for i in range(len(offsets) - 1):
            size = int(offsets[i + 1] - offsets[i])
            if not size:
                continue
            share = np.bincount(kinds[offsets[i] : offsets[i + 1]], minlength=N_KINDS) / size
            mine, lens = words[first[i] : first[i + 1]], lengths[first[i] : first[i + 1]]
            n, lines = max(1, len(mine)), share[0] * size + 1
            _, counts = np.unique(mine, return_counts=True)
            last = kinds[ends[first[i] : first[i + 1]] - 1] if len(mine) else kinds[:0]
            rest = [
                np.log1p(size),
                np.log1p(n),
                lens.mean() if len(mine) else 0,
                lens.std() if len(mine) else 0,
                len(counts) / n,
                counts.max(initial=0) / n,
                (mine[1:] == mine[:-1]).sum() / n,
                np.log1p(size / lines),
                ((last > 6) & (last < N_KINDS - 2)).sum() / n,  # words that end in a symbol
            ]
            out[row + i] = [*np.log(share + 1e-3), *rest]
    return out


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float
    empty: float  # score of texts without any character

    def rank(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale).clip(-8, 8) @ self.weights

    def score(self, x: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
        z = self.slope * (self.rank(x) - self.cut) + np.log(threshold / (1 - threshold))
        return np.where(x.any(axis=1), 1 / (1 + np.exp(-np.clip(z, -30, 30))), self.empty)


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> QualityModel:
    """Bradley-Terry weights, and the cut at the quantile that is label 0's share."""
    if not len(y):
        x, y = np.zeros((1, N_FEATURES)), np.ones(1)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = ((x - mean) / scale).clip(-8, 8)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    weights = np.zeros(x.shape[1])
    if len(good) and len(bad):
        draw = np.random.default_rng(seed)
        won, lost = draw.choice(good, pairs), draw.choice(bad, pairs)
        turned = np.where(np.arange(pairs) % 2, 1.0, -1.0)  # both orders, so that the loss has both outcomes
        difference = (z[won] - z[lost]) * turned[:, None]
        weights = fit_logistic(difference, (turned > 0).astype(float), np.zeros(x.shape[1]), strength=pairs / 1000)
    ranks = z @ weights
    cut = float(np.quantile(ranks, len(bad) / len(y)))
    spread = float(ranks.std())
    return QualityModel(mean, scale, weights, cut, 4.0 / spread if spread > 0 else 1.0, 0.0)


def _pairs(rows: DataFrame, n_good: int, n_bad: int) -> DataFrame:
    """Written ``(y, x)``: differences of rows of label 1 and 0, each row in one pair at least.

    Rows are dealt into groups by their id. The rarer label's are repeated, so that a group holds as many of both.
    """
    few, many = sorted((n_good, n_bad))
    rounds, groups, parts = max(2, -(-PAIRS // many)), max(1, few // GROUP_ROWS), max(1, many // max(few, GROUP_ROWS))
    rare = F.col("y") == int(n_good < n_bad)
    part = F.when(rare, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(parts)).cast("int")))
    dealt = rows.select("y", "x", F.pmod(F.xxhash64("id"), F.lit(groups)).alias("group"), F.explode(part).alias("part"))

    def pair(table: pa.Table) -> pa.Table:
        y = table.column("y").to_numpy()
        x = table.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1)
        rng = np.random.default_rng(7)
        sides = [x[y == label] for label in (1, 0)]
        won, lost = (side[np.lexsort(side.T)][rng.permutation(len(side))] for side in sides)  # whatever the order of rows
        n = max(len(won), len(lost)) if len(won) and len(lost) else 0
        i, turns = np.tile(np.arange(n), rounds), np.repeat(np.arange(rounds), n)
        short = max(1, min(len(won), len(lost)))
        # In each round the rarer ones move on.
        moved = i + turns * max(1, short // rounds)
        a, b = (i, moved) if len(won) >= len(lost) else (moved, i)
        signs = np.where((i + turns) % 2, 1.0, -1.0)  # both orders, so that the loss has both outcomes
        difference = (won[a % max(1, len(won))] - lost[b % max(1, len(lost))]) * signs[:, None] if n else np.zeros((0, x.shape[1]))
        lists = pa.ListArray.from_arrays(np.arange(len(difference) + 1, dtype=np.int32) * x.shape[1], pa.array(difference.ravel()))
        return pa.table([pa.array((signs > 0).astype(np.int32)), lists], ["y", "x"])

    return stored(dealt.groupBy("group", "part").applyInArrow(pair, "y int, x array<double>"), "quality-pairs")


def _quantile(rows: DataFrame, rank, low: float, high: float, before: int) -> float:
    """The rank that ``before`` of the rows lie below: counted in bins, then in bins of the bin that holds it."""
    for _ in range(6):
        if not low < high:
            break
        edges = np.linspace(low, high, BINS + 1)

        def count(x: np.ndarray, y: np.ndarray, edges: np.ndarray = edges) -> np.ndarray:
            # The first number counts what lies below the edges.
            return np.bincount(np.searchsorted(edges, rank(x), side="right"), minlength=BINS + 2).astype(float)

        place = int(np.searchsorted(np.cumsum(summed(rows, count)), before, side="right"))
        if not 0 < place <= BINS:
            return float(high if place else low)
        low, high = float(edges[place - 1]), float(edges[place])
    return low


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", learn_rows: int | None = None) -> QualityModel:
    """Fit on all labelled documents outside the held-out fold, or ``learn_rows`` of them; sums over their features reach the driver."""
    known = labelled_rows(docs, labels, label, id_col, text_col, learn_rows)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array(list(features(batch.column(1))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x, batch.column(2)], ["id", "x", "y"])

    kind = known.schema["id"].dataType.simpleString()
    rows = known.mapInArrow(read, f"id {kind}, x array<double>, y int").withColumn("y", F.least("y", F.lit(1)))
    rows = stored(rows, "quality-features")
    total = summed(rows, lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(axis=0)]))
    if total is None:
        return fit(np.empty((0, N_FEATURES)), np.empty(0))
    n, n_good, mean = int(total[0]), int(total[1]), total[2:] / total[0]
    scale = np.sqrt(summed(rows, lambda x, y: ((x - mean) ** 2).sum(axis=0)) / n) + 1e-6
    weights = np.zeros(N_FEATURES)
    if 0 < n_good < n:
        z = lambda x: ((x - mean) / scale).clip(-8, 8)
        pairs = _pairs(_scaled(rows, z), n_good, n - n_good)
        weights = fit_logistic_rows(pairs, weights, strength=pairs.count() / 1000)
    model = QualityModel(mean, scale, weights, 0.0, 1.0, 0.0)
    ranks = rows.mapInArrow(_ranked(model.rank), "y int, x array<double>")
    ranks = stored(ranks, "quality-ranks")
    ends = ranks.agg(F.min(F.get("x", F.lit(0))).alias("a"), F.max(F.get("x", F.lit(0))).alias("b")).first()
    middle = float(summed(ranks, lambda x, y: x.sum(axis=0))[0]) / n
    spread = float(np.sqrt(summed(ranks, lambda x, y: ((x - middle) ** 2).sum(axis=0))[0] / n))
    model.cut = _quantile(ranks, lambda x: x[:, 0], ends.a, ends.b, min(n - n_good, n - 1))
    model.slope = 4.0 / spread if spread > 0 else 1.0
    return model


def _scaled(rows: DataFrame, z) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = z(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64())), batch.column(2)], ["id", "x", "y"])

    return rows.mapInArrow(run, rows.schema)


def _ranked(rank):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = rank(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1))
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array([[v] for v in values], pa.list_(pa.float64()))], ["y", "x"])

    return run


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(id_col, held_out, score, predicted)`` of every row; ``predicted`` is 1 from ``threshold`` on.

    Null and empty texts score 0. Repeated rows get equal scores; null ids stay null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(features(batch.column(1)), threshold))], ["id", "score"])

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col))
    out = given.mapInArrow(run, f"id {given.schema['id'].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
