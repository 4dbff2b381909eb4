"""Numpy scoring of one Arrow batch against a block of queries.

Spark partitions the documents and merges the local results; these helpers only
see one batch of one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SCALE = 10.0**6


def round6(x: np.ndarray) -> np.ndarray:
    """Half-up rounding to six decimals."""
    return np.floor(x * SCALE + 0.5) / SCALE


def matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of a list column as a 2-D double array; all rows need the same length."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if vectors.null_count:
        raise ValueError("null vector")
    offsets = np.asarray(vectors.offsets)
    dims = np.diff(offsets)
    if len(dims) == 0:
        return np.empty((0, 0))
    if (dims != dims[0]).any():
        raise ValueError(f"vectors of different dimensions: {sorted(set(dims.tolist()))[:5]}")
    values = np.asarray(vectors.values[offsets[0] : offsets[-1]], dtype=np.float64)
    return values.reshape(len(dims), int(dims[0]))


def nested(token_vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All token vectors of a list-of-lists column and the token offsets per row."""
    if isinstance(token_vectors, pa.ChunkedArray):
        token_vectors = token_vectors.combine_chunks()
    offsets = np.asarray(token_vectors.offsets)
    inner = token_vectors.values[offsets[0] : offsets[-1]]
    return matrix(inner), offsets - offsets[0]


def inner_products(docs: np.ndarray, queries: np.ndarray) -> np.ndarray:
    return docs @ queries.T


def l2_distances(docs: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Distances by matrix product; nearly equal pairs are recomputed by difference,
    because the product form loses their digits."""
    doc_norms = np.einsum("ij,ij->i", docs, docs)
    query_norms = np.einsum("ij,ij->i", queries, queries)
    scale = doc_norms[:, None] + query_norms[None, :]
    squared = scale - 2.0 * (docs @ queries.T)
    rows, cols = np.nonzero(squared < 1e-4 * scale)
    for start in range(0, len(rows), 8192):
        r, c = rows[start : start + 8192], cols[start : start + 8192]
        diff = docs[r] - queries[c]
        squared[r, c] = np.einsum("ij,ij->i", diff, diff)
    return np.sqrt(np.maximum(squared, 0.0))


# Elements of one similarity matrix held at a time (64 MB of doubles).
MATRIX_ELEMENTS = 8_000_000


def _late_interaction(similarity, doc_tokens, doc_offsets, query_tokens, query_offsets) -> np.ndarray:
    """Per (document, query): sum over query tokens of the best token similarity."""
    n_queries = len(query_offsets) - 1
    out = np.empty((len(doc_offsets) - 1, n_queries))
    budget = max(1, MATRIX_ELEMENTS // max(1, len(doc_tokens)))
    start = 0
    while start < n_queries:
        stop = int(np.searchsorted(query_offsets, query_offsets[start] + budget, side="right")) - 1
        stop = min(max(stop, start + 1), n_queries)
        lo, hi = query_offsets[start], query_offsets[stop]
        sims = similarity(doc_tokens, query_tokens[lo:hi])
        best = np.maximum.reduceat(sims, doc_offsets[:-1], axis=0)
        out[:, start:stop] = np.add.reduceat(best, query_offsets[start:stop] - lo, axis=1)
        start = stop
    return out


def maxsim_scores(doc_tokens, doc_offsets, query_tokens, query_offsets) -> np.ndarray:
    return _late_interaction(inner_products, doc_tokens, doc_offsets, query_tokens, query_offsets)


def equal_bits(docs: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Number of dimensions whose signs agree; zero counts as not positive."""
    doc_signs, query_signs = np.where(docs > 0, 1.0, -1.0), np.where(queries > 0, 1.0, -1.0)
    return (doc_signs @ query_signs.T + docs.shape[1]) / 2.0


def equal_bit_scores(doc_tokens, doc_offsets, query_tokens, query_offsets) -> np.ndarray:
    return _late_interaction(equal_bits, doc_tokens, doc_offsets, query_tokens, query_offsets)


@dataclass
class QueryBlock:
    """A bounded set of queries, ready for scoring: row ``i`` belongs to query ``qids[i]``.

    ``cells`` names the part of the collection a row looks at; ``None`` means all.
    """

    qids: list
    vectors: np.ndarray
    offsets: np.ndarray | None = None
    cells: np.ndarray | None = None

    @staticmethod
    def from_arrow(table: pa.Table, multi: bool, routed: bool) -> "QueryBlock":
        qids = table.column("qid").to_pylist()
        cells = np.array(table.column("cell").to_pylist(), dtype=object) if routed else None
        if multi:
            vectors, offsets = nested(table.column("qvec"))
            return QueryBlock(qids, vectors, offsets, cells)
        return QueryBlock(qids, matrix(table.column("qvec")), None, cells)

    def matching(self, docs: pa.Array) -> np.ndarray:
        """Document vectors of the queries' dimension."""
        docs = matrix(docs)
        if docs.shape[1] != self.vectors.shape[1]:
            raise ValueError(
                f"document vectors have {docs.shape[1]} dimensions, queries {self.vectors.shape[1]}"
            )
        return docs

    def scores(self, docs: pa.Array, metric: str) -> np.ndarray:
        """(documents x queries) scores, larger is better."""
        if metric in ("maxsim", "equal_bits"):
            doc_tokens, doc_offsets = nested(docs)
            score = maxsim_scores if metric == "maxsim" else equal_bit_scores
            return score(doc_tokens, doc_offsets, self.vectors, self.offsets)
        docs = self.matching(docs)
        if metric == "ip":
            return inner_products(docs, self.vectors)
        return -l2_distances(docs, self.vectors)


class LocalTopK:
    """Best ``k`` hits per query among the batches one task has seen.

    Order is (rounded score descending, docid ascending), the order of the final
    ranking, so dropping the rest cannot change the result.
    """

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.scores = [np.empty(0)] * n_queries
        self.ids = [np.empty(0, dtype=object)] * n_queries
        self.threshold = np.full(n_queries, -np.inf)

    def offer(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.threshold[query]
        if not keep.any():
            return
        merged = np.concatenate([self.scores[query], scores[keep]])
        merged_ids = np.concatenate([self.ids[query], ids[keep]])
        if len(merged) > self.k:
            cut = np.partition(merged, len(merged) - self.k)[len(merged) - self.k]
            better = np.flatnonzero(merged > cut)
            ties = np.flatnonzero(merged == cut)
            wanted = self.k - len(better)
            if len(ties) > wanted:
                ties = np.array(sorted(ties, key=lambda i: merged_ids[i])[:wanted], dtype=np.int64)
            chosen = np.concatenate([better, ties])
            merged, merged_ids = merged[chosen], merged_ids[chosen]
            self.threshold[query] = cut
        self.scores[query], self.ids[query] = merged, merged_ids

    def offer_all(self, scores: np.ndarray, ids: np.ndarray, columns: np.ndarray | None = None) -> None:
        columns = np.arange(scores.shape[1]) if columns is None else columns
        rounded = round6(scores)
        for j, query in enumerate(columns):
            self.offer(int(query), rounded[:, j], ids)

    def offer_near(self, queries: np.ndarray, docs: np.ndarray, ids: np.ndarray, metric: str, columns: np.ndarray | None = None) -> None:
        """The documents against the queries (all, or those numbered ``columns``) by ``l2`` or ``ip``.

        Only pairs that may reach the threshold of their query are rounded and looked at one by one; a query's products lie side by side.
        """
        columns = np.arange(len(queries)) if columns is None else columns
        rows = max(1, MATRIX_ELEMENTS // max(1, len(docs)))
        doc_norms = np.einsum("ij,ij->i", docs, docs)
        for start in range(0, len(columns), rows):
            some, numbers = queries[start : start + rows], columns[start : start + rows]
            values, threshold = some @ docs.T, self.threshold[numbers]
            if metric == "l2":
                query_norms = np.einsum("ij,ij->i", some, some)
                values *= -2.0
                values += query_norms[:, None]
                values += doc_norms[None, :]
                # Beyond rounding, the product form may be wrong in the last digits of the norms.
                least = np.maximum(-threshold, 0.0) + 1e-6
                near = values <= (least * least + 1e-9 * (query_norms + doc_norms.max(initial=0.0)))[:, None]
            else:
                near = values >= (threshold - 1e-6)[:, None]
            found, doc = np.nonzero(near)
            scores = values[found, doc]
            if metric == "l2":
                scores = self._distances(scores, some, docs, query_norms, doc_norms, found, doc)
            scores = round6(scores)
            ends = np.searchsorted(found, np.arange(len(some) + 1)).tolist()
            for j in np.unique(found).tolist():
                part = slice(ends[j], ends[j + 1])
                self.offer(int(numbers[j]), scores[part], ids[doc[part]])

    @staticmethod
    def _distances(squared, queries, docs, query_norms, doc_norms, q, d) -> np.ndarray:
        """Negative distances; nearly equal pairs are computed anew by difference."""
        close = np.flatnonzero(squared < 1e-4 * (query_norms[q] + doc_norms[d]))
        for start in range(0, len(close), 8192):
            part = close[start : start + 8192]
            diff = docs[d[part]] - queries[q[part]]
            squared[part] = np.einsum("ij,ij->i", diff, diff)
        return -np.sqrt(np.maximum(squared, 0.0))

    def results(self, rows: int = 50_000) -> Iterator[tuple[list[int], list, np.ndarray]]:
        """``(query numbers, ids, scores)`` in pieces of about ``rows`` hits."""
        queries: list[int] = []
        size = 0
        for query, scores in enumerate(self.scores):
            queries.append(query)
            size += len(scores)
            if size >= rows:
                yield self._piece(queries)
                queries, size = [], 0
        if size:
            yield self._piece(queries)

    def _piece(self, queries: list[int]) -> tuple[list[int], list, np.ndarray]:
        numbers = np.repeat(queries, [len(self.scores[q]) for q in queries]).tolist()
        ids = np.concatenate([self.ids[q] for q in queries]).tolist()
        return numbers, ids, np.concatenate([self.scores[q] for q in queries])
