"""Text encoding through a user-supplied model, and vector checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import vectors as V
from gleaner.functions.constants import ENCODE_BATCH_SIZE


class Encoder(Protocol):
    """Model with one method; rows of the result belong to the texts.

    A model may also have ``count_tokens(texts)``; without it a text has as many tokens as words.
    """

    def encode(self, texts: list[str]): ...


def _count_tokens(model: Encoder, texts: list[str]) -> np.ndarray:
    own = getattr(model, "count_tokens", None)
    return np.asarray(own(texts) if own else [len(t.split()) for t in texts], dtype=np.int64)


def budget_batches(lengths: np.ndarray, token_budget: int, most: int) -> list[np.ndarray]:
    """Row numbers of batches of texts of similar length, shortest first.

    A batch padded to its longest text holds at most ``token_budget`` tokens, and at most ``most`` texts; a longer
    text is a batch of its own. An empty text counts as one token.
    """
    if token_budget < 1 or most < 1:
        raise ValueError("a batch holds at least one token and one text")
    order = np.argsort(lengths, kind="stable")
    batches, start = [], 0
    for end in range(1, len(order) + 1):
        longest = max(1, lengths[order[end]]) if end < len(order) else 0
        if end == len(order) or end - start == most or (end + 1 - start) * longest > token_budget:
            batches.append(order[start:end])
            start = end
    return batches


def _batches(model: Encoder, texts: list[str], batch_size: int, token_budget: int | None) -> list[np.ndarray]:
    if token_budget is None:
        return [np.arange(i, min(i + batch_size, len(texts))) for i in range(0, len(texts), batch_size)]
    return budget_batches(_count_tokens(model, texts), token_budget, batch_size)


def _encode(
    df: DataFrame, col: str, factory: Callable[[], Encoder], batch_size: int, out: str, kind: str, token_budget: int | None = None
) -> DataFrame:
    """``df`` without ``col``, with the encoded column; one model per task.

    Only the kept columns and the text travel to Python; select before encoding.
    """
    kept = [f for f in df.schema.fields if f.name != col]
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{out}` {kind}"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in batches:
            if model is None:
                model = factory()
            texts = batch[col].fillna("").tolist()
            vectors = [None] * len(texts)
            for some in _batches(model, texts, batch_size, token_budget):
                for row, vector in zip(some, model.encode([texts[i] for i in some])):
                    vectors[row] = vector
            yield batch.drop(columns=[col]).assign(**{out: vectors})

    return df.mapInPandas(run, ddl)


def encode_corpus(
    df: DataFrame,
    col: str,
    encoder_factory: Callable[[], Encoder],
    batch_size: int = ENCODE_BATCH_SIZE,
    out: str = "vec",
    token_budget: int | None = None,
) -> DataFrame:
    """One dense vector per text.

    With ``token_budget``, the texts of an Arrow batch are encoded by length, in batches of at most
    ``batch_size`` texts that hold at most so many tokens with their padding; rows keep their order.
    """
    return _encode(df, col, encoder_factory, batch_size, out, "array<float>", token_budget)


def padding_report(
    df: DataFrame, col: str, encoder_factory: Callable[[], Encoder], batch_size: int = ENCODE_BATCH_SIZE, token_budget: int | None = None
) -> DataFrame:
    """One row ``(batches, tokens, slots, padding)``: what encoding ``col`` pads its batches to, and the share of padding in it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in batches:
            model = model or encoder_factory()
            texts = batch[col].fillna("").tolist()
            lengths = _count_tokens(model, texts)
            some = _batches(model, texts, batch_size, token_budget)
            slots = sum(len(b) * int(lengths[b].max()) for b in some)
            yield pd.DataFrame({"batches": [len(some)], "tokens": [int(lengths.sum())], "slots": [slots]})

    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("batches", "tokens", "slots")]
    made = df.select(col).mapInPandas(run, "batches bigint, tokens bigint, slots bigint").agg(*sums)
    padding = F.coalesce(1 - F.col("tokens") / F.nullif(F.col("slots"), F.lit(0)), F.lit(0.0))
    return made.withColumn("padding", padding)


def encode_queries(
    df: DataFrame,
    encoder_factory: Callable[[], Encoder],
    batch_size: int = ENCODE_BATCH_SIZE,
) -> DataFrame:
    """``(qid, query, qvec)``; queries may use another model than documents."""
    texts = df.select("*", F.col("query").alias("encoded_text"))
    return _encode(texts, "encoded_text", encoder_factory, batch_size, "qvec", "array<float>")


def encode_multivector(
    df: DataFrame,
    col: str,
    encoder_factory: Callable[[], Encoder],
    batch_size: int = ENCODE_BATCH_SIZE,
    out: str = "vecs",
    token_budget: int | None = None,
) -> DataFrame:
    """One list of token vectors per text; ``token_budget`` as in :func:`encode_corpus`."""
    return _encode(df, col, encoder_factory, batch_size, out, "array<array<float>>", token_budget)


def concat_chunk_vectors(chunks: DataFrame) -> DataFrame:
    """``(docid, vecs)``: token vectors of all chunks of a document in chunk order.

    A group holds the chunks of one document, which one row holds afterwards.
    """
    ordered = F.array_sort(F.collect_list(F.struct("chunk_no", "vecs")))
    return chunks.groupBy("docid").agg(
        F.flatten(F.transform(ordered, lambda c: c.vecs)).alias("vecs")
    )


def pool_vectors(df: DataFrame, col: str = "vecs", method: str = "cls", out: str = "vec") -> DataFrame:
    """One vector per row from its token vectors: ``cls`` (first), ``mean`` or ``max``."""
    return df.withColumn(out, V.pooled(F.col(col), method)).drop(col)


def l2_normalize(df: DataFrame, col: str = "vec") -> DataFrame:
    return df.withColumn(col, V.l2_normalized(F.col(col)))


def sign_binarize(df: DataFrame, col: str = "vec", out: str = "bits") -> DataFrame:
    return df.withColumn(out, V.sign_bits(F.col(col)))


def vector_to_text(df: DataFrame, col: str = "vec", out: str = "vec_text") -> DataFrame:
    return df.withColumn(out, V.vector_text(F.col(col)))


def text_to_vector(df: DataFrame, col: str = "vec_text", out: str = "vec") -> DataFrame:
    return df.withColumn(out, V.parsed_vector(F.col(col)))


def validate_vectors(vectors: DataFrame, ids: DataFrame, dim: int) -> DataFrame:
    """One row: numbers of vectors and ids, wrong dimensions, ids without vector, verdict."""
    sides = vectors.select("docid", F.size("vec").alias("dim"), F.lit(1).alias("has_vec")).join(
        ids.select("docid", F.lit(1).alias("has_id")), "docid", "full"
    )
    report = sides.agg(
        F.count("has_vec").alias("n_vectors"),
        F.count("has_id").alias("n_ids"),
        F.count_if(F.col("has_vec").isNotNull() & (F.col("dim") != dim)).alias("wrong_dim"),
        F.count_if(F.col("has_vec").isNull()).alias("ids_without_vector"),
        F.count_if(F.col("has_id").isNull()).alias("vectors_without_id"),
    )
    ok = (
        (F.col("wrong_dim") == 0)
        & (F.col("ids_without_vector") == 0)
        & (F.col("vectors_without_id") == 0)
    )
    return report.withColumn("ok", ok)
