"""Cutting texts into chunks and limiting their length."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.functions.constants import CHUNK_CHARS

# Where a text may be cut, best place first; then anywhere.
BREAKS = ["\n\n", "\n", " "]


def truncate_text(
    df: DataFrame, max_tokens: int, col: str = "text", out: str | None = None
) -> DataFrame:
    """Texts limited to ``max_tokens`` whitespace-separated tokens."""
    return df.withColumn(out or col, T.truncated(F.col(col), max_tokens))


def _fixed(df: DataFrame, size: int, overlap: int) -> DataFrame:
    """Windows of ``size`` characters, ``overlap`` of them shared with the next; JVM only."""
    step = size - overlap
    length = F.char_length("text")
    last = F.when(length > size, F.ceil((length - size) / F.lit(step)).cast("int")).otherwise(0)
    return (
        df.where(length > 0)
        .select("docid", "text", F.explode(F.sequence(F.lit(0), last)).alias("n"))
        .select(
            "docid",
            F.col("n").cast("bigint").alias("chunk_no"),
            F.substr("text", F.col("n") * step + 1, F.lit(size)).alias("chunk"),
        )
    )


def _tail(pieces: list[str], room: int) -> list[str]:
    """The longest run of last pieces with at most ``room`` characters."""
    kept: list[str] = []
    for piece in reversed(pieces):
        room -= len(piece)
        if room < 0:
            break
        kept.insert(0, piece)
    return kept


def _packed(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Neighbouring pieces joined to chunks of at most ``size`` characters."""
    current: list[str] = []
    length = 0
    for piece in pieces:
        if current and length + len(piece) > size:
            yield "".join(current)
            current = _tail(current, min(overlap, size - len(piece)))
            length = sum(map(len, current))
        current.append(piece)
        length += len(piece)
    yield "".join(current)


def _sliced(text: str, size: int, overlap: int) -> Iterator[str]:
    """Chunks of a text without breaks; like :func:`_packed` over its characters."""
    overlap = min(overlap, size - 1)
    for start in range(0, max(1, len(text) - overlap), size - overlap):
        yield text[start : start + size]


def _chunks(text: str, size: int, overlap: int, breaks: list[str]) -> Iterator[str]:
    usable = [b for b in breaks if b in text]
    if not usable:
        yield from _sliced(text, size, overlap)
        return
    best, finer = usable[0], usable[1:]
    head, *rest = text.split(best)
    # A break stays with the piece that follows it.
    short: list[str] = []
    for piece in filter(None, [head, *(best + r for r in rest)]):
        if len(piece) < size:
            short.append(piece)
            continue
        # A long piece is cut at finer breaks and shares no chunk with its neighbours.
        yield from _packed(short, size, overlap)
        short = []
        yield from _chunks(piece, size, overlap, finer)
    yield from _packed(short, size, overlap)


def recursive_chunks(text: str, size: int, overlap: int = 0) -> list[str]:
    """Chunks of at most ``size`` characters, cut at paragraphs, lines, words or anywhere.

    Surrounding whitespace of a chunk is dropped, so are empty chunks.
    """
    return [c.strip() for c in _chunks(text, size, overlap, BREAKS) if c.strip()]


def _recursive(df: DataFrame, size: int, overlap: int) -> DataFrame:
    docid = df.schema["docid"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (docid, number, chunk)
                for docid, text in zip(batch["docid"], batch["text"])
                for number, chunk in enumerate(recursive_chunks(text, size, overlap))
            ]
            yield pd.DataFrame(rows, columns=["docid", "chunk_no", "chunk"])

    rows = df.where(F.col("text").isNotNull()).select("docid", "text")
    return rows.mapInPandas(cut, f"docid {docid}, chunk_no bigint, chunk string")


def chunk_documents(
    df: DataFrame, size: int = CHUNK_CHARS, overlap: int = 0, mode: str = "recursive"
) -> DataFrame:
    """``(docid, chunk_no, chunk)``; ``mode`` is ``recursive`` or ``fixed``."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    if mode == "fixed":
        return _fixed(df, size, overlap)
    if mode == "recursive":
        return _recursive(df, size, overlap)
    raise ValueError(f"unknown mode {mode!r}; use recursive or fixed")
