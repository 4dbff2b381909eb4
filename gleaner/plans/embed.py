"""Offline encoding of a corpus or a query set to vector files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.constants import ENCODE_BATCH_SIZE
from gleaner.operators.chunking import truncate_text
from gleaner.operators.encode import Encoder, encode_corpus, l2_normalize
from gleaner.operators.positions import slice_range
from gleaner.plans.maintenance import artifact_path
from gleaner.plans.workspace import is_complete, stored
from gleaner.sources.vectors import read_fvecs, write_fvecs


def generate_vectors(
    texts: DataFrame,
    root: str,
    lang: str,
    model: str,
    encoder_factory: Callable[[], Encoder],
    begin: int | None = None,
    end: int | None = None,
    col: str = "text",
    max_tokens: int | None = None,
    normalize: bool = False,
    batch_size: int = ENCODE_BATCH_SIZE,
    overwrite: bool = False,
) -> DataFrame:
    """``(pos, vec)`` of the positioned ``texts``, kept as an fvecs folder under ``root``.

    The folder is named by language, rows, model and every setting that changes a vector; a
    complete one is reused unless ``overwrite``. Whole texts are encoded; ``max_tokens`` cuts
    them first, for an encoder that takes no more. ``begin`` and ``end`` restrict the work to a range of
    positions, so that several jobs can share a corpus; positions in the folder
    count from the begin of the range.
    """
    spark = texts.sparkSession
    settings = [col, *(["unit"] if normalize else []), *([f"first{max_tokens}"] if max_tokens is not None else [])]
    path = artifact_path(root, "dense", lang, "_".join([model, *settings]), begin, end)
    if overwrite or not is_complete(spark, path):
        rows = texts.select("pos", col)
        if begin is not None or end is not None:
            rows = slice_range(rows, begin or 0, end if end is not None else (1 << 62))
        if max_tokens is not None:
            rows = truncate_text(rows, max_tokens, col)
        vectors = encode_corpus(rows, col, encoder_factory, batch_size)
        if normalize:
            vectors = l2_normalize(vectors).withColumn("vec", F.col("vec").cast("array<float>"))
        # Written once before it is range-partitioned: the model runs once per text.
        write_fvecs(stored(vectors, "encoded"), path)
    return read_fvecs(spark, path)
