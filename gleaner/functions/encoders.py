"""A deterministic encoder, so that pipelines run without a neural model."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np

WORD_BREAK = re.compile("[ \t\r\n]+")


@lru_cache(maxsize=200_000)
def _slot(token: str) -> tuple[int, int]:
    """Hash and sign of a token."""
    digest = hashlib.md5(token.encode("utf-8")).hexdigest()
    return int(digest[:8], 16), 1 if int(digest[8], 16) % 2 == 0 else -1


class HashingEncoder:
    """Signed feature hashing of whitespace tokens into ``dim`` buckets."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for row, text in enumerate(texts):
            for token in WORD_BREAK.split(text):
                if token:
                    bucket, sign = _slot(token)
                    out[row, bucket % self.dim] += sign
        return out


class HashingTokenEncoder:
    """One vector per whitespace token, all zero but for the signed bucket of the token."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: list[str]) -> list[list[list[float]]]:
        result = []
        for text in texts:
            vectors = []
            for token in WORD_BREAK.split(text):
                if token:
                    bucket, sign = _slot(token)
                    vector = [0.0] * self.dim
                    vector[bucket % self.dim] = float(sign)
                    vectors.append(vector)
            result.append(vectors)
        return result
