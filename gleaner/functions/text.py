"""Text expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.constants import (
    BASE_ID_GROUP,
    QUERY_RESERVED_CHARS,
    TOKEN_DELIMITER,
    TOKEN_MAX_LEN,
    TOKEN_MIN_LEN,
)


def sanitized(text: Column) -> Column:
    """``text`` with every reserved query character replaced by one space."""
    return F.translate(text, QUERY_RESERVED_CHARS, " " * len(QUERY_RESERVED_CHARS))


def pieces(text: Column) -> Column:
    """All lower-case pieces between token delimiters, short and empty ones included.

    The reserved query characters are delimiters themselves, so a query and its
    sanitised form have the same pieces.
    """
    return F.split(F.lower(text), TOKEN_DELIMITER)


def is_token(piece: Column, min_len: int = TOKEN_MIN_LEN, max_len: int = TOKEN_MAX_LEN) -> Column:
    return F.char_length(piece).between(min_len, max_len)


def tokens(text: Column, min_len: int = TOKEN_MIN_LEN, max_len: int = TOKEN_MAX_LEN) -> Column:
    """Array of the index terms of ``text``."""
    return F.filter(pieces(text), lambda t: is_token(t, min_len, max_len))


def truncated(text: Column, max_tokens: int) -> Column:
    """The first ``max_tokens`` whitespace-separated tokens; shorter texts stay untouched."""
    words = F.split(text, r"[ \t\r\n]+")
    return F.when(F.size(words) <= max_tokens, text).otherwise(
        F.array_join(F.slice(words, 1, max_tokens), " ")
    )


def base_id(pos: Column, group: int = BASE_ID_GROUP) -> Column:
    """Group label of a 0-based row position."""
    number = F.floor(pos / F.lit(group)) + 1
    return F.concat(F.lit("base_id_"), number.cast("bigint").cast("string"))
