"""Words of whole Arrow text batches as 64-bit hashes, computed on bytes with numpy.

Separators are ASCII bytes, so words can be cut on UTF-8 bytes without decoding.
Two different words share a hash with probability about 2**-64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Separators of ``[^\x20\x09-\x0D]+``.
BLANKS = bytes([*range(0x09, 0x0E), 0x20])
#: Separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-case.
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

SLICE_BYTES = 2 << 20  # text worked on at once; more only for one longer text
LONG_WORD = 1024  # longer words are hashed one by one

_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * _C1
    h ^= h >> np.uint64(33)
    h = h * _C2
    h ^= h >> np.uint64(33)
    return h


def text_slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` of runs of rows with about ``SLICE_BYTES`` of text; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1
        stop = min(max(stop, row + 1), len(column))
        low, high = offsets[row], offsets[stop]
        yield row, data[low:high], offsets[row : stop + 1] - low
        row = stop


def cut_words(data: np.ndarray, offsets: np.ndarray, separators: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and per row the number of the first word (one more at the end)."""
    is_sep = np.zeros(256, dtype=bool)
    is_sep[list(separators)] = True
    inside = np.zeros(len(data) + 2, dtype=bool)
    np.logical_not(is_sep[data], out=inside[1:-1])
    begins = inside[1:] & ~inside[:-1]
    finishes = inside[:-1] & ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]  # words do not run from one text into the next
    touching = edges[inside[edges] & inside[edges + 1]]
    begins[touching] = True
    finishes[touching] = True
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes)
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, A-Z taken as lower case."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    np.take(_LOWER, data, out=padded[: len(data)])
    lanes = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    lengths = ends - starts
    h = mix(lengths.astype(np.uint64) * _STEP)
    usual = lengths <= LONG_WORD
    at, k = np.flatnonzero(usual), 0
    while len(at):
        left = lengths[at] - 8 * k
        h[at] = mix(h[at] ^ (lanes[starts[at] + 8 * k] & _MASKS[np.minimum(left, 8)]))
        at, k = at[left > 8], k + 1
    for i in np.flatnonzero(~usual):
        digest = hashlib.blake2b(padded[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        h[i] = np.uint64(int.from_bytes(digest, "little"))
    return h


def hash_runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.full(n, np.uint64(k))
    for i in range(k):
        h = h * _STEP + words[i : i + n]
    return mix(h)
