"""Lines of gzip files, one large file read by many tasks.

A gzip file can't be entered in its middle without the state of the decompressor: the bit at which a block of
the compressed stream begins, and the 32 KB of text before it. One pass over a file writes such checkpoints,
with the number of lines before each; then every range between two checkpoints is a task of its own. A line belongs to the range in which
it begins. Files of one range need no first pass.

The decompressor is the system's zlib, called for the two things that Python's module doesn't offer: stopping
at the end of a block and starting within a byte. Where that library is missing, every file is one range.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gleaner.plans.workspace import stored
from gleaner.sources.files import data_files, resolve

SPLIT_BYTES = 16 << 20  # compressed bytes of a range
READ_BYTES = 1 << 20
OUT_BYTES = 1 << 18
WINDOW = 32 << 10
GZIP, RAW = 31, -15  # window bits: with header and trailer, or the bare stream
OK, END, BUFFER_FULL, TO_BLOCK_END = 0, 1, -5, 5  # fixed values of the library
RANGE = "file string, tag string, no int, at long, bits int, begin long, stop long, lines long, window binary, error string"
LINE = "file string, tag string, no int, line long, value string, error string"


class _Stream(ctypes.Structure):
    """The library's stream record."""

    _fields_ = [
        ("next_in", ctypes.c_void_p), ("avail_in", ctypes.c_uint), ("total_in", ctypes.c_ulong),
        ("next_out", ctypes.c_void_p), ("avail_out", ctypes.c_uint), ("total_out", ctypes.c_ulong),
        ("msg", ctypes.c_char_p), ("state", ctypes.c_void_p), ("zalloc", ctypes.c_void_p), ("zfree", ctypes.c_void_p),
        ("opaque", ctypes.c_void_p), ("data_type", ctypes.c_int), ("adler", ctypes.c_ulong), ("reserved", ctypes.c_ulong),
    ]


@lru_cache(maxsize=1)
def _library() -> ctypes.CDLL | None:
    name = ctypes.util.find_library("z") or "libz.so.1"
    try:
        library = ctypes.CDLL(name)
    except OSError:
        return None
    library.zlibVersion.restype = ctypes.c_char_p
    return library


class BrokenFile(RuntimeError):
    """A gzip file is damaged or ends early."""


class Inflater:
    """Text of a gzip file from its start or from a checkpoint, and where its blocks begin."""

    def __init__(self, handle, at: int = 0, bits: int = 0, window: bytes = b""):
        self.library, self.handle = _library(), handle
        self.stream, self.given = _Stream(), b""
        self.out = ctypes.create_string_buffer(OUT_BYTES)
        self.raw, self.ended = at > 0, False
        self._begin(RAW if self.raw else GZIP)
        self.read_to = at - (bits > 0)
        if self.raw:
            handle.seek(self.read_to)
            if bits:
                first = handle.read(1)[0]
                self.read_to += 1
                self.library.inflatePrime(ctypes.byref(self.stream), bits, first >> (8 - bits))
            self.library.inflateSetDictionary(ctypes.byref(self.stream), window, len(window))

    def _begin(self, window_bits: int) -> None:
        code = self.library.inflateInit2_(ctypes.byref(self.stream), window_bits, self.library.zlibVersion(), ctypes.sizeof(_Stream))
        if code != OK:
            raise BrokenFile(f"the decompressor doesn't start: {code}")

    def _feed(self) -> bool:
        """Whether there is input."""
        if not self.stream.avail_in:
            self.given = self.handle.read(READ_BYTES)
            self.read_to += len(self.given)
            self.stream.next_in = ctypes.cast(ctypes.c_char_p(self.given), ctypes.c_void_p).value
            self.stream.avail_in = len(self.given)
        return self.stream.avail_in > 0

    @property
    def at(self) -> int:
        """Compressed bytes used so far."""
        return self.read_to - self.stream.avail_in

    @property
    def block_bits(self) -> int | None:
        """At the beginning of a block that has another before it: bits of the last byte that are still to be used."""
        kind = self.stream.data_type
        return kind & 7 if kind & 128 and not kind & 64 else None

    def text(self) -> Iterator[bytes]:
        """The text of all members, a piece at a time; pieces end with blocks."""
        while True:
            if not self._feed():
                raise BrokenFile("ends inside the compressed stream")
            self.stream.next_out = ctypes.addressof(self.out)
            self.stream.avail_out = OUT_BYTES
            code = self.library.inflate(ctypes.byref(self.stream), TO_BLOCK_END)
            if code not in (OK, END, BUFFER_FULL):
                raise BrokenFile(f"damaged near byte {self.at}")
            self.ended = code == END
            if made := OUT_BYTES - self.stream.avail_out:
                yield ctypes.string_at(self.out, made)
            elif code == OK:
                yield b""  # a block's head
            if code == END and not self._next_member():
                return

    def _next_member(self) -> bool:
        """Go on with the member behind this one, if there is any."""
        if self.raw:  # the trailer is not part of the bare stream
            for _ in range(8):
                if not self._feed():
                    raise BrokenFile("ends inside a trailer")
                self._skip()
        while self._feed() and self.given[len(self.given) - self.stream.avail_in] == 0:
            self._skip()  # padding
        if not self._feed():
            return False
        self.library.inflateEnd(ctypes.byref(self.stream))
        left, place = self.stream.avail_in, self.stream.next_in
        self.stream = _Stream()
        self._begin(GZIP)
        self.raw, self.stream.avail_in, self.stream.next_in = False, left, place
        return True

    def _skip(self) -> None:
        self.stream.next_in += 1
        self.stream.avail_in -= 1

    def close(self) -> None:
        self.library.inflateEnd(ctypes.byref(self.stream))


def checkpoints(handle, every: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """``(at, bits, begin, lines, window)`` of the starts of ranges; the last one, with ``at = -1``, is the file's end.

    ``begin`` counts bytes of text, ``lines`` the line ends before it.
    """
    yield 0, 0, 0, 0, b""
    source, begin, lines, last, window = Inflater(handle), 0, 0, 0, b""
    try:
        for part in source.text():
            begin, lines = begin + len(part), lines + part.count(b"\n")
            window = (window + part)[-WINDOW:] if len(part) < WINDOW else part[-WINDOW:]
            if begin and source.at - last >= every and source.block_bits is not None and not source.ended:
                yield source.at, source.block_bits, begin, lines, window
                last = source.at
    finally:
        source.close()
    yield -1, 0, begin, lines + (window[-1:] not in (b"\n", b"")), b""


def range_lines(handle, at: int, bits: int, begin: int, stop: int, window: bytes) -> Iterator[bytes]:
    """Lines that begin in ``[begin, stop)``; ``stop < 0`` stands for the end of the file."""
    source = Inflater(handle, at, bits, window)
    place, rest = begin, b""
    skip = begin > 0 and window[-1:] != b"\n"  # the line here began in the range before
    try:
        for part in source.text():
            rest += part
            if b"\n" not in part:
                continue
            *whole, rest = rest.split(b"\n")
            for line in whole:
                if skip:
                    skip = False
                elif 0 <= stop <= place:
                    return
                else:
                    yield line
                place += len(line) + 1
            if not skip and 0 <= stop <= place:
                return
        if rest and not skip and not 0 <= stop <= place:
            yield rest
    finally:
        source.close()


def _plain_lines(handle) -> Iterator[bytes]:
    """Lines of a whole file by Python's own module."""
    inflater, rest = zlib.decompressobj(GZIP), b""
    while data := handle.read(READ_BYTES):
        while data:
            *whole, rest = (rest + inflater.decompress(data)).split(b"\n")
            yield from whole
            data = inflater.unused_data.lstrip(b"\0") if inflater.eof else b""
            inflater = zlib.decompressobj(GZIP) if inflater.eof and data else inflater
    if not inflater.eof:
        raise BrokenFile("ends inside the compressed stream")
    if rest:
        yield rest


def gzip_ranges(spark: SparkSession, paths: dict[str, str], split_bytes: int = SPLIT_BYTES, count_lines: bool = True) -> DataFrame:
    """Ranges of the gzip files below ``paths`` (tag to path), written; a damaged file has a range with its error.

    Files are gone through at once, a task each. Without ``count_lines`` files of at most ``split_bytes`` are taken as one
    range unread, and their line numbers stay unknown.
    """
    files, ranges = [], []
    for tag, path in paths.items():
        for file, size in data_files(path):
            alone = _library() is None or size <= split_bytes and not count_lines
            (ranges if alone else files).append((file, tag, size))
    root = next(iter(paths.values()))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = resolve(root)
        for batch in batches:
            for row in batch.to_pylist():
                found, error = [], None
                try:
                    with filesystem.open_input_file(row["file"]) as handle:
                        found = list(checkpoints(handle, split_bytes))
                except (BrokenFile, OSError) as problem:
                    found, error = [(0, 0, 0, 0, b""), (-1, 0, 0, 0, b"")], str(problem)
                last = len(found) - 2
                rows = [
                    (row["file"], row["tag"], no, at, bits, begin, -1 if no == last else found[no + 1][2], lines + (begin > 0 and window[-1:] != b"\n"), window, error)
                    for no, (at, bits, begin, lines, window) in enumerate(found[:-1])
                ]
                rows.append((row["file"], row["tag"], last + 1, -1, 0, found[-1][2], -1, found[-1][3], b"", error))
                yield _batch(rows, RANGE)

    known = spark.createDataFrame([(f, t, 0, 0, 0, 0, -1, None, bytearray(), None) for f, t, _ in ranges], RANGE)
    if files:
        listed = spark.createDataFrame(files, "file string, tag string, size long").repartition(len(files))
        known = known.unionByName(listed.mapInArrow(index, RANGE))
    return stored(known, "gzip-ranges")


_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(columns, kinds)], list(names))


def gzip_lines(ranges: DataFrame, root: str, keep_errors: bool = False) -> DataFrame:
    """``(file, tag, no, line, value, error)``: the lines of all ranges, each range a task.

    ``line`` is the number of the line in its file, from 0, where it is known. A damaged file raises, or with ``keep_errors``
    gives a row that only has an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = resolve(root)
        for batch in batches:
            for row in batch.to_pylist():
                key, number, held, size = (row["file"], row["tag"], row["no"]), row["lines"], [], 0
                try:
                    if row["error"]:
                        raise BrokenFile(f"{row['file']} {row['error']}")
                    with filesystem.open_input_file(row["file"]) as handle:
                        whole = row["at"] == 0 and row["stop"] < 0 and row["lines"] is None
                        lines = _plain_lines(handle) if whole else range_lines(handle, row["at"], row["bits"], row["begin"], row["stop"], row["window"])
                        for line in lines:
                            held.append((*key, number, line.removesuffix(b"\r").decode("utf-8", "replace"), None))
                            number, size = None if number is None else number + 1, size + len(line)
                            if size >= READ_BYTES:
                                yield _batch(held, LINE)
                                held, size = [], 0
                except (BrokenFile, OSError, zlib.error) as problem:
                    if not keep_errors:
                        raise
                    held.append((*key, None, None, str(problem)))
                if held:
                    yield _batch(held, LINE)

    work = ranges.where("at >= 0")
    return work.repartition(max(1, work.count())).mapInArrow(read, LINE)


def with_positions(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """``lines`` with ``pos``, the gap-free number of a line over all files of a tag in the order of their names."""
    # One row per file.
    before = Window.partitionBy("tag").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.where("at < 0").select("file", "tag", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("start"))
    return lines.join(starts, ["file", "tag"]).withColumn("pos", F.col("start") + F.col("line")).drop("start")
