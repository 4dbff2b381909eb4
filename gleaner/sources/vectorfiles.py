"""Data sources for binary vector files.

``fvecs`` / ``ivecs``: per record an int32 dimension and that many 4-byte values.
``multivec``: per record an int32 length and that many fvecs records.
``sparsevec``: an int32 number of records; per record an int32 length and that
many (int32 index, float32 value) pairs.

All numbers are little-endian. Register with :func:`register`, then use
``spark.read.format(...)`` and ``df.write.format(...)``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
)
from pyspark.sql.types import StructType

from gleaner.sources.files import PartCommit, PartFiles, data_files, resolve

# Positions of files read record by record: file number times this, plus record number.
FILE_STRIDE = 1 << 40
INT = np.dtype("<i4")


class Span(InputPartition):
    """Records of one file: a byte range (fixed-size records) or the whole file."""

    def __init__(self, path: str, size: int, start: int, count: int, first_pos: int, dim: int):
        super().__init__(path)
        self.path = path
        self.size = size
        self.start = start
        self.count = count
        self.first_pos = first_pos
        self.dim = dim


class TruncatedFile(RuntimeError):
    """A file ends inside a record."""


def _read_exact(handle, n: int) -> bytes | None:
    """``n`` bytes, or ``None`` at (or inside) the end of the file."""
    data = handle.read(n)
    return data if len(data) == n else None


def _check_mode(mode: str) -> str:
    if mode not in ("fail", "stop"):
        raise ValueError(f"onTruncated is {mode!r}; use fail or stop")
    return mode


class VectorReader(DataSourceReader):
    """Reads fixed-size records in parallel byte ranges.

    The driver only lists files and reads one header; every task checks the
    headers of its own records. With ``layout=variable`` every file is one task
    and its records may differ in dimension.
    """

    def __init__(self, schema: StructType, options: dict, value_type: str):
        self.out = schema
        self.path = options["path"]
        self.value_type = value_type
        self.mode = _check_mode(options.get("ontruncated", "fail"))
        self.layout = options.get("layout", "fixed")
        self.max_rows = int(options["maxrows"]) if "maxrows" in options else None
        self.rows_per_split = int(options.get("rowspersplit", 65_536))

    def partitions(self) -> list[Span]:
        files = [(p, s) for p, s in data_files(self.path) if s > 0]
        if self.layout == "variable":
            return [Span(p, s, 0, -1, i * FILE_STRIDE, -1) for i, (p, s) in enumerate(files)]
        if not files:
            return [Span("", 0, 0, 0, 0, 0)]
        filesystem, _ = resolve(self.path)
        with filesystem.open_input_file(files[0][0]) as handle:
            header = _read_exact(handle, 4)
        if header is None:
            if self.mode == "fail":
                raise TruncatedFile(f"{files[0][0]} ends inside a record")
            return [Span("", 0, 0, 0, 0, 0)]
        dim = int(np.frombuffer(header, INT)[0])
        record = 4 + 4 * dim
        spans, pos = [], 0
        for path, size in files:
            if size % record and self.mode == "fail":
                raise TruncatedFile(
                    f"{path} holds no whole number of {dim}-dimensional records "
                    "(mixed dimensions need layout=variable)"
                )
            rows = size // record
            for first in range(0, rows, self.rows_per_split):
                count = min(self.rows_per_split, rows - first)
                if self.max_rows is not None:
                    count = min(count, self.max_rows - pos - first)
                if count > 0:
                    spans.append(Span(path, size, first * record, count, pos + first, dim))
            pos += rows
        return spans or [Span("", 0, 0, 0, 0, 0)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        if not span.path:
            return
        filesystem, _ = resolve(self.path)
        with filesystem.open_input_file(span.path) as handle:
            batches = self._variable(handle, span) if span.dim < 0 else self._fixed(handle, span)
            yield from batches

    def _batch(self, first: int, values: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        arrow_type = pa.float32() if self.value_type == "<f4" else pa.int32()
        vectors = pa.ListArray.from_arrays(
            pa.array(offsets.astype(np.int32)), pa.array(values, arrow_type)
        )
        pos = pa.array(np.arange(first, first + len(offsets) - 1, dtype=np.int64))
        return pa.RecordBatch.from_arrays([pos, vectors], names=["pos", "vec"])

    def _fixed(self, handle, span: Span) -> Iterator[pa.RecordBatch]:
        width = span.dim + 1
        step = max(1, 4_000_000 // (4 * width))
        handle.seek(span.start)
        for first in range(0, span.count, step):
            count = min(step, span.count - first)
            block = np.frombuffer(handle.read(count * 4 * width), INT).reshape(count, width)
            if (block[:, 0] != span.dim).any():
                raise ValueError(
                    f"{span.path} mixes dimensions; read it with option layout=variable"
                )
            values = np.ascontiguousarray(block[:, 1:]).view(self.value_type).ravel()
            offsets = np.arange(count + 1) * span.dim
            yield self._batch(span.first_pos + first, values, offsets)

    def _variable(self, handle, span: Span) -> Iterator[pa.RecordBatch]:
        first, vectors = span.first_pos, []
        limit = self.max_rows if self.max_rows is not None else span.size
        while len(vectors) + first - span.first_pos < limit:
            vector = read_vector(handle, self.value_type, span.path, self.mode)
            if vector is None:
                break
            vectors.append(vector)
            if len(vectors) == 4096:
                yield self._vectors(first, vectors)
                first, vectors = first + len(vectors), []
        if vectors:
            yield self._vectors(first, vectors)

    def _vectors(self, first: int, vectors: list[np.ndarray]) -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(v) for v in vectors])])
        return self._batch(first, np.concatenate(vectors), offsets)


def read_vector(handle, value_type: str, path: str, mode: str) -> np.ndarray | None:
    """Next record, or ``None`` at the end; a partial record follows ``mode``."""
    header = handle.read(4)
    if not header:
        return None
    body = None
    if len(header) == 4:
        body = _read_exact(handle, 4 * int(np.frombuffer(header, INT)[0]))
    if body is None:
        if mode == "fail":
            raise TruncatedFile(f"{path} ends inside a record")
        return None
    return np.frombuffer(body, value_type)


class FileReader(DataSourceReader):
    """Base of the formats with variable-length records: every file is one task."""

    rows_per_batch = 512

    def __init__(self, options: dict):
        self.path = options["path"]
        self.mode = _check_mode(options.get("ontruncated", "fail"))

    def partitions(self) -> list[Span]:
        files = data_files(self.path)
        spans = [Span(p, s, 0, -1, i * FILE_STRIDE, -1) for i, (p, s) in enumerate(files) if s]
        return spans or [Span("", 0, 0, 0, 0, 0)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        if not span.path:
            return
        filesystem, _ = resolve(self.path)
        with filesystem.open_input_stream(span.path, buffer_size=1 << 20) as handle:
            records = self.records(handle, span.path)
            first = span.first_pos
            while rows := list(islice(records, self.rows_per_batch)):
                pos = pa.array(np.arange(first, first + len(rows), dtype=np.int64))
                yield self.batch(pos, rows)
                first += len(rows)

    def records(self, handle, path: str) -> Iterator:
        raise NotImplementedError

    def batch(self, pos: pa.Array, rows: list) -> pa.RecordBatch:
        raise NotImplementedError

    def cut(self, path: str) -> None:
        if self.mode == "fail":
            raise TruncatedFile(f"{path} ends inside a record")


def _lists(values: pa.Array, lengths: list[int]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


class MultiVectorReader(FileReader):
    def records(self, handle, path: str) -> Iterator[list[np.ndarray]]:
        while header := handle.read(4):
            if len(header) < 4:
                return self.cut(path)
            vectors = []
            for _ in range(int(np.frombuffer(header, INT)[0])):
                vector = read_vector(handle, "<f4", path, self.mode)
                if vector is None:
                    return self.cut(path)
                vectors.append(vector)
            yield vectors

    def batch(self, pos: pa.Array, rows: list[list[np.ndarray]]) -> pa.RecordBatch:
        vectors = [v for row in rows for v in row]
        values = np.concatenate(vectors) if vectors else np.empty(0, np.float32)
        tokens = _lists(pa.array(values, pa.float32()), [len(v) for v in vectors])
        return pa.RecordBatch.from_arrays(
            [pos, _lists(tokens, [len(row) for row in rows])], names=["pos", "vecs"]
        )


# Rows of a sparse file unless ``rowsPerFile`` says otherwise; a task holds the bytes of one file.
SPARSE_ROWS_PER_FILE = 50_000
PAIR = np.dtype([("index", "<i4"), ("value", "<f4")])


class SparseVectorReader(FileReader):
    def records(self, handle, path: str) -> Iterator[np.ndarray]:
        header = _read_exact(handle, 4)
        if header is None:
            return self.cut(path)
        for _ in range(int(np.frombuffer(header, INT)[0])):
            length = _read_exact(handle, 4)
            n = int(np.frombuffer(length, INT)[0]) if length else 0
            body = _read_exact(handle, 8 * n)
            if length is None or body is None:
                return self.cut(path)
            yield np.frombuffer(body, PAIR)

    def batch(self, pos: pa.Array, rows: list[np.ndarray]) -> pa.RecordBatch:
        pairs, lengths = np.concatenate(rows), [len(row) for row in rows]
        indices = pa.array(np.ascontiguousarray(pairs["index"]), pa.int32())
        values = pa.array(np.ascontiguousarray(pairs["value"]), pa.float32())
        return pa.RecordBatch.from_arrays(
            [pos, _lists(indices, lengths), _lists(values, lengths)],
            names=["pos", "indices", "values"],
        )


class PartWriter(DataSourceArrowWriter):
    """Writes one or more part files per partition, in the row order of the partition."""

    suffix = ""

    def __init__(self, options: dict, overwrite: bool):
        self.parts = PartCommit(options["path"], overwrite)
        # Bounds what a format with a leading record count must hold in memory.
        self.rows_per_file = int(options.get("rowsperfile", 0))

    def encode(self, batch: pa.RecordBatch) -> bytes:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> PartFiles:
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        filesystem, target = resolve(self.parts.path)
        filesystem.create_dir(target, recursive=True)
        moves, handle = [], None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if handle is None:
                    part = self.parts.new_part(partition, 0, self.suffix)
                    moves.append(part)
                    handle = filesystem.open_output_stream(part[0])
                handle.write(self.encode(batch))
        finally:
            if handle is not None:
                handle.close()
        return PartFiles(moves)

    def commit(self, messages: list) -> None:
        self.parts.commit(messages)

    def abort(self, messages: list) -> None:
        self.parts.abort(messages)


def _records(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Length-prefixed runs of 4-byte values as one int32 array."""
    offsets = np.asarray(offsets, dtype=np.int64)
    lengths = np.diff(offsets)
    out = np.empty(len(values) + len(lengths), dtype=INT)
    heads = offsets[:-1] - offsets[0] + np.arange(len(lengths))
    mask = np.ones(len(out), dtype=bool)
    mask[heads] = False
    out[heads] = lengths
    out[mask] = values.view(INT)
    return out


def _list_values(array: pa.ListArray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    if array.null_count:
        raise ValueError("null vector")
    offsets = np.asarray(array.offsets)
    values = np.asarray(array.values[offsets[0] : offsets[-1]]).astype(dtype)
    return offsets, values


class VectorWriter(PartWriter):
    def __init__(self, options: dict, overwrite: bool, value_type: str):
        super().__init__(options, overwrite)
        self.value_type = value_type
        self.suffix = ".fvecs" if value_type == "<f4" else ".ivecs"

    def encode(self, batch: pa.RecordBatch) -> bytes:
        return _records(*_list_values(batch.column("vec"), self.value_type)).tobytes()


class MultiVectorWriter(PartWriter):
    suffix = ".multivec"

    def encode(self, batch: pa.RecordBatch) -> bytes:
        column = batch.column("vecs")
        out = []
        for row in range(batch.num_rows):
            tokens = column[row].values
            out.append(np.array([len(tokens)], INT).tobytes())
            if len(tokens):
                out.append(_records(*_list_values(tokens, "<f4")).tobytes())
        return b"".join(out)


class SparseVectorWriter(PartWriter):
    """Part files of bounded row count: the count precedes the records."""

    suffix = ".data"

    def encode(self, batch: pa.RecordBatch) -> bytes:
        offsets, indices = _list_values(batch.column("indices"), "<i4")
        value_offsets, values = _list_values(batch.column("values"), "<f4")
        if (np.diff(offsets) != np.diff(value_offsets)).any():
            raise ValueError("indices and values differ in length")
        pairs = np.empty(2 * len(indices), dtype=INT)
        pairs[0::2], pairs[1::2] = indices, values.view(INT)
        doubled = 2 * (offsets.astype(np.int64) - offsets[0])
        body = _records(doubled, pairs)
        heads = doubled[:-1] + np.arange(batch.num_rows)
        body[heads] //= 2
        return body.tobytes()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> PartFiles:
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        filesystem, target = resolve(self.parts.path)
        filesystem.create_dir(target, recursive=True)
        moves, held, count = [], [], 0

        def flush() -> None:
            part = self.parts.new_part(partition, len(moves), self.suffix)
            moves.append(part)
            with filesystem.open_output_stream(part[0]) as handle:
                handle.write(np.array([count], INT).tobytes())
                handle.writelines(held)

        most = self.rows_per_file or SPARSE_ROWS_PER_FILE
        for whole in iterator:
            start = 0
            while start < whole.num_rows:
                batch = whole.slice(start, most - count)
                held.append(self.encode(batch))
                count, start = count + batch.num_rows, start + batch.num_rows
                if count == most:
                    flush()
                    held, count = [], 0
        if count:
            flush()
        return PartFiles(moves)


class FvecsSource(DataSource):
    """Float vectors: ``(pos, vec)`` in file order."""

    value_type, element = "<f4", "float"

    @classmethod
    def name(cls) -> str:
        return "fvecs"

    def schema(self) -> str:
        return f"pos bigint, vec array<{self.element}>"

    def reader(self, schema: StructType) -> VectorReader:
        return VectorReader(schema, self.options, self.value_type)

    def writer(self, schema: StructType, overwrite: bool) -> VectorWriter:
        return VectorWriter(self.options, overwrite, self.value_type)


class IvecsSource(FvecsSource):
    """Integer vectors, such as neighbour ids."""

    value_type, element = "<i4", "int"

    @classmethod
    def name(cls) -> str:
        return "ivecs"


class MultiVectorSource(DataSource):
    """Lists of token vectors: ``(pos, vecs)``."""

    @classmethod
    def name(cls) -> str:
        return "multivec"

    def schema(self) -> str:
        return "pos bigint, vecs array<array<float>>"

    def reader(self, schema: StructType) -> MultiVectorReader:
        return MultiVectorReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> MultiVectorWriter:
        return MultiVectorWriter(self.options, overwrite)


class SparseVectorSource(DataSource):
    """Sparse vectors: ``(pos, indices, values)``."""

    @classmethod
    def name(cls) -> str:
        return "sparsevec"

    def schema(self) -> str:
        return "pos bigint, indices array<int>, values array<float>"

    def reader(self, schema: StructType) -> SparseVectorReader:
        return SparseVectorReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> SparseVectorWriter:
        return SparseVectorWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the four formats known to the session."""
    for source in (FvecsSource, IvecsSource, MultiVectorSource, SparseVectorSource):
        spark.dataSource.register(source)
