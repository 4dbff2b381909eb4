"""Token files: ids of each document compressed on its own with one shared zstandard dictionary.

Documents are put in the order of their ids by a range shuffle of the texts. Each task encodes
its texts with the ``tokenizers`` library, ends every document with the end id, serialises the
ids as little-endian unsigned 32-bit integers and compresses each document as a frame of its own.
Because frames are short, they share a dictionary trained on serialised id arrays of
a bounded sample (``SAMPLE_DOCS`` documents of at most ``SAMPLE_CHARS`` characters; it changes sizes, never ids).

File: magic, SHA-256 of the dictionary, frames; then an offset index (document ids, offsets and numbers of ids,
deflated) and a trailer that says where the index starts. One document is read by three range reads. The manifest, a table
with a row per file, is the commit: files that it doesn't name belong to lost or repeated tasks and are never read.
"""

from __future__ import annotations

import hashlib
import os
import posixpath
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import SparkFiles, TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from gleaner.llm.bpe import _ship, byte_letters
from gleaner.plans.workspace import fresh_dir, stored
from gleaner.sources.files import resolve

MAGIC = b"TOKZ0001"
TRAILER = struct.Struct("<QQ8s")  # start of the index, documents, magic
END_ID = 2
FILE_BYTES = 256 << 20  # a file is closed once it holds as much
LEVEL = 3
DICTIONARY_BYTES = 64 << 10
SAMPLE_DOCS, SAMPLE_CHARS = 1000, 16_384
MEMO_PARTS = 400_000  # parts of texts a worker remembers; then it starts over
LONG_PART = 48  # characters; longer parts are encoded where they stand
MANIFEST = "part int, segment int, file string, dictionary string, first_id long, last_id long, n_docs long, n_ids long"
#: Words never reach over a single space between visible characters, so texts may be cut there.
CUT = re.compile(r"(?<=[\w!-~]) (?=[\w!-~])")
SAFE = re.compile(r"[\w!-~](?:[\s\S]*[\w!-~])?")


class Encoder:
    """The ids of whole texts that the library gives with a byte-level vocabulary, as bytes; parts between safe spaces are encoded once and remembered."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        special = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        # Bytes of text behind each id; in a byte-level vocabulary every letter of a piece stands for a byte.
        self.widths = np.array([len(special[i].encode()) if i in special else len(self.tokenizer.id_to_token(i) or "") for i in range(size)])
        self.memo: dict[str, bytes] = {}
        letters = byte_letters()
        self.letters, self.blank = {b: letters[b] for b in range(256)}, letters[0x20]
        self.marks = {m: self._plain([m])[0].tobytes() for m in ".,;:!?"}
        self.line = self._plain(["\n"])[0].tobytes()
        self.tokenize = self.tokenizer.model.tokenize

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes | None:
        """Ids of letters, with or without a closing mark, after a space (or at the start of a line, if a line break leads).

        Letters are one word of the pattern, so the library's model is asked directly. ``None`` for anything else.
        """
        found = self.memo.get(word)
        if found is None:
            mark = self.marks.get(word[-1:])
            if mark and word[-2:-1].isalpha():
                if (found := self._word(word[:-1])) is not None:
                    found += mark
            elif (bare := word.removeprefix("\n")).isalpha():
                shown = bare if bare.isascii() else bare.encode().decode("latin-1").translate(self.letters)
                found = array("I", [t.id for t in self.tokenize(self.blank + shown if bare is word else shown)]).tobytes()
            if found is not None:
                self.memo[word] = found
        return found

    def _learn(self, parts: Iterable[str]) -> None:
        """Remember parts with the space before them.

        Words, and two words with a line break between, are put together; the rest is encoded a
        thousand parts at once, as a running text whose ids are cut where the parts end.
        """
        memo, word, others = self.memo, self._word, []
        for part in parts:
            if word(part) is None:
                left, line, right = part.partition("\n")
                if line and (a := word(left)) is not None and (b := word(line + right)) is not None:
                    memo[part] = a + self.line + b
                else:
                    others.append(part)
        groups = [others[i : i + 1000] for i in range(0, len(others), 1000)]
        for group, ids in zip(groups, self._plain([" " + " ".join(g) for g in groups])):
            ends = np.cumsum([len(p.encode()) + 1 for p in group])
            stops = np.searchsorted(np.cumsum(self.widths[ids]), ends, side="left") + 1
            raw, at = ids.tobytes(), 0
            for part, stop in zip(group, (4 * stops).tolist()):
                memo[part] = raw[at:stop]
                at = stop

    def encode(self, texts: list[str]) -> list[bytes]:
        memo = self.memo
        if len(memo) > MEMO_PARTS:
            memo.clear()
        cut = [t.split(" ") for t in texts]
        new = set().union(*cut) - memo.keys()
        odd = {p for p in new if not SAFE.fullmatch(p)}
        if odd:  # such texts are cut at safe spaces only
            cut = [p if odd.isdisjoint(p) else CUT.split(t) for p, t in zip(cut, texts)]
            new = set().union(*cut) - memo.keys()
            odd = {p for p in new if not SAFE.fullmatch(p)}
        odd.update(p for p in new if len(p) > LONG_PART)
        self._learn(new - odd)
        # What begins a text has no space before it; long or odd parts aren't remembered.
        starts, rest = list({p[0] for p in cut}), list(odd)
        ids = self._plain(starts + [" " + p for p in rest])
        first, once = dict(zip(starts, (x.tobytes() for x in ids))), dict(zip(rest, (x.tobytes() for x in ids[len(starts) :])))
        memo.update(once)
        out = [b"".join([first[p[0]], *map(memo.__getitem__, p[1:])]) for p in cut]
        for part in once:
            del memo[part]
        return out


@lru_cache(maxsize=1)
def _encoder(vocabulary: str) -> Encoder:
    """One encoder a worker, from the file Spark has brought to its machine. Its tasks run one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    with open(SparkFiles.get(vocabulary), encoding="utf-8") as handle:
        return Encoder(handle.read())


def _slices(texts: pa.Array, most: int = 1 << 23) -> Iterator[tuple[int, list[str]]]:
    """Texts of a batch in runs of some megabytes, with the place of the first."""
    held, size, start = [], 0, 0
    for i, text in enumerate(texts):
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= most:
            yield start, held
            held, size, start = [], 0, i + 1
    if held:
        yield start, held


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for serialised id arrays; raw content where there is too little to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size] or bytes(8)


def _order(id_col: str, text_col: str) -> list[Column]:
    """Ascending ids, nulls first; equal ids by a hash of the text. The row number spreads copies of one row over tasks."""
    return [F.col(id_col).asc_nulls_first(), F.xxhash64(text_col).asc(), F.col("salt").asc()]


def write_tokens(
    docs: DataFrame, folder: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID
) -> DataFrame:
    """Write the ids of every whole text to files in ``folder``, in ascending order of the id; the manifest, written.

    ``vocabulary`` is the path of a ``tokenizers`` file. Null and empty texts consist of the end id alone. Null ids come first;
    equal ids stay separate documents, in the order of a hash of their texts. An empty table gives no
    files. Other columns, whatever their names, are not looked at. A long text is one frame.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as handle:
        shipped = _ship(spark, handle.read(), "token-vocabulary")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    end = np.array([end_id], dtype="<u4").tobytes()

    def ids_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shipped)
        for batch in batches:
            for _, texts in _slices(batch.column(0)):
                made = [raw + end for raw in encoder.encode(texts)]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["ids"])

    sample = rows.where(F.char_length("text") <= SAMPLE_CHARS).select("text", F.xxhash64(F.monotonically_increasing_id()).alias("h"))
    sample = sample.orderBy("h").limit(SAMPLE_DOCS).select("text").mapInArrow(ids_only, "ids binary")
    trained = train_dictionary(sorted(bytes(r.ids) for r in sample.collect()))
    digest = hashlib.sha256(trained).hexdigest()
    filesystem, target = resolve(folder)
    filesystem.create_dir(target, recursive=True)
    with filesystem.open_output_stream(posixpath.join(target, f"{digest}.dictionary"), compression=None) as out:
        out.write(trained)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, target = resolve(folder)
        encoder, part, segment, out = _encoder(shipped), TaskContext.get().partitionId(), 0, None
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained), write_content_size=True)
        for batch in batches:
            for start, texts in _slices(batch.column(1)):
                for key, raw in zip(batch.column(0)[start : start + len(texts)], encoder.encode(texts)):
                    if out is None:
                        out = _File(filesystem, target, digest)
                    out.add(key.as_py(), pack.compress(raw + end), len(raw) // 4 + 1)
                    if out.at >= FILE_BYTES:
                        yield out.close(part, segment)
                        out, segment = None, segment + 1
        if out is not None:
            yield out.close(part, segment)

    order = _order("id", "text")
    dealt = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(dealt.select("id", "text").mapInArrow(write, MANIFEST), "token-manifest")


class _File:
    """A file being written, under a name that no other attempt uses."""

    def __init__(self, filesystem, target: str, digest: str):
        self.name, self.digest = f"tokens-{uuid.uuid4().hex}.tokz", digest
        self.out = filesystem.open_output_stream(posixpath.join(target, self.name), compression=None)
        self.out.write(MAGIC + bytes.fromhex(digest))
        self.at = len(MAGIC) + 32
        self.ids, self.offsets, self.sizes = [], [self.at], []

    def add(self, key: int | None, frame: bytes, n_ids: int) -> None:
        self.out.write(frame)
        self.at += len(frame)
        self.ids.append(key)
        self.offsets.append(self.at)
        self.sizes.append(n_ids)

    def close(self, part: int, segment: int) -> pa.RecordBatch:
        known = np.array([k is not None for k in self.ids], dtype="u1")
        index = [known, np.array([k or 0 for k in self.ids], dtype="<i8"), np.array(self.offsets, dtype="<u8"), np.array(self.sizes, dtype="<u8")]
        self.out.write(zlib.compress(b"".join(a.tobytes() for a in index)))
        self.out.write(TRAILER.pack(self.at, len(self.ids), MAGIC))
        self.out.close()
        row = [part, segment, self.name, self.digest, self.ids[0], self.ids[-1], len(self.ids), int(sum(self.sizes))]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.string()] + [pa.int64()] * 4
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], [c.split()[0] for c in MANIFEST.split(", ")])


class TokenFile:
    """A file opened for reading: its offset index, and frames by range reads."""

    def __init__(self, filesystem, target: str, name: str, digest: str):
        self.handle = filesystem.open_input_file(posixpath.join(target, name))
        size = self.handle.size()
        start, n, magic = TRAILER.unpack(self.handle.read_at(TRAILER.size, size - TRAILER.size))
        head = self.handle.read_at(len(MAGIC) + 32, 0)
        if magic != MAGIC or head != MAGIC + bytes.fromhex(digest):
            raise ValueError(f"{name} is no token file, or was written with another dictionary")
        raw = zlib.decompress(self.handle.read_at(size - TRAILER.size - start, start))
        self.known = np.frombuffer(raw, "u1", n)
        self.ids = np.frombuffer(raw, "<i8", n, n)
        self.offsets = np.frombuffer(raw, "<u8", n + 1, 9 * n).astype(np.int64)
        self.sizes = np.frombuffer(raw, "<u8", n, 9 * n + 8 * (n + 1)).astype(np.int64)
        with filesystem.open_input_stream(posixpath.join(target, f"{digest}.dictionary"), compression=None) as source:
            trained = source.read()
        if hashlib.sha256(trained).hexdigest() != digest:
            raise ValueError("the dictionary has not the hash its name says")
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained))

    def documents(self, low: int, high: int) -> list[bytes]:
        """Serialised ids of documents ``low`` to ``high`` of the file, by one range read."""
        first = int(self.offsets[low])
        data = memoryview(self.handle.read_at(int(self.offsets[high]) - first, first))
        cuts = (self.offsets[low : high + 1] - first).tolist()
        made = [self.unpack.decompress(data[a:b]) for a, b in zip(cuts, cuts[1:])]
        if [len(x) // 4 for x in made] != self.sizes[low:high].tolist():
            raise ValueError("a document has not as many ids as the index says")
        return made


def _rows(file: TokenFile, low: int, high: int, start: int, with_ids: bool) -> pa.RecordBatch:
    made = file.documents(low, high)
    sizes = file.sizes[low:high]
    arrays = [
        pa.array(file.ids[low:high], pa.int64(), mask=file.known[low:high] == 0),
        pa.array(start + np.cumsum(sizes) - sizes, pa.int64()),
        pa.array(sizes, pa.int64()),
        pa.array([zlib.crc32(x) for x in made], pa.int64()),
    ]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    if with_ids:
        flat = np.frombuffer(b"".join(made), "<u4").astype(np.int64)
        arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat)))
        names.append("ids")
    return pa.RecordBatch.from_arrays(arrays, names)


def read_tokens(manifest: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` of all documents, from the files; each file is a task.

    ``start`` counts the ids of all documents before this one. Lengths and the dictionary's hash are checked.
    """
    # One row per file of up to FILE_BYTES: the running sum is over some ten rows per terabyte of ids.
    before = Window.orderBy("part", "segment").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", "dictionary", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, target = resolve(folder)
        for batch in batches:
            for row in batch.to_pylist():
                file, start, low = TokenFile(filesystem, target, row["file"], row["dictionary"]), row["start"], 0
                cuts = np.cumsum(file.sizes)
                while low < len(file.sizes):
                    # Some million ids at once, one document at least.
                    done = int(cuts[low - 1]) if low else 0
                    high = max(low + 1, int(np.searchsorted(cuts, done + (1 << 21), side="right")))
                    yield _rows(file, low, high, start + done, with_ids)
                    low = high

    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return files.repartition(max(1, manifest.count())).mapInArrow(run, kinds)


def lookup(manifest: DataFrame, folder: str, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of the asked documents: only files whose id range holds one are opened, only its frame is read.

    Unknown and null ids give nothing; an id that several documents have gives all of them.
    """
    asked = ids.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    near = asked.join(manifest, F.col("doc_id").between(F.coalesce("first_id", F.lit(-(1 << 63))), F.col("last_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, target = resolve(folder)
        name, file = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != name:
                    name, file = row["file"], TokenFile(filesystem, target, row["file"], row["dictionary"])
                nulls = int((file.known == 0).sum())  # they come first
                low, high = (nulls + int(np.searchsorted(file.ids[nulls:], row["doc_id"], side)) for side in ("left", "right"))
                for at in range(low, high):
                    yield _rows(file, at, at + 1, 0, True).select(["doc_id", "n_tokens", "ids"])

    near = near.select("doc_id", "file", "dictionary").repartition("file").sortWithinPartitions("file", "doc_id")
    return near.mapInArrow(run, "doc_id long, n_tokens long, ids array<long>")


def token_folder(docs: DataFrame) -> str:
    """A new folder for token files below the shared one."""
    return fresh_dir(docs.sparkSession, "tokens")
