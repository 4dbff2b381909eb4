"""Byte-level BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The vocabulary file (its path is a parameter) gives pieces, merges and special tokens. Texts are cut by
the file's pattern into words. The most frequent words of the corpus, counted over
all documents, are compiled together with their token ids into a minimal acyclic
automaton: words with equal endings share states, and each arc adds to the number of
the word it spells, which leads to its ids (a perfect hash). Words outside of it are
merged exactly, so the lexicon's size changes the speed of a run and never its result.

Lexicon and vocabulary are flat files that workers map into memory, so all workers of a machine share their
pages. A worker remembers nothing between slices of about ``SLICE_CHARS`` characters: the different words of a slice walk the
automaton together, an arc at a time, and the rest of them is merged together, a pair a word at a time.

Null texts are encoded like empty ones, repeated rows each for themselves. A very long text is a slice of its own and is encoded
whole; words of more than ``SHORT_WORD`` bytes are merged with a heap.
"""

from __future__ import annotations

import json
import mmap
import os
import re
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.plans.workspace import fresh_dir, stored

#: Fixed value: the pattern of this kind of tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Its letters, numbers and blanks among the first 256 characters, for a faster machine.
LATIN = {r"\p{L}": "A-Za-zªµºÀ-ÖØ-öø-ÿ", r"\p{N}": "0-9²³¹¼-¾", r"\s": "\\t-\\r \\x85\\xa0"}

LEXICON_WORDS = 100_000
COUNTED_WORDS = 300_000  # different words a task counts before it hands its counts on
CLASSES = 16  # of frequencies, per factor of e
SHORT_WORD = 48  # bytes; longer words are merged with a heap
SLICE_CHARS = 1 << 20
BITS, NO_JOIN = 20, 1 << 60  # ids have fewer bits
LOW_BITS = (1 << BITS) - 1
LONG_WORD = 256  # characters; longer words are not counted


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary file: printable ones for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _latin_pattern() -> re.Pattern[str]:
    """The pattern for texts of the first 256 characters."""
    letters, numbers, blanks = LATIN.values()
    return re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{blanks}{letters}{numbers}]+|[{blanks}]+(?![^{blanks}])|[{blanks}]+"
    )


class Cutter:
    """Cuts texts into special tokens and words of the pattern."""

    def __init__(self, special: dict[str, int]):
        self.special = special
        words = sorted(special, key=len, reverse=True)
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, words)) + ")") if words else None
        self.any = regex.compile(PATTERN).findall
        self.latin = _latin_pattern().findall

    def segments(self, text: str) -> tuple[str, ...] | list[str]:
        """Text between special tokens, and the special tokens themselves."""
        if self.cut_special is None or not any(s in text for s in self.special):
            return (text,)
        return self.cut_special.split(text)

    def words(self, segment: str) -> list[str]:
        try:
            segment.encode("latin-1")
        except UnicodeEncodeError:
            return self.any(segment)
        return self.latin(segment)


def pack(tables: dict[str, np.ndarray], **more) -> bytes:
    """Arrays, and small values that JSON can hold, as one flat file."""
    at, places = 0, {}
    for name, table in tables.items():
        places[name] = [table.dtype.str, at, len(table)]
        at += -(-table.nbytes // 8) * 8
    head = json.dumps({"tables": places, **more}).encode()
    head += b" " * (-len(head) % 8)
    body = (t.tobytes() + b"\0" * (-t.nbytes % 8) for t in tables.values())
    return len(head).to_bytes(8, "little") + head + b"".join(body)


def unpack(path: str | None = None, data: bytes | None = None) -> tuple[dict[str, np.ndarray], dict]:
    """The arrays and values of a flat file, which is mapped, not read."""
    if data is None:
        with open(path, "rb") as handle:
            data = mmap.mmap(handle.fileno(), 0, access=mmap.ACCESS_READ)
    size = int.from_bytes(data[:8], "little")
    head = json.loads(data[8 : 8 + size])
    tables = {name: np.frombuffer(data, kind, n, 8 + size + at) for name, (kind, at, n) in head.pop("tables").items()}
    return tables, head


class Places:
    """Places of distinct keys (not negative), found for whole arrays of keys by open addressing."""

    STEP = 0x9E3779B97F4A7C15

    def __init__(self, keys: np.ndarray, at: np.ndarray):
        self.keys, self.at = keys, at
        self.shift, self.last = 65 - len(keys).bit_length(), len(keys) - 1

    @classmethod
    def tables(cls, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Key and place per slot, at most half of them taken."""
        size = 1 << max(2, (2 * len(keys)).bit_length())
        slots, at = np.full(size, -1, "<i8"), np.full(size, -1, "<i4")
        own = cls(slots, at)
        todo = np.arange(len(keys))
        slot = own._slots(keys)
        while len(todo):
            free = np.flatnonzero(slots[slot] == -1)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            slots[slot[won]], at[slot[won]] = keys[todo[won]], todo[won]
            left = np.ones(len(todo), bool)
            left[won] = False
            todo, slot = todo[left], (slot[left] + 1) & own.last
        return slots, at

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(self.STEP)) >> np.uint64(self.shift)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for others."""
        slot = self._slots(keys)
        held, out = self.keys[slot], self.at[slot]
        left = np.flatnonzero((held != keys) & (held != -1))
        while len(left):
            slot[left] = (slot[left] + 1) & self.last
            held, out[left] = self.keys[slot[left]], self.at[slot[left]]
            left = left[(held != keys[left]) & (held != -1)]
        return out

    def one(self, key: int) -> int:
        slot = (key * self.STEP & (1 << 64) - 1) >> self.shift
        while (held := self.keys[slot]) != key and held != -1:
            slot = (slot + 1) & self.last
        return int(self.at[slot])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers ``start, start + 1, ...`` of all runs, one run after the other."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


def compile_vocabulary(text: str) -> bytes:
    """Merges, pieces and special tokens of a byte-level BPE file as flat tables."""
    spec = json.loads(text)
    model = spec["model"]
    to_byte = {c: b for b, c in byte_letters().items()}
    ids = {bytes(to_byte[c] for c in piece): i for piece, i in model["vocab"].items() if all(c in to_byte for c in piece)}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    joins = {}  # pairs of ids as one number -> rank and id of the merged piece as one number
    for rank, merge in enumerate(model["merges"]):
        a, b = (bytes(to_byte[c] for c in part) for part in (merge if isinstance(merge, list) else merge.split(" ")))
        joins[ids[a] << BITS | ids[b]] = rank << BITS | ids[a + b]
    pieces = {i: piece for piece, i in ids.items()} | {i: s.encode() for s, i in special.items()}
    ordered = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
    slots, at = Places.tables(np.fromiter(joins, "<i8", len(joins)))
    tables = {
        "byte_ids": np.asarray([ids[bytes([b])] for b in range(256)], "<i8"),
        "slots": slots, "at": at, "joins": np.fromiter(joins.values(), "<i8", len(joins)),
        "starts": np.cumsum([0, *map(len, ordered)]).astype("<i8"), "pieces": np.frombuffer(b"".join(ordered), np.uint8),
    }
    return pack(tables, special=special)


class Vocabulary:
    """Pieces, merges and special tokens, mapped from a compiled file."""

    def __init__(self, path: str | None = None, data: bytes | None = None):
        tables, head = unpack(path, data)
        self.byte_ids, self.joins = tables["byte_ids"], tables["joins"]
        self.places = Places(tables["slots"], tables["at"])
        self.starts, self.pieces = tables["starts"], tables["pieces"]
        self.special: dict[str, int] = head["special"]

    def _joins(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at = self.places.find((left << BITS | right).ravel())
        return np.where(at >= 0, self.joins[at], NO_JOIN).reshape(left.shape)

    def merge(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all given words one after the other, and their number per word: in each
        word the neighbouring pair of lowest rank is merged, leftmost first, until none is left.
        """
        out = np.zeros((len(starts), SHORT_WORD), np.int32)
        sizes = np.zeros(len(starts), np.int64)
        for n in np.unique(lengths[lengths <= SHORT_WORD]):
            rows = np.flatnonzero(lengths == n)
            ids = self.byte_ids[data[starts[rows, None] + np.arange(n)]]
            joins = self._joins(ids[:, :-1], ids[:, 1:])
            # Every word here has the same number of parts, and loses one a round or is done.
            while len(rows):
                best = joins.min(1, initial=NO_JOIN)
                done = best == NO_JOIN
                if done.any():
                    out[rows[done], : ids.shape[1]], sizes[rows[done]] = ids[done], ids.shape[1]
                    rows, ids, joins, best = rows[~done], ids[~done], joins[~done], best[~done]
                    if not len(rows):
                        break
                every, at = np.arange(len(rows)), joins.argmin(1)
                ids[every, at] = best & LOW_BITS
                keep = np.ones(ids.shape, bool)
                keep[every, at + 1] = False
                ids = ids[keep].reshape(len(rows), -1)
                keep = np.ones(joins.shape, bool)
                keep[every, at] = False
                joins = joins[keep].reshape(len(rows), -1)
                some = np.flatnonzero(at < joins.shape[1])
                joins[some, at[some]] = self._joins(ids[some, at[some]], ids[some, at[some] + 1])
                some = np.flatnonzero(at > 0)
                joins[some, at[some] - 1] = self._joins(ids[some, at[some] - 1], ids[some, at[some]])
        flat = out[np.arange(SHORT_WORD) < sizes[:, None]]
        long = np.flatnonzero(lengths > SHORT_WORD)
        if not len(long):
            return flat, sizes
        made = [self.merge_long(data[starts[i] : starts[i] + lengths[i]]) for i in long]
        places = np.cumsum(sizes) - sizes  # of short words in ``flat``; long ones follow at its end
        sizes[long] = [len(ids) for ids in made]
        places[long] = len(flat) + np.cumsum(sizes[long]) - sizes[long]
        flat = np.concatenate([flat, np.fromiter(chain.from_iterable(made), np.int32)])
        return flat[ragged(places, sizes)], sizes

    def merge_long(self, word: np.ndarray) -> list[int]:
        """The same for one word with pairs in a heap by (rank, place) and parts as a linked list: a word of
        any length costs its length times a logarithm.
        """
        first = self.byte_ids[word]
        ids: list[int] = first.tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        joins, find = self.joins, self.places.one
        begun = self._joins(first[:-1], first[1:])
        some = np.flatnonzero(begun != NO_JOIN)
        heap = [(int(begun[i]), int(i), ids[i], ids[i + 1]) for i in some]
        heapify(heap)

        def push(i: int, j: int) -> None:
            if (at := find(ids[i] << BITS | ids[j])) >= 0:
                heappush(heap, (int(joins[at]), i, ids[i], ids[j]))

        while heap:
            best, i, left, right = heappop(heap)
            j = after[i]
            if ids[i] != left or j >= len(ids) or ids[j] != right:
                continue  # one of the two was merged meanwhile
            ids[i], ids[j] = best & LOW_BITS, -1
            after[i] = k = after[j]
            if k < len(ids):
                before[k] = i
                push(i, k)
            if before[i] >= 0:
                push(before[i], i)
        return [i for i in ids if i >= 0]


def compile_lexicon(entries: list[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The minimal acyclic automaton of distinct words with their ids, as one flat file.

    Built from sorted words; a state is frozen once no later word can pass it, and
    equal frozen states become one. Per arc its state and byte, a target, and the words
    that come before it in the state; per word (in sorted order) its ids.
    """
    entries = sorted(entries)
    frozen: dict[tuple, int] = {}
    states: list[tuple] = []  # (ends here, ((byte, target), ...))
    counts: list[int] = []  # words from a state on
    path: list[list] = [[False, []]]  # the states of the last word, not frozen yet
    last = b""

    def freeze(down_to: int) -> None:
        while len(path) - 1 > down_to:
            ends, arcs = path.pop()
            key = (ends, tuple(arcs))
            if key not in frozen:
                frozen[key] = len(states)
                states.append(key)
                counts.append(ends + sum(counts[t] for _, t in arcs))
            path[-1][1][-1] = (path[-1][1][-1][0], frozen[key])

    for word, _ in entries:
        shared = len(os.path.commonprefix([word, last]))
        freeze(shared)
        for byte in word[shared:]:
            path[-1][1].append((byte, -1))
            path.append([False, []])
        path[-1][0] = True
        last = word
    freeze(0)
    states.append((path[0][0], tuple(path[0][1])))

    arc, target, skip = [], [], []
    for state, (ends, arcs) in enumerate(states):
        passed = int(ends)
        for b, t in arcs:
            arc.append(state << 8 | b)
            target.append(t)
            skip.append(passed)
            passed += counts[t]
    slots, at = Places.tables(np.asarray(arc, "<i8"))
    tables = {
        "slots": slots, "at": at, "target": np.asarray(target, "<i4"), "skip": np.asarray(skip, "<i4"),
        "final": np.asarray([ends for ends, _ in states], bool), "starts": np.cumsum([0] + [len(ids) for _, ids in entries]).astype("<i8"),
        "ids": np.fromiter(chain.from_iterable(ids for _, ids in entries), "<i4"),
    }
    return pack(tables)


class Lexicon:
    """A compiled automaton, mapped from its file."""

    def __init__(self, path: str | None = None, data: bytes | None = None):
        tables, _ = unpack(path, data)
        self.arcs = Places(tables["slots"], tables["at"])
        self.target, self.skip, self.final = tables["target"], tables["skip"], tables["final"]
        self.starts, self.ids = tables["starts"], tables["ids"]
        self.root = len(self.final) - 1

    def find(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for those not in the lexicon; all words take an arc at a time."""
        out = np.full(len(starts), -1)
        walking = np.arange(len(starts))
        state, number, step = np.full(len(starts), self.root), np.zeros(len(starts), np.int64), 0
        while len(walking):
            at_end = lengths[walking] == step
            here = at_end & self.final[state]
            out[walking[here]] = number[here]
            walking, state, number = walking[~at_end], state[~at_end], number[~at_end]
            arc = self.arcs.find(state << 8 | data[starts[walking] + step])
            on = arc >= 0
            walking, arc = walking[on], arc[on]
            state, number, step = self.target[arc].astype(np.int64), number[on] + self.skip[arc], step + 1
        return out

    def get(self, word: bytes) -> tuple[int, ...] | None:
        """Ids of ``word``, or ``None`` if it isn't in the lexicon."""
        number = self.find(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0]
        return None if number < 0 else tuple(self.ids[self.starts[number] : self.starts[number + 1]].tolist())


class Codec:
    """Encodes and decodes slices of texts; it remembers nothing between them."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.cutter = Cutter(vocabulary.special)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts one after the other, and where each text's begin (one more at the end)."""
        words: list[str] = []
        ends, special = [0], []  # special: place among the words, id
        for text in texts:
            for segment in self.cutter.segments(text or ""):
                if (token := self.cutter.special.get(segment)) is not None:
                    special.append((len(words), token))
                    words.append("")
                else:
                    words += self.cutter.words(segment)
            ends.append(len(words))
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        del words
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pool, starts, sizes = self._ids(coded.dictionary)
        if special:
            places, tokens = np.array(special).T
            which[places] = len(starts) + np.arange(len(places))
            starts = np.concatenate([starts, len(pool) + np.arange(len(places))])
            sizes = np.concatenate([sizes, np.ones(len(places), np.int64)])
            pool = np.concatenate([pool, tokens.astype(np.int32)])
        lengths = sizes[which]
        bounds = np.concatenate([[0], np.cumsum(lengths)])[ends]
        return pool[ragged(starts[which], lengths)], bounds

    def _ids(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words: a pool of ids, and where each word's begin and how many they are."""
        _, offsets, data = words.buffers()
        offsets = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
        starts, lengths = offsets[:-1], np.diff(offsets)
        number = self.lexicon.find(data, starts, lengths)
        known, new = np.flatnonzero(number >= 0), np.flatnonzero(number < 0)
        begin, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        first = self.lexicon.starts[number[known]]
        sizes[known] = self.lexicon.starts[number[known] + 1] - first
        held = self.lexicon.ids[ragged(first, sizes[known])]
        merged, sizes[new] = self.vocabulary.merge(data, starts[new], lengths[new])
        begin[known] = np.cumsum(sizes[known]) - sizes[known]
        begin[new] = len(held) + np.cumsum(sizes[new]) - sizes[new]
        return np.concatenate([held, merged]), begin, sizes

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The text of each run of ids; an id that the vocabulary doesn't have stands for nothing."""
        first = self.vocabulary.starts
        ids = np.where((ids >= 0) & (ids < len(first) - 1), ids, -1)
        lengths = np.where(ids >= 0, first[ids + 1] - first[np.maximum(ids, 0)], 0)
        data = self.vocabulary.pieces[ragged(first[np.maximum(ids, 0)], lengths)].tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])[bounds].tolist()
        return [data[a:b].decode("utf-8", errors="replace") for a, b in zip(ends, ends[1:])]


@lru_cache(maxsize=1)
def _codec(vocabulary: str, lexicon: str) -> Codec:
    """One codec a worker; files are the ones Spark has brought to its machine."""
    return Codec(Vocabulary(SparkFiles.get(vocabulary)), Lexicon(SparkFiles.get(lexicon)))


def _ship(spark: SparkSession, data: bytes, label: str) -> str:
    """Write ``data`` to the shared folder and have Spark bring it to every worker; its name there."""
    name = f"{label}-{uuid.uuid4().hex}"
    path = f"{fresh_dir(spark, label)}/{name}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(path)
    return name


def frequent_words(docs: DataFrame, text_col: str, special: dict[str, int], n: int) -> list[str]:
    """At most ``n`` words, the most frequent ones over all whole texts.

    Tasks count many texts before anything is shuffled. Words are taken by classes of like frequency as long as a whole
    class fits, so only the sizes of some hundred classes and the words taken reach the driver, however many tasks there are.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        cutter = Cutter(special)
        total: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                for segment in cutter.segments(text.as_py() or ""):
                    if segment not in special:
                        total.update(cutter.words(segment))
                if len(total) > COUNTED_WORDS:
                    yield _counts(total)
                    total.clear()
        yield _counts(total)

    rows = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(count, "word string, n long").where(F.length("word") <= LONG_WORD)
    words = rows.groupBy("word").agg(F.sum("n").alias("n"))
    words = stored(words.select("word", F.floor(F.log("n") * CLASSES).cast("int").alias("class")), "bpe-words")
    taken, least = 0, None
    for r in words.groupBy("class").count().orderBy(F.desc("class")).collect():
        taken += r["count"]
        if taken > n:
            break
        least = r["class"]
    return [] if least is None else [r.word for r in words.where(F.col("class") >= least).select("word").collect()]


def _counts(total: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])


def prepare(docs: DataFrame, path: str, text_col: str = "text", words: int = LEXICON_WORDS) -> tuple[str, str]:
    """Names of the shipped vocabulary and of the lexicon compiled for ``docs``."""
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as handle:
        raw = compile_vocabulary(handle.read())
    loaded = Vocabulary(data=raw)
    known = [w.encode() for w in frequent_words(docs, text_col, loaded.special, words)]
    lengths = np.array([len(w) for w in known], np.int64)
    ids, sizes = loaded.merge(np.frombuffer(b"".join(known), np.uint8), np.cumsum(lengths) - lengths, lengths)
    ends = np.cumsum(sizes).tolist()
    made = ids.tolist()
    entries = [(w, tuple(made[a:b])) for w, a, b in zip(known, [0, *ends], ends)]
    return _ship(spark, raw, "bpe-vocabulary"), _ship(spark, compile_lexicon(entries), "bpe-lexicon")


def _encoded(codec: Codec, column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    ids, bounds = codec.encode(column.to_pylist())
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())), ids, bounds


def encode(docs: DataFrame, files: tuple[str, str], text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col array<int>``: the token ids of each whole text, empty for null and empty texts.

    Special tokens written out in a text get their ids. All rows and columns stay; a column named like the result is replaced.
    """
    return _mapped(docs, files, text_col, {ids_col: "array<int>"}, lambda codec, column: [_encoded(codec, column)[0]])


def decode(rows: DataFrame, files: tuple[str, str], ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with ``text_col``: the text of the token ids, special tokens included; empty for null.

    Ids that are null or not in the vocabulary stand for nothing. All rows and columns stay; a column named like the result is replaced.
    """

    def run(codec: Codec, column: pa.Array) -> list[pa.Array]:
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        ids = pc.fill_null(column.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        return [pa.array(codec.decode(ids, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])), pa.string())]

    return _mapped(rows, files, ids_col, {text_col: "string"}, run)


def round_trip(docs: DataFrame, files: tuple[str, str], text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``encode`` and then ``decode`` of its ids in one pass over the texts."""

    def run(codec: Codec, column: pa.Array) -> list[pa.Array]:
        made, ids, bounds = _encoded(codec, column)
        return [made, pa.array(codec.decode(ids.astype(np.int64), bounds), pa.string())]

    return _mapped(docs, files, text_col, {ids_col: "array<int>", decoded_col: "string"}, run)


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """``(start, rows)`` of runs of rows with about ``SLICE_CHARS`` characters or ids; more only for one longer row."""
    size = pc.list_value_length if pa.types.is_list(column.type) else pc.binary_length
    ends = np.cumsum(pc.fill_null(size(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(column):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_CHARS, side="right")))
        yield start, stop - start
        start = stop


def _mapped(rows: DataFrame, files: tuple[str, str], from_col: str, made: dict[str, str], work: Callable[[Codec, pa.Array], list[pa.Array]]) -> DataFrame:
    rest = [c for c in rows.columns if c not in made]
    given = rows.select(F.col(f"`{from_col}`").alias("given"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("rest"))
    kind = given.schema["rest"].dataType.simpleString()
    names = [f"made{i}" for i in range(len(made))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*files)
        for batch in batches:
            for start, n in _slices(batch.column(0)):
                part = batch.slice(start, n)
                yield pa.RecordBatch.from_arrays([*work(codec, part.column(0)), part.column(1)], [*names, "rest"])

    out = given.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, made.values())) + f", rest {kind}")
    return out.select(*[F.col(f"rest.`{c}`") for c in rest], *[F.col(n).alias(c) for n, c in zip(names, made)])
