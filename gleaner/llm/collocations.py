"""Phrase collocations from an FM-index per shard over word ids.

Tasks cut their texts into pieces and words and lay them down as shards: word numbers in text
order, with separators between pieces. Words that are frequent in their language get an id for the whole
corpus; in each shard all others become separators, because no frequent phrase holds them. The Burrows-Wheeler
transform of some shards and that of their reversal, sorted as deep as phrases are long, make a
bidirectional index: an interval of the first extends to the left, one of the second to the right.

Phrases grow by a word at a time. Each index extends the intervals of the phrases that are frequent in the
whole corpus and whose last words are frequent too, a sum over the indexes tells which of the longer ones are,
and these go back to the indexes that have them. So phrases that can't count any more are never listed, and a phrase
is one row an index however often it occurs.
"""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from gleaner.llm.sides import checked_broadcast
from gleaner.plans.workspace import fresh_dir, stored
from gleaner.sources.files import resolve

MIN_COUNT = 30
LONGEST = 4  # words of a phrase
BEST = 2000  # phrases reported a language
SHARE = 80  # percent of a phrase's occurrences inside a longer one that make it redundant
SCALE = 2_000_000
NO_LANGUAGE = "und"
SHARD_WORDS = 2_000_000
INDEX_WORDS = 6_000_000  # at most, of the shards that share an index, but for the last one
BLOCK = 1 << 20  # occurrences looked at together
#: Characters that end a piece, and blanks between words.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_FROM = bytes(range(65, 91)) + PIECE_ENDS + b"\t"
_TO = bytes(range(97, 123)) + b"\n" * len(PIECE_ENDS) + b" "
PLAIN = bytes.maketrans(_FROM, _TO)
WORDS = "shard long, lang string, word string, local int, n long"


class _Numbers(dict):
    """Numbers of words in a shard, given out as they come. Number 0 separates pieces; nothing is no word."""

    def __init__(self, given: list):
        super().__init__({b"": -1, b"\n": 0})
        self.given = given

    def __missing__(self, word: bytes) -> int:
        self.given.append(word)
        self[word] = number = len(self.given)
        return number


class _Shard:
    """Word numbers of texts, gathered in one task; words of different languages have different numbers."""

    def __init__(self):
        self.words: list[bytes] = []
        self.numbers: dict[str, _Numbers] = {}
        self.langs: list[tuple[str, int]] = []  # language and first number of each run of new words
        self.runs: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, parts: list[bytes]) -> None:
        before = len(self.words)
        numbers = self.numbers.get(lang)
        if numbers is None:
            numbers = self.numbers[lang] = _Numbers(self.words)
        run = np.fromiter(map(numbers.__getitem__, parts), np.int32, len(parts))
        self.runs += [run[run >= 0], np.zeros(1, np.int32)]
        self.size += len(run)
        if len(self.words) > before:
            self.langs.append((lang, before))

    def close(self, filesystem, target: str) -> Iterator[pa.RecordBatch]:
        name = int.from_bytes(os.urandom(8), "little") >> 1
        text = np.concatenate([np.zeros(1, np.int32), *self.runs])
        _save(filesystem, target, f"{name}.text", [text])
        counts = np.bincount(text, minlength=len(self.words) + 1)[1:]
        starts = [first for _, first in self.langs] + [len(self.words)]
        for (lang, first), last in zip(self.langs, starts[1:]):
            for at in range(first, last, 50_000):
                end = min(last, at + 50_000)
                columns = [
                    pa.array([name] * (end - at), pa.int64()),
                    pa.array([lang] * (end - at), pa.string()),
                    pa.array([w.decode("utf-8", "replace") for w in self.words[at:end]], pa.string()),
                    pa.array(np.arange(at + 1, end + 1, dtype=np.int32)),
                    pa.array(counts[at:end], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "lang", "word", "local", "n"])


def _save(filesystem, target: str, name: str, arrays: list[np.ndarray]) -> None:
    """Arrays in one file that appears complete or not at all; a repeated task writes the same again."""
    data = b"".join(np.int64(len(a)).tobytes() + a.dtype.str.encode().ljust(8) + a.tobytes() for a in arrays)
    hidden = posixpath.join(target, f".{name}.{os.urandom(6).hex()}")
    with filesystem.open_output_stream(hidden, compression=None) as out:
        out.write(zstandard.compress(data, 1))
    filesystem.move(hidden, posixpath.join(target, name))


def _load(filesystem, target: str, name: str) -> list[np.ndarray]:
    with filesystem.open_input_stream(posixpath.join(target, name), compression=None) as source:
        data, at, out = zstandard.decompress(source.read()), 0, []
    while at < len(data):
        n, kind = int(np.frombuffer(data, np.int64, 1, at)[0]), np.dtype(data[at + 8 : at + 16].decode().strip())
        out.append(np.frombuffer(data, kind, n, at + 16))
        at += 16 + n * kind.itemsize
    return out


def write_shards(docs: DataFrame, folder: str, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Lay the texts down as shards in ``folder``; ``(shard, lang, word, local, n)``: the words of each shard, written.

    A shard ends with the piece that fills it. Only shards of the returned table count.
    """
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang")
    rows = docs.select(lang, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, target = resolve(folder)
        filesystem.create_dir(target, recursive=True)
        shard = _Shard()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), pc.cast(batch.column(1), pa.binary())):
                parts = text.as_py().translate(PLAIN).replace(b"\n", b" \n ").split(b" ")
                at = 0
                while at < len(parts):
                    try:
                        end = parts.index(b"\n", at + SHARD_WORDS) if len(parts) - at > SHARD_WORDS else len(parts)
                    except ValueError:
                        end = len(parts)
                    shard.add(lang, parts[at:end] if at or end < len(parts) else parts)
                    at = end
                    if shard.size >= SHARD_WORDS:
                        yield from shard.close(filesystem, target)
                        shard = _Shard()
        if shard.words:
            yield from shard.close(filesystem, target)

    return stored(rows.mapInArrow(run, WORDS), "phrase-words")


def _sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the ``depth`` symbols from there on (around the end); prefixes double from pass to pass."""
    rank, have = text, 1
    while True:
        key = rank.astype(np.int64)
        key *= int(rank.max()) + 1
        key += np.roll(rank, -have)
        order, have = np.argsort(key), 2 * have
        if have >= depth:
            return order
        key = key[order]
        rank = np.zeros(len(text), np.int32)
        rank[order[1:]] = np.cumsum(key[1:] != key[:-1], dtype=np.int32)


class Transform:
    """The Burrows-Wheeler transform of a text with ranks: intervals are extended by a symbol before them."""

    def __init__(self, bwt: np.ndarray, symbols: int):
        self.bwt, self.n = bwt, len(bwt)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=symbols))])  # smaller symbols in the text
        order = np.argsort(bwt, kind="stable")
        self.places = bwt[order].astype(np.int64) * self.n + order

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where an interval's bound goes when ``symbol`` is set before its pattern."""
        return np.searchsorted(self.places, symbol.astype(np.int64) * self.n + at)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the rows of ``patterns``, read from their last symbol to the first."""
        low, high = self.before[patterns[:, -1]], self.before[patterns[:, -1] + 1]
        for column in range(patterns.shape[1] - 2, -1, -1):
            low, high = self.step(patterns[:, column], low), self.step(patterns[:, column], high)
        return low, high

    def extensions(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(pattern, symbol, count)`` of all words that stand before the patterns' occurrences."""
        ends = np.cumsum(high - low)
        blocks = np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, BLOCK))
        blocks = np.unique([0, *blocks, len(low)])
        found = [self._extensions(low[a:b], high[a:b], a) for a, b in zip(blocks, blocks[1:])]
        return tuple(map(np.concatenate, zip(*found))) if found else (np.zeros(0, np.int64),) * 3

    def _extensions(self, low: np.ndarray, high: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = high - low
        owner = np.repeat(np.arange(len(low)), size)
        places = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
        symbol = self.bwt[places]
        symbols = len(self.before) - 1
        key, count = np.unique((owner * symbols + symbol)[symbol > 0], return_counts=True)
        return key // symbols + first, key % symbols, count


@dataclass
class Index:
    """Both transforms of a text, and the corpus-wide ids of its symbols 1, 2, …, ascending."""

    ids: np.ndarray
    left: Transform
    right: Transform

    @classmethod
    def build(cls, text: np.ndarray, ids: np.ndarray, depth: int) -> tuple[Index, list[np.ndarray]]:
        arrays = [ids]
        for side in (text, text[::-1]):
            arrays.append(side[_sorted_suffixes(side, depth) - 1].astype(np.int32))
        return cls.opened(arrays), arrays

    @classmethod
    def opened(cls, arrays: list[np.ndarray]) -> Index:
        ids, left, right = arrays
        return cls(ids, Transform(left, len(ids) + 1), Transform(right, len(ids) + 1))

    def extend(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases longer by a word on the right, with their counts, if their last words are among ``phrases`` too.

        ``phrases`` holds symbols, a row each. All phrases of a length extend alike: from the
        reversed transform, where a phrase reads from right to left.
        """
        low, high = self.right.search(phrases[:, ::-1])
        owner, symbol, count = self.right.extensions(low, high)
        if phrases.shape[1] > 1:
            parts = np.concatenate([phrases[:, 1:], phrases[:, :-1]])
            kinds = np.unique(parts, axis=0, return_inverse=True)[1].reshape(-1)
            ends, begins = kinds[: len(phrases)], kinds[len(phrases) :]
            symbols = len(self.ids) + 1
            known = np.isin(ends[owner] * symbols + symbol, begins * symbols + phrases[:, -1])
            owner, symbol, count = owner[known], symbol[known], count[known]
        return np.column_stack([phrases[owner], symbol]), count

    def neighbours(self, phrases: np.ndarray) -> tuple[tuple, tuple]:
        """``(phrase, symbol, count)`` of the words left and right of each phrase's occurrences."""
        return self.left.extensions(*self.left.search(phrases)), self.right.extensions(*self.right.search(phrases[:, ::-1]))


def _keys(n: int) -> list[str]:
    return [f"w{i}" for i in range(1, n + 1)]


def _found(number: int, index: Index, phrases: np.ndarray, count: np.ndarray) -> pa.Table:
    columns = [pa.array(index.ids[phrases[:, i] - 1], pa.int64()) for i in range(phrases.shape[1])]
    columns += [pa.array(np.full(len(count), number), pa.int64()), pa.array(count, pa.int64())]
    return pa.Table.from_arrays(columns, [*_keys(phrases.shape[1]), "index", "n"])


def _schema(n: int) -> str:
    return ", ".join(f"{c} long" for c in [*_keys(n), "index", "n"])


def _frequent(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows of phrases that all indexes together hold often enough, with that sum; written. A phrase has a row an index."""
    total = F.sum("n").over(Window.partitionBy(*keys))
    return stored(rows.withColumn("f", total).where(F.col("f") >= least).select(*keys, "index", "f"), "phrase-level")


def _groups(shards: DataFrame) -> DataFrame:
    """``(shard, index)``: the shards that share an index, packed by size; a row a shard.

    An index holds up to ``INDEX_WORDS`` words, and less where the table has too few words to keep all tasks busy.
    """
    sizes = stored(shards.groupBy("shard").agg(F.sum("n").alias("n")), "phrase-shards")
    count, total = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    most = min(INDEX_WORDS, max(SHARD_WORDS, total // (2 * shards.sparkSession.sparkContext.defaultParallelism)))
    bucket = F.pmod(F.xxhash64("shard"), F.lit(max(1, count // 1000)))  # about a thousand shards are packed together
    filled = F.sum("n").over(Window.partitionBy("bucket").orderBy("shard")) - 1
    sizes = sizes.withColumn("bucket", bucket).withColumn("nth", F.floor(filled / F.lit(most)).cast("long"))
    index = F.col("bucket") * F.lit(1 << 32) + F.col("nth")
    return checked_broadcast(stored(sizes.select("shard", index.alias("index")), "phrase-groups"))


def _numbered(often: DataFrame) -> DataFrame:
    """``(id, lang, word, f)``: ids from 0 without gaps, frequent words first, so that most ids are short."""
    order = [F.desc("f"), F.col("lang"), F.col("word")]
    row = F.monotonically_increasing_id()
    placed = often.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(placed.select(F.shiftright(row, 33).alias("part"), row.bitwiseAND((1 << 33) - 1).alias("place"), "*"), "phrase-frequent")
    # A row per range partition, a number this job chose itself.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    numbered = placed.join(F.broadcast(starts), "part").select((F.col("start") + F.col("place")).alias("id"), "lang", "word", "f")
    return stored(numbered, "phrase-numbered")


def frequent_phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = MIN_COUNT
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(words, phrases, sizes)``: all words and phrases that occur ``least`` times in their language.

    ``words (id, lang, word, f)``, ``phrases (key array<long>, f)`` for 1 to ``longest`` words, and
    ``sizes (lang, n)``: the number of all word occurrences.
    """
    spark = docs.sparkSession
    folder = fresh_dir(spark, "phrases")
    shards = write_shards(docs, folder, text_col, lang_col)
    sizes = stored(shards.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-sizes")
    groups = _groups(shards)
    often = shards.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    words = _numbered(often)
    mapped = shards.select("shard", "lang", "word", "local").join(words.select("id", "lang", "word"), ["lang", "word"])
    mapped = mapped.join(groups, "shard").select("index", "shard", "local", "id")

    def build(key: tuple, group: pa.Table) -> pa.Table:
        filesystem, target = resolve(folder)
        number = key[0].as_py()
        ids, symbol_of = np.unique(group.column("id").to_numpy(), return_inverse=True)
        shard, local, texts = group.column("shard").to_numpy(), group.column("local").to_numpy(), []
        for name in np.unique(shard):
            (text,), own = _load(filesystem, target, f"{name}.text"), shard == name
            symbol = np.zeros(max(int(text.max()), int(local[own].max())) + 1, np.int32)
            symbol[local[own]] = symbol_of[own] + 1
            text = symbol[text]
            texts.append(text[(text > 0) | np.concatenate([[True], text[:-1] > 0])])  # one separator is enough
        index, arrays = Index.build(np.concatenate(texts), ids, longest)
        _save(filesystem, target, f"{number}.index", arrays)
        return _found(number, index, *index.extend(np.arange(1, len(ids) + 1)[:, None]))

    def extend(key: tuple, group: pa.Table) -> pa.Table:
        filesystem, target = resolve(folder)
        number, n = key[0].as_py(), group.num_columns - 2
        index = Index.opened(_load(filesystem, target, f"{number}.index"))
        phrases = np.column_stack([np.searchsorted(index.ids, group.column(c).to_numpy()) + 1 for c in _keys(n)])
        return _found(number, index, *index.extend(phrases))

    levels = [words.select(F.array("id").alias("key"), "f")]
    rows = mapped.groupBy("index").applyInArrow(build, _schema(2))
    for n in range(2, longest + 1):
        level = _frequent(rows, _keys(n), least)
        levels.append(level.groupBy(*_keys(n)).agg(F.max("f").alias("f")).select(F.array(*_keys(n)).alias("key"), "f"))
        rows = level.groupBy("index").applyInArrow(extend, _schema(n + 1)) if n < longest else rows
    phrases = levels[0]
    for level in levels[1:]:
        phrases = phrases.unionByName(level)
    return words, stored(phrases, "phrase-counts"), sizes


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    longest: int = LONGEST,
    least: int = MIN_COUNT,
    best: int = BEST,
    share: int = SHARE,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score, left_count, right_count)``: each language's first ``best`` phrases.

    Counts are exact, over all whole texts: a phrase occurs ``a`` times, the two parts of its weakest cut ``l`` and ``r``
    times; ``score = floor(2000000 a / (l + r))`` in decimal arithmetic. ``left_count`` and ``right_count`` are the counts
    of its most frequent extensions by a word (0 if none is a candidate); a phrase with ``share`` percent of its
    occurrences in one of them goes. A longer phrase than by one word can't take more, so this is
    the test against all longer candidates.

    Null texts are empty, a null language is ``und``; copies of a text count each time. Ties rank by score, count and phrase in byte
    order. Tables without texts or without frequent phrases give no rows. Other columns are not looked at.
    """
    words, phrases, sizes = frequent_phrases(docs, text_col, lang_col, longest, least)
    candidates = phrases.where(F.size("key") > 1).withColumnRenamed("f", "a")
    one = "slice(key, 1, size(key) - 1)", "slice(key, 2, size(key) - 1)"
    longer = candidates.where(F.size("key") > 2)
    sides = [longer.groupBy(F.expr(part).alias("key")).agg(F.max("a").alias(name)) for part, name in zip(one, ("right_count", "left_count"))]
    kept = candidates.join(sides[0], "key", "left").join(sides[1], "key", "left").na.fill(0, ["left_count", "right_count"])
    inside = F.greatest("left_count", "right_count").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * share
    kept = kept.where(~inside)

    cuts = kept.select("*", F.explode(F.expr("sequence(1, size(key) - 1)")).alias("k"))
    cuts = cuts.withColumn("p1", F.expr("slice(key, 1, k)")).withColumn("p2", F.expr("slice(key, k + 1, size(key) - k)"))
    cuts = cuts.join(phrases.select(F.col("key").alias("p1"), F.col("f").alias("l")), "p1")
    cuts = cuts.join(phrases.select(F.col("key").alias("p2"), F.col("f").alias("r")), "p2")
    score = f"cast(a as decimal(20,0)) * {SCALE} div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"
    weakest = F.min(F.struct(F.expr(score).cast("long").alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("key", "a", "left_count", "right_count").agg(weakest)
    scored = scored.join(words.select(F.col("id"), "lang"), F.col("key")[0] == F.col("id"))

    # Only phrases that can be among the best are spelt out; ties at the end all stay until then.
    order = [F.desc("cut.score"), F.desc("a")]
    near = scored.withColumn("at", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("at") <= best)
    near = stored(near.select("lang", "key", "a", "left_count", "right_count", "cut"), "phrase-best")
    letters = near.select("key", F.posexplode("key").alias("place", "id")).join(words.select("id", "word"), "id")
    letters = letters.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("spelt"))
    near = near.join(letters, "key").withColumn("phrase", F.array_join(F.col("spelt.word"), " "))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")).where(F.col("rank") <= best)
    near = near.join(sizes, "lang")
    return near.select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score", "left_count", "right_count")
