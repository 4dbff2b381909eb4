"""N-gram Jaccard self-join of documents by T-occurrence search, and the groups it yields.

A document is the set of its distinct word ``n``-grams. Two documents of sizes
``x`` and ``y`` link when they share at least ``T = ceil(t (x + y) / (1 + t))``
n-grams. As in DivideSkip, the inverted lists of a document are divided: its
rarest ``p + k - 1`` n-grams, with ``p = x - ceil(t x) + 1``, have short lists, which are merged - at
least ``k`` of them must hold any partner - and the remaining, longer lists are only probed by
binary search for the candidates so found. ``k`` is about a third of ``p``, so a
passage in many otherwise different documents makes no candidates.

* **Order.** All tasks need one order from rare to frequent. A table of ``slots``
  counters over n-gram hashes is summed over *all* documents; only its size, fixed
  by a parameter, reaches the driver. A hash is rewritten with the rank of its
  slot in front, so numeric order is frequency order. Any order gives the same result.
* **Copies.** Documents with equal sets are one node; they never meet each other.
* **Short lists** become rows ``(n-gram, document)``. Lists of one entry go. Lists of up to
  ``SMALL_LIST`` entries yield their pairs, at most ``SMALL_LIST / 2`` per row.
* **Hot lists** come from families of near copies. Each list names one leader, the entry that
  is in most hot lists, so a family has few. A member is described by its difference from the leader: a
  bit per n-gram of the leader, and the n-grams the leader lacks. Members meet in blocks of bounded
  size, where bit products give the shared n-grams of all pairs at once; a block yields
  a spanning forest of its links, never its pairs.
* **Probing** streams over the pairs of one document at a time and runs the
  division again over the real lists of the candidates.

Results are exact up to 64-bit hash collisions within a pair of documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleaner.llm.graph import components
from gleaner.llm.sides import checked_broadcast
from gleaner.llm.wordhash import BLANKS, cut_words, hash_runs, hash_words, mix, text_slices
from gleaner.plans.workspace import stored

SLOTS = 1 << 16
SHARE = 3
SMALL_LIST = 16
PROBE_ROWS = 256  # candidates whose lists are merged at once
PROBE_LISTS = 64  # long lists probed between two checks of what a candidate can still reach
PROBE_BATCH = 1000  # rows of pairs whose texts are cut at once
FAMILY_BLOCK = 500  # about so many members of a family meet as many others in a task
BITS = 1 << 15  # n-grams of a leader whose bits are unpacked at once

def _row_grams(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, n-gram hashes, per row the number of its first hash)``; not yet distinct."""
    for row, data, offsets in text_slices(column):
        starts, ends, first = cut_words(data, offsets, BLANKS)
        words = hash_words(data, starts, ends)
        runs = hash_runs(words, n)
        parts, bounds = [], [0]
        for i in range(len(offsets) - 1):
            low, high = first[i], first[i + 1]
            if high - low >= n:
                part = runs[low : high - n + 1]
            elif high > low:  # fewer words: the whole sequence
                part = mix(hash_runs(words[low:high], int(high - low)) ^ np.uint64(high - low))
            else:
                part = words[:0]
            parts.append(part)
            bounds.append(bounds[-1] + len(part))
        yield row, np.concatenate(parts) if parts else words[:0], np.array(bounds)


def gram_slots(docs: DataFrame, text: str, n: int, slots: int) -> np.ndarray:
    """Rank of each of ``slots`` hash slots, from the rarest to the most frequent over all documents."""
    shift = np.uint64(64 - (slots - 1).bit_length())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, dtype=np.int64)
        for batch in batches:
            for _, grams, _ in _row_grams(batch.column(0), n):
                total += np.bincount((grams >> shift).astype(np.int64), minlength=slots)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["slot", "n"])

    rows = docs.select(F.col(text)).mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    counts = np.zeros(slots, dtype=np.int64)
    table = rows.toArrow()  # at most ``slots`` rows
    counts[table.column("slot").to_numpy()] = table.column("n").to_numpy()
    rank = np.empty(slots, dtype=np.uint64)
    rank[np.argsort(counts, kind="stable")] = np.arange(slots, dtype=np.uint64)
    return rank


def _ordered(grams: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Hashes with the rank of their slot in front: in ascending order rare ones come first."""
    bits = (len(rank) - 1).bit_length()
    shift, low = np.uint64(64 - bits), np.uint64((1 << (64 - bits)) - 1)
    return (rank[(grams >> shift).astype(np.int64)] << shift) | (grams & low)


def short_lists(size, percent: int):
    """``(p, k)``: a partner stands in ``k`` or more of the first ``p + k - 1`` lists; also for columns of sizes."""
    if isinstance(size, int):
        p = size - (percent * size + 99) // 100 + 1
        return p, 1 + p // SHARE
    p = size - F.ceil(size * percent / 100) + 1
    return p, 1 + F.floor(p / SHARE)


def _as_lists(parts: list[np.ndarray]) -> pa.ListArray:
    sizes = np.cumsum([0] + [len(p) for p in parts])
    values = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values))


def _sets(docs: DataFrame, id_col: str, text: str, n: int, rank, percent: int) -> DataFrame:
    """``(id, size, sig, short)``: set size, a 128-bit name of the set, and its short-list n-grams."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, grams, bounds in _row_grams(batch.column(1), n):
                sizes, sigs, shorts, grams = [], [], [], _ordered(grams, rank.value)
                for low, high in zip(bounds[:-1], bounds[1:]):
                    tokens = np.unique(grams[low:high])
                    size = len(tokens)
                    sizes.append(size)
                    sigs.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if size else None)
                    shorts.append(tokens[: sum(short_lists(size, percent)) - 1] if size else tokens)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(sizes)), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), _as_lists(shorts)],
                    ["id", "size", "sig", "short"],
                )

    pair = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text))
    return pair.mapInArrow(build, "id long, size long, sig binary, short array<long>")


def _whole_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    return [np.unique(grams[i:j]) for _, grams, at in _row_grams(column, n) for i, j in zip(at[:-1], at[1:])]


def t_occurrence(query: np.ndarray, lists: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the candidate sets ``lists`` share enough of ``query`` (all sorted), by DivideSkip."""
    sizes = np.array([len(x) for x in lists])
    need = -((-percent * (sizes + len(query))) // (100 + percent))  # T of each candidate
    tokens, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), sizes)
    place = np.minimum(np.searchsorted(query, tokens), len(query) - 1)
    known = query[place] == tokens  # entries of the inverted lists of the query's tokens
    n = len(lists)
    entries = np.sort(place[known] * n + owner[known])  # by list, then by candidate
    length = np.bincount(entries // n, minlength=len(query))
    by_length = np.argsort(length, kind="stable")
    least = int(need.min())
    n_long = min(int(least / (1 + 0.1 * np.log2(length.max() + 1))), least - 1, len(query))
    short, long = by_length[: len(query) - n_long], by_length[len(query) - n_long :]
    in_short = np.zeros(len(query), dtype=bool)
    in_short[short] = True
    hits = np.bincount(entries[in_short[entries // n]] % n, minlength=n)  # merged short lists
    alive = np.flatnonzero(hits >= need - n_long)
    for i in range(0, n_long, PROBE_LISTS):  # long lists: binary search for candidates that can still reach T
        if not len(alive):
            break
        some = long[i : i + PROBE_LISTS]
        asked = (some[:, None] * n + alive[None, :]).ravel()
        at = np.minimum(np.searchsorted(entries, asked), max(0, len(entries) - 1))
        hits[alive] += (entries[at] == asked).reshape(len(some), -1).sum(axis=0) if len(entries) else 0
        alive = alive[hits[alive] + (n_long - i - len(some)) >= need[alive]]
    return hits >= need


def _links(docs: DataFrame, id_col: str, text: str, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The rows ``(a, b)`` of ``pairs`` whose documents link; written.

    The texts travel, not their n-grams, which take more room.
    """

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            a, b = rows.column("a").to_numpy(), rows.column("b").to_numpy()
            keep = np.zeros(len(a), dtype=bool)
            cuts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            queries = _whole_sets(rows.column("mine").take(pa.array(cuts)), n)
            lists = _whole_sets(rows.column("other"), n)
            for query, start, end in zip(queries, cuts, [*cuts[1:], len(a)]):
                for i in range(start, end, PROBE_ROWS):
                    stop = min(end, i + PROBE_ROWS)
                    keep[i:stop] = t_occurrence(query, lists[i:stop], percent)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    ids = checked_broadcast(stored(ids, "ngram-ids"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t")).join(ids, "id", "left_semi")
    wide = pairs.join(texts.select(F.col("id").alias("b"), F.col("t").alias("other")), "b")
    wide = wide.join(texts.select(F.col("id").alias("a"), F.col("t").alias("mine")), "a")
    wide = wide.select("a", "b", "mine", "other")
    return stored(wide.mapInArrow(probe, "a long, b long"), "ngram-links")


def _fits(x: str, y: str, percent: int):
    """Sizes that allow the similarity."""
    return F.expr(f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})")


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    percent: int = 80,
    slots: int = SLOTS,
) -> DataFrame:
    """``(id_col, n_shingles, component_id)``, one row per row of ``docs``.

    ``component_id`` is the smallest id reachable over links, the row's own id included.
    Null and blank texts have an empty set and link with nothing. Texts of fewer
    than ``n`` words are one n-gram. Rows that repeat an id are one node, each with
    its own size. A null id gets the group of the texts equal to its own, else null.
    An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(id_col, text_col)
    rank = spark.sparkContext.broadcast(gram_slots(docs, text_col, n, slots))  # 8 bytes a slot
    table = stored(_sets(docs, id_col, text_col, n, rank, percent), "ngram-sets")
    named = table.where("id is not null and size > 0").groupBy("sig").agg(F.min("id").alias("rep"))
    copies = stored(table.where("id is not null").join(named, "sig").where("id != rep").select("id", "sig"), "ngram-copies")
    reps = table.where("id is not null").join(checked_broadcast(copies), ["id", "sig"], "left_anti")
    shared = stored(_repeated(reps.select(F.explode("short").alias("gram"), "id", "size")), "ngram-shared")
    for _ in range(2):
        shared = _with_partners(shared, percent)
    lists = stored(shared.join(shared.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1"), "gram"), "ngram-lists")

    small, hot = lists.where(F.col("m") <= SMALL_LIST), lists.where(F.col("m") > SMALL_LIST)
    pairs = stored(_likely_pairs(small, hot, percent), "ngram-pairs")
    links = _links(docs, id_col, text_col, pairs, n, percent).union(_same_id(table, named))
    links = links.union(_family_links(docs, id_col, text_col, hot, n, percent))
    groups = stored(components(links.withColumnsRenamed({"a": "u", "b": "v"})), "ngram-groups")

    rows = table.select("id", "size", "sig").join(named, "sig", "left")
    rows = rows.join(groups, rows.rep == groups.node, "left")
    return rows.select(
        F.col("id").alias(id_col),
        F.col("size").alias("n_shingles"),
        F.coalesce("component", "rep", "id").alias("component_id"),
    )


def _same_id(table: DataFrame, named: DataFrame) -> DataFrame:
    """Links between the sets of rows that repeat an id."""
    rows = table.where("id is not null").select("id", "sig").join(named, "sig").select("id", "rep")
    apart = rows.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z")
    return rows.join(apart, "id").where("rep != a").select("a", F.col("rep").alias("b")).distinct()


def _repeated(entries: DataFrame) -> DataFrame:
    """Entries of lists with more than one entry.

    Sorted by range of (n-gram, id), so a hot list spreads over several tasks. Each task
    looks at neighbouring rows only; its first and last row stay, as their list may go on elsewhere.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, None  # the last row, and the n-gram before it
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            gram = rows.column("gram").to_numpy()
            same = gram[1:] == gram[:-1]
            keep = np.r_[before is None or before == gram[0], same]
            keep[:-1] |= same
            held = rows.slice(len(gram) - 1).to_batches()[0]
            before = gram[-2] if len(gram) > 1 else before
            yield from rows.slice(0, len(gram) - 1).filter(pa.array(keep[:-1])).to_batches()
        if held is not None:
            yield held

    spread = entries.repartitionByRange("gram", "id").sortWithinPartitions("gram")
    return spread.mapInArrow(look, entries.schema)


def _with_partners(entries: DataFrame, percent: int) -> DataFrame:
    """Entries of documents that stand in as many lists with others as any link of theirs needs; written."""
    lists = entries.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1").select("gram")
    rows = entries.join(lists, "gram", "left_semi")
    least = F.ceil(F.col("size") * percent / 100)  # of a partner's size
    enough = rows.groupBy("id").agg(F.count("*").alias("n"), F.min("size").alias("size"))
    enough = stored(enough.where(F.col("n") >= short_lists(least, percent)[1]).select("id"), "ngram-able")
    return stored(rows.join(checked_broadcast(enough), "id", "left_semi"), "ngram-shared")


def _likely_pairs(small: DataFrame, hot: DataFrame, percent: int) -> DataFrame:
    """Pairs of entries of small lists whose sizes allow a link and that can share enough short lists.

    Of the hot lists they share no more than the one with fewer of them stands in.
    """
    x, y = small.alias("x"), small.alias("y")
    on = (F.col("x.gram") == F.col("y.gram")) & (F.col("x.id") < F.col("y.id")) & _fits("x.size", "y.size", percent)
    smaller = F.least("x.size", "y.size").alias("size")
    met = x.join(y, on).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), smaller)
    met = met.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("size").alias("size"))
    in_hot = stored(hot.groupBy("id").agg(F.count("*").alias("h")), "ngram-hot")
    for end in ("a", "b"):
        counts = checked_broadcast(in_hot.select(F.col("id").alias(end), F.col("h").alias(f"h{end}")))
        met = met.join(counts, end, "left")
    hot_shared = F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0)))
    return met.where(F.col("n") + hot_shared >= short_lists(F.col("size"), percent)[1]).select("a", "b")


def _families(hot: DataFrame) -> DataFrame:
    """``(a, b)``: the leaders ``a`` of the hot lists with all entries ``b`` of their lists, themselves included."""
    weight = hot.groupBy("id").agg(F.count("*").alias("weight"))
    entries = hot.select("gram", "id").join(weight, "id")
    lead = entries.groupBy("gram").agg(F.max("weight").alias("most"))
    heads = entries.join(lead, "gram").where("weight = most").groupBy("gram").agg(F.min("id").alias("a"))
    return hot.select("gram", F.col("id").alias("b")).join(heads, "gram").select("a", "b").distinct()


def _wide(docs: DataFrame, id_col: str, text: str, pairs: DataFrame) -> DataFrame:
    """``(a, b, mine, other)``: written pairs with the texts of both, which take less room than their n-grams."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    ids = checked_broadcast(stored(ids, "ngram-ids"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t")).join(ids, "id", "left_semi")
    wide = pairs.join(texts.select(F.col("id").alias("b"), F.col("t").alias("other")), "b")
    wide = wide.join(texts.select(F.col("id").alias("a"), F.col("t").alias("mine")), "a")
    return wide.select("a", "b", "mine", "other")


def _runs(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple]:
    """``(a, set of a, all b, their sets)`` for neighbouring rows of one ``a``."""
    for batch in batches:
        for at in range(0, batch.num_rows, PROBE_BATCH):
            rows = batch.slice(at, PROBE_BATCH)
            a, b = rows.column("a").to_numpy(), rows.column("b").to_numpy()
            cuts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            queries = _whole_sets(rows.column("mine").take(pa.array(cuts)), n)
            others = _whole_sets(rows.column("other"), n)
            for query, start, end in zip(queries, cuts, [*cuts[1:], len(a)]):
                yield int(a[start]), query, b[start:end], others[start:end]


def _links(docs: DataFrame, id_col: str, text: str, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The rows ``(a, b)`` of ``pairs`` whose documents link; written."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, query, b, others in _runs(batches, n):
            for i in range(0, len(b), PROBE_ROWS):
                found = b[i : i + PROBE_ROWS][t_occurrence(query, others[i : i + PROBE_ROWS], percent)]
                if len(found):
                    yield _pairs(np.full(len(found), a), found)

    return stored(_wide(docs, id_col, text, pairs).mapInArrow(probe, "a long, b long"), "ngram-links")


def _pairs(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _family_links(docs: DataFrame, id_col: str, text: str, hot: DataFrame, n: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` that connect all entries of hot lists which links connect; written."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, leader, b, members in _runs(batches, n):
            bits, extra = [], []
            for tokens in members:
                held = np.zeros(len(leader), dtype=bool)
                at = np.minimum(np.searchsorted(leader, tokens), len(leader) - 1)
                known = leader[at] == tokens
                held[at[known]] = True
                bits.append(np.packbits(held).tobytes())
                extra.append(tokens[~known])
            sizes = [len(tokens) for tokens in members]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a] * len(b), pa.int64()), pa.array(b), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), _as_lists(extra)],
                ["a", "b", "size", "bits", "extra"],
            )

    families = stored(_families(hot), "ngram-families")
    rows = _wide(docs, id_col, text, families).mapInArrow(describe, "a long, b long, size long, bits binary, extra array<long>")
    rows = stored(rows, "ngram-members")
    blocks = rows.groupBy("a").agg(F.ceil(F.count("*") / FAMILY_BLOCK).cast("int").alias("blocks"))
    rows = rows.join(checked_broadcast(stored(blocks, "ngram-blocks")), "a")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("b"), "blocks").cast("int"))
    rows = rows.withColumn("with", F.explode_outer(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("a", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"), "own", "b", "size", "bits", "extra")

    def meet(table: pa.Table) -> pa.Table:
        a, b = spanning_links(
            table.column("b").to_numpy(), table.column("size").to_numpy(), table.column("own").to_numpy(),
            table.column("bits").to_pylist(), table.column("extra").combine_chunks(), percent,
        )
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return stored(rows.groupBy("a", "x", "y").applyInArrow(meet, "a long, b long"), "ngram-links")


def spanning_links(ids, sizes, own, bits: list[bytes], extra: pa.ListArray, percent: int) -> tuple[list, list]:
    """A spanning forest of the links among members described by bits and extra n-grams.

    With members of two blocks, pairs within one block are left to the task of that block.
    """
    shared = np.zeros((len(ids), len(ids)), dtype=np.float32)
    packed = np.frombuffer(b"".join(bits), dtype=np.uint8).reshape(len(ids), -1)
    for at in range(0, packed.shape[1], BITS // 8):
        part = np.unpackbits(packed[:, at : at + BITS // 8], axis=1).astype(np.float32)
        shared += part @ part.T
    more = np.diff(extra.offsets.to_numpy())
    need = -((-percent * (sizes[:, None] + sizes[None, :])) // (100 + percent))
    sure = shared >= need
    able = shared + np.minimum(more[:, None], more[None, :]) >= need
    if len(set(own.tolist())) > 1:
        apart = own[:, None] != own[None, :]
        sure &= apart
        able &= apart
    np.fill_diagonal(sure, False)
    group = np.arange(len(ids))
    a, b = [], []
    seen = np.zeros(len(ids), dtype=bool)
    for i in range(len(ids)):  # trees of the sure links
        wave = [i]
        while wave:
            j = wave.pop()
            if seen[j]:
                continue
            seen[j] = True
            fresh = np.flatnonzero(sure[j] & ~seen & (group != group[i]))
            group[fresh] = group[i]
            a += [int(ids[j])] * len(fresh)
            b += ids[fresh].tolist()
            wave += fresh.tolist()
    able &= group[:, None] < group[None, :]
    values, ends = extra.flatten().to_numpy(zero_copy_only=False), extra.offsets.to_numpy() - extra.offsets[0].as_py()
    for i, j in np.argwhere(able):
        if group[i] != group[j]:
            common = len(np.intersect1d(values[ends[i] : ends[i + 1]], values[ends[j] : ends[j + 1]], assume_unique=True))
            if shared[i, j] + common >= need[i, j]:
                a.append(int(ids[i]))
                b.append(int(ids[j]))
                group[group == group[j]] = group[i]
    return a, b


def keep_one_per_group(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row with the smallest id stays.

    Rows without an id stay, and so do all rows without words. Rows that repeat an
    id stay or go together.
    """
    id_col = options.get("id_col", "doc_id")
    found = jaccard_components(docs, **options)
    gone = found.where("n_shingles > 0").where(F.col("component_id") != F.col(id_col)).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti")
