"""BM25 of large query sets: blocks of queries meet an inverted index of all documents.

* **Segments.** Documents are packed once, by the tasks that hold them, into small inverted indexes: the distinct words of some thousand
  documents of a language with their lists. They are written to the shared folder and never moved: every block of queries scans them there.
* **Chains.** A few tasks for each block of queries go through the segments one after the other and keep the best ``k`` of every query. So
  the number of hits that are shuffled follows from the number of queries, and hardly from that of the documents.
* **Threshold.** The ``k``-th best score so far is what a document must reach. Words whose largest weights together stay
  below it can't bring a document there by themselves: their lists are only looked up for the documents of the other words (MaxScore).

Only documents that cannot be among the first ``k`` are left out, so the hits are those of an exhaustive search.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as ST

from gleaner.functions.blocks import round6
from gleaner.plans.workspace import stored

DOC_BLOCK_ROWS = 32_768
BLOCK_POSTINGS = 8_000_000  # of the documents that a task scores at a time
SEGMENT_WORDS = 2_000_000  # running words of a segment
QUERY_BLOCK_ROWS = 65_536
LEAST_QUERIES = 4_096  # of a block that only more tasks ask for
CHAINS = 4  # tasks that share the segments for a block of queries
HIT_ROWS = 100_000  # handed on together
DENSE_LISTS = 200  # long lists that are kept by document, for lookups
SLACK = 2e-6  # rounded scores, and sums of weights in another order


def _blob(**columns: pa.Array) -> bytes:
    """Arrays of any lengths as one compressed value."""
    lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns.values()]
    batch = pa.RecordBatch.from_arrays(lists, list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _arrays(blob: bytes) -> dict[str, pa.Array]:
    batch = pa.ipc.open_stream(blob).read_next_batch()
    return {name: batch.column(name).flatten() for name in batch.schema.names}


def _joined(arrays: list[pa.Array]) -> pa.Array:
    whole = pa.chunked_array(arrays).combine_chunks()
    return whole if isinstance(whole, pa.Array) else pa.concat_arrays(whole.chunks)


def _words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a column, and the number of words of each row."""
    lists = pc.split_pattern(column, " ")
    words, sizes = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if pc.any(pc.equal(words, "")).as_py():  # of rows without any word
        filled = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[filled], minlength=len(sizes))
        words = words.filter(pa.array(filled))
    return words, sizes


class _Bags:
    """Bags of words of one language on their way to a segment. Bags of one document that have the same length are one."""

    def __init__(self) -> None:
        self.docids, self.lengths, self.words, self.places, self.counts, self.rows = [], [], [], [], [], 0
        self.n_words = self.n = self.total = 0

    def add(self, batch: pa.RecordBatch) -> None:
        bags = batch.column("bags")
        each = pc.fill_null(pc.list_value_length(bags), 0).to_numpy(zero_copy_only=False)
        bags = bags.flatten()
        doc = np.repeat(np.arange(batch.num_rows), each)
        dl = pc.fill_null(pc.struct_field(bags, "dl"), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.n += int((dl > 0).sum())
        self.total += int(dl.sum())
        row = np.arange(len(doc))
        if len(doc) > batch.num_rows:
            pairs, row = np.unique(np.stack([doc, dl]), axis=1, return_inverse=True)
            (doc, dl), row = pairs, row.reshape(-1)
        words, sizes = _words(pc.struct_field(bags, "words"))
        tfs = pc.struct_field(bags, "tfs")
        counts = tfs.flatten().to_numpy(zero_copy_only=False) if tfs.null_count < len(tfs) else np.ones(len(words))
        self.docids.append(batch.column("docid").take(pa.array(doc)))
        self.lengths.append(dl)
        self.words.append(words)
        self.places.append(np.repeat(row, sizes) + self.rows)
        self.counts.append(counts.astype(np.int64))
        self.rows += len(doc)
        self.n_words += len(words)

    def segment(self) -> bytes:
        """Lists of all words: gaps between their rows, and counts."""
        coded = _joined(self.words).dictionary_encode()
        key = coded.indices.to_numpy().astype(np.int64) * self.rows + np.concatenate(self.places)
        counts = np.concatenate(self.counts)
        if (counts == 1).all():
            key, tf = np.unique(key, return_counts=True)
        else:
            order = np.argsort(key)
            key, first = np.unique(key[order], return_index=True)
            tf = np.add.reduceat(counts[order], first) if len(first) else counts
        term, row = np.divmod(key, self.rows)
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        gaps = np.diff(row, prepend=0)
        gaps[starts] = row[starts]
        return _blob(
            words=coded.dictionary.take(pa.array(term[starts])),
            sizes=pa.array(np.diff(starts, append=len(term)).astype(np.int32)),
            gaps=pa.array(gaps.astype(np.uint32)),
            tfs=pa.array(tf.astype(np.uint32)),
            docids=_joined(self.docids),
            lengths=pa.array(np.concatenate(self.lengths)),
        )


def written_segments(docs: DataFrame) -> DataFrame:
    """The written segments ``(lang, n, total, segment)`` of ``docs(lang, docid, bags(dl, words, tfs))``, a row per document; ``tfs`` null where words repeat.

    ``n`` bags hold a word, and ``total`` words there are.
    """
    most_rows, most_words = DOC_BLOCK_ROWS, SEGMENT_WORDS
    schema = ST.StructType([docs.schema["lang"], *(ST.StructField(c, ST.LongType()) for c in ("n", "total")), ST.StructField("segment", ST.BinaryType())])

    def rows(lang: str | None, bags: _Bags) -> pa.RecordBatch:
        columns = [pa.array([lang], pa.string()), pa.array([bags.n]), pa.array([bags.total]), pa.array([bags.segment()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "n", "total", "segment"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, _Bags] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, min(1_024, most_rows)):
                batch = whole.slice(start, min(1_024, most_rows))
                for lang in pc.unique(batch.column("lang")).to_pylist():
                    same = pc.is_null(batch.column("lang")) if lang is None else pc.equal(batch.column("lang"), lang)
                    bags = held.setdefault(lang, _Bags())
                    bags.add(batch.filter(same))
                    if bags.rows >= most_rows or bags.n_words >= most_words:
                        yield rows(lang, held.pop(lang))
        for lang, bags in held.items():
            yield rows(lang, bags)

    return stored(docs.mapInArrow(pack, schema), "segments")


def segment_freqs(segments: DataFrame) -> DataFrame:
    """``(lang, term, df)`` of the written segments."""

    def freqs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, blob in zip(batch.column("lang").to_pylist(), batch.column("segment")):
                lists = _arrays(blob.as_py())
                df = lists["sizes"].cast(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(df), pa.string()), lists["words"], df], ["lang", "term", "df"])

    each = segments.select("lang", "segment").mapInArrow(freqs, "lang string, term string, df bigint")
    return each.groupBy("lang", "term").agg(F.sum("df").alias("df"))


def segment_stats(segments: DataFrame) -> DataFrame:
    """``(lang, n, avgdl)`` of the written segments."""
    n = F.sum("n")
    return segments.groupBy("lang").agg(n.alias("n"), (F.sum("total") / F.nullif(n, F.lit(0))).alias("avgdl")).where(F.col("n") > 0)


def segment_documents(segments: DataFrame, docid: ST.StructField) -> DataFrame:
    """``(lang, docid, dl, words, tfs)`` of the written segments: the distinct words of every bag in one string."""
    schema = ST.StructType([segments.schema["lang"], docid]).add("dl", ST.LongType()).add("words", ST.StringType()).add("tfs", ST.ArrayType(ST.IntegerType()))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, blob in zip(batch.column("lang").to_pylist(), batch.column("segment")):
                lists = _arrays(blob.as_py())
                sizes, n = lists["sizes"].to_numpy().astype(np.int64), len(lists["docids"])
                ends = np.cumsum(lists["gaps"].to_numpy(), dtype=np.int64)
                row = ends - np.repeat(np.concatenate([[0], ends])[np.cumsum(sizes) - sizes], sizes)
                order = np.argsort(row, kind="stable")
                offsets = pa.array(np.searchsorted(row[order], np.arange(n + 1)).astype(np.int32))
                words = pa.ListArray.from_arrays(offsets, lists["words"].take(pa.array(np.repeat(np.arange(len(sizes)), sizes)[order])))
                tfs = pa.ListArray.from_arrays(offsets, lists["tfs"].cast(pa.int32()).take(pa.array(order)))
                columns = [pa.array([lang] * n, pa.string()), lists["docids"], lists["lengths"], pc.binary_join(words, " "), tfs]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "docid", "dl", "words", "tfs"]).filter(pc.greater(lists["lengths"], 0))

    return segments.select("lang", "segment").mapInArrow(documents, schema)


class InvertedLists:
    """Lists of the documents of some segments of one language: the words of the queries with the documents that hold them."""

    def __init__(self, segments: list[dict[str, pa.Array]], vocabulary: pa.Array, avgdl: float, k1: float, b: float):
        names = _joined([s["docids"] for s in segments])
        distinct = pc.unique(names)
        # In the order of the final ranking, so that of equal scores the first numbers stay.
        self.ids = distinct.take(pc.sort_indices(distinct, null_placement="at_start"))
        number = pc.index_in(names, value_set=self.ids).to_numpy().astype(np.int64)
        keys, parts, done = [], [], 0
        for s in segments:
            place = pc.index_in(s["words"], value_set=vocabulary)
            sizes = s["sizes"].to_numpy().astype(np.int64)
            known = place.is_valid().to_numpy(zero_copy_only=False)
            asked = np.repeat(known, sizes)
            ends = np.cumsum(s["gaps"].to_numpy(), dtype=np.int64)
            before = np.concatenate([[0], ends])[np.cumsum(sizes) - sizes]
            row = ends[asked] - np.repeat(before[known], sizes[known])
            tf = s["tfs"].to_numpy()[asked].astype(float)
            norm = k1 * (1 - b + b * s["lengths"].to_numpy().astype(float) / avgdl)
            keys.append(np.repeat(place.drop_null().to_numpy().astype(np.int64), sizes[known]) << 32 | number[row + done])
            parts.append(tf * (k1 + 1) / (tf + norm[row]))
            done += len(s["docids"])
        key, part = np.concatenate(keys), np.concatenate(parts)
        order = np.argsort(key)
        key, part = key[order], part[order]
        if len(distinct) < len(names) and len(key):  # bags of different lengths of one document
            first = np.flatnonzero(np.diff(key, prepend=-1))
            key, part = key[first], np.add.reduceat(part, first)
        self.rows, self.parts = (key & 0xFFFFFFFF).astype(np.int32), part
        starts = np.searchsorted(key >> 32, np.arange(len(vocabulary) + 1))
        full = np.flatnonzero(np.diff(starts))
        most = np.zeros(len(vocabulary))
        if len(full):
            most[full] = np.maximum.reduceat(part, starts[full])
        # As lists: a query looks up a few numbers.
        self.starts, self.most = starts.tolist(), most.tolist()
        self.sums, self.places, self.dense, self.reached = np.zeros(len(self.ids)), np.zeros(len(self.ids), np.int32), {}, {}

    def _looked_up(self, term: int, rows: np.ndarray) -> np.ndarray:
        """Weights of a word in the documents ``rows``."""
        found = self.dense.get(term)
        if found is None:
            span = slice(self.starts[term], self.starts[term + 1])
            if (span.stop - span.start) * 4 > len(self.ids) and len(self.dense) < DENSE_LISTS:
                found = self.dense[term] = np.zeros(len(self.ids))
                found[self.rows[span]] = self.parts[span]
            else:
                listed = self.rows[span]
                at = np.minimum(np.searchsorted(listed, rows), len(listed) - 1)
                return np.where(listed[at] == rows, self.parts[span][at], 0.0)
        return found[rows]

    def _reached(self, term: int, k: int) -> float:
        """What ``k`` documents reach by one word alone."""
        known = self.reached.get(term)
        if known is None:
            start, stop = self.starts[term], self.starts[term + 1]
            n = stop - start
            known = self.reached[term] = float(np.partition(self.parts[start:stop], n - k)[n - k]) if n >= k else 0.0
        return known

    def best(self, terms: list[int], idfs: list[float], k: int, boost: float, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and rounded scores of the best ``k`` documents of those that reach ``least``, a rounded score or minus infinity."""
        starts, nothing = self.starts, (np.empty(0, np.int64), np.empty(0))
        held = [(idf * self.most[t], t, idf) for t, idf in zip(terms, idfs) if starts[t] < starts[t + 1]]
        if not held:
            return nothing
        low = (least - SLACK) / boost if least > -np.inf else least
        if boost > 0:
            low = max(low, max(idf * self._reached(t, k) for _, t, idf in held) - SLACK / boost)
        held.sort()
        reach = list(accumulate(bound for bound, _, _ in held))
        if reach[-1] < low:
            return nothing
        # The first words of this order can't reach the threshold together.
        n_looked = bisect_left(reach, low)
        rest = reach[n_looked - 1] if n_looked else 0.0
        listed = [(slice(starts[t], starts[t + 1]), idf) for _, t, idf in held[n_looked:]]
        lists = [self.rows[span] for span, _ in listed]
        if sum(map(len, lists)) * 16 > len(self.ids):
            weights = np.concatenate([self.parts[span] * idf for span, idf in listed])
            sums = np.bincount(np.concatenate(lists), weights, len(self.ids))
            found = np.flatnonzero(sums > max(0.0, low - rest))
            sums = sums[found]
        else:
            for rows, (span, idf) in zip(lists, listed):
                self.sums[rows] += self.parts[span] * idf
            found = np.concatenate(lists)
            sums = self.sums[found]
            self.sums[found] = 0.0
            near = sums >= low - rest
            found, sums = found[near], sums[near]
            # Each document once: of its places the one that is written last.
            places = np.arange(len(found), dtype=np.int32)
            self.places[found] = places
            once = self.places[found] == places
            found, sums = found[once], sums[once]
        for place in range(n_looked - 1, -1, -1):
            if not len(found):
                return nothing
            _, term, idf = held[place]
            sums = sums + self._looked_up(term, found) * idf
            near = sums >= low - (reach[place - 1] if place else 0.0)
            found, sums = found[near], sums[near]
        scores = round6(boost * sums)
        near = scores >= least
        found, scores = found[near], scores[near]
        if len(found) > k:
            cut = np.partition(scores, len(found) - k)[len(found) - k]
            better, ties = np.flatnonzero(scores > cut), np.flatnonzero(scores == cut)
            if len(ties) > k - len(better):
                ties = ties[np.argsort(found[ties])[: k - len(better)]]
            chosen = np.concatenate([better, ties])
            found, scores = found[chosen], scores[chosen]
        return found, scores


class _Chain:
    """The best ``k`` of every query among the documents that one task has seen."""

    def __init__(self, asked: pa.Table, k: int, boost: float, k1: float, b: float):
        self.k, self.boost, self.k1, self.b = k, boost, k1, b
        self.langs, self.qids = asked.column("lang"), asked.column("qid")
        names = self.langs.to_pylist()
        words, sizes = _words(_joined(asked.column("words").chunks))
        idfs, ends = _joined(asked.column("idfs").chunks).flatten().to_numpy(), np.cumsum(sizes)
        first_of = {lang: i for i, lang in reversed(list(enumerate(names)))}
        self.avgdl = {lang: asked.column("avgdl")[i].as_py() for lang, i in first_of.items()}
        self.queries = {lang: [] for lang in first_of}
        for i, lang in enumerate(names):
            self.queries[lang].append(i)
        self.vocabulary = pc.unique(words)
        codes = pc.index_in(words, value_set=self.vocabulary).to_numpy().astype(np.int64)
        self.terms, self.idfs = ([part.tolist() for part in np.split(x, ends[:-1])] for x in (codes, idfs))
        self.found, self.scores = [np.empty(0, np.int64)] * len(names), [np.empty(0)] * len(names)
        self.least = [-np.inf] * len(names)
        self.names, self.starts = [], [0]

    def _ids(self, numbers: np.ndarray) -> pa.Array:
        """Document ids by number."""
        block = np.searchsorted(self.starts, numbers, side="right") - 1
        order = np.argsort(block, kind="stable")
        cuts = np.searchsorted(block[order], np.arange(len(self.names) + 1))
        taken = [self.names[i].take(pa.array(numbers[order[a:z]] - self.starts[i])) for i, (a, z) in enumerate(zip(cuts, cuts[1:])) if a < z]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return _joined(taken).take(pa.array(back)) if taken else self.names[0].slice(0, 0)

    def meet(self, lang: str, segments: list[dict[str, pa.Array]]) -> None:
        """All queries of a language against some segments."""
        lists = InvertedLists(segments, self.vocabulary, self.avgdl[lang], self.k1, self.b)
        start, k = self.starts[-1], self.k
        self.names.append(lists.ids)
        self.starts.append(start + len(lists.ids))
        for q in self.queries[lang]:
            found, scores = lists.best(self.terms[q], self.idfs[q], k, self.boost, self.least[q])
            if not len(found):
                continue
            found, scores = np.concatenate([self.found[q], found + start]), np.concatenate([self.scores[q], scores])
            if len(found) > k:
                cut = np.partition(scores, len(found) - k)[len(found) - k]
                better, ties = np.flatnonzero(scores > cut), np.flatnonzero(scores == cut)
                if len(ties) > k - len(better):
                    ties = ties[pc.sort_indices(self._ids(found[ties]), null_placement="at_start").to_numpy()[: k - len(better)]]
                chosen = np.concatenate([better, ties])
                found, scores = found[chosen], scores[chosen]
            self.found[q], self.scores[q] = found, scores
            if len(found) == k and self.boost > 0:
                self.least[q] = float(scores.min())

    def hits(self, queries: int) -> Iterator[bytes]:
        """Hits of so many queries at a time."""
        for first in range(0, len(self.found) if self.names else 0, queries):
            found, part = self.found[first : first + queries], slice(first, first + queries)
            yield _blob(
                lang=_joined(self.langs[part].chunks), qid=_joined(self.qids[part].chunks),
                sizes=pa.array([len(f) for f in found], pa.int32()),
                docid=self._ids(np.concatenate(found)), score=pa.array(np.concatenate(self.scores[part])),
            )


def _asked(weighted: DataFrame) -> tuple[DataFrame, int]:
    """The written queries ``(block, lang, qid, words, idfs, avgdl)``, and the number of their blocks.

    A block holds queries of one language, or of several that have few.
    """
    spark = weighted.sparkSession
    cores = spark.sparkContext.defaultParallelism
    asked = weighted.groupBy("lang", "qid").agg(F.collect_list(F.struct("term", "idf")).alias("e"), F.max("avgdl").alias("avgdl"))
    sizes = weighted.groupBy("lang").agg(F.count_distinct("qid").alias("n")).orderBy("lang").collect()  # a row per collection
    total = sum(r.n for r in sizes)
    size = max(1, min(QUERY_BLOCK_ROWS, max(LEAST_QUERIES, -(-total * CHAINS // (2 * cores)))))
    shape, block, room = [], -1, 0
    for r in sizes:
        if r.n > room:
            blocks = -(-r.n // size)
            shape.append((r.lang, block + 1, blocks))
            block += blocks
            room = size - r.n if blocks == 1 else 0
        else:
            shape.append((r.lang, block, 1))
            room -= r.n
    shape = spark.createDataFrame(shape, ST.StructType([weighted.schema["lang"], *(ST.StructField(c, ST.IntegerType()) for c in ("first", "blocks"))]))
    asked = asked.join(F.broadcast(shape), "lang").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("qid"), F.col("blocks"))).cast("int"))
    asked = asked.select("block", "lang", "qid", F.array_join("e.term", " ").alias("words"), F.col("e.idf").alias("idfs"), "avgdl")
    return stored(asked, "query-blocks"), block + 1


def block_hits(weighted: DataFrame, segments: DataFrame, docid: ST.StructField, k: int, boost: float, k1: float, b: float) -> DataFrame:
    """``(lang, qid, docid, score, rank)``: the best ``k`` of every query.

    ``weighted`` are the written query terms ``(lang, qid, term, idf, n, avgdl)``, ``segments`` the written ones of documents with such ``docid``.
    """
    spark = weighted.sparkSession
    types = {f.name: f for f in weighted.schema}
    out = ST.StructType([types["lang"], types["qid"], docid, ST.StructField("score", ST.DoubleType()), ST.StructField("rank", ST.LongType())])
    asked, n_blocks = _asked(weighted)
    if not n_blocks:
        return spark.createDataFrame([], out)
    chains = max(CHAINS, -(-2 * spark.sparkContext.defaultParallelism // n_blocks))
    most_rows, most_postings, queries = DOC_BLOCK_ROWS, BLOCK_POSTINGS, max(1, HIT_ROWS // k)

    def scored(block: int) -> DataFrame:
        # One block of bounded size is held at a time; the tasks of all blocks run in one job.
        shared = spark.sparkContext.broadcast(asked.where(F.col("block") == block).drop("block").toArrow())

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chain, held = _Chain(shared.value, k, boost, k1, b), {}
            for batch in batches:
                for lang, blob in zip(batch.column("lang").to_pylist(), batch.column("segment")):
                    if lang not in chain.queries:
                        continue
                    segment = _arrays(blob.as_py())
                    some = held.setdefault(lang, [])
                    grown = [*some, segment]
                    if some and (sum(len(s["docids"]) for s in grown) > most_rows or sum(len(s["gaps"]) for s in grown) > most_postings):
                        chain.meet(lang, held.pop(lang))
                        held[lang] = [segment]
                    else:
                        some.append(segment)
            for lang in list(held):
                chain.meet(lang, held.pop(lang))
            for part, hits in enumerate(chain.hits(queries)):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([hits], pa.binary())], ["block", "part", "hits"])

        langs = [r.lang for r in asked.where(F.col("block") == block).select("lang").distinct().collect()]
        few = segments.where(F.col("lang").isin(langs)).select("lang", "segment")
        return few.coalesce(chains).mapInArrow(score, "block int, part int, hits binary")

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [_arrays(blob.as_py()) for batch in batches for blob in batch.column("hits")]
        number = np.concatenate([np.repeat(np.arange(len(f["sizes"])), f["sizes"].to_numpy()) for f in found])
        docids, scores = _joined([f["docid"] for f in found]), np.concatenate([f["score"].to_numpy() for f in found])
        table = pa.table({"number": number, "score": scores, "docid": docids})
        order = pc.sort_indices(table, [("number", "ascending"), ("score", "descending"), ("docid", "ascending")], null_placement="at_start").to_numpy()
        number = number[order]
        rank = np.arange(1, len(order) + 1) - np.searchsorted(number, number)
        kept = rank <= k
        order, number = order[kept], pa.array(number[kept])
        columns = [found[0]["lang"].take(number), found[0]["qid"].take(number), docids.take(pa.array(order)), pa.array(scores[order]), pa.array(rank[kept])]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "qid", "docid", "score", "rank"])

    hits = reduce(DataFrame.unionByName, [scored(i) for i in range(n_blocks)])
    return hits.groupBy("block", "part").applyInArrow(merge, out)
