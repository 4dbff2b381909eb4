"""BM25 search that leaves out ranges of documents which can't reach the first hits.

Documents are dealt into ranges of some sixty of similar length, for which the largest term weights differ most. The
block table holds the largest weight of each term in each range; summed over the terms of a query it bounds the score of
every document there. A first pass scores the most promising ranges of each query; its ``k``-th best score is a threshold
that the final hits must reach, and only ranges whose bound reaches it are read at all. The result is that of an exhaustive search.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions.constants import BM25_B, BM25_K1
from gleaner.operators.bounds import BROADCAST_ROWS, broadcast_if_small, fits
from gleaner.operators.fulltext import FullTextIndex, documents_by_word, query_terms, weighted_terms
from gleaner.operators.topk import query_keys, rounded, top_k
from gleaner.plans.workspace import fresh_dir, stored

RANGE_DOCS = 64
#: Bands of document lengths: so many to each doubling.
BANDS = 4
SLABS = 64  # folders of the saved postings; a search opens those with ranges it needs
FIRST_RANGES = 8  # ranges of a query that are scored to get its threshold, for each ten hits
TASK_WORDS = 4_000_000  # running words whose postings a task sorts
BROADCAST_PAIRS = 20_000_000  # of a range and the number of a query that wants it: 4 bytes each
SLACK = 1e-5  # sums of weights in another order, and rounded scores


@dataclass(frozen=True)
class BlockIndex:
    """``postings(lang, term, docid, part, range, slab)`` and ``maxima(lang, term, range, slab, most)``; ``part`` is the weight without its idf."""

    postings: DataFrame
    maxima: DataFrame
    doc_freqs: DataFrame
    corpus_stats: DataFrame
    # What an index that isn't saved is made of: `(lang, docid, words, tfs, norm, range, slab)`, a row per document.
    docs: DataFrame | None = None
    factor: float = BM25_K1 + 1


def _postings(docs: DataFrame, factor: float) -> DataFrame:
    """A row per document and word, by the tasks that hold the documents."""
    others = [c for c in docs.columns if c not in ("words", "tfs", "norm")]
    each = F.explode(F.arrays_zip(F.split("words", " ").alias("term"), F.col("tfs").alias("tf"))).alias("e")
    tf = F.col("e.tf").cast("double")
    rows = docs.select(*others, "norm", each).withColumn("part", tf * F.lit(factor) / (tf + F.col("norm")))
    rest = [c for c in others if c not in ("lang", "docid", "range", "slab")]
    return rows.select("lang", F.col("e.term").alias("term"), "docid", "part", "range", "slab", *rest)


def build_block_index(
    index: FullTextIndex, range_docs: int = RANGE_DOCS, k1: float = BM25_K1, b: float = BM25_B
) -> BlockIndex:
    """Ranges and largest weights of an index. Documents stay where they are: a document's range follows from its length and id."""
    docs, stats = documents_by_word(index)
    stats = stored(stats, "collections")
    band = F.floor(F.log2(F.col("dl").cast("double")) * BANDS).cast("int").alias("band")
    lengths = docs if index.bags is not None else index.doc_lengths
    sizes = lengths.select("lang", band).groupBy("lang", "band").agg(F.count(F.lit(1)).alias("n_docs"))
    sizes = stored(sizes.withColumn("n_ranges", F.ceil(F.col("n_docs") / F.lit(range_docs))).drop("n_docs"), "bands")
    rows = docs.withColumn("band", band).join(broadcast_if_small(sizes), ["lang", "band"])
    rows = rows.join(broadcast_if_small(stats.select("lang", "avgdl")), "lang")
    # Numbers that fall together would only make one range of two.
    number = F.xxhash64("lang", "band", F.pmod(F.xxhash64("docid"), F.col("n_ranges")))
    norm = F.lit(k1) * (1 - b + b * F.col("dl").cast("double") / F.col("avgdl"))
    rows = rows.select("lang", "docid", "words", "tfs", norm.alias("norm"), number.alias("range"))
    rows = rows.withColumn("slab", F.pmod("range", F.lit(SLABS)).cast("int"))
    postings = _postings(rows, k1 + 1)
    return BlockIndex(postings, _maxima(postings), index.doc_freqs, stats, rows, k1 + 1)


def _maxima(postings: DataFrame) -> DataFrame:
    return postings.groupBy("lang", "term", "range", "slab").agg(F.max("part").alias("most"))


def save_block_index(index: BlockIndex, path: str | None = None) -> BlockIndex:
    """Write the index: postings in folders of ranges and sorted by range, the block table in parts of whole ranges that are sorted by term."""
    spark = index.postings.sparkSession
    root = path or fresh_dir(spark, "blocks")
    # Documents are moved, not their postings; all of a range come to one task, and a task writes into few folders.
    total = index.corpus_stats.agg(F.sum(F.col("n") * F.col("avgdl"))).first()[0] or 0
    folds = max(1, math.ceil(total / (SLABS * TASK_WORDS)))
    fold = F.pmod(F.xxhash64("range"), F.lit(folds)).cast("int").alias("fold")
    whole = index.postings if index.docs is None else index.docs
    dealt = whole.select("*", fold).repartition(SLABS * folds, "slab", "fold")
    rows = dealt if index.docs is None else _postings(dealt, index.factor)
    rows.drop("fold").sortWithinPartitions("slab", "range", "term").write.mode("overwrite").partitionBy("slab").parquet(f"{root}/postings")
    # Ranges are whole in a task: their largest weights need no shuffle of postings, and no global order.
    maxima = rows.groupBy("lang", "term", "range", "slab", "fold").agg(F.max("part").alias("most")).drop("fold")
    maxima.sortWithinPartitions("lang", "term").write.mode("overwrite").parquet(f"{root}/maxima")
    # Frequencies follow from the written postings.
    written = spark.read.parquet(f"{root}/postings")
    written.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("df")).write.mode("overwrite").parquet(f"{root}/doc_freqs")
    index.corpus_stats.write.mode("overwrite").parquet(f"{root}/corpus_stats")
    return open_block_index(spark, root)


def open_block_index(spark: SparkSession, root: str) -> BlockIndex:
    return BlockIndex(*(spark.read.parquet(f"{root}/{name}") for name in ("postings", "maxima", "doc_freqs", "corpus_stats")))


@dataclass(frozen=True)
class PrunedSearch:
    """The hits, and the postings that were scored for them."""

    hits: DataFrame
    read: DataFrame


def _scored(ranges: DataFrame, terms: DataFrame, index: BlockIndex, keys: list[str]) -> DataFrame:
    """Weights of the query terms in the postings of some ranges, a row per query, term and document.

    The ranges name the folders that are opened. Postings stay where they are if the query terms are few: they meet the terms, and then the
    numbers of the queries that want their range, which are broadcast in parts of bounded size. Otherwise they are joined by shuffle.
    """
    queries = terms.select("lang", "qid").distinct()
    number = F.hash("lang", "qid")
    apart = queries.agg(F.count("*") == F.count_distinct(number)).first()[0]
    if not (apart and fits(terms, BROADCAST_ROWS)):
        wanted = terms.join(ranges, ["lang", "qid"]).select("lang", "qid", "term", "idf", "range", "slab")
        rows = index.postings.join(wanted, ["lang", "term", "range", "slab"])
        return rows.select(*keys, "docid", (F.col("idf") * F.col("part")).alias("weight"))
    rows = index.postings.join(F.broadcast(terms.withColumn("number", number)), ["lang", "term"])
    wanted = stored(ranges.groupBy("lang", "range", "slab").agg(F.collect_list(number).alias("numbers")), "wanted-ranges")
    parts = max(1, math.ceil(ranges.count() / BROADCAST_PAIRS))
    found = []
    for part in range(parts):
        here = F.pmod("slab", F.lit(parts)) == part
        some = rows.where(here).join(F.broadcast(wanted.where(here)), ["lang", "range", "slab"])
        found.append(some.where(F.array_contains("numbers", F.col("number"))).select(*keys, "docid", (F.col("idf") * F.col("part")).alias("weight")))
    return reduce(DataFrame.unionAll, found)


def pruned_search(queries: DataFrame, index: BlockIndex, k: int = 10, first_ranges: int | None = None) -> PrunedSearch:
    """:func:`bm25_search` for small ``k``, with the postings it needed.

    Every query keeps its own threshold: with less than ``k`` documents in its first ranges nothing is left out.
    ``first_ranges`` changes what is read, never the hits.
    """
    keys = query_keys(queries)
    most = first_ranges or max(1, FIRST_RANGES * k // 10)
    terms = stored(weighted_terms(query_terms(queries), index.doc_freqs, index.corpus_stats).select("lang", "qid", "term", "idf"), "query-terms")
    bounds = index.maxima.join(broadcast_if_small(terms), ["lang", "term"])
    bounds = bounds.groupBy("lang", "qid", "range", "slab").agg(F.sum(F.col("idf") * F.col("most")).alias("bound"))
    bounds = stored(bounds, "range-bounds")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("bound"), "range"))
    first = bounds.withColumn("place", place).where(F.col("place") <= most).select("lang", "qid", "range", "slab", "bound")
    first = stored(first, "first-ranges")
    scored = stored(_scored(first, terms, index, keys), "first-weights")
    sums = lambda rows: rows.groupBy(*keys, "docid").agg(rounded(F.sum("weight")).alias("score"))
    reached = top_k(sums(scored), k).groupBy(*keys).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    least = reached.select(*keys, F.when(F.col("n") >= k, F.col("least") - SLACK).alias("least"))
    rest = bounds.join(broadcast_if_small(least), keys, "left").where("least is null or bound >= least")
    rest = stored(rest.join(first.select("lang", "qid", "range"), ["lang", "qid", "range"], "left_anti").select("lang", "qid", "range", "slab"), "more-ranges")
    read = scored.unionByName(_scored(rest, terms, index, keys))
    # A document lies in one range, so its weights are complete in one of the passes.
    return PrunedSearch(top_k(sums(read), k), read)


def block_max_search(queries: DataFrame, index: BlockIndex, k: int = 10) -> DataFrame:
    """``(qid, docid, score, rank)`` of the ``k`` most relevant documents, as an exhaustive search gives them."""
    return pruned_search(queries, index, k).hits
