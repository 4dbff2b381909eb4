"""Full-text index tables and BM25 search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.functions.constants import BM25_B, BM25_K1, MAX_HITS, TOKEN_MAX_LEN, TOKEN_MIN_LEN
from gleaner.operators.bounds import BROADCAST_ROWS, fits, local_rows, salted_join, small_table
from gleaner.operators.textblocks import block_hits, segment_documents, segment_freqs, segment_stats, written_segments
from gleaner.operators.topk import query_keys, rounded, top_k
from gleaner.plans.workspace import fresh_dir, stored


def normalize_query(df: DataFrame, col: str = "query", out: str | None = None) -> DataFrame:
    """Replace each reserved character of a keyword query by one space."""
    return df.withColumn(out or col, T.sanitized(F.col(col)))


def tokenize(
    df: DataFrame,
    id_col: str = "docid",
    text_col: str = "text",
    min_len: int = TOKEN_MIN_LEN,
    max_len: int = TOKEN_MAX_LEN,
) -> DataFrame:
    """``(id, pos, term)`` for every index term; ``pos`` counts all pieces from 0."""
    return (
        df.select(id_col, F.posexplode(T.pieces(F.col(text_col))).alias("pos", "term"))
        .where(T.is_token(F.col("term"), min_len, max_len))
        .withColumn("pos", F.col("pos").cast("bigint"))
    )


@dataclass(frozen=True)
class FullTextIndex:
    """Inverted index of one or several collections (``lang`` names the collection).

    ``postings(lang, term, docid, tf, dl)`` is distributed by document, so the
    score of a document is complete within one partition and only the best hits
    of every partition are shuffled.
    """

    postings: DataFrame
    doc_lengths: DataFrame
    doc_freqs: DataFrame
    corpus_stats: DataFrame
    # Number of hash partitions by docid that `postings` is known to have.
    partitions: int | None = None
    # What an index that isn't saved is made of: `(lang, docid, terms, dl)`, all tokens of a document in one partition.
    bags: DataFrame | None = None


def _with_lang(df: DataFrame) -> DataFrame:
    return df if "lang" in df.columns else df.withColumn("lang", F.lit(""))


def _doc_freqs(postings: DataFrame) -> DataFrame:
    return postings.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("df"))


# Bytes of text that one task tokenises, and whose postings it holds.
TEXT_BYTES = 16 << 20


def text_partitions(docs: DataFrame, text_col: str = "text", least: int = 1) -> int:
    """Partitions that hold at most about ``TEXT_BYTES`` of text each, but no fewer than ``least``."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(least, -(-size // TEXT_BYTES))


def build_fulltext_index(
    docs: DataFrame,
    id_col: str = "docid",
    text_col: str = "text",
    min_len: int = TOKEN_MIN_LEN,
    max_len: int = TOKEN_MAX_LEN,
    partitions: int | None = None,
) -> FullTextIndex:
    """Index tables of ``docs``; a ``lang`` column separates collections.

    The text is moved once, by docid; term counting then needs no further
    shuffle because all tokens of a document sit in one partition. There are at least ``partitions``
    of them, and more where the text asks for it.
    """
    narrow = _with_lang(docs).select("lang", F.col(id_col).alias("docid"), text_col)
    least = partitions or docs.sparkSession.sparkContext.defaultParallelism
    partitions = text_partitions(docs, text_col, least)
    spread = narrow.repartition(partitions, "docid")
    bags = spread.select(
        "lang", "docid", T.tokens(F.col(text_col), min_len, max_len).alias("terms")
    ).select("lang", "docid", "terms", F.size("terms").cast("bigint").alias("dl"))
    # explode() would also test every text for tokens before it is moved.
    postings = (
        bags.select("lang", "docid", "dl", F.explode_outer("terms").alias("term"))
        .where(F.col("term").isNotNull())
        .groupBy("lang", "docid", "dl", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
        .select("lang", "term", "docid", "tf", "dl")
    )
    # Already distributed by docid: no shuffle.
    doc_lengths = postings.select("lang", "docid", "dl").distinct()
    # A filter on the length would be pushed below the shuffle and tokenise twice,
    # so empty documents are left out while counting.
    n = F.count_if(F.col("dl") > 0)
    corpus_stats = (
        bags.groupBy("lang")
        .agg(n.alias("n"), (F.sum("dl") / F.nullif(n, F.lit(0))).alias("avgdl"))
        .where(F.col("n") > 0)
    )
    if "lang" not in docs.columns:
        corpus_stats = F.broadcast(corpus_stats)  # one collection, one row
    return FullTextIndex(postings, doc_lengths, _doc_freqs(postings), corpus_stats, partitions, bags)


def save_fulltext_index(
    index: FullTextIndex, name: str, path: str | None = None, buckets: int = 8
) -> FullTextIndex:
    """Write the index tables and return an index that reads them.

    An index that knows its partitions is written without another shuffle, one
    file per bucket; otherwise ``buckets`` says how many there shall be.

    Postings are bucketed by document and sorted by term inside each bucket:
    scoring then needs no shuffle by document, and the row-group statistics of
    the sorted ``term`` column let a search skip most of every file.
    """
    spark = index.postings.sparkSession
    root = path or fresh_dir(spark, f"index-{name}")
    postings = index.postings
    if index.partitions:
        buckets = index.partitions
    else:
        postings = postings.repartition(buckets, "docid")
    (
        postings.write.bucketBy(buckets, "docid")
        .sortBy("lang", "term", "docid")
        .mode("overwrite")
        .option("path", f"{root}/postings")
        .saveAsTable(f"{name}_postings")
    )
    # The other tables follow from the written postings; the text is not read again.
    postings = spark.table(f"{name}_postings")
    lengths = postings.groupBy("lang", "docid").agg(F.max("dl").alias("dl"))
    lengths.write.mode("overwrite").parquet(f"{root}/doc_lengths")
    doc_lengths = spark.read.parquet(f"{root}/doc_lengths")
    _doc_freqs(postings).sort("lang", "term").write.mode("overwrite").parquet(f"{root}/doc_freqs")
    corpus_stats = doc_lengths.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")
    )
    corpus_stats.write.mode("overwrite").parquet(f"{root}/corpus_stats")
    return open_fulltext_index(spark, name, root)


def open_fulltext_index(spark: SparkSession, name: str, root: str) -> FullTextIndex:
    """Index written by :func:`save_fulltext_index`."""
    written = spark.read.parquet(f"{root}/corpus_stats")
    few = local_rows(written, MAX_COLLECTIONS)
    return FullTextIndex(
        spark.table(f"{name}_postings"),
        spark.read.parquet(f"{root}/doc_lengths"),
        spark.read.parquet(f"{root}/doc_freqs"),
        written if few is None else few,
    )


def query_terms(queries: DataFrame, query_col: str = "query") -> DataFrame:
    """Distinct ``(lang, qid, term)`` of every sanitised query."""
    return (
        _with_lang(queries)
        .select("lang", "qid", F.explode_outer(F.array_distinct(T.tokens(F.col(query_col)))).alias("term"))
        .where(F.col("term").isNotNull())
    )


# Terms a pushed-down filter may list.
PUSHED_TERMS = 2_000
# Queries of which a task may hold a row per document.
PAIRED_QUERIES = 1_000
# Languages that a pushed-down filter may list.
MAX_LANGS = 100
# Collections whose statistics may travel as a local table.
MAX_COLLECTIONS = 10_000


def weighted_terms(terms: DataFrame, doc_freqs: DataFrame, stats: DataFrame) -> DataFrame:
    """Query terms with ``df, n, avgdl`` and the inverse document frequency."""
    n, df = F.col("n").cast("double"), F.col("df").cast("double")
    joined = terms.join(doc_freqs, ["lang", "term"]).join(stats, "lang")
    return joined.withColumn("idf", F.log(1 + (n - df + 0.5) / (df + 0.5)))


def postings_join(terms: DataFrame, index: FullTextIndex) -> DataFrame:
    """Query terms joined to the postings, document frequencies and statistics.

    One row per ``(query, term, document)``. The query side carries the
    statistics and is broadcast when it is proven small, so postings are never
    shuffled. A larger query side is joined by shuffle with salted terms, because
    a term may occur in a third of all documents.
    """
    postings, doc_freqs, stats = index.postings, index.doc_freqs, index.corpus_stats
    few = small_table(terms)
    if few is not None:
        vocabulary = few.column("term").unique().to_pylist()
        if 0 < len(vocabulary) <= PUSHED_TERMS:
            # Index terms are letters, digits and underscores: nothing to escape.
            listed = F.expr("term IN ({})".format(", ".join(f"'{t}'" for t in vocabulary)))
            postings, doc_freqs = postings.where(listed), doc_freqs.where(listed)
        local = terms.sparkSession.createDataFrame(few, terms.schema)
        weighted = weighted_terms(local, doc_freqs, stats)
        return postings.join(F.broadcast(weighted), ["lang", "term"])
    weighted = weighted_terms(terms, doc_freqs, stats)
    return salted_join(postings, weighted, ["lang", "term"], "docid", counted="df")


def bm25_weight(k1: float = BM25_K1, b: float = BM25_B) -> Column:
    """BM25 weight of one ``(term, document)`` row of :func:`postings_join`."""
    tf, dl = F.col("tf").cast("double"), F.col("dl").cast("double")
    return F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.col("avgdl")))


def bm25_scores(
    queries: DataFrame,
    index: FullTextIndex,
    boost: float = 1.0,
    k1: float = BM25_K1,
    b: float = BM25_B,
) -> DataFrame:
    """``score`` of every document that shares a term with a query."""
    keys = query_keys(queries)
    rows = postings_join(query_terms(queries), index)
    return rows.groupBy(*keys, "docid").agg(
        rounded(boost * F.sum(bm25_weight(k1, b))).alias("score")
    )


def _documents(index: FullTextIndex, weighted: DataFrame | None = None) -> DataFrame:
    """``(lang, docid, bags)``: the words of every document, or of those in the languages of the written query terms. Nothing is moved."""
    if index.bags is not None:
        bags = index.bags.select("lang", "docid", "dl", F.array_join("terms", " ").alias("words"), F.lit(None).cast("array<int>").alias("tfs"))
    else:
        postings = index.postings
        few = small_table(weighted.select("lang").distinct(), MAX_LANGS)
        if few is not None:
            postings = postings.where(F.col("lang").isin(few.column("lang").to_pylist()))
        bags = _counted(postings)
    return bags.groupBy("lang", "docid").agg(F.collect_list(F.struct("dl", "words", "tfs")).alias("bags"))


def documents_by_word(index: FullTextIndex) -> tuple[DataFrame, DataFrame]:
    """``(lang, docid, dl, words, tfs)``: the distinct words of every document in one string; and the statistics.

    For an index that isn't saved the text is moved and cut once; both follow from written segments.
    """
    if index.bags is not None:
        segments = written_segments(_documents(index))
        return segment_documents(segments, index.postings.schema["docid"]), segment_stats(segments)
    return _counted(index.postings), index.corpus_stats


def _counted(postings: DataFrame) -> DataFrame:
    bags = postings.groupBy("lang", "docid", "dl").agg(F.collect_list(F.struct("term", F.col("tf").cast("int").alias("tf"))).alias("e"))
    return bags.select("lang", "docid", "dl", F.array_join("e.term", " ").alias("words"), F.col("e.tf").alias("tfs"))


def bm25_search(
    queries: DataFrame,
    index: FullTextIndex,
    k: int = MAX_HITS,
    boost: float = 1.0,
    k1: float = BM25_K1,
    b: float = BM25_B,
) -> DataFrame:
    """``(qid, docid, score, rank)`` of the ``k`` most relevant documents per query.

    Queries with a ``lang`` column are answered from the collection of that language.
    A few queries keep a row per document of a partition; more of them meet written segments of the documents, in blocks.
    """
    terms = query_terms(queries)
    if fits(queries.select("qid"), PAIRED_QUERIES) and fits(terms.select("qid"), BROADCAST_ROWS):
        return top_k(bm25_scores(queries, index, boost, k1, b), k)
    if index.bags is None:
        weighted = stored(weighted_terms(terms, index.doc_freqs, index.corpus_stats), "query-terms")
        segments = written_segments(_documents(index, weighted))
    else:
        # The text is moved and cut once: statistics follow from the written segments.
        segments = written_segments(_documents(index))
        weighted = stored(weighted_terms(terms, segment_freqs(segments), segment_stats(segments)), "query-terms")
    hits = block_hits(weighted, segments, index.postings.schema["docid"], k, boost, k1, b)
    return hits.select(*query_keys(queries), "docid", "score", "rank")
