"""Retrieval inputs derived from the whole test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.positions import assign_positions

LANGS = ["de", "en", "es", "fr"]
TOPICS = 50


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_id(col: str):
    return F.col(col).cast("string")


def corpus_by_lang(spark, sf) -> DataFrame:
    """``(lang, docid, text)`` of all documents."""
    return table(spark, sf, "documents").select("lang", text_id("doc_id").alias("docid"), "text")


def corpus(spark, sf) -> DataFrame:
    """``(docid, text)`` of all documents, as one collection."""
    return corpus_by_lang(spark, sf).drop("lang")


def positioned_docs(spark, sf) -> DataFrame:
    """Documents of all languages with their position by ``doc_id``."""
    docs = table(spark, sf, "documents")
    return assign_positions(docs, "doc_id").withColumn("docid", text_id("doc_id"))


def queries(spark, sf) -> DataFrame:
    """``(qid, query)``: the whole benchmark."""
    return table(spark, sf, "benchmark").select(
        text_id("item_id").alias("qid"), F.col("text").alias("query")
    )


def title_queries(spark, sf) -> DataFrame:
    """``(lang, qid, query)``: title and declared language of every page."""
    return table(spark, sf, "pages").select(
        F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"),
        text_id("page_id").alias("qid"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("query"),
    )


def vectors(spark, sf) -> DataFrame:
    """``(docid, vec)`` of all embeddings."""
    return table(spark, sf, "embeddings").select(
        text_id("vec_id").alias("docid"), F.col("embedding").alias("vec")
    )


def vectors_by_lang(spark, sf) -> DataFrame:
    """``(lang, docid, vec)``: documents that have a vector."""
    langs = corpus_by_lang(spark, sf).select("lang", "docid")
    return vectors(spark, sf).join(langs, "docid").select("lang", "docid", "vec")


def scaled_vectors(spark, sf) -> DataFrame:
    """Embeddings stretched so that distance and inner product rank differently."""
    factor = (1 + F.col("vec_id") % 5).cast("double")
    return table(spark, sf, "embeddings").select(
        text_id("vec_id").alias("docid"),
        F.transform(F.col("embedding").cast("array<double>"), lambda x: x * factor).alias("vec"),
    )


def with_vectors(queries_df: DataFrame, vecs: DataFrame) -> DataFrame:
    """Queries with the vector of the same number, null where there is none."""
    side = vecs.select(F.col("docid").alias("qid"), F.col("vec").alias("qvec"))
    return queries_df.join(side, "qid", "left")


def query_vectors(spark, sf) -> DataFrame:
    """``(qid, query, qvec)`` of the whole benchmark."""
    return with_vectors(queries(spark, sf), vectors(spark, sf))


def token_vectors(vec):
    """Four token vectors of 16 dimensions out of one vector of 64."""
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice(vec, i * 16 + 1, 16))


def multivecs(spark, sf) -> DataFrame:
    """``(docid, vecs)``: every embedding as four token vectors."""
    return vectors(spark, sf).select("docid", token_vectors(F.col("vec")).alias("vecs"))


def query_multivecs(spark, sf) -> DataFrame:
    """``(qid, qvecs)`` of the benchmark items that have a vector."""
    rows = query_vectors(spark, sf).where(F.col("qvec").isNotNull())
    return rows.select("qid", token_vectors(F.col("qvec")).alias("qvecs"))


def sparse_vectors(spark, sf) -> DataFrame:
    """``(docid, sparse)``: entries of every embedding above 0.1."""
    entries = F.map_from_entries(
        F.filter(
            F.transform("embedding", lambda x, i: F.struct(i.alias("k"), x.alias("v"))),
            lambda e: e.v > F.lit(0.1).cast("float"),
        )
    )
    return table(spark, sf, "embeddings").select(text_id("vec_id").alias("docid"), entries.alias("sparse"))


def query_sparse(spark, sf) -> DataFrame:
    side = sparse_vectors(spark, sf).withColumnRenamed("docid", "qid")
    return queries(spark, sf).select("qid").join(side, "qid")


def qrels(spark, sf) -> DataFrame:
    """``(qid, docid, rel)``: every labelled document is judged for one topic, graded 0 to 3."""
    return table(spark, sf, "labels").select(
        (F.col("doc_id") % TOPICS).cast("string").alias("qid"),
        text_id("doc_id").alias("docid"),
        (F.col("quality") + 2 * F.col("toxic")).cast("int").alias("rel"),
    )


def title_qrels(spark, sf) -> DataFrame:
    """``(lang, qid, docid, rel)``: labelled documents judged for a page of their language.

    A page is the topic of the documents with its number modulo the number of topics.
    """
    judged = qrels(spark, sf).where(F.col("rel") > 0)
    langs = corpus_by_lang(spark, sf).select("lang", "docid")
    topics_ = title_queries(spark, sf).select("lang", "qid")
    return judged.join(langs, "docid").join(topics_, ["lang", "qid"]).select("lang", "qid", "docid", "rel")


def topics(spark, sf) -> DataFrame:
    """One topic per labelled document; it is its own positive or negative passage, or null."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    passage = F.array(F.struct(text_id("doc_id").alias("docid"), F.col("text").alias("text")))
    return (
        table(spark, sf, "labels")
        .join(docs, "doc_id")
        .select(
            text_id("doc_id").alias("query_id"),
            F.col("text").alias("query"),
            F.when(F.col("quality") == 1, passage).alias("positive_passages"),
            F.when(F.col("toxic") == 1, passage).alias("negative_passages"),
        )
    )


def label_centroids(spark, sf) -> DataFrame:
    """``(cell, centroid)``: mean vector of every label."""
    return (
        table(spark, sf, "embeddings")
        .select("label", F.posexplode("embedding").alias("dim", "x"))
        .groupBy("label", "dim")
        .agg(F.avg(F.col("x").cast("double")).alias("m"))
        .groupBy(F.col("label").cast("bigint").alias("cell"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda e: e.m).alias("centroid"))
    )
