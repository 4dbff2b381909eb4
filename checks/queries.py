"""One registered query per operator; each reads whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import inputs as I
from checks.oracle import K_EVAL, NPROBE
from gleaner.functions import text as T
from gleaner.functions import vectors as V
from gleaner.functions.encoders import HashingEncoder, HashingTokenEncoder
from gleaner.operators import ann, chunking, encode, evaluate, fulltext, fusion, hits, positions
from gleaner.operators import blockmax, phrases, pq, radii, rerank, routing, vectorsearch
from gleaner.operators.explain import explain_query
from gleaner.operators.topk import rounded, top_k
from gleaner.plans import load, maintenance, versions
from gleaner.plans.benchmark import run_benchmark
from gleaner.plans.embed import generate_vectors
from gleaner.plans.experiment import Collection, open_collection, run_experiment
from gleaner.plans.workspace import fresh_dir, stored
from gleaner.sources import corpus as C
from gleaner.sources import trec
from gleaner.sources import vectors as VF
from gleaner.streaming import jobs

QUERIES: dict[str, Callable] = {}


def query(fn: Callable) -> Callable:
    """Register a query; a trailing underscore avoids the name of an imported operator."""
    QUERIES[fn.__name__.rstrip("_")] = fn
    return fn


def long(df: DataFrame, vec: str, *keys, dim: str = "dim", val: str = "val") -> DataFrame:
    """One row per vector entry, so that arrays compare value by value."""
    return df.select(*keys, F.posexplode(vec).alias(dim, val)).select(
        *keys,
        F.col(dim).cast("bigint").alias(dim),
        F.col(val).cast("double").alias(val),
    )


# ---------------------------------------------------------------- sources


def write_corpora(spark, sf) -> str:
    """Corpora as ``corpus-{lang}`` folders of gzip JSON lines."""
    root = fresh_dir(spark, "corpora")
    for lang in I.LANGS:
        docs = I.corpus_by_lang(spark, sf).where(F.col("lang") == lang).select("docid", "text")
        docs.write.option("compression", "gzip").json(f"{root}/corpus-{lang}")
    return root


@query
def read_corpus(spark, sf):
    root = write_corpora(spark, sf)
    frames = [C.read_corpus(spark, f"{root}/corpus-{lang}", lang) for lang in I.LANGS]
    return reduce(DataFrame.unionByName, frames)


@query
def read_gzip_corpus(spark, sf):
    """All documents in gzip files of bounded size, read in ranges with the places of their lines."""
    path = f"{fresh_dir(spark, 'gzip')}/corpus.jsonl.gz"
    docs = I.corpus(spark, sf)
    files = fulltext.text_partitions(docs)  # a file is written, and gone through for its ranges, by one task
    docs = docs.repartitionByRange(files, "docid").sortWithinPartitions("docid")
    docs.write.option("compression", "gzip").json(path)
    rows = C.read_gzip_corpus(spark, path, "en", split_bytes=1 << 16)
    return rows.select("pos", "docid", "text", "lang")


def written_topics(spark, sf) -> DataFrame:
    root = fresh_dir(spark, "topics")
    # Null passage lists stay out of the JSON, as in the original files.
    I.topics(spark, sf).write.option("compression", "gzip").json(f"{root}/test.jsonl.gz")
    return C.read_topics(spark, root, "test")


def passage_counts(df: DataFrame) -> list:
    return [
        F.size("positive_passages").cast("bigint").alias("n_positive"),
        F.size("negative_passages").cast("bigint").alias("n_negative"),
    ]


@query
def read_topics(spark, sf):
    df = written_topics(spark, sf)
    return df.select("query_id", "query", *passage_counts(df), "split")


@query
def topic_qrels(spark, sf):
    return C.topic_qrels(C.fill_missing_passages(I.topics(spark, sf)))


@query
def pair_in_source_order(spark, sf):
    """A JSON-lines corpus, its ids in no order, paired with a vector file by place."""
    path, vec_path = fresh_dir(spark, "lines"), fresh_dir(spark, "fvecs")
    order = F.reverse(F.col("docid"))
    docs = I.corpus(spark, sf).repartitionByRange(5, order).sortWithinPartitions(order)
    docs.select("docid", "text").write.json(path)
    VF.write_fvecs(positioned_vectors(spark, sf), vec_path)
    corpus = positions.assign_source_positions(C.read_corpus(spark, path, "en"))
    paired = positions.zip_join(corpus, VF.read_fvecs(spark, vec_path))
    return paired.select("pos", "docid", F.length("text").cast("bigint").alias("n_chars"), F.col("vec")[0].cast("double").alias("first"))


@query
def read_all_languages(spark, sf):
    docs, _ = C.read_all_languages(spark, write_corpora(spark, sf))
    return docs.select("lang", "docid", "text")


@query
def load_summary(spark, sf):
    return C.load_summary(*C.read_all_languages(spark, write_corpora(spark, sf)))


@query
def load_totals(spark, sf):
    return C.load_totals(load_summary(spark, sf))


def positioned_vectors(spark, sf) -> DataFrame:
    rows = I.table(spark, sf, "embeddings").select("vec_id", "embedding")
    return positions.assign_positions(rows, "vec_id").select(
        "pos", "vec_id", F.col("embedding").alias("vec")
    )


@query
def read_fvecs(spark, sf):
    path = fresh_dir(spark, "fvecs")
    VF.write_fvecs(positioned_vectors(spark, sf), path)
    return long(VF.read_fvecs(spark, path), "vec", "pos")


@query
def read_ivecs(spark, sf):
    found = vectorsearch.knn_join(I.query_vectors(spark, sf), I.vectors(spark, sf), 10)
    neighbours = found.groupBy(F.col("qid").cast("bigint").alias("qid")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", F.col("docid").cast("int").alias("id")))),
            lambda e: e.id,
        ).alias("vec")
    )
    # Stored first: the positions and the rows must see the same neighbours.
    neighbours = stored(neighbours, "neighbours")
    path = fresh_dir(spark, "ivecs")
    VF.write_ivecs(positions.assign_positions(neighbours, "qid"), path)
    return VF.read_ivecs(spark, path).select("pos", F.posexplode("vec").alias("place", "neighbour")).select(
        "pos", F.col("place").cast("bigint").alias("place"), "neighbour"
    )


@query
def read_sparse_json(spark, sf):
    path = fresh_dir(spark, "sparse") + ".json"
    rows = I.sparse_vectors(spark, sf).where(F.size("sparse") > 0)
    # Lines of one JSON array; the docid travels as entry -1.
    tagged = F.map_concat(
        F.create_map(F.lit(-1), F.col("docid").cast("float")), F.col("sparse").cast("map<int,float>")
    )
    rows.select(F.concat(F.to_json(tagged), F.lit(",")).alias("value")).write.text(path)
    back = VF.sparse_convert(VF.read_sparse(spark, path).withColumn(
        "docid", F.try_element_at("sparse", F.lit(-1)).cast("bigint").cast("string")
    ).select("docid", "sparse"), "rows")
    return back.where(F.col("idx") >= 0).select("docid", "idx", F.col("val").cast("double").alias("val"))


@query
def read_sparse_binary(spark, sf):
    path = fresh_dir(spark, "sparse") + ".data"
    ids = positioned_vectors(spark, sf).select("pos", F.col("vec_id").cast("string").alias("docid"))
    rows = VF.sparse_convert(I.sparse_vectors(spark, sf).join(ids, "docid"), "coo")
    VF.write_sparse(rows.select("pos", "indices", "values"), path)
    # Positions of a folder of binary files order the rows; ranks restore the row numbers.
    back = stored(VF.read_sparse(spark, path).withColumnRenamed("pos", "place"), "sparse")
    back = positions.assign_positions(back, "place").select("pos", "sparse")
    return VF.sparse_convert(back, "rows").select("pos", "idx", F.col("val").cast("double").alias("val"))


@query
def read_multivectors(spark, sf):
    path = fresh_dir(spark, "multivec")
    rows = I.multivecs(spark, sf).select(F.col("docid").cast("bigint").alias("doc"), "vecs")
    VF.write_multivectors(rows, path, pos="doc")
    back = stored(VF.read_multivectors(spark, path).withColumnRenamed("pos", "place"), "multivec")
    back = positions.assign_positions(back, "place")
    ids = positions.assign_positions(rows.select("doc"), "doc")
    tokens = back.join(ids, "pos").select("doc", F.posexplode("vecs").alias("tok", "vec"))
    return long(tokens.withColumn("tok", F.col("tok").cast("bigint")), "vec", "doc", "tok")


@query
def read_qrels(spark, sf):
    path = fresh_dir(spark, "qrels")
    trec.write_qrels(I.qrels(spark, sf), path)
    return trec.read_qrels(spark, path)


def evaluation_runs(spark, sf) -> DataFrame:
    """Keyword and vector run of the benchmark with their run ids."""
    bm25 = bm25_run(spark, sf, K_EVAL)
    dense = vectorsearch.dense_search(I.query_vectors(spark, sf), I.vectors(spark, sf), K_EVAL)
    cols = ["run_id", "qid", "docid", "score", "rank"]
    runs = (
        bm25.withColumn("run_id", F.lit("en_bm25"))
        .select(*cols)
        .unionByName(dense.withColumn("run_id", F.lit("en_dense")).select(*cols))
    )
    # Runs are written before they are judged.
    return stored(runs, "runs")


@query
def read_runs(spark, sf):
    folder = fresh_dir(spark, "runs")
    trec.write_scores(bm25_run(spark, sf, K_EVAL), f"{folder}/en_bm25.txt")
    dense = vectorsearch.dense_search(I.query_vectors(spark, sf), I.vectors(spark, sf), K_EVAL)
    trec.write_trec_run(dense, f"{folder}/en_dense.txt")
    return trec.read_runs(spark, folder, "en")


# ------------------------------------------------------------------ sinks


def loaded_collection(spark, sf) -> str:
    """All documents loaded language by language, paired with vectors by position."""
    path = fresh_dir(spark, "collection")
    vectors = stored(positioned_vectors(spark, sf).select("pos", "vec"), "vectors")
    docs = I.table(spark, sf, "documents").select("doc_id", "lang", "text")
    for lang in I.LANGS:
        rows = positions.assign_positions(docs.where(F.col("lang") == lang), "doc_id")
        rows = rows.select("pos", F.col("doc_id").cast("string").alias("docid"), "text")
        load.load_collection(rows, vectors, path, lang)
    return path


@query
def load_collection(spark, sf):
    return load.read_collection(spark, loaded_collection(spark, sf)).select(
        "lang", "id", "base_id", "docid_col", "fulltext_col",
        F.size("dense_col").cast("bigint").alias("dim"),
        F.get("dense_col", F.lit(0)).cast("double").alias("first_value"),
    )


@query
def replace_collection(spark, sf):
    """Two loads of every language; the second of one fails, so its first stays. Old readers keep what they began with."""
    root = fresh_dir(spark, "versions")
    vectors = stored(positioned_vectors(spark, sf).select("pos", "vec"), "vectors")
    docs = I.table(spark, sf, "documents").select("doc_id", "lang", "text")
    loads = {}
    for lang in I.LANGS:
        rows = positions.assign_positions(docs.where(F.col("lang") == lang), "doc_id")
        loads[lang] = stored(rows.select("pos", F.col("doc_id").cast("string").alias("docid"), "text"), "rows")
        versions.replace_collection(loads[lang], vectors, root, lang)
    old = versions.snapshot(spark, root)
    for lang, rows in loads.items():
        new = rows.withColumn("text", F.concat("text", F.lit(" (new)")))
        versions.replace_collection(new, vectors, root, lang, is_bad=(F.col("lang") == "de") & (F.col("id") % 7 == 3))
    both = {"old": versions.read_snapshot(spark, root, old), "new": versions.read_snapshot(spark, root)}
    parts = [df.select(F.lit(v).alias("version"), "lang", "id", "docid_col", "fulltext_col") for v, df in both.items()]
    return reduce(DataFrame.union, parts)


@query
def write_fvecs(spark, sf):
    path = fresh_dir(spark, "fvecs")
    VF.write_fvecs(positioned_vectors(spark, sf), path)
    ids = positioned_vectors(spark, sf).select("pos", F.col("vec_id").cast("string").alias("docid"))
    return VF.read_fvecs(spark, path).join(ids, "pos").select(
        "docid", rounded(V.dot(F.col("vec"), F.col("vec"))).alias("norm2"),
        F.size("vec").cast("bigint").alias("dim"),
    )


@query
def write_multivectors(spark, sf):
    path = fresh_dir(spark, "multivec")
    rows = I.multivecs(spark, sf).withColumn("pos", F.col("docid").cast("bigint"))
    VF.write_multivectors(rows, path)
    back = stored(VF.read_multivectors(spark, path).withColumnRenamed("pos", "place"), "multivec")
    ids = positions.assign_positions(rows.select(F.col("pos").alias("doc")), "doc")
    flat = F.flatten("vecs").cast("array<double>")
    total = F.aggregate(flat, F.lit(0.0), lambda acc, x: acc + x)
    return positions.assign_positions(back, "place").join(ids, "pos").select(
        F.col("doc").cast("string").alias("docid"),
        F.size("vecs").cast("bigint").alias("n_tokens"),
        rounded(total).alias("total"),
    )


@query
def write_trec_run(spark, sf):
    folder = fresh_dir(spark, "runs")
    trec.write_trec_run(bm25_run(spark, sf, 100), f"{folder}/en_bm25.txt")
    return trec.read_runs(spark, folder, "en").drop("run_id")


@query
def write_score_file(spark, sf):
    folder = fresh_dir(spark, "runs")
    trec.write_scores(bm25_run(spark, sf, 100), f"{folder}/en_bm25.txt")
    return trec.read_scores(spark, f"{folder}/en_bm25_score.txt")


@query
def materialize_once(spark, sf):
    path = maintenance.artifact_path(fresh_dir(spark, "artifacts"), "sizes", "en", "none")

    def sizes() -> DataFrame:
        return I.table(spark, sf, "documents").groupBy("lang").agg(
            F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars")
        )

    maintenance.materialize(spark, sizes, path)
    # The second call must not compute anything.
    return maintenance.materialize(spark, lambda: sizes().limit(0), path)


# -------------------------------------------- projections, filters, per row


@query
def select_queries(spark, sf):
    return C.select_queries(I.topics(spark, sf))


@query
def filter_languages(spark, sf):
    docs = I.table(spark, sf, "documents").select("lang", "doc_id", "n_chars")
    return C.filter_languages(docs, ["fr", "de"])


@query
def normalize_query(spark, sf):
    return fulltext.normalize_query(I.queries(spark, sf))


@query
def tokenize(spark, sf):
    return fulltext.tokenize(I.corpus(spark, sf))


@query
def assign_positions(spark, sf):
    docs = I.table(spark, sf, "documents").select("doc_id", "lang")
    return positions.assign_positions(docs, ["lang", "doc_id"])


def document_positions(spark, sf) -> DataFrame:
    return positions.assign_positions(I.table(spark, sf, "documents").select("doc_id"), "doc_id")


@query
def assign_base_id(spark, sf):
    return positions.assign_base_id(document_positions(spark, sf))


@query
def cap_rows(spark, sf):
    return positions.cap_rows(document_positions(spark, sf), 300)


@query
def slice_range(spark, sf):
    return positions.slice_range(document_positions(spark, sf), 100, 400)


@query
def split_ranges(spark, sf):
    docs = document_positions(spark, sf)
    total = docs.count()
    return positions.split_ranges(docs, [total // 4, total // 2, total])


@query
def fill_missing_passages(spark, sf):
    df = C.fill_missing_passages(I.topics(spark, sf))
    return df.select("query_id", *passage_counts(df))


@query
def vector_to_text(spark, sf):
    text = encode.vector_to_text(I.vectors(spark, sf)).drop("vec")
    return long(encode.text_to_vector(text), "vec", "docid")


@query
def sparse_convert(spark, sf):
    there = VF.sparse_convert(I.sparse_vectors(spark, sf), "coo")
    rows = VF.sparse_convert(VF.sparse_convert(there, "map"), "rows")
    return rows.select("docid", "idx", F.col("val").cast("double").alias("val"))


@query
def sign_binarize(spark, sf):
    bits = encode.sign_binarize(I.vectors(spark, sf))
    return bits.select("docid", F.posexplode("bits").alias("dim", "bit")).withColumn(
        "dim", F.col("dim").cast("bigint")
    )


@query
def l2_normalize(spark, sf):
    rows = long(encode.l2_normalize(I.scaled_vectors(spark, sf)), "vec", "docid")
    return rows.withColumn("val", rounded(F.col("val")))


@query
def validate_vectors(spark, sf):
    return encode.validate_vectors(I.vectors(spark, sf), I.corpus(spark, sf), 64)


@query
def chunk_documents(spark, sf):
    return chunking.chunk_documents(I.corpus(spark, sf), mode="fixed")


@query
def chunk_documents_overlap(spark, sf):
    return chunking.chunk_documents(I.corpus(spark, sf), overlap=128, mode="fixed")


@query
def chunk_documents_recursive(spark, sf):
    chunks = chunking.chunk_documents(I.corpus(spark, sf), mode="recursive")
    # A group is the chunks of one document.
    ordered = F.array_sort(F.collect_list(F.struct("chunk_no", "chunk")))
    joined = F.array_join(F.transform(ordered, lambda c: c.chunk), "")
    return chunks.groupBy("docid").agg(
        F.regexp_replace(joined, r"\s+", "").alias("letters"),
        F.bool_and(F.char_length("chunk") <= 512).alias("all_fit"),
    )


@query
def truncate_text(spark, sf):
    return chunking.truncate_text(I.corpus(spark, sf), 8192)


@query
def parse_hits(spark, sf):
    run = bm25_run(spark, sf, 10)
    # A group is one response of at most ten hits.
    entry = F.struct("rank", "docid", "score")
    responses = run.groupBy("qid").agg(F.array_sort(F.collect_list(entry)).alias("hits"))
    flat = F.transform(
        "hits",
        lambda h: F.struct(
            h.docid.alias("docid_col"), F.lit(0.5).alias("_score"), h.score.alias("_keyword_score")
        ),
    )
    nested = F.transform(
        "hits",
        lambda h: F.struct(h.score.alias("_score"), F.struct(h.docid.alias("docid_col")).alias("_source")),
    )
    nested = F.struct(F.struct(nested.alias("hits")).alias("hits"))
    broken = F.concat(F.to_json(flat), F.lit("]"))
    shapes = {"list": F.to_json(flat), "nested": F.to_json(nested), "broken": broken}
    stacked = responses.select("qid", F.explode(F.create_map(
        *[c for name, text in shapes.items() for c in (F.lit(name), text)]
    )).alias("shape", "response"))
    return hits.parse_hits(stacked.select(F.concat_ws(":", "shape", "qid").alias("qid"), "response"))


# ------------------------------------------------------------------ joins


@query
def zip_join(spark, sf):
    docs = document_positions(spark, sf).select("pos", F.col("doc_id").cast("string").alias("docid"))
    return positions.zip_join(docs, positioned_vectors(spark, sf)).select(
        "pos", "docid", F.get("vec", F.lit(0)).cast("double").alias("first_value"),
        F.size("vec").cast("bigint").alias("dim"),
    )


@query
def zip_queries(spark, sf):
    items = positions.assign_positions(I.table(spark, sf, "benchmark"), "item_id").select(
        "pos", F.col("item_id").cast("string").alias("qid"), F.col("text").alias("query")
    )
    paired = routing.zip_queries(items, positioned_vectors(spark, sf), strict=False)
    return paired.select(
        "pos", "qid", "query", "target", F.get("qvec", F.lit(0)).cast("double").alias("first_value")
    )


@query
def postings_join(spark, sf):
    index = fulltext.build_fulltext_index(I.corpus(spark, sf))
    rows = fulltext.postings_join(fulltext.query_terms(I.queries(spark, sf)), index)
    return rows.select("qid", "term", "docid", "tf", "dl", "df", "n", rounded(F.col("avgdl")).alias("avgdl"))


@query
def knn_join(spark, sf):
    return vectorsearch.knn_join(I.query_vectors(spark, sf), I.vectors(spark, sf), 10)


@query
def knn_join_pruned(spark, sf):
    index = radii.build_ball_index(I.vectors(spark, sf))
    return radii.pruned_knn_join(I.query_vectors(spark, sf), index, 10)


def legs(spark, sf, k: int = K_EVAL) -> list[DataFrame]:
    dense = vectorsearch.dense_search(I.query_vectors(spark, sf), I.vectors(spark, sf), k)
    return [bm25_run(spark, sf, k), fusion.similarity_run(dense)]


@query
def fuse_join(spark, sf):
    return fusion.fuse_join(*legs(spark, sf)).withColumn("right_score", rounded(F.col("right_score")))


@query
def judge_run(spark, sf):
    judged = evaluate.judge_run(evaluation_runs(spark, sf), I.qrels(spark, sf))
    return judged.select("run_id", "qid", "docid", "rank", "rel")


@query
def missing_topics(spark, sf):
    dense = vectorsearch.dense_search(I.query_vectors(spark, sf), I.vectors(spark, sf), 10)
    return evaluate.missing_topics(dense, I.qrels(spark, sf))


@query
def route_by_language(spark, sf):
    return routing.route_by_language(I.title_queries(spark, sf), I.corpus_by_lang(spark, sf)).select(
        "qid", "lang", "query", "collection", "n_docs"
    )


def label_index(spark, sf) -> ann.VectorIndex:
    return ann.build_vector_index(I.vectors(spark, sf), centroids=I.label_centroids(spark, sf))


def vector_queries(spark, sf) -> DataFrame:
    return I.query_vectors(spark, sf).where(F.col("qvec").isNotNull()).select("qid", "qvec")


@query
def approx_knn_join(spark, sf):
    return ann.approx_knn_join(vector_queries(spark, sf), label_index(spark, sf), 10, NPROBE)


# -------------------------------------------------- index and table builds


@query
def postings(spark, sf):
    return fulltext.build_fulltext_index(I.corpus(spark, sf)).postings.select("term", "docid", "tf")


@query
def doc_lengths(spark, sf):
    return fulltext.build_fulltext_index(I.corpus(spark, sf)).doc_lengths.select("docid", "dl")


@query
def doc_freqs(spark, sf):
    return fulltext.build_fulltext_index(I.corpus(spark, sf)).doc_freqs.select("term", "df")


@query
def corpus_stats(spark, sf):
    stats = fulltext.build_fulltext_index(I.corpus(spark, sf)).corpus_stats
    return stats.select("n", rounded(F.col("avgdl")).alias("avgdl"))


@query
def corpus_stats_by_language(spark, sf):
    stats = fulltext.build_fulltext_index(I.corpus_by_lang(spark, sf)).corpus_stats
    return stats.select("lang", "n", rounded(F.col("avgdl")).alias("avgdl"))


@query
def build_vector_index(spark, sf):
    return label_index(spark, sf).cells.select("docid", "cell")


@query
def build_vector_index_kmeans(spark, sf):
    return ann.build_vector_index(I.vectors(spark, sf), n_cells=16).cells.select("docid", "cell")


@query
def reconcile_counts(spark, sf):
    table = load.read_collection(spark, loaded_collection(spark, sf))
    return load.reconcile_counts(I.corpus_by_lang(spark, sf), table)


def marked_docs(spark, sf) -> DataFrame:
    """Positioned documents; the toxic ones are rows a load cannot take."""
    docs = positions.assign_positions(I.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return docs.join(I.table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")


@query
def batch_report(spark, sf):
    return load.batch_report(marked_docs(spark, sf), 100, F.col("toxic") == 1)


@query
def good_batches(spark, sf):
    return load.good_batches(marked_docs(spark, sf), 10, F.col("toxic") == 1).select("doc_id", "lang", "pos")


@query
def collect_table_stats(spark, sf):
    return maintenance.collect_table_stats(I.table(spark, sf, "documents"), exact=True)


@query
def compact_table(spark, sf):
    root = fresh_dir(spark, "compact")
    I.table(spark, sf, "documents").repartition(16).write.parquet(f"{root}/small")
    return maintenance.compact_table(spark, f"{root}/small", f"{root}/compact", 4, ["lang", "doc_id"]).select(
        "doc_id", "lang", "source", "n_chars", "text"
    )


@query
def concat_chunk_vectors(spark, sf):
    number = F.col("docid").cast("bigint")
    chunks = I.multivecs(spark, sf).select(
        F.floor(number / 4).cast("bigint").alias("docid"), (number % 4).alias("chunk_no"), "vecs"
    )
    tokens = encode.concat_chunk_vectors(chunks).select("docid", F.posexplode("vecs").alias("tok", "vec"))
    return long(tokens.withColumn("tok", F.col("tok").cast("bigint")), "vec", "docid", "tok")


@query
def pool_vectors(spark, sf):
    frames = [
        long(encode.pool_vectors(I.multivecs(spark, sf), method=m), "vec", "docid").withColumn("method", F.lit(m))
        for m in ("cls", "mean", "max")
    ]
    return reduce(DataFrame.unionByName, frames).withColumn("val", rounded(F.col("val")))


def timings(spark, sf) -> DataFrame:
    return I.table(spark, sf, "events").select(
        F.lit("en").alias("lang"), F.col("event_type").alias("query_type"), F.col("value").alias("seconds")
    )


@query
def latency_summary(spark, sf):
    return evaluate.latency_summary(timings(spark, sf))


@query
def average_runs(spark, sf):
    rows = I.table(spark, sf, "events").select(
        F.col("event_type").alias("run_id"), F.lit("value").alias("metric"), "value"
    )
    return evaluate.average_runs(rows)


# ----------------------------------------------------------------- search


def bm25_run(spark, sf, k: int) -> DataFrame:
    index = fulltext.build_fulltext_index(I.corpus(spark, sf))
    return fulltext.bm25_search(I.queries(spark, sf), index, k)


@query
def bm25_search(spark, sf):
    return bm25_run(spark, sf, 1000)


@query
def bm25_search_saved_index(spark, sf):
    index = fulltext.build_fulltext_index(I.corpus(spark, sf), partitions=8)
    saved = fulltext.save_fulltext_index(index, "gleaner_check")
    return fulltext.bm25_search(I.queries(spark, sf), saved, 100)


@query
def bm25_search_by_language(spark, sf):
    index = fulltext.build_fulltext_index(I.corpus_by_lang(spark, sf))
    return fulltext.bm25_search(I.title_queries(spark, sf), index, 100)


@query
def dense_search(spark, sf):
    return vectorsearch.dense_search(I.query_vectors(spark, sf), I.vectors(spark, sf), 1000)


@query
def dense_search_blocked(spark, sf):
    """The way taken when the query set is too large to broadcast."""
    return vectorsearch.dense_search(
        I.query_vectors(spark, sf), I.vectors(spark, sf), 100, query_broadcast_rows=0
    )


def scaled_queries(spark, sf) -> DataFrame:
    return I.with_vectors(I.queries(spark, sf), I.scaled_vectors(spark, sf))


@query
def dense_search_ip(spark, sf):
    return vectorsearch.dense_search(scaled_queries(spark, sf), I.scaled_vectors(spark, sf), 100, "ip")


@query
def dense_search_unnormalized(spark, sf):
    return vectorsearch.dense_search(scaled_queries(spark, sf), I.scaled_vectors(spark, sf), 100)


@query
def block_max_search(spark, sf):
    """The first ten hits without the ranges of documents that can't reach them."""
    index = fulltext.build_fulltext_index(I.corpus(spark, sf))
    blocks = blockmax.save_block_index(blockmax.build_block_index(index, range_docs=16))
    return blockmax.block_max_search(I.queries(spark, sf), blocks, 10)


@query
def pq_search(spark, sf):
    """Every twentieth vector against all codes: how many hits there are, and whether nine in ten are the exact ones."""
    vectors = I.vectors(spark, sf)
    asked = vectors.where(F.col("docid").cast("long") % 20 == 0).select(F.col("docid").alias("qid"), F.col("vec").alias("qvec"))
    found = stored(pq.pq_search(asked, pq.build_code_index(vectors), 10), "pq")
    exact = vectorsearch.dense_search(asked, vectors, 10)
    right = exact.join(found.select("qid", "docid", F.lit(1).alias("hit")), ["qid", "docid"], "left")
    share = right.agg((F.count("hit") >= 0.9 * F.count("*")).alias("recall_reached"))
    sizes = found.agg(F.count_distinct("qid").alias("n_queries"), F.count("*").alias("n_hits"))
    return sizes.crossJoin(share)  # one row each


@query
def phrase_search(spark, sf):
    """The first three words of every benchmark text as a phrase, and the fifth and sixth with a slop."""
    words = F.filter(T.pieces(F.col("query")), lambda p: p != "")
    texts = I.queries(spark, sf).select("qid", words.alias("w"))
    clause = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    asked = texts.select("qid", F.concat(F.lit('"'), clause(1, 3), F.lit('" "'), clause(5, 2), F.lit('"~3')).alias("query"))
    return phrases.phrase_search(asked, phrases.build_positional_index(I.corpus(spark, sf)), 100)


@query
def sparse_search(spark, sf):
    return vectorsearch.sparse_search(I.query_sparse(spark, sf), I.sparse_vectors(spark, sf), 100)


@query
def maxsim_search(spark, sf):
    return vectorsearch.maxsim_search(I.query_multivecs(spark, sf), I.multivecs(spark, sf), 100)


@query
def hybrid_search(spark, sf):
    index = fulltext.build_fulltext_index(I.corpus(spark, sf))
    return fusion.hybrid_search(I.query_vectors(spark, sf), index, I.vectors(spark, sf), 100)


@query
def hybrid_fallback(spark, sf):
    """Queries whose vector has an odd label come without vector."""
    labels = I.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("qid"), "label")
    known = F.when(F.col("label") % 2 == 0, F.col("qvec"))
    mixed = I.query_vectors(spark, sf).join(labels, "qid", "left").withColumn("qvec", known).drop("label")
    index = fulltext.build_fulltext_index(I.corpus(spark, sf))
    return fusion.hybrid_search(mixed, index, I.vectors(spark, sf), 100)


@query
def ann_search(spark, sf):
    return ann.ann_search(vector_queries(spark, sf), label_index(spark, sf), 100, NPROBE)


@query
def ann_search_kmeans(spark, sf):
    index = ann.build_vector_index(I.vectors(spark, sf), n_cells=16)
    saved = ann.save_vector_index(index, fresh_dir(spark, "ann"))
    return ann.ann_search(vector_queries(spark, sf), saved, 100)


@query
def fusion_rrf(spark, sf):
    return fusion.fuse_rrf(legs(spark, sf), k=100)


@query
def fusion_weighted(spark, sf):
    return fusion.fuse_weighted(legs(spark, sf), "0.6,0.4", 100)


@query
def fusion_normalized(spark, sf):
    return fusion.fuse_normalized(legs(spark, sf), 100)


def first_stage(spark, sf) -> DataFrame:
    return vectorsearch.dense_search(I.query_vectors(spark, sf), I.vectors(spark, sf), 20)


@query
def maxsim_rerank(spark, sf):
    return rerank.maxsim_rerank(
        first_stage(spark, sf), I.query_multivecs(spark, sf), I.multivecs(spark, sf), 20
    )


@query
def bit_rerank(spark, sf):
    return rerank.bit_rerank(
        first_stage(spark, sf), I.query_multivecs(spark, sf), I.multivecs(spark, sf), 20
    )


@query
def top_k_(spark, sf):
    docs = I.table(spark, sf, "documents").select("lang", F.col("doc_id").cast("string").alias("docid"), "n_chars")
    return top_k(docs, 10, score="n_chars", by=["lang"])


@query
def run_experiment_(spark, sf):
    queries = I.with_vectors(I.title_queries(spark, sf), I.vectors(spark, sf))
    collection = Collection(
        fulltext.build_fulltext_index(I.corpus_by_lang(spark, sf)), I.vectors_by_lang(spark, sf)
    )
    return run_experiment(queries, collection, ["bm25", "dense", "hybrid_dense_bm25"], I.LANGS, 100)


@query
def explain_query_(spark, sf):
    index = fulltext.build_fulltext_index(I.corpus(spark, sf))
    return explain_query(I.query_vectors(spark, sf), index, I.vectors(spark, sf), 10)


# ------------------------------------------------------------- evaluation


@query
def recall_at_k(spark, sf):
    return evaluate.recall_at_k(evaluation_runs(spark, sf), I.qrels(spark, sf), 10)


@query
def ndcg_at_k(spark, sf):
    return evaluate.ndcg_at_k(evaluation_runs(spark, sf), I.qrels(spark, sf), 10)


@query
def mean_over_topics(spark, sf):
    per_topic = evaluate.recall_at_k(evaluation_runs(spark, sf), I.qrels(spark, sf), 100)
    return evaluate.mean_over_topics(per_topic, "recall")


@query
def evaluate_runs(spark, sf):
    return evaluate.evaluate_runs(
        evaluation_runs(spark, sf), I.qrels(spark, sf), ["recall@100", "ndcg@100"]
    )


@query
def evaluate_runs_by_score(spark, sf):
    return evaluate.evaluate_runs(evaluation_runs(spark, sf), I.qrels(spark, sf), order="score")


@query
def final_report(spark, sf):
    metrics = evaluate.evaluate_runs(evaluation_runs(spark, sf), I.qrels(spark, sf))
    name = F.col("query_type")
    run_id = F.when(name == "click", "en_bm25").when(name == "view", "en_dense").otherwise(name)
    latencies = evaluate.latency_summary(timings(spark, sf).withColumn("run_id", run_id), ["run_id"])
    return evaluate.final_report(metrics, latencies)


@query
def run_benchmark_(spark, sf):
    """Load, search, write, read back and judge; the time column is left out."""
    table = load.read_collection(spark, loaded_collection(spark, sf))
    docs = table.select("lang", F.col("docid_col").alias("docid"), F.col("fulltext_col").alias("text"))
    built = fulltext.build_fulltext_index(docs, partitions=8)
    index = fulltext.save_fulltext_index(built, "gleaner_benchmark")
    asked = I.with_vectors(I.title_queries(spark, sf), I.vectors(spark, sf))
    report = run_benchmark(
        asked, open_collection(table, index), I.title_qrels(spark, sf), ["bm25", "dense"],
        ["de", "en", "es", "fr"], fresh_dir(spark, "benchmark"), 100,
    )
    return report.select("run_id", "recall_at_10", "ndcg_at_10", "queries")


@query
def ann_recall(spark, sf):
    exact = vectorsearch.dense_search(I.query_vectors(spark, sf), I.vectors(spark, sf), 10)
    found = ann.ann_search(vector_queries(spark, sf), label_index(spark, sf), 10, NPROBE)
    return evaluate.ann_recall(found, exact, 10)


# -------------------------------------------------------------- streaming


def streamed(spark, df: DataFrame, label: str, files: int = 4, per_batch: int = 2) -> DataFrame:
    """``df`` written to a folder and read as a stream of several micro-batches."""
    path = fresh_dir(spark, label)
    df.repartition(files).write.parquet(path)
    return jobs.read_stream(spark, path, df.schema, per_batch)


@query
def stream_load(spark, sf):
    out = fresh_dir(spark, "stream-load")
    stream = streamed(spark, I.corpus_by_lang(spark, sf), "incoming")
    jobs.stream_load(stream, I.vectors(spark, sf), out)
    schema = I.corpus_by_lang(spark, sf).join(I.vectors(spark, sf), "docid").schema
    return jobs.read_loaded(spark, out, schema).select(
        "lang", "docid", "text", F.get("vec", F.lit(0)).cast("double").alias("first_value")
    )


@query
def stream_encode(spark, sf):
    stream = streamed(spark, I.corpus(spark, sf), "incoming")
    vecs = jobs.stream_encode(stream, "text", HashingEncoder, fresh_dir(spark, "stream-encode"))
    return long(vecs, "vec", "docid").where(F.col("val") != 0)


@query
def stream_search(spark, sf):
    index = fulltext.save_fulltext_index(
        fulltext.build_fulltext_index(I.corpus(spark, sf), partitions=8), "gleaner_stream"
    )
    stream = streamed(spark, I.queries(spark, sf), "questions")
    out = fresh_dir(spark, "stream-search")
    return jobs.stream_search(stream, Collection(index), "bm25", out, 100)


# --------------------------------------------------------------- encoders


@query
def encode_corpus(spark, sf):
    vecs = encode.encode_corpus(I.corpus(spark, sf), "text", HashingEncoder)
    return long(vecs, "vec", "docid").where(F.col("val") != 0)


@query
def encode_corpus_by_budget(spark, sf):
    vecs = encode.encode_corpus(I.corpus(spark, sf), "text", HashingEncoder, token_budget=16_384)
    return long(vecs, "vec", "docid").where(F.col("val") != 0)


@query
def generate_vectors_(spark, sf):
    docs = document_positions(spark, sf).join(I.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    made = generate_vectors(
        docs, fresh_dir(spark, "vectors"), "en", "hashing-64", HashingEncoder, normalize=True
    )
    rows = long(made, "vec", "pos").where(F.col("val") != 0)
    # Stored as 32-bit floats: compare four decimals.
    return rows.withColumn("val", F.round("val", 4))


@query
def encode_queries(spark, sf):
    vecs = encode.encode_queries(I.queries(spark, sf), HashingEncoder)
    return long(vecs, "qvec", "qid").where(F.col("val") != 0)


@query
def encode_multivector(spark, sf):
    turns = I.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    vecs = encode.encode_multivector(turns, "text", lambda: HashingTokenEncoder(16))
    tokens = vecs.select("conv_id", "turn", F.posexplode("vecs").alias("tok", "vec"))
    rows = long(tokens.withColumn("tok", F.col("tok").cast("bigint")), "vec", "conv_id", "turn", "tok")
    return rows.where(F.col("val") != 0)
