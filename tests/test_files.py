import gzip
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions.encoders import HashingEncoder
from gleaner.operators import positions
from gleaner.plans import maintenance
from gleaner.plans.embed import generate_vectors
from gleaner.plans.workspace import fresh_dir, is_complete, shared_root
from gleaner.sources import corpus as C
from gleaner.sources import trec
from gleaner.sources import vectors as VF
from gleaner.sources.files import data_files
from tests.conftest import rows


def fvecs_bytes(vectors, kind="f"):
    return b"".join(struct.pack("<i", len(v)) + struct.pack(f"<{len(v)}{kind}", *v) for v in vectors)


def test_fvecs_of_one_file_in_order(spark, tmp_path):
    path = tmp_path / "a.fvecs"
    path.write_bytes(fvecs_bytes([[1, 2], [3, 4], [5, 6]]))
    assert rows(VF.read_fvecs(spark, str(path)), "pos", "vec") == [(0, [1, 2]), (1, [3, 4]), (2, [5, 6])]
    assert rows(VF.read_fvecs(spark, str(path), max_rows=2), "pos") == [(0,), (1,)]


def test_fvecs_splits_one_file(spark, tmp_path):
    from gleaner.sources.vectorfiles import register

    vectors = np.arange(300, dtype=np.float32).reshape(100, 3)
    (tmp_path / "a.fvecs").write_bytes(fvecs_bytes(vectors.tolist()))
    register(spark)
    df = spark.read.format("fvecs").option("rowsPerSplit", 30).load(str(tmp_path / "a.fvecs"))
    assert df.rdd.getNumPartitions() == 4
    assert [r.vec for r in df.orderBy("pos").collect()] == vectors.tolist()


@pytest.mark.parametrize("cut", [1, 6])
@pytest.mark.parametrize("layout", ["fixed", "variable"])
def test_truncated_fvecs(spark, tmp_path, cut, layout):
    path = tmp_path / "a.fvecs"
    path.write_bytes(fvecs_bytes([[1, 2], [3, 4]]) + fvecs_bytes([[5, 6]])[:cut])
    with pytest.raises(Exception, match="inside a record|whole number"):
        VF.read_fvecs(spark, str(path), layout=layout).collect()
    got = VF.read_fvecs(spark, str(path), on_truncated="stop", layout=layout)
    assert rows(got, "vec") == [([1, 2],), ([3, 4],)]


def test_mixed_dimensions_need_the_variable_layout(spark, tmp_path):
    path = tmp_path / "a.fvecs"
    path.write_bytes(fvecs_bytes([[1, 2], [3], [4]]))
    with pytest.raises(Exception, match="variable|whole number|dimensions"):
        VF.read_fvecs(spark, str(path)).collect()
    assert [r.vec for r in VF.read_fvecs(spark, str(path), layout="variable").orderBy("pos").collect()] == [[1, 2], [3], [4]]


def test_ivecs_and_empty_file(spark, tmp_path):
    (tmp_path / "a.ivecs").write_bytes(fvecs_bytes([[7, -1]], "i"))
    assert rows(VF.read_ivecs(spark, str(tmp_path / "a.ivecs")), "vec") == [([7, -1],)]
    (tmp_path / "e.fvecs").write_bytes(b"")
    assert VF.read_fvecs(spark, str(tmp_path / "e.fvecs")).count() == 0


def test_written_vectors_are_plain_files_in_order(spark):
    vectors = np.random.default_rng(1).normal(size=(50, 5)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "pos bigint, vec array<float>")
    path = fresh_dir(spark, "t")
    VF.write_fvecs(df.repartition(7), path)
    from gleaner.sources.files import resolve

    files = [f for f, _ in data_files(path)]
    raw = b"".join(resolve(path)[0].open_input_file(f).read() for f in files)
    assert raw == fvecs_bytes(vectors.tolist())
    VF.write_fvecs(df.where("pos < 3"), path)  # overwrite leaves no old part
    assert VF.read_fvecs(spark, path).count() == 3


def test_multivectors_round_trip_and_truncation(spark, tmp_path):
    docs = [[[1.0, 2.0], [3.0, 4.0]], [], [[5.0, 6.0]]]
    df = spark.createDataFrame(list(enumerate(docs)), "pos bigint, vecs array<array<float>>")
    path = fresh_dir(spark, "t")
    VF.write_multivectors(df, path)
    assert [r.vecs for r in VF.read_multivectors(spark, path).orderBy("pos").collect()] == docs
    raw = struct.pack("<i", 1) + fvecs_bytes([[1, 2]]) + struct.pack("<i", 2) + fvecs_bytes([[3, 4]])
    (tmp_path / "m").write_bytes(raw)
    assert [r.vecs for r in VF.read_multivectors(spark, str(tmp_path / "m")).collect()] == [[[1.0, 2.0]]]
    with pytest.raises(Exception, match="inside a record"):
        VF.read_multivectors(spark, str(tmp_path / "m"), "fail").collect()


def test_sparse_json_and_binary(spark, tmp_path):
    records = [{"1": 0.5, "20": 2.0}, {}, {"3": 1.0}]
    path = tmp_path / "s.json"
    path.write_text(json.dumps(records))
    got = VF.read_sparse(spark, str(path)).orderBy("file", "block", "seq").collect()
    assert [r.sparse for r in got] == [{1: 0.5, 20: 2.0}, {}, {3: 1.0}]
    coo = VF.read_sparse(spark, str(path), "coo").orderBy("file", "block", "seq").collect()
    assert [(r.indices, r["values"]) for r in coo] == [([1, 20], [0.5, 2.0]), ([], []), ([3], [1.0])]

    binary = struct.pack("<i", 3) + struct.pack("<iifif", 2, 1, 0.5, 20, 2.0) + struct.pack("<i", 0) + struct.pack("<iif", 1, 3, 1.0)
    (tmp_path / "s.data").write_bytes(binary)
    got = VF.read_sparse(spark, str(tmp_path / "s.data")).orderBy("pos").collect()
    assert [r.sparse for r in got] == [{1: 0.5, 20: 2.0}, {}, {3: 1.0}]
    with pytest.raises(ValueError):
        VF.read_sparse(spark, str(tmp_path / "s.txt"))
    out = fresh_dir(spark, "t") + ".data"
    VF.write_sparse(VF.read_sparse(spark, str(tmp_path / "s.data"), "coo"), out)
    assert [r.sparse for r in VF.read_sparse(spark, out).orderBy("pos").collect()] == [{1: 0.5, 20: 2.0}, {}, {3: 1.0}]


def test_one_large_json_array_is_read_in_splits(spark, tmp_path):
    records = [{str(i): 1.0, str(i + 1): 0.25} for i in range(5000)]
    path = tmp_path / "s.json"
    path.write_text(json.dumps(records))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = VF.read_sparse(spark, str(path))
        assert df.rdd.getNumPartitions() > 1
        got = df.orderBy("file", "block", "seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [sorted(r.sparse) for r in got] == [[i, i + 1] for i in range(5000)]


def test_run_files(spark, tmp_path):
    (tmp_path / "en_bm25.txt").write_text("q1 Q0 d1 1 2.5 Faiss\nq1 Q0 d2 2 1.5 Faiss\n\n")
    (tmp_path / "en_bm25_score.txt").write_text("q1 d1 1 2.500000\n")
    (tmp_path / "de_bm25.txt").write_text("q9 Q0 d9 1 1.0 Faiss\n")
    got = trec.read_runs(spark, str(tmp_path), "en")
    assert rows(got, "run_id", "qid", "docid", "rank", "score", "tag") == [
        ("en_bm25", "q1", "d1", 1, 2.5, "Faiss"), ("en_bm25", "q1", "d2", 2, 1.5, "Faiss")
    ]
    assert rows(trec.read_scores(spark, str(tmp_path / "en_bm25_score.txt")), "docid", "score") == [("d1", 2.5)]
    assert trec.score_path("/a/en_bm25.txt") == "/a/en_bm25_score.txt"


def test_max_hits_cuts_written_runs(spark):
    run = spark.createDataFrame([("q", f"d{i}", i, 1.0 / i) for i in range(1, 6)], "qid string, docid string, rank bigint, score double")
    folder = fresh_dir(spark, "t")
    trec.write_scores(run, f"{folder}/en_x.txt", max_hits=2)
    assert rows(trec.read_runs(spark, folder, "en"), "docid", "rank") == [("d1", 1), ("d2", 2)]


def test_written_runs_keep_all_hits_by_default(spark):
    run = spark.range(1, 1502).select(
        F.lit("q").alias("qid"), F.concat(F.lit("d"), "id").alias("docid"), F.col("id").alias("rank"), (1 / F.col("id")).alias("score")
    )
    folder = fresh_dir(spark, "t")
    trec.write_scores(run, f"{folder}/en_x.txt")
    assert trec.read_runs(spark, folder, "en").count() == 1501
    assert trec.read_scores(spark, f"{folder}/en_x_score.txt").count() == 1501


def test_vector_artifacts_are_named_by_range_and_settings(spark):
    docs = spark.range(10).select(F.col("id").alias("pos"), F.concat(F.lit("text "), "id").alias("text"))
    root = fresh_dir(spark, "t")
    args = (docs, root, "en", "hashing", HashingEncoder)
    assert generate_vectors(*args, end=3).count() == 3
    assert generate_vectors(*args, begin=7).count() == 3
    assert generate_vectors(*args).count() == 10
    plain, unit = generate_vectors(*args), generate_vectors(*args, normalize=True)
    assert rows(plain, "pos", "vec") != rows(unit, "pos", "vec")


def test_long_texts_are_encoded_whole(spark):
    text = " ".join(f"w{i}" for i in range(9000))
    docs = spark.createDataFrame([(0, text)], "pos long, text string")
    whole = generate_vectors(docs, fresh_dir(spark, "t"), "en", "hashing", HashingEncoder)
    cut = generate_vectors(docs, fresh_dir(spark, "t"), "en", "hashing", HashingEncoder, max_tokens=8192)
    assert rows(whole, "vec") != rows(cut, "vec")


def test_qrels_accept_tabs_and_spaces(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("q1\t0\td1\t1\nq1 0 d2 0\n")
    assert rows(trec.read_qrels(spark, str(tmp_path / "q.tsv")), "qid", "docid", "rel") == [("q1", "d1", 1), ("q1", "d2", 0)]


def test_topics_with_null_passages(spark, tmp_path):
    records = [
        {"query_id": "q1", "query": "a", "positive_passages": [{"docid": "d1", "text": "t"}], "negative_passages": None},
        {"query_id": "q2", "query": "b"},
    ]
    with gzip.open(tmp_path / "test.jsonl.gz", "wt") as f:
        f.write("\n".join(json.dumps(r) for r in records))
    topics = C.read_topics(spark, str(tmp_path), "test")
    assert rows(topics, "query_id", F.size("positive_passages"), F.size("negative_passages")) == [("q1", 1, 0), ("q2", 0, 0)]
    assert rows(C.topic_qrels(topics), "qid", "docid", "rel") == [("q1", "d1", 1)]
    assert rows(C.select_queries(topics), "query_id", "query") == [("q1", "a"), ("q2", "b")]
    with pytest.raises(ValueError):
        C.read_topics(spark, str(tmp_path), "validation")


def test_missing_languages_do_not_stop_the_others(spark, tmp_path):
    (tmp_path / "corpus-en").mkdir()
    with gzip.open(tmp_path / "corpus-en" / "corpus.jsonl.gz", "wt") as f:
        f.write('{"docid": "d1", "text": "x"}\n')
    docs, status = C.read_all_languages(spark, str(tmp_path), ["en", "fr"])
    summary = C.load_summary(docs, status)
    assert rows(summary, "lang", "status", "n_rows") == [("en", "success", 1), ("fr", "failed", 0)]
    assert tuple(C.load_totals(summary).first()) == (1, 1, 1)
    with pytest.raises(ValueError):
        C.read_all_languages(spark, str(tmp_path), ["xx"])
    empty, status = C.read_all_languages(spark, str(tmp_path), ["fr"])
    assert empty.count() == 0 and status.count() == 1


def test_filter_languages(spark):
    df = spark.createDataFrame([("en",), ("fr",)], "lang string")
    assert rows(C.filter_languages(df, "fr"), "lang") == [("fr",)]
    with pytest.raises(ValueError):
        C.filter_languages(df, ["xx"])


def test_materialize_computes_once(spark):
    path = fresh_dir(spark, "t") + "/x"
    calls = []

    def make(n):
        calls.append(n)
        return spark.range(n)

    assert maintenance.materialize(spark, lambda: make(3), path).count() == 3
    assert maintenance.materialize(spark, lambda: make(5), path).count() == 3
    assert maintenance.materialize(spark, lambda: make(4), path, overwrite=True).count() == 4
    assert calls == [3, 4] and is_complete(spark, path)


def test_unfinished_output_is_rewritten(spark):
    import os

    path = shared_root(spark).removeprefix("file:") + "/unfinished"
    path = fresh_dir(spark, "t").removeprefix("file:")
    spark.range(9).write.parquet(path)
    os.remove(f"{path}/_SUCCESS")
    assert maintenance.materialize(spark, lambda: spark.range(2), path).count() == 2


def test_compaction_keeps_rows(spark):
    root = fresh_dir(spark, "t")
    spark.range(1000).withColumn("lang", F.lit("en")).repartition(12).write.parquet(f"{root}/a")
    assert maintenance.file_count(spark.read.parquet(f"{root}/a")) == 12
    out = maintenance.compact_table(spark, f"{root}/a", f"{root}/b", 3, ["lang", "id"])
    assert maintenance.file_count(out) == 3
    assert rows(out, "id") == rows(spark.read.parquet(f"{root}/a"), "id")


def test_analyze_table(spark):
    spark.range(10).write.mode("overwrite").option("path", fresh_dir(spark, "t")).saveAsTable("stats_test")
    maintenance.analyze_table(spark, "stats_test")
    described = spark.sql("DESCRIBE EXTENDED stats_test id").collect()
    assert ("distinct_count", "10") in [(r.info_name, r.info_value) for r in described]


def test_source_positions_follow_names_and_places(spark, tmp_path):
    for name, ids in (("part-2", "ab"), ("part-10", "cde"), ("part-1", "f")):
        (tmp_path / f"{name}.json").write_text("".join(f'{{"docid": "{i}", "text": "t"}}\n' for i in ids))
    corpus = C.read_corpus(spark, str(tmp_path), "en")
    assert rows(positions.assign_source_positions(corpus), "pos", "docid") == [(0, "f"), (1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    try:
        split = C.read_corpus(spark, str(tmp_path), "en")
        assert rows(positions.assign_source_positions(split), "pos", "docid")[3:] == [(3, "c"), (4, "d"), (5, "e")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_parts_count_by_value(spark, tmp_path):
    for number in (99999, 100000, 2):
        (tmp_path / f"part-{number}.fvecs").write_bytes(fvecs_bytes([[number, 0]]))
    assert [f.rsplit("-")[-1] for f, _ in data_files(str(tmp_path))] == ["2.fvecs", "99999.fvecs", "100000.fvecs"]
    assert [r.vec[0] for r in VF.read_fvecs(spark, str(tmp_path)).orderBy("pos").collect()] == [2, 99999, 100000]


def test_sparse_files_are_bounded(spark, monkeypatch):
    from gleaner.sources import vectorfiles

    rows_ = [(i, [i], [1.0]) for i in range(70)]
    df = spark.createDataFrame(rows_, "pos long, indices array<int>, values array<float>")
    path = fresh_dir(spark, "t") + ".data"
    vectorfiles.register(spark)
    df.repartition(1).sortWithinPartitions("pos").write.format("sparsevec").option("rowsPerFile", 20).mode("overwrite").save(path)
    assert len(data_files(path)) == 4
    assert [r.indices for r in VF.read_sparse(spark, path, "coo").orderBy("pos").collect()] == [[i] for i in range(70)]
