import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import blocks, vectors as V
from gleaner.functions.blocks import LocalTopK, l2_distances
from gleaner.operators import ann, encode, evaluate, rerank, vectorsearch
from gleaner.operators.blocksearch import block_search
from tests.conftest import rows

rng = np.random.default_rng(7)


def vec_frame(spark, ids, matrix, id_col="docid", col="vec"):
    return spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in zip(ids, matrix)], f"{id_col} string, {col} array<float>"
    )


@pytest.fixture(scope="module")
def data(spark):
    docs = rng.normal(size=(60, 8)).astype(np.float32) * rng.integers(1, 5, size=(60, 1))
    docs[10] = docs[11] = docs[12]  # exact copies: ties
    queries = np.vstack([docs[12], rng.normal(size=(4, 8))]).astype(np.float32)
    return docs, queries


def brute(docs, queries, metric, k):
    out = []
    for j, q in enumerate(queries.astype(np.float64)):
        d = docs.astype(np.float64)
        score = np.sqrt(((d - q) ** 2).sum(1)) if metric == "l2" else d @ q
        order = sorted(range(len(d)), key=lambda i: (round(score[i], 6) * (1 if metric == "l2" else -1), str(i)))
        out += [(f"q{j}", str(i), r + 1) for r, i in enumerate(order[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("metric", ["l2", "ip"])
@pytest.mark.parametrize("limit", [4096, 0])
def test_dense_search_equals_brute_force(spark, data, metric, limit):
    docs, queries = data
    d = vec_frame(spark, [str(i) for i in range(60)], docs).repartition(5)
    q = vec_frame(spark, [f"q{j}" for j in range(5)], queries, "qid", "qvec")
    got = vectorsearch.dense_search(q, d, 7, metric, query_broadcast_rows=limit)
    assert rows(got, "qid", "docid", "rank") == brute(docs, queries, metric, 7)


def test_small_blocks_give_the_same_hits(spark, data, monkeypatch):
    from gleaner.operators import blocksearch

    monkeypatch.setattr(blocksearch, "DOC_BLOCK_ROWS", 7)
    monkeypatch.setattr(blocksearch, "QUERY_BLOCK_ROWS", 2)
    docs, queries = data
    d = vec_frame(spark, [str(i) for i in range(60)], docs)
    q = vec_frame(spark, [f"q{j}" for j in range(5)], queries, "qid", "qvec")
    got = vectorsearch.dense_search(q, d, 7, "l2", query_broadcast_rows=1)
    assert rows(got, "qid", "docid", "rank") == brute(docs, queries, "l2", 7)


def test_empty_and_null_query_vectors_have_no_hits(spark, data):
    docs, _ = data
    d = vec_frame(spark, [str(i) for i in range(60)], docs)
    q = spark.createDataFrame([("a", []), ("b", None)], "qid string, qvec array<float>")
    assert vectorsearch.dense_search(q, d, 3).count() == 0


def test_mixed_dimensions_are_an_error(spark):
    d = spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "docid string, vec array<float>").coalesce(1)
    q = spark.createDataFrame([("q", [1.0])], "qid string, qvec array<float>")
    with pytest.raises(Exception, match="dimension"):
        vectorsearch.dense_search(q, d, 3).collect()


def test_unknown_metrics_are_an_error(spark, data):
    q = spark.createDataFrame([("q", [1.0])], "qid string, qvec array<float>")
    with pytest.raises(ValueError):
        vectorsearch.dense_search(q, q, 3, "cosine")
    with pytest.raises(ValueError):
        block_search(q, q, 3, "cosine")


def test_near_copies_keep_their_digits():
    base = rng.normal(size=(1, 64)) * 1000
    near = base + 1e-4
    assert abs(l2_distances(near, base)[0, 0] - 8e-4) < 1e-9


def test_local_top_k_keeps_ties_in_id_order():
    top = LocalTopK(1, 2)
    top.offer_all(np.array([[1.0], [1.0]]), np.array(["c", "b"], dtype=object))
    top.offer_all(np.array([[1.0], [0.5]]), np.array(["a", "z"], dtype=object))
    [(_, ids, scores)] = list(top.results())
    assert sorted(ids) == ["a", "b"] and scores.tolist() == [1.0, 1.0]


def test_routed_dense_search_stays_in_its_language(spark, data):
    docs, queries = data
    d = vec_frame(spark, [str(i) for i in range(60)], docs).withColumn(
        "lang", F.when(F.col("docid").cast("int") % 3 == 0, "en").otherwise("de")
    )
    q = vec_frame(spark, [f"q{j}" for j in range(5)], queries, "qid", "qvec").withColumn("lang", F.lit("en"))
    for limit in (4096, 0):
        got = rows(vectorsearch.dense_search(q, d, 3, query_broadcast_rows=limit), "lang", "docid")
        assert len(got) == 15 and all(lang == "en" and int(i) % 3 == 0 for lang, i in got)


def multi(spark, id_col, col, items):
    return spark.createDataFrame(items, f"{id_col} string, {col} array<array<float>>")


def maxsim(q, d, sim):
    return sum(max(sim(a, b) for b in d) for a in q)


@pytest.fixture(scope="module")
def tokens():
    docs = [(f"d{i:02d}", rng.normal(size=(int(rng.integers(1, 6)), 4)).tolist()) for i in range(25)]
    queries = [(f"q{j}", rng.normal(size=(int(rng.integers(1, 4)), 4)).tolist()) for j in range(4)]
    f32 = lambda items: [(i, np.float32(v).astype(float).tolist()) for i, v in items]
    return f32(docs), f32(queries)


def test_maxsim_equals_brute_force(spark, tokens):
    docs, queries = tokens
    got = vectorsearch.maxsim_search(multi(spark, "qid", "qvecs", queries), multi(spark, "docid", "vecs", docs), 5)
    want = []
    for q, qv in queries:
        scored = sorted((-round(maxsim(qv, dv, np.dot), 6), d) for d, dv in docs)
        want += [(q, d, -s) for s, d in scored[:5]]
    got = rows(got, "qid", "docid", "score")
    assert [(a, b) for a, b, _ in got] == sorted((a, b) for a, b, _ in want)


@pytest.mark.parametrize("kind", ["maxsim", "bits"])
def test_rerank_keeps_candidates_and_reorders_them(spark, tokens, kind):
    docs, queries = tokens
    run = spark.createDataFrame(
        [(q, d, float(-r), r + 1) for q, _ in queries for r, (d, _) in enumerate(docs[:10])] + [("q0", "unknown", -99.0, 11)],
        "qid string, docid string, score double, rank bigint",
    )
    fn = rerank.maxsim_rerank if kind == "maxsim" else rerank.bit_rerank
    sim = np.dot if kind == "maxsim" else (lambda a, b: int(((np.array(a) > 0) == (np.array(b) > 0)).sum()))
    got = rows(fn(run, multi(spark, "qid", "qvecs", queries), multi(spark, "docid", "vecs", docs), 11), "qid", "rank", "docid")
    for q, qv in queries:
        scored = {d: round(float(maxsim(qv, dv, sim)), 6) for d, dv in docs[:10]}
        if q == "q0":
            scored["unknown"] = 0.0
        want = [d for d, _ in sorted(scored.items(), key=lambda e: (-e[1], e[0]))]
        mine = [d for _, _, d in sorted((r for r in got if r[0] == q), key=lambda r: r[1])]
        assert mine == want


def test_sparse_search(spark):
    docs = spark.createDataFrame([("a", {1: 1.0, 2: 2.0}), ("b", {2: 1.0}), ("c", {9: 5.0}), ("d", {})], "docid string, sparse map<int,float>")
    q = spark.createDataFrame([("q", {1: 3.0, 2: 0.5}), ("r", {7: 1.0})], "qid string, sparse map<int,float>")
    assert rows(vectorsearch.sparse_search(q, docs, 5), "qid", "docid", "score") == [("q", "a", 4.0), ("q", "b", 0.5)]


def test_more_probes_find_more(spark, data):
    docs, queries = data
    d = vec_frame(spark, [str(i) for i in range(60)], docs)
    q = vec_frame(spark, [f"q{j}" for j in range(5)], queries, "qid", "qvec")
    index = ann.build_vector_index(d, n_cells=6)
    exact = vectorsearch.dense_search(q, d, 5)
    recalls = [evaluate.ann_recall(ann.ann_search(q, index, 5, n), exact, 5).first().recall for n in (1, 3, 6)]
    assert recalls == sorted(recalls) and recalls[-1] == 1.0


def test_ann_recall_floor_on_embeddings(spark):
    from checks import inputs as I

    sf = "/root/testdata/sf0.01"
    q = I.query_vectors(spark, sf).where(F.col("qvec").isNotNull()).select("qid", "qvec")
    index = ann.build_vector_index(I.vectors(spark, sf), n_cells=16)
    exact = vectorsearch.dense_search(q, I.vectors(spark, sf), 10)
    assert evaluate.ann_recall(ann.ann_search(q, index, 10, 8), exact, 10).first().recall >= 0.85


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, -4.0, 0.0],), ([0.0, 0.0, 0.0],)], "vec array<float>")
    got = df.select(V.l2_normalized(F.col("vec")), V.sign_bits(F.col("vec"))).collect()
    assert got[0][0] == pytest.approx([0.6, -0.8, 0.0]) and got[0][1] == [1, 0, 0]
    assert got[1][0] == [0.0, 0.0, 0.0]
    text = df.select(V.vector_text(F.col("vec")).alias("t"))
    assert text.first().t == "[3.0,-4.0,0.0]"
    assert text.select(V.parsed_vector(F.col("t"))).first()[0] == [3.0, -4.0, 0.0]


def test_pooling(spark):
    df = spark.createDataFrame([("a", [[1.0, 5.0], [3.0, 1.0]])], "docid string, vecs array<array<float>>")
    pooled = {m: encode.pool_vectors(df, method=m).first().vec for m in ("cls", "mean", "max")}
    assert pooled == {"cls": [1.0, 5.0], "mean": [2.0, 3.0], "max": [3.0, 5.0]}
    with pytest.raises(ValueError):
        encode.pool_vectors(df, method="sum")


def test_validate_vectors(spark):
    vecs = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0]), ("x", [1.0, 2.0])], "docid string, vec array<float>")
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "docid string")
    report = encode.validate_vectors(vecs, ids, 2).first()
    assert (report.n_vectors, report.n_ids, report.wrong_dim, report.ids_without_vector, report.vectors_without_id, report.ok) == (3, 3, 1, 1, 1, False)
    assert encode.validate_vectors(vecs.where("docid = 'a'"), ids.where("docid = 'a'"), 2).first().ok


def test_sparse_search_without_broadcast(spark, monkeypatch):
    from checks import inputs as I

    sf = "/root/testdata/sf0.001"
    args = I.query_sparse(spark, sf), I.sparse_vectors(spark, sf), 5
    want = rows(vectorsearch.sparse_search(*args), "qid", "docid", "score", "rank")
    monkeypatch.setattr(vectorsearch, "small_table", lambda df: None)
    assert rows(vectorsearch.sparse_search(*args), "qid", "docid", "score", "rank") == want


def test_the_same_query_id_in_two_languages(spark):
    vectors = spark.createDataFrame(
        [("a", "de", [0.0, 0.0]), ("b", "de", [3.0, 0.0]), ("c", "en", [0.1, 0.0]), ("d", "en", [9.0, 0.0])],
        "docid string, lang string, vec array<float>",
    )
    queries = spark.createDataFrame([(1, "de", [0.0, 0.0]), (1, "en", [0.0, 0.0])], "qid long, lang string, qvec array<float>")
    for broadcast_rows in (4096, 1):
        got = vectorsearch.dense_search(queries, vectors, 2, query_broadcast_rows=broadcast_rows)
        assert rows(got, "lang", "qid", "docid", "rank") == [
            ("de", 1, "a", 1), ("de", 1, "b", 2), ("en", 1, "c", 1), ("en", 1, "d", 2)
        ]


def test_first_places_equal_a_stable_sort():
    for columns, n in ((5, 5), (40, 3), (40, 40), (9, 1)):
        distances = rng.integers(0, 12, (200, columns)).astype(float)
        assert (ann._first_places(distances, n) == np.argsort(distances, axis=1, kind="stable")[:, :n]).all()


def test_cells_follow_the_number_of_vectors(spark):
    vectors = vec_frame(spark, [f"d{i}" for i in range(100)], rng.normal(size=(100, 4)))
    assert ann.build_vector_index(vectors).centroids.count() == 10


def test_sparse_search_equals_brute_force(spark, monkeypatch):
    from gleaner.operators import sparsesearch

    rnd = np.random.default_rng(4)

    def some(n, size):
        return [{int(i): float(rnd.normal()) for i in rnd.choice(60, rnd.integers(0, size), replace=False)} for _ in range(n)]

    docs = [(str(rnd.choice(["en", "fr"])), f"d{i}", m) for i, m in enumerate(some(300, 12))] + [("en", "none", None), ("fr", "neg", {-1: 2.0, 3: 1.0})]
    asked = [(str(rnd.choice(["en", "fr", "de"])), i, m) for i, m in enumerate(some(25, 6))] + [("fr", 99, {-1: 1.5}), ("en", 98, {1: float(rnd.normal())}), ("fr", 98, {1: 1.0})]
    given = spark.createDataFrame([(a, b, c) for a, b, c in docs], "lang string, docid string, sparse map<int,float>").repartition(4)
    queries = spark.createDataFrame(asked, "lang string, qid long, sparse map<int,float>")
    f32 = lambda m: {i: float(np.float32(v)) for i, v in (m or {}).items()}

    def brute(routed, k):
        out = []
        for lang, qid, q in asked:
            q, scored = f32(q), []
            for other, docid, d in docs:
                d = f32(d)
                if (not routed or other == lang) and q.keys() & d.keys():
                    scored.append((-round(sum(q[i] * d[i] for i in q.keys() & d.keys()), 6) + 0.0, docid))
            out += [(lang, qid, docid, rank) for rank, (_, docid) in enumerate(sorted(scored)[:k], 1)]
        return sorted(out, key=repr)

    for cells in (1, 4_000_000):
        monkeypatch.setattr(sparsesearch, "CELLS", cells)
        for k in (3, 1000):
            found = vectorsearch.sparse_search(queries, given, k)
            assert rows(found, "lang", "qid", "docid", "rank") == brute(True, k)
    single = queries.where("qid < 98").drop("lang")
    got = rows(vectorsearch.sparse_search(single, given, 5), "qid", "docid", "rank")
    assert got == sorted([r[1:] for r in brute(False, 5) if r[1] < 98], key=repr)


def test_sparse_search_shuffles_only_hits(spark):
    docs = spark.createDataFrame([(f"d{i}", {1: float(i), 2: 1.0}) for i in range(500)], "docid string, sparse map<int,float>").repartition(2)
    queries = spark.createDataFrame([("q", {1: 1.0, 2: 1.0})], "qid string, sparse map<int,float>")
    plan = vectorsearch.sparse_search(queries, docs, 4)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "HashAggregate" not in plan and "Join" not in plan


def test_scans_of_large_tables_have_more_tasks(spark, monkeypatch):
    from gleaner.operators import bounds

    df = spark.range(1_000_000)
    few = bounds.scan_tasks(df, 4)
    monkeypatch.setattr(bounds, "TASK_BYTES", 1000)
    assert few == 4 * spark.sparkContext.defaultParallelism and bounds.scan_tasks(df, 4) == 8000


def test_cells_learn_from_a_bounded_share(spark):
    from gleaner.operators import ann

    rnd = np.random.default_rng(8)
    centres = rnd.normal(size=(12, 16)) * 3
    data = [(f"d{i}", (centres[i % 12] + 0.3 * rnd.normal(size=16)).tolist()) for i in range(3000)]
    vectors = spark.createDataFrame(data, "docid string, vec array<double>")
    few = ann.kmeans_centroids(vectors, 12, train_per_cell=20)
    assert few.count() == 12
    index = ann.build_vector_index(vectors, centroids=few)
    assert index.cells.count() == 3000
    queries = vectors.where("docid in ('d5', 'd77', 'd1234')").withColumnsRenamed({"docid": "qid", "vec": "qvec"})
    exact = vectorsearch.dense_search(queries, vectors, 10)
    found = ann.ann_search(queries, index, 10, nprobe=4)
    assert exact.join(found, ["qid", "docid"]).count() >= 0.9 * exact.count()


def test_only_pairs_that_may_be_hits_are_looked_at_one_by_one(monkeypatch):
    """Hits equal those of whole matrices, with equal vectors and ties; later documents that are far away are never offered."""
    rng = np.random.default_rng(3)
    docs, queries = rng.normal(size=(900, 8)).round(1), rng.normal(size=(40, 8)).round(1)
    docs[100:130], queries[:5] = docs[7], docs[7]  # equal ones
    docs[500:] += 50
    ids = np.array([f"d{i:03}" for i in range(900)], dtype=object)
    monkeypatch.setattr(blocks, "MATRIX_ELEMENTS", 1_000)  # several parts of the queries
    for metric, scores in (("l2", lambda d: -blocks.l2_distances(d, queries)), ("ip", lambda d: blocks.inner_products(d, queries))):
        whole, near = blocks.LocalTopK(40, 10), blocks.LocalTopK(40, 10)
        offered = []
        offer = near.offer
        near.offer = lambda query, found, names: (offered.append(len(found)), offer(query, found, names))
        for start in range(0, 900, 100):
            part = slice(start, start + 100)
            whole.offer_all(scores(docs[part]), ids[part])
            near.offer_near(queries, docs[part], ids[part], metric)
        for q in range(40):
            assert sorted(zip(-whole.scores[q], whole.ids[q])) == sorted(zip(-near.scores[q], near.ids[q]))
        assert metric == "ip" or sum(offered) < 40 * 400
