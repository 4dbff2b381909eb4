"""Times the headline queries; prints one JSON line.

Like the workload it stands for, the bench loads and indexes once and then times
every search type over the whole query set. ``BENCH_SF_DIR`` and ``BENCH_CPUS``
choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import inputs as I  # noqa: E402
from checks import queries as Q  # noqa: E402
from gleaner.functions.constants import MAX_HITS  # noqa: E402
from gleaner.functions.encoders import HashingEncoder  # noqa: E402
from gleaner.operators import ann, encode, evaluate, fulltext, fusion, rerank, vectorsearch  # noqa: E402
from gleaner.plans.session import local_session  # noqa: E402
from gleaner.plans.workspace import fresh_dir, stored  # noqa: E402


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def run(name: str, make):
        start = time.perf_counter()
        result = make()
        if hasattr(result, "write") and not name.startswith("build"):
            result.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        return result

    corpus, queries, vectors = I.corpus(spark, sf), I.queries(spark, sf), I.vectors(spark, sf)
    asked = stored(I.query_vectors(spark, sf), "queries")  # the query set, read once
    n_queries = asked.count()

    def build_index():
        built = fulltext.build_fulltext_index(corpus, partitions=8)
        return fulltext.save_fulltext_index(built, "bench")

    index = run("build_fulltext_index", build_index)
    cells = run(
        "build_vector_index",
        lambda: ann.save_vector_index(ann.build_vector_index(vectors, 16), fresh_dir(spark, "ann")),
    )
    run("load_collection", lambda: Q.load_collection(spark, sf))
    run("encode_corpus", lambda: encode.encode_corpus(corpus, "text", HashingEncoder))
    run("fvecs_round_trip", lambda: Q.write_fvecs(spark, sf))
    run("bm25_search", lambda: fulltext.bm25_search(asked, index, MAX_HITS))
    run("bm25_search_unindexed", lambda: Q.bm25_search(spark, sf))
    run("dense_search", lambda: vectorsearch.dense_search(asked, vectors, MAX_HITS))
    run("ann_search", lambda: ann.ann_search(asked, cells, MAX_HITS))
    run("sparse_search", lambda: Q.sparse_search(spark, sf))
    run("maxsim_search", lambda: Q.maxsim_search(spark, sf))
    run("hybrid_search", lambda: fusion.hybrid_search(asked, index, vectors, MAX_HITS))
    keyword = stored(fulltext.bm25_search(asked, index, MAX_HITS), "run")
    dense = stored(vectorsearch.dense_search(asked, vectors, MAX_HITS), "run")
    run("fusion_rrf", lambda: fusion.fuse_rrf([keyword, dense]))
    run("fusion_normalized", lambda: fusion.fuse_normalized([keyword, fusion.similarity_run(dense)]))
    run(
        "maxsim_rerank",
        lambda: rerank.maxsim_rerank(dense, I.query_multivecs(spark, sf), I.multivecs(spark, sf), 100),
    )
    run("evaluate_runs", lambda: evaluate.evaluate_runs(keyword, I.qrels(spark, sf)))

    searches = ("bm25_search", "dense_search", "hybrid_search")
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "ms_per_query": {s: round(1000 * times[s] / n_queries, 3) for s in searches},
                "n_queries": n_queries,
                "cpus": cpus,
                "sf": sf,
            }
        )
    )


if __name__ == "__main__":
    main()
