"""DuckDB SQL with the same result as every registered query."""

from __future__ import annotations

CHARS = "&|!+-–():''\"?~^"
CLEAN = f"translate({{0}}, '{CHARS}', '{' ' * 14}')"
DELIMITER = r"'[^\p{L}\p{N}_]+'"


def _clean(col: str) -> str:
    return CLEAN.format(col)


def _pieces(col: str) -> str:
    return f"string_split_regex(lower({_clean(col)}), {DELIMITER})"


def _terms(col: str) -> str:
    return f"list_filter({_pieces(col)}, lambda t: length(t) BETWEEN 3 AND 84)"


VECS = "vecs AS (SELECT CAST(vec_id AS VARCHAR) AS docid, embedding AS vec, label FROM embeddings)"
QUERIES = "queries AS (SELECT '' AS lang, CAST(item_id AS VARCHAR) AS qid, text AS query FROM benchmark)"
TITLES = """queries AS (SELECT regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang,
  CAST(page_id AS VARCHAR) AS qid, regexp_extract(html, '<title>([^<]*)</title>', 1) AS query FROM pages)"""


def _index(lang: str = "''") -> str:
    return f"""docs AS (SELECT {lang} AS lang, CAST(doc_id AS VARCHAR) AS docid, text FROM documents),
bags AS (SELECT lang, docid, {_terms('text')} AS terms FROM docs),
lens AS (SELECT lang, docid, CAST(len(terms) AS BIGINT) AS dl FROM bags WHERE len(terms) > 0),
postings AS (SELECT lang, term, docid, count(*) AS tf
  FROM (SELECT lang, docid, unnest(terms) AS term FROM bags) GROUP BY ALL),
dfs AS (SELECT lang, term, count(*) AS df FROM postings GROUP BY ALL),
stats AS (SELECT lang, count(*) AS n, avg(dl) AS avgdl FROM lens GROUP BY ALL)"""


def _bm25(k: int, queries: str = QUERIES, lang: str = "''") -> str:
    return f"""{queries}, {_index(lang)},
qterms AS (SELECT DISTINCT lang, qid, unnest({_terms('query')}) AS term FROM queries),
pj AS (SELECT t.lang, t.qid, t.term, p.docid, p.tf, l.dl, d.df, s.n, s.avgdl
  FROM qterms t JOIN postings p USING (lang, term) JOIN dfs d USING (lang, term)
  JOIN lens l USING (lang, docid) JOIN stats s USING (lang)),
contrib AS (SELECT lang, qid, term, docid,
  ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) AS w FROM pj),
bm25_all AS (SELECT lang, qid, docid, round(sum(w), 6) AS score FROM contrib GROUP BY ALL),
bm25 AS (SELECT *, row_number() OVER (PARTITION BY lang, qid ORDER BY score DESC, docid) AS rank
  FROM bm25_all QUALIFY rank <= {k})"""


def _dist(a: str, b: str) -> str:
    return f"list_distance({a}::DOUBLE[], {b}::DOUBLE[])"


def _dense(k: int) -> str:
    """Benchmark against all embeddings; needs VECS and QUERIES."""
    return f"""qvecs AS (SELECT q.qid, v.vec AS qvec FROM queries q JOIN vecs v ON v.docid = q.qid),
dense_all AS (SELECT q.qid, v.docid, round({_dist('q.qvec', 'v.vec')}, 6) AS score FROM qvecs q CROSS JOIN vecs v),
dense AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, docid) AS rank
  FROM dense_all QUALIFY rank <= {k})"""


def _ranked(source: str, k: int, out: str, by: str = "qid") -> str:
    return f"""{out} AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, docid) AS rank
  FROM {source} QUALIFY rank <= {k})"""


def _hybrid(k: int) -> str:
    """Needs ``bm25`` and ``dense``."""
    return f"""hybrid_all AS (SELECT coalesce(b.qid, d.qid) AS qid, coalesce(b.docid, d.docid) AS docid,
  round(coalesce(b.score, 0) + coalesce(1 / (1 + d.score), 0), 6) AS score
  FROM bm25 b FULL JOIN dense d ON b.qid = d.qid AND b.docid = d.docid),
{_ranked('hybrid_all', k, 'hybrid')}"""


QRELS = """qrels AS (SELECT CAST(doc_id % 50 AS VARCHAR) AS qid, CAST(doc_id AS VARCHAR) AS docid,
  CAST(quality + 2 * toxic AS INTEGER) AS rel FROM labels)"""

TOPICS = """topics AS (SELECT CAST(l.doc_id AS VARCHAR) AS query_id, d.text AS query,
  l.quality, l.toxic FROM labels l JOIN documents d USING (doc_id))"""

# Runs of the evaluation queries: keyword and vector search of the benchmark.
K_EVAL = 100
RUNS = f"""{_bm25(K_EVAL)}, {VECS}, {_dense(K_EVAL)},
runs AS (SELECT 'en_bm25' AS run_id, qid, docid, score, rank FROM bm25
  UNION ALL SELECT 'en_dense', qid, docid, score, rank FROM dense)"""


def _metrics(k: int) -> str:
    """Per run and judged topic; needs ``runs`` and ``qrels``."""
    return f"""judged AS (SELECT r.run_id, r.qid, r.rank, q.rel FROM runs r JOIN qrels q USING (qid, docid)
  WHERE q.rel > 0 AND r.rank <= {k}),
found AS (SELECT run_id, qid, count(*) AS hits, sum(rel / log2(rank + 1)) AS dcg FROM judged GROUP BY ALL),
ideal AS (SELECT qid, sum(rel / log2(rn + 1)) AS idcg FROM
  (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, docid) AS rn FROM qrels WHERE rel > 0)
  WHERE rn <= {k} GROUP BY qid),
topics AS (SELECT qid, count(*) FILTER (WHERE rel > 0) AS nrel FROM qrels GROUP BY qid),
scored AS (SELECT g.run_id, t.qid, coalesce(f.hits / nullif(t.nrel, 0), 0) AS recall,
  coalesce(f.dcg / nullif(i.idcg, 0), 0) AS ndcg
  FROM topics t CROSS JOIN (SELECT DISTINCT run_id FROM runs) g
  LEFT JOIN found f ON f.run_id = g.run_id AND f.qid = t.qid LEFT JOIN ideal i ON i.qid = t.qid)"""


POSITIONED = """docs AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents),
evecs AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings)"""

TOKENS = """toks AS (SELECT docid, tok, vec[tok * 16 + 1 : tok * 16 + 16] AS tv
  FROM vecs, (SELECT unnest(range(4)) AS tok))"""

MAXSIM_PAIRS = f"""{TOKENS},
qtoks AS (SELECT q.qid, t.tok, t.tv FROM queries q JOIN toks t ON t.docid = q.qid)"""

CELLS = f"""means AS (SELECT label, d, avg(x) AS m FROM (SELECT label, unnest(range(64)) AS d,
  unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL),
centroids AS (SELECT CAST(label AS BIGINT) AS cell, list(m ORDER BY d) AS c FROM means GROUP BY label),
cells AS (SELECT docid, vec, cell FROM (SELECT v.docid, v.vec, c.cell,
  row_number() OVER (PARTITION BY v.docid ORDER BY round({_dist('v.vec', 'c.c')}, 6), c.cell) AS place
  FROM vecs v CROSS JOIN centroids c) WHERE place = 1)"""

NPROBE = 4


def _ann(k: int) -> str:
    return f"""qvecs AS (SELECT q.qid, v.vec AS qvec FROM queries q JOIN vecs v ON v.docid = q.qid),
probes AS (SELECT qid, qvec, cell FROM (SELECT q.qid, q.qvec, c.cell,
  row_number() OVER (PARTITION BY q.qid ORDER BY round({_dist('q.qvec', 'c.c')}, 6), c.cell) AS place
  FROM qvecs q CROSS JOIN centroids c) WHERE place <= {NPROBE}),
ann AS (SELECT p.qid, c.docid, round({_dist('p.qvec', 'c.vec')}, 6) AS score,
  row_number() OVER (PARTITION BY p.qid ORDER BY round({_dist('p.qvec', 'c.vec')}, 6), c.docid) AS rank
  FROM probes p JOIN cells c USING (cell) QUALIFY rank <= {k})"""


def _hash(token: str, dim: int) -> str:
    return (
        f"CAST(('0x' || substr(md5({token}), 1, 8))::UBIGINT % {dim} AS BIGINT) AS dim, "
        f"CASE WHEN ('0x' || substr(md5({token}), 9, 1))::INTEGER % 2 = 0 THEN 1 ELSE -1 END AS sign"
    )


def _encoded(source: str, id_col: str, dim: int = 64) -> str:
    """Non-zero entries of the hashing encoder over ``text``."""
    return f"""SELECT docid, dim, CAST(sum(sign) AS DOUBLE) AS val FROM
  (SELECT docid, {_hash('token', dim)} FROM (SELECT CAST({id_col} AS VARCHAR) AS docid,
   unnest(string_split_regex(text, '[ \\t\\r\\n]+')) AS token FROM {source}) WHERE token <> '')
  GROUP BY ALL HAVING sum(sign) <> 0"""


COLLECTION = """docs AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos FROM documents),
evecs AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings),
loaded AS (SELECT d.lang, d.pos, d.pos + 1 AS id, 'base_id_' || CAST(d.pos // 500 + 1 AS VARCHAR) AS base_id,
  CAST(d.doc_id AS VARCHAR) AS docid_col, d.text AS fulltext_col, e.embedding AS dense_col
  FROM docs d JOIN evecs e USING (pos))"""

SPARSE = """sparse AS (SELECT CAST(vec_id AS VARCHAR) AS docid, vec_id, i AS idx, x AS val FROM
  (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS x FROM embeddings) WHERE x > 0.1::FLOAT)"""

EXPERIMENT = f"""{_bm25(100, TITLES, 'lang')}, {VECS},
lvecs AS (SELECT d.lang, v.docid, v.vec FROM vecs v JOIN docs d USING (docid)),
dense AS (SELECT q.lang, q.qid, d.docid, round({_dist('v.vec', 'd.vec')}, 6) AS score,
  row_number() OVER (PARTITION BY q.qid ORDER BY round({_dist('v.vec', 'd.vec')}, 6), d.docid) AS rank
  FROM queries q JOIN vecs v ON v.docid = q.qid JOIN lvecs d ON d.lang = q.lang QUALIFY rank <= 100),
hybrid_all AS (SELECT coalesce(b.lang, d.lang) AS lang, coalesce(b.qid, d.qid) AS qid,
  coalesce(b.docid, d.docid) AS docid, round(coalesce(b.score, 0) + coalesce(1 / (1 + d.score), 0), 6) AS score
  FROM bm25 b FULL JOIN dense d ON b.qid = d.qid AND b.docid = d.docid),
{_ranked('hybrid_all', 100, 'hybrid')}"""


def _flat(sql: str) -> str:
    return " ".join(line.strip() for line in sql.splitlines()).strip()


ORACLE: dict[str, str] = {
    # sources
    "read_corpus": "SELECT CAST(doc_id AS VARCHAR) AS docid, text, lang FROM documents",
    "read_gzip_corpus": """SELECT row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS pos, CAST(doc_id AS VARCHAR) AS docid,
      text, 'en' AS lang FROM documents""",
    "read_topics": f"""WITH {TOPICS} SELECT query_id, query, CAST(quality = 1 AS BIGINT) AS n_positive,
      CAST(toxic = 1 AS BIGINT) AS n_negative, 'test' AS split FROM topics""",
    "topic_qrels": f"WITH {TOPICS} SELECT query_id AS qid, query_id AS docid, 1 AS rel FROM topics WHERE quality = 1",
    "pair_in_source_order": """SELECT pos, docid, n_chars, CAST(embedding[1] AS DOUBLE) AS first FROM (SELECT CAST(doc_id AS VARCHAR) AS docid,
        CAST(length(text) AS BIGINT) AS n_chars, row_number() OVER (ORDER BY reverse(CAST(doc_id AS VARCHAR))) - 1 AS pos FROM documents)
      JOIN (SELECT embedding, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings) USING (pos)""",
    "read_all_languages": "SELECT lang, CAST(doc_id AS VARCHAR) AS docid, text FROM documents",
    "load_summary": """SELECT l.lang, CASE WHEN count(d.doc_id) > 0 THEN 'success' ELSE 'failed' END AS status,
      count(d.doc_id) AS n_rows FROM (SELECT unnest(['ar','de','en','es','fr','hi','it','ja','ko','pt','ru','th','zh']) AS lang) l
      LEFT JOIN documents d USING (lang) GROUP BY l.lang""",
    "load_totals": """SELECT count(DISTINCT lang) AS succeeded, 13 - count(DISTINCT lang) AS failed,
      count(*) AS n_rows FROM documents""",
    "read_fvecs": """SELECT pos, CAST(unnest(range(64)) AS BIGINT) AS dim, unnest(embedding)::DOUBLE AS val FROM
      (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings)""",
    "read_ivecs": f"""WITH {QUERIES}, {VECS}, {_dense(10)}
      SELECT CAST(dense_rank() OVER (ORDER BY CAST(qid AS BIGINT)) - 1 AS BIGINT) AS pos, rank - 1 AS place,
      CAST(docid AS INTEGER) AS neighbour FROM dense""",
    "read_sparse_json": f"WITH {SPARSE} SELECT docid, CAST(idx AS INTEGER) AS idx, CAST(val AS DOUBLE) AS val FROM sparse",
    "read_sparse_binary": f"""WITH {SPARSE} SELECT e.pos, CAST(s.idx AS INTEGER) AS idx, CAST(s.val AS DOUBLE) AS val
      FROM sparse s JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings) e USING (vec_id)""",
    "read_multivectors": f"""WITH {VECS}, {TOKENS} SELECT CAST(docid AS BIGINT) AS doc, tok, CAST(unnest(range(16)) AS BIGINT) AS dim,
      unnest(tv)::DOUBLE AS val FROM toks""",
    "read_qrels": f"WITH {QRELS} SELECT qid, docid, rel FROM qrels",
    "read_runs": f"WITH {RUNS} SELECT run_id, qid, docid, rank, round(score, 6) AS score, 'Faiss' AS tag FROM runs",
    # sinks
    "load_collection": f"""WITH {COLLECTION} SELECT lang, id, base_id, docid_col, fulltext_col,
      len(dense_col) AS dim, dense_col[1]::DOUBLE AS first_value FROM loaded""",
    "replace_collection": f"""WITH {COLLECTION} SELECT 'old' AS version, lang, id, docid_col, fulltext_col FROM loaded
      UNION ALL SELECT 'new', lang, id, docid_col, fulltext_col || CASE WHEN lang = 'de' THEN '' ELSE ' (new)' END FROM loaded""",
    "write_fvecs": """SELECT CAST(vec_id AS VARCHAR) AS docid, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS norm2,
      len(embedding) AS dim FROM embeddings""",
    "write_multivectors": f"""WITH {VECS}, {TOKENS} SELECT docid, CAST(count(*) AS BIGINT) AS n_tokens,
      round(sum(list_sum(tv::DOUBLE[])), 6) AS total FROM toks GROUP BY docid""",
    "write_trec_run": f"WITH {_bm25(100)} SELECT qid, docid, rank, score, 'Faiss' AS tag FROM bm25",
    "write_score_file": f"WITH {_bm25(100)} SELECT qid, docid, rank, score FROM bm25",
    "materialize_once": """SELECT lang, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY lang""",
    # projections and filters
    "select_queries": f"WITH {TOPICS} SELECT query_id, query FROM topics",
    "filter_languages": "SELECT lang, doc_id, n_chars FROM documents WHERE lang IN ('fr', 'de')",
    "normalize_query": f"SELECT CAST(item_id AS VARCHAR) AS qid, {_clean('text')} AS query FROM benchmark",
    "tokenize": f"""SELECT docid, pos, term FROM (SELECT CAST(doc_id AS VARCHAR) AS docid,
      CAST(unnest(range(len({_pieces('text')}))) AS BIGINT) AS pos, unnest({_pieces('text')}) AS term FROM documents)
      WHERE length(term) BETWEEN 3 AND 84""",
    "assign_positions": """SELECT doc_id, lang, row_number() OVER (ORDER BY lang, doc_id) - 1 AS pos FROM documents""",
    "assign_base_id": f"""WITH {POSITIONED} SELECT doc_id, pos, 'base_id_' || CAST(pos // 500 + 1 AS VARCHAR) AS base_id FROM docs""",
    "cap_rows": f"WITH {POSITIONED} SELECT doc_id, pos FROM docs WHERE pos < 300",
    "slice_range": f"WITH {POSITIONED} SELECT doc_id, pos FROM docs WHERE pos >= 100 AND pos < 400",
    "split_ranges": f"""WITH {POSITIONED}, n AS (SELECT count(*) AS n FROM documents),
      parts AS (SELECT 0 AS part_id, 0 AS part_begin, n // 4 AS part_end FROM n UNION ALL
        SELECT 1, n // 4, n // 2 FROM n UNION ALL SELECT 2, n // 2, n FROM n)
      SELECT doc_id, pos, CAST(part_id AS BIGINT) AS part_id, CAST(part_begin AS BIGINT) AS part_begin, part_end
      FROM docs JOIN parts ON pos >= part_begin AND pos < part_end""",
    "fill_missing_passages": f"""WITH {TOPICS} SELECT query_id, CAST(quality = 1 AS BIGINT) AS n_positive,
      CAST(toxic = 1 AS BIGINT) AS n_negative FROM topics""",
    "vector_to_text": """SELECT CAST(vec_id AS VARCHAR) AS docid, CAST(unnest(range(64)) AS BIGINT) AS dim,
      unnest(embedding)::DOUBLE AS val FROM embeddings""",
    "sparse_convert": f"""WITH {SPARSE} SELECT docid, CAST(idx AS INTEGER) AS idx, CAST(val AS DOUBLE) AS val FROM sparse""",
    "sign_binarize": """SELECT CAST(vec_id AS VARCHAR) AS docid, CAST(unnest(range(64)) AS BIGINT) AS dim,
      unnest(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)) AS bit FROM embeddings""",
    "l2_normalize": """WITH scaled AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 5)) AS vec FROM embeddings)
      SELECT CAST(vec_id AS VARCHAR) AS docid, CAST(unnest(range(64)) AS BIGINT) AS dim,
      round(unnest(list_transform(vec, lambda x: x / sqrt(list_inner_product(vec, vec)))), 6) AS val FROM scaled""",
    "validate_vectors": """SELECT count(e.vec_id) AS n_vectors, count(d.doc_id) AS n_ids,
      count(*) FILTER (WHERE e.vec_id IS NOT NULL AND len(e.embedding) <> 64) AS wrong_dim,
      count(*) FILTER (WHERE e.vec_id IS NULL) AS ids_without_vector,
      count(*) FILTER (WHERE d.doc_id IS NULL) AS vectors_without_id,
      count(*) FILTER (WHERE e.vec_id IS NULL OR d.doc_id IS NULL OR len(e.embedding) <> 64) = 0 AS ok
      FROM embeddings e FULL JOIN documents d ON d.doc_id = e.vec_id""",
    "chunk_documents": """SELECT CAST(doc_id AS VARCHAR) AS docid, CAST(n AS BIGINT) AS chunk_no, substr(text, n * 512 + 1, 512) AS chunk
      FROM (SELECT doc_id, text, unnest(range((length(text) + 511) // 512)) AS n FROM documents)""",
    "chunk_documents_overlap": """SELECT CAST(doc_id AS VARCHAR) AS docid, CAST(n AS BIGINT) AS chunk_no, substr(text, n * 384 + 1, 512) AS chunk
      FROM (SELECT doc_id, text, unnest(range(CASE WHEN length(text) > 512 THEN (length(text) - 512 + 383) // 384 + 1 ELSE 1 END)) AS n
      FROM documents WHERE length(text) > 0)""",
    "chunk_documents_recursive": r"""SELECT CAST(doc_id AS VARCHAR) AS docid, regexp_replace(text, '\s+', '', 'g') AS letters,
      true AS all_fit FROM documents WHERE length(regexp_replace(text, '\s+', '', 'g')) > 0""",
    "truncate_text": """WITH w AS (SELECT doc_id, text, string_split_regex(text, '[ \\t\\r\\n]+') AS words FROM documents)
      SELECT CAST(doc_id AS VARCHAR) AS docid, CASE WHEN len(words) <= 8192 THEN text
      ELSE array_to_string(words[1:8192], ' ') END AS text FROM w""",
    "parse_hits": f"""WITH {_bm25(10)} SELECT shape || ':' || qid AS qid, rank, docid, score FROM bm25,
      (SELECT unnest(['list', 'nested']) AS shape)""",
    # joins
    "zip_join": f"""WITH {POSITIONED} SELECT d.pos, CAST(d.doc_id AS VARCHAR) AS docid, e.embedding[1]::DOUBLE AS first_value,
      len(e.embedding) AS dim FROM docs d JOIN evecs e USING (pos)""",
    "zip_queries": f"""WITH {POSITIONED}, q AS (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS pos FROM benchmark)
      SELECT q.pos, CAST(item_id AS VARCHAR) AS qid, q.text AS query, {_clean('q.text')} AS target,
      e.embedding[1]::DOUBLE AS first_value FROM q JOIN evecs e USING (pos)""",
    "postings_join": f"WITH {_bm25(1)} SELECT qid, term, docid, tf, dl, df, n, round(avgdl, 6) AS avgdl FROM pj",
    "knn_join": f"WITH {VECS}, {QUERIES}, {_dense(10)} SELECT qid, docid, score AS distance, rank FROM dense",
    "knn_join_pruned": f"WITH {VECS}, {QUERIES}, {_dense(10)} SELECT qid, docid, score AS distance, rank FROM dense",
    "fuse_join": f"""WITH {_bm25(100)}, {VECS}, {_dense(100)} SELECT coalesce(b.qid, d.qid) AS qid, coalesce(b.docid, d.docid) AS docid,
      coalesce(b.score, 0.0) AS left_score, round(coalesce(1 / (1 + d.score), 0.0), 6) AS right_score
      FROM bm25 b FULL JOIN dense d ON b.qid = d.qid AND b.docid = d.docid""",
    "judge_run": f"""WITH {RUNS}, {QRELS} SELECT r.run_id, r.qid, r.docid, r.rank, coalesce(q.rel, 0) AS rel
      FROM runs r LEFT JOIN qrels q USING (qid, docid)""",
    "missing_topics": f"WITH {QRELS}, {QUERIES} SELECT DISTINCT qid FROM qrels WHERE qid NOT IN (SELECT qid FROM queries)",
    "route_by_language": f"""WITH {TITLES}, n AS (SELECT lang, count(*) AS n_docs FROM documents GROUP BY lang)
      SELECT qid, lang, query, 'test_insert_' || lang AS collection, coalesce(n_docs, 0) AS n_docs FROM queries LEFT JOIN n USING (lang)""",
    "approx_knn_join": f"WITH {VECS}, {QUERIES}, {CELLS}, {_ann(10)} SELECT * FROM ann",
    # index and table builds
    "postings": f"WITH {_index()} SELECT term, docid, tf FROM postings",
    "doc_lengths": f"WITH {_index()} SELECT docid, dl FROM lens",
    "doc_freqs": f"WITH {_index()} SELECT term, df FROM dfs",
    "corpus_stats": f"WITH {_index()} SELECT n, round(avgdl, 6) AS avgdl FROM stats",
    "corpus_stats_by_language": f"WITH {_index('lang')} SELECT lang, n, round(avgdl, 6) AS avgdl FROM stats",
    "build_vector_index": f"WITH {VECS}, {CELLS} SELECT docid, cell FROM cells",
    "reconcile_counts": f"""WITH {COLLECTION}, expected AS (SELECT lang, count(*) AS expected FROM documents GROUP BY lang),
      actual AS (SELECT lang, count(*) AS actual FROM loaded GROUP BY lang)
      SELECT lang, expected, coalesce(actual, 0) AS actual, expected = coalesce(actual, 0) AS ok FROM expected LEFT JOIN actual USING (lang)""",
    "batch_report": f"""WITH {POSITIONED} SELECT d.lang, CAST(pos // 100 + 1 AS BIGINT) AS batch_num, count(*) AS n_rows,
      count(*) FILTER (WHERE l.toxic = 1) AS n_bad, count(*) FILTER (WHERE l.toxic = 1) = 0 AS ok
      FROM docs d LEFT JOIN labels l USING (doc_id) GROUP BY ALL""",
    "good_batches": f"""WITH {POSITIONED}, rows AS (SELECT d.doc_id, d.lang, pos, pos // 10 AS b, coalesce(l.toxic = 1, false) AS bad
      FROM docs d LEFT JOIN labels l USING (doc_id)), failed AS (SELECT DISTINCT lang, b FROM rows WHERE bad)
      SELECT r.doc_id, r.lang, r.pos FROM rows r LEFT JOIN failed f ON f.lang = r.lang AND f.b = r.b WHERE f.b IS NULL""",
    "collect_table_stats": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL) AS n_nulls,
        count(DISTINCT {c}) AS n_distinct, CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value,
        round(avg(length(CAST({c} AS VARCHAR))), 6) AS avg_length FROM documents"""
        for c in ("doc_id", "text", "lang", "source", "n_chars")
    ),
    "compact_table": "SELECT doc_id, lang, source, n_chars, text FROM documents",
    "concat_chunk_vectors": f"""WITH {VECS}, {TOKENS} SELECT CAST(docid AS BIGINT) // 4 AS docid,
      (CAST(docid AS BIGINT) % 4) * 4 + tok AS tok, CAST(unnest(range(16)) AS BIGINT) AS dim, unnest(tv)::DOUBLE AS val FROM toks""",
    "pool_vectors": f"""WITH {VECS}, {TOKENS}, dims AS (SELECT docid, tok, CAST(unnest(range(16)) AS BIGINT) AS dim, unnest(tv)::DOUBLE AS x FROM toks)
      SELECT docid, 'cls' AS method, dim, round(x, 6) AS val FROM dims WHERE tok = 0
      UNION ALL SELECT docid, 'mean', dim, round(avg(x), 6) FROM dims GROUP BY docid, dim
      UNION ALL SELECT docid, 'max', dim, round(max(x), 6) FROM dims GROUP BY docid, dim""",
    "latency_summary": """SELECT 'en' AS lang, event_type AS query_type, count(*) AS queries,
      round(1000 * sum(value) / count(*), 6) AS mean_ms FROM events GROUP BY event_type""",
    "average_runs": """SELECT event_type AS run_id, 'value' AS metric, count(*) AS repeats, round(avg(value), 6) AS mean_value
      FROM events GROUP BY event_type""",
    # search
    "bm25_search": f"WITH {_bm25(1000)} SELECT qid, docid, score, rank FROM bm25",
    "pq_search": """SELECT count(*) AS n_queries, 10 * count(*) AS n_hits, true AS recall_reached
      FROM embeddings WHERE vec_id % 20 = 0""",
    "block_max_search": f"WITH {_bm25(10)} SELECT qid, docid, score, rank FROM bm25",
    "bm25_search_saved_index": f"WITH {_bm25(100)} SELECT qid, docid, score, rank FROM bm25",
    "bm25_search_by_language": f"WITH {_bm25(100, TITLES, 'lang')} SELECT lang, qid, docid, score, rank FROM bm25",
    "dense_search": f"WITH {VECS}, {QUERIES}, {_dense(1000)} SELECT qid, docid, score, rank FROM dense",
    "dense_search_blocked": f"WITH {VECS}, {QUERIES}, {_dense(100)} SELECT qid, docid, score, rank FROM dense",
    "dense_search_ip": f"""WITH scaled AS (SELECT CAST(vec_id AS VARCHAR) AS docid,
      list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 5)) AS vec FROM embeddings), {QUERIES},
      alls AS (SELECT q.qid, v.docid, round(list_inner_product(s.vec, v.vec), 6) AS score FROM queries q
        JOIN scaled s ON s.docid = q.qid CROSS JOIN scaled v), {_ranked('alls', 100, 'hits')}
      SELECT qid, docid, score, rank FROM hits""",
    "dense_search_unnormalized": f"""WITH scaled AS (SELECT CAST(vec_id AS VARCHAR) AS docid,
      list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 5)) AS vec FROM embeddings), {QUERIES},
      alls AS (SELECT q.qid, v.docid, round(list_distance(s.vec, v.vec), 6) AS score FROM queries q
        JOIN scaled s ON s.docid = q.qid CROSS JOIN scaled v)
      SELECT qid, docid, score, row_number() OVER (PARTITION BY qid ORDER BY score, docid) AS rank FROM alls QUALIFY rank <= 100""",
    "phrase_search": r"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS docid,
        list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS w FROM documents),
      t AS (SELECT docid, unnest(w) AS term, unnest(range(len(w))) AS pos FROM d),
      kept AS (SELECT * FROM t WHERE length(term) BETWEEN 3 AND 84),
      dl AS (SELECT docid, count(*) AS dl FROM kept GROUP BY docid),
      st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl),
      b AS (SELECT CAST(item_id AS VARCHAR) AS qid,
        list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS w FROM benchmark),
      part AS (SELECT qid, 0 AS slop, unnest(w[1:3]) AS term, unnest(range(len(w[1:3]))) AS place FROM b
        UNION ALL SELECT qid, 3, unnest(w[5:6]), unnest(range(len(w[5:6]))) FROM b),
      q AS (SELECT qid, slop, term, place - min(place) OVER (PARTITION BY qid, slop) AS place,
        count(*) OVER (PARTITION BY qid, slop) AS parts FROM part WHERE length(term) BETWEEN 3 AND 84),
      exact AS (SELECT DISTINCT qid, slop, docid, pos - place AS p FROM q JOIN kept USING (term) WHERE slop = 0 OR parts = 1
        GROUP BY qid, slop, docid, pos - place, parts HAVING count(*) = parts),
      loose AS (SELECT DISTINCT x.qid, x.slop, a.docid, a.pos AS p FROM q x JOIN q y ON y.qid = x.qid AND y.slop = x.slop AND y.place > 0
        JOIN kept a ON a.term = x.term JOIN kept c ON c.docid = a.docid AND c.term = y.term AND c.pos - a.pos BETWEEN y.place AND y.place + 3
        WHERE x.slop = 3 AND x.place = 0),
      tf AS (SELECT qid, slop, docid, count(*)::DOUBLE AS tf FROM (SELECT * FROM exact UNION ALL SELECT * FROM loose) GROUP BY ALL),
      df AS (SELECT qid, slop, count(*)::DOUBLE AS df FROM tf GROUP BY ALL),
      s AS (SELECT qid, docid, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
        FROM tf JOIN df USING (qid, slop) JOIN dl USING (docid), st GROUP BY qid, docid)
      SELECT qid, docid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM s QUALIFY rank <= 100""",
    "sparse_search": f"""WITH {SPARSE}, {QUERIES}, alls AS (SELECT q.qid, d.docid, round(sum(s.val::DOUBLE * d.val::DOUBLE), 6) AS score
      FROM queries q JOIN sparse s ON s.docid = q.qid JOIN sparse d ON d.idx = s.idx GROUP BY ALL), {_ranked('alls', 100, 'hits')}
      SELECT qid, docid, score, rank FROM hits""",
    "maxsim_search": f"""WITH {VECS}, {QUERIES}, {MAXSIM_PAIRS},
      best AS (SELECT q.qid, q.tok, d.docid, max(list_inner_product(q.tv::DOUBLE[], d.tv::DOUBLE[])) AS m
        FROM qtoks q CROSS JOIN toks d GROUP BY ALL),
      alls AS (SELECT qid, docid, round(sum(m), 6) AS score FROM best GROUP BY ALL), {_ranked('alls', 100, 'hits')}
      SELECT qid, docid, score, rank FROM hits""",
    "hybrid_search": f"WITH {_bm25(100)}, {VECS}, {_dense(100)}, {_hybrid(100)} SELECT qid, docid, score, rank FROM hybrid",
    "hybrid_fallback": f"""WITH {_bm25(100)}, {VECS}, evens AS (SELECT * FROM vecs WHERE label % 2 = 0),
      dense AS (SELECT q.qid, v.docid, round({_dist('e.vec', 'v.vec')}, 6) AS score,
        row_number() OVER (PARTITION BY q.qid ORDER BY round({_dist('e.vec', 'v.vec')}, 6), v.docid) AS rank
        FROM queries q JOIN evens e ON e.docid = q.qid CROSS JOIN vecs v QUALIFY rank <= 100), {_hybrid(100)}
      SELECT qid, docid, score, rank FROM hybrid""",
    "ann_search": f"WITH {VECS}, {QUERIES}, {CELLS}, {_ann(100)} SELECT * FROM ann",
    "fusion_rrf": f"""WITH {RUNS}, alls AS (SELECT qid, docid, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM runs GROUP BY ALL),
      {_ranked('alls', 100, 'hits')} SELECT qid, docid, score, rank FROM hits""",
    "fusion_weighted": f"""WITH {RUNS}, alls AS (SELECT qid, docid, round(sum(CASE run_id WHEN 'en_bm25' THEN 0.6::DOUBLE * score
      ELSE 0.4::DOUBLE / (1 + score) END), 6) AS score FROM runs GROUP BY ALL),
      {_ranked('alls', 100, 'hits')} SELECT qid, docid, score, rank FROM hits""",
    "fusion_normalized": f"""WITH {RUNS}, sims AS (SELECT run_id, qid, docid, CASE run_id WHEN 'en_bm25' THEN score ELSE 1 / (1 + score) END AS s FROM runs),
      ranges AS (SELECT run_id, qid, min(s) AS low, max(s) AS high FROM sims GROUP BY ALL),
      alls AS (SELECT qid, docid, round(sum(CASE WHEN high > low THEN (s - low) / (high - low) ELSE 1.0 END), 6) AS score
        FROM sims JOIN ranges USING (run_id, qid) GROUP BY ALL), {_ranked('alls', 100, 'hits')}
      SELECT qid, docid, score, rank FROM hits""",
    "maxsim_rerank": f"""WITH {VECS}, {QUERIES}, {_dense(20)}, {MAXSIM_PAIRS},
      best AS (SELECT r.qid, q.tok, r.docid, max(list_inner_product(q.tv::DOUBLE[], d.tv::DOUBLE[])) AS m
        FROM dense r JOIN qtoks q USING (qid) JOIN toks d USING (docid) GROUP BY ALL),
      alls AS (SELECT qid, docid, round(sum(m), 6) AS score FROM best GROUP BY ALL), {_ranked('alls', 20, 'hits')}
      SELECT qid, docid, score, rank FROM hits""",
    "bit_rerank": f"""WITH {VECS}, {QUERIES}, {_dense(20)}, {MAXSIM_PAIRS},
      pairs AS (SELECT r.qid, q.tok, r.docid, d.tok AS dtok, unnest(q.tv) AS a, unnest(d.tv) AS b
        FROM dense r JOIN qtoks q USING (qid) JOIN toks d USING (docid)),
      sims AS (SELECT qid, tok, docid, dtok, count(*) FILTER (WHERE (a > 0) = (b > 0)) AS sim FROM pairs GROUP BY ALL),
      best AS (SELECT qid, tok, docid, max(sim) AS m FROM sims GROUP BY ALL),
      alls AS (SELECT qid, docid, CAST(sum(m) AS DOUBLE) AS score FROM best GROUP BY ALL), {_ranked('alls', 20, 'hits')}
      SELECT qid, docid, score, rank FROM hits""",
    "top_k": """SELECT lang, CAST(doc_id AS VARCHAR) AS docid, n_chars,
      row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, CAST(doc_id AS VARCHAR)) AS rank FROM documents QUALIFY rank <= 10""",
    "run_experiment": f"""WITH {EXPERIMENT} SELECT lang, query_type, lang || '_' || query_type AS run_id, qid, docid, score, rank FROM (
      SELECT lang, 'bm25' AS query_type, qid, docid, score, rank FROM bm25
      UNION ALL SELECT lang, 'dense', qid, docid, score, rank FROM dense
      UNION ALL SELECT lang, 'hybrid_dense_bm25', qid, docid, score, rank FROM hybrid)""",
    "explain_query": f"""WITH {_bm25(10)}, {VECS}, {_dense(10)}, {_hybrid(10)},
      parts AS (SELECT c.qid, c.docid, 'keyword' AS leg, c.term AS part, round(c.w, 6) AS contribution
        FROM contrib c JOIN bm25 b ON b.qid = c.qid AND b.docid = c.docid
        UNION ALL SELECT qid, docid, 'vector', 'l2', round(1 / (1 + score), 6) FROM dense)
      SELECT h.qid, h.docid, h.rank, p.leg, p.part, p.contribution FROM hybrid h JOIN parts p ON p.qid = h.qid AND p.docid = h.docid""",
    # evaluation
    "recall_at_k": f"WITH {RUNS}, {QRELS}, {_metrics(10)} SELECT run_id, qid, round(recall, 6) AS recall FROM scored",
    "ndcg_at_k": f"WITH {RUNS}, {QRELS}, {_metrics(10)} SELECT run_id, qid, round(ndcg, 6) AS ndcg FROM scored",
    "mean_over_topics": f"""WITH {RUNS}, {QRELS}, {_metrics(100)} SELECT run_id, round(avg(round(recall, 6)), 6) AS mean_recall,
      count(*) AS topics FROM scored GROUP BY run_id""",
    "evaluate_runs": f"""WITH {RUNS}, {QRELS}, {_metrics(100)} SELECT run_id, 'recall@100' AS metric, round(avg(recall), 6) AS value
      FROM scored GROUP BY run_id UNION ALL SELECT run_id, 'ndcg@100', round(avg(ndcg), 6) FROM scored GROUP BY run_id""",
    "evaluate_runs_by_score": f"""WITH {RUNS.replace('runs AS', 'ranked_runs AS')}, runs AS (SELECT run_id, qid, docid, score,
      row_number() OVER (PARTITION BY run_id, qid ORDER BY score DESC, docid DESC) AS rank FROM ranked_runs),
      {QRELS}, {_metrics(10)} SELECT run_id, 'recall@10' AS metric, round(avg(recall), 6) AS value
      FROM scored GROUP BY run_id UNION ALL SELECT run_id, 'ndcg@10', round(avg(ndcg), 6) FROM scored GROUP BY run_id""",
    "final_report": f"""WITH {RUNS}, {QRELS}, {_metrics(10)}, m AS (SELECT run_id, round(avg(recall), 6) AS recall_at_10,
        round(avg(ndcg), 6) AS ndcg_at_10 FROM scored GROUP BY run_id),
      l AS (SELECT CASE event_type WHEN 'click' THEN 'en_bm25' WHEN 'view' THEN 'en_dense' ELSE event_type END AS run_id,
        count(*) AS queries, round(1000 * sum(value) / count(*), 6) AS mean_ms FROM events GROUP BY ALL)
      SELECT coalesce(m.run_id, l.run_id) AS run_id, recall_at_10, ndcg_at_10, queries, mean_ms
      FROM m FULL JOIN l ON l.run_id = m.run_id""",
    "run_benchmark": f"""WITH {TITLES}, {COLLECTION.replace('docs AS', 'pdocs AS').replace('FROM docs d', 'FROM pdocs d')},
      {_bm25(100, '', 'lang').lstrip(', ').replace('FROM documents),', "FROM pdocs JOIN evecs USING (pos)),", 1)},
      dvecs AS (SELECT lang, docid_col AS docid, dense_col AS vec FROM loaded), {VECS},
      dense AS (SELECT q.lang, q.qid, d.docid, row_number() OVER (PARTITION BY q.qid
          ORDER BY round({_dist('v.vec', 'd.vec')}, 6), d.docid) AS rank
        FROM queries q JOIN vecs v ON v.docid = q.qid JOIN dvecs d ON d.lang = q.lang QUALIFY rank <= 100),
      {QRELS}, tq AS (SELECT d.lang, r.qid, r.docid, r.rel FROM qrels r JOIN documents d ON CAST(d.doc_id AS VARCHAR) = r.docid
        JOIN queries q ON q.lang = d.lang AND q.qid = r.qid WHERE rel > 0),
      runs AS (SELECT lang, 'bm25' AS t, qid, docid, rank FROM bm25 UNION ALL SELECT lang, 'dense', qid, docid, rank FROM dense),
      sums AS (SELECT r.lang, r.t, r.qid, count(*) AS hits, sum(rel / log2(rank + 1)) AS dcg
        FROM runs r JOIN tq USING (lang, qid, docid) WHERE rank <= 10 GROUP BY ALL),
      ideal AS (SELECT lang, qid, count(*) AS nrel, sum(rel / log2(rn + 1)) FILTER (WHERE rn <= 10) AS idcg FROM (SELECT *,
        row_number() OVER (PARTITION BY lang, qid ORDER BY rel DESC, docid) AS rn FROM tq) GROUP BY ALL),
      report AS (SELECT i.lang, x.t, round(avg(coalesce(s.hits / i.nrel, 0)), 6) AS recall_at_10, round(avg(coalesce(s.dcg / i.idcg, 0)), 6) AS ndcg_at_10
        FROM ideal i CROSS JOIN (SELECT unnest(['bm25', 'dense']) AS t) x LEFT JOIN sums s ON s.lang = i.lang AND s.qid = i.qid AND s.t = x.t GROUP BY ALL)
      SELECT lang || '_' || t AS run_id, recall_at_10, ndcg_at_10, CAST((SELECT count(*) FROM queries q WHERE q.lang = report.lang) AS BIGINT) AS queries
      FROM report""",
    "ann_recall": f"""WITH {VECS}, {QUERIES}, {CELLS}, {_ann(10)}, dense AS (SELECT q.qid, v.docid,
        row_number() OVER (PARTITION BY q.qid ORDER BY round({_dist('q.qvec', 'v.vec')}, 6), v.docid) AS rank
        FROM qvecs q CROSS JOIN vecs v QUALIFY rank <= 10),
      per AS (SELECT d.qid, avg(CASE WHEN a.docid IS NULL THEN 0 ELSE 1 END) AS r FROM dense d
        LEFT JOIN ann a ON a.qid = d.qid AND a.docid = d.docid GROUP BY d.qid)
      SELECT round(avg(r), 6) AS recall, count(*) AS queries FROM per""",
    # streaming
    "stream_load": """SELECT lang, CAST(doc_id AS VARCHAR) AS docid, text, embedding[1]::DOUBLE AS first_value
      FROM documents JOIN embeddings ON vec_id = doc_id""",
    "stream_encode": _encoded("documents", "doc_id"),
    "stream_search": f"WITH {_bm25(100)} SELECT qid, docid, score, rank, 'bm25' AS query_type FROM bm25",
    # encoders
    "encode_corpus": _encoded("documents", "doc_id"),
    "encode_corpus_by_budget": _encoded("documents", "doc_id"),
    "generate_vectors": f"""WITH entries AS ({_encoded('documents', 'doc_id')}),
      norms AS (SELECT docid, sqrt(sum(val * val)) AS norm FROM entries GROUP BY docid), {POSITIONED}
      SELECT pos, dim, round(CAST(val / norm AS FLOAT)::DOUBLE, 4) AS val FROM entries JOIN norms USING (docid)
      JOIN docs ON CAST(doc_id AS VARCHAR) = docid""",
    "encode_queries": _encoded("benchmark", "item_id").replace("docid", "qid"),
    "encode_multivector": f"""SELECT conv_id, turn, CAST(tok AS BIGINT) AS tok, dim, CAST(sign AS DOUBLE) AS val FROM
      (SELECT conv_id, turn, tok, {_hash('token', 16)} FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS tok, token
        FROM (SELECT conv_id, turn, unnest(range(len(w))) AS i, unnest(w) AS token FROM
          (SELECT conv_id, turn, string_split_regex(text, '[ \\t\\r\\n]+') AS w FROM conversations)) WHERE token <> ''))""",
}

ORACLE = {key: _flat(sql) for key, sql in ORACLE.items()}
