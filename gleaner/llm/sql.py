"""DuckDB SQL of the registered queries that SQL can express."""

from gleaner.llm.queries import URL_RULES

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lower(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{UPPER.lower()}')"


def _words(text: str, word: str) -> str:
    return f"regexp_extract_all({_lower(f'coalesce({text}, {chr(39) * 2})')}, '{word}')"


BLANK_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _runs(words: str, n: str) -> str:
    """All runs of ``n`` words, with their starts from 0."""
    return f"list_transform(range(0, len({words}) - {n} + 1), lambda i: {{'nr': i, 'g': array_to_string({words}[i + 1:i + {n}], ' ')}})"


NGRAM_JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, {_words('text', BLANK_WORD)} AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, r.g FROM (SELECT doc_id, unnest({_runs('w', 'least(5, len(w))')}) AS r FROM w WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
  l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
  r AS (SELECT doc_id AS node, doc_id AS low FROM documents UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.node),
  m AS (SELECT node, min(low) AS component_id FROM r GROUP BY node)
  SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
  FROM documents d LEFT JOIN n USING (doc_id) JOIN m ON m.node = d.doc_id"""

WINNOWING = f"""WITH w AS (SELECT doc_id, {_words('text', ALNUM_WORD)} AS w FROM documents),
  b AS (SELECT item_id, {_words('text', ALNUM_WORD)} AS w FROM benchmark),
  bw AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
  win AS (SELECT DISTINCT item_id, n, r.g FROM (SELECT item_id, n, unnest({_runs('w', 'n')}) AS r FROM bw)),
  here AS (SELECT doc_id, n, r.nr, r.g FROM (SELECT doc_id, n, unnest({_runs('w', 'n')}) AS r
    FROM w, (SELECT DISTINCT n FROM win) k WHERE len(w) >= n)),
  hits AS (SELECT here.doc_id, here.nr, here.n, win.item_id FROM here JOIN win ON here.n = win.n AND here.g = win.g),
  pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(nr, nr + n)) AS p FROM hits) GROUP BY doc_id),
  items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS list
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
  SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.w) AS contaminated
  FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)"""

# 5 hex digits of a SHA-1 are 4 characters of base 32.
WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
  f AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex),
  c AS (SELECT page_id, html, first, list_transform(range(0, 8), lambda i: CAST('0x' || hex[i * 5 + 1:i * 5 + 5] AS BIGINT)) AS v FROM p JOIN f USING (hex))
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST((v[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1]), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to FROM c"""

URL_FILTER = f"""WITH r(h, p, v) AS (VALUES {', '.join(map(str, URL_RULES))}),
  u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
  s AS (SELECT page_id, {_lower("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
  SELECT page_id, any_value(host) AS host, any_value(path) AS path, arg_max(h || p, length(h || p)) AS rule,
    coalesce(arg_max(v, length(h || p)), 'allow') AS verdict
  FROM s LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id"""

TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.v, v.v) AS BIGINT) AS score
    FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s QUALIFY rank <= 5"""

COLLOCATIONS = f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex({_lower("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
  w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
  sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
  g AS (SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g FROM w, range(1, 5) t(k)),
  f AS (SELECT lang, g, len(g) AS k, array_to_string(g, ' ') AS phrase, count(*) AS f FROM g GROUP BY lang, g HAVING count(*) >= 30),
  c AS (SELECT * FROM f WHERE k > 1),
  part AS (SELECT lang, f, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: array_to_string(g[i:i + m - 1], ' '))))) AS phrase
    FROM c WHERE k > 2),
  inside AS (SELECT lang, phrase, max(f) AS most FROM part GROUP BY lang, phrase),
  kept AS (SELECT c.* FROM c LEFT JOIN inside i USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * f),
  cut AS (SELECT lang, phrase, f AS a, g, k, unnest(range(1, k)) AS m FROM kept),
  scored AS (SELECT cut.lang, cut.phrase, a, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (x.f + y.f) AS BIGINT) AS score
    FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(cut.g[1:m], ' ')
      JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(cut.g[m + 1:cut.k], ' ')
    QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.phrase ORDER BY score, m) = 1)
  SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, n, score
  FROM scored JOIN sizes USING (lang) QUALIFY rank <= 2000"""

ORACLE: dict[str, str] = {
    "op1_ngram_jaccard": NGRAM_JACCARD,
    "op4_winnowing": WINNOWING,
    "op6_warc_index": WARC,
    "op7_url_filter": URL_FILTER,
    "op9_pivot_top_k": TOP_K,
    "op11_collocations": COLLOCATIONS,
}
