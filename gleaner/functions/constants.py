"""Fixed values of the retrieval workload (data formats and defaults)."""

# Languages of the collection.
LANGUAGES = ["ar", "de", "en", "es", "fr", "hi", "it", "ja", "ko", "pt", "ru", "th", "zh"]

# Characters of a keyword query that are replaced by a space each.
QUERY_RESERVED_CHARS = "&|!+-–():'\"?~^"

# Length range of a full-text token.
TOKEN_MIN_LEN = 3
TOKEN_MAX_LEN = 84

# Hits per query, rows per load batch, rows per base id.
MAX_HITS = 1000
LOAD_BATCH_SIZE = 1000
BASE_ID_GROUP = 500

# Encoder batch, chunk length.
ENCODE_BATCH_SIZE = 32
CHUNK_CHARS = 512

# Tag of run files, prefix of collection names.
RUN_TAG = "Faiss"
COLLECTION_PREFIX = "test_insert_"

# Names of the query types.
QUERY_TYPES = ["bm25", "dense", "sparse", "colbert", "hybrid_dense_bm25", "fusion_rrf",
               "fusion_weighted"]

# Published BM25 parameters and rank-fusion constant.
BM25_K1 = 1.2
BM25_B = 0.75
RRF_CONSTANT = 60

# Delimiters of full-text tokens: everything but letters, digits and underscore.
TOKEN_DELIMITER = r"[^\p{L}\p{N}_]+"

# Scores are compared and stored with this many decimals.
SCORE_DECIMALS = 6
