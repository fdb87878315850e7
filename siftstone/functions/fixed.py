"""Results depend on every one of them, so they are plain data."""

# Search-token synonyms.
SYNONYMS = {
    "database": ["db", "sqlite", "sql"],
    "db": ["database", "sqlite", "sql"],
    "sqlite": ["database", "db", "sql"],
    "sql": ["sqlite", "database", "db"],
    "library": ["lib", "libraries"],
    "libraries": ["library", "lib"],
    "lib": ["library", "libraries"],
    "embedding": ["embeddings", "vector", "vectors"],
    "embeddings": ["embedding", "vector", "vectors"],
    "vector": ["embedding", "embeddings", "vectors"],
    "vectors": ["vector", "embedding", "embeddings"],
    "search": ["query", "retrieval"],
    "query": ["search", "retrieval"],
    "runtime": ["shared", "library", "libraries"],
    "model": ["gguf", "embedding"],
    "cache": ["cached"],
}

# Weight of a token variant by how it was made.
EXACT_WEIGHT, SINGULAR_WEIGHT, PLURAL_WEIGHT, SYNONYM_WEIGHT = 1.0, 0.92, 0.88, 0.72

# Default path weights: glob -> ranking weight, smallest matching weight wins.
DEFAULT_PATH_WEIGHTS = {
    "**/*_test.*": 0.82,
    "**/*.test.*": 0.84,
    "**/*.spec.*": 0.84,
    "**/test_*.py": 0.84,
    "**/test/**": 0.9,
    "**/tests/**": 0.9,
    "**/testdata/**": 0.78,
    "**/spec/**": 0.9,
    "**/specs/**": 0.9,
    "**/example*.*": 0.88,
    "**/example*/**": 0.88,
    "**/examples/**": 0.88,
    "**/sample*/**": 0.9,
    "**/samples/**": 0.9,
    "**/demo/**": 0.9,
    "**/demos/**": 0.9,
    "**/benchmark*/**": 0.9,
    "**/benchmarks/**": 0.9,
    "**/*_bench.*": 0.9,
    "**/fixture*/**": 0.84,
    "**/fixtures/**": 0.84,
    "**/__fixtures__/**": 0.84,
    "**/mock*/**": 0.9,
    "**/mocks/**": 0.9,
    "**/__mocks__/**": 0.9,
    "**/stubs/**": 0.9,
    "**/vendor/**": 0.72,
    "**/third_party/**": 0.78,
    "**/dist/**": 0.7,
    "**/build/**": 0.72,
    "**/node_modules/**": 0.35,
}

# Top-level directories that are never indexed.
SKIPPED_TOP_DIRS = [".git", ".semsearch"]

# Binary sniffing.
SNIFF_BYTES, SUSPICIOUS_PERCENT = 8192, 10

# Directive prefixes and frames of the line-based extractor.
SEARCH_PREFIX, CONTEXT_PREFIX = "@search:", "@filectx:"
FOLLOWING_LINES = 10

# Snippet lengths in lines.
SIGNATURE_LINES, BODY_LINES, VALUE_LINES, ARROW_SIGNATURE_LINES = 4, 10, 6, 2

# Search defaults.
DEFAULT_LIMIT, DEFAULT_MAX_DISTANCE = 10, 0.85
OVERFETCH_FACTOR, OVERFETCH_MIN = 5, 20
DEFAULT_PROVIDER, DEFAULT_MODEL = "llama.cpp", "embeddinggemma"

# Lexical score terms.
PHRASE_IN_TEXT, PHRASE_IN_DOCUMENT = 0.7, 0.35
BASENAME_TERM, PATH_TERM = 0.03, 0.01
TEXT_TERM, PATH_ONLY_TERM = 0.45, 0.1
ALL_IN_TEXT, ALL_IN_DOCUMENT, ALL_TOLERANCE = 0.25, 0.12, 0.999
SINGLE_TOKEN_TERM = 0.2

# Auto mode: lexical results win at (distance above, score at least).
LEXICAL_WINS = [(0.88, 0.55), (0.82, 0.8)]

# Document and query formats by profile.
PROFILE_REVISIONS = {"gemma": "embeddinggemma-v4", "qwen": "qwen3-embedding-v1", "generic": "generic-v1"}
GEMMA_QUERY_PREFIX = "task: code retrieval | query: "
QWEN_INSTRUCTION = (
    "Given a code search query, retrieve relevant code symbols and documentation that answer the query."
)
MODEL_ALIASES = {
    "gemma": ["default", "embeddinggemma", "gemma", "embeddinggemma-300m"],
    "qwen": ["qwen3", "qwen3-embedding", "qwen3embedding", "qwen"],
}
MODEL_IDS = {"gemma": "embeddinggemma", "qwen": "qwen3"}
DOCUMENT_HASH_HEADER = "embedding_doc_format:"
PROVIDER_ALIASES = {"": "llama.cpp", "llama.cpp": "llama.cpp", "llama": "llama.cpp", "llamacpp": "llama.cpp",
                    "openrouter": "openrouter"}
FINGERPRINT_VERSION = "index-input-v1"

# Evaluation.
MAX_SCORED_RANK, REPORT_ROWS = 10, 10
TOP1_SHARE, TOP3_SHARE, MRR_SHARE = 0.5, 0.2, 0.3
MODE_ORDER = ["auto", "semantic", "lexical"]
PLATFORM_ORDER = [
    ("linux", "amd64"), ("linux", "arm64"), ("darwin", "arm64"),
    ("darwin", "amd64"), ("windows", "amd64"), ("windows", "arm64"),
]

# Patterns of the tool logs.
HIT_LINE = r"(?m)^\s*(\d+)\.\s+(.+):(\d+)\s{2,}.*$"
NO_HITS = "No matches found"
INDEX_LINE = r"Indexed\s+(\d+)\s+symbols\s+in\s+(\d+)\s+files"
INDEX_UP_TO_DATE = "Index already up to date"
COMMIT_PATTERN = "^[a-f0-9]{40}$"

# Schema version a manifest without one has.
MANIFEST_SCHEMA_VERSION = 1
