"""Checked queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import documents as D
from ..functions import metrics as M
from ..functions import paths as P
from ..functions import text as X
from ..operators import lexical
from ..operators.search import sort_distance
from ..operators.vector import l2_normalize
from . import sql as Q
from .views import view, with_views

TURN = ["conv_id", "turn"]


def normalize_text(spark, sf):
    return view(spark, sf, "documents").select("doc_id", F.md5(X.normalize_text(F.col("text"))).alias("text_digest"),
                                               F.char_length(X.normalize_text(F.col("text"))).alias("chars"))


def query_tokens(spark, sf):
    tokens = view(spark, sf, "query_texts_v").select("query_id", F.posexplode(X.query_tokens(F.col("text"))).alias("at", "token"))
    return tokens.select("query_id", (F.col("at") + 1).alias("token_no"), "token")


def token_variants(spark, sf):
    words = view(spark, sf, "documents").select(F.explode(X.query_tokens(F.col("text"))).alias("token"))
    extra = spark.createDataFrame([(key,) for key in X.fixed.SYNONYMS], "token string")
    return lexical.expand_variants(words.unionByName(extra))


def lexical_score(spark, sf):
    pairs = view(spark, sf, "turn_pairs_v").select(
        *TURN, "text", X.normalize_text(F.col("body")).alias("text_norm"), X.normalize_text(F.col("path")).alias("path_norm"),
        X.normalize_text(P.base_name(F.col("path"))).alias("base_norm"))
    return lexical.score_pairs(pairs, TURN).select(*TURN, F.round("lexical_score", 9).alias("lexical_score"))


def path_weights(spark, sf):
    return view(spark, sf, "paths_v").distinct().select("path", P.path_weight(F.col("path")).alias("weight"))


#: A caller's own path rules.
OWN_WEIGHTS = {"src/**": 0.5, "vendor/**": 0.25}


def own_path_weights(spark, sf):
    return view(spark, sf, "symbols_v").select("doc_id", P.path_weight(F.col("path"), OWN_WEIGHTS).alias("weight"))


def semantic_sort_distance(spark, sf):
    rows = view(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 40).alias("d"),
                                              (F.col("l_discount") * 11).alias("w"))
    return rows.select("l_orderkey", "l_linenumber", F.round(sort_distance(F.col("d"), F.col("w")), 12).alias("sort_distance"))


def result_text(spark, sf):
    return view(spark, sf, "symbols_v").select("doc_id", F.md5(X.result_text()).alias("digest"))


def symbol_search_text(spark, sf):
    return view(spark, sf, "symbols_v").select("doc_id", F.md5(X.symbol_search_text()).alias("digest"))


def stable_symbol_id(spark, sf):
    bare = view(spark, sf, "events").select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("row_id"), F.lit(" ").alias("kind"), F.lit("").alias("qualified_name"),
        F.lit("").alias("signature"), F.col("event_type").alias("name"), F.col("user_id").cast("int").alias("line"))
    full = view(spark, sf, "symbols_v").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("row_id"), "kind", "qualified_name", "signature", "name", "line")
    return full.unionByName(bare).select("row_id", D.stable_symbol_id().alias("symbol_id"))


def normalize_embedding_text(spark, sf):
    dirty = F.concat(F.lit(" \r\n"), F.replace("text", F.lit(". "), F.lit(".\r\n")), F.lit("\x00\r"))
    return view(spark, sf, "conversations").select(*TURN, D.normalize_embedding_text(dirty).alias("text"))


def _documents(spark, sf):
    symbols = view(spark, sf, "symbols_v")
    profile = F.when(F.col("kind") == "function", "gemma").when(F.col("kind") == "type", "qwen").otherwise("generic")
    return D.build_documents(symbols.withColumn("profile", profile), F.col("profile")).select("doc_id", "profile", "document")


def build_documents(spark, sf):
    return _documents(spark, sf).select("doc_id", "profile", F.left("document", F.lit(40)).alias("head"), F.md5("document").alias("digest"))


def embedding_hash(spark, sf):
    return _documents(spark, sf).select("doc_id", D.embedding_hash(F.col("profile"), F.col("document")).alias("embedding_hash"))


def format_queries(spark, sf):
    profile = F.when(F.col("mode") == "auto", "gemma").when(F.col("mode") == "semantic", "qwen").otherwise("generic")
    return view(spark, sf, "query_texts_v").select("query_id", D.format_query(profile, F.col("text")).alias("formatted"))


def resolve_models(spark, sf):
    model = F.col("model")
    return view(spark, sf, "model_names_v").select(
        "p_partkey", D.resolve_profile(model).alias("profile"), F.coalesce(D.resolve_model_id(model), F.lit("")).alias("model_id"),
        D.profile_revision(D.resolve_profile(model)).alias("revision"))


def normalize_modes(spark, sf):
    return view(spark, sf, "model_names_v").select(
        "p_partkey", F.coalesce(D.normalize_mode(F.col("mode")), F.lit("error")).alias("mode"),
        F.coalesce(D.normalize_provider(F.col("provider")), F.lit("error")).alias("provider"))


def l2_normalized(spark, sf):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") - 3))
    return view(spark, sf, "embeddings").select("vec_id", F.posexplode(l2_normalize(scaled)).alias("place", "x")).select(
        "vec_id", "place", (F.round("x", 9) + 0.0).alias("x"))


def scanner_fingerprint(spark, sf):
    excludes = F.array(F.concat("p_type", F.lit("/")), F.concat(F.lit("*."), F.col("p_name")), F.col("p_brand"))
    return view(spark, sf, "part").select("p_partkey", D.scanner_fingerprint(F.concat(F.lit(" "), F.col("p_name")), F.lit("@filectx: "), excludes).alias("fingerprint"))


def compact_fields(spark, sf):
    text = F.col("text")
    return view(spark, sf, "conversations").select(
        *TURN, X.compact(text, 80).alias("c80"), X.compact(text, 3).alias("c3"), F.md5(X.compact(text, 0)).alias("whole"))


def format_metrics(spark, sf):
    counts = F.map_from_arrays(F.array(F.lit("lexical"), F.lit("zeta"), F.lit("auto")), F.array("l_linenumber", "l_linenumber", F.lit(2)))
    return view(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", M.format_duration_ms(F.col("l_extendedprice") / 20).alias("duration"),
        M.format_mode_counts(counts).alias("modes"), M.short_commit(F.md5(F.col("l_orderkey").cast("string"))).alias("commit"),
        M.hit_ref(F.concat(F.lit(" "), F.col("l_returnflag")), F.col("l_linenumber")).alias("ref"))


def clean_docstrings(spark, sf):
    return view(spark, sf, "literals_v").select(*TURN, X.clean_docstring(F.col("literal")).alias("doc"))


def container_names(spark, sf):
    part = view(spark, sf, "part")
    name = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    receiver = F.concat(F.lit("("), F.col("p_type"), F.lit(" *"), name, F.lit(")"))
    impl = F.concat(F.when(F.col("p_size") % 2 == 0, "&mut ").otherwise(" & "), name, F.lit("<T> "))
    return part.select("p_partkey", X.go_receiver(receiver).alias("go_name"), X.rust_impl_type(impl).alias("rust_name"))


def constant_names(spark, sf):
    names = view(spark, sf, "part").select(F.explode(F.array(F.upper("p_type"), F.col("p_brand"), F.upper("p_name"), F.lit(""))).alias("name")).distinct()
    return names.select("name", X.is_constant_name(F.col("name")).alias("is_constant"))


def relative_paths(spark, sf):
    return view(spark, sf, "paths_v").distinct().select("path", P.relative_path(F.col("path"), "/data/repo").alias("relative"))


def route_queries(spark, sf):
    texts = view(spark, sf, "query_texts_v").select("query_id", "text").unionByName(
        view(spark, sf, "pages").select(F.concat(F.lit("u"), F.col("page_id").cast("string")).alias("query_id"), F.col("url").alias("text"))
    ).unionByName(view(spark, sf, "documents").select(
        F.concat(F.lit("w"), F.col("doc_id").cast("string")).alias("query_id"), "text"))
    return texts.select("query_id", X.prefers_lexical(F.col("text")).alias("prefers_lexical"))


_N = Q.normalize_text
_clean = lambda x: (
    f"replace(replace({Q.trim_space(f'replace({x}, chr(0), {Q.quote('')})')}, chr(13) || chr(10), chr(10)), chr(13), chr(10))")
_DOC_BODY = """concat('Path: ', path, chr(10), 'Kind: ', kind, CASE WHEN c_name <> '' THEN concat(chr(10), 'Name: ', c_name) ELSE '' END,
 CASE WHEN c_qual <> '' AND c_qual <> c_name THEN concat(chr(10), 'Qualified name: ', c_qual) ELSE '' END,
 CASE WHEN c_sig <> '' THEN concat(chr(10), 'Signature:', chr(10), c_sig) ELSE '' END, CASE WHEN c_doc <> '' THEN concat(chr(10), 'Documentation:', chr(10), c_doc) ELSE '' END,
 chr(10), 'File context:', chr(10), file_context, CASE WHEN c_body <> '' THEN concat(chr(10), 'Body snippet:', chr(10), c_body) ELSE '' END)"""
_BY_KIND = "CASE kind WHEN 'function' THEN 'gemma' WHEN 'type' THEN 'qwen' ELSE 'generic' END"
_REVISION = "CASE profile WHEN 'gemma' THEN 'embeddinggemma-v4' WHEN 'qwen' THEN 'qwen3-embedding-v1' ELSE 'generic-v1' END"


def document_ctes(profile: str = _BY_KIND) -> str:
    """CTEs up to ``docs(doc_id, profile, document)`` over the symbol view."""
    return f"""cleaned AS (SELECT *, {_clean('name')} AS c_name, {_clean('qualified_name')} AS c_qual, {_clean('signature')} AS c_sig,
 {_clean('documentation')} AS c_doc, {_clean('body')} AS c_body, {profile} AS profile FROM symbols_v),
docs AS (SELECT doc_id, profile, CASE WHEN profile = 'gemma' THEN concat('title: ', replace(concat({Q.base_name('path')}, ' ', c_qual), '|', '/'), ' | text: ', {_DOC_BODY})
 ELSE concat('Title: ', replace(concat({Q.base_name('path')}, ' ', c_qual), '|', '/'), chr(10), {_DOC_BODY}) END AS document FROM cleaned)"""


def document_hash() -> str:
    return f"md5({Q.trim_space(f'concat({Q.quote(X.fixed.DOCUMENT_HASH_HEADER)}, {_REVISION}, chr(10), document)')})"


_REL = """CASE WHEN NOT starts_with(path, '/') THEN regexp_replace(regexp_replace(path, '^[.]/', ''), '/$', '')
 WHEN starts_with(path, '/data/repo/') THEN regexp_extract(path, '([0-9]+)//', 1) || '/f.go' ELSE path END"""
# Words as they are told apart, without the steps of the tokeniser; whole documents are routed, so each term is linear.
_WORDS = r"list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+'))"
_ROUTE = rf"""regexp_matches(text, '[\p{{L}}\p{{Nd}}]') AND ((NOT regexp_matches(trim(text), '\s') AND (regexp_matches(text, '[\p{{Nd}}/._:()\[\]{{}}-]')
 OR (regexp_matches(text, '\p{{Lu}}') AND regexp_matches(text, '\p{{Ll}}')))) OR (len({_WORDS}) = 1 AND length(({_WORDS})[1]) <= 3))"""
_TURN_SCORE = f"""WITH asked AS (SELECT conv_id, turn, {_N('text')} AS phrase, {Q.query_tokens('text')} AS tokens, {_N('body')} AS tn, {_N('path')} AS pn, {_N(Q.base_name('path'))} AS bn FROM turn_pairs_v),
tok AS (SELECT *, len(tokens) AS n, unnest(tokens) AS token FROM asked), distinct_tokens AS (SELECT DISTINCT token FROM tok), variants AS ({Q.variants('distinct_tokens')}),
best AS (SELECT conv_id, turn, phrase, tn, pn, n, t.token, max(CASE WHEN contains(tn, variant) THEN weight ELSE 0 END) AS wt,
 max(CASE WHEN contains(concat(tn, ' ', pn), variant) THEN weight ELSE 0 END) AS wd, max(CASE WHEN contains(bn, variant) THEN weight ELSE 0 END) AS wb,
 max(CASE WHEN contains(pn, variant) THEN weight ELSE 0 END) AS wp FROM tok t JOIN variants v ON t.token = v.token GROUP BY ALL),
sums AS (SELECT conv_id, turn, phrase, tn, pn, n, sum(wt) AS st, sum(wd) AS sd, sum(CASE WHEN wb > 0 THEN 0.03 * wb ELSE 0.01 * wp END) AS near FROM best GROUP BY ALL)
SELECT conv_id, turn, round(least(1.0::DOUBLE, CASE WHEN contains(tn, phrase) THEN 0.7::DOUBLE WHEN contains(concat(tn, ' ', pn), phrase) THEN 0.35::DOUBLE ELSE 0 END + near + 0.45 * st / n
 + CASE WHEN sd > st THEN 0.1 * (sd - st) / n ELSE 0 END + CASE WHEN n > 1 AND st >= 0.999 * n THEN 0.25 WHEN n > 1 AND sd >= 0.999 * n THEN 0.12 ELSE 0 END
 + CASE WHEN n = 1 AND sd > 0 THEN 0.2 * sd ELSE 0 END), 9) AS lexical_score FROM sums"""
_L = r"regexp_replace(lower(trim(model)), '[-_ ]', '', 'g')"
_PROFILE = f"""CASE WHEN {_L} IN ('default', 'embeddinggemma', 'gemma', 'embeddinggemma300m') THEN 'gemma' WHEN {_L} IN ('qwen3', 'qwen3embedding', 'qwen') THEN 'qwen'
 WHEN contains(lower(model), 'embeddinggemma') THEN 'gemma' WHEN contains(lower(model), 'qwen3') AND contains(lower(model), 'embed') THEN 'qwen'
 WHEN contains(lower(model), 'gemma') THEN 'gemma' ELSE 'generic' END"""
_FLAT = r"trim(regexp_replace(text, '[\s\x0B\p{Z}]+', ' ', 'g'))"
_LIT = "replace(literal, chr(13) || chr(10), chr(10))"
_UNQUOTED = """CASE WHEN turn % 5 = 0 OR turn % 5 = 1 THEN literal[4:-4] WHEN turn % 5 IN (2, 3) THEN literal[2:-2] ELSE literal END"""

QUERIES = {
    "own_path_weights": (own_path_weights, with_views("""SELECT doc_id, CASE WHEN starts_with(path, 'vendor/') THEN 0.25::DOUBLE WHEN starts_with(path, 'src/') THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM symbols_v""", "symbols_v")),
    "normalize_text": (normalize_text, f"SELECT doc_id, md5({_N('text')}) AS text_digest, length({_N('text')})::INT AS chars FROM documents"),
    "query_tokens": (query_tokens, with_views(
        f"SELECT query_id, unnest(range(1, len(tokens) + 1))::INT AS token_no, unnest(tokens) AS token FROM (SELECT query_id, {Q.query_tokens('text')} AS tokens FROM query_texts_v)", "query_texts_v")),
    "token_variants": (token_variants, f"""WITH words AS (SELECT DISTINCT unnest(string_split({_N('text')}, ' ')) AS token FROM documents
 UNION SELECT unnest([{', '.join(Q.quote(key) for key in X.fixed.SYNONYMS)}])), toks AS (SELECT token FROM words WHERE token <> '')
SELECT token, variant, weight FROM ({Q.variants('toks')}) WHERE variant <> ''"""),
    "lexical_score": (lexical_score, with_views(_TURN_SCORE, "turn_pairs_v")),
    "path_weights": (path_weights, with_views(
        f"SELECT path, {Q.path_weight('path')} AS weight FROM (SELECT DISTINCT path FROM paths_v)", "paths_v")),
    "semantic_sort_distance": (semantic_sort_distance, """SELECT l_orderkey, l_linenumber, round(CASE WHEN 1 - d <= 0 THEN d
 ELSE 1 - (1 - d) * CASE WHEN w <= 0 OR w > 1 THEN 1 ELSE w END END, 12) AS sort_distance
 FROM (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE / 40 AS d, l_discount::DOUBLE * 11 AS w FROM lineitem)"""),
    "result_text": (result_text, with_views(f"SELECT doc_id, md5({Q.result_text()}) AS digest FROM symbols_v", "symbols_v")),
    "symbol_search_text": (symbol_search_text, with_views(
        f"SELECT doc_id, md5({Q.join_parts('kind', 'name', 'container', 'qualified_name', 'signature', 'documentation', 'file_context', 'body')}) AS digest FROM symbols_v", "symbols_v")),
    "stable_symbol_id": (stable_symbol_id, with_views(f"""SELECT concat('d', doc_id) AS row_id, md5(concat(kind, chr(10), {Q.trim_space('qualified_name')}, chr(10), {Q.trim_space('signature')})) AS symbol_id FROM symbols_v
 UNION ALL SELECT concat('e', event_id), md5(concat(event_type, chr(10), user_id)) FROM events""", "symbols_v")),
    "normalize_embedding_text": (normalize_embedding_text,
        f"SELECT conv_id, turn, replace({Q.trim_space('text')}, '. ', '.' || chr(10)) AS text FROM conversations"),
    "build_documents": (build_documents, with_views(f"WITH {document_ctes()} SELECT doc_id, profile, left(document, 40) AS head, md5(document) AS digest FROM docs", "symbols_v")),
    "embedding_hash": (embedding_hash, with_views(
        f"WITH {document_ctes()} SELECT doc_id, {document_hash()} AS embedding_hash FROM docs", "symbols_v")),
    "format_queries": (format_queries, with_views(f"""SELECT query_id, CASE mode WHEN 'auto' THEN concat('task: code retrieval | query: ', {_clean('text')})
 WHEN 'semantic' THEN concat('Instruct: Given a code search query, retrieve relevant code symbols and documentation that answer the query.', chr(10), 'Query: ', {_clean('text')})
 ELSE {_clean('text')} END AS formatted FROM query_texts_v""", "query_texts_v")),
    "resolve_models": (resolve_models, with_views(f"""SELECT p_partkey, profile, CASE WHEN {_L} IN ('default', 'embeddinggemma', 'gemma', 'embeddinggemma300m') THEN 'embeddinggemma'
 WHEN {_L} IN ('qwen3', 'qwen3embedding', 'qwen') THEN 'qwen3' ELSE '' END AS model_id, {_REVISION} AS revision
 FROM (SELECT *, {_PROFILE} AS profile FROM model_names_v)""", "model_names_v")),
    "normalize_modes": (normalize_modes, with_views("""SELECT p_partkey, CASE WHEN trim(lower(mode)) IN ('', 'auto') THEN 'auto' WHEN trim(lower(mode)) IN ('semantic', 'lexical') THEN trim(lower(mode)) ELSE 'error' END AS mode,
 CASE WHEN trim(lower(provider)) IN ('', 'llama', 'llamacpp', 'llama.cpp') THEN 'llama.cpp' WHEN trim(lower(provider)) = 'openrouter' THEN 'openrouter' ELSE 'error' END AS provider FROM model_names_v""", "model_names_v")),
    "l2_normalize": (l2_normalized, """SELECT vec_id, place::INT AS place, CASE WHEN norm > 0 THEN round(x / norm, 9) ELSE x END + 0.0 AS x FROM (
 SELECT vec_id, unnest(range(64)) AS place, unnest(v) AS x, sqrt(list_sum(list_transform(v, lambda y: y * y))) AS norm
 FROM (SELECT vec_id, list_transform(embedding, lambda y: y::DOUBLE * (label - 3)) AS v FROM embeddings))"""),
    "scanner_fingerprint": (scanner_fingerprint, """SELECT p_partkey, concat('index-input-v1:', md5(array_to_string(['index-input-v1', p_name, '@filectx:',
 array_to_string(list_sort([p_type || '/', '*.' || p_name, p_brand]), chr(0))], chr(31)))) AS fingerprint FROM part"""),
    "compact_fields": (compact_fields, f"""SELECT conv_id, turn, CASE WHEN length(flat) <= 80 THEN flat ELSE left(flat, 77) || '...' END AS c80, left(flat, 3) AS c3, md5(flat) AS whole
 FROM (SELECT conv_id, turn, {_FLAT} AS flat FROM conversations)"""),
    "format_metrics": (format_metrics, """SELECT l_orderkey, l_linenumber, CASE WHEN ms >= 1000 THEN printf('%.2fs', ms / 1000) ELSE printf('%.2fms', ms) END AS duration,
 concat('auto=2 lexical=', l_linenumber, ' zeta=', l_linenumber) AS modes, left(md5(l_orderkey::VARCHAR), 7) AS commit, concat(l_returnflag, ':', l_linenumber) AS ref
 FROM (SELECT *, l_extendedprice::DOUBLE / 20 AS ms FROM lineitem)"""),
    "clean_docstrings": (clean_docstrings, with_views(rf"""SELECT conv_id, turn, {Q.trim_space("array_to_string(list_transform(string_split(bare, chr(10)), lambda x: " + Q.trim_space('x') + "), chr(10))")} AS doc
 FROM (SELECT conv_id, turn, {_UNQUOTED} AS bare FROM literals_v)""", "literals_v")),
    "container_names": (container_names, """SELECT p_partkey, concat(upper(w[1][1]), w[1][2:], upper(w[2][1]), w[2][2:]) AS go_name, concat(upper(w[1][1]), w[1][2:], upper(w[2][1]), w[2][2:], '<T>') AS rust_name
 FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)"""),
    "constant_names": (constant_names, """SELECT name, name <> '' AND NOT regexp_matches(name, '[a-z]') AS is_constant FROM (
 SELECT upper(p_type) AS name FROM part UNION SELECT p_brand FROM part UNION SELECT upper(p_name) FROM part UNION SELECT '' FROM part)"""),
    "relative_paths": (relative_paths, with_views(f"SELECT path, {_REL} AS relative FROM (SELECT DISTINCT path FROM paths_v)", "paths_v")),
    "route_queries": (route_queries, with_views(rf"""SELECT query_id, {_ROUTE} AS prefers_lexical FROM (SELECT query_id, text FROM query_texts_v UNION ALL SELECT concat('u', page_id), url FROM pages
 UNION ALL SELECT concat('w', doc_id), text FROM documents)""", "query_texts_v")),
}
