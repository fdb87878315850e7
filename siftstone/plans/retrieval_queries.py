"""Checked queries of lexical, semantic and auto search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import embed as E
from ..operators import lexical, postings
from ..operators import search as S
from ..operators.vector import vector_knn
from . import sql as Q
from .text_queries import document_ctes, document_hash
from .views import view, with_views

# A cut that leaves some queries with hits and some with none.
NEAR_CUT = 0.97


def lexical_search(spark, sf):
    return postings.lexical_search(view(spark, sf, "queries_v"), view(spark, sf, "symbols_v"))


def lexical_search_indexed(spark, sf):
    """The same hits by an inverted index."""
    return postings.search_postings(postings.build_postings(view(spark, sf, "symbols_v")), view(spark, sf, "queries_v"))


def vector_knn_all(spark, sf):
    return vector_knn(view(spark, sf, "vector_queries_v"), view(spark, sf, "embeddings_v"), 10)


def vector_knn_cells(spark, sf):
    """The way for query sets too large to broadcast."""
    return vector_knn(view(spark, sf, "vector_queries_v"), view(spark, sf, "embeddings_v"), 10, broadcast_components=0)


def semantic_max_distance(spark, sf):
    nearest = vector_knn(view(spark, sf, "near_queries_v"), view(spark, sf, "embeddings_v"), 50)
    return S.within_distance(nearest, NEAR_CUT)


def semantic_search(spark, sf):
    return S.semantic_search(view(spark, sf, "near_queries_v"), view(spark, sf, "symbols_v"),
                             view(spark, sf, "embeddings_v"), max_distance=NEAR_CUT)


def semantic_search_uncut(spark, sf):
    return S.semantic_search(view(spark, sf, "queries_v"), view(spark, sf, "symbols_v"), view(spark, sf, "embeddings_v"), max_distance=0)


def _auto(spark, sf):
    return S.auto_search(view(spark, sf, "near_queries_v"), view(spark, sf, "symbols_v"),
                         view(spark, sf, "embeddings_v"), max_distance=NEAR_CUT)


def auto_search(spark, sf):
    return _auto(spark, sf)


def unknown_modes(spark, sf):
    return S.unknown_modes(view(spark, sf, "queries_v"))


def overfetch_rerank(spark, sf):
    nearest = S.neighbours(view(spark, sf, "near_queries_v"), view(spark, sf, "symbols_v"), view(spark, sf, "embeddings_v"))
    found = S.candidates(nearest, view(spark, sf, "symbols_v"))
    order = S.Window.partitionBy("query_id").orderBy("sort_distance", "distance", *lexical.ORDER)
    return found.withColumn("rank", F.row_number().over(order)).filter("rank <= 10").select(
        "query_id", "rank", "candidate_rank", "path", "distance", "sort_distance")


def prefer_lexical(spark, sf):
    rows = view(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("query_id"),
        F.when(F.col("event_type") == "click", "RunCLI").when(F.col("event_type") == "view", "db").otherwise(F.col("event_type")).alias("text"),
        F.when(F.col("event_id") % 11 != 0, 0.75 + (F.col("user_id") % 20) / 100).alias("semantic_distance"),
        F.when(F.col("event_id") % 13 != 0, (F.col("event_id") % 21) / 20).alias("lexical_score"))
    return S.prefer_lexical(rows)


def project_hits(spark, sf):
    hits = view(spark, sf, "symbols_v").select(
        F.col("container").alias("query_id"),
        F.col("line").alias("rank"), "path", "symbol_id", "line", "qualified_name",
        F.when(F.col("kind") == "type", "lexical").otherwise("semantic").alias("metric"),
        F.when(F.col("kind") != "type", F.col("doc_id") / 8192).alias("distance"))
    shown = S.project_hits(hits, view(spark, sf, "symbols_v"), "/data/repo", details=True)
    return shown.select("query_id", "rank", "path", "line", "metric", "kind", "name", "qualified_name", F.round("distance", 9).alias("distance"),
                        "documentation", F.md5("body").alias("body"))


def search_envelopes(spark, sf):
    hits = S.project_hits(_auto(spark, sf), view(spark, sf, "symbols_v"), details=True)
    envelopes = S.search_envelopes(view(spark, sf, "near_queries_v"), hits, "local", "hash64")
    shown = F.transform("hits", lambda hit: F.concat(hit["rank"].cast("string"), F.lit(". "), hit["path"], F.lit(":"), hit["line"].cast("string")))
    return envelopes.withColumn("hits", F.array_join(shown, "\n"))


def embed_documents(spark, sf):
    symbols = view(spark, sf, "symbols_v").drop("embedding_hash", "provider", "model_id")
    keyed = E.document_keys(symbols, "local", "hash64")
    stored = view(spark, sf, "embeddings_v")
    vectors = E.embed_documents(E.embedding_misses(keyed, stored), E.hashing_embedder(64), 64)
    return vectors.select("embedding_hash", "dim", F.size("embedding").alias("components"))


_LEX = Q.lexical_ctes()
_NEAR = Q.lexical_ctes("near_queries_v") + "," + Q.semantic_ctes("near_queries_v", "embeddings_v")
_VIEWS = ("queries_v", "symbols_v", "embeddings_v")
_NEAR_VIEWS = ("near_queries_v", "symbols_v", "embeddings_v")
_RANKED = f"""SELECT query_id, rank::INT AS rank, path, line, qualified_name, symbol_id, distance, sort_distance, lexical_score FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {Q.SEMANTIC_ORDER}) AS rank FROM found"""
_TOKENS = Q.query_tokens("text")
_ROUTE = rf"""len({_TOKENS}) > 0 AND ((NOT regexp_matches(trim(text), '\s') AND (regexp_matches(text, '[\p{{Nd}}/._:()\[\]{{}}-]')
 OR (regexp_matches(text, '\p{{Lu}}') AND regexp_matches(text, '\p{{Ll}}')))) OR (len({_TOKENS}) = 1 AND length(({_TOKENS})[1]) <= 3))"""
_KNN = f"""SELECT query_id, embedding_hash, distance, candidate_rank::INT AS candidate_rank FROM (SELECT q.query_id, e.embedding_hash, {Q.distance('q.query_vector', 'e.embedding')} AS distance,
 row_number() OVER (PARTITION BY q.query_id ORDER BY {Q.distance('q.query_vector', 'e.embedding')}, e.embedding_hash) AS candidate_rank
 FROM vector_queries_v q, embeddings_v e) WHERE candidate_rank <= 10"""

_AUTO = f"""{_NEAR},
modes AS (SELECT query_id, text, lower(trim(coalesce(nullif(trim(mode), ''), 'auto'))) AS mode FROM near_queries_v),
routed AS (SELECT query_id, mode, CASE WHEN mode IN ('lexical', 'semantic') THEN mode WHEN {_ROUTE} THEN 'lexical' ELSE 'semantic' END AS route FROM modes WHERE mode IN ('auto', 'semantic', 'lexical')),
kept AS (SELECT f.* FROM found f JOIN routed r ON f.query_id = r.query_id WHERE r.route = 'semantic' AND (f.distance <= {NEAR_CUT}
 OR (r.mode = 'auto' AND NOT EXISTS (SELECT 1 FROM found g WHERE g.query_id = f.query_id AND g.distance <= {NEAR_CUT})))),
semantic AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {Q.SEMANTIC_ORDER}) AS rank FROM kept) WHERE rank <= 10),
auto AS (SELECT query_id, rank::INT AS rank, path, line, qualified_name, symbol_id, distance, sort_distance, lexical_score, 'semantic' AS metric FROM semantic
UNION ALL SELECT t.query_id, t.rank::INT, path, line, qualified_name, symbol_id, NULL, NULL, lexical_score, 'lexical' FROM top_lexical t JOIN routed r ON t.query_id = r.query_id
WHERE r.route = 'lexical' OR (r.mode <> 'semantic' AND t.query_id NOT IN (SELECT query_id FROM semantic)))"""

QUERIES = {
    "lexical_search": (lexical_search, with_views(f"WITH {_LEX} SELECT query_id, path, line, qualified_name, symbol_id, lexical_score, rank::INT AS rank FROM top_lexical", *_VIEWS)),
    "lexical_search_indexed": (lexical_search_indexed, with_views(f"WITH {_LEX} SELECT query_id, path, line, qualified_name, symbol_id, lexical_score, rank::INT AS rank FROM top_lexical", *_VIEWS)),
    "vector_knn": (vector_knn_all, with_views(_KNN, "vector_queries_v", "embeddings_v")),
    "vector_knn_cells": (vector_knn_cells, with_views(_KNN, "vector_queries_v", "embeddings_v")),
    "semantic_max_distance": (semantic_max_distance, with_views(f"""WITH {_NEAR.replace('WHERE e.embedding_hash IN (SELECT embedding_hash FROM symbols_v)', '')}
 SELECT query_id, embedding_hash, distance, candidate_rank::INT AS candidate_rank FROM nearest WHERE distance <= {NEAR_CUT}""", *_NEAR_VIEWS)),
    "semantic_search": (semantic_search, with_views(f"WITH {_NEAR} {_RANKED} WHERE distance <= {NEAR_CUT}) WHERE rank <= 10", *_NEAR_VIEWS)),
    "semantic_search_uncut": (semantic_search_uncut, with_views(
        f"WITH {_LEX}, {Q.semantic_ctes('queries_v', 'embeddings_v')} {_RANKED}) WHERE rank <= 10", *_VIEWS)),
    "auto_search": (auto_search, with_views(f"WITH {_AUTO} SELECT * FROM auto", *_NEAR_VIEWS)),
    "unknown_modes": (unknown_modes, with_views("""SELECT query_id, mode, 'unknown-mode' AS error FROM queries_v
 WHERE lower(trim(coalesce(mode, ''))) NOT IN ('', 'auto', 'semantic', 'lexical')""", "queries_v")),
    "overfetch_rerank": (overfetch_rerank, with_views(f"""WITH {_NEAR} SELECT query_id, rank::INT AS rank, candidate_rank::INT AS candidate_rank, path, distance, sort_distance FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sort_distance, distance, path, line, qualified_name, symbol_id) AS rank FROM found) WHERE rank <= 10""", *_NEAR_VIEWS)),
    "prefer_lexical": (prefer_lexical, """SELECT event_id::VARCHAR AS query_id, CASE WHEN event_id % 13 = 0 THEN FALSE WHEN event_id % 11 = 0 THEN TRUE
 ELSE event_type IN ('click', 'view') AND ((0.75::DOUBLE + (user_id % 20)::DOUBLE / 100 > 0.88 AND (event_id % 21)::DOUBLE / 20 >= 0.55)
  OR (0.75::DOUBLE + (user_id % 20)::DOUBLE / 100 > 0.82 AND (event_id % 21)::DOUBLE / 20 >= 0.8)) END AS prefer_lexical FROM events"""),
    "project_hits": (project_hits, with_views("""SELECT container AS query_id, line AS rank, path, line, CASE WHEN kind = 'type' THEN 'lexical' ELSE printf('%.4f', doc_id::DOUBLE / 8192) END AS metric, kind, name, qualified_name,
 CASE WHEN kind = 'type' THEN 0 ELSE round(doc_id::DOUBLE / 8192, 9) END AS distance, documentation, md5(body) AS body FROM symbols_v""", "symbols_v")),
    "search_envelopes": (search_envelopes, with_views(f"""WITH {_AUTO} SELECT q.query_id, {Q.trim_space('any_value(q.text)')} AS query, any_value(q.mode) AS mode, 'local' AS provider, 'hash64' AS model_id,
 count(a.path)::INT AS result_count, coalesce(string_agg(concat(a.rank, '. ', a.path, ':', a.line), chr(10) ORDER BY a.rank) FILTER (a.path IS NOT NULL), '') AS hits
 FROM near_queries_v q LEFT JOIN auto a ON q.query_id = a.query_id GROUP BY q.query_id""", *_NEAR_VIEWS)),
    "embed_documents": (embed_documents, with_views(f"""WITH {document_ctes("'generic'")}
 SELECT {document_hash()} AS embedding_hash, 64::INT AS dim, 64::INT AS components FROM docs""", "symbols_v")),
}
