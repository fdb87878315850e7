"""Semantic, auto and routed search over the active symbols."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from ..functions.documents import normalize_mode
from ..functions.paths import path_weight
from ..schemas import SYMBOL_TEXT
from ..session import materialize
from . import lexical
from .postings import Postings, lexical_search
from .vector import vector_knn

HASH = ["provider", "model_id", "embedding_hash"]


def overfetch(limit: int) -> int:
    return max(fixed.OVERFETCH_FACTOR * limit, fixed.OVERFETCH_MIN)


def sort_distance(distance: Column, weight: Column) -> Column:
    """Distance after the path weight; only similarity below 1 is weighted."""
    weight = F.when((weight <= 0) | (weight > 1), 1.0).otherwise(weight)
    return F.when(1 - distance <= 0, distance).otherwise(1 - (1 - distance) * weight)


def active_embeddings(embeddings: DataFrame, symbols: DataFrame) -> DataFrame:
    """Vectors the given symbols use, one per hash."""
    return embeddings.join(symbols.select(*HASH).distinct(), HASH, "left_semi")


def neighbours(queries: DataFrame, symbols: DataFrame, embeddings: DataFrame, limit: int = fixed.DEFAULT_LIMIT) -> DataFrame:
    """Nearest active vectors of each query, more of them than ``limit``.

    Written once: the tables below read it several times, and joins pick
    broadcast or shuffle from its real size.
    """
    return materialize(vector_knn(queries, active_embeddings(embeddings, symbols), overfetch(limit)), "neighbours")


def candidates(nearest: DataFrame, symbols: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Symbols of the nearest vectors, with their sort distance.

    ``symbols`` are of one provider and model. A vector may serve many
    symbols; all of them are candidates.
    """
    found = symbols.select("path", "symbol_id", "line", "qualified_name", "embedding_hash").join(nearest, "embedding_hash")
    return found.withColumn("path_weight", path_weight(F.col("path"), weights)).withColumn(
        "sort_distance", F.round(sort_distance(F.col("distance"), F.col("path_weight")), 12))


def _rank_semantic(found: DataFrame, queries: DataFrame, symbols: DataFrame, limit: int) -> DataFrame:
    """Total order of the candidates, cut at ``limit`` per query.

    The lexical score only breaks ties, so it is worked out for the rows at or
    above the ``limit``-th sort distance and distance. That row is found by a
    top-k, which keeps ``limit`` rows per task even where one vector serves a
    large part of all symbols.
    """
    near = Window.partitionBy("query_id").orderBy("sort_distance", "distance", *lexical.ORDER)
    last = (
        found.select("query_id", "sort_distance", "distance", *lexical.ORDER)
        .withColumn("at", F.row_number().over(near)).filter(F.col("at") <= limit)
        .groupBy("query_id").agg(F.max(F.struct("sort_distance", "distance")).alias("last"))
    )
    close = found.join(last, "query_id").filter(F.struct("sort_distance", "distance") <= F.col("last"))
    keep = ["query_id", *lexical.ORDER, "distance", "sort_distance", "path_weight"]
    # Few rows per query are left, so the symbols are scanned against them and
    # only the texts that meet one are normalised.
    close = materialize(close.select(*keep), "close-candidates")
    texts = symbols.select(*lexical.KEY, *[name for name in SYMBOL_TEXT if name != "qualified_name"])
    pairs = texts.join(close, lexical.KEY).join(queries.select("query_id", "text"), "query_id")
    scored = lexical.score_pairs(lexical.normalized_texts(pairs, *keep, "text"), keep).withColumn(
        "lexical_score", F.round(F.col("lexical_score") * F.col("path_weight"), 9))
    order = Window.partitionBy("query_id").orderBy(
        "sort_distance", "distance", F.desc("lexical_score"), *lexical.ORDER)
    return (
        scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
        .select("query_id", "rank", *lexical.ORDER, "distance", "sort_distance", "lexical_score")
    )


def within_distance(found: DataFrame, max_distance: float) -> DataFrame:
    """Hits within the distance cut; a cut of zero or less is no cut."""
    return found if max_distance <= 0 else found.filter(F.col("distance") <= max_distance)


def semantic_search(queries: DataFrame, symbols: DataFrame, embeddings: DataFrame,
                    weights: Mapping[str, float] | None = None, limit: int = fixed.DEFAULT_LIMIT,
                    max_distance: float = fixed.DEFAULT_MAX_DISTANCE) -> DataFrame:
    """Ranked hits of ``queries(query_id, text, query_vector)``."""
    nearest = within_distance(neighbours(queries, symbols, embeddings, limit), max_distance)
    return _rank_semantic(candidates(nearest, symbols, weights), queries, symbols, limit)


def prefer_lexical(tops: DataFrame) -> DataFrame:
    """Whether lexical results win, from each query's best row of either kind.

    Expects ``query_id, text, semantic_distance, lexical_score``, null where
    that search found nothing.
    """
    semantic, score = F.col("semantic_distance"), F.col("lexical_score")
    wins = F.lit(False)
    for distance, least in fixed.LEXICAL_WINS:
        wins = wins | ((semantic > distance) & (score >= least))
    return tops.select(
        "query_id",
        F.when(score.isNull(), False).when(semantic.isNull(), True)
        .otherwise(X.prefers_lexical(F.col("text")) & wins).alias("prefer_lexical"))


def read_mode(queries: DataFrame) -> Column:
    """The normalised mode, ``auto`` for none, null for an unknown one."""
    return normalize_mode(F.coalesce("mode", F.lit(""))) if "mode" in queries.columns else F.lit("auto")


def unknown_modes(queries: DataFrame) -> DataFrame:
    """``query_id, mode, error`` of the queries that no search answers."""
    return queries.filter(read_mode(queries).isNull()).select("query_id", "mode", F.lit("unknown-mode").alias("error"))


def auto_search(queries: DataFrame, symbols: DataFrame, embeddings: DataFrame,
                weights: Mapping[str, float] | None = None, limit: int = fixed.DEFAULT_LIMIT,
                max_distance: float = fixed.DEFAULT_MAX_DISTANCE, index: Postings | None = None) -> DataFrame:
    """Hits of every query by its mode; ``auto`` (or no ``mode``) is routed.

    Modes are read without blanks and case. A query of an unknown mode has no
    hits: it is an error that :func:`unknown_modes` tells. A ``limit`` of zero or
    less is the default.
    Routed queries that look like code go lexical. The others go semantic; the
    distance cut is dropped for a query whose hits all fail it, and a query
    without any neighbour goes lexical. One neighbour search serves both cuts.
    """
    limit = limit if limit > 0 else fixed.DEFAULT_LIMIT
    mode = read_mode(queries)
    queries = queries.filter(mode.isNotNull())
    routed = materialize(queries.select(
        "query_id", "text", "query_vector", mode.alias("mode"),
        F.when(mode == "lexical", "lexical").when(mode == "semantic", "semantic")
        .when(X.prefers_lexical(F.col("text")), "lexical").otherwise("semantic").alias("route")), "routed-queries")
    asked = routed.filter((F.col("route") == "semantic") & F.col("query_vector").isNotNull())
    nearest = neighbours(asked, symbols, embeddings, limit)
    if max_distance > 0:
        # The nearest vector tells whether the cut leaves a query any hit.
        best = nearest.filter(F.col("candidate_rank") == 1).select("query_id", F.col("distance").alias("best"))
        relaxed = (F.col("best") > max_distance) & (F.col("mode") != "semantic")
        nearest = nearest.join(asked.select("query_id", "mode"), "query_id").join(best, "query_id").filter(
            (F.col("distance") <= max_distance) | relaxed).drop("mode", "best")
    semantic = materialize(_rank_semantic(candidates(nearest, symbols, weights), asked, symbols, limit), "semantic-hits").withColumn(
        "metric", F.lit("semantic"))
    # Auto queries left without any semantic hit fall back to lexical search.
    empty = routed.filter((F.col("route") == "semantic") & (F.col("mode") != "semantic")).join(
        semantic.select("query_id").distinct(), "query_id", "left_anti")
    word_queries = routed.filter(F.col("route") == "lexical").unionByName(empty).select("query_id", "text")
    words = lexical_search(word_queries, symbols, weights, limit, index).select(
        "query_id", "rank", *lexical.ORDER, F.lit(None).cast("double").alias("distance"),
        F.lit(None).cast("double").alias("sort_distance"), "lexical_score", F.lit("lexical").alias("metric"))
    return semantic.unionByName(words)


def display_metric(metric: Column, distance: Column) -> Column:
    return F.when(metric == "lexical", "lexical").otherwise(F.call_function("format_number", distance, F.lit("0.0000")))


def project_hits(hits: DataFrame, symbols: DataFrame, root: str = "/", details: bool = False) -> DataFrame:
    """Hit columns shown to a caller; documentation and body only in detail."""
    from ..functions.paths import relative_path

    columns = ["kind", "name", "signature", "documentation", "body"]
    shown = hits.join(symbols.select("path", "symbol_id", *columns), lexical.KEY)
    extra = lambda name: F.when(F.lit(details), F.col(name)).otherwise("").alias(name)
    return shown.select(
        "query_id", "rank", relative_path(F.col("path"), root).alias("path"), "line",
        display_metric(F.col("metric"), F.col("distance")).alias("metric"), "kind", "name", "qualified_name", "signature",
        F.coalesce("distance", F.lit(0.0)).alias("distance"), extra("documentation"), extra("body"))


def search_envelopes(queries: DataFrame, hits: DataFrame, provider: str, model_id: str) -> DataFrame:
    """One row per query with its hits in rank order; at most ``limit`` each."""
    hit = F.struct("rank", "path", "line", "metric", "kind", "name", "qualified_name", "signature", "distance",
                   "documentation", "body")
    per_query = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    none = F.array().cast(per_query.schema["hits"].dataType)
    return queries.select("query_id", X.trim_space(F.col("text")).alias("query"), "mode").join(per_query, "query_id", "left").select(
        "query_id", "query", "mode", F.lit(provider).alias("provider"), F.lit(model_id).alias("model_id"),
        F.coalesce(F.size("hits"), F.lit(0)).alias("result_count"), F.coalesce("hits", none).alias("hits"))
