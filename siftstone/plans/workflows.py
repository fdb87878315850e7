"""End-to-end jobs: index a tree, search it, run a suite."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import documents as D
from ..functions import fixed
from ..operators import embed as E
from ..operators import evaluate as V
from ..operators import index as I
from ..operators import postings as P
from ..operators import search as S
from ..operators.extract import extract_symbols
from ..session import materialize
from ..sources.files import content_hash, is_binary
from ..sources.tables import POSTING_TABLES, IndexStore


def index_files(store: IndexStore, files: DataFrame, embedder: E.Embedder, dim: int, provider: str = fixed.DEFAULT_PROVIDER,
                model: str = fixed.DEFAULT_MODEL, search_prefix: str = fixed.SEARCH_PREFIX,
                context_prefix: str = fixed.CONTEXT_PREFIX, excludes: Iterable[str] = ()) -> DataFrame:
    """Index ``files(path, content)`` and return the counts of the run.

    Unchanged files keep their symbol rows, changed ones are extracted again,
    and only documents without a stored vector reach the embedder. The new
    snapshot is complete on storage before the pointer moves to it.
    """
    spark = store.spark
    model_id = spark.range(1).select(F.coalesce(D.resolve_model_id(F.lit(model)), F.lit(model))).first()[0]
    mine = (F.col("provider") == provider) & (F.col("model_id") == model_id)
    fingerprint = spark.range(1).select(D.fingerprint_of(search_prefix, context_prefix, excludes)).first()[0]

    text = files.filter(~is_binary(F.col("content")))
    listed = materialize(text.select("path", content_hash(F.col("content")).alias("content_hash")), "listed-files")
    state = I.current_file_state(store.table("hash_states"), store.pointers("current_states"), store.table("state_files"))
    # Another scanner setting reads files differently, so nothing is reused.
    previous = state.filter(mine & (F.col("scanner_fingerprint") == fingerprint)).select("path", "content_hash")
    pointers = store.pointers("current_snapshots")
    active = I.current_symbols(store.table("snapshot_symbols"), pointers).filter(mine)
    has_snapshot = pointers.filter(mine).limit(1).count() > 0

    snapshot_id = max(store.next_id("snapshots", "snapshot_id"), store.next_id("snapshot_symbols", "snapshot_id"))
    owner = spark.createDataFrame([(snapshot_id, provider, model_id)], "snapshot_id long, provider string, model_id string")
    store.append("snapshots", owner.withColumn("created_at", F.current_timestamp()))

    unchanged = I.unchanged_paths(listed, previous) if has_snapshot else listed.select("path").filter("false")
    unchanged = materialize(unchanged, "unchanged-paths")
    reused = active.join(unchanged, "path", "left_semi").withColumn("snapshot_id", F.lit(snapshot_id).cast("long"))
    changed = text.join(unchanged, "path", "left_anti").withColumn("content", F.col("content").cast("string"))
    keyed = materialize(
        E.document_keys(extract_symbols(changed, search_prefix, context_prefix), provider, model), "extracted-symbols")
    vectors = E.embed_documents(E.embedding_misses(keyed, store.table("embeddings").filter(mine)), embedder, dim)
    store.append("embeddings", vectors)
    snapshot = I.assemble_snapshot(reused, I.unique_symbols(I.symbol_rows(keyed, snapshot_id)))
    store.append("snapshot_symbols", snapshot)
    store_postings(store, store.table("snapshot_symbols").filter(mine & (F.col("snapshot_id") == snapshot_id)), snapshot_id)

    store.write_pointers("current_snapshots", I.activate_pointers(pointers, owner))
    version = max(store.next_id("hash_states", "state_version"), store.next_id("state_files", "state_version"))
    header, staged = I.stage_state(listed, owner, version, fingerprint)
    store.append("hash_states", header)
    store.append("state_files", staged)
    if not I.activation_errors(header, store.table("hash_states")).isEmpty():
        raise RuntimeError("state-not-owned")
    store.write_pointers("current_states", I.activate_pointers(
        store.pointers("current_states"), header, "state_version"))
    written = store.table("snapshot_symbols").filter(mine & (F.col("snapshot_id") == snapshot_id))
    counts = materialize(I.index_run_counts(written, unchanged), "run-counts")
    store.vacuum()
    store.vacuum_embeddings(provider, model_id)
    return counts


def store_postings(store: IndexStore, symbols: DataFrame, snapshot_id: int) -> None:
    """The inverted index of a snapshot's symbols, each part made of the one written before."""
    mine = F.col("snapshot_id") == snapshot_id
    owned = lambda rows: rows.withColumn("snapshot_id", F.lit(snapshot_id).cast("long"))
    forward = P.symbol_words(symbols)
    store.append("posting_symbols", owned(forward))
    store.append("postings", owned(P.word_postings(forward)))
    store.append("vocabulary", owned(P.word_counts(store.table("postings").filter(mine))))
    store.append("grams", owned(P.word_grams(store.table("vocabulary").filter(mine))))


def stored_postings(store: IndexStore, snapshot_id: int) -> P.Postings:
    return P.Postings(*[store.table(name).filter(F.col("snapshot_id") == snapshot_id).drop("snapshot_id") for name in POSTING_TABLES])


def publish_digest(store: IndexStore, manifests: DataFrame, repo: str, provider: str = fixed.DEFAULT_PROVIDER, model_id: str = fixed.DEFAULT_MODEL) -> DataFrame:
    """The manifest of ``repo`` after an index run: next version, digest of the active content, local again."""
    symbols = I.current_symbols(store.table("snapshot_symbols"), store.pointers(), provider, model_id)
    mine = (F.col("provider") == provider) & (F.col("model_id") == model_id)
    digest = I.logical_digest(symbols.join(store.table("embeddings").filter(mine), I.HASH)).select(F.lit(repo).alias("repo"), "digest")
    return I.bump_manifests(manifests, digest)


def search_index(store: IndexStore, queries: DataFrame, embedder: E.Embedder, dim: int, provider: str = fixed.DEFAULT_PROVIDER,
                 model: str = fixed.DEFAULT_MODEL, weights: Mapping[str, float] | None = None,
                 limit: int = fixed.DEFAULT_LIMIT, max_distance: float = fixed.DEFAULT_MAX_DISTANCE) -> DataFrame:
    """Ranked hits of ``queries(query_id, text, mode)`` over the active index."""
    model_id = store.spark.range(1).select(F.coalesce(D.resolve_model_id(F.lit(model)), F.lit(model))).first()[0]
    symbols = I.current_symbols(store.table("snapshot_symbols"), store.pointers(), provider, model_id)
    vectors = store.table("embeddings").filter(
        (F.col("provider") == provider) & (F.col("model_id") == model_id) & (F.col("dim") == dim))
    asked = materialize(E.embed_queries(queries, model, embedder, dim), "query-vectors")
    active = store.pointers().filter((F.col("provider") == provider) & (F.col("model_id") == model_id)).first()
    return S.auto_search(asked, symbols, vectors, weights, limit, max_distance, stored_postings(store, active["snapshot_id"]))


def run_suite(expected: DataFrame, hits: DataFrame) -> DataFrame:
    """Quality per repository and over all, from ``expected(repo, query_id,
    expected_ref)`` and the ranked ``hits`` of each repository's queries."""
    return V.quality_rollup(V.score_queries(expected, hits))
