"""Times the headline queries and prints one JSON line.

``$BENCH_SF_DIR`` names the tables, ``$BENCH_CPUS`` the local cores. A short
warm-up keeps JVM start and first-use code generation out of the figures.
"""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import functions as F

from siftstone.operators.embed import hashing_embedder
from siftstone.plans import catalog, workflows
from siftstone.plans.views import view
from siftstone.session import local_session, materialize, scratch_dir
from siftstone.sources.tables import IndexStore

HEADLINE = [
    "lexical_search", "semantic_search", "auto_search", "vector_knn", "vector_knn_cells", "overfetch_rerank",
    "normalize_text", "token_variants", "lexical_score", "path_weights", "build_documents", "embedding_hash",
    "list_hashed_files", "explode_lines", "extract_annotations", "extract_declarations", "following_lines",
    "embed_documents", "classify_changes", "reuse_unchanged", "embedding_cache_misses", "vacuum_embeddings",
    "logical_digest", "index_run_counts", "write_read_index", "score_queries", "quality_rollup", "timing_means",
    "validate_suite", "reconcile_manifests",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def workflows_timed(spark, sf_dir: str) -> dict[str, float]:
    """Seconds for a cold index, a warm one over the same files, and a search of it."""
    files = materialize(view(spark, sf_dir, "source_files_v").select("path", F.col("content").cast("binary").alias("content")), "bench-files")
    store = IndexStore(spark, f"{scratch_dir(spark)}/bench-{uuid.uuid4().hex}")
    asked = view(spark, sf_dir, "query_texts_v").select("query_id", "text", "mode")
    steps = {"index_cold": lambda: workflows.index_files(store, files, hashing_embedder(64), 64),
             "index_warm": lambda: workflows.index_files(store, files, hashing_embedder(64), 64),
             "search_index": lambda: workflows.search_index(store, asked, hashing_embedder(64), 64)}
    times = {}
    for name, step in steps.items():
        started = time.perf_counter()
        run(step())
        times[name] = round(time.perf_counter() - started, 3)
    return times


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    queries = catalog.queries()
    small = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    for name in ("lexical_search", "vector_knn", "score_queries"):
        run(queries[name](spark, small if os.path.isdir(small) else sf_dir))
    times = {}
    for name in HEADLINE:
        started = time.perf_counter()
        run(queries[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - started, 3)
    asked = view(spark, sf_dir, "queries_v").count()
    print(json.dumps({
        "metric": "headline queries, total time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "workflows": workflows_timed(spark, sf_dir),
        "search_ms_per_query": {name: round(1000 * times[name] / max(asked, 1), 2) for name in ("lexical_search", "auto_search")},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
