"""Equal results of different plans, hot keys, and incremental indexing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftstone import schemas
from siftstone.functions import text as X
from siftstone.operators import embed, index, lexical, search
from siftstone.operators.vector import vector_knn
from siftstone.plans import catalog, workflows
from siftstone.plans.views import view
from siftstone.sources.tables import IndexStore

SF = "/root/testdata/sf0.001"


def test_postings_equal_brute_force(spark):
    """Every query against every symbol, scored straight from the definition."""
    queries = view(spark, SF, "query_texts_v").select("query_id", "text").filter("length(text) < 150")
    symbols = view(spark, SF, "symbols_v").filter("length(body) < 600")
    rows = lexical.search_rows(symbols)
    fast = {(r.query_id, r.path): r.lexical_score for r in lexical.lexical_scores(queries, rows).collect()}
    pairs = queries.crossJoin(rows)
    keep = ["query_id", "path", "path_weight"]
    slow = lexical.score_pairs(pairs, keep).select("query_id", "path", F.round(F.col("lexical_score") * F.col("path_weight"), 9).alias("s"))
    slow = {(r.query_id, r.path): r.s for r in slow.filter("s > 0").collect()}
    assert fast == slow and len(fast) > 300


def test_search_without_broadcast(spark):
    """The same hits when no side is small enough to broadcast."""
    run = lambda: sorted(map(tuple, catalog.queries()["auto_search"](spark, SF).collect()), key=str)
    usual = run()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        assert run() == usual and usual
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        if adaptive is None:
            spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("limit", [0, 10_000_000])
def test_knn_with_copies(spark, limit, monkeypatch):
    """A third of the vectors are copies of one; both plans find the same."""
    from siftstone.operators import vector

    monkeypatch.setattr(vector, "QUERY_ROWS", 32)
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(600, 8)).astype(np.float32)
    vectors[:200] = vectors[0]
    names = [f"v{i:04d}" for i in range(600)]
    items = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in zip(names, vectors)], "embedding_hash string, embedding array<float>")
    asked = items.select(F.col("embedding_hash").alias("query_id"), F.col("embedding").alias("query_vector")).filter("query_id >= 'v0150' AND query_id < 'v0260'")
    got = {}
    for r in vector_knn(asked, items, 12, broadcast_components=limit).collect():
        got.setdefault(r.query_id, []).append((r.candidate_rank, r.embedding_hash, r.distance))
    exact = vectors.astype(np.float64)
    assert len(got) == 110
    for name, rows in got.items():
        distance = np.round(np.sqrt(((exact - exact[int(name[1:])]) ** 2).sum(axis=1)), 9)
        order = sorted(range(600), key=lambda i: (distance[i], names[i]))[:12]
        assert [(i + 1, names[j], distance[j]) for i, j in enumerate(order)] == sorted(rows)


def test_knn_hands_on_few_candidates(spark):
    """Of many tasks, those of later waves hand on only what may be among the nearest."""
    from siftstone.operators.vector import knn_candidates

    rng = np.random.default_rng(11)
    rows = [(f"v{i:05d}", [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(6000, 6)))]
    items = spark.createDataFrame(spark.sparkContext.parallelize(rows, 120), "embedding_hash string, embedding array<double>")
    asked = spark.createDataFrame([(f"q{i}", [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(40, 6)))], "query_id string, query_vector array<double>")
    handed = knn_candidates(asked, items, 5).count()
    # One list of k from each of 120 tasks would be 24,000; a wave and its bound leave about 8 tasks' lists and 16 k.
    assert 200 <= handed < 40 * 5 * 30
    got = {(r.query_id, r.candidate_rank): r.embedding_hash for r in vector_knn(asked, items, 5).collect()}
    few = {(r.query_id, r.candidate_rank): r.embedding_hash for r in vector_knn(asked, items.coalesce(2), 5).collect()}
    assert got == few and len(got) == 200


def test_knn_checks_dimensions(spark):
    items = spark.createDataFrame([("a", [1.0, 0.0])], "embedding_hash string, embedding array<float>")
    asked = spark.createDataFrame([("q", [1.0, 0.0, 0.0])], "query_id string, query_vector array<float>")
    with pytest.raises(Exception, match="components met queries"):
        vector_knn(asked, items, 3).collect()


def test_semantic_ties_on_one_hot_vector(spark):
    """Most symbols share one vector; the lexical score orders them all."""
    rows = [(f"f{i:03d}.go", i % 7 + 1, f"s{i}", "alpha beta" if i == 77 else "gamma", "h0" if i % 5 else f"h{i}") for i in range(200)]
    symbols = spark.createDataFrame(rows, "path string, line int, symbol_id string, body string, embedding_hash string").select(
        "*", *[F.lit("").alias(n) for n in schemas.SYMBOL_TEXT if n != "body"], F.lit("p").alias("provider"), F.lit("m").alias("model_id"))
    vectors = spark.createDataFrame(
        [("p", "m", "h0", [1.0, 0.0])] + [("p", "m", f"h{i}", [0.0, 1.0 + i]) for i in range(0, 200, 5) if i],
        "provider string, model_id string, embedding_hash string, embedding array<float>")
    queries = spark.createDataFrame([("q", "alpha", [1.0, 0.0])], "query_id string, text string, query_vector array<float>")
    hits = search.semantic_search(queries, symbols, vectors, max_distance=0.5).orderBy("rank").collect()
    assert hits[0].path == "f077.go" and len(hits) == 10 and [h.path for h in hits[1:3]] == ["f000.go", "f001.go"]


def test_semantic_weights_and_cut(spark):
    symbols = spark.createDataFrame(
        [("examples/router_test.go", 10, "a", "h1"), ("mux.go", 32, "b", "h2"), ("far.go", 1, "c", "h3")],
        "path string, line int, symbol_id string, embedding_hash string").select(
        "*", *[F.lit("").alias(n) for n in schemas.SYMBOL_TEXT], F.lit("p").alias("provider"), F.lit("m").alias("model_id"))
    vectors = spark.createDataFrame([("p", "m", "h1", [0.38]), ("p", "m", "h2", [0.4]), ("p", "m", "h3", [0.91])],
                                    "provider string, model_id string, embedding_hash string, embedding array<float>")
    queries = spark.createDataFrame([("q", "create a new router", [0.0])], "query_id string, text string, query_vector array<float>")
    hits = search.semantic_search(queries, symbols, vectors, limit=2).orderBy("rank").collect()
    assert [h.path for h in hits] == ["mux.go", "examples/router_test.go"]


def test_digest_ignores_layout(spark):
    active = index.active_index(view(spark, SF, "snapshot_symbols_v"), view(spark, SF, "pointers_v"), view(spark, SF, "model_embeddings_v"))
    first = index.logical_digest(active).first().digest
    moved = active.withColumn("snapshot_id", F.col("snapshot_id") + 100).repartition(13, "path")
    assert index.logical_digest(moved).first().digest == first
    assert index.logical_digest(active.withColumn("line", F.col("line") + 1)).first().digest != first


def test_incremental_equals_full(spark, tmp_path):
    before = [("a.py", "def one():\n    return 1\n"), ("b.py", "def two():\n    return 2\n"), ("gone.py", "def gone():\n    pass\n"),
              ("note.txt", "# @search: a note\nbody\n")]
    after = [("a.py", before[0][1]), ("b.py", "def two():\n    return 3\n\n\ndef extra():\n    pass\n"), ("note.txt", before[3][1]),
             ("new.py", "X = 1\n")]
    make = lambda rows: spark.createDataFrame([(p, bytearray(c.encode())) for p, c in rows], "path string, content binary")
    calls = []

    def counting(texts):
        calls.append(len(texts))
        return embed.hashing_embedder(16)(texts)

    store = IndexStore(spark, str(tmp_path / "incremental"))
    one = workflows.index_files(store, make(before), embed.hashing_embedder(16), 16).first()
    assert (one.indexed_files, one.indexed_symbols, one.reused_files) == (4, 4, 0)
    two = workflows.index_files(store, make(after), counting, 16).first()
    assert (two.indexed_files, two.indexed_symbols, two.reused_files, two.reused_symbols) == (4, 5, 2, 2)
    full = IndexStore(spark, str(tmp_path / "full"))
    workflows.index_files(full, make(after), embed.hashing_embedder(16), 16)
    digest = lambda s: index.logical_digest(index.active_index(
        s.table("snapshot_symbols"), s.pointers(), s.table("embeddings"))).first()
    assert digest(store) == digest(full) and digest(full).row_count == 5
    assert store.table("snapshot_symbols").select("snapshot_id").distinct().count() == 1
    # Headers and vectors that nothing uses are gone too, and the manifest moves on.
    assert store.table("snapshots").count() == 1 and store.table("hash_states").count() == 1
    assert store.table("embeddings").count() == full.table("embeddings").count()
    manifests = spark.createDataFrame([("mine", 4), ("other", 1)], "repo string, version long")
    provider, model = store.pointers().select("provider", "model_id").first()
    moved = workflows.publish_digest(store, manifests, "mine", provider, model).collect()
    assert [(r.repo, r.version, r.indexing_hash, r.source) for r in moved] == [("mine", 5, digest(full).digest, "local")]

    queries = spark.createDataFrame([("q1", "extra", "lexical"), ("q2", "return the number two please", "auto")], "query_id string, text string, mode string")
    hits = workflows.search_index(store, queries, embed.hashing_embedder(16), 16).orderBy("query_id", "rank").collect()
    assert hits[0].path == "b.py" and hits[0].qualified_name == "extra" and {h.query_id for h in hits} == {"q1", "q2"}


@pytest.mark.parametrize("broken", ["write_pointers", "_drop_generations"])
def test_vectors_survive_a_vacuum_that_ends_early(spark, tmp_path, monkeypatch, broken):
    store = IndexStore(spark, str(tmp_path))
    rows = [("local", "m:1", f"h{i}", 2, [float(i), 1.0]) for i in range(6)] + [("local", "other", "h0", 2, [0.0, 0.0])]
    store.append("embeddings", spark.createDataFrame(rows, schemas.EMBEDDINGS))
    used = spark.createDataFrame([(1, "local", "m:1", "p", 1, f"s{i}", f"h{i}") for i in range(4)],
                                 "snapshot_id long, provider string, model_id string, path string, line int, symbol_id string, embedding_hash string")
    store.append("snapshot_symbols", used.select("*", *[F.lit("").alias(f.name) for f in schemas.SNAPSHOT_SYMBOLS if f.name not in used.columns]))
    held = lambda: sorted(r.embedding_hash for r in store.table("embeddings").filter("model_id = 'm:1'").collect())

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as patch:
        patch.setattr(IndexStore, broken, stop)
        with pytest.raises(RuntimeError):
            store.vacuum_embeddings("local", "m:1")
    assert held() == [f"h{i}" for i in range(6 if broken == "write_pointers" else 4)]
    assert store.vacuum_embeddings("local", "m:1") == (2 if broken == "write_pointers" else 0) and held() == [f"h{i}" for i in range(4)]
    assert len(store._generations("local", "m:1")) == 1 and store.table("embeddings").count() == 5
    store.append("embeddings", spark.createDataFrame([("local", "m:1", "h9", 2, [9.0, 1.0])], schemas.EMBEDDINGS))
    assert held() == ["h0", "h1", "h2", "h3", "h9"]


def test_no_active_snapshot(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path))
    with pytest.raises(index.NoActiveSnapshot):
        index.current_symbols(store.table("snapshot_symbols"), store.pointers(), "p", "m")


def test_gram_join_finds_every_substring(spark):
    words = spark.createDataFrame([("feedback",), ("db",), ("été",), ("x" * 5000 + "needle",)], "word string")
    wanted = spark.createDataFrame([("t1", "db", 1.0), ("t2", "é", 0.9), ("t3", "needle", 1.0), ("t4", "edba", 0.5)], "token string, variant string, weight double")
    got = {(r.token, r.word[:8]) for r in lexical.match_vocabulary(words, wanted).collect()}
    assert got == {("t1", "feedback"), ("t1", "db"), ("t2", "été"), ("t3", "xxxxxxxx"), ("t4", "feedback")}
    assert X.SPACES.isspace()
