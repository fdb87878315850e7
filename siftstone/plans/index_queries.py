"""Checked queries of index upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import index as I
from ..session import materialize, scratch_dir
from ..sources import rules
from ..sources.tables import IndexStore
from .views import view, with_views

MODEL = ["provider", "model_id"]


def list_current_symbols(spark, sf):
    out = I.current_symbols(view(spark, sf, "snapshot_symbols_v"), view(spark, sf, "pointers_v"))
    return out.select(*MODEL, "snapshot_id", "path", "line", "symbol_id", "qualified_name", F.md5("body").alias("body"))


def list_model_symbols(spark, sf):
    out = I.current_symbols(view(spark, sf, "snapshot_symbols_v"), view(spark, sf, "pointers_v"), "local", "en")
    return out.select("snapshot_id", "path", "line", "symbol_id").orderBy("path", "line", "symbol_id")


def embedding_symbol_join(spark, sf):
    out = I.embedding_symbols(view(spark, sf, "snapshot_symbols_v"), view(spark, sf, "model_embeddings_v"))
    return out.select("snapshot_id", "path", "symbol_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


def _active(spark, sf):
    return I.active_index(view(spark, sf, "snapshot_symbols_v"), view(spark, sf, "pointers_v"), view(spark, sf, "model_embeddings_v"))


def active_index_join(spark, sf):
    return _active(spark, sf).select(*MODEL, "snapshot_id", "path", "symbol_id", F.size("embedding").alias("dim"))


def current_file_state(spark, sf):
    return I.current_file_state(view(spark, sf, "hash_states_v"), view(spark, sf, "state_pointers_v"), view(spark, sf, "state_files_v"))


def index_run_counts(spark, sf):
    files, previous = view(spark, sf, "files_v"), view(spark, sf, "prev_files_v")
    return I.index_run_counts(view(spark, sf, "snapshot_symbols_v"), I.unchanged_paths(files, previous))


def logical_digest(spark, sf):
    return I.logical_digest(_active(spark, sf), *MODEL)


def index_status(spark, sf):
    models = view(spark, sf, "documents").select(F.lit("local").alias("provider"), F.col("lang").alias("model_id")).distinct()
    manifests = models.filter("model_id <> 'es'").withColumn("version", F.lit(3).cast("long")).withColumn("source", F.lit("remote"))
    return I.index_status(models, view(spark, sf, "pointers_v"), view(spark, sf, "snapshot_symbols_v"), manifests)


def embedding_cache_misses(spark, sf):
    wanted = view(spark, sf, "symbols_v").select("provider", "model_id", "embedding_hash", F.col("body").alias("document"))
    from ..operators.embed import embedding_misses

    return embedding_misses(wanted, view(spark, sf, "embeddings_v")).select("embedding_hash", F.md5("document").alias("document"))


def reuse_unchanged(spark, sf):
    out = I.reuse_unchanged(view(spark, sf, "files_v"), view(spark, sf, "prev_files_v"), view(spark, sf, "snapshot_symbols_v"), 99)
    return out.select("snapshot_id", "path", "symbol_id", "line")


def classify_changes(spark, sf):
    return I.classify_changes(view(spark, sf, "files_v"), view(spark, sf, "prev_files_v"))


def assemble_snapshot(spark, sf):
    symbols, files, previous = (view(spark, sf, name) for name in ("snapshot_symbols_v", "files_v", "prev_files_v"))
    reused = I.reuse_unchanged(files, previous, symbols, 99)
    changed = symbols.join(I.unchanged_paths(files, previous), "path", "left_anti")
    extracted = changed.withColumn("snapshot_id", F.lit(99).cast("long")).withColumn("line", F.col("line") + 1)
    return I.assemble_snapshot(reused, extracted).select("snapshot_id", "path", "symbol_id", "line")


def vacuum_snapshots(spark, sf):
    out = I.vacuum_by_pointer(view(spark, sf, "snapshot_symbols_v"), view(spark, sf, "pointers_v"))
    return out.select("snapshot_id", "path", "symbol_id")


def vacuum_embeddings(spark, sf):
    symbols = I.vacuum_by_pointer(view(spark, sf, "snapshot_symbols_v"), view(spark, sf, "pointers_v"))
    from ..functions.documents import embedding_key

    return I.vacuum_embeddings(view(spark, sf, "model_embeddings_v"), symbols).select(embedding_key().alias("embedding_key"))


def vacuum_file_states(spark, sf):
    return I.vacuum_by_pointer(view(spark, sf, "state_files_v"), view(spark, sf, "state_pointers_v"), "state_version")


def union_dims(spark, sf):
    tables = I.union_dims(view(spark, sf, "embeddings_v"), view(spark, sf, "wide_embeddings_v"))
    return tables.groupBy("dim").agg(F.count(F.lit(1)).alias("vectors"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most"))


def activate_snapshot(spark, sf):
    updates = view(spark, sf, "snapshots_v").groupBy(*MODEL).agg(F.min("snapshot_id").alias("snapshot_id"))
    return I.activate_pointers(view(spark, sf, "pointers_v"), updates.filter("model_id IN ('en', 'fr')"))


def activation_errors(spark, sf):
    states = view(spark, sf, "hash_states_v")
    updates = states.select("provider", F.lit("en").alias("model_id"), (F.col("state_version") * 2).alias("state_version"))
    return I.activation_errors(updates, states)


def _broken_rows(spark, sf):
    symbols = view(spark, sf, "snapshot_symbols_v").withColumn("symbol_id", F.md5("qualified_name")).withColumn("path", F.col("container"))
    vectors = view(spark, sf, "model_embeddings_v").withColumn("dim", F.when(F.col("model_id") == "de", 32).otherwise(F.col("dim")))
    return symbols, vectors.withColumn("embedding_hash", F.substring("embedding_hash", 1, 3))


def validate_index_rows(spark, sf):
    symbols, vectors = _broken_rows(spark, sf)
    bad = I.symbol_violations(symbols).select(
        F.concat_ws("|", F.col("snapshot_id").cast("string"), "path", "symbol_id").alias("row_key"), F.lit("duplicate symbol").alias("violation"), "dropped")
    return bad.unionByName(I.embedding_violations(vectors).groupBy(
        F.concat_ws("|", "provider", "model_id", "embedding_hash").alias("row_key"), "violation").agg(F.count(F.lit(1)).alias("dropped")))


def unique_symbols(spark, sf):
    return I.unique_symbols(_broken_rows(spark, sf)[0]).select("snapshot_id", "path", "symbol_id", "line")


def state_matches(spark, sf):
    files, previous = view(spark, sf, "files_v"), view(spark, sf, "prev_files_v")
    return I.state_matches(files, previous).select(F.lit("previous").alias("state"), "matches").unionByName(
        I.state_matches(files, files).select(F.lit("same").alias("state"), "matches")).unionByName(
        I.state_matches(files, files, F.lit(False)).select(F.lit("other scanner").alias("state"), "matches"))


def bump_manifests(spark, sf):
    manifests = view(spark, sf, "manifests_v")
    return I.bump_manifests(manifests, manifests.select("repo", F.md5(F.concat("repo", "indexing_hash")).alias("digest")))


def bind_manifests(spark, sf):
    manifests = view(spark, sf, "manifests_v")
    urls = manifests.select("repo", F.concat(F.lit("https://ci/"), "repo").alias("ci_url"))
    return I.bind_manifests(manifests.drop("has_index"), urls)


def reconcile_manifests(spark, sf):
    return I.reconcile_manifests(view(spark, sf, "manifests_v"), view(spark, sf, "published_v"))


def write_read_index(spark, sf):
    """Both tables through storage; the snapshot and model filters prune."""
    import uuid

    store = IndexStore(spark, f"{scratch_dir(spark)}/index-{uuid.uuid4().hex}")
    store.append("snapshot_symbols", view(spark, sf, "snapshot_symbols_v"))
    store.append("embeddings", view(spark, sf, "model_embeddings_v"))
    store.write_pointers("current_snapshots", view(spark, sf, "pointers_v"))
    symbols = I.current_symbols(store.table("snapshot_symbols"), store.pointers(), "local", "en")
    vectors = store.table("embeddings").filter("provider = 'local' AND model_id = 'en' AND dim = 64")
    return I.embedding_symbols(symbols, vectors).select("snapshot_id", "path", "symbol_id", F.md5("body").alias("body"), F.size("embedding").alias("dim"))


def index_rounds(spark, sf):
    """Two index runs over the source files: all of them, then without some, with others changed; the manifest moves on each time."""
    import uuid

    from ..operators.embed import hashing_embedder
    from .workflows import index_files, publish_digest

    store = IndexStore(spark, f"{scratch_dir(spark)}/rounds-{uuid.uuid4().hex}")
    files = view(spark, sf, "source_files_v")
    key = F.regexp_extract("path", r"p(\d+)\.", 1).cast("long")
    changed = files.filter(key % 7 != 0).withColumn("content", F.when(key % 3 == 0, F.concat("content", F.lit("\n"))).otherwise(F.col("content")))
    manifests = spark.createDataFrame([("parts", 1)], "repo string, version long")
    out = None
    for number, round_files in enumerate((files, changed), 1):
        counts = index_files(store, round_files.withColumn("content", F.col("content").cast("binary")), hashing_embedder(16), 16)
        owner = store.pointers().first()
        bumped = publish_digest(store, manifests, "parts", owner["provider"], owner["model_id"])
        manifests = materialize(bumped.select("repo", "version", "indexing_hash", "source"), "manifests")
        row = counts.crossJoin(manifests).select(
            F.lit(number).alias("round"), "indexed_files", "indexed_symbols", "reused_files", "reused_symbols", F.lit(store.table("embeddings").count()).cast("long").alias("vectors"),
            F.lit(store.table("snapshots").count()).cast("long").alias("snapshots"), "version", "source", F.length("indexing_hash").alias("hash_length"))
        out = row if out is None else out.unionByName(row)
    return out


def begin_snapshot(spark, sf):
    """The number the next snapshot of each model would get."""
    symbols = view(spark, sf, "snapshot_symbols_v")
    return symbols.groupBy("provider", "model_id").agg(F.max("snapshot_id").alias("last")).withColumn("next_id", F.lit(I.next_id(symbols, "snapshot_id")))


def stage_state(spark, sf):
    listed, owner = view(spark, sf, "files_v").select("path", "content_hash"), spark.createDataFrame([("local", "en")], "provider string, model_id string")
    header, files = I.stage_state(listed, owner, I.next_id(view(spark, sf, "hash_states_v"), "state_version"), "fp")
    return files.join(header.drop("created_at"), "state_version")


def manifest_source(spark, sf):
    """Manifests written as files and read back, normalised."""
    import uuid

    path = f"{scratch_dir(spark)}/manifests-{uuid.uuid4().hex}"
    rules.write_manifests(view(spark, sf, "manifests_v").select("schema_version", "version", "indexing_hash", "source", F.struct("ci_url").alias("remote")), path)
    good, _ = rules.read_manifests(spark, path, lines=True)
    return good.select("schema_version", "version", "indexing_hash", "source", F.coalesce("remote.ci_url", F.lit("")).alias("ci_url"))


_ACTIVE = "s.provider = p.provider AND s.model_id = p.model_id AND s.snapshot_id = p.snapshot_id"
_E = "s.provider = e.provider AND s.model_id = e.model_id AND s.embedding_hash = e.embedding_hash"
_IDX = ("snapshot_symbols_v", "pointers_v", "model_embeddings_v")
_SAME = "SELECT f.path FROM files_v f JOIN prev_files_v p ON f.path = p.path AND f.content_hash = p.content_hash"
_FILES = ("files_v", "prev_files_v", "snapshot_symbols_v")
_FIELDS = ["s.provider", "s.model_id", "s.path", "s.line", "s.symbol_id", "s.kind", "s.name", "s.container", "s.qualified_name", "s.signature", "s.documentation", "s.body", "s.embedding_hash"]
_ROW = ", ".join(f"strlen({f}::VARCHAR), ':', {f}::VARCHAR" for f in _FIELDS)
_SCALED = "(x::DOUBLE * 1099511627776::DOUBLE)"
_REST = f"(({_SCALED} - floor({_SCALED})) * 36028797018963968::DOUBLE)"
_EXACT = f"concat(floor({_SCALED})::BIGINT, '.', floor({_REST})::BIGINT, '.', floor(({_REST} - floor({_REST})) * 36028797018963968::DOUBLE)::BIGINT)"
_SUMS = ", '|', ".join(f"sum(('0x' || substr(d, {at * 4 + 1}, 4))::BIGINT)" for at in range(16))

QUERIES = {
    "begin_snapshot": (begin_snapshot, with_views("SELECT provider, model_id, max(snapshot_id) AS last, (SELECT max(snapshot_id) + 1 FROM snapshot_symbols_v)::INT AS next_id FROM snapshot_symbols_v GROUP BY ALL", "snapshot_symbols_v")),
    "stage_state": (stage_state, with_views("""SELECT f.path, f.content_hash, (SELECT max(state_version) + 1 FROM hash_states_v)::BIGINT AS state_version, 'local' AS provider, 'en' AS model_id, 'fp' AS scanner_fingerprint FROM files_v f""",
                                            "files_v", "hash_states_v")),
    "manifest_source": (manifest_source, with_views("""SELECT greatest(schema_version, 1)::INT AS schema_version, version, trim(indexing_hash) AS indexing_hash, lower(trim(source)) AS source, trim(ci_url) AS ci_url FROM manifests_v""", "manifests_v")),
    "list_current_symbols": (list_current_symbols, with_views(f"""SELECT s.provider, s.model_id, s.snapshot_id, s.path, s.line, s.symbol_id, s.qualified_name, md5(s.body) AS body
 FROM snapshot_symbols_v s JOIN pointers_v p ON {_ACTIVE}""", *_IDX[:2])),
    "list_model_symbols": (list_model_symbols, with_views(f"SELECT s.snapshot_id, s.path, s.line, s.symbol_id FROM snapshot_symbols_v s JOIN pointers_v p ON {_ACTIVE} WHERE s.model_id = 'en'", *_IDX[:2])),
    "embedding_symbol_join": (embedding_symbol_join, with_views(f"""SELECT s.snapshot_id, s.path, s.symbol_id, round(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE)), 6) AS total
 FROM snapshot_symbols_v s JOIN model_embeddings_v e ON {_E}""", *_IDX)),
    "active_index_join": (active_index_join, with_views(f"""SELECT s.provider, s.model_id, s.snapshot_id, s.path, s.symbol_id, len(e.embedding)::INT AS dim
 FROM snapshot_symbols_v s JOIN pointers_v p ON {_ACTIVE} JOIN model_embeddings_v e ON {_E}""", *_IDX)),
    "current_file_state": (current_file_state, with_views("""SELECT h.provider, h.model_id, h.state_version, h.scanner_fingerprint, f.path, f.content_hash FROM hash_states_v h
 JOIN state_pointers_v p ON h.provider = p.provider AND h.model_id = p.model_id AND h.state_version = p.state_version JOIN state_files_v f ON f.state_version = h.state_version""",
                                      "hash_states_v", "state_pointers_v", "state_files_v")),
    "index_run_counts": (index_run_counts, with_views(f"""SELECT count(DISTINCT path) AS indexed_files, count(*) AS indexed_symbols, count(DISTINCT path) FILTER (path IN ({_SAME})) AS reused_files,
 count(*) FILTER (path IN ({_SAME})) AS reused_symbols FROM snapshot_symbols_v""", *_FILES)),
    "logical_digest": (logical_digest, with_views(f"""SELECT provider, model_id, count(*) AS row_count, sha256(concat(count(*), '|', {_SUMS})) AS digest FROM (
 SELECT s.provider, s.model_id, sha256(concat({_ROW}, array_to_string(list_transform(e.embedding, lambda x: {_EXACT}), ','))) AS d
 FROM snapshot_symbols_v s JOIN pointers_v p ON {_ACTIVE} JOIN model_embeddings_v e ON {_E}) GROUP BY provider, model_id""", *_IDX)),
    "index_status": (index_status, with_views(f"""SELECT 'local' AS provider, m.lang AS model_id, p.snapshot_id IS NOT NULL AS index_present, CASE WHEN m.lang = 'es' THEN 0 ELSE 3 END::BIGINT AS manifest_version,
 CASE WHEN m.lang = 'es' THEN '' ELSE 'remote' END AS manifest_source, count(s.path) AS symbols, count(DISTINCT s.path) AS files FROM (SELECT DISTINCT lang FROM documents) m
 LEFT JOIN pointers_v p ON p.model_id = m.lang LEFT JOIN snapshot_symbols_v s ON {_ACTIVE} GROUP BY ALL""", *_IDX[:2])),
    "embedding_cache_misses": (embedding_cache_misses, with_views("SELECT embedding_hash, md5(body) AS document FROM symbols_v WHERE embedding_hash NOT IN (SELECT embedding_hash FROM embeddings_v)", "symbols_v", "embeddings_v")),
    "reuse_unchanged": (reuse_unchanged, with_views(f"SELECT 99::BIGINT AS snapshot_id, path, symbol_id, line FROM snapshot_symbols_v WHERE path IN ({_SAME})", *_FILES)),
    "classify_changes": (classify_changes, with_views("""SELECT coalesce(f.path, p.path) AS path, CASE WHEN f.path IS NULL THEN 'deleted' WHEN p.path IS NULL THEN 'new' WHEN f.content_hash = p.content_hash THEN 'unchanged' ELSE 'changed' END AS change
 FROM files_v f FULL JOIN prev_files_v p ON f.path = p.path""", *_FILES[:2])),
    "assemble_snapshot": (assemble_snapshot, with_views(f"SELECT 99::BIGINT AS snapshot_id, path, symbol_id, CASE WHEN path IN ({_SAME}) THEN line ELSE line + 1 END AS line FROM snapshot_symbols_v", *_FILES)),
    "vacuum_snapshots": (vacuum_snapshots, with_views("SELECT snapshot_id, path, symbol_id FROM snapshot_symbols_v WHERE snapshot_id IN (SELECT snapshot_id FROM pointers_v)", *_IDX[:2])),
    "vacuum_embeddings": (vacuum_embeddings, with_views("""SELECT concat(provider, '|', model_id, '|', embedding_hash) AS embedding_key FROM model_embeddings_v WHERE concat(provider, '|', model_id, '|', embedding_hash) IN (
 SELECT concat(provider, '|', model_id, '|', embedding_hash) FROM snapshot_symbols_v WHERE snapshot_id IN (SELECT snapshot_id FROM pointers_v))""", *_IDX)),
    "vacuum_file_states": (vacuum_file_states, with_views("SELECT * FROM state_files_v WHERE state_version IN (SELECT state_version FROM state_pointers_v)", "state_files_v", "state_pointers_v")),
    "union_dims": (union_dims, with_views("""SELECT dim, count(*) AS vectors, min(len(embedding))::INT AS least, max(len(embedding))::INT AS most FROM (SELECT dim, embedding FROM embeddings_v UNION ALL SELECT dim, embedding FROM wide_embeddings_v) GROUP BY dim""",
                              "embeddings_v", "wide_embeddings_v")),
    "activate_snapshot": (activate_snapshot, with_views("""SELECT provider, model_id, snapshot_id FROM pointers_v WHERE model_id NOT IN ('en', 'fr')
 UNION ALL SELECT provider, model_id, min(snapshot_id) FROM snapshots_v WHERE model_id IN ('en', 'fr') GROUP BY provider, model_id""", "pointers_v", "snapshots_v")),
    "activation_errors": (activation_errors, with_views("""SELECT u.provider, 'en' AS model_id, u.state_version * 2 AS state_version, CASE WHEN h.state_version IS NULL THEN 'unknown version' ELSE 'wrong owner' END AS error
 FROM hash_states_v u LEFT JOIN hash_states_v h ON h.state_version = u.state_version * 2 WHERE h.state_version IS NULL OR h.model_id <> 'en'""", "hash_states_v")),
    "validate_index_rows": (validate_index_rows, with_views("""SELECT concat(snapshot_id, '|', container, '|', md5(qualified_name)) AS row_key, 'duplicate symbol' AS violation, count(*) - 1 AS dropped FROM snapshot_symbols_v GROUP BY 1 HAVING count(*) > 1
 UNION ALL SELECT concat(provider, '|', model_id, '|', left(embedding_hash, 3)), 'invalid dimension', count(*) FROM model_embeddings_v WHERE model_id = 'de' GROUP BY 1
 UNION ALL SELECT concat(provider, '|', model_id, '|', left(embedding_hash, 3)), 'duplicate key', 1 FROM model_embeddings_v GROUP BY 1 HAVING count(*) > 1""", *_IDX)),
    "unique_symbols": (unique_symbols, with_views("SELECT snapshot_id, container AS path, md5(qualified_name) AS symbol_id, min(line) AS line FROM snapshot_symbols_v GROUP BY 1, 2, 3", *_IDX[:1])),
    "state_matches": (state_matches, with_views("SELECT 'same' AS state, TRUE AS matches UNION ALL SELECT 'other scanner', FALSE UNION ALL SELECT 'previous', (SELECT count(*) FROM (SELECT * FROM files_v EXCEPT SELECT * FROM prev_files_v)) + (SELECT count(*) FROM (SELECT * FROM prev_files_v EXCEPT SELECT * FROM files_v)) = 0", *_FILES[:2])),
    "bump_manifests": (bump_manifests, with_views("SELECT repo, version + 1 AS version, md5(concat(repo, indexing_hash)) AS indexing_hash, 'local' AS source, NULL::VARCHAR AS ci_url FROM manifests_v", "manifests_v")),
    "bind_manifests": (bind_manifests, with_views("SELECT repo, version, indexing_hash, 'remote' AS source, concat('https://ci/', repo) AS ci_url FROM manifests_v", "manifests_v")),
    "reconcile_manifests": (reconcile_manifests, with_views("""SELECT l.repo, CASE WHEN lower(trim(l.source)) <> 'remote' OR trim(l.ci_url) = '' THEN 'unbound' WHEN p.repo IS NULL AND l.has_index THEN 'keep-local' WHEN p.repo IS NULL THEN 'missing'
 WHEN NOT l.has_index OR l.version <> p.version OR trim(l.indexing_hash) <> trim(p.indexing_hash) THEN 'download'
 WHEN greatest(l.schema_version, 1) <> p.schema_version OR trim(l.ci_url) <> coalesce(nullif(trim(p.ci_url), ''), trim(l.ci_url)) THEN 'metadata-refresh' ELSE 'up-to-date' END AS action
 FROM manifests_v l LEFT JOIN published_v p ON l.repo = p.repo""", "manifests_v", "published_v")),
    "index_rounds": (index_rounds, """SELECT 1::INT AS round, 4 * count(*) AS indexed_files, 10 * count(*) AS indexed_symbols, 0::BIGINT AS reused_files, 0::BIGINT AS reused_symbols,
 10 * count(*) AS vectors, 1::BIGINT AS snapshots, 2::BIGINT AS version, 'local' AS source, 64::INT AS hash_length FROM part
 UNION ALL SELECT 2, 4 * count(*), 10 * count(*), 4 * count(*) FILTER (p_partkey % 3 <> 0), 10 * count(*) FILTER (p_partkey % 3 <> 0), 10 * count(*), 1, 3, 'local', 64
 FROM part WHERE p_partkey % 7 <> 0"""),
    "write_read_index": (write_read_index, with_views(f"""SELECT s.snapshot_id, s.path, s.symbol_id, md5(s.body) AS body, len(e.embedding)::INT AS dim FROM snapshot_symbols_v s JOIN pointers_v p ON {_ACTIVE}
 JOIN model_embeddings_v e ON {_E} WHERE s.model_id = 'en'""", *_IDX)),
}
