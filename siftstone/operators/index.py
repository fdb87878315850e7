"""Upkeep of the index tables: reuse, activation, vacuum, digests, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import documents as D
from ..functions import fixed
from ..functions.text import trim_space

OWNER = ["provider", "model_id"]
HASH = [*OWNER, "embedding_hash"]


class NoActiveSnapshot(LookupError):
    """The provider and model have no active snapshot."""


def current_symbols(symbols: DataFrame, pointers: DataFrame, provider: str | None = None,
                    model_id: str | None = None) -> DataFrame:
    """Symbols of the active snapshots, or of one provider and model.

    The pointer table holds one row per model, so naming one turns the lookup
    into a literal filter that prunes the snapshot's partitions.
    """
    if provider is None:
        return symbols.join(pointers, [*OWNER, "snapshot_id"], "left_semi")
    row = pointers.filter((F.col("provider") == provider) & (F.col("model_id") == model_id)).first()
    if row is None:
        raise NoActiveSnapshot(f"{provider}/{model_id}")
    return symbols.filter((F.col("provider") == provider) & (F.col("model_id") == model_id)
                          & (F.col("snapshot_id") == row["snapshot_id"]))


def embedding_symbols(symbols: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Symbols with the vector of their document; one vector may serve many."""
    return symbols.join(embeddings.select(*HASH, "embedding"), HASH)


def active_index(symbols: DataFrame, pointers: DataFrame, embeddings: DataFrame) -> DataFrame:
    return embedding_symbols(current_symbols(symbols, pointers), embeddings)


def current_file_state(states: DataFrame, pointers: DataFrame, files: DataFrame) -> DataFrame:
    """Files of the active hash states whose header belongs to the same model."""
    current = states.join(pointers, [*OWNER, "state_version"]).select(*OWNER, "state_version", "scanner_fingerprint")
    return current.join(files, "state_version").select(*OWNER, "state_version", "scanner_fingerprint", "path", "content_hash")


def classify_changes(listed: DataFrame, previous: DataFrame) -> DataFrame:
    """``path, change``: new, changed, unchanged or deleted."""
    before = previous.select("path", F.col("content_hash").alias("previous_hash"))
    return listed.select("path", "content_hash").join(before, "path", "full_outer").select(
        "path",
        F.when(F.col("content_hash").isNull(), "deleted").when(F.col("previous_hash").isNull(), "new")
        .when(F.col("content_hash") == F.col("previous_hash"), "unchanged").otherwise("changed").alias("change"))


def unchanged_paths(listed: DataFrame, previous: DataFrame) -> DataFrame:
    return listed.join(previous, ["path", "content_hash"], "left_semi").select("path")


def reuse_unchanged(listed: DataFrame, previous: DataFrame, symbols: DataFrame, snapshot_id: int) -> DataFrame:
    """Active symbols of unchanged files, copied into the new snapshot."""
    kept = symbols.join(unchanged_paths(listed, previous), "path", "left_semi")
    return kept.withColumn("snapshot_id", F.lit(snapshot_id).cast("long"))


def assemble_snapshot(reused: DataFrame, extracted: DataFrame) -> DataFrame:
    return reused.unionByName(extracted)


def index_run_counts(snapshot: DataFrame, reused_paths: DataFrame) -> DataFrame:
    """Files and symbols of a run, in all and reused; empty files do not count."""
    # One row per path before the reuse flag joins in.
    per_path = snapshot.groupBy("path").agg(F.count(F.lit(1)).alias("symbols"))
    flagged = per_path.join(reused_paths.select("path").distinct().withColumn("reused", F.lit(True)), "path", "left")
    reused = F.coalesce("reused", F.lit(False))
    zero = F.lit(0).cast("long")
    return flagged.agg(
        F.count(F.lit(1)).alias("indexed_files"), F.coalesce(F.sum("symbols"), zero).alias("indexed_symbols"),
        F.count(F.when(reused, 1)).alias("reused_files"),
        F.coalesce(F.sum(F.when(reused, F.col("symbols"))), zero).alias("reused_symbols"))


def next_id(table: DataFrame, column: str) -> int:
    """The next snapshot or state number."""
    return int(table.agg(F.coalesce(F.max(column), F.lit(0))).first()[0]) + 1


def stage_state(listed: DataFrame, owner: DataFrame, version: int, fingerprint: str) -> tuple[DataFrame, DataFrame]:
    """Header and file rows of a new file state; it is not active before its pointer moves."""
    number = F.lit(version).cast("long").alias("state_version")
    header = owner.select(number, *OWNER, F.lit(fingerprint).alias("scanner_fingerprint"), F.current_timestamp().alias("created_at"))
    return header, listed.select(number, "path", "content_hash")


def activate_pointers(pointers: DataFrame, updates: DataFrame, column: str = "snapshot_id") -> DataFrame:
    """Pointer table after an upsert per provider and model."""
    both = pointers.select(*OWNER, column, F.lit(0).alias("age")).unionByName(
        updates.select(*OWNER, column, F.lit(1).alias("age")))
    return both.groupBy(*OWNER).agg(F.max_by(column, F.struct("age", column)).alias(column))


def activation_errors(updates: DataFrame, headers: DataFrame, column: str = "state_version") -> DataFrame:
    """Updates that name an unknown version or one of another model."""
    owners = headers.select(column, F.col("provider").alias("owner_provider"), F.col("model_id").alias("owner_model"))
    joined = updates.join(owners, column, "left")
    foreign = (F.col("owner_provider") != F.col("provider")) | (F.col("owner_model") != F.col("model_id"))
    return joined.select(
        *OWNER, column, F.when(F.col("owner_provider").isNull(), "unknown version").when(foreign, "wrong owner").alias("error")
    ).filter(F.col("error").isNotNull())


def vacuum_by_pointer(table: DataFrame, pointers: DataFrame, column: str = "snapshot_id") -> DataFrame:
    """Rows whose snapshot or state is active for some model."""
    return table.join(pointers.select(column).distinct(), column, "left_semi")


def vacuum_embeddings(embeddings: DataFrame, symbols: DataFrame) -> DataFrame:
    """Vectors a symbol still uses."""
    return embeddings.join(symbols.select(*HASH).distinct(), HASH, "left_semi")


def union_dims(*tables: DataFrame) -> DataFrame:
    """Vectors of every dimension in one table."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


SYMBOL_KEY = ["snapshot_id", "path", "symbol_id"]


def symbol_violations(symbols: DataFrame) -> DataFrame:
    """Symbol keys that occur more than once: the line kept, the rows dropped."""
    return symbols.groupBy(*SYMBOL_KEY).agg(
        F.min("line").alias("kept_line"), (F.count(F.lit(1)) - 1).alias("dropped")
    ).filter(F.col("dropped") > 0)


def unique_symbols(symbols: DataFrame) -> DataFrame:
    """Symbols with the first row by line kept of each key.

    A minimum merges before the shuffle, so a key with very many copies does
    not gather in one task.
    """
    rest = [name for name in symbols.columns if name not in (*SYMBOL_KEY, "line", "qualified_name")]
    first = F.min(F.struct("line", "qualified_name", *rest)).alias("row")
    return symbols.groupBy(*SYMBOL_KEY).agg(first).select(*SYMBOL_KEY, "row.*").select(*symbols.columns)


def embedding_violations(embeddings: DataFrame) -> DataFrame:
    """Vectors of the wrong length, and keys that occur more than once."""
    wrong = embeddings.filter(F.size("embedding") != F.col("dim")).select(*HASH, F.lit("invalid dimension").alias("violation"))
    twice = embeddings.groupBy(*HASH).count().filter(F.col("count") > 1).select(*HASH, F.lit("duplicate key").alias("violation"))
    return wrong.unionByName(twice)


def state_matches(listed: DataFrame, state: DataFrame, same_fingerprint: Column | None = None) -> DataFrame:
    """One row, ``matches``: same fingerprint and the same path-hash pairs."""
    old = state.select("path", F.col("content_hash").alias("old_hash"))
    same = F.coalesce(F.col("content_hash") == F.col("old_hash"), F.lit(False))
    fingerprint = F.lit(True) if same_fingerprint is None else same_fingerprint
    return listed.select("path", "content_hash").join(old, "path", "full_outer").agg(
        F.bool_and(same).alias("same")).select((fingerprint & F.coalesce("same", F.lit(True))).alias("matches"))


DIGEST_FIELDS = ["provider", "model_id", "path", "line", "symbol_id", "kind", "name", "container", "qualified_name",
                 "signature", "documentation", "body", "embedding_hash"]
DIGEST_PIECES, PIECE = 16, 4


def row_digest() -> Column:
    """Digest of one active row: each field with its length, then the vector
    in fixed point, which is exact for any single-precision number below 2^23."""
    parts = []
    for name in DIGEST_FIELDS:
        text = F.col(name).cast("string")
        parts += [F.octet_length(text).cast("string"), F.lit(":"), text]

    def exact(value: Column) -> Column:
        # Scaling by a power of two loses nothing, nor does taking the whole part away.
        scaled = value.cast("double") * float(1 << 40)
        rest = (scaled - F.floor(scaled)) * float(1 << 55)
        whole = F.floor(scaled).cast("string")
        # Most numbers are whole by now.
        return F.when(rest == 0, F.concat(whole, F.lit(".0.0"))).otherwise(
            F.concat_ws(".", whole, *(F.floor(x).cast("string") for x in (rest, (rest - F.floor(rest)) * float(1 << 55)))))

    vector = F.array_join(F.transform("embedding", exact), ",")
    return F.sha2(F.concat(*parts, vector), 256)


def logical_digest(active: DataFrame, *keys: str) -> DataFrame:
    """Digest of the active content, blind to row order and snapshot ids.

    The row digests are cut into pieces and added up piece by piece: a sum
    needs no order, merges in partial aggregation and holds no rows, however
    many there are. One hash over count and sums is the result.
    """
    digest = active.select(*keys, row_digest().alias("digest"))
    # Three pieces are read at once, which a long holds, and taken apart by shifts.
    runs = [F.conv(F.substring("digest", at * PIECE + 1, 3 * PIECE), 16, 10).cast("long").alias(f"run_{at // 3}") for at in range(0, DIGEST_PIECES, 3)]
    digest = digest.select(*keys, *runs)

    def piece(at: int) -> Column:
        behind = min(DIGEST_PIECES, at // 3 * 3 + 3) - 1 - at
        return F.shiftright(f"run_{at // 3}", 4 * PIECE * behind).bitwiseAND(F.lit((1 << 4 * PIECE) - 1))

    sums = [F.coalesce(F.sum(piece(at)), F.lit(0).cast("long")).cast("string") for at in range(DIGEST_PIECES)]
    return digest.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *sums), 256).alias("digest"))


def index_status(models: DataFrame, pointers: DataFrame, symbols: DataFrame, manifests: DataFrame) -> DataFrame:
    """Per model: whether an index is there, its manifest and its size."""
    sizes = current_symbols(symbols, pointers).groupBy(*OWNER).agg(
        F.count(F.lit(1)).alias("symbols"), F.countDistinct("path").alias("files"))
    zero = F.lit(0).cast("long")
    return (
        models.join(pointers, OWNER, "left").join(sizes, OWNER, "left")
        .join(manifests.select(*OWNER, "version", "source"), OWNER, "left")
        .select(*OWNER, F.col("snapshot_id").isNotNull().alias("index_present"),
                F.coalesce("version", zero).alias("manifest_version"), F.coalesce("source", F.lit("")).alias("manifest_source"),
                F.coalesce("symbols", zero).alias("symbols"), F.coalesce("files", zero).alias("files"))
    )


def bump_manifests(manifests: DataFrame, digests: DataFrame) -> DataFrame:
    """Manifests after an index run: next version, new digest, local again."""
    return manifests.select("repo", "version").join(digests.select("repo", F.col("digest").alias("indexing_hash")), "repo").select(
        "repo", (F.col("version") + 1).alias("version"), "indexing_hash", F.lit("local").alias("source"),
        F.lit(None).cast("string").alias("ci_url"))


def bind_manifests(manifests: DataFrame, bindings: DataFrame) -> DataFrame:
    """Manifests bound to a published index; version and digest stay."""
    return manifests.drop("ci_url", "source").join(bindings.select("repo", "ci_url"), "repo").select(
        "repo", "version", "indexing_hash", F.lit("remote").alias("source"), "ci_url")


def normal_manifests(manifests: DataFrame) -> DataFrame:
    """Manifests as they are read: defaults filled in, texts without blanks around them."""
    clean = lambda name: trim_space(F.coalesce(F.col(name), F.lit("")))
    schema = F.coalesce("schema_version", F.lit(0))
    return manifests.withColumns({
        "schema_version": F.when(schema == 0, fixed.MANIFEST_SCHEMA_VERSION).otherwise(schema),
        "version": F.greatest(F.coalesce("version", F.lit(0)), F.lit(0)).cast("long"), "indexing_hash": clean("indexing_hash"),
        "source": F.lower(clean("source")), "ci_url": clean("ci_url")})


def reconcile_manifests(local: DataFrame, published: DataFrame) -> DataFrame:
    """What a sync does per repository.

    ``local`` holds ``repo, schema_version, version, indexing_hash, source,
    ci_url, has_index``; ``published`` the same without the last and with any
    ``source``. Both are normalised first. A published manifest counts
    as remote, and without an url of its own has the local one; where it
    differs in nothing but its schema version or url, only the manifest is
    written anew.
    """
    own = normal_manifests(local)
    remote = normal_manifests(published.withColumn("source", F.lit("remote"))).select(
        "repo", *(F.col(name).alias(f"remote_{name}") for name in ("schema_version", "version", "indexing_hash", "ci_url")))
    bound = (F.col("source") == "remote") & (F.col("ci_url") != "")
    same = (F.col("version") == F.col("remote_version")) & (F.col("indexing_hash") == F.col("remote_indexing_hash"))
    url = F.when(F.col("remote_ci_url") == "", F.col("ci_url")).otherwise(F.col("remote_ci_url"))
    written = (F.col("schema_version") == F.col("remote_schema_version")) & (F.col("ci_url") == url)
    action = (
        F.when(~bound, "unbound")
        .when(F.col("remote_version").isNull() & F.col("has_index"), "keep-local")
        .when(F.col("remote_version").isNull(), "missing")
        .when(~F.col("has_index") | ~same, "download")
        .when(~written, "metadata-refresh")
        .otherwise("up-to-date")
    )
    return own.join(remote, "repo", "left").select("repo", action.alias("action"))


def symbol_rows(keyed: DataFrame, snapshot_id: int) -> DataFrame:
    """Extracted symbols with a document hash, as rows of a snapshot."""
    return keyed.select(
        F.lit(snapshot_id).cast("long").alias("snapshot_id"), *OWNER, "path", "line", D.stable_symbol_id().alias("symbol_id"),
        "kind", "name", "container", "qualified_name", "signature", "documentation", "body", "embedding_hash")
