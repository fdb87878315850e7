"""The checked queries of the operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a container's samples, and what its boxes say, with the payload read back."""
    from .media import media_tracks, store_texts

    files = store_texts(table(spark, sf_dir, "documents"))
    tracks = media_tracks(files, keys=("doc_id", "text_bytes"), checks=True)
    ranges = F.transform("keyframe_ranges", lambda r: F.concat_ws("+", r["start"], r["length"]))
    feature = F.concat_ws(";", F.concat(F.lit("codec="), "codec"), F.concat(F.lit("duration="), F.col("duration").cast("string")),
                          F.concat(F.lit("samples="), "n_samples"), F.concat(F.lit("keyframes="), "n_keyframes"),
                          F.concat(F.lit("ranges="), F.md5(F.concat_ws(",", ranges))))
    return tracks.select("doc_id", F.col("text_bytes").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes",
                         "media_sha256", feature.alias("feature"), "codec", "duration", "n_samples", "n_keyframes")


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded by the public SentencePiece model and decoded again."""
    from .sentence_pieces import encode_pieces

    return encode_pieces(table(spark, sf_dir, "documents"), checks=True)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity under a model of trusted text, and whether its language's threshold keeps it."""
    from .quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document less its lines that an earlier one equals or nearly equals."""
    from .line_dedup import dedup_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split("text", "\n")).alias("n_lines"))
    kept = dedup_lines(docs)
    return kept.select("doc_id", "text", "n_lines", F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).alias("n_kept"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token sequences of at most 4,096 ids."""
    from .packing import digests, packed_documents

    return digests(packed_documents(table(spark, sf_dir, "documents")))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    from .fingerprints import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes, tokens and rows."""
    from .sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from four fifths of them."""
    from .language_id import fit, held_out, predict_languages

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out()))
    return predict_languages(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document; more than 2,048 are over the limit."""
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 2048)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash and the near-duplicate component it is in."""
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors, by inner product, of every twentieth one."""
    from .vector_graph import nearest_vectors

    return nearest_vectors(table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the words of every source lie from those of each other source, and which words set it apart from its language."""
    from .divergence import audit_sources

    return audit_sources(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A leaf for every document, its proof, and whether the proof holds after tampering."""
    from .merkle import audited_manifest

    return audited_manifest(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole corpus pipeline over ``documents``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_media_columns": op1_media_columns,
    "op2_sentence_pieces": op2_sentence_pieces,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_line_dedup": op4_line_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_sharding": op7_sharding,
    "op8_language_id": op8_language_id,
    "op9_token_counts": op9_token_counts,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_vector_graph": op11_vector_graph,
    "op12_source_divergence": op12_source_divergence,
    "op13_merkle_manifest": op13_merkle_manifest,
}

# Edit distance 1 leaves one half of the shorter line as it is, so equal halves are joined.
LINES_SQL = """
WITH rows AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
places AS (SELECT doc_id, pos - 1 AS pos, trim(parts[pos], ' ' || chr(9) || chr(13)) AS line
           FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos FROM rows)),
firsts AS (SELECT line, min((doc_id, pos)) AS place, length(line) AS n FROM places WHERE line <> '' GROUP BY line),
halves AS (SELECT line, place, n, b, CAST(floor(b / 2) AS int) AS m FROM (SELECT *, unnest([n, n - 1]) AS b FROM firsts WHERE n >= 32)),
pairs AS (
  SELECT x.line, y.line AS earlier FROM halves x JOIN halves y ON x.b = y.b AND left(x.line, x.m) = left(y.line, y.m)
  WHERE y.place < x.place AND (x.n = x.b OR y.n = y.b)
  UNION SELECT x.line, y.line FROM halves x JOIN halves y ON x.b = y.b AND right(x.line, x.b - x.m) = right(y.line, y.b - y.m)
  WHERE y.place < x.place AND (x.n = x.b OR y.n = y.b)),
near AS (SELECT DISTINCT line FROM pairs WHERE levenshtein(line, earlier) = 1),
kept AS (SELECT p.doc_id, p.pos FROM places p LEFT JOIN firsts f ON p.line = f.line LEFT JOIN near ON p.line = near.line
         WHERE p.line = '' OR (near.line IS NULL AND f.place = (p.doc_id, p.pos))),
texts AS (SELECT r.doc_id, string_agg(r.parts[k.pos + 1], chr(10) ORDER BY k.pos) AS text FROM rows r JOIN kept k ON r.doc_id = k.doc_id GROUP BY r.doc_id)
SELECT r.doc_id, CASE WHEN r.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text, CAST(len(r.parts) AS int) AS n_lines,
       CASE WHEN r.text IS NULL THEN NULL WHEN coalesce(t.text, '') = '' THEN 0 ELSE CAST(len(string_split(t.text, chr(10))) AS int) END AS n_kept
FROM rows r LEFT JOIN texts t ON r.doc_id = t.doc_id"""

SOURCES_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_count FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
cells AS (SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
langs AS (SELECT lang, count(*) AS v, sum(lang_count) AS n FROM kept GROUP BY lang),
groups AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0) AS n FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN cells c USING (lang, source) GROUP BY g.lang, g.source),
shares AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
                  1 + (1000000000 * (coalesce(c.c, 0)::HUGEINT + 5)) // (g.n::HUGEINT + 5 * l.v) AS p,
                  1 + (1000000000 * (k.lang_count::HUGEINT + 5)) // (l.n::HUGEINT + 5 * l.v) AS q
           FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source
         GROUP BY x.lang, x.source, y.source),
rows AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
         FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN sums s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
         UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM shares WHERE c > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS int) AS rank FROM rows QUALIFY part = 'pair' OR rank <= 50"""

# One step of the first two recursions makes a level of the trees, one of the last folds a step of the proofs.
MANIFEST_SQL = """
WITH RECURSIVE heads AS (
  SELECT row_number() OVER () AS r, doc_id, source, text,
         xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
                         lambda crc, x: list_reduce([xor(crc, x)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, (a & 1) * 3988292384))), 4294967295) % 5 = 0 AS hit,
         concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
                coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head
  FROM documents),
leaves AS (SELECT r, doc_id, source, sha256(concat(head, coalesce(strlen(text) || ':' || text, '-'))) AS leaf, hit,
                  sha256(concat(head, coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-'))) AS changed FROM heads),
placed AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS src, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                  count(*) OVER (PARTITION BY source) AS n FROM leaves),
tree AS (SELECT src, 0 AS level, pos, n, leaf AS digest FROM placed
         UNION ALL SELECT src, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY src, level, n, pos // 16),
subroots AS (SELECT src, digest, row_number() OVER (ORDER BY src) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (SELECT 0 AS level, pos, n, digest FROM subroots
        UNION ALL SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, n, pos // 16),
nodes AS (SELECT src, level, pos, digest FROM tree WHERE n > 1 UNION ALL SELECT -1, level, pos, digest FROM top WHERE n > 1),
steps AS (SELECT src, level, pos,
                 coalesce(string_agg(digest, '') OVER (PARTITION BY src, level, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
                 coalesce(string_agg(digest, '') OVER (PARTITION BY src, level, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM nodes),
ways AS (SELECT p.r, s.level AS k, before, after FROM placed p JOIN steps s ON s.src = p.src AND s.pos = p.pos // CAST(16 ** s.level AS BIGINT)
         UNION ALL SELECT p.r, 1000 + s.level, before, after FROM placed p JOIN subroots u ON u.src = p.src JOIN steps s ON s.src = -1 AND s.pos = u.pos // CAST(16 ** s.level AS BIGINT)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY k) AS step FROM ways),
proofs AS (SELECT r, max(step) AS steps, sha256(string_agg(before || after, '' ORDER BY step)) AS proof_sha256 FROM ranked GROUP BY r),
folds AS (SELECT r, 0 AS step, CASE WHEN hit THEN changed ELSE leaf END AS node FROM placed
          UNION ALL SELECT f.r, f.step + 1, sha256(concat(w.before, f.node, w.after)) FROM folds f JOIN ranked w ON w.r = f.r AND w.step = f.step + 1)
SELECT p.doc_id, p.leaf, u.digest AS subroot, t.digest AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, f.node AS folded_root, f.node = t.digest AS verified
FROM placed p JOIN subroots u ON u.src = p.src CROSS JOIN (SELECT digest FROM top WHERE n = 1) t LEFT JOIN proofs q ON q.r = p.r
JOIN folds f ON f.r = p.r AND f.step = coalesce(q.steps, 0)"""

ORACLE_SQL: dict[str, str] = {"op4_line_dedup": LINES_SQL, "op12_source_divergence": SOURCES_SQL, "op13_merkle_manifest": MANIFEST_SQL}
