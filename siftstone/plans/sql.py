"""Pieces of DuckDB text shared by the checks."""

from __future__ import annotations

from ..functions import fixed


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trim_space(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\x0B\p{{Z}}]+|[\s\x0B\p{{Z}}]+$', '', 'g')"


def normalize_text(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{Nd}}]+', ' ', 'g'))"


def query_tokens(x: str) -> str:
    """Distinct tokens in first-seen order."""
    words = f"string_split({normalize_text(x)}, ' ')"
    return f"list_filter({words}, lambda w, i: w <> '' AND list_position({words}, w) = i)"


def join_parts(*parts: str) -> str:
    items = ", ".join(trim_space(part) for part in parts)
    return f"array_to_string(list_filter([{items}], lambda p: p <> ''), chr(10))"


def result_text(prefix: str = "") -> str:
    names = ["kind", "name", "container", "qualified_name", "signature", "documentation", "body"]
    return join_parts(*[prefix + name for name in names])


def base_name(path: str) -> str:
    return f"regexp_extract({path}, '([^/]*)$', 1)"


def _weight_regex(glob: str) -> str:
    # Only the shapes the default rules use: **/name and **/name/**.
    body = glob.removeprefix("**/")
    below = body.endswith("/**")
    body = body.removesuffix("/**").replace(".", "[.]").replace("*", "[^/]*")
    return f"(^|/){body}" + ("(/|$)" if below else "($|/)")


def path_weight(path: str) -> str:
    cases = " ".join(
        f"WHEN regexp_matches({path}, {quote(_weight_regex(glob))}) THEN {weight}::DOUBLE"
        for glob, weight in sorted(fixed.DEFAULT_PATH_WEIGHTS.items(), key=lambda item: item[1])
    )
    return f"CASE {cases} ELSE 1.0::DOUBLE END"


def variants(tokens: str) -> str:
    """CTE text ``token, variant, weight`` over a relation of distinct tokens."""
    synonyms = ", ".join(
        f"({quote(key)}, {quote(value)})" for key, values in fixed.SYNONYMS.items() for value in values)
    return f"""
SELECT token, variant, max(weight) AS weight FROM (
  SELECT token, token AS variant, 1.0::DOUBLE AS weight FROM {tokens}
  UNION ALL SELECT token, CASE WHEN suffix(token, 'ies') AND strlen(token) > 3 THEN left(token, length(token) - 3) || 'y'
      WHEN suffix(token, 'es') AND strlen(token) > 2 THEN left(token, length(token) - 2)
      WHEN suffix(token, 's') AND strlen(token) > 1 THEN left(token, length(token) - 1) ELSE token END, 0.92::DOUBLE FROM {tokens}
  UNION ALL SELECT token, CASE WHEN suffix(token, 'y') AND strlen(token) > 1 THEN left(token, length(token) - 1) || 'ies'
      WHEN suffix(token, 's') THEN token ELSE token || 's' END, 0.88::DOUBLE FROM {tokens}
  UNION ALL SELECT t.token, s.word, 0.72::DOUBLE FROM {tokens} t JOIN (VALUES {synonyms}) s(key, word) ON t.token = s.key
) GROUP BY token, variant"""


def lexical_ctes(queries: str = "queries_v", symbols: str = "symbols_v") -> str:
    """CTEs up to ``pair_scores(query_id, path, ..., score, path_weight)``.

    Words of a text are compared with variants by ``contains``; the phrase is
    looked for in the text of every pair that shares a word.
    """
    return f"""
texts AS (SELECT path, symbol_id, line, qualified_name, {path_weight('path')} AS path_weight,
  {normalize_text(result_text())} AS text_norm, {normalize_text('path')} AS path_norm, {normalize_text(base_name('path'))} AS base_norm FROM {symbols}),
asked AS (SELECT query_id, {normalize_text('text')} AS phrase, {query_tokens('text')} AS tokens FROM {queries}),
asked_tokens AS (SELECT query_id, phrase, len(tokens) AS n, unnest(tokens) AS token FROM asked),
distinct_tokens AS (SELECT DISTINCT token FROM asked_tokens),
variants AS ({variants('distinct_tokens')}),
words AS (SELECT DISTINCT path, symbol_id, field, word FROM (
  SELECT path, symbol_id, 't' AS field, unnest(string_split(text_norm, ' ')) AS word FROM texts
  UNION ALL SELECT path, symbol_id, 'p', unnest(string_split(path_norm, ' ')) FROM texts
  UNION ALL SELECT path, symbol_id, 'b', unnest(string_split(base_norm, ' ')) FROM texts) WHERE word <> ''),
matched AS (SELECT v.token, w.word, max(v.weight) AS weight FROM (SELECT DISTINCT word FROM words) w JOIN variants v
  ON contains(w.word, v.variant) GROUP BY v.token, w.word),
token_weights AS (SELECT w.path, w.symbol_id, m.token,
  coalesce(max(CASE WHEN field = 't' THEN weight END), 0) AS wt, coalesce(max(CASE WHEN field = 'p' THEN weight END), 0) AS wp,
  coalesce(max(CASE WHEN field = 'b' THEN weight END), 0) AS wb FROM words w JOIN matched m ON w.word = m.word GROUP BY ALL),
pair_sums AS (SELECT a.query_id, a.n, a.phrase, t.path, t.symbol_id, sum(wt) AS st, sum(greatest(wt, wp)) AS sd,
  sum(CASE WHEN wb > 0 THEN 0.03 * wb ELSE 0.01 * wp END) AS near
  FROM asked_tokens a JOIN token_weights t ON a.token = t.token GROUP BY ALL),
pair_scores AS (SELECT s.query_id, x.path, x.line, x.qualified_name, x.symbol_id, x.path_weight, least(1.0::DOUBLE,
  CASE WHEN contains(x.text_norm, s.phrase) THEN 0.7::DOUBLE WHEN contains(concat(x.text_norm, ' ', x.path_norm), s.phrase) THEN 0.35::DOUBLE ELSE 0 END
  + near + 0.45 * st / n + CASE WHEN sd > st THEN 0.1 * (sd - st) / n ELSE 0 END
  + CASE WHEN n > 1 AND st >= 0.999 * n THEN 0.25 WHEN n > 1 AND sd >= 0.999 * n THEN 0.12 ELSE 0 END
  + CASE WHEN n = 1 AND sd > 0 THEN 0.2 * sd ELSE 0 END) AS score
  FROM pair_sums s JOIN texts x ON s.path = x.path AND s.symbol_id = x.symbol_id),
lexical AS (SELECT query_id, path, line, qualified_name, symbol_id, round(score * path_weight, 9) AS lexical_score FROM pair_scores),
top_lexical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
  ORDER BY lexical_score DESC, path, line, qualified_name, symbol_id) AS rank FROM lexical WHERE lexical_score > 0) WHERE rank <= 10)"""


def distance(left: str, right: str) -> str:
    return f"round(list_distance({left}::DOUBLE[], {right}::DOUBLE[]), 9)"


def semantic_ctes(queries: str, embeddings: str, symbols: str = "symbols_v", k: int = 50) -> str:
    """CTEs for the nearest vectors and their symbols; needs ``lexical_ctes``."""
    return f"""
nearest AS (SELECT * FROM (SELECT q.query_id, e.embedding_hash, {distance('q.query_vector', 'e.embedding')} AS distance,
  row_number() OVER (PARTITION BY q.query_id ORDER BY {distance('q.query_vector', 'e.embedding')}, e.embedding_hash) AS candidate_rank
  FROM {queries} q, {embeddings} e WHERE e.embedding_hash IN (SELECT embedding_hash FROM {symbols})) WHERE candidate_rank <= {k}),
found AS (SELECT n.query_id, n.distance, n.candidate_rank, x.path, x.symbol_id, x.line, x.qualified_name,
  round(CASE WHEN 1 - n.distance <= 0 THEN n.distance ELSE 1 - (1 - n.distance) * x.path_weight END, 12) AS sort_distance,
  coalesce(l.lexical_score, 0) AS lexical_score
  FROM nearest n JOIN {symbols} s ON n.embedding_hash = s.embedding_hash JOIN texts x ON s.path = x.path AND s.symbol_id = x.symbol_id
  LEFT JOIN lexical l ON l.query_id = n.query_id AND l.path = x.path AND l.symbol_id = x.symbol_id)"""


SEMANTIC_ORDER = "sort_distance, distance, lexical_score DESC, path, line, qualified_name, symbol_id"
