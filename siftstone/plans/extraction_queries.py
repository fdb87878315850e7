"""Checked queries of file sources, line extraction and declarations."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from ..operators import extract as E
from ..operators import lines as L
from ..sources import files as S
from ..sources import logs, rules
from . import shapes
from . import sql as Q
from .views import view, with_views



def filter_builtin_paths(spark, sf):
    return view(spark, sf, "paths_v").distinct().filter(~P.is_builtin_skipped(F.col("path")))


def filter_ignore_patterns(spark, sf):
    paths = view(spark, sf, "paths_v").distinct()
    return paths.select("path", P.is_ignored(F.col("path"), ["build/", "*.html", "/vendor"]).alias("plain"),
                        P.is_ignored(F.col("path"), ["*_test.txt", "tests/*", "!tests/src1"]).alias("negated"))


def filter_binary_files(spark, sf):
    return view(spark, sf, "raw_files_v").select("path", S.is_binary(F.col("content")).alias("is_binary"))


def file_content_hash(spark, sf):
    return view(spark, sf, "raw_files_v").select("path", S.content_hash(F.col("content")).alias("content_hash"))


def list_hashed_files(spark, sf):
    files = view(spark, sf, "raw_files_v").filter(
        ~P.is_builtin_skipped(F.col("path")) & ~P.is_ignored(F.col("path"), ["src3/", "*.html"]))
    return S.hashed_files(files)


def file_sha256(spark, sf):
    return view(spark, sf, "raw_files_v").select("path", S.revision(F.col("content")).alias("revision"))


def load_path_weights(spark, sf):
    pattern = F.concat(F.lit("**/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_partkey").cast("string"), F.lit("/**"))
    text = F.concat(F.lit('{"'), pattern, F.lit('": '), (F.col("p_size") * 25).cast("string"), F.lit("e-3}"))
    return rules.parse_path_weights(view(spark, sf, "part").select(text.alias("rules")))


def parse_hit_log(spark, sf):
    return logs.parse_hits(view(spark, sf, "hit_logs_v"))


def parse_index_log(spark, sf):
    return logs.parse_index_log(view(spark, sf, "index_logs_v"))


def explode_lines(spark, sf):
    files = view(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")).unionByName(
        view(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("path"),
                                        F.concat(F.replace("html", F.lit("</p>"), F.lit("\r\n")), F.lit("\n")).alias("content")))
    return L.explode_lines(files).select("path", "line", F.md5("text").alias("digest"))


def _marked_lines(spark, sf):
    return L.explode_lines(view(spark, sf, "marked_files_v"))


def normalize_comment_lines(spark, sf):
    return L.normalize_comments(_marked_lines(spark, sf)).select("path", "line", F.md5("text").alias("digest"))


def match_directives(spark, sf):
    return L.match_directives(_marked_lines(spark, sf)).select("path", "line", "directive", F.md5("payload").alias("payload"))


def extract_annotations(spark, sf):
    return L.extract_annotations(view(spark, sf, "marked_files_v"))


def following_lines(spark, sf):
    return L.following_lines(view(spark, sf, "marked_files_v")).select("path", "line", F.md5("following").alias("following"))


def comment_islands(spark, sf):
    lines = _marked_lines(spark, sf).withColumn("is_comment", (F.col("line") % 5).isin(1, 3, 4))
    return L.comment_islands(lines)


def clean_comments(spark, sf):
    return view(spark, sf, "comment_lines_v").select("conv_id", "turn", X.clean_comment(F.col("text")).alias("comment"))


def first_n_lines(spark, sf):
    text = F.col("text")
    return view(spark, sf, "documents").select("doc_id", X.first_lines(text, 4).alias("first4"), F.md5(X.first_lines(text, 10)).alias("first10"))


def combine_docs(spark, sf):
    parts = [F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" \t"), F.col("text"))).otherwise(" "), F.col("role"), F.concat("text", F.lit("\n"))]
    return view(spark, sf, "conversations").select("conv_id", "turn", X.join_parts(*parts).alias("doc"))


def route_extractors(spark, sf):
    files = view(spark, sf, "source_files_v").select("path").unionByName(view(spark, sf, "paths_v").distinct())
    return E.route_extractors(files)


def trailing_comments(spark, sf):
    part = view(spark, sf, "part")
    slash = part.select(F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("row_id"), F.lit(True).alias("slash"),
                        F.concat(F.lit("var x = 1 // "), "p_name").alias("text"))
    hash_ = part.select(F.concat(F.lit("h"), F.col("p_partkey").cast("string")).alias("row_id"), F.lit(False).alias("slash"),
                        F.concat(F.lit("X = 1  # "), "p_brand").alias("text"))
    return slash.unionByName(hash_).select("row_id", L.trailing_comment(F.col("text"), F.col("slash")).alias("comment"))


def extract_declarations(spark, sf):
    out = E.extract_declarations(view(spark, sf, "source_files_v"))
    return out.select("path", "line", "kind", "name", "container", "qualified_name", "signature", "documentation", "file_context",
                      F.md5("body").alias("body"))


def extract_shapes(spark, sf):
    out = E.extract_symbols(view(spark, sf, "shape_files_v"))
    return out.select("path", "line", "kind", "name", "container", "qualified_name", "signature", "documentation", "file_context",
                      F.md5("body").alias("body"))


def route_unparsed(spark, sf):
    return E.route_extractors(view(spark, sf, "shape_files_v"))


def _annotate(path: str, content: str) -> list[dict]:
    """A caller's extractor: one symbol per file, named after its content."""
    return [{"line": 1, "kind": "file", "name": hashlib.md5(content.encode()).hexdigest(), "body": content}]


def extract_with_udtf(spark, sf):
    files = view(spark, sf, "marked_files_v")
    return E.extract_with(files, _annotate).select("path", "line", "kind", "name", "documentation", F.md5("body").alias("body"))


_SKIP = r"(regexp_matches(path, '^/*[.](git|semsearch)(/|$)') OR regexp_matches(lower(path), '(^|/)readme([.][^/]*)?(/|$)'))"
_LINES = """marked AS (SELECT path, string_split(content, chr(10)) AS lines FROM marked_files_v),
lines AS (SELECT path, unnest(range(1, len(lines) + 1))::INT AS line, unnest(lines) AS text, lines FROM marked)"""
# What the marked lines hold, from how they were made.
_DIRECTIVES = _LINES + """,
source_lines AS (SELECT concat(source, '/doc_', doc_id, CASE WHEN doc_id % 5 = 0 THEN '.sql' ELSE '.txt' END) AS path,
 unnest(range(1, len(string_split(text, chr(10))) + 1))::INT AS line, unnest(string_split(text, chr(10))) AS original FROM documents),
directives AS (SELECT s.path, s.line, CASE WHEN s.line % 5 = 1 THEN 'search' ELSE 'context' END AS directive,
 regexp_replace(regexp_replace(""" + Q.trim_space("original") + r""", '^:\s*', ''), '\s*[*]/$', '') AS payload FROM source_lines s WHERE s.line % 5 IN (1, 3))"""
_BODY = Q.trim_space("array_to_string(l.lines[l.line + 1 : l.line + 10], chr(10))")
_PREFIXES = ["///", "/\\*!", "/\\*\\*", "//!", "//", "#", "/\\*", "\\*/", "\\*"]


def _clean_sql(x: str) -> str:
    out = Q.trim_space(x)
    for prefix in _PREFIXES:
        out = f"regexp_replace({out}, '^{prefix}', '')"
    return Q.trim_space(f"regexp_replace({out}, '[*]/$', '')")


_FIRST = lambda n: Q.trim_space(f"array_to_string((string_split({Q.trim_space('text')}, chr(10)))[1:{n}], chr(10))")
_CAMEL = "concat('Part', p_partkey)"

QUERIES = {
    "filter_builtin_paths": (filter_builtin_paths, with_views(f"SELECT DISTINCT path FROM paths_v WHERE NOT {_SKIP}", "paths_v")),
    "filter_ignore_patterns": (filter_ignore_patterns, with_views("""SELECT path, regexp_matches(path, '(^|/)build/|[.]html($|/)|^/?vendor($|/)') AS plain,
 CASE WHEN regexp_matches(path, '_test[.]txt$') THEN NOT FALSE WHEN regexp_matches(path, '(^|/)tests/src1(/|$)') THEN FALSE ELSE regexp_matches(path, '(^|/)tests/[^/]') END AS negated
 FROM (SELECT DISTINCT path FROM paths_v)""", "paths_v")),
    "filter_binary_files": (filter_binary_files, with_views("""SELECT path, contains(probe, '00x') OR odd * 100 // greatest(n, 1) > 10 AS is_binary FROM (
 SELECT path, len(bytes) AS n, array_to_string(list_transform(bytes, lambda b: b || 'x'), '') AS probe,
 len(list_filter(bytes, lambda b: b < '20' AND b NOT IN ('0A', '0D', '09', '0C'))) AS odd
 FROM (SELECT path, regexp_extract_all(left(hex(content), 16384), '..') AS bytes FROM raw_files_v))""", "raw_files_v")),
    "file_content_hash": (file_content_hash, with_views("SELECT path, md5(content) AS content_hash FROM raw_files_v", "raw_files_v")),
    "list_hashed_files": (list_hashed_files, with_views(f"""SELECT path, md5(content) AS content_hash FROM raw_files_v WHERE NOT {_SKIP}
 AND NOT regexp_matches(path, '(^|/)src3/|[.]html$') AND NOT starts_with(path, 'blob/')
 AND len(list_filter(regexp_extract_all(left(hex(content), 16384), '..'), lambda b: b = '02')) * 100 // greatest(least(octet_length(content), 8192), 1) <= 10
 UNION ALL SELECT path, md5(content) FROM raw_files_v WHERE starts_with(path, 'blob/')
 AND len(list_filter(regexp_extract_all(hex(content), '..'), lambda b: b = '00')) = 0
 AND len(list_filter(regexp_extract_all(hex(content), '..'), lambda b: b < '20' AND b NOT IN ('0A', '0D', '09', '0C'))) * 100 // 16 <= 10""", "raw_files_v")),
    "file_sha256": (file_sha256, with_views("SELECT path, concat('sha256:', sha256(content)) AS revision FROM raw_files_v", "raw_files_v")),
    "load_path_weights": (load_path_weights, """SELECT concat('**/', replace(p_name, ' ', '_'), p_partkey, '/**') AS pattern, (p_size * 25 / 1000.0)::DOUBLE AS weight,
 p_size BETWEEN 1 AND 40 AS valid FROM part"""),
    "parse_hit_log": (parse_hit_log, """SELECT event_id AS run, (event_id % 12 + 1)::INT AS rank, concat('dir ', event_id % 5, '/f:', user_id, '.txt') AS path, (event_id % 7 + 1)::INT AS line, TRUE AS ok
 FROM events WHERE event_type NOT IN ('error', 'signup')
 UNION ALL SELECT event_id, 13, 'last.go', user_id::INT, TRUE FROM events WHERE event_type NOT IN ('error', 'signup')
 UNION ALL SELECT event_id, NULL, NULL, NULL, event_type = 'error' FROM events WHERE event_type IN ('error', 'signup')"""),
    "parse_index_log": (parse_index_log, """SELECT event_id AS run, CASE event_type WHEN 'error' THEN '' WHEN 'view' THEN 'Index already up to date' ELSE concat('Indexed ', user_id, ' symbols in  ', event_id % 40, ' files') END AS summary,
 CASE WHEN event_type IN ('error', 'view') THEN 0 ELSE user_id END::INT AS indexed_symbols, CASE WHEN event_type IN ('error', 'view') THEN 0 ELSE event_id % 40 END::INT AS indexed_files, event_type <> 'error' AS ok FROM events"""),
    "explode_lines": (explode_lines, """SELECT path, unnest(range(1, len(lines) + 1))::INT AS line, unnest(list_transform(lines, lambda x: md5(x))) AS digest FROM (
 SELECT doc_id::VARCHAR AS path, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS lines FROM documents WHERE text <> ''
 UNION ALL SELECT concat('p', page_id), string_split(replace(html, '</p>', chr(10)), chr(10)) FROM pages)"""),
    "normalize_comment_lines": (normalize_comment_lines, with_views(f"""WITH {_LINES} SELECT path, line,
 md5({Q.trim_space("regexp_replace(regexp_replace(" + Q.trim_space('text') + r", '^((//|/[*]|[*]|#|--|;)\s*)+', ''), '\s*[*]/$', '')")}) AS digest FROM lines""", "marked_files_v")),
    "match_directives": (match_directives, with_views(f"WITH {_DIRECTIVES} SELECT path, line, directive, md5(payload) AS payload FROM directives", "marked_files_v")),
    "extract_annotations": (extract_annotations, with_views(f"""WITH {_DIRECTIVES},
 contexts AS (SELECT path, string_agg(payload, chr(10) ORDER BY line) AS file_context FROM directives WHERE directive = 'context' AND payload <> '' GROUP BY path)
 SELECT l.path, l.line, 'annotation' AS kind, concat('annotation:', l.line) AS name, '' AS container, concat('annotation:', l.line) AS qualified_name, '' AS signature,
 d.payload AS documentation, {_BODY} AS body, coalesce(c.file_context, '') AS file_context
 FROM directives d JOIN lines l ON d.path = l.path AND d.line = l.line LEFT JOIN contexts c ON c.path = l.path WHERE d.payload <> ''""", "marked_files_v")),
    "following_lines": (following_lines, with_views(
        f"WITH {_LINES} SELECT path, line, md5(array_to_string(lines[line + 1 : line + 10], chr(10))) AS following FROM lines", "marked_files_v")),
    "comment_islands": (comment_islands, with_views(f"""WITH {_LINES} SELECT path, min(line) AS first_line, max(line) AS last_line, string_agg(text, chr(10) ORDER BY line) AS text
 FROM (SELECT path, line, text, CASE WHEN line % 5 = 1 THEN line ELSE line // 5 * 5 + 3 END AS island FROM lines WHERE line % 5 IN (1, 3, 4)) GROUP BY path, island""", "marked_files_v")),
    "clean_comments": (clean_comments, with_views(f"""SELECT conv_id, turn, {Q.trim_space("array_to_string(list_transform(string_split(" + Q.trim_space('text') + ", chr(10)), lambda x: " + _clean_sql('x') + "), chr(10))")} AS comment FROM comment_lines_v""", "comment_lines_v")),
    "first_n_lines": (first_n_lines, f"SELECT doc_id, {_FIRST(4)} AS first4, md5({_FIRST(10)}) AS first10 FROM documents"),
    "combine_docs": (combine_docs, f"SELECT conv_id, turn, concat(CASE WHEN turn % 2 = 0 THEN {Q.trim_space('text')} || chr(10) ELSE '' END, role, chr(10), {Q.trim_space('text')}) AS doc FROM conversations"),
    "route_extractors": (route_extractors, with_views("""SELECT path, CASE WHEN regexp_matches(lower(path), '[.](go|py|rs|js|jsx|mjs|cjs|ts|tsx)$') THEN 'declarations' ELSE 'annotations' END AS extractor
 FROM (SELECT path FROM source_files_v UNION ALL SELECT DISTINCT path FROM paths_v)""", "source_files_v", "paths_v")),
    "trailing_comments": (trailing_comments, """SELECT concat('s', p_partkey) AS row_id, p_name AS comment FROM part UNION ALL SELECT concat('h', p_partkey), regexp_replace(p_brand, '^#', '') FROM part"""),
    "extract_declarations": (extract_declarations, f"""WITH syms AS (
 SELECT concat('go/p', p_partkey, '.go') AS path, 5 AS line, 'struct' AS kind, {_CAMEL} AS name, '' AS container, {_CAMEL} AS signature, p_name AS documentation, concat('Catalogue of ', p_type, '.') AS file_context,
  concat('struct {{', chr(10), '  Size int', chr(10), '}}') AS body FROM part
 UNION ALL SELECT concat('go/p', p_partkey, '.go'), 10, 'method', 'SizeOf', {_CAMEL}, concat('func (p *', {_CAMEL}, ') SizeOf() int'), concat('Size tells ', p_brand, '.'), concat('Catalogue of ', p_type, '.'),
  concat('{{', chr(10), '  return ', p_size, chr(10), '}}') FROM part
 UNION ALL SELECT concat('py/p', p_partkey, '.py'), 1, 'class', {_CAMEL}, '', concat('class ', {_CAMEL}, ':'), p_name, '',
  concat('\"\"\"', p_name, '\"\"\"', chr(10), chr(10), '    # ', p_brand, chr(10), '    def size(self):', chr(10), '        return ', p_size) FROM part
 UNION ALL SELECT concat('py/p', p_partkey, '.py'), 5, 'method', 'size', {_CAMEL}, 'def size(self):', p_brand, '', concat('return ', p_size) FROM part
 UNION ALL SELECT concat('py/p', p_partkey, '.py'), 8, 'constant', 'LIMIT', '', concat('LIMIT = ', p_size), '', '', '' FROM part
 UNION ALL SELECT concat('rs/p', p_partkey, '.rs'), 2, 'struct', {_CAMEL}, '', concat('pub struct ', {_CAMEL}), p_name, '', concat('{{', chr(10), '    size: usize,', chr(10), '}}') FROM part
 UNION ALL SELECT concat('rs/p', p_partkey, '.rs'), 8, 'method', 'size', {_CAMEL}, 'pub fn size(&self) -> usize', p_brand, '', concat('{{', chr(10), '        self.size', chr(10), '    }}') FROM part
 UNION ALL SELECT concat('ts/p', p_partkey, '.ts'), 2, 'class', {_CAMEL}, '', concat('class ', {_CAMEL}), p_name, '',
  concat('{{', chr(10), '  // ', p_brand, chr(10), '  size(): number {{ return ', p_size, ' }}', chr(10), '}}') FROM part
 UNION ALL SELECT concat('ts/p', p_partkey, '.ts'), 4, 'method', 'size', {_CAMEL}, 'size(): number', p_brand, '', concat('{{ return ', p_size, ' }}') FROM part
 UNION ALL SELECT concat('ts/p', p_partkey, '.ts'), 7, 'constant', 'limit', '', concat('limit = ', p_size), '', '', p_size::VARCHAR FROM part)
SELECT path, line, kind, name, container, CASE WHEN container = '' THEN name ELSE concat(container, '.', name) END AS qualified_name, signature, documentation, file_context, md5(body) AS body FROM syms"""),
    "extract_shapes": (extract_shapes, shapes.symbols_sql()),
    "route_unparsed": (route_unparsed, shapes.verdicts_sql()),
    "extract_with_udtf": (extract_with_udtf, with_views(
        "SELECT path, 1::INT AS line, 'file' AS kind, md5(content) AS name, '' AS documentation, md5(content) AS body FROM marked_files_v", "marked_files_v")),
}
