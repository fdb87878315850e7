"""Input views over the driver tables, as text both engines can run.

Each view is SQL with ``{name}`` for the tables and views it reads. A pair
holds the text for Spark and for DuckDB where array functions differ in name.
Every view covers its whole tables.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

from ..session import dealt
from . import shapes

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]

VIEWS: dict[str, str | tuple[str, str]] = {
    # One symbol per document, whole text as body; paths hit the weight rules.
    "symbols_v": """
SELECT doc_id,
       concat(CASE doc_id % 8 WHEN 0 THEN 'tests/' WHEN 1 THEN 'examples/' WHEN 2 THEN 'vendor/acme/' ELSE 'src/' END,
              source, '/doc_', CAST(doc_id AS string), CASE WHEN doc_id % 5 = 0 THEN '_test.txt' ELSE '.txt' END) AS path,
       md5(concat('sym|', CAST(doc_id AS string))) AS symbol_id,
       CAST(doc_id % 50 + 1 AS int) AS line,
       CASE doc_id % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 2 THEN 'type' ELSE 'constant' END AS kind,
       regexp_extract(text, '[A-Za-z]+', 0) AS name,
       source AS container,
       concat(source, '.', regexp_extract(text, '[A-Za-z]+', 0)) AS qualified_name,
       split_part(text, chr(10), 1) AS signature,
       split_part(text, chr(10), 2) AS documentation,
       text AS body,
       concat(lang, ' text') AS file_context,
       md5(concat('doc|', CAST(doc_id AS string))) AS embedding_hash,
       'local' AS provider, 'hash64' AS model_id
FROM {documents}""",
    "embeddings_v": """
SELECT md5(concat('doc|', CAST(vec_id AS string))) AS embedding_hash, 'local' AS provider, 'hash64' AS model_id,
       64 AS dim, embedding FROM {embeddings}""",
    # Vectors of a second model, twice as long.
    "wide_embeddings_v": (
        """SELECT md5(concat('doc|', CAST(vec_id AS string))) AS embedding_hash, 'local' AS provider, 'hash128' AS model_id,
       128 AS dim, concat(embedding, reverse(embedding)) AS embedding FROM {embeddings}""",
        """SELECT md5(concat('doc|', CAST(vec_id AS string))) AS embedding_hash, 'local' AS provider, 'hash128' AS model_id,
       128 AS dim, list_concat(embedding, list_reverse(embedding)) AS embedding FROM {embeddings}"""),
    # Every vector is a query as well: all-pairs neighbours.
    "vector_queries_v": "SELECT vec_id AS query_id, embedding AS query_vector FROM {embeddings}",
    # Long passages, short names and code-like brands.
    "query_texts_v": """
SELECT concat('b', CAST(item_id AS string)) AS query_id, text,
       CASE CAST(item_id % 7 AS int) WHEN 0 THEN 'auto' WHEN 1 THEN ' Semantic' WHEN 2 THEN 'lexical' WHEN 3 THEN NULL WHEN 4 THEN 'LEXICAL ' WHEN 5 THEN 'semantic' ELSE 'fuzzy' END AS mode, item_id AS vec_id FROM {benchmark}
UNION ALL SELECT concat('n', p_name), p_name, 'auto', min(p_partkey) FROM {part} GROUP BY p_name
UNION ALL SELECT concat('c', p_brand), p_brand, 'auto', min(p_partkey) FROM {part} GROUP BY p_brand""",
    # A query's vector is a stored one read backwards, so it is nobody's copy.
    "queries_v": (
        """SELECT q.query_id, q.text, q.mode, reverse(e.embedding) AS query_vector
FROM {query_texts_v} q JOIN {embeddings} e ON q.vec_id = e.vec_id""",
        """SELECT q.query_id, q.text, q.mode, list_reverse(e.embedding) AS query_vector
FROM {query_texts_v} q JOIN {embeddings} e ON q.vec_id = e.vec_id"""),
    # Short blends of a stored vector and its reverse: many vectors lie closer than 1, so cut and weights matter.
    "near_queries_v": (
        """SELECT q.query_id, q.text, q.mode, zip_with(e.embedding, reverse(e.embedding), (x, y) ->
        CAST(CAST(x AS double) * (CASE WHEN q.vec_id % 4 = 0 THEN 0.0D ELSE 0.1D END) + CAST(y AS double) * 0.1D AS float)) AS query_vector
FROM {query_texts_v} q JOIN {embeddings} e ON q.vec_id = e.vec_id""",
        """SELECT q.query_id, q.text, q.mode, list_transform(list_zip(e.embedding, list_reverse(e.embedding)), lambda p:
        (p[1]::DOUBLE * (CASE WHEN q.vec_id % 4 = 0 THEN 0.0::DOUBLE ELSE 0.1::DOUBLE END) + p[2]::DOUBLE * 0.1::DOUBLE)::FLOAT) AS query_vector
FROM {query_texts_v} q JOIN {embeddings} e ON q.vec_id = e.vec_id"""),
    # A user turn as the query and the turn after it as the symbol text.
    "turn_pairs_v": """
SELECT q.conv_id, q.turn, q.text, a.text AS body, concat(a.role, '/turn_', CAST(a.turn AS string), '.txt') AS path
FROM {conversations} q JOIN {conversations} a ON q.conv_id = a.conv_id AND q.turn + 1 = a.turn""",
    # Raw files: text, web pages, and bytes that are no text.
    "raw_files_v": (
        """SELECT concat(source, '/', CASE WHEN doc_id % 9 = 0 THEN 'README.md' ELSE concat('doc_', CAST(doc_id AS string), '.txt') END) AS path,
       CAST(text AS binary) AS content FROM {documents}
UNION ALL SELECT concat('web/', CAST(page_id AS string), '.html'), CAST(html AS binary) FROM {pages}
UNION ALL SELECT concat('blob/', CAST(vec_id AS string), '.bin'), unhex(md5(CAST(vec_id AS string))) FROM {embeddings}
UNION ALL SELECT concat('note/', CAST(conv_id AS string), '_', CAST(turn AS string)),
       CAST(concat(CASE WHEN turn % 2 = 0 THEN repeat(chr(2), CAST(turn AS int) * 8 + 1) ELSE '' END, text) AS binary) FROM {conversations}""",
        """SELECT concat(source, '/', CASE WHEN doc_id % 9 = 0 THEN 'README.md' ELSE concat('doc_', CAST(doc_id AS string), '.txt') END) AS path,
       encode(text) AS content FROM {documents}
UNION ALL SELECT concat('web/', CAST(page_id AS string), '.html'), encode(html) FROM {pages}
UNION ALL SELECT concat('blob/', CAST(vec_id AS string), '.bin'), unhex(md5(CAST(vec_id AS string))) FROM {embeddings}
UNION ALL SELECT concat('note/', CAST(conv_id AS string), '_', CAST(turn AS string)),
       encode(concat(CASE WHEN turn % 2 = 0 THEN repeat(chr(2), CAST(turn AS int) * 8 + 1) ELSE '' END, text)) FROM {conversations}"""),
    # Paths as they come: symbols, urls, and awkward names made from rows.
    "paths_v": """
SELECT path FROM {symbols_v}
UNION ALL SELECT concat('./', path) FROM {symbols_v}
UNION ALL SELECT regexp_replace(url, '^https?://', '') FROM {pages}
UNION ALL SELECT concat(CASE CAST(s_suppkey % 8 AS int) WHEN 0 THEN '.git/' WHEN 1 THEN '.semsearch/' WHEN 2 THEN 'docs/Readme.' WHEN 3 THEN 'README'
         WHEN 4 THEN 'src/readme/' WHEN 5 THEN 'pkg/readme_' WHEN 6 THEN 'a/.git/' ELSE 'build/' END,
       CASE WHEN s_suppkey % 8 = 3 THEN '' ELSE CAST(s_suppkey AS string) END) FROM {supplier}
UNION ALL SELECT concat(CASE WHEN c_custkey % 2 = 0 THEN '/data/repo/' ELSE '/etc/' END, 'x/../', CAST(c_custkey AS string), '//f.go') FROM {customer}""",
    # Files whose lines hold search and context directives.
    "marked_files_v": (
        """SELECT concat(source, '/doc_', CAST(doc_id AS string), CASE WHEN doc_id % 5 = 0 THEN '.sql' ELSE '.txt' END) AS path,
 array_join(transform(split(text, '\\n', -1), (x, i) ->
 CASE WHEN (i + 1) % 5 = 1 THEN concat('// @search: ', x) WHEN (i + 1) % 5 = 3 THEN concat('# @filectx ', x, ' */')
      WHEN (i + 1) % 5 = 4 THEN concat('  -- ', x) ELSE x END), chr(10)) AS content FROM {documents}""",
        """SELECT concat(source, '/doc_', CAST(doc_id AS string), CASE WHEN doc_id % 5 = 0 THEN '.sql' ELSE '.txt' END) AS path,
 array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
 CASE WHEN i % 5 = 1 THEN concat('// @search: ', x) WHEN i % 5 = 3 THEN concat('# @filectx ', x, ' */')
      WHEN i % 5 = 4 THEN concat('  -- ', x) ELSE x END), chr(10)) AS content FROM {documents}"""),
    # Lines that look like comments of several languages.
    "comment_lines_v": """
SELECT conv_id, turn, concat(CASE CAST(turn % 6 AS int) WHEN 0 THEN '/// ' WHEN 1 THEN '/** ' WHEN 2 THEN '# ' WHEN 3 THEN '//! ' WHEN 4 THEN ' * ' ELSE '// ' END,
       text, CASE WHEN turn % 2 = 1 THEN ' */' ELSE '' END) AS text, CAST(turn % 6 AS int) AS style FROM {conversations}""",
    # One small source file per part and language.
    "source_files_v": """
SELECT concat('go/p', CAST(p_partkey AS string), '.go') AS path,
       concat('// Catalogue of ', p_type, '.', chr(10), 'package parts', chr(10), chr(10), '// ', p_name, chr(10),
              'type Part', CAST(p_partkey AS string), ' struct {{', chr(10), '  Size int', chr(10), '}}', chr(10), chr(10),
              '// Size tells ', p_brand, '.', chr(10), 'func (p *Part', CAST(p_partkey AS string), ') SizeOf() int {{', chr(10),
              '  return ', CAST(p_size AS string), chr(10), '}}', chr(10)) AS content FROM {part}
UNION ALL
SELECT concat('py/p', CAST(p_partkey AS string), '.py'),
       concat('class Part', CAST(p_partkey AS string), ':', chr(10), '    \"\"\"', p_name, '\"\"\"', chr(10), chr(10),
              '    # ', p_brand, chr(10), '    def size(self):', chr(10), '        return ', CAST(p_size AS string), chr(10), chr(10),
              'LIMIT = ', CAST(p_size AS string), chr(10)) FROM {part}
UNION ALL
SELECT concat('rs/p', CAST(p_partkey AS string), '.rs'),
       concat('/// ', p_name, chr(10), 'pub struct Part', CAST(p_partkey AS string), ' {{', chr(10), '    size: usize,', chr(10), '}}', chr(10), chr(10),
              'impl Part', CAST(p_partkey AS string), ' {{', chr(10), '    /// ', p_brand, chr(10), '    pub fn size(&self) -> usize {{', chr(10),
              '        self.size', chr(10), '    }}', chr(10), '}}', chr(10)) FROM {part}
UNION ALL
SELECT concat('ts/p', CAST(p_partkey AS string), '.ts'),
       concat('/** ', p_name, ' */', chr(10), 'export class Part', CAST(p_partkey AS string), ' {{', chr(10), '  // ', p_brand, chr(10),
              '  size(): number {{ return ', CAST(p_size AS string), ' }}', chr(10), '}}', chr(10), chr(10),
              'export const limit = ', CAST(p_size AS string), ';', chr(10)) FROM {part}""",
    # Files of all shapes of code, some of which do not parse.
    "shape_files_v": shapes.files_sql(),
    # Two file-hash states: the listing, and what an earlier run saw.
    "files_v": "SELECT concat(source, '/doc_', CAST(doc_id AS string)) AS path, md5(text) AS content_hash FROM {documents}",
    "prev_files_v": """
SELECT concat(d.source, '/doc_', CAST(d.doc_id AS string)) AS path,
       CASE WHEN l.quality = 0 THEN md5(concat(d.text, 'x')) ELSE md5(d.text) END AS content_hash
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id
UNION ALL SELECT concat('web/page_', CAST(page_id AS string)), md5(html) FROM {pages}""",
    # Index tables: one model per language, three snapshots each.
    "snapshot_symbols_v": """
SELECT CAST(doc_id % 3 + 1 + CASE lang WHEN 'de' THEN 3 WHEN 'es' THEN 6 WHEN 'fr' THEN 9 ELSE 0 END AS bigint) AS snapshot_id,
       'local' AS provider, lang AS model_id, concat(source, '/doc_', CAST(doc_id AS string)) AS path,
       CAST(doc_id % 50 + 1 AS int) AS line, md5(concat('sym|', CAST(doc_id AS string))) AS symbol_id,
       'text' AS kind, regexp_extract(text, '[A-Za-z]+', 0) AS name, source AS container,
       concat(source, '.', regexp_extract(text, '[A-Za-z]+', 0)) AS qualified_name,
       split_part(text, chr(10), 1) AS signature, split_part(text, chr(10), 2) AS documentation, text AS body,
       md5(concat('doc|', CAST(doc_id AS string))) AS embedding_hash FROM {documents}""",
    "pointers_v": """
SELECT provider, model_id, max(snapshot_id) AS snapshot_id FROM {snapshot_symbols_v} WHERE model_id <> 'fr' GROUP BY provider, model_id""",
    "snapshots_v": "SELECT DISTINCT snapshot_id, provider, model_id FROM {snapshot_symbols_v}",
    "model_embeddings_v": """
SELECT 'local' AS provider, d.lang AS model_id, md5(concat('doc|', CAST(e.vec_id AS string))) AS embedding_hash, 64 AS dim, e.embedding
FROM {embeddings} e JOIN {documents} d ON e.vec_id = d.doc_id""",
    "hash_states_v": """
SELECT DISTINCT snapshot_id AS state_version, provider, model_id, concat('fp-', model_id) AS scanner_fingerprint FROM {snapshot_symbols_v}""",
    "state_pointers_v": "SELECT provider, model_id, snapshot_id AS state_version FROM {pointers_v}",
    "state_files_v": "SELECT snapshot_id AS state_version, path, md5(body) AS content_hash FROM {snapshot_symbols_v}",
    # Runs, hits and labels of an evaluation.
    "runs_v": """
SELECT event_id, concat('repo', CAST(user_id % 8 AS string)) AS repo, concat('q', CAST(user_id AS string)) AS query_id,
       CASE event_type WHEN 'signup' THEN 'cold_index' WHEN 'view' THEN 'warm_index' ELSE 'warm_search' END AS run_kind,
       CASE event_type WHEN 'click' THEN 'auto' WHEN 'error' THEN ' Semantic' WHEN 'view' THEN '' ELSE 'lexical' END AS mode,
       value AS duration_ms,
       CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 90 END AS int) AS indexed_symbols,
       CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 9 END AS int) AS indexed_files
FROM {events}""",
    # Repositories share query ids.
    "hits_v": """
SELECT concat('q', CAST(user_id % 37 AS string)) AS query_id, concat('repo', CAST(user_id % 8 AS string)) AS repo,
       CAST(event_id % 3 AS int) AS run, CAST(CAST(regexp_extract(props, '[0-9]+', 0) AS int) % 12 + 1 AS int) AS rank,
       concat('f', CAST(event_id % 20 AS string), '.txt') AS path, CAST(event_id % 7 + 1 AS int) AS line FROM {events}""",
    "labels_v": """
SELECT DISTINCT concat('q', CAST(user_id % 37 AS string)) AS query_id, concat('repo', CAST(user_id % 8 AS string)) AS repo,
       concat('f', CAST(user_id % 20 AS string), '.txt:', CAST(user_id % 7 + 1 AS string)) AS expected_ref FROM {events}
UNION SELECT concat('q', CAST(user_id % 37 AS string)), concat('repo', CAST(user_id % 8 AS string)),
       concat('f', CAST(user_id % 5 AS string), '.txt:', CAST(user_id % 7 + 1 AS string)) FROM {events}""",
    "suite_queries_v": """
SELECT concat('suite', CAST(user_id % 3 AS string)) AS suite_id, concat('repo', CAST(user_id % 8 AS string)) AS repo, query_id, mode
FROM (SELECT user_id, concat('q', CAST(user_id AS string)) AS query_id,
      min(CASE event_type WHEN 'click' THEN 'auto' WHEN 'error' THEN ' Semantic' WHEN 'view' THEN 'LEXICAL' ELSE 'other' END) AS mode
      FROM {events} GROUP BY user_id)""",
    # Suite rows with all kinds of mistakes.
    "suite_rows_v": (
        """SELECT CASE WHEN s_nationkey = 0 THEN ' ' ELSE concat('suite', CAST(s_nationkey AS string)) END AS suite_id,
       CAST(s_nationkey % 4 AS int) AS suite_version, CASE WHEN s_nationkey % 5 = 1 THEN '' ELSE concat('Suite ', CAST(s_nationkey AS string)) END AS suite_name,
       CAST(s_suppkey AS int) AS repo_at, CASE WHEN s_suppkey % 10 = 3 THEN ' same ' WHEN s_suppkey % 10 = 4 THEN '' ELSE s_name END AS repo,
       CASE WHEN s_suppkey % 6 = 1 THEN ' ' ELSE 'https://example.com/r.git' END AS url,
       CASE WHEN s_suppkey % 4 = 2 THEN md5(s_name) ELSE concat(md5(s_name), '01234567') END AS commit,
       CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE 'go' END AS language,
       CAST(conv_id * 100 + turn AS int) AS query_at, CASE WHEN turn = 2 THEN 'twice' WHEN turn = 3 THEN '' ELSE concat('c', CAST(conv_id AS string), '-', CAST(turn AS string)) END AS query_id,
       CASE WHEN turn = 1 AND conv_id % 2 = 0 THEN '  ' ELSE text END AS text, role AS mode,
       CASE CAST(turn % 3 AS int) WHEN 0 THEN array('a.go:1', ' b.go:2') WHEN 1 THEN array('a.go') ELSE CAST(array() AS array<string>) END AS expected_hits
FROM {supplier} LEFT JOIN {conversations} ON s_suppkey = conv_id""",
        """SELECT CASE WHEN s_nationkey = 0 THEN ' ' ELSE concat('suite', CAST(s_nationkey AS string)) END AS suite_id,
       CAST(s_nationkey % 4 AS int) AS suite_version, CASE WHEN s_nationkey % 5 = 1 THEN '' ELSE concat('Suite ', CAST(s_nationkey AS string)) END AS suite_name,
       CAST(s_suppkey AS int) AS repo_at, CASE WHEN s_suppkey % 10 = 3 THEN ' same ' WHEN s_suppkey % 10 = 4 THEN '' ELSE s_name END AS repo,
       CASE WHEN s_suppkey % 6 = 1 THEN ' ' ELSE 'https://example.com/r.git' END AS url,
       CASE WHEN s_suppkey % 4 = 2 THEN md5(s_name) ELSE concat(md5(s_name), '01234567') END AS commit,
       CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE 'go' END AS language,
       CAST(conv_id * 100 + turn AS int) AS query_at, CASE WHEN turn = 2 THEN 'twice' WHEN turn = 3 THEN '' ELSE concat('c', CAST(conv_id AS string), '-', CAST(turn AS string)) END AS query_id,
       CASE WHEN turn = 1 AND conv_id % 2 = 0 THEN '  ' ELSE text END AS text, role AS mode,
       CASE CAST(turn % 3 AS int) WHEN 0 THEN ['a.go:1', ' b.go:2'] WHEN 1 THEN ['a.go'] ELSE CAST([] AS varchar[]) END AS expected_hits
FROM {supplier} LEFT JOIN {conversations} ON s_suppkey = conv_id"""),
    # One benchmark report per supplier.
    "reports_v": """
SELECT s_name AS report, CASE CAST(s_nationkey % 4 AS int) WHEN 0 THEN 'windows' WHEN 1 THEN 'darwin' WHEN 2 THEN 'linux' ELSE 'freebsd' END AS os,
       CASE WHEN s_suppkey % 2 = 0 THEN 'arm64' ELSE 'amd64' END AS arch,
       CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE concat('cpu ', CAST(s_nationkey AS string)) END AS cpu_info,
       concat('v0.', CAST(s_nationkey AS string)) AS tool_version, CAST(s_nationkey AS int) AS repository_count,
       CAST(s_suppkey AS int) AS query_count, CAST(s_suppkey % 5 AS int) AS n_lexical, CAST(s_suppkey % 7 AS int) AS n_auto,
       abs(s_acctbal) AS cold_index_mean_ms, abs(s_acctbal) / 3 AS warm_index_mean_ms, abs(s_acctbal) / 7 AS warm_search_mean_ms,
       CAST(s_suppkey % 101 AS int) AS quality_score, concat('suite', CAST(s_nationkey % 3 AS string)) AS suite_name,
       md5(CAST(s_nationkey % 3 AS string)) AS suite_revision FROM {supplier}""",
    # Manifests of one repository per customer, here and as published.
    "manifests_v": """
SELECT c_name AS repo, CAST(c_nationkey % 4 AS bigint) AS version, md5(concat('h', CAST(c_nationkey % 4 AS string))) AS indexing_hash,
       CASE WHEN c_custkey % 5 = 0 THEN 'local' WHEN c_custkey % 5 = 1 THEN ' Remote ' ELSE 'remote' END AS source,
       CAST(CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE 1 END AS int) AS schema_version,
       CASE WHEN c_custkey % 7 = 0 THEN ' ' WHEN c_custkey % 7 = 1 THEN concat(' https://ci/', c_name) ELSE concat('https://ci/', c_name) END AS ci_url,
       c_custkey % 11 <> 0 AS has_index FROM {customer}""",
    "published_v": """
SELECT c_name AS repo, CAST(CASE WHEN c_custkey % 4 = 0 THEN c_nationkey % 4 + 1 ELSE c_nationkey % 4 END AS bigint) AS version,
       concat(CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE '' END, md5(concat('h', CAST(c_nationkey % 4 AS string)))) AS indexing_hash,
       CAST(CASE WHEN c_custkey % 13 = 0 THEN 2 ELSE 1 END AS int) AS schema_version,
       CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 6 = 1 THEN ' ' WHEN c_custkey % 6 = 2 THEN 'https://ci/moved' ELSE concat('https://ci/', c_name, ' ') END AS ci_url
       FROM {customer} WHERE c_acctbal > 0""",
    # Logs as text.
    "hit_logs_v": """
SELECT event_id AS run, CASE event_type WHEN 'error' THEN 'No matches found' WHEN 'signup' THEN concat('strange ', props)
         ELSE concat('Loaded model', chr(10), ' ', CAST(event_id % 12 + 1 AS string), '. dir ', CAST(event_id % 5 AS string), '/f:', CAST(user_id AS string), '.txt:',
                     CAST(event_id % 7 + 1 AS string), '  ', CAST(value AS string), chr(10), '13. last.go:', CAST(user_id AS string), '  lexical', chr(10)) END AS stdout
FROM {events}""",
    "index_logs_v": """
SELECT event_id AS run, CASE event_type WHEN 'error' THEN 'fatal: no' WHEN 'view' THEN concat('Loaded', chr(10), 'Index already up to date', chr(10))
         ELSE concat('Loaded model', chr(10), 'Indexed ', CAST(user_id AS string), ' symbols in  ', CAST(event_id % 40 AS string), ' files', chr(10)) END AS stdout
FROM {events}""",
    # Model names, modes and providers in many spellings.
    "model_names_v": """
SELECT p_partkey, CASE CAST(p_partkey % 10 AS int) WHEN 0 THEN 'Embedding_Gemma-300m' WHEN 1 THEN concat('/models/', p_name, '/Qwen3-Embedding-0.6B-Q8_0.gguf')
         WHEN 2 THEN 'qwen 3' WHEN 3 THEN concat('google/', 'gemma-', CAST(p_size AS string)) WHEN 4 THEN concat(' ', p_brand) WHEN 5 THEN 'DEFAULT'
         WHEN 6 THEN concat('qwen3/embed/', p_name) WHEN 7 THEN 'qwen3embedding' WHEN 8 THEN '/m/embeddinggemma-300m.gguf' ELSE p_type END AS model,
       CASE CAST(p_partkey % 6 AS int) WHEN 0 THEN '' WHEN 1 THEN ' AUTO ' WHEN 2 THEN 'SeMaNtIc' WHEN 3 THEN 'lexical' ELSE p_type END AS mode,
       CASE CAST(p_partkey % 7 AS int) WHEN 0 THEN '' WHEN 1 THEN 'LLAMA' WHEN 2 THEN ' llama.cpp' WHEN 3 THEN 'LlamaCpp' WHEN 4 THEN 'OpenRouter' ELSE p_brand END AS provider
FROM {part}""",
    # String literals as they stand in source code.
    "literals_v": """
SELECT conv_id, turn, CASE CAST(turn % 5 AS int) WHEN 0 THEN concat('\"\"\"', text, chr(10), '   tail\"\"\"') WHEN 1 THEN concat(chr(39), chr(39), chr(39), ' ', text, chr(39), chr(39), chr(39))
         WHEN 2 THEN concat('\"', text, '\"') WHEN 3 THEN concat(chr(39), text, chr(39)) ELSE concat('\"', text) END AS literal FROM {conversations}""",
}


#: Views that make files of each row of a table: its rows go to all tasks first.
FILE_VIEWS = ("source_files_v", "shape_files_v")


def _parts(name: str, engine: int) -> tuple[str, list[str]]:
    text = VIEWS[name] if isinstance(VIEWS[name], str) else VIEWS[name][engine]
    fields = [field for _, field, _, _ in string.Formatter().parse(text) if field]
    return text, list(dict.fromkeys(fields))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a view over them, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text, fields = _parts(name, 0)
    tables = {field: view(spark, sf_dir, field) for field in fields}
    return spark.sql(text, **({field: dealt(table) for field, table in tables.items()} if name in FILE_VIEWS else tables))


def with_views(query: str, *names: str) -> str:
    """DuckDB text of ``query`` with the named views in front of it."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in TABLES or name in ordered:
            return
        for field in _parts(name, 1)[1]:
            add(field)
        ordered.append(name)

    for name in names:
        add(name)
    views = []
    for name in ordered:
        text, fields = _parts(name, 1)
        views.append(f"{name} AS ({text.format(**{field: field for field in fields})})")
    body = query.strip()
    if not views:
        return body
    return "WITH " + ",\n".join(views) + (",\n" + body[5:] if body.upper().startswith("WITH ") else "\n" + body)
