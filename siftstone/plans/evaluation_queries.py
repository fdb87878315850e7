"""Checked queries of scoring and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schemas
from ..functions import metrics as M
from ..operators import evaluate as V
from ..session import scratch_dir
from ..sources import suites as suites_source
from . import workflows
from .views import view, with_views


def _scored(spark, sf):
    return V.score_queries(view(spark, sf, "labels_v"), view(spark, sf, "hits_v").filter("run = 0"))


def score_queries(spark, sf):
    return _scored(spark, sf).withColumn("rr", F.round("rr", 9))


def _rounded(df):
    return df.withColumns({name: F.round(name, 9) for name in ("top1", "top3", "mrr")})


def aggregate_quality(spark, sf):
    return _rounded(V.aggregate_quality(_scored(spark, sf)))


def quality_rollup(spark, sf):
    return _rounded(V.quality_rollup(_scored(spark, sf)))


def timing_means(spark, sf):
    means = V.timing_means(view(spark, sf, "runs_v"))
    return means.withColumns({name: F.round(name, 9) for name in means.columns if name.endswith("_ms")})


def _flat_modes(df, *keys, column="modes"):
    return df.select(*keys, M.format_mode_counts(F.col(column)).alias(column))


def mode_counts(spark, sf):
    return _flat_modes(V.mode_counts(view(spark, sf, "suite_queries_v")), "repo")


def latest_index_run(spark, sf):
    return V.latest_index_run(view(spark, sf, "runs_v").withColumn("run_no", F.col("event_id")))


def first_top_hit(spark, sf):
    hits = view(spark, sf, "hits_v")
    return V.first_top_hit(hits.groupBy("repo", "query_id").agg((F.min("run") + F.max("line") % 2).alias("first_run")), hits)


def ranking_misses(spark, sf):
    misses = V.ranking_misses(_scored(spark, sf)).select("repo", "query_id", "top3_success", "observed_rank")
    hits = view(spark, sf, "hits_v")
    first = V.first_top_hit(hits.select("repo", "query_id").distinct().withColumn("first_run", F.lit(0)), hits)
    labels = view(spark, sf, "labels_v").groupBy("repo", "query_id").agg(F.array_join(F.array_sort(F.collect_set("expected_ref")), ", ").alias("expected"))
    return misses.join(first, V.QUERY).join(labels, V.QUERY).select(
        "repo", "query_id", "expected", V.top_hit_text(F.col("path"), F.col("line"), F.col("observed_rank")).alias("got"),
        F.when(F.col("top3_success"), "yes").otherwise("no").alias("top3"))


def miss_report(spark, sf):
    misses = V.ranking_misses(_scored(spark, sf)).select("repo", "query_id", "observed_rank")
    return V.miss_report(misses, ["repo", "query_id"])


def slowest_queries(spark, sf):
    return V.slowest_queries(V.query_search_means(view(spark, sf, "runs_v")).withColumn(
        "warm_search_mean_ms", F.round("warm_search_mean_ms", 9)))


def matrix_summary(spark, sf):
    counts = F.map_filter(F.map_from_arrays(F.array(F.lit("lexical"), F.lit("auto")), F.array("n_lexical", "n_auto")), lambda k, v: v > 0)
    reports = view(spark, sf, "reports_v").withColumn("mode_counts", counts)
    return V.matrix_summary(reports)


def matrix_header(spark, sf):
    return V.matrix_header(view(spark, sf, "reports_v"))


def suite_coverage(spark, sf):
    return _flat_modes(V.suite_coverage(view(spark, sf, "suite_queries_v")), "suite_id", "repository_count", "query_count", column="mode_counts")


def validate_suite(spark, sf):
    return V.validate_suite(view(spark, sf, "suite_rows_v"))


def run_suite(spark, sf):
    return _rounded(workflows.run_suite(view(spark, sf, "labels_v"), view(spark, sf, "hits_v").filter("run = 0")))


def _tool_results(spark, sf):
    return view(spark, sf, "hits_v").withColumn("duration_ms", (F.col("run") * 10 + F.length("query_id") + F.length("repo")).cast("double"))


def tool_report(spark, sf):
    """Another tool's rows: scores of its first run and mean times of all."""
    scored, times = V.tool_report(_tool_results(spark, sf), view(spark, sf, "labels_v"))
    return scored.join(times, V.QUERY, "left").withColumns({name: F.round(name, 9) for name in ("rr", "warm_search_mean_ms")})


def suite_source(spark, sf):
    """Suites nested as their files are, read back as one row per query."""
    hits = view(spark, sf, "labels_v").groupBy("repo", "query_id").agg(F.array_sort(F.collect_list("expected_ref")).alias("expected_hits"))
    query = F.struct(F.col("query_id").alias("id"), F.concat("repo", F.lit(" "), "query_id").alias("text"), F.lit("auto").alias("mode"), "expected_hits")
    repos = hits.groupBy("repo").agg(F.array_sort(F.collect_list(query)).alias("queries"))
    repo = F.struct(F.col("repo").alias("id"), F.concat(F.lit("https://"), "repo").alias("url"), F.md5("repo").alias("commit"), F.lit("go").alias("language"), "queries")
    suites = repos.withColumn("suite_id", F.concat(F.lit("suite"), F.substring("repo", -1, 1).cast("int") % 3)).groupBy("suite_id").agg(
        F.lit(1).alias("suite_version"), F.first("suite_id").alias("name"), F.lit("").alias("description"), F.array_sort(F.collect_list(repo)).alias("repositories"))
    path = f"{scratch_dir(spark)}/suites-{uuid.uuid4().hex}"
    suites.write.json(path)
    nested = spark.read.schema(schemas.SUITE).json(path)
    return suites_source.suite_rows(nested).withColumn("expected_hits", F.concat_ws(",", "expected_hits"))


def nested_report(spark, sf):
    """The nested report written as JSON, read back and counted level by level."""
    hits = view(spark, sf, "hits_v")
    queries = view(spark, sf, "labels_v").groupBy("repo", "query_id").agg(F.array_sort(F.collect_list("expected_ref")).alias("expected_hits")).select(
        "repo", "query_id", F.col("query_id").alias("text"), F.lit("auto").alias("mode"), "expected_hits")
    searches = _tool_results(spark, sf).select("repo", "query_id", "run", "duration_ms").distinct()
    runs = view(spark, sf, "runs_v").filter("run_kind <> 'warm_search'").withColumn("run_no", F.col("event_id"))
    report = V.nested_report(queries, hits, searches, runs)
    path = f"{scratch_dir(spark)}/report-{uuid.uuid4().hex}"
    suites_source.write_report(report, path)
    back = spark.read.schema(report.schema).json(path)
    count = lambda column: F.aggregate(column, F.lit(0), lambda total, x: total + x)
    inner = F.transform("queries", lambda q: count(F.transform(q["runs"], lambda r: F.size(r["hits"]))))
    return _rounded(back.select("repo", "query_count", "top1", "top3", "mrr", "quality_score", F.size("queries").alias("queries"),
                                count(F.transform("queries", lambda q: F.size(q["runs"]))).alias("runs"), count(inner).alias("hits"),
                                F.coalesce(F.size("cold_index_runs"), F.lit(0)).alias("cold_runs"), F.round("warm_search_mean_ms", 9).alias("warm_search_mean_ms"), "last_indexed_symbols"))


_SCORED = """ranked AS (SELECT l.query_id, l.repo, coalesce(min(h.rank), 0) AS r FROM labels_v l LEFT JOIN hits_v h
 ON h.repo = l.repo AND h.query_id = l.query_id AND concat(h.path, ':', h.line) = l.expected_ref AND h.rank <= 10 AND h.run = 0 GROUP BY l.query_id, l.repo),
scored AS (SELECT query_id, repo, r = 1 AS top1_success, r BETWEEN 1 AND 3 AS top3_success, CASE WHEN r > 0 THEN 1.0::DOUBLE / r ELSE 0 END AS rr, r::INT AS observed_rank FROM ranked)"""
_QUALITY = """round(avg(top1_success::INT::DOUBLE), 9) AS top1, round(avg(top3_success::INT::DOUBLE), 9) AS top3, round(avg(rr), 9) AS mrr,
 round(round(100 * (0.5 * avg(top1_success::INT::DOUBLE) + 0.2 * avg(top3_success::INT::DOUBLE) + 0.3 * avg(rr)), 9))::INT AS quality_score"""
_LABELLED = ("labels_v", "hits_v")
_MODE = "CASE WHEN lower(trim(mode)) IN ('', 'auto') THEN 'auto' WHEN lower(trim(mode)) IN ('semantic', 'lexical') THEN lower(trim(mode)) ELSE trim(mode) END"
_MODES = "string_agg(concat(m, '=', n), ' ' ORDER BY CASE m WHEN 'auto' THEN 0 WHEN 'semantic' THEN 1 WHEN 'lexical' THEN 2 ELSE 3 END, m)"
_MS = lambda x: f"CASE WHEN {x} >= 1000 THEN printf('%.2fs', {x} / 1000) ELSE printf('%.2fms', {x}) END"

_ROLLUP = f"""WITH {_SCORED} SELECT repo, FALSE AS is_total, count(*) AS query_count, {_QUALITY} FROM scored GROUP BY repo
 UNION ALL SELECT '', TRUE, count(*), {_QUALITY} FROM scored"""

QUERIES = {
    "run_suite": (run_suite, with_views(_ROLLUP, *_LABELLED)),
    "tool_report": (tool_report, with_views(f"""WITH {_SCORED}, times AS (SELECT repo, query_id, avg(d) AS ms FROM (SELECT DISTINCT repo, query_id, run, (run * 10 + length(query_id) + length(repo))::DOUBLE AS d FROM hits_v) GROUP BY ALL)
 SELECT s.repo, s.query_id, top1_success, top3_success, round(rr, 9) AS rr, observed_rank, round(ms, 9) AS warm_search_mean_ms FROM scored s LEFT JOIN times t ON t.repo = s.repo AND t.query_id = s.query_id""", *_LABELLED)),
    "nested_report": (nested_report, with_views(f"""WITH {_SCORED.replace("AND h.run = 0", "AND h.run = (SELECT min(run) FROM hits_v f WHERE f.repo = l.repo AND f.query_id = l.query_id)")},
 s AS (SELECT DISTINCT repo, query_id, run, (run * 10 + length(query_id) + length(repo))::DOUBLE AS d FROM hits_v),
 i AS (SELECT repo, indexed_symbols, row_number() OVER (PARTITION BY repo ORDER BY (indexed_symbols > 0 OR indexed_files > 0) DESC, (run_kind = 'warm_index') DESC, event_id DESC) AS place
       FROM runs_v WHERE run_kind IN ('cold_index', 'warm_index'))
 SELECT x.repo, count(*) AS query_count, {_QUALITY}, count(*)::INT AS queries, (SELECT count(*) FROM s WHERE s.repo = x.repo)::INT AS runs, (SELECT count(*) FROM hits_v h WHERE h.repo = x.repo)::INT AS hits,
 (SELECT count(*) FROM runs_v r WHERE r.repo = x.repo AND run_kind = 'cold_index')::INT AS cold_runs, round((SELECT avg(d) FROM s WHERE s.repo = x.repo), 9) AS warm_search_mean_ms,
 (SELECT indexed_symbols FROM i WHERE i.repo = x.repo AND place = 1) AS last_indexed_symbols FROM scored x GROUP BY x.repo""", *_LABELLED, "runs_v")),
    "suite_source": (suite_source, with_views("""WITH q AS (SELECT repo, query_id, string_agg(expected_ref, ',' ORDER BY expected_ref) AS expected_hits FROM labels_v GROUP BY ALL),
 n AS (SELECT *, concat('suite', right(repo, 1)::INT % 3) AS suite_id FROM q)
 SELECT suite_id, 1::INT AS suite_version, suite_id AS suite_name, (dense_rank() OVER (PARTITION BY suite_id ORDER BY repo) - 1)::INT AS repo_at, repo, concat('https://', repo) AS url, md5(repo) AS commit, 'go' AS language,
 (row_number() OVER (PARTITION BY repo ORDER BY query_id) - 1)::INT AS query_at, query_id, concat(repo, ' ', query_id) AS text, 'auto' AS mode, expected_hits FROM n""", "labels_v")),
    "score_queries": (score_queries, with_views(f"WITH {_SCORED} SELECT query_id, repo, top1_success, top3_success, round(rr, 9) AS rr, observed_rank FROM scored", *_LABELLED)),
    "aggregate_quality": (aggregate_quality, with_views(f"WITH {_SCORED} SELECT {_QUALITY} FROM scored", *_LABELLED)),
    "quality_rollup": (quality_rollup, with_views(f"""WITH {_SCORED} SELECT repo, FALSE AS is_total, count(*) AS query_count, {_QUALITY} FROM scored GROUP BY repo
 UNION ALL SELECT '', TRUE, count(*), {_QUALITY} FROM scored""", *_LABELLED)),
    "timing_means": (timing_means, with_views("""SELECT CASE WHEN grouping(repo) = 1 THEN '' ELSE repo END AS repo, grouping(repo) = 1 AS is_total,
 round(coalesce(avg(CASE WHEN run_kind = 'cold_index' THEN duration_ms END), 0), 9) AS cold_index_mean_ms, round(coalesce(avg(CASE WHEN run_kind = 'warm_index' THEN duration_ms END), 0), 9) AS warm_index_mean_ms,
 round(coalesce(avg(CASE WHEN run_kind = 'warm_search' THEN duration_ms END), 0), 9) AS warm_search_mean_ms FROM runs_v GROUP BY GROUPING SETS ((repo), ())""", "runs_v")),
    "mode_counts": (mode_counts, with_views(f"""SELECT repo, {_MODES} AS modes FROM (SELECT repo, {_MODE} AS m, count(*) AS n FROM suite_queries_v GROUP BY ALL
 UNION ALL SELECT '', {_MODE}, count(*) FROM suite_queries_v GROUP BY ALL) GROUP BY repo""", "suite_queries_v")),
    "latest_index_run": (latest_index_run, with_views("""SELECT repo, run_kind, event_id AS run_no, indexed_symbols, indexed_files FROM (SELECT *, row_number() OVER (PARTITION BY repo
 ORDER BY (indexed_symbols > 0 OR indexed_files > 0) DESC, (run_kind = 'warm_index') DESC, event_id DESC) AS place FROM runs_v WHERE run_kind IN ('cold_index', 'warm_index')) WHERE place = 1""", "runs_v")),
    "first_top_hit": (first_top_hit, with_views("""SELECT q.repo, q.query_id, h.path, h.line FROM (SELECT repo, query_id, min(run) + max(line) % 2 AS first_run FROM hits_v GROUP BY ALL) q
 LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY repo, query_id, run ORDER BY rank, path, line) AS at FROM hits_v) h ON h.repo = q.repo AND h.query_id = q.query_id AND h.run = q.first_run AND h.at = 1""", "hits_v")),
    "ranking_misses": (ranking_misses, with_views(f"""WITH {_SCORED}, tops AS (SELECT *, row_number() OVER (PARTITION BY repo, query_id ORDER BY rank, path, line) AS at FROM hits_v WHERE run = 0),
 wanted AS (SELECT repo, query_id, string_agg(DISTINCT expected_ref, ', ' ORDER BY expected_ref) AS expected FROM labels_v GROUP BY ALL)
 SELECT s.repo, s.query_id, w.expected, CASE WHEN t.path IS NULL THEN 'no hits' WHEN observed_rank > 0 THEN concat(t.path, ':', t.line, ' @ rank ', observed_rank) ELSE concat(t.path, ':', t.line) END AS got,
 CASE WHEN top3_success THEN 'yes' ELSE 'no' END AS top3 FROM scored s JOIN wanted w ON s.repo = w.repo AND s.query_id = w.query_id LEFT JOIN tops t ON t.repo = s.repo AND t.query_id = s.query_id AND t.at = 1 WHERE NOT top1_success""", *_LABELLED)),
    "miss_report": (miss_report, with_views(f"""WITH {_SCORED} SELECT repo, query_id, observed_rank, greatest((SELECT count(*) FROM scored WHERE NOT top1_success) - 10, 0) AS more_omitted
 FROM scored WHERE NOT top1_success ORDER BY repo, query_id LIMIT 10""", *_LABELLED)),
    "slowest_queries": (slowest_queries, with_views("""SELECT repo, query_id, round(avg(duration_ms), 9) AS warm_search_mean_ms FROM runs_v WHERE run_kind = 'warm_search'
 GROUP BY repo, query_id ORDER BY 3 DESC, 1, 2 LIMIT 10""", "runs_v")),
    "matrix_summary": (matrix_summary, with_views(f"""SELECT concat(os, '/', arch) AS platform, CASE WHEN cpu_info = '' THEN 'unknown CPU' ELSE cpu_info END AS cpu, tool_version AS tool, repository_count AS repos, query_count AS queries,
 CASE WHEN n_auto = 0 AND n_lexical = 0 THEN 'none' ELSE trim(concat(CASE WHEN n_auto > 0 THEN concat('auto=', n_auto, ' ') ELSE '' END, CASE WHEN n_lexical > 0 THEN concat('lexical=', n_lexical) ELSE '' END)) END AS modes,
 {_MS('cold_index_mean_ms')} AS cold_index, {_MS('warm_index_mean_ms')} AS warm_index, {_MS('warm_search_mean_ms')} AS warm_search, quality_score AS score FROM reports_v""", "reports_v")),
    "matrix_header": (matrix_header, with_views("""SELECT string_agg(DISTINCT suite_name, ', ' ORDER BY suite_name) AS suite_name, string_agg(DISTINCT suite_revision, ', ' ORDER BY suite_revision) AS suite_revision,
 count(*) AS platforms FROM reports_v""", "reports_v")),
    "suite_coverage": (suite_coverage, with_views(f"""SELECT suite_id, (SELECT count(DISTINCT repo) FROM suite_queries_v x WHERE x.suite_id = g.suite_id) AS repository_count, sum(n)::BIGINT AS query_count, {_MODES} AS mode_counts
 FROM (SELECT suite_id, {_MODE} AS m, count(*) AS n FROM suite_queries_v GROUP BY ALL) g GROUP BY suite_id""", "suite_queries_v")),
    "validate_suite": (validate_suite, with_views(r"""WITH r AS (SELECT *, trim(coalesce(repo, '')) AS rid, trim(coalesce(query_id, '')) AS qid FROM suite_rows_v), q AS (SELECT * FROM r WHERE query_at IS NOT NULL),
 s AS (SELECT DISTINCT suite_id, suite_version, suite_name FROM r), p AS (SELECT suite_id, repo_at, repo, rid, url, commit, language, count(query_at) AS n FROM r GROUP BY ALL)
 SELECT suite_id, '' AS repo, '' AS query_id, 'suite id is required' AS violation FROM s WHERE trim(suite_id) = ''
 UNION ALL SELECT suite_id, '', '', 'suite version must be greater than zero' FROM s WHERE suite_version <= 0
 UNION ALL SELECT suite_id, '', '', 'suite name is required' FROM s WHERE trim(suite_name) = ''
 UNION ALL SELECT suite_id, repo, '', 'repository has empty id' FROM p WHERE rid = ''
 UNION ALL SELECT suite_id, repo, '', 'repository has empty url' FROM p WHERE trim(url) = ''
 UNION ALL SELECT suite_id, repo, '', 'repository must pin a 40-character commit sha' FROM p WHERE NOT regexp_full_match(trim(commit), '[a-f0-9]{40}')
 UNION ALL SELECT suite_id, repo, '', 'repository has empty language' FROM p WHERE trim(language) = ''
 UNION ALL SELECT suite_id, repo, '', 'repository must define at least one query' FROM p WHERE n = 0
 UNION ALL SELECT suite_id, repo, query_id, 'query has empty id' FROM q WHERE qid = ''
 UNION ALL SELECT suite_id, repo, query_id, 'query has empty text' FROM q WHERE trim(text) = ''
 UNION ALL SELECT suite_id, repo, query_id, 'query has unknown mode' FROM q WHERE lower(trim(mode)) NOT IN ('', 'auto', 'semantic', 'lexical')
 UNION ALL SELECT suite_id, repo, query_id, 'query must define at least one expected hit' FROM q WHERE len(expected_hits) = 0
 UNION ALL SELECT suite_id, repo, query_id, 'query has an invalid expected hit' FROM q WHERE len(list_filter(expected_hits, lambda h: NOT contains(h, ':'))) > 0
 UNION ALL SELECT suite_id, rid, '', 'repository is duplicated' FROM p WHERE rid <> '' GROUP BY suite_id, rid HAVING count(*) > 1
 UNION ALL SELECT suite_id, repo, qid, 'query is duplicated' FROM q WHERE qid <> '' GROUP BY suite_id, repo_at, repo, qid HAVING count(*) > 1""", "suite_rows_v")),
}
