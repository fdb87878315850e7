"""Scoring of ranked hits against labelled suites, and the report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, metrics
from ..functions.documents import normalize_mode
from ..functions.text import trim_space


#: Query ids are unique within a repository only.
QUERY = ["repo", "query_id"]


def score_queries(expected: DataFrame, hits: DataFrame) -> DataFrame:
    """Metrics per query from ``expected(repo, query_id, expected_ref)`` and
    ``hits(repo, query_id, rank, path, line)``: the best expected hit up to rank 10."""
    refs = hits.filter(F.col("rank") <= fixed.MAX_SCORED_RANK).select(
        *QUERY, "rank", metrics.hit_ref(F.col("path"), F.col("line")).alias("expected_ref"))
    # Ranks are reduced per query and reference before they meet the labels.
    best = refs.groupBy(*QUERY, "expected_ref").agg(F.min("rank").alias("rank"))
    scored = expected.join(best, [*QUERY, "expected_ref"], "left").groupBy(*QUERY).agg(F.min("rank").alias("rank"))
    rank = F.coalesce(F.col("rank"), F.lit(0))
    return scored.select(
        *QUERY, (rank == 1).alias("top1_success"), ((rank > 0) & (rank <= 3)).alias("top3_success"),
        F.when(rank > 0, 1.0 / rank).otherwise(0.0).alias("rr"), rank.cast("int").alias("observed_rank"))


def _quality() -> list[Column]:
    top1, top3, mrr = (F.coalesce(F.avg(c), F.lit(0.0)) for c in (
        F.col("top1_success").cast("double"), F.col("top3_success").cast("double"), F.col("rr")))
    return [top1.alias("top1"), top3.alias("top3"), mrr.alias("mrr"), metrics.quality_score(top1, top3, mrr).alias("quality_score")]


def aggregate_quality(scored: DataFrame) -> DataFrame:
    return scored.agg(*_quality())


def quality_rollup(scored: DataFrame) -> DataFrame:
    """Quality per ``repo`` and, with an empty ``repo``, over all queries."""
    total = F.grouping("repo") == 1
    return scored.rollup("repo").agg(F.count(F.lit(1)).alias("query_count"), *_quality(), total.alias("is_total")).select(
        F.when(F.col("is_total"), "").otherwise(F.col("repo")).alias("repo"), "is_total", "query_count",
        "top1", "top3", "mrr", "quality_score")


def timing_means(runs: DataFrame) -> DataFrame:
    """Mean duration per run kind, for each ``repo`` and pooled over all."""
    def mean(kind: str) -> Column:
        return F.coalesce(F.avg(F.when(F.col("run_kind") == kind, F.col("duration_ms"))), F.lit(0.0)).alias(f"{kind}_mean_ms")

    total = F.grouping("repo") == 1
    return runs.rollup("repo").agg(total.alias("is_total"), *[mean(kind) for kind in ("cold_index", "warm_index", "warm_search")]).select(
        F.when(F.col("is_total"), "").otherwise(F.col("repo")).alias("repo"), "is_total",
        "cold_index_mean_ms", "warm_index_mean_ms", "warm_search_mean_ms")


def query_mode(mode: Column) -> Column:
    """Normalised mode; an unknown one is kept as it was written."""
    return F.coalesce(normalize_mode(mode), trim_space(mode))


def mode_counts(queries: DataFrame) -> DataFrame:
    """``repo, modes`` with a map of query counts by mode; '' is the total.

    Counts are reduced by repository and mode first, so the map is built from
    a handful of rows per repository.
    """
    counted = queries.groupBy("repo", query_mode(F.col("mode")).alias("mode")).count()
    totals = counted.groupBy("mode").agg(F.sum("count").alias("count")).select(F.lit("").alias("repo"), "mode", "count")
    return counted.unionByName(totals).groupBy("repo").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("mode", "count")))).alias("modes"))


def latest_index_run(runs: DataFrame) -> DataFrame:
    """The run a report shows per ``repo``: the last warm run that indexed
    something, else such a cold run, else the last warm, else the last cold.

    Expects ``repo, run_kind, run_no, indexed_symbols, indexed_files``.
    """
    counted = (F.col("indexed_symbols") > 0) | (F.col("indexed_files") > 0)
    warm = F.col("run_kind") == "warm_index"
    choice = F.struct(counted.cast("int").alias("counted"), warm.cast("int").alias("warm"), "run_no",
                      "indexed_symbols", "indexed_files", "run_kind")
    return runs.filter(F.col("run_kind").isin("cold_index", "warm_index")).groupBy("repo").agg(F.max(choice).alias("run")).select(
        "repo", "run.run_kind", "run.run_no", "run.indexed_symbols", "run.indexed_files")


def first_top_hit(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """First hit of a query's first run, null where that run has none.

    ``queries`` hold ``repo, query_id, first_run``; ``hits`` hold ``run`` as well.
    """
    best = hits.groupBy(*QUERY, "run").agg(F.min(F.struct("rank", "path", "line")).alias("hit"))
    return queries.join(best.withColumnRenamed("run", "first_run"), [*QUERY, "first_run"], "left").select(
        *QUERY, F.col("hit.path").alias("path"), F.col("hit.line").alias("line"))


def ranking_misses(scored: DataFrame) -> DataFrame:
    """All queries whose first hit is not an expected one."""
    return scored.filter(~F.col("top1_success"))


def top_hit_text(path: Column, line: Column, observed_rank: Column) -> Column:
    ref = F.concat(path, F.lit(":"), line.cast("string"))
    return F.when(path.isNull(), "no hits").when(
        observed_rank > 0, F.concat(ref, F.lit(" @ rank "), observed_rank.cast("string"))).otherwise(ref)


def miss_report(misses: DataFrame, order: list[str], rows: int = fixed.REPORT_ROWS) -> DataFrame:
    """The first misses of the text report, and how many more there are."""
    total = misses.agg(F.count(F.lit(1)).alias("n"))
    shown = misses.orderBy(*order).limit(rows)
    return shown.withColumn("more_omitted", F.greatest(total.scalar() - rows, F.lit(0)).cast("long"))


def query_search_means(runs: DataFrame) -> DataFrame:
    """Mean search time of each ``repo, query_id``."""
    return runs.filter(F.col("run_kind") == "warm_search").groupBy("repo", "query_id").agg(
        F.avg("duration_ms").alias("warm_search_mean_ms"))


def slowest_queries(means: DataFrame, rows: int = fixed.REPORT_ROWS) -> DataFrame:
    """The slowest queries of the report; a top-k by design."""
    return means.orderBy(F.desc("warm_search_mean_ms"), "repo", "query_id").limit(rows)


def platform_order(os: Column, arch: Column) -> Column:
    out = F
    for at, (name, machine) in enumerate(fixed.PLATFORM_ORDER):
        out = out.when((os == name) & (arch == machine), F.lit(at))
    return out.otherwise(F.lit(99))


def matrix_summary(reports: DataFrame) -> DataFrame:
    """One row per report in the fixed platform order, formatted.

    Expects ``os, arch, cpu_info, tool_version, repository_count, query_count,
    mode_counts, cold_index_mean_ms, warm_index_mean_ms, warm_search_mean_ms,
    quality_score``.
    """
    shown = lambda name: metrics.format_duration_ms(F.col(name)).alias(name.removesuffix("_mean_ms"))
    return reports.orderBy(platform_order(F.col("os"), F.col("arch")), "os", "arch").select(
        F.concat_ws("/", "os", "arch").alias("platform"),
        F.when(F.coalesce("cpu_info", F.lit("")) == "", "unknown CPU").otherwise(F.col("cpu_info")).alias("cpu"),
        F.col("tool_version").alias("tool"), F.col("repository_count").alias("repos"), F.col("query_count").alias("queries"),
        metrics.format_mode_counts(F.col("mode_counts")).alias("modes"),
        shown("cold_index_mean_ms"), shown("warm_index_mean_ms"), shown("warm_search_mean_ms"),
        F.col("quality_score").alias("score"))


def matrix_header(reports: DataFrame) -> DataFrame:
    """Names of the suites, their revisions, and the number of platforms."""
    names = lambda name: F.array_join(F.array_sort(F.collect_set(name)), ", ").alias(name)
    return reports.agg(names("suite_name"), names("suite_revision"), F.count(F.lit(1)).alias("platforms"))


def suite_coverage(queries: DataFrame) -> DataFrame:
    """Per suite: repositories, queries, and the query count of every mode."""
    counted = queries.groupBy("suite_id", "repo", query_mode(F.col("mode")).alias("mode")).count()
    modes = counted.groupBy("suite_id", "mode").agg(F.sum("count").alias("count")).groupBy("suite_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("mode", "count")))).alias("mode_counts"))
    return counted.groupBy("suite_id").agg(
        F.countDistinct("repo").alias("repository_count"), F.sum("count").alias("query_count")).join(modes, "suite_id")


def validate_suite(rows: DataFrame) -> DataFrame:
    """Violations of suite rows, one row each: ``suite_id, repo, query_id, violation``.

    ``rows`` come from :func:`siftstone.sources.suites.suite_rows`: one row per
    query, ``repo_at`` and ``query_at`` number them; a repository without
    queries and a suite without repositories have a row with nulls.
    """
    blank = lambda name: F.coalesce(trim_space(F.col(name)), F.lit("")) == ""
    at = lambda *names: [F.col(name) if name in names else F.lit("").alias(name)
                         for name in ("suite_id", "repo", "query_id")]

    def rules(table: DataFrame, keys: list[str], checks: list[tuple[str, Column]]) -> DataFrame:
        found = F.array_compact(F.array(*[F.when(failed, F.lit(name)) for name, failed in checks]))
        return table.select(*at(*keys), F.explode(found).alias("violation"))

    suites = rows.select("suite_id", "suite_version", "suite_name", F.col("repo_at").isNull().alias("no_repo")).distinct()
    repo_key = ["suite_id", "repo_at", "repo", "url", "commit", "language"]
    has_repo = rows.filter(F.col("repo_at").isNotNull())
    repos = has_repo.groupBy(*repo_key).agg(F.count("query_at").alias("queries"))
    has_query = has_repo.filter(F.col("query_at").isNotNull())
    hits = F.coalesce("expected_hits", F.array().cast("array<string>"))
    twice = lambda table, *keys: table.withColumn("seen", trim_space(F.col(keys[-1]))).filter(F.col("seen") != "").groupBy(
        *keys[:-1], "seen").count().filter("count > 1")
    repeated_repos = twice(repos, "suite_id", "repo").select("suite_id", F.col("seen").alias("repo"))
    repeated_queries = twice(has_query, "suite_id", "repo_at", "repo", "query_id").select("suite_id", "repo", F.col("seen").alias("query_id"))
    parts = [
        rules(suites, ["suite_id"], [
            ("suite id is required", blank("suite_id")),
            ("suite version must be greater than zero", F.coalesce("suite_version", F.lit(0)) <= 0),
            ("suite name is required", blank("suite_name")),
            ("suite must include at least one repository", F.col("no_repo")),
        ]),
        rules(repos, ["suite_id", "repo"], [
            ("repository has empty id", blank("repo")),
            ("repository has empty url", blank("url")),
            ("repository must pin a 40-character commit sha",
             ~F.coalesce(trim_space(F.col("commit")).rlike(fixed.COMMIT_PATTERN), F.lit(False))),
            ("repository has empty language", blank("language")),
            ("repository must define at least one query", F.col("queries") == 0),
        ]),
        rules(has_query, ["suite_id", "repo", "query_id"], [
            ("query has empty id", blank("query_id")),
            ("query has empty text", blank("text")),
            ("query has unknown mode", normalize_mode(F.coalesce("mode", F.lit(""))).isNull()),
            ("query must define at least one expected hit", F.size(hits) == 0),
            ("query has an invalid expected hit", F.exists(hits, lambda hit: ~trim_space(hit).contains(":"))),
        ]),
        repeated_repos.select(*at("suite_id", "repo"), F.lit("repository is duplicated").alias("violation")),
        repeated_queries.select(*at("suite_id", "repo", "query_id"), F.lit("query is duplicated").alias("violation")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def tool_report(results: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores and timings of any tool's ``repo, query_id, run, rank, path,
    line, duration_ms`` rows; only the first run is scored."""
    scored = score_queries(expected, results.filter((F.col("run") == 0) & F.col("rank").isNotNull()))
    times = results.select("repo", "query_id", "run", "duration_ms").distinct().groupBy("repo", "query_id").agg(
        F.avg("duration_ms").alias("warm_search_mean_ms"))
    return scored, times


def nested_report(queries: DataFrame, hits: DataFrame, searches: DataFrame, index_runs: DataFrame) -> DataFrame:
    """The report of a suite run, a row per repository with its queries and runs inside.

    ``queries(repo, query_id, text, mode, expected_hits)``, ``hits(repo,
    query_id, run, rank, path, line)``, ``searches(repo, query_id, run,
    duration_ms)``, ``index_runs(repo, run_kind, run_no, duration_ms,
    indexed_symbols, indexed_files)``. Totals come from :func:`quality_rollup`
    and :func:`timing_means`; they stay tables of their own.
    """
    listed = lambda *columns: F.array_sort(F.collect_list(F.struct(*columns)))
    hit = F.when(F.col("rank").isNotNull(), F.struct("rank", "path", "line"))
    runs = searches.join(hits.select(*QUERY, "run", "rank", "path", "line"), [*QUERY, "run"], "left").groupBy(*QUERY, "run").agg(
        F.min("duration_ms").alias("duration_ms"), F.array_sort(F.collect_list(hit)).alias("hits"))
    per_query = runs.groupBy(*QUERY).agg(listed("run", "duration_ms", "hits").alias("runs"), F.avg("duration_ms").alias("mean_ms"), F.min("run").alias("first_run"))
    expected = queries.select(*QUERY, F.explode("expected_hits").alias("expected_ref"))
    firsts = hits.join(per_query.select(*QUERY, F.col("first_run").alias("run")), [*QUERY, "run"])
    scored = score_queries(expected, firsts)
    top = first_top_hit(per_query.select(*QUERY, "first_run"), hits)
    whole = queries.join(per_query.drop("first_run"), QUERY, "left").join(scored, QUERY, "left").join(
        top.select(*QUERY, F.struct("path", "line").alias("top_hit")), QUERY, "left")
    entry = F.struct(F.col("query_id").alias("id"), "text", query_mode(F.col("mode")).alias("mode"), "expected_hits", "runs",
                     F.coalesce("mean_ms", F.lit(0.0)).alias("warm_search_mean_ms"), F.when(F.col("top_hit.path").isNotNull(), F.col("top_hit")).alias("top_hit"),
                     "top1_success", "top3_success", "rr", "observed_rank")
    repos = whole.groupBy("repo").agg(F.array_sort(F.collect_list(entry)).alias("queries"), F.count(F.lit(1)).alias("query_count"), *_quality())
    index_run = listed("run_no", "duration_ms", "indexed_symbols", "indexed_files").alias("runs")
    kinds = [index_runs.filter(F.col("run_kind") == kind).groupBy("repo").agg(index_run).withColumnRenamed("runs", f"{kind}_runs") for kind in ("cold_index", "warm_index")]
    times = timing_means(index_runs.select("repo", "run_kind", "duration_ms").unionByName(
        searches.select("repo", F.lit("warm_search").alias("run_kind"), "duration_ms"))).filter(~F.col("is_total")).drop("is_total")
    last = latest_index_run(index_runs).select("repo", F.col("indexed_symbols").alias("last_indexed_symbols"), F.col("indexed_files").alias("last_indexed_files"))
    for table in (*kinds, times, last):
        repos = repos.join(table, "repo", "left")
    return repos
