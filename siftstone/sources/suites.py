"""Labelled query suites and benchmark reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def suite_rows(suites: DataFrame) -> DataFrame:
    """One row per query of nested suites; empty levels keep a row of nulls."""
    repos = suites.select(
        "suite_id", "suite_version", F.col("name").alias("suite_name"),
        F.posexplode_outer("repositories").alias("repo_at", "r"))
    return repos.select(
        "suite_id", "suite_version", "suite_name", "repo_at", F.col("r.id").alias("repo"), F.col("r.url").alias("url"),
        F.col("r.commit").alias("commit"), F.col("r.language").alias("language"),
        F.posexplode_outer("r.queries").alias("query_at", "q"),
    ).select("suite_id", "suite_version", "suite_name", "repo_at", "repo", "url", "commit", "language", "query_at",
             F.col("q.id").alias("query_id"), F.col("q.text").alias("text"), F.col("q.mode").alias("mode"),
             F.col("q.expected_hits").alias("expected_hits"))


def read_suite(spark: SparkSession, *paths: str) -> DataFrame:
    """Suite files (nested JSON) as one row per query."""
    return suite_rows(spark.read.schema(schemas.SUITE).json(list(paths), multiLine=True))


def expected_hits(rows: DataFrame) -> DataFrame:
    return rows.select("repo", "query_id", F.explode("expected_hits").alias("expected_ref"))


def write_report(report: DataFrame, path: str) -> None:
    """A nested report as JSON lines, nulls kept."""
    report.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
