"""Logs of search and index runs as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import trim_space


def read_logs(spark: SparkSession, *paths: str) -> DataFrame:
    """``run, stdout``: one row per log file."""
    return spark.read.text(list(paths), wholetext=True).select(
        F.input_file_name().alias("run"), F.col("value").alias("stdout"))


def parse_hits(logs: DataFrame, key: str = "run") -> DataFrame:
    """``key, rank, path, line, ok``: one row per hit line of ``stdout``.

    A log without hits has one row of nulls; ``ok`` is false when it does not
    say that nothing matched either.
    """
    lines = F.regexp_extract_all("stdout", F.lit(fixed.HIT_LINE), F.lit(0))
    rows = logs.select(key, "stdout", F.explode_outer(lines).alias("hit"))

    def group(at: int) -> Column:
        return F.regexp_extract("hit", fixed.HIT_LINE, at)

    return rows.select(
        key, group(1).cast("int").alias("rank"), trim_space(group(2)).alias("path"), group(3).cast("int").alias("line"),
        (F.col("hit").isNotNull() | F.col("stdout").contains(fixed.NO_HITS)).alias("ok"))


def parse_index_log(logs: DataFrame, key: str = "run") -> DataFrame:
    """``key, summary, indexed_symbols, indexed_files, ok`` of each index log."""
    found = F.regexp_extract("stdout", fixed.INDEX_LINE, 0)
    idle = F.col("stdout").contains(fixed.INDEX_UP_TO_DATE)

    def count(at: int) -> Column:
        value = F.regexp_extract("stdout", fixed.INDEX_LINE, at)
        return F.when(value != "", value.cast("int")).otherwise(0)

    return logs.select(
        key, F.when(found != "", found).when(idle, fixed.INDEX_UP_TO_DATE).otherwise("").alias("summary"),
        count(1).alias("indexed_symbols"), count(2).alias("indexed_files"), ((found != "") | idle).alias("ok"))
