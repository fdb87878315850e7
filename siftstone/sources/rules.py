"""Path-weight rule files and manifests."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import fixed
from ..functions.paths import check_weights


def load_path_weights(spark: SparkSession, path: str) -> dict[str, float]:
    """Rules of a JSON file, for :func:`path_weight`; none for a missing file.

    A rule file is configuration of a few lines, so it is held on the driver.
    """
    if "://" not in path and not os.path.exists(path):
        return {}
    rows = parse_path_weights(spark.read.text(path, wholetext=True).withColumnRenamed("value", "rules"))
    return check_weights({row["pattern"]: row["weight"] for row in rows.collect()})


def parse_path_weights(texts: DataFrame) -> DataFrame:
    """``pattern, weight, valid`` of JSON rule texts, in pattern order."""
    rules = texts.select(F.explode(F.from_json("rules", "map<string,double>")).alias("pattern", "weight"))
    valid = (F.trim("pattern") != "") & ~F.isnan("weight") & (F.col("weight") > 0) & (F.col("weight") <= 1)
    return rules.select("pattern", "weight", valid.alias("valid"))


def write_default_weights(path: str) -> bool:
    """Write the default rules unless the file is there already."""
    if os.path.exists(path):
        return False
    with open(path, "w") as out:
        json.dump(fixed.DEFAULT_PATH_WEIGHTS, out, indent=2)
    return True


def normalize_manifests(manifests: DataFrame) -> DataFrame:
    """Manifests with defaults filled in and texts trimmed."""
    url = F.trim("remote.ci_url")
    return manifests.withColumns({
        "schema_version": F.when(F.coalesce("schema_version", F.lit(0)) == 0, fixed.MANIFEST_SCHEMA_VERSION).otherwise(F.col("schema_version")),
        "version": F.greatest(F.coalesce("version", F.lit(0)), F.lit(0)).cast("long"),
        "indexing_hash": F.trim(F.coalesce("indexing_hash", F.lit(""))),
        "source": F.trim(F.lower(F.coalesce("source", F.lit("")))),
        "remote": F.when(F.coalesce(url, F.lit("")) != "", F.struct(url.alias("ci_url"))),
    })


def manifest_errors(manifests: DataFrame) -> DataFrame:
    """Manifests of an unknown schema or source, with the reason."""
    error = F.when(F.col("schema_version") <= 0, "invalid manifest schema_version").when(
        ~F.col("source").isin("", "local", "remote"), "invalid manifest source")
    return manifests.withColumn("error", error).filter(F.col("error").isNotNull())


def read_manifests(spark: SparkSession, *paths: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Normalised manifests with their file, and the ones in error.

    A file holds one manifest, or one a line as :func:`write_manifests` has it.
    """
    raw = spark.read.schema(schemas.MANIFESTS).json(list(paths), multiLine=not lines).withColumn("file", F.input_file_name())
    manifests = normalize_manifests(raw)
    errors = manifest_errors(manifests)
    known = (F.col("schema_version") > 0) & F.col("source").isin("", "local", "remote")
    return manifests.filter(known), errors


def write_manifests(manifests: DataFrame, path: str) -> None:
    manifests.write.mode("overwrite").json(path)
