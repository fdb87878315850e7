"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Nothing here fixes a partition count for a cluster: AQE coalesces and splits
# shuffle partitions from their measured size.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Text stages do much work on few bytes: coalesce to busy cores, not to size.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # Explode-heavy text stages keep their row batches small in Python workers.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def local_session(cpus: int | str = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("siftstone")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: executors of a
    cluster do not share one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
    return _local_scratch()


@functools.cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="siftstone-")


def materialize(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and gives the
    planner real file sizes, so a later join broadcasts this side only when
    it is below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by key when its scan would leave cores idle.

    A small file can be one task however long its texts are; a large table
    has far more splits than cores and stays as it is. So does a plan that
    shuffles already: asking it for its partitions would run the shuffle.
    """
    plan = df._jdf.queryExecution().executedPlan().nodeName()
    if not plan.startswith("Adaptive") and df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism:
        return df.repartition(*keys)
    return df


def dealt(df: DataFrame, ways: int = 4) -> DataFrame:
    """``df``, the rows of a scan, in at least ``ways`` tasks for each core, however few its splits are.

    For rows that each become much work further on: they are moved while they
    are small, and by number, so that their few bytes are not put together again.
    """
    return df.repartition(max(ways * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))
