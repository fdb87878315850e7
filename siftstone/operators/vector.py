"""Exact nearest neighbours of many query vectors at once (L2 distance).

Items stay where they are. Queries go to them in chunks of a checked size, one
after another. A chunk meets the items in waves, each of them ``WAVE`` times as
many as all before: the k-th distance found so far bounds what a task of the
next wave hands on, so all tasks together hand on about ``WAVE`` times k candidates
for a query and wave, however many tasks there are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, scratch_dir

# A chunk of queries has at most so many vector components (64 MB), but so many rows at least.
BROADCAST_COMPONENTS, QUERY_ROWS = 8_000_000, 8192
#: How many times the items of all earlier waves a wave has; the first one is read by so many times fewer tasks.
WAVE = 16
PAIR_BLOCK = 4_000_000
DIGITS = 9


def l2_normalize(vector: Column) -> Column:
    """Vector of length one; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.asarray(np.stack(column.to_numpy()), dtype=np.float64)


def _nearest(queries: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, distance) of the ``k`` nearest of each query.

    ``vectors`` are in id order, so the lower row wins a tie. The matrix
    product only picks candidates; distances come from the differences.
    """
    rows, columns, distances = [], [], []
    k = min(k, len(vectors))
    v_square = np.einsum("ij,ij->i", vectors, vectors)
    step = max(1, PAIR_BLOCK // max(1, len(vectors)))
    for start in range(0, len(queries), step):
        block = queries[start:start + step]
        square = np.einsum("ij,ij->i", block, block)[:, None] + v_square - 2.0 * (block @ vectors.T)
        slack = 1e-9 * (1.0 + np.abs(square).max())
        kth = np.partition(square, k - 1, axis=1)[:, k - 1:k] + slack
        row, column = np.nonzero(square <= kth)
        exact = np.empty(len(row))
        chunk = max(1, PAIR_BLOCK // vectors.shape[1])
        for at in range(0, len(row), chunk):
            part = slice(at, at + chunk)
            delta = block[row[part]] - vectors[column[part]]
            exact[part] = np.sqrt(np.einsum("ij,ij->i", delta, delta))
        exact = np.round(exact, DIGITS)
        order = np.lexsort((column, exact, row))
        row, column, exact = row[order], column[order], exact[order]
        first = np.searchsorted(row, np.arange(len(block)))
        keep = np.arange(len(row)) - first[row] < k
        rows.append(row[keep] + start)
        columns.append(column[keep])
        distances.append(exact[keep])
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(distances)


def _merge_top(frame: pd.DataFrame, k: int, query: str, item: str) -> pd.DataFrame:
    frame = frame.sort_values([query, "distance", item], kind="stable")
    return frame[frame.groupby(query, sort=False).cumcount() < k]


def vector_knn(queries: DataFrame, index: DataFrame, k: int, query_id: str = "query_id", query_vector: str = "query_vector",
               item_id: str = "embedding_hash", vector: str = "embedding",
               broadcast_components: int = BROADCAST_COMPONENTS) -> DataFrame:
    """``query_id, item_id, distance, candidate_rank`` of the ``k`` nearest items.

    Ties go to the smaller item id. All vectors must have one dimension.
    """
    nearest = knn_candidates(queries, index, k, query_id, query_vector, item_id, vector, broadcast_components)
    order = Window.partitionBy(query_id).orderBy("distance", item_id)
    return nearest.withColumn("candidate_rank", F.row_number().over(order)).filter(F.col("candidate_rank") <= k)


def knn_candidates(queries: DataFrame, index: DataFrame, k: int, query_id: str = "query_id", query_vector: str = "query_vector",
                   item_id: str = "embedding_hash", vector: str = "embedding", broadcast_components: int = BROADCAST_COMPONENTS) -> DataFrame:
    """``query_id, item_id, distance``: the ``k`` nearest of every query, and what else its tasks could not rule out."""
    queries = queries.select(query_id, query_vector)
    index = index.select(item_id, vector)
    stats = queries.agg(F.count(F.lit(1)).alias("rows"), F.min(F.size(query_vector)).alias("low"),
                        F.max(F.size(query_vector)).alias("high")).first()
    if stats["rows"] and stats["low"] != stats["high"]:
        raise ValueError("query vectors differ in dimension")
    dim = stats["high"] or 0
    schema = T.StructType([queries.schema[query_id], index.schema[item_id], T.StructField("distance", T.DoubleType())])
    found = None
    for chunk in _chunks(queries, stats["rows"], max(QUERY_ROWS, broadcast_components // max(1, dim))):
        near = _in_waves(chunk.toPandas(), index, k, dim, schema, query_vector, vector)
        found = near if found is None else found.unionByName(near)
    return index.sparkSession.createDataFrame([], schema) if found is None else found


def _chunks(queries: DataFrame, rows: int, size: int) -> Iterator[DataFrame]:
    """``queries`` in parts of about ``size`` rows."""
    if not rows:
        return
    parts = -(-rows // size)
    if parts == 1:
        yield queries
        return
    # By row, so that an id repeated over and over is no large chunk; a folder each, so that a chunk is read alone.
    where = f"{scratch_dir(queries.sparkSession)}/query-chunks-{uuid.uuid4().hex}"
    queries.withColumn("chunk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts))).write.partitionBy("chunk").parquet(where)
    written = queries.sparkSession.read.schema(queries.schema.add("chunk", "long")).parquet(where)
    for part in range(parts):
        yield written.filter(F.col("chunk") == part).drop("chunk")


def _check(vectors: np.ndarray, dim: int) -> np.ndarray:
    if vectors.shape[1] != dim:
        raise ValueError(f"vectors of {vectors.shape[1]} components met queries of {dim}")
    return vectors


def _tasks(index: DataFrame) -> int:
    """About how many tasks read the items; nothing is run to find out."""
    plan = index._jdf.queryExecution()
    if not plan.executedPlan().nodeName().startswith("Adaptive"):
        return index.rdd.getNumPartitions()
    size = int(str(plan.optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # of unknown size
        return int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    advised = index._jdf.sparkSession().sessionState().conf().getConf(index.sparkSession._jvm.org.apache.spark.sql.internal.SQLConf.ADVISORY_PARTITION_SIZE_IN_BYTES())
    return size // int(advised) + 1


def _in_waves(table: pd.DataFrame, index: DataFrame, k: int, dim: int, schema: T.StructType, query_vector: str, vector: str) -> DataFrame:
    """Candidates of one chunk. Few tasks hand on little, so a small index is one wave."""
    query_id, item_id = schema[0].name, schema[1].name
    spark = index.sparkSession
    if table.empty:
        return spark.createDataFrame([], schema)
    tasks, waves = _tasks(index), 1
    while WAVE**waves < tasks:
        waves += 1
    rows = spark.createDataFrame([], T.StructType([T.StructField("row", T.LongType()), *schema.fields[1:]]))
    bound = np.full(len(table), np.inf)
    ids, matrix = table[query_id].to_numpy(), _matrix(table[query_vector])
    step = WAVE ** (waves - 1)
    place = F.pmod(F.xxhash64(item_id), F.lit(step))
    for wave in range(waves):
        low, high = (0 if not wave else WAVE ** (wave - 1)), WAVE**wave
        part = index if waves == 1 else index.filter((place >= low) & (place < high)).coalesce(max(1, tasks * high // step))
        shared = spark.sparkContext.broadcast((matrix, bound))
        found = materialize(_scan(part, shared, k, dim, T.StructType([T.StructField("row", T.LongType()), *schema.fields[1:]]), vector), "nearest")
        rows = rows.unionByName(found)
        if wave + 1 < waves:
            last = Window.partitionBy("row").orderBy("distance")
            kth = rows.select("row", "distance").withColumn("at", F.row_number().over(last)).filter(F.col("at") == k).toPandas()
            bound = np.full(len(table), np.inf)
            bound[kth["row"].to_numpy()] = kth["distance"].to_numpy()
    names = spark.createDataFrame(pd.DataFrame({"row": np.arange(len(ids)), query_id: ids}), T.StructType([T.StructField("row", T.LongType()), schema.fields[0]]))
    return rows.join(names, "row").select(query_id, item_id, "distance")


def _scan(index: DataFrame, shared, k: int, dim: int, schema: T.StructType, vector: str) -> DataFrame:
    """``row, item_id, distance`` of the ``k`` nearest items of each task, as far as they are within the bound."""
    item_id = schema[1].name

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix, bound = shared.value
        best = None
        for batch in batches:
            if batch.empty:
                continue
            batch = batch.sort_values(item_id, kind="stable")
            row, column, distance = _nearest(matrix, _check(_matrix(batch[vector]), dim), k)
            inside = distance <= bound[row]
            found = pd.DataFrame({"row": row[inside], item_id: batch[item_id].to_numpy()[column[inside]], "distance": distance[inside]})
            best = found if best is None else _merge_top(pd.concat([best, found], ignore_index=True), k, "row", item_id)
        if best is not None:
            yield best[["row", item_id, "distance"]]

    return index.mapInPandas(run, schema)
