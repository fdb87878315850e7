"""Approximate nearest neighbours by largest inner product over robust-pruned graphs.

Rows are dealt by a hash into shards of a bounded expected size. A shard's
graph is grown in batches: a greedy beam search over what stands proposes
neighbours, and pruning keeps a near one only if no kept one is clearly nearer
to it (``alpha``), so edges stay diverse. Every query searches every shard by a
beam and the shards' best are merged. Inner products are made distances by one
more component, which gives all vectors of a shard the same length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftstone.session import materialize


@dataclass(frozen=True)
class Graph:
    """How graphs are grown and searched."""

    degree: int = 32
    #: Width of the beam that proposes neighbours, and of the one that answers queries.
    build_beam: int = 64
    search_beam: int = 96
    #: A candidate goes if a kept neighbour is ``alpha`` times nearer to it than the node is.
    alpha: float = 1.1
    #: Nodes that a step of the search expands at once for each query.
    expand: int = 4
    #: Rows added to the graph, or queries searched, at once.
    batch: int = 256


def level_out(x: np.ndarray) -> np.ndarray:
    """``x`` (single precision) with a component more that makes all rows equally long."""
    square = np.einsum("ij,ij->i", x, x)
    return np.column_stack((x, np.sqrt(np.maximum(square.max(initial=0) - square, 0)))).astype("f4")


def beam_search(x: np.ndarray, edges: np.ndarray, start: int, asked: np.ndarray, beam: int, expand: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and negative inner products of the ``beam`` nearest nodes found for each of ``asked``, nearest first; -1 where there are none."""
    n = len(asked)
    ids = np.full((n, beam), -1, "i4")
    far = np.full((n, beam), np.inf, "f4")
    done = np.ones((n, beam), bool)
    seen = np.zeros((n, len(x) + 1), bool)  # the last column is that of no node
    seen[:, -1] = seen[:, start] = True
    ids[:, 0], far[:, 0], done[:, 0] = start, -(asked @ x[start]), False
    active = np.arange(n)
    while len(active):
        # The nearest nodes not yet expanded, of the queries that have any.
        rank = np.cumsum(~done[active], axis=1)
        chosen = ~done[active] & (rank <= expand)
        parents = np.where(chosen, ids[active], -1)
        order = np.argsort(~chosen, axis=1, kind="stable")[:, :expand]
        parents = np.take_along_axis(parents, order, 1)
        done[active] |= chosen
        found = np.where(parents[:, :, None] >= 0, edges[parents], -1).reshape(len(active), -1)
        found.sort(axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        found[seen[active[:, None], found]] = -1
        seen[active[:, None], found] = True
        seen[:, -1] = True
        at, place = np.nonzero(found >= 0)
        new = np.full(found.shape, np.inf, "f4")
        new[at, place] = -np.einsum("ij,ij->i", x[found[at, place]], asked[active[at]])
        every = np.concatenate((far[active], new), axis=1)
        best = np.argpartition(every, beam - 1, axis=1)[:, :beam]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(every, best, 1), axis=1, kind="stable"), 1)
        ids[active] = np.take_along_axis(np.concatenate((ids[active], found), axis=1), best, 1)
        far[active] = np.take_along_axis(every, best, 1)
        done[active] = np.take_along_axis(np.concatenate((done[active], found < 0), axis=1), best, 1)
        active = active[~done[active].all(axis=1)]
    return ids, far


def robust_prune(x: np.ndarray, nodes: np.ndarray, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` of the candidates ``near`` of each of ``nodes``, nearest first; -1 stands for none."""
    near = np.sort(near, axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    near[near == nodes[:, None]] = -1
    points = x[near]
    length = np.einsum("j,j->", x[0], x[0]) if len(x) else 0.0
    away = np.maximum(2 * length - 2 * np.einsum("bcj,bj->bc", points, x[nodes]), 0)  # squared distances
    away[near < 0] = np.inf
    order = np.argsort(away, axis=1, kind="stable")
    near, away = np.take_along_axis(near, order, 1), np.take_along_axis(away, order, 1)
    points = np.take_along_axis(points, order[:, :, None], 1)
    between = np.maximum(2 * length - 2 * np.matmul(points, points.transpose(0, 2, 1)), 0)
    alive = near >= 0
    kept = np.full((len(nodes), degree), -1, "i4")
    rows = np.arange(len(nodes))
    for k in range(degree):
        first = np.argmax(alive, axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        kept[some, k] = near[rows, first][some]
        alive &= alpha * alpha * between[rows, first] > away
        alive[rows, first] = False
    return kept


def grow(x: np.ndarray, how: Graph = Graph()) -> tuple[np.ndarray, int]:
    """The out-edges of every row of ``x``, whose rows are equally long, and the node at which searches start."""
    n = len(x)
    edges = np.full((n + 1, how.degree), -1, "i4")  # the last row is that of no node
    start = int(np.argmax(x @ x.mean(axis=0))) if n else 0
    order = np.concatenate(([start], np.delete(np.arange(n), start))) if n else np.zeros(0, "i8")
    at, size = 1, 1
    while at < n:
        own = order[at : at + min(size, how.batch)]
        found = beam_search(x, edges, start, x[own], how.build_beam, how.expand)[0]
        # What was added so far may be less than a beam: the batch itself is no candidate.
        out = robust_prune(x, own, found, how.degree, how.alpha)
        edges[own] = out
        # Each kept neighbour gets the edge back; one with too many is pruned again.
        source, target = np.repeat(own, how.degree), out.reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        back = np.full((len(nodes), int(count.max(initial=0))), -1, "i4")
        back[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        both = np.concatenate((edges[nodes], back), axis=1)
        full = (both >= 0).sum(axis=1) > how.degree
        fits = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, : how.degree]
        edges[nodes[~full]] = fits[~full]
        for k in range(0, int(full.sum()), how.batch):
            some = np.flatnonzero(full)[k : k + how.batch]
            edges[nodes[some]] = robust_prune(x, nodes[some], both[some], how.degree, how.alpha)
        at, size = at + len(own), at + len(own)
    return _reached(edges[:n], start), start


def _reached(edges: np.ndarray, start: int) -> np.ndarray:
    """``edges`` with some more, where needed, so that searches can come from ``start`` to every node."""
    n = len(edges)
    reached = np.zeros(n + 1, bool)
    fresh = np.array([start] if n else [], "i8")
    while n:
        while len(fresh):
            reached[fresh] = True
            found = np.unique(edges[fresh])
            fresh = found[(found >= 0) & ~reached[found]]
        left = np.flatnonzero(~reached[:n])
        if not len(left):
            break
        near = edges[left]
        known = (near >= 0) & reached[near]
        some = known.any(axis=1)
        # From the nearest neighbour that is reached; if no one has any, the first is led to from the start.
        owner = np.where(some, near[np.arange(len(left)), known.argmax(axis=1)], start)
        left, owner = (left[some], owner[some]) if some.any() else (left[:1], owner[:1])
        by = np.argsort(owner, kind="stable")
        left, owner = left[by], owner[by]
        nodes, first, count = np.unique(owner, return_index=True, return_counts=True)
        wider = np.full((n, edges.shape[1] + int(count.max())), -1, "i4")
        wider[:, : edges.shape[1]] = edges
        free = np.repeat((edges[nodes] >= 0).sum(axis=1) - first, count) + np.arange(len(left))
        wider[owner, free] = left
        edges = wider[:, : int((wider >= 0).sum(axis=1).max())]
        fresh = left
    return edges


# --- tables


def _vectors(table: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``vec_id, vector`` of the rows that take part."""
    column = F.col(vector)
    if table.schema[vector].dataType.simpleString() not in ("array<float>", "array<double>"):
        column = column.cast("array<double>")
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), column.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).filter(finite & F.exists("vector", lambda x: x != 0))


def _matrix(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(lists), -1)


def index_vectors(vectors: DataFrame, how: Graph = Graph(), shard_rows: int = 16_384, most: int = 21) -> DataFrame:
    """The graphs of all shards, a row a node: ``dim, shard, slot, ids, vector, edges, start``.

    Equal vectors are one node with the ``most`` least of their ids: with
    equal scores and ties going to the lesser id, no other of them can be
    among the ``most`` best of a query. Vectors of different lengths never share a shard.
    """
    place = F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))
    distinct = vectors.withColumn("place", place).filter(F.col("place") <= most).groupBy("vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    distinct = materialize(distinct.withColumn("dim", F.size("vector")), "distinct-vectors")
    shards = max(1, -(-distinct.count() // shard_rows))
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"))
    kind = vectors.schema["vector"].dataType.simpleString()
    element = pa.float32() if kind == "array<float>" else pa.float64()
    schema = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("slot", pa.int32()), ("ids", pa.list_(pa.int64())), ("vector", pa.list_(element)),
                        ("edges", pa.list_(pa.int32())), ("start", pa.int32())])

    def build(group: pa.Table) -> pa.Table:
        # In an order that does not depend on how rows arrive.
        group = group.take(np.argsort([x[0] for x in group.column("ids").to_pylist()], kind="stable"))
        edges, start = grow(level_out(_matrix(group.column("vector"), "f4")), how)
        n, kept = len(edges), edges >= 0
        out = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(kept.sum(axis=1)))), pa.int32()), pa.array(edges[kept], pa.int32()))
        return pa.table({"dim": group.column("dim"), "shard": group.column("shard"), "slot": pa.array(np.arange(n), pa.int32()), "ids": group.column("ids"),
                         "vector": group.column("vector"), "edges": out, "start": pa.array(np.full(n, start), pa.int32())}).cast(schema)

    # A number of partitions of its own: graphs are far more work than their bytes tell.
    keyed = dealt.repartition(4 * shards, "dim", "shard").groupBy("dim", "shard")
    return materialize(keyed.applyInArrow(build, f"dim int, shard int, slot int, ids array<long>, vector {kind}, edges array<int>, start int"), "graphs")


def search_vectors(queries: DataFrame, index: DataFrame, k: int = 20, how: Graph = Graph(), query_rows: int = 4096) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best found for each row of ``queries`` (``vec_id``, ``vector``), less rows of its own id.

    A task searches one shard's graph for a bounded part of the queries; the
    index has to know at least ``k + 1`` ids of equal vectors. Scores are inner products of the given vectors in double precision.
    """
    asked = materialize(queries.distinct(), "asked")
    parts = max(1, -(-asked.count() // query_rows))
    shards = 1 + (index.agg(F.max("shard")).first()[0] or 0)
    asked = asked.select(F.size("vector").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"),
                         F.col("vec_id").alias("query_id"), F.col("vector").alias("asked"))
    held = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(nodes: pa.Table, rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {name: [] for name in schema.names}
        if nodes.num_rows and rows.num_rows:
            nodes = nodes.take(np.argsort(nodes.column("slot").to_numpy()))
            ids, vectors, start = nodes.column("ids").to_pylist(), _matrix(nodes.column("vector"), "f8"), nodes.column("start")[0].as_py()
            edge_lists = nodes.column("edges").combine_chunks()
            counts = np.diff(edge_lists.offsets.to_numpy())
            edges = np.full((len(ids) + 1, max(1, int(counts.max()))), -1, "i4")
            edges[:-1][np.arange(edges.shape[1]) < counts[:, None]] = edge_lists.flatten().to_numpy()
            x = level_out(vectors.astype("f4"))
            rows = rows.take(np.argsort(rows.column("query_id").to_numpy(), kind="stable"))
            names, sought = rows.column("query_id").to_pylist(), _matrix(rows.column("asked"), "f8")
            flat = np.column_stack((sought, np.zeros(len(sought)))).astype("f4")
            for at in range(0, len(names), how.batch):
                found, _ = beam_search(x, edges, start, flat[at : at + how.batch], max(how.search_beam, k + 1), how.expand)
                for query, near in enumerate(found, at):
                    near = near[near >= 0]
                    scores = np.einsum("ij,j->i", vectors[near], sought[query])
                    best = np.lexsort((near, -scores))[: k + 1]
                    pairs = sorted((-score, i) for node, score in zip(near[best].tolist(), scores[best].tolist()) for i in ids[node] if i != names[query])[:k]
                    out["query_id"] += [names[query]] * len(pairs)
                    out["vec_id"] += [i for _, i in pairs]
                    out["score"] += [-score for score, _ in pairs]
        return pa.Table.from_pydict(out, schema=schema)

    keys, tasks = ("dim", "shard", "part"), 2 * shards * parts
    pairs = asked.repartition(tasks, *keys).groupBy(*keys)
    hits = held.repartition(tasks, *keys).groupBy(*keys).cogroup(pairs).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.distinct().withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_vectors(table: DataFrame, every: int = 20, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", how: Graph = Graph(), shard_rows: int = 16_384) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows whose id is divisible by ``every``, against all other rows.

    Rows without an id, and vectors that are null, zero or hold a null or non-finite
    component, take no part. Rows equal in id and vector count once; an id with several vectors
    is one query that has the best of all of them, and each is a candidate of others. Other columns are ignored.
    An empty table gives an empty one, and a table of few rows gives all candidates.
    """
    rows = materialize(_vectors(table, vec_id, vector), "vectors")
    return search_vectors(rows.filter(F.pmod("vec_id", F.lit(every)) == 0), index_vectors(rows, how, shard_rows, k + 1), k, how)
