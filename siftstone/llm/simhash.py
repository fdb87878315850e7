"""Near-duplicate groups by SimHash and a sharded vantage-point tree.

Fingerprints are 64 bits, linked at 4 or fewer differing bits. The distinct
ones are routed through a vantage-point tree: each belongs to one leaf, and is
sent as a query to every later leaf that its ball may reach by the triangle bound.
A leaf is a shard of the join; large leaves are cut into tasks by queries and
members, so a leaf that cannot be split further is no single task. A
task emits a spanning forest of the links it found, never all pairs. Links are
then merged into components by min-label steps over tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.session import materialize

from .common import blocks, to_batches, whole_text

RADIUS = 4
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


# --- fingerprints --------------------------------------------------------------------------------------------------


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Bit by bit the majority of the hashes of word shingles; 0 without a word."""
    import xxhash

    words = text.translate(LOWER).split()  # bytes.split() cuts at exactly the six blanks
    if not words:
        return 0
    ends = np.cumsum([len(x) + 1 for x in words]) - 1
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    starts = [0, *(ends + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())), "<u8", len(words) - shingle + 1)
    ones = np.zeros(64, "i8")
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int((np.uint64(1) << np.arange(64, dtype="u8"))[2 * ones > len(hashes)].sum())


def _prints_of(rows: DataFrame, shingle: int) -> DataFrame:
    """``rows`` with ``print`` (64 bits as a signed long) in place of ``text``."""
    rows = rows.withColumn("text", whole_text().cast("binary"))
    schema = rows.drop("text").withColumn("print", F.lit(0).cast("long")).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            found = np.array([fingerprint(x.as_py(), shingle) for x in part.column("text")], "<u8").view("<i8")
            yield from part.drop_columns("text").append_column("print", pa.array(found, pa.int64())).to_batches()

    return rows.mapInArrow(read, schema)


def fingerprints(docs: DataFrame, text: str | Column = "text", doc_id: str | Column = "doc_id", shingle: int = 4) -> DataFrame:
    """``doc_id`` and ``print`` of every row; null and empty texts have 0."""
    own = docs.select((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    return _prints_of(own, shingle)


# --- the tree ------------------------------------------------------------------------------------------------------


class Tree:
    """Vantage points with the median distance, as arrays; node 0 is the root, children below 0 are leaves."""

    def __init__(self, points: np.ndarray, leaves: int) -> None:
        self.point, self.cut, self.child = [], [], []
        self.n_leaves = 0
        self._grow(np.sort(points), max(1, len(points) // leaves))

    def _grow(self, points: np.ndarray, enough: int) -> int:
        if len(points) > enough:
            # Of a few candidates the one with the widest spread of distances prunes best.
            candidates = points[:: max(1, len(points) // 16)][:16]
            distances = np.bitwise_count(candidates[:, None] ^ points[None, :]).astype("i8")
            best = int(np.argmax(distances.std(axis=1)))
            cut = int(np.median(distances[best]))
            inside = distances[best] <= cut
            if not inside.all():
                node = len(self.point)
                self.point.append(candidates[best])
                self.cut.append(cut)
                self.child.append([0, 0])
                self.child[node] = [self._grow(points[inside], enough), self._grow(points[~inside], enough)]
                return node
        self.n_leaves += 1
        return -self.n_leaves

    def route(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and leaves: all leaves that the ball around each point may reach; radius 0 gives its own."""
        rows, leaves = [], []
        todo = [(0 if self.point else -1, np.arange(len(points)))]
        while todo:
            node, own = todo.pop()
            if not len(own):
                continue
            if node < 0:
                rows.append(own)
                leaves.append(np.full(len(own), -node - 1))
                continue
            distance = np.bitwise_count(points[own] ^ self.point[node]).astype("i8")
            todo.append((self.child[node][0], own[distance - radius <= self.cut[node]]))
            todo.append((self.child[node][1], own[distance + radius > self.cut[node]]))
        return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.zeros(0, "i8"), np.zeros(0, "i8"))


class Forest:
    """Components of numbered nodes, merged by whole arrays of links."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        while True:
            a, b = self.root[left], self.root[right]
            apart = a != b
            if not apart.any():
                return
            left, right, a, b = left[apart], right[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def leaf_links(members: np.ndarray, queries: np.ndarray, radius: int = RADIUS, tile: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between ``queries`` and ``members`` (both distinct): each point and its root.

    Two more vantage points bound which members a group of queries can meet.
    """
    points = np.unique(np.concatenate((members, queries)))
    if not len(members) or len(points) < 2:
        return points[:0], points[:0]
    forest = Forest(len(points))
    first, second = points[len(points) // 3], points[2 * len(points) // 3]
    ring = lambda x, p: np.bitwise_count(x ^ p).astype("i8")

    def ordered(x: np.ndarray):
        key = ring(x, first) * 65 + ring(x, second)
        order = np.argsort(key, kind="stable")
        return x[order], key[order]

    members, member_key = ordered(members)
    queries, query_key = ordered(queries)
    member_at, query_at = np.searchsorted(points, members), np.searchsorted(points, queries)
    groups, starts = np.unique(query_key, return_index=True)
    for key, start, stop in zip(groups, starts, [*starts[1:], len(queries)]):
        a, b = divmod(int(key), 65)
        for ring_a in range(max(0, a - radius), min(64, a + radius) + 1):
            low = np.searchsorted(member_key, ring_a * 65 + max(0, b - radius))
            high = np.searchsorted(member_key, ring_a * 65 + min(64, b + radius), side="right")
            if low == high:
                continue
            step = max(1, tile // (high - low))
            for at in range(start, stop, step):
                own = slice(at, min(stop, at + step))
                near = np.bitwise_count(queries[own, None] ^ members[None, low:high]) <= radius
                x, y = np.nonzero(near)
                if len(x):
                    forest.add(query_at[own][x], member_at[low:high][y])
    linked = np.flatnonzero(forest.root != np.arange(len(points)))
    return points[linked], points[forest.root[linked]]


def links(prints: DataFrame, leaf_size: int = 65_536, sample: int = 20_000, radius: int = RADIUS) -> DataFrame:
    """``a, b``: links whose components are those of all pairs of distinct ``print`` within ``radius`` bits.

    The tree is grown from at most about ``sample`` prints; it decides how much
    is pruned, not what is found.
    """
    n = prints.count()
    share = min(1.0, sample / max(n, 1))
    drawn = prints.filter(F.pmod(F.xxhash64("print"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    tree = Tree(np.array([r[0] for r in drawn.collect()], "i8").view("u8"), max(1, -(-n // leaf_size)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("print").to_numpy().view("u8")
            rows, leaf = tree.route(own, radius)
            home_rows, home_leaf = tree.route(own, 0)
            home = np.empty(len(own), "i8")
            home[home_rows] = home_leaf
            # Of two near points each reaches the other's leaf, so the one of the lower leaf goes to the higher.
            rows, leaf = rows[leaf >= home[rows]], leaf[leaf >= home[rows]]
            yield from to_batches({"print": own[rows].view("i8"), "leaf": leaf, "home": home[rows] == leaf},
                                  pa.schema([("print", pa.int64()), ("leaf", pa.int32()), ("home", pa.bool_())]), 50_000)

    routed = materialize(prints.select("print").mapInArrow(route, "print long, leaf int, home boolean"), "routed")
    # One row per leaf; cuts make tasks of at most leaf_size members and 4 x leaf_size queries.
    cuts = routed.groupBy("leaf").agg(F.ceil(F.count("*") / (4 * leaf_size)).cast("int").alias("q_cuts"), F.ceil(F.sum(F.col("home").cast("int")) / leaf_size).cast("int").alias("m_cuts"))
    known = routed.join(cuts, "leaf").filter("m_cuts > 0")
    spot = F.pmod(F.xxhash64("print"), F.lit(1 << 20))
    asked = known.select("leaf", (spot % F.col("q_cuts")).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.col("m_cuts") - 1)).alias("m"), "print", F.lit(False).alias("member"))
    held = known.filter("home").select("leaf", F.explode(F.sequence(F.lit(0), F.col("q_cuts") - 1)).alias("q"), (spot % F.col("m_cuts")).cast("int").alias("m"), "print", F.lit(True).alias("member"))

    def join(group: pd.DataFrame) -> pd.DataFrame:
        own = group["print"].to_numpy("i8").view("u8")
        member = group["member"].to_numpy(bool)
        a, b = leaf_links(own[member], own[~member], radius)
        return pd.DataFrame({"a": a.view("i8"), "b": b.view("i8")})

    return asked.unionByName(held).groupBy("leaf", "q", "m").applyInPandas(join, "a long, b long")


# --- components ----------------------------------------------------------------------------------------------------


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """``node, root`` for each node of ``edges`` (``a``, ``b``): the least node of its component.

    Large-star and small-star steps in turn: each moves the links of a node to
    the least node near it. Minima are partial before the shuffle, no
    neighbourhood is gathered, and steps are written as tables.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")

    def state(df: DataFrame) -> tuple:
        # Exact for equality: counts and sums of hashes.
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(edges)
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("least"))
        # Large star: the greater neighbours of a node go to the least one.
        large = both.filter("b > a").join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()
        # Small star: the lesser neighbours, and the node itself, go to the least one.
        large = materialize(large, "large-star")
        small_least = large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        moved = large.join(small_least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("least").alias("b"))
        edges = moved.unionByName(small_least.select(F.col("node").alias("a"), F.col("least").alias("b"))).filter("a <> b").distinct()
        edges = materialize(edges, "small-star")
        now = state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def print_classes(prints: DataFrame, leaf_size: int = 65_536) -> DataFrame:
    """``print, root`` for each distinct ``print``: the least print of its component."""
    distinct = materialize(prints.select("print").distinct(), "distinct-prints")
    roots = components(links(distinct, leaf_size))
    return distinct.join(roots, F.col("print") == F.col("node"), "left").select("print", F.coalesce("root", "print").alias("root"))


def near_duplicates(docs: DataFrame, text: str | Column = "text", doc_id: str | Column = "doc_id", shingle: int = 4, leaf_size: int = 65_536) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    ``component_id`` is the least ``doc_id`` that links reach, itself included.
    Null and empty texts have fingerprint zero and are linked like any other.
    Null ids are never the least one, unless a component has no other; repeated
    rows come back as often. An empty table gives an empty one.
    """
    prints = materialize(fingerprints(docs, text, doc_id, shingle), "fingerprints")
    classes = materialize(print_classes(prints, leaf_size), "print-classes")
    firsts = prints.groupBy("print").agg(F.min("doc_id").alias("least")).join(classes, "print")
    least = firsts.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = classes.join(least, "root").select("print", "component_id")
    return prints.join(of_print, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def keep_firsts(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """The first row of ``docs`` of each ``root`` over ``rooted`` (``doc_id``, ``text_hash``, ``root``)."""
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))
    winners = rooted.groupBy("root").agg(F.min(order).alias("w"))
    chosen = materialize(winners.select(F.col("w.doc_id").alias("kept_id"), F.col("w.text_hash").alias("kept_hash")), "kept")
    kept = docs.join(
        chosen, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.xxhash64("text") == F.col("kept_hash")), "left_semi")
    # Rows equal in id and text are the same document more than once.
    return kept.dropDuplicates(["doc_id", "text"]).select(docs.columns)


def one_of_each(docs: DataFrame, shingle: int = 4, leaf_size: int = 65_536) -> DataFrame:
    """The rows of ``docs``, unchanged, less all but one of each near-duplicate component.

    The row with the component's least ``doc_id`` stays; of several such rows
    the one with the least hash of its text, and of rows equal in both
    one. A component of null ids only keeps its row of the least hash.
    """
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    marked = materialize(_prints_of(keyed, shingle), "fingerprints")
    classes = print_classes(marked, leaf_size)
    return keep_firsts(docs, marked.join(classes, "print"))
