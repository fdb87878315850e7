"""Near copies by SimHash and the exact Jaccard similarity of their sets of word shingles.

The vantage-point tree of ``simhash.py`` gives the first candidates: fingerprints of the same
shingles within a few bits, compared whole. Pairs of the similarity asked for may differ in more bits, so a
prefix filter, which loses no pair, gives those among what is still apart: with all shingles in
one order, two sets of similarity ``t`` share a shingle among the first
``n - ceil(t n) + 1`` of each. The order is by frequency in a sample, rarest first, so
passages in many documents seldom make candidates; it decides how many there are, not what is found.
Only prefixes are stored and shuffled, once. A histogram of the hashes, which
bounds the difference of two sets from below, thins out candidates; the sets of
what is left are made again from the texts and compared whole. Each shingle's first holder is tried
against the others before all pairs of what is still apart, so a large group
of copies is no square of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.session import materialize

from .common import blocks, release, to_batches, whole_text
from . import simhash
from .simhash import LOWER, components

EPSILON = 1e-9
#: Parts of the hash space in a histogram; a count of more than 255 is cut, which only weakens the bound.
PARTS = 256
#: Bits of the filter that tells which texts are needed again. Its size is fixed: with more texts than it has room for it lets more through.
FILTER_BITS = 23


def shingles(text: bytes, size: int = 5) -> np.ndarray:
    """The distinct hashes of a text's word shingles, ascending; a shorter text is one shingle, one without a word has none."""
    import xxhash

    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, "u8")
    ends = np.cumsum([len(x) + 1 for x in words]) - 1
    joined = b" ".join(words)
    starts = [0, *(ends + 1).tolist()]
    stops = ends[size - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops)), "u8", len(stops)))


def _frequent(docs: DataFrame, size: int, sample: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in at least ``least`` of about ``sample`` texts, ascending, and in how many; at most a text's shingles x ``sample`` / ``least``."""
    texts = docs.select(whole_text().alias("text"))
    drawn = min(1.0, sample / max(1, docs.count()))
    some = texts.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(drawn * (1 << 30))).distinct()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            every = np.concatenate([shingles(x.as_py(), size) for x in part.column("text")])
            found, counts = np.unique(every, return_counts=True)
            yield from to_batches({"shingle": found.view("i8"), "c": counts}, pa.schema([("shingle", pa.int64()), ("c", pa.int64())]), 100_000)

    some = some.select(F.col("text").cast("binary").alias("text"))
    counted = some.mapInArrow(read, "shingle long, c long").groupBy("shingle").agg(F.sum("c").alias("c")).filter(F.col("c") >= least)
    rows = counted.toArrow()
    keys = rows.column("shingle").to_numpy().view("u8")
    order = np.argsort(keys)
    return keys[order], rows.column("c").to_numpy()[order]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), whole_text().cast("binary").alias("text"))


def prefixes(docs: DataFrame, size: int = 5, similarity: float = 0.8, sample: int = 5_000, least: int = 3) -> DataFrame:
    """``doc_id, text_hash, node`` of every row; where a block has a set for the first time also ``print, n, histogram, prefix, frequent``.

    ``node`` is a hash of the set, ``print`` the SimHash of the text's shingles; ``prefix`` holds its first shingles in the common order, of which
    ``frequent`` tells whether the sample knows them.
    """
    keys, counts = _frequent(docs, size, sample, least)
    kinds = [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("node", pa.int64()), ("print", pa.int64()), ("n", pa.int32()), ("histogram", pa.binary()), ("prefix", pa.list_(pa.int64())), ("frequent", pa.list_(pa.bool_()))]
    out = pa.schema(kinds)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for part in blocks(batches, rows=2048, size=4 << 20):
            columns: dict[str, list] = {name: [] for name in out.names[2:]}
            seen: set[int] = set()  # nodes of this block
            for text in part.column("text"):
                whole = text.as_py()
                own = shingles(whole, size)
                node = int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 7)).view("i8"))
                row: tuple = (node, None, None, None, None, None)
                if node not in seen:
                    seen.add(node)
                    n = len(own)
                    histogram = np.minimum(np.bincount((own >> np.uint64(56)).astype("i8"), minlength=PARTS), 255).astype("u1").tobytes()
                    rank = np.zeros(n, "i8")
                    if len(keys) and n:
                        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                        rank = np.where(keys[at] == own, counts[at], 0)
                    first = np.lexsort((own, rank))[: n and n - math.ceil(similarity * n - EPSILON) + 1]
                    own_print = int(np.uint64(simhash.fingerprint(whole, size)).view("i8"))
                    row = (node, own_print, n, histogram, own[first].view("i8"), rank[first] > 0)
                for name, value in zip(out.names[2:], row):
                    columns[name].append(value)
            yield from to_batches({"doc_id": part.column("doc_id"), "text_hash": part.column("text_hash"), **columns}, out, 1024)
        part = columns = None
        release()

    ddl = "doc_id long, text_hash long, node long, print long, n int, histogram binary, prefix array<long>, frequent array<boolean>"
    return _keyed(docs).mapInArrow(read, ddl)


def _possible(n: Column, pos: Column, m: Column, at: Column, similarity: float) -> Column:
    """Of sizes that allow it, and with enough left from the shared shingle on, were it the first one shared."""
    need = similarity / (1 + similarity) * (n + m)
    return (F.least(n, m) >= similarity * F.greatest(n, m) - EPSILON) & (F.least(n - pos, m - at) >= need - EPSILON)


def _thinned(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """``a, b`` of ``pairs`` whose histograms do not tell that they are too different."""
    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "u1").reshape(-1, PARTS).astype("i2") for c in ("of_a", "of_b"))
            n = (batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()).astype("f8")
            yield batch.select(["a", "b"]).filter(pa.array(np.abs(x - y).sum(axis=1) <= (1 - similarity) / (1 + similarity) * n + EPSILON))

    of = lambda side: nodes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("histogram").alias(f"of_{side}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(far, "a long, b long")


def _needed_sets(docs: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """``node, shingles`` of the ``needed`` (``node, doc_id, text_hash``), made from their texts, which stay where they are."""
    spot = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(1 << FILTER_BITS))
    words = needed.select(spot.alias("spot")).groupBy(F.shiftright("spot", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot % 64 AS int))")).alias("bits")).toArrow()
    table = np.zeros(1 << (FILTER_BITS - 6), "i8")
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("spot").to_numpy()
            hit = (table[at >> 6] >> (at & 63)) & 1 == 1
            if not hit.any():
                continue
            rows = batch.filter(pa.array(hit))
            for part in blocks(iter([rows]), rows=512):
                sets = [shingles(x.as_py(), size).view("i8") for x in part.column("text")]
                yield from to_batches({"doc_id": part.column("doc_id"), "text_hash": part.column("text_hash"), "shingles": sets},
                                      pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("shingles", pa.list_(pa.int64()))]), 512)
        batch = rows = part = sets = None
        release()

    made = _keyed(docs).withColumn("spot", spot).mapInArrow(read, "doc_id long, text_hash long, shingles array<long>")
    keys = needed.select("node", F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash"))
    met = made.join(keys, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash")))
    return met.select("node", "shingles").dropDuplicates(["node"])


def _compared(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, size: int, similarity: float) -> DataFrame:
    """``a, b`` of ``pairs`` whose whole sets are similar."""
    pairs = materialize(_thinned(pairs, nodes, similarity), "thinned")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    needed = materialize(nodes.select("node", "doc_id", "text_hash").join(wanted, "node"), "needed")
    sets = materialize(_needed_sets(docs, needed, size), "needed-sets")
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a")
    both = both.withColumn("shared", F.size(F.array_intersect("of_a", "of_b")))
    return materialize(both.filter(F.col("shared") >= similarity * (F.size("of_a") + F.size("of_b") - F.col("shared")) - EPSILON).select("a", "b"), "similar")


def tree_pairs(nodes: DataFrame, radius: int = simhash.RADIUS) -> DataFrame:
    """``a, b``: a spanning forest of the ``nodes`` whose ``print`` is within ``radius`` bits, by the vantage-point tree; equal prints hang on one of them."""
    holders = materialize(nodes.groupBy("print").agg(F.min("node").alias("holder")), "prints")
    of = lambda side: holders.select(F.col("print").alias(side), F.col("holder").alias(f"of_{side}"))
    near = simhash.links(holders.select("print"), radius=radius).join(of("a"), "a").join(of("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    equal = nodes.select("node", "print").join(holders, "print").select(F.col("holder").alias("a"), F.col("node").alias("b"))
    return near.unionByName(equal).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar(marked: DataFrame, docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``a, b``: links whose components are those of all pairs of distinct ``node`` of at least ``similarity``.

    ``marked`` is ``prefixes`` of ``docs``, written.
    """
    own = marked.filter("prefix is not null")
    nodes = materialize(own.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash", "print", "n", "histogram")).alias("x")).select("node", "x.*"), "nodes")
    by_print = materialize(tree_pairs(nodes), "tree-pairs")
    close = _compared(by_print, docs, nodes, size, similarity)
    joined = materialize(components(close), "tree-roots")
    # n and the place in the prefix as one number, to keep rows short.
    entries = own.select("node", F.posexplode(F.arrays_zip("prefix", "frequent")).alias("pos", "e"), "n").select(
        F.col("e.prefix").alias("shingle"), F.col("e.frequent").alias("frequent"), "node", (F.col("n").cast("long") * (1 << 32) + F.col("pos")).alias("place"))
    # Shingles the sample does not know have few holders; those of the others are told by a bounded table.
    group = Window.partitionBy("shingle")
    rare = entries.filter("not frequent").drop("frequent").withColumn("first", F.min(F.struct("node", "place")).over(group)).withColumn("top", F.max("node").over(group))
    known = entries.filter("frequent").drop("frequent")
    firsts = known.groupBy("shingle").agg(F.min(F.struct("node", "place")).alias("first"), F.max("node").alias("top"))
    both = rare.unionByName(known.join(firsts, "shingle")).filter(F.col("first.node") < F.col("top"))
    held = materialize(both.select("shingle", "node", "place", F.col("first.node").alias("first"), F.col("first.place").alias("first_place")), "held")

    def parts(place: str | Column) -> tuple[Column, Column]:
        column = F.col(place) if isinstance(place, str) else place
        return F.shiftright(column, 32), column.bitwiseAND(F.lit((1 << 32) - 1))

    star = held.filter((F.col("node") != F.col("first")) & _possible(*parts("place"), *parts("first_place"), similarity))
    star = star.select(F.col("first").alias("a"), F.col("node").alias("b")).distinct().join(by_print, ["a", "b"], "left_anti")
    # What the tree has joined is not tried again.
    rooted = lambda side: joined.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    star = star.join(rooted("a"), "a", "left").join(rooted("b"), "b", "left").filter(~F.col("root_a").eqNullSafe(F.col("root_b")) | F.col("root_a").isNull()).select("a", "b")
    star = materialize(star, "star")
    tried = star.unionByName(by_print)
    near = close.unionByName(_compared(star, docs, nodes, size, similarity))
    roots = materialize(components(near), "roots")
    rooted = held.join(roots, "node", "left").select("shingle", "node", "place", F.coalesce("root", "node").alias("root"))
    apart = rooted.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("shingle")
    open_ = materialize(rooted.join(apart, "shingle").distinct(), "apart")
    x, y = open_.alias("x"), open_.alias("y")
    more = x.join(y, F.col("x.shingle") == F.col("y.shingle")).filter((F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")))
    more = more.filter(_possible(*parts("x.place"), *parts("y.place"), similarity)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    more = materialize(more.distinct().join(tried, ["a", "b"], "left_anti"), "more")
    return near.unionByName(_compared(more, docs, nodes, size, similarity))


def one_of_each(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, unchanged, less all but one of each component of near copies.

    Two texts are linked if their sets of ``size``-word shingles have a Jaccard
    similarity of at least ``similarity``; texts without a word are all alike. The row with the
    component's least ``doc_id`` stays; of several such rows the one with the least hash of its text, and of rows equal in
    both one. A component of null ids only keeps its row of the least hash. An empty table gives an empty one.
    """
    marked = materialize(prefixes(docs, size, similarity), "prefixes")
    roots = materialize(components(similar(marked, docs, size, similarity)), "classes")
    rooted = marked.select("doc_id", "text_hash", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    order = F.struct(F.col("doc_id").isNull().alias("k0"), F.coalesce("doc_id", F.lit(0)).alias("k1"), F.col("text_hash").alias("k2"))
    chosen = materialize(rooted.groupBy("root").agg(F.min(order).alias("w")).select("w.*"), "kept")
    # Texts are shuffled once: rows equal in id and text meet where their key was joined.
    keyed = docs.withColumns({"k0": F.col("doc_id").isNull(), "k1": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "k2": F.xxhash64("text")})
    return keyed.join(chosen, ["k0", "k1", "k2"], "left_semi").dropDuplicates(["k0", "k1", "k2"]).select(docs.columns)
