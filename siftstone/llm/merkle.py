"""A Merkle manifest of a table: digests of rows, trees per source, proofs by pointer jumping.

Rows of a source are leaves in the order of their ids. Runs of ``fanout``
consecutive nodes become one node until one is left, the source's subroot;
subroots become the root in the same way. Every node above the leaves points to
an ancestor and holds the siblings on the way there. A self-join takes each
node to its ancestor's ancestor and appends the ancestor's segment, so the
distance doubles until all have come to the root. Leaves of a run share what is
above it, so a run travels as one row and its leaves add their own siblings at the end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The key of the tree of subroots; keys of sources are never empty.
TOP = ""
STEP = "struct<before:string,after:string>"


def field(value: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaves(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id", source: str = "source",
           tampered: Column | None = None, text: str = "text", share: int = 5) -> DataFrame:
    """``key, source, leaf, tampered_leaf``; the last is null where the row is left alone."""
    changed = F.translate(F.col(text), UPPER, LOWER)
    hit = F.crc32(F.col(key).cast("string").cast("binary")) % share == 0 if tampered is None else tampered
    other = digest(*[field(changed if c == text else F.col(c)) for c in columns])
    return docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), digest(*[field(F.col(c)) for c in columns]).alias("leaf"),
                       F.when(hit, other).alias("tampered_leaf"))


def numbered(rows: DataFrame, group: list[str], order: list[str], part_rows: int) -> DataFrame:
    """``rows`` with ``pos``, from 0 in each group, and the group's number of rows ``n``; groups and rows ascend, nulls first.

    ``rows`` is a written table. Rows are sorted in ranges; what precedes a range in its group
    is added up over ranges, so no group is gathered, however large.
    """
    parts = max(1, -(-rows.count() // part_rows))
    placed = rows.repartitionByRange(parts, *group, *order).sortWithinPartitions(*group, *order).withColumn("place", F.monotonically_increasing_id())
    placed = materialize(placed.withColumn("range", F.shiftright("place", 33)), "placed")
    counts = placed.groupBy(*group, "range").agg(F.min("place").alias("first"), F.count("*").alias("c"))
    own = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    offsets = counts.withColumn("n", F.sum("c").over(own)).withColumn("before", F.sum("c").over(own.orderBy("range")) - F.col("c"))
    offsets = offsets.select(*[F.col(g).alias(f"{g}_of") for g in group], F.col("range").alias("range_of"), "first", "before", "n")
    same = F.col("range") == F.col("range_of")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"{g}_of"))
    joined = placed.join(offsets, same)
    return joined.select(*rows.columns, (F.col("place") - F.col("first") + F.col("before")).alias("pos"), "n")


def _runs(nodes: DataFrame, fanout: int, kept: list[str]) -> DataFrame:
    """``tree, pos, n, members``: runs of nodes in the order of ``pos``; ``n`` is the number of nodes of the tree's level."""
    member = F.struct((F.col("pos") % fanout).cast("int").alias("slot"), *kept)
    return nodes.groupBy("tree", F.floor(F.col("pos") / fanout).cast("long").alias("pos"), "n").agg(F.array_sort(F.collect_list(member)).alias("members"), F.sum("size").alias("size"))


def _joined(digests: Column, start: Column | int = 1, length: Column | int = 1 << 30) -> Column:
    return F.array_join(F.slice(digests, start, length), "")


def _siblings(digests: Column, slot: Column) -> Column:
    """The step of the node at ``slot`` (from 0): the digests before and after it in its run."""
    return F.struct(_joined(digests, F.lit(1), slot).alias("before"), _joined(digests, slot + F.lit(2), F.greatest(F.size(digests) - slot - 1, F.lit(0))).alias("after"))


def _tree(nodes: DataFrame, level: int, fanout: int) -> tuple[DataFrame | None, DataFrame, int]:
    """Links of nodes to their parents; ``tree, digest, size, level`` of the last node of each tree; the highest level.

    ``nodes``: ``tree, pos, n, digest, size`` of one level of all trees.
    """
    links, ends = None, None
    while True:
        end = nodes.filter("n = 1").select("tree", "digest", "size", F.lit(level).alias("level"))
        ends = end if ends is None else ends.unionByName(end)
        nodes = nodes.filter("n > 1")
        if nodes.isEmpty():
            return links, ends, level
        runs = materialize(_runs(nodes, fanout, ["digest"]), "runs")
        digests = F.col("members.digest")
        each = runs.select("tree", "pos", "size", digests.alias("digests"), F.explode("members").alias("m"))
        own = each.select("tree", F.lit(level).alias("level"), (F.col("pos") * fanout + F.col("m.slot")).alias("pos"), F.col("tree").alias("to_tree"),
                          F.lit(level + 1).alias("to_level"), F.col("pos").alias("to_pos"), F.col("size").alias("to_size"),
                          F.array(_siblings(F.col("digests"), F.col("m.slot"))).alias("segment"))
        links = own if links is None else links.unionByName(own)
        level += 1
        nodes = materialize(runs.select("tree", "pos", F.ceil(F.col("n") / fanout).cast("long").alias("n"), digest(_joined(digests)).alias("digest"), "size"), "nodes")


def _jump(links: DataFrame, height: int, below: int) -> DataFrame:
    """``tree, pos, segment``: of each node of level 1, the siblings on its whole way up."""
    links = materialize(links, "links")
    steps = max(0, math.ceil(math.log2(max(1, height))))
    for step in range(steps):
        left = links.filter("level = 1") if step == steps - 1 else links
        # An ancestor of many leaves has copies, so that no key of the join is held by more than about ``below`` leaves.
        copies = F.ceil(F.col("to_size") / below).cast("int")
        salted = left.withColumn("salt", F.pmod(F.xxhash64("tree", "level", "pos"), copies).cast("int"))
        sizes = links.groupBy("to_tree", "to_level", "to_pos").agg(F.first("to_size").alias("size")).withColumnsRenamed({"to_tree": "tree", "to_level": "level", "to_pos": "pos"})
        above = links.join(sizes, ["tree", "level", "pos"]).select(
            *[F.col(c).alias(f"a_{c}") for c in ("tree", "level", "pos", "to_tree", "to_level", "to_pos", "to_size", "segment")],
            F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / below).cast("int") - 1)).alias("a_salt"))
        met = salted.join(above, (F.col("to_tree") == F.col("a_tree")) & (F.col("to_level") == F.col("a_level")) & (F.col("to_pos") == F.col("a_pos")) & (F.col("salt") == F.col("a_salt")), "left")
        further = {c: F.coalesce(f"a_{c}", c) for c in ("to_tree", "to_level", "to_pos", "to_size")}
        further["segment"] = F.when(F.col("a_tree").isNull(), F.col("segment")).otherwise(F.concat("segment", "a_segment"))
        links = materialize(met.select("tree", "level", "pos", *[c.alias(name) for name, c in further.items()]), "jumped")
    return links.filter("level = 1").select("tree", "pos", "segment")


def manifest(rows: DataFrame, fanout: int = 16, part_rows: int = 500_000, below: int = 65_536) -> DataFrame:
    """``key, source, leaf, tampered_leaf, subroot, root, proof`` for each row of ``leaves``.

    ``proof`` is an array of steps from the leaf to the root, each with the joined digests
    ``before`` and ``after`` the node in its run; a run of one gives a step with none, a lone node
    gives no step. Null keys come first, rows with equal keys by their leaf, repeated rows are leaves each.
    A null source is a source of its own, before all others. An empty table gives an empty one.
    """
    rows = materialize(rows, "leaves")
    tree = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit(":"), F.col("source")))
    placed = numbered(rows, ["source"], ["key", "leaf"], part_rows).withColumn("tree", tree)
    # Level 1: runs of leaves. A lone leaf is its source's subroot itself.
    kept = ["key", "source", "leaf", "tampered_leaf"]
    runs = materialize(_runs(placed.withColumn("size", F.lit(1)), fanout, kept), "leaf-runs")
    own = F.when(F.col("n") == 1, F.col("members")[0]["leaf"]).otherwise(digest(_joined(F.col("members.leaf"))))
    nodes = materialize(runs.select("tree", "pos", F.ceil(F.col("n") / fanout).cast("long").alias("n"), own.alias("digest"), "size"), "nodes")
    links, ends, height = _tree(nodes, 1, fanout)
    ends = materialize(ends, "subroots")
    # Sources in order: "-" stands before ":", and names go on bytewise.
    tops = numbered(ends, [], ["tree"], part_rows)
    upper, root, top = _tree(tops.select(F.lit(TOP).alias("tree"), "pos", "n", "digest", "size"), 0, fanout)
    found = root.select("digest").first()
    if found is None:
        return runs.select(F.explode("members").alias("m")).select("m.*", F.lit("").alias("subroot"), F.lit("").alias("root"), F.array().cast(f"array<{STEP}>").alias("proof")).drop("slot")
    if upper is not None:
        # Nodes of level 0 of the upper tree are the subroots, which have a level and place in their own.
        named = tops.select(F.col("tree").alias("of"), F.col("level").alias("of_level"), F.col("pos").alias("of_pos"))
        low = upper.filter("level = 0").join(named, F.col("pos") == F.col("of_pos"))
        low = low.select(F.col("of").alias("tree"), F.col("of_level").alias("level"), F.lit(0).cast("long").alias("pos"), "to_tree", "to_level", "to_pos", "to_size", "segment")
        upper = low.unionByName(upper.filter("level > 0"))
        links = upper if links is None else links.unionByName(upper)
    above = _jump(links, height + top, below) if links is not None else None
    # Subroots come to the runs of their source in copies for every so many runs.
    wide = max(1, below // fanout)
    parts = F.floor(F.col("pos") / wide)
    subroots = ends.select(F.col("tree").alias("of"), F.col("digest").alias("subroot"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / (wide * fanout)).cast("long"))).alias("of_part"))
    full = runs.join(subroots, (F.col("tree") == F.col("of")) & (parts == F.col("of_part")))
    if above is not None:
        full = full.join(above, ["tree", "pos"], "left")
    rest = F.coalesce("segment", F.array().cast(f"array<{STEP}>")) if above is not None else F.array().cast(f"array<{STEP}>")
    each = full.select(F.col("members.leaf").alias("run"), "n", "subroot", rest.alias("rest"), F.explode("members").alias("m"))
    first = F.array(_siblings(F.col("run"), F.col("m.slot")))
    proof = F.when(F.col("n") == 1, F.col("rest")).otherwise(F.concat(first, F.col("rest")))
    return each.select(*[F.col(f"m.{c}") for c in kept], "subroot", F.lit(found.digest).alias("root"), proof.alias("proof"))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``proof`` give."""
    return F.aggregate(proof, leaf, lambda node, step: digest(step["before"], node, step["after"]))


def audited_manifest(docs: DataFrame, fanout: int = 16, **sizes) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every document.

    About a fifth of the documents, chosen by their id, are tampered with: ``text`` loses its capitals.
    ``folded_root`` is what their leaf gives with the untampered siblings. See ``manifest`` for nulls, ties and repeated rows;
    other columns are ignored.
    """
    each = manifest(leaves(docs), fanout, **sizes)
    proof = digest(F.array_join(F.transform("proof", lambda step: F.concat(step["before"], step["after"])), ""))
    folded = fold(F.coalesce("tampered_leaf", "leaf"), F.col("proof"))
    rows = each.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
