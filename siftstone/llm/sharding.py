"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Copies of a text form a group that goes to one shard, unless the group is so
large that no balance would be left: it is cut into parts by row. The largest
groups, of bounded number by their share of the whole, are packed first by one
task over all shards; the rest is dealt into cells of a bounded expected number
of groups, and each cell packs its own against its share of what the shards have
left. Either way a group goes where the dot product of its size and the
residual capacity is greatest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftstone.session import materialize

MEASURES = ("bytes", "tokens", "rows")


def place(sizes: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """The shard of each row of ``sizes`` (groups x measures), largest first.

    ``capacity`` (shards x measures) is what the shards have left; it is
    scaled to the sum of ``sizes``, so that all of it is used. Ties go to the
    lowest shard.
    """
    total = sizes.sum(axis=0)
    left = np.maximum(capacity, 0)
    left = left * np.where(left.sum(axis=0) > 0, total / np.maximum(left.sum(axis=0), 1e-300), 0)
    scale = np.where(total > 0, 1 / np.maximum(total, 1e-300), 0)
    need, free = sizes * scale, left * scale
    chosen = np.zeros(len(sizes), "i8")
    for i in np.argsort(-need.max(axis=1), kind="stable"):
        # The excess over what is free counts against a shard before the dot product.
        over = np.maximum(need[i] - free, 0).sum(axis=1)
        fits = over <= 1e-12
        scores = free @ need[i]
        best = int(np.argmax(np.where(fits, scores, -np.inf))) if fits.any() else int(np.argmin(over - 1e-3 * scores))
        chosen[i] = best
        free[best] -= need[i]
    return chosen


def shard_groups(groups: DataFrame, shards: int, share: int = 512, cell_groups: int = 20_000) -> DataFrame:
    """``group_key, part, shard`` for groups with ``bytes``, ``tokens`` and ``rows``.

    A group of over 1/``share`` of a shard in some measure is large; there are
    at most 3 x ``shards`` x ``share`` of them, each cut into parts of at most
    an eighth of a shard. ``parts`` tells how many parts a group has; the rows
    of a group are to be dealt to them evenly.
    """
    totals = groups.agg(*(F.sum(m).cast("double").alias(m) for m in MEASURES), F.count("*").alias("n")).first()
    if not totals["n"]:
        return groups.select("group_key", F.lit(1).alias("parts"), F.lit(0).alias("part"), F.lit(0).alias("shard"))
    mean = {m: max((totals[m] or 0.0) / shards, 1.0) for m in MEASURES}
    relative = F.greatest(*(F.col(m) / mean[m] for m in MEASURES))
    groups = groups.withColumn("parts", F.least(F.ceil(relative * 8), F.col("rows")).cast("int"))
    large = groups.filter(relative > 1 / share)
    small = groups.filter(relative <= 1 / share)
    cells = max(1, -(-totals["n"] // cell_groups))
    kind = "group_key string, parts int, part int, shard int, bytes double, tokens double, rows double"
    even = np.tile([mean[m] for m in MEASURES], (shards, 1))

    def pack_large(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["group_key", "part"])
        return group.assign(shard=place(group[list(MEASURES)].to_numpy("f8"), even))[["group_key", "parts", "part", "shard", *MEASURES]]

    cut = large.select("group_key", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                       *((F.col(m) / F.col("parts")).alias(m) for m in MEASURES))
    placed = materialize(cut.groupBy(F.lit(0).alias("all")).applyInPandas(pack_large, kind), "large-groups")
    # One row per shard at most.
    taken = {row["shard"]: row for row in placed.groupBy("shard").agg(*(F.sum(m).alias(m) for m in MEASURES)).collect()}
    left = np.array([[mean[m] - (taken[s][m] if s in taken else 0) for m in MEASURES] for s in range(shards)])

    def pack_small(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("group_key")
        return group.assign(part=0, shard=place(group[list(MEASURES)].to_numpy("f8"), left))[["group_key", "parts", "part", "shard"]]

    dealt = small.withColumn("cell", F.pmod(F.xxhash64("group_key"), F.lit(cells)))
    rest = dealt.groupBy("cell").applyInPandas(pack_small, "group_key string, parts int, part int, shard int")
    return placed.select("group_key", "parts", "part", "shard").unionByName(rest)


def shard_documents(docs: DataFrame, shards: int = 24, slot_rows: int = 20_000, exact_rows: int = 500) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` with sizes, tokens and rows near equal over the shards.

    The size of a document is its bytes in UTF-8 plus 8; a null text has none
    and groups with empty ones. Equal texts share a shard unless their group is
    large (see ``shard_groups``). ``slot`` counts the rows of a shard from 0
    without gaps. Null ids and repeated rows are rows like any other; further
    columns are ignored. An empty table gives an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    words = F.length("text") - F.length(F.translate(F.col("text"), " \n\t\r", "")) + 1
    rows = materialize(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.coalesce(words, F.lit(0)).cast("long").alias("tokens"), F.sha2(text, 256).alias("group_key")), "sizes")
    groups = materialize(rows.groupBy("group_key").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")), "groups")
    shard_of = materialize(shard_groups(groups, shards), "shards")
    numbered = rows.withColumn("deal", F.xxhash64("doc_id", F.monotonically_increasing_id()))
    # Rows of a cut group: parts of few rows are dealt in turn, in a window of bounded size; larger ones come out even by a hash.
    cut = groups.join(shard_of.filter("part = 0").select("group_key", "parts"), "group_key").select("group_key", "parts", (F.col("rows") < exact_rows * F.col("parts")).alias("few"))
    owned = numbered.join(cut, "group_key")
    whole = owned.filter("parts = 1").withColumn("part", F.lit(0))
    hashed = owned.filter("parts > 1 and not few").withColumn("part", F.pmod("deal", F.col("parts")).cast("int"))
    turn = F.row_number().over(Window.partitionBy("group_key").orderBy("deal", "doc_id"))
    in_turn = owned.filter("parts > 1 and few").withColumn("part", F.pmod(turn, F.col("parts")).cast("int"))
    dealt = whole.unionByName(hashed).unionByName(in_turn)
    placed = dealt.join(shard_of.drop("parts"), ["group_key", "part"])
    cells = max(1, -(-rows.count() // slot_rows))
    placed = materialize(placed.select("doc_id", "size", "text_crc32", "shard", "deal", F.pmod("deal", F.lit(cells)).alias("cell")), "placed")
    # Slots: those of earlier cells of the shard first, then the order in the cell.
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = counts.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "deal", "text_crc32")) - 1
    return placed.withColumn("within", within).join(before, ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("within")).alias("slot"))
