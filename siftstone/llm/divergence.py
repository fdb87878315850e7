"""How far sources of one language lie apart in their words.

Words are counted per block of texts in the tasks that read them, so a shuffle
sees sums only. The matrix of groups (sources of a language) and kept terms is
cut into tiles of a bounded size. A tile is a quadtree: quadrants without a
count are not divided. Two groups are walked through together: a quadrant empty in both is
priced by its number of columns, since all its cells have the share of an
absent term; where a count is left, single cells are compared.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.session import materialize

from .common import blocks, whole_text

#: Bytes that part terms become blanks, A-Z become a-z; bytes of other characters stay.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
SCALE = 1_000_000_000
#: Groups and terms of a language in a tile (two halves of groups); both are dealt by hashes, so sizes are expected ones.
TILE_GROUPS, TILE_TERMS = 32, 1024


def count_terms(docs: DataFrame) -> DataFrame:
    """``lang, source, term, count, docs`` of blocks of texts: partial sums; ``docs`` is the number of texts that hold the term.

    A row with a null term stands for its group.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], whole_text().cast("binary").alias("text"))
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("count", pa.int64()), ("docs", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, size=4 << 20):
            held: dict[tuple, list[list[bytes]]] = defaultdict(list)
            for lang, source, text in zip(*[part.column(c).to_pylist() for c in ("lang", "source", "text")]):
                held[lang, source].append(text.translate(LETTERS).split())
            for (lang, source), words in held.items():
                counts, holders = Counter(chain.from_iterable(words)), Counter(chain.from_iterable(map(set, words)))
                n = len(counts) + 1
                yield pa.RecordBatch.from_pydict({"lang": [lang] * n, "source": [source] * n, "term": pa.array([None, *counts], pa.binary()).cast(pa.string()), "count": [0, *counts.values()],
                                                  "docs": [0, *map(holders.__getitem__, counts)]}, schema)

    return rows.mapInArrow(read, "lang string, source string, term string, count long, docs long")


def _share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (count + 5) / (total + 5 * terms))``, exact; null without terms."""
    wide = lambda c: c.cast("decimal(28,0)")
    scaled = (wide(count) + 5) * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", scaled, wide(total + 5 * terms)) + 1


def _occupied(p: np.ndarray) -> list[np.ndarray]:
    """The quadtree of ``p``: whether a quadrant holds a cell, from single cells up."""
    levels = [p > 0]
    while max(levels[-1].shape) > 1:
        below = levels[-1]
        padded = np.zeros(tuple(-(-s // 2) * 2 for s in below.shape), bool)
        padded[: below.shape[0], : below.shape[1]] = below
        levels.append(padded.reshape(padded.shape[0] // 2, 2, padded.shape[1] // 2, 2).any(axis=(1, 3)))
    return levels


def tile_distances(p: np.ndarray, absent_p: np.ndarray, q: np.ndarray, absent_q: np.ndarray) -> np.ndarray:
    """The sum over columns of ``|p - q|`` for each row of ``p`` with each of ``q``; cells of zero have the row's absent share."""
    n, m, columns = len(p), len(q), p.shape[1]
    height = max(n, m, columns, 1)
    height = max(1, (height - 1).bit_length() + 1)
    tree_p, tree_q = _occupied(p), _occupied(q)
    for tree in (tree_p, tree_q):
        tree.extend([tree[-1]] * (height - len(tree)))
    sums, empty = np.zeros(n * m), np.zeros((n, m), "i8")
    a = b = c = np.zeros(1, "i8")
    for level in range(height - 1, -1, -1):
        used = tree_p[level][a, c] | tree_q[level][b, c]
        size = 1 << level
        for i, j, k in zip(a[~used].tolist(), b[~used].tolist(), c[~used].tolist()) if level else ():
            empty[i * size : (i + 1) * size, j * size : (j + 1) * size] += min(columns, (k + 1) * size) - k * size
        if not level:
            empty += np.bincount(a[~used] * m + b[~used], minlength=n * m).reshape(n, m)
        a, b, c = a[used], b[used], c[used]
        if level:
            bits = np.arange(8)
            a, b, c = ((2 * x[:, None] + (bits >> s & 1)).ravel() for x, s in ((a, 2), (b, 1), (c, 0)))
            half = size >> 1
            inside = (a * half < n) & (b * half < m) & (c * half < columns)
            a, b, c = a[inside], b[inside], c[inside]
    left, right = p[a, c], q[b, c]
    left, right = np.where(left > 0, left, absent_p[a]), np.where(right > 0, right, absent_q[b])
    # Sums of at most 2^53 are exact in doubles: TILE_TERMS shares of at most 10^9 + 1.
    sums += np.bincount(a * m + b, weights=np.abs(left - right).astype("f8"), minlength=n * m)
    return sums.astype("i8").reshape(n, m) + empty * np.abs(absent_p[:, None] - absent_q[None, :])


def _tile(rows: pd.DataFrame) -> pd.DataFrame:
    """Partial distances of the groups of one tile: ``lang, source, other, value, columns``."""
    real = rows["term"].notna().to_numpy()
    column = np.full(len(rows), -1)
    terms, column[real] = np.unique(rows["term"].to_numpy()[real].astype(str), return_inverse=True)
    width = len(terms)

    def half(own: np.ndarray):
        names, row = np.unique(rows["source"].to_numpy()[own], return_inverse=True)
        p, absent = np.zeros((len(names), width), "i8"), np.zeros(len(names), "i8")
        held = real[own]
        p[row[held], column[own][held]] = rows["p"].to_numpy()[own][held]
        absent[row] = rows["absent"].to_numpy()[own]
        return names, p, absent

    left = rows["left"].to_numpy(bool)
    same = rows["a"].iloc[0] == rows["b"].iloc[0]
    names, p, absent_p = half(left)
    others, q, absent_q = (names, p, absent_p) if same else half(~left)
    # A half of a tile may have no group, and all of them no term in its strip.
    value = tile_distances(p, absent_p, q, absent_q) if p.size and q.size else np.zeros((len(names), len(others)), "i8")
    i, j = np.nonzero(np.triu(np.ones(value.shape, bool), 1) if same else np.ones(value.shape, bool))
    return pd.DataFrame({"lang": rows["lang"].iloc[0], "source": names[i], "other": others[j], "value": value[i, j], "columns": width})


def pair_distances(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, other, value`` for each ordered pair of sources of a language.

    ``cells``: ``lang, source, term, p`` where a group has the term; ``groups``: ``lang, source,
    absent, terms``, the share of a term it has not, and the language's number of kept terms.
    """
    sizes = groups.groupBy("lang").agg(F.ceil(F.count("*") / TILE_GROUPS).cast("int").alias("bands"), F.ceil(F.max("terms") / TILE_TERMS).cast("int").alias("strips"))
    dealt = cells.join(groups.select("lang", "source", "absent"), ["lang", "source"]).join(sizes, "lang")
    dealt = dealt.withColumn("strip", F.pmod(F.xxhash64("term"), F.col("strips")).cast("int"))
    # A group stands in every strip, also where it has no term: others have some there.
    stands = groups.filter("terms > 0").join(sizes, "lang").select("lang", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("p"), "absent", "bands", "strips",
                                                                   F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("strip"))
    dealt = dealt.unionByName(stands).withColumn("band", F.pmod(F.xxhash64("source"), F.col("bands")).cast("int"))
    # A band meets itself and each other band once: as the left half with later ones, as the right half with earlier ones.
    met = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("bands") - 1)))
    met = met.select("lang", "source", "term", "p", "absent", "strip", F.least("band", "with").alias("a"), F.greatest("band", "with").alias("b"), (F.col("band") <= F.col("with")).alias("left"))
    parts = met.groupBy("lang", "strip", "a", "b").applyInPandas(_tile, "lang string, source string, other string, value long, columns long")
    sums = parts.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"), F.sum("columns").alias("columns"))
    both = sums.unionByName(sums.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value", "columns"))
    x = groups.select("lang", "source", "absent", "terms")
    y = groups.select("lang", F.col("source").alias("other"), F.col("absent").alias("absent_of_other"))
    every = x.join(y, "lang").filter("source <> other").join(both, ["lang", "source", "other"], "left")
    # Columns that no tile of the pair had are empty in both groups.
    rest = (F.col("terms") - F.coalesce("columns", F.lit(0))) * F.abs(F.col("absent") - F.col("absent_of_other"))
    return every.select("lang", "source", "other", F.coalesce(F.coalesce("value", F.lit(0)) + rest, F.lit(0)).cast("long").alias("value"))


def audit_sources(docs: DataFrame, least_docs: int = 30, most_ranks: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every group of documents of equal ``lang`` and ``source``.

    Part ``pair`` ranks the other sources of the language by their distance, part ``term`` the terms
    that a source has more of than its language. Null text, lang and source are empty ones; repeated rows count
    each; other columns are ignored. A language without a kept term has pairs of
    distance 0 and no terms. An empty table gives an empty one.
    """
    counted = materialize(count_terms(docs).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")), "terms")
    of_lang = counted.filter("term is not null").groupBy("lang", "term").agg(F.sum("count").alias("lang_count"), F.sum("docs").alias("docs"))
    kept = materialize(of_lang.filter(F.col("docs") >= least_docs).drop("docs"), "kept-terms")
    cells = materialize(counted.drop("docs").join(kept, ["lang", "term"]), "cells")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_count").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = counted.filter("term is null").select("lang", "source").join(langs, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["terms", "total", "lang_total"])
    absent = F.when(F.col("terms") > 0, _share(F.lit(0), F.col("total"), F.col("terms")))
    groups = materialize(groups.withColumn("absent", absent), "groups")
    priced = cells.join(groups.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"])
    priced = materialize(priced.select("lang", "source", "term", _share(F.col("count"), F.col("total"), F.col("terms")).alias("p"),
                                       _share(F.col("lang_count"), F.col("lang_total"), F.col("terms")).alias("q")), "shares")
    pairs = pair_distances(priced.drop("q"), groups).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    terms = priced.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", order).unionByName(terms.withColumn("rank", order).filter(F.col("rank") <= most_ranks))
