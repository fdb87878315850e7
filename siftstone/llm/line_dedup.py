"""Line dedup by a deletion neighbourhood, in DataFrame functions only.

Lines at edit distance 1 share a variant: delete the character in which they
differ, or the one that only the longer has. All variants of all lines would
be a hash per character, so the neighbourhood is narrowed first: delete a half
of a line, then a sixteenth of that half, and keep on only where another line
shares what is left. The last step emits the single deletions inside the windows
that remain. Nothing is lost, because two lines within the bound agree outside
any window that holds their difference.

Lines are counted before they are shuffled by text, keys are counted before they
are joined, and a variant's group gives its earliest line, never its pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.session import materialize

BLANKS = " \t\r"
PARTS = 16


def _deleted(text: Column, start: Column, width: Column) -> tuple[Column, Column]:
    """What is left and right of a window."""
    return F.substring(text, F.lit(1), start), F.substring(text, start + width + 1, F.length(text))


def _window_key(text: Column, base: Column, start: Column, width: Column) -> Column:
    """Hash of a line without a window in the coordinates of ``base`` characters; a line one longer has one more in it."""
    left, right = _deleted(text, start, width + F.length(text) - base)
    return F.xxhash64(base, start, width, left, right)


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose ``key`` another line has too."""
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    return rows.join(counts, "key", "left_semi")


def _lines(docs: DataFrame) -> DataFrame:
    """``doc_id, doc_hash, pos, line`` of every line that is not blank."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("doc_hash"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.withColumn("line", F.btrim("line", F.lit(BLANKS))).filter("line <> ''")


def _distinct(lines: DataFrame, min_chars: int) -> DataFrame:
    """A row per distinct line: hashes, first place, number, and the keys of its halves if it is long enough."""
    size = F.length("line")
    keys = [(base, F.lit(0), F.floor(base / 2).cast("int")) for base in (size, size - 1)]
    keys += [(base, F.floor(base / 2).cast("int"), (base - F.floor(base / 2)).cast("int")) for base in (size, size - 1)]
    halves = F.when(size >= min_chars, F.array(*(_window_key(F.col("line"), *x) for x in keys)))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "doc_hash", "pos")
    return lines.select(F.xxhash64("line").alias("h"), F.xxhash64("line", F.lit(1)).alias("h2"), place.alias("place"), halves.alias("halves")).groupBy("h", "h2").agg(
        F.min("place").alias("first"), F.count("*").alias("n"), F.any_value("halves").alias("halves"))


def _near(lines: DataFrame, distinct: DataFrame, min_chars: int, broadcast_rows: int) -> DataFrame:
    """``h, h2`` of lines with an earlier line at edit distance 1."""
    # A half that another line has too: four keys per line (two lengths, two halves).
    half_keys = distinct.filter("halves is not null").select("h", F.posexplode("halves").alias("half", "key"))
    windows = materialize(_shared(half_keys).select("h", "half"), "half-windows")
    wanted = windows.select("h").distinct()
    if wanted.count() <= broadcast_rows:
        wanted = F.broadcast(wanted)
    # The text of these lines, once each.
    texts = lines.filter(F.length("line") >= min_chars).withColumn("h", F.xxhash64("line")).join(wanted, "h", "left_semi")
    texts = materialize(texts.groupBy("h", "line").agg(F.count("*").alias("n")).drop("n").join(distinct.select("h", "h2", "first"), "h").filter(F.xxhash64("line", F.lit(1)) == F.col("h2")), "near-texts")
    base = F.length("line") - F.when(F.col("half") % 2 == 1, 1).otherwise(0)
    second = F.col("half") >= 2
    middle = F.floor(F.col("base") / 2).cast("int")
    of_half = texts.join(windows, "h").withColumn("base", base).withColumn("start", F.when(second, middle).otherwise(0)).withColumn("width", F.when(second, F.col("base") - middle).otherwise(middle))
    edge = lambda i: F.floor(F.col("width") * i / PARTS).cast("int")
    parts = of_half.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).withColumn("from", F.col("start") + edge(F.col("i"))).withColumn("to", F.col("start") + edge(F.col("i") + 1)).filter("from < to")
    part_keys = parts.select("h", "h2", "base", F.col("from").alias("start"), (F.col("to") - F.col("from")).alias("width"), _window_key(F.col("line"), F.col("base"), F.col("from"), F.col("to") - F.col("from")).alias("key"))
    fine = materialize(_shared(part_keys).drop("key"), "part-windows")
    # Single deletions in what remains, and the line itself as the variant of a longer one.
    own = fine.join(texts, ["h", "h2"])
    last = F.col("start") + F.col("width") - 1 + F.length("line") - F.col("base")
    spots = F.when(F.length("line") == F.col("base"), F.concat(F.array(F.lit(-1)), F.sequence(F.col("start"), last))).otherwise(F.sequence(F.col("start"), last))
    variants = own.select("h", "h2", "first", "line", F.explode(spots).alias("spot"))
    left, right = _deleted(F.col("line"), F.col("spot"), F.lit(1))
    variants = variants.select("h", "h2", "first", "spot", F.when(F.col("spot") < 0, F.xxhash64("line")).otherwise(F.xxhash64(F.concat(left, right))).alias("variant")).distinct()
    variants = materialize(variants, "variants")
    # Lines that lose the same character in the same place differ in it alone, so the earliest stands for all.
    winner = F.min(F.struct(F.col("first"), F.col("h"), F.col("h2"))).alias("w")
    deleted, whole = variants.filter("spot >= 0"), variants.filter("spot < 0")
    found = [deleted.join(deleted.groupBy("variant", "spot").agg(winner), ["variant", "spot"]),
             deleted.join(whole.groupBy("variant").agg(winner), "variant"),
             whole.join(deleted.groupBy("variant").agg(winner), "variant")]
    pairs = [x.filter(F.col("w.first") < F.col("first")).select("h", "h2", F.col("w.h").alias("wh"), F.col("w.h2").alias("wh2")) for x in found]
    pairs = pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).distinct()
    other = texts.select(F.col("h").alias("wh"), F.col("h2").alias("wh2"), F.col("line").alias("earlier"))
    checked = pairs.join(texts.select("h", "h2", "line"), ["h", "h2"]).join(other, ["wh", "wh2"])
    return checked.filter(F.levenshtein("line", "earlier") == 1).select("h", "h2").distinct()


def dedup_lines(docs: DataFrame, bound: int = 1, min_chars: int = 32, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``docs`` with ``text`` less every line that an earlier line equals or nearly equals.

    Lines end at a line feed and are compared without blanks around them. A
    line goes if one at edit distance ``bound`` (0 or 1) or less is earlier in
    the order of ``doc_id`` and line, whether or not that one stays; lines of fewer
    than ``min_chars`` characters have to be equal. Blank lines stay. All
    columns and rows come back: a null text stays null, an empty one empty,
    and a text of copies only becomes empty. Null ids come after all others.
    Rows equal in ``doc_id`` and ``text`` are one occurrence and keep the
    same lines. Beyond ``broadcast_rows`` lines with a near half, their texts
    are joined by a shuffle.
    """
    if bound not in (0, 1):
        raise ValueError(f"bound is 0 or 1, not {bound}")
    names = docs.columns
    lines = _lines(docs.select("doc_id", "text"))
    distinct = materialize(_distinct(lines, min_chars), "distinct-lines")
    marked = distinct.withColumn("near", F.lit(False))
    if bound:
        near = materialize(_near(lines, distinct, min_chars, broadcast_rows), "near-lines").withColumn("hit", F.lit(True))
        marked = distinct.join(near, ["h", "h2"], "left").withColumn("near", F.coalesce("hit", F.lit(False)))
    affected = marked.filter("near or n > 1").select("h", "h2", "first", "near")
    places = lines.select(F.xxhash64("line").alias("h"), F.xxhash64("line", F.lit(1)).alias("h2"), "doc_id", "doc_hash", "pos").join(affected, ["h", "h2"])
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("doc_hash") == F.col("first.doc_hash")) & (F.col("pos") == F.col("first.pos"))
    gone = places.filter(F.col("near") | ~same).groupBy(F.col("doc_id").alias("gone_id"), F.col("doc_hash").alias("gone_hash")).agg(F.collect_set("pos").alias("gone_at"))
    parts = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone_at"))
    text = F.when(F.col("gone_at").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n"))
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(F.col("gone_id")) & (F.xxhash64(docs["text"]) == F.col("gone_hash")), "left")
    return joined.select(*(text.alias(x) if x == "text" else docs[x] for x in names))
