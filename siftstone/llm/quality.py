"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over characters: its n-grams (four by default) tell shouting, tables,
markup and noise from prose. All trusted documents are counted. Counts and
their sums by context are tables keyed by n-gram, and probabilities come from
joins with them, shard by shard. What is joined are the distinct n-grams of a
block of documents, so a frequent one is a row per block; the answers go
back to their block, where each document's sum is taken. A document is
rejected outside a low and a high limit from its language's quantiles of trusted
perplexities. A word over and over is not improbable by characters, so the pairs of
words that a document has had before are counted too, with a limit of their own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.session import materialize

from .common import block_ids, blocks, release, to_batches, whole_text

BEGIN, END = "\x02", "\x03"
BLOCK = {"rows": 16_384, "size": 16 << 20}
#: Hash tables of n-grams begin this small and grow with the distinct ones; else they begin with room for every position.
HINT = 1 << 14


def pieces(texts: list[str], order: int, size: int = 1 << 20, together: int = 1 << 19) -> Iterator[tuple[list[str], np.ndarray]]:
    """Padded texts and their numbers, about ``together`` characters at a time; a text longer than ``size`` comes in overlapping pieces."""
    held: list[str] = []
    owners: list[int] = []
    n = 0
    for owner, text in enumerate(texts):
        padded = BEGIN * (order - 1) + text + END
        for at in range(0, len(padded) - order + 1, size):
            own = padded[at : at + size + order - 1]
            held.append(own)
            owners.append(owner)
            n += len(own)
            if n >= together:
                yield held, np.array(owners)
                held, owners, n = [], [], 0
    if held:
        yield held, np.array(owners)


def grams(padded: list[str], order: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct n-grams of padded texts; for each position its n-gram's number and its text's."""
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4")
    owners = np.repeat(np.arange(len(padded), dtype="i4"), [len(x) for x in padded])
    # Characters first, then one more at a time: numbers stay dense, so no key overflows.
    numbers, chars = pd.factorize(codes, size_hint=HINT)
    spelled = chars.astype("<u4").reshape(-1, 1)
    letters = numbers
    for n in range(2, order + 1):
        keys = numbers[:-1].astype("i8") * len(chars) + letters[n - 1 :]
        numbers, found = pd.factorize(keys, size_hint=HINT)
        spelled = np.concatenate((spelled[found // len(chars)], chars[found % len(chars)].astype("<u4").reshape(-1, 1)), axis=1)
    inside = owners[: len(numbers)] == owners[order - 1 :]
    used, numbers = _compact(numbers[inside], len(spelled))
    data = spelled[used].tobytes().decode("utf-32-le", "surrogatepass")
    return [data[i : i + order] for i in range(0, len(data), order)], numbers, owners[order - 1 :][inside]


def distinct_grams(texts: list[str], order: int) -> set[str]:
    """The n-grams of all texts, of which no more than one piece's and the distinct ones are held."""
    found: set[str] = set()
    for padded, _ in pieces(texts, order):
        found.update(grams(padded, order)[0])
    return found


def _compact(numbers: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    seen = np.zeros(size, bool)
    seen[numbers] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[numbers]


def repeats(text: str) -> tuple[int, int]:
    """Words of a text, and how many of them follow the same word as before, anywhere earlier in it."""
    words = text.split()
    return len(words), max(0, len(words) - 1 - len(set(zip(words, words[1:]))))


def count_grams(texts: DataFrame, order: int) -> DataFrame:
    """``gram, c`` over a column ``text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, **BLOCK):
            total: Counter[str] = Counter()
            for padded, _ in pieces(part.column("text").to_pylist(), order):
                names, numbers, _ = grams(padded, order)
                total.update(dict(zip(names, np.bincount(numbers, minlength=len(names)).tolist())))
            yield from to_batches({"gram": list(total), "c": list(total.values())}, pa.schema([("gram", pa.string()), ("c", pa.int64())]))
        part = total = None
        release()

    return texts.select("text").mapInArrow(count, "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c"))


class KneserNey:
    """Tables of one model: counts per n-gram, and per context their sum and the weight left for the lower order."""

    def __init__(self, counts: DataFrame, order: int) -> None:
        self.order = order
        self.counts: dict[int, DataFrame] = {order: materialize(counts, "grams")}
        for n in range(order - 1, 0, -1):
            # Below the highest order an n-gram counts the characters seen before it.
            higher = self.counts[n + 1].select(F.substring("gram", 2, n).alias("gram"))
            self.counts[n] = materialize(higher.groupBy("gram").agg(F.count("*").alias("c")), f"grams{n}")
        self.discounts = {n: self._discounts(n) for n in self.counts}
        self.contexts = {n: self._contexts(n) for n in self.counts}
        self.symbols = self.counts[1].count() + 1  # and one for those never seen

    def _discounts(self, n: int) -> tuple[float, float, float]:
        t = self.counts[n].agg(*(F.count_if(F.col("c") == k).alias(f"t{k}") for k in (1, 2, 3, 4))).first()
        y = t["t1"] / (t["t1"] + 2 * t["t2"]) if t["t1"] else 0.5
        # Never nothing: unseen symbols keep a share.
        part = lambda k: min(max(k - (k + 1) * y * t[f"t{k + 1}"] / t[f"t{k}"], 0.05), float(k)) if t[f"t{k}"] else 0.5 * k
        return part(1), part(2), part(3)

    def _discount(self, n: int):
        d1, d2, d3 = self.discounts[n]
        return F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)

    def _contexts(self, n: int) -> DataFrame:
        d = self._discount(n)
        sums = self.counts[n].groupBy(F.substring("gram", 1, n - 1).alias("context")).agg(F.sum("c").alias("total"), F.sum(d).alias("left"))
        return materialize(sums.select("context", "total", (F.col("left") / F.col("total")).alias("weight")), f"contexts{n}")

    def probabilities(self, wanted: DataFrame, n: int | None = None) -> DataFrame:
        """``gram, p`` for distinct n-grams: what is left of the count, and the lower order's share by the context's weight."""
        n = n or self.order
        rows = wanted.join(self.counts[n], "gram", "left").withColumn("context", F.substring("gram", 1, n - 1))
        rows = rows.join(self.contexts[n], "context", "left")
        own = F.coalesce(F.greatest(F.col("c") - self._discount(n), F.lit(0.0)) / F.col("total"), F.lit(0.0))
        weight = F.coalesce("weight", F.lit(1.0))
        if n == 1:
            return rows.select("gram", (own + weight / self.symbols).alias("p"))
        rows = rows.withColumn("suffix", F.substring("gram", 2, n - 1))
        lower = self.probabilities(rows.select(F.col("suffix").alias("gram")).distinct(), n - 1)
        return rows.join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("lower")), "suffix").select("gram", (own + weight * F.col("lower")).alias("p"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """``doc_id`` of documents whose labels all say good and not toxic."""
    own = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"), F.count_if(F.col("quality").isNull() | F.col("toxic").isNull()).alias("unknown"))
    return own.filter("q = 1 and t = 0 and unknown = 0").select("doc_id")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), whole_text().alias("text"))


def score_documents(docs: DataFrame, model: KneserNey) -> DataFrame:
    """``doc_id, text_hash, lang, n, nll, words, repeats``: symbols of each document, the sum of their negative log probabilities, and ``repeats``.

    ``docs`` is read twice and has to give the same partitions each time, as
    the scan of a table does; otherwise the job fails.
    """
    order = model.order

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part in zip(block_ids(), blocks(batches, **BLOCK)):
            names = list(distinct_grams(part.column("text").to_pylist(), order))
            yield from to_batches({"block": [number] * len(names), "gram": names}, pa.schema([("block", pa.int64()), ("gram", pa.string())]))
        part = names = None
        release()

    kinds = pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("text_hash", pa.list_(pa.int64())), ("lang", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64())), ("texts", pa.binary())])

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part in zip(block_ids(), blocks(batches, **BLOCK)):
            texts = [x.encode("utf-8", "surrogatepass") for x in part.column("text").to_pylist()]
            row = {name: [part.column(name).to_pylist()] for name in ("doc_id", "text_hash", "lang")}
            yield from to_batches({"block": [number], **row, "sizes": [[len(x) for x in texts]], "texts": [zstandard.compress(b"".join(texts), 6)]}, kinds)
        part = texts = row = None
        release()

    out = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("nll", pa.float64()), ("words", pa.int64()), ("repeats", pa.int64())])

    def sums(packed: pa.Table, answers: pa.Table) -> pa.Table:
        logs = dict(zip(answers.column("gram").to_pylist(), answers.column("log_p").to_pylist()))
        columns: dict[str, list] = {name: [] for name in out.names}
        for row in packed.to_pylist():
            data, ends = zstandard.decompress(row["texts"]), np.cumsum(row["sizes"]).tolist()
            texts = [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip([0, *ends], ends)]
            data = row["texts"] = None
            nll = np.zeros(len(texts))
            for padded, texts_at in pieces(texts, order):
                names, numbers, owners = grams(padded, order)
                # A KeyError here means that the two scans gave different blocks.
                values = np.array([logs[x] for x in names])
                np.subtract.at(nll, texts_at, np.bincount(owners, weights=values[numbers], minlength=len(padded)))
            for name in ("doc_id", "text_hash", "lang"):
                columns[name] += row[name]
            columns["n"] += [len(x) + 1 for x in texts]
            columns["nll"] += nll.tolist()
            for text in texts:
                n_words, n_repeats = repeats(text)
                columns["words"].append(n_words)
                columns["repeats"].append(n_repeats)
        found = pa.table(columns, schema=out)
        logs = columns = data = texts = None
        release()
        return found

    rows = _rows(docs)
    asked = materialize(rows.select("text").mapInArrow(ask, "block long, gram string"), "asked")
    known = materialize(model.probabilities(asked.select("gram").distinct()).select("gram", F.ln("p").alias("log_p")), "probabilities")
    answers = asked.join(known, "gram").select(F.col("block").alias("of_block"), "gram", "log_p")
    packed = rows.mapInArrow(squeeze, "block long, doc_id array<long>, text_hash array<long>, lang array<string>, sizes array<long>, texts binary")
    return packed.groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(sums, "doc_id long, text_hash long, lang string, n long, nll double, words long, repeats long")


def _of_languages(df: DataFrame, name: str, most: int = 10_000) -> DataFrame:
    """``df`` written, and broadcast unless it has more rows than languages there are."""
    df = materialize(df, name)
    return F.broadcast(df) if df.count() <= most else df


def classify(docs: DataFrame, labels: DataFrame, order: int = 4, quantile: float = 0.99, slack: float = 1.25, prior: float = 200.0, broadcast_rows: int = 1_000_000, repeat_slack: float = 2.5, repeat_prior: float = 50.0) -> DataFrame:
    """``doc_id, text_hash, lang, n_symbols, perplexity, threshold, low_threshold, repeated, repeated_threshold, keep`` of every row.

    The model is trained on all documents that ``labels`` trusts. A document's
    mean is drawn to its language's by ``prior`` symbols, so a short one is
    not rejected on a few characters. The threshold is ``slack`` times the
    language's ``quantile`` over trusted documents, the low one the opposite quantile
    over ``slack``. ``repeated`` is the share of words in a pair the document has had, with one
    more repeat and ``repeat_prior`` words at the language's share; its threshold is
    ``repeat_slack`` times the same quantile. A language without any trusted document
    has the limits of all. Without trusted text everything is kept. A null
    or empty text is one end symbol; a null language is ``und``. Rows equal in
    id and text score alike and come back each. Up to ``broadcast_rows`` trusted
    ids are sent to the tasks, more are joined by a shuffle.
    """
    trusted = materialize(trusted_ids(labels), "trusted")
    n_trusted = trusted.count()
    few = F.broadcast(trusted) if n_trusted <= broadcast_rows else trusted
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).join(few, "doc_id", "left_semi")
    counts = count_grams(text, order)
    model = KneserNey(counts, order)
    scored = materialize(score_documents(docs, model), "scores")
    names = ("threshold", "low_threshold", "repeated_threshold")
    if not model.counts[1].head(1):
        unknown = {x: F.lit(None).cast("double").alias(x) for x in (*names, "repeated")}
        return scored.select("doc_id", "text_hash", "lang", F.col("n").alias("n_symbols"), F.exp(F.col("nll") / F.col("n")).alias("perplexity"), unknown["threshold"], unknown["low_threshold"], unknown["repeated"], unknown["repeated_threshold"], F.lit(True).alias("keep"))
    good = scored.join(trusted, "doc_id", "left_semi")
    mean = F.sum("nll") / F.sum("n")
    share = F.coalesce(F.try_divide(F.sum("repeats"), F.sum("words")), F.lit(0.0))
    overall = good.agg(mean.alias("mean"), share.alias("share")).first()
    # A row per language: sent to the tasks, so that no language is one task's.
    means = _of_languages(good.groupBy("lang").agg(mean.alias("mean"), share.alias("share")), "means")
    drawn = lambda df: df.join(means, "lang", "left").withColumn(
        "perplexity", F.exp((F.col("nll") + prior * F.coalesce("mean", F.lit(overall["mean"]))) / (F.col("n") + prior))).withColumn(
        "repeated", (F.col("repeats") + 1 + repeat_prior * F.coalesce("share", F.lit(overall["share"]))) / (F.col("words") + repeat_prior))
    smoothed = drawn(good)
    cuts = (F.percentile_approx("perplexity", quantile, 10_000) * slack, F.percentile_approx("perplexity", 1 - quantile, 10_000) / slack,
            F.percentile_approx("repeated", quantile, 10_000) * repeat_slack)
    cuts = [cut.alias(name) for name, cut in zip(names, cuts)]
    general = smoothed.agg(*cuts).first()
    limits = _of_languages(smoothed.groupBy("lang").agg(*cuts), "limits")
    judged = drawn(scored).join(limits, "lang", "left").withColumns({x: F.coalesce(x, F.lit(general[x])) for x in names})
    keep = F.col("perplexity").between(F.col("low_threshold"), F.col("threshold")) & (F.col("repeated") <= F.col("repeated_threshold"))
    return judged.select("doc_id", "text_hash", "lang", F.col("n").alias("n_symbols"), "perplexity", "threshold", "low_threshold", "repeated", "repeated_threshold", keep.alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, **more) -> DataFrame:
    """The rows of ``docs``, unchanged, that ``classify`` keeps."""
    bad = materialize(classify(docs, labels, **more).filter(~F.col("keep")).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct(), "rejected")
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("bad_id")) & (F.xxhash64(docs["text"]) == F.col("bad_hash")), "left_anti")
