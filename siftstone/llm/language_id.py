"""Language ID with a string kernel, Nyström landmarks and kernel ridge regression.

The kernel of two texts is the number of character n-grams of one to three
letters that both have, over the root of the product of how many each has
(a blended-spectrum presence kernel). A bounded sample of labelled rows is the
training set; some of them are landmarks. One ridge regression per language is
fitted on the kernel with the landmarks (weights b solve
``(K'K + ridge * n * Kmm) b = K'y``). Texts are scored in batches by two matrix
products: presence with landmarks, kernel with weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, to_batches, whole_text

UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
#: n-grams are hashed to so many presence flags (a power of two).
BITS, ORDERS = 13, (1, 2, 3)
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    """``languages`` in order, landmarks as packed presence flags, weights (landmarks x languages)."""

    languages: list[str]
    landmarks: bytes
    weights: np.ndarray

    def matrix(self) -> np.ndarray:
        """Landmarks as columns, each divided by its norm."""
        packed = np.frombuffer(self.landmarks, "u1").reshape(-1, (1 << BITS) // 8)
        flags = np.unpackbits(packed, axis=1).astype("f4")
        return np.ascontiguousarray((flags / np.sqrt(np.maximum(flags.sum(axis=1, keepdims=True), 1))).T)


def presence(texts: list[str]) -> np.ndarray:
    """Which hashed n-grams of letters, in lower case with a blank around words, each text has."""
    plain = [f" {' '.join(LETTERS.findall(x.lower()))} " for x in texts]
    flags = np.zeros(len(texts) << BITS, "u1")
    codes = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    owners = np.repeat(np.arange(len(texts), dtype="i8"), [len(x) for x in plain])
    gram = np.zeros_like(codes)
    for order in range(1, max(ORDERS) + 1):
        gram = codes if order == 1 else (gram[:-1] << np.uint64(21)) | codes[order - 1 :]
        if order in ORDERS:
            own = owners[order - 1 :]
            place = ((gram + np.uint64(order)) * MIX >> np.uint64(64 - BITS)).astype("i8")
            inside = own == owners[: len(own)]
            flags[((own << BITS) | place)[inside]] = 1
    return flags.reshape(len(texts), 1 << BITS)


def kernel(texts: list[str], landmarks: np.ndarray) -> np.ndarray:
    flags = presence(texts).astype("f4")
    return (flags @ landmarks) / np.sqrt(np.maximum(flags.sum(axis=1, keepdims=True), 1))


def predictor(model: Model, batch: int = 256):
    """A function of texts that gives their languages and scores from 0 to 1."""
    landmarks, weights = model.matrix(), model.weights.astype("f4")

    def predict(texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, x in enumerate(texts) if x and LETTERS.search(x)] if model.languages else []
        for start in range(0, len(known), batch):
            rows = known[start : start + batch]
            found = np.maximum(kernel([texts[i] for i in rows], landmarks) @ weights, 0)
            best = found.argmax(axis=1)
            sums = found.sum(axis=1)
            share = np.where(sums > 0, found[np.arange(len(rows)), best] / np.maximum(sums, 1e-30), 0)
            for i, k, score in zip(rows, best, share):
                names[i], scores[i] = model.languages[k], round(float(score), 5)
        return names, scores

    return predict


def fit(labelled: DataFrame, sample_per_language: int = 1500, landmarks_per_language: int = 64, ridge: float = 1e-4) -> Model:
    """A model from ``text`` and ``lang``; rows with a null in either or without a letter are left out.

    About ``sample_per_language`` distinct texts of each language are drawn by a hash
    of the text, so the training set is bounded whatever the table; the same
    table gives the same model. No labelled row with a letter at all gives a model that
    answers ``und``.
    """
    rank = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / float(1 << 40)
    rows = labelled.select("text", F.col("lang").alias("label"), rank.alias("rank")).filter(F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # Copies of a text are one: they neither crowd out others nor are read more than once.
    sizes = {r["label"]: r["n"] for r in rows.select("label", "rank").distinct().groupBy("label").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], b"", np.zeros((0, 0)))
    share = F.create_map(*(x for name, n in sizes.items() for x in (F.lit(name), F.lit(min(1.0, sample_per_language / n)))))
    sample = rows.filter(F.col("rank") < share[F.col("label")]).dropDuplicates(["label", "rank"])

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, rows=512):
            packed = [np.packbits(presence([x]), axis=1).tobytes() for x in part.column("text").to_pylist()]
            yield from to_batches({"label": part.column("label"), "rank": part.column("rank"), "flags": packed},
                                  pa.schema([("label", pa.string()), ("rank", pa.float64()), ("flags", pa.binary())]))

    # Bounded: sample_per_language times languages rows of a kilobyte.
    drawn = sample.mapInArrow(flags, "label string, rank double, flags binary").dropDuplicates(["label", "flags"]).toArrow().to_pydict()
    if not drawn["label"]:
        return Model([], b"", np.zeros((0, 0)))
    order = sorted(range(len(drawn["label"])), key=lambda i: (drawn["label"][i], drawn["rank"][i], drawn["flags"][i]))
    labels = np.array([languages.index(drawn["label"][i]) for i in order])
    packed = np.frombuffer(b"".join(drawn["flags"][i] for i in order), "u1").reshape(len(order), -1)
    marks = np.concatenate([np.flatnonzero(labels == k)[:landmarks_per_language] for k in range(len(languages))])
    model = Model(languages, packed[marks].tobytes(), np.zeros((len(marks), len(languages))))
    landmarks = model.matrix().astype("f8")
    gram, target = np.zeros((len(marks), len(marks))), np.zeros((len(marks), len(languages)))
    # Each language has the same weight, however many rows were drawn.
    weight = 1 / np.maximum(np.bincount(labels, minlength=len(languages)), 1)
    for start in range(0, len(order), 256):
        own = slice(start, start + 256)
        flat = np.unpackbits(packed[own], axis=1).astype("f8")
        k = (flat @ landmarks) / np.sqrt(np.maximum(flat.sum(axis=1, keepdims=True), 1))
        weighted = k * weight[labels[own], None]
        gram += weighted.T @ k
        target += weighted.T @ np.eye(len(languages))[labels[own]]
    flat = np.unpackbits(packed[marks], axis=1).astype("f8")
    among = (flat @ landmarks) / np.sqrt(np.maximum(flat.sum(axis=1, keepdims=True), 1))
    system = gram + ridge * len(languages) * among + 1e-9 * np.eye(len(marks))
    return Model(languages, model.landmarks, np.linalg.lstsq(system, target, rcond=None)[0])


def predict_languages(docs: DataFrame, model: Model, text: str | Column = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys``, ``lang_pred`` and ``score`` of every row.

    A null text, or one without a letter, is ``und`` with score 0. Repeated
    rows are predicted each; other columns are dropped. The score is the
    language's share of the positive regression values.
    """
    rows = docs.select(*keys, whole_text(text).alias("text_to_read"))
    schema = rows.drop("text_to_read").withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor(model)
        for part in blocks(batches, "text_to_read"):
            names, scores = predict(part.column("text_to_read").to_pylist())
            done = part.drop_columns("text_to_read").append_column("lang_pred", pa.array(names, pa.string())).append_column("score", pa.array(scores, pa.float64()))
            yield from done.to_batches()

    return rows.mapInArrow(read, schema)


def keep_known_languages(docs: DataFrame, model: Model, min_score: float = 0.3) -> DataFrame:
    """The rows of ``docs``, unchanged, whose text some language of the model claims with ``min_score`` or more."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor(model)
        for part in blocks(batches):
            names, scores = predict(part.column("text").to_pylist())
            yield from part.filter(pa.array([x != UNKNOWN and y >= min_score for x, y in zip(names, scores)], pa.bool_())).to_batches()

    return docs.mapInArrow(keep, docs.schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is a multiple of 5, or it has no id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))
