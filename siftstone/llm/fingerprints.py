"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A sketch has cells of count, XOR of digests and XOR of their checks; a digest
lies in three cells. The sketches of two versions are subtracted cell by cell
and what is left is peeled: a cell with one digest gives it away and is cleared
everywhere. What was peeled are the paragraphs that only one version has. If
cells remain, both are sketched anew with more cells. Paragraphs are the lines
of a text, cut further after sentence and clause ends, and longer ones after
words picked by a hash, so that an edit changes only the pieces around it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftstone.session import materialize

from .common import blocks, to_batches, whole_text

PARAGRAPH = re.compile(r"[^\n.,;:!?]*[.,;:!?]+|[^\n.,;:!?]+")
#: A piece of more characters is cut after about every eighth word.
LONG, EVERY = 160, 8
#: Cells of a stored fingerprint; a multiple of 3. Each retry has GROWTH times as many.
CELLS, GROWTH = 12, 8
CELL = np.dtype([("count", "<i4"), ("key", "<u8"), ("check", "<u4")])
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], "u8")


def paragraphs(text: str) -> Iterator[str]:
    """Pieces of a text, blank ones included."""
    for piece in PARAGRAPH.findall(text):
        if len(piece) <= LONG:
            yield piece
            continue
        held: list[str] = []
        for word in piece.split():
            held.append(word)
            if zlib.crc32(word.encode("utf-8", "surrogatepass")) % EVERY == 0 or len(held) == 4 * EVERY:
                yield " ".join(held)
                held = []
        yield " ".join(held)


def digests(text: str, known: dict[str, int] | None = None) -> list[int]:
    """64-bit digests of the paragraphs; the second and later copies of one get digests of their own.

    ``known`` remembers digests from text to text.
    """
    import xxhash

    known = {} if known is None else known
    found = []
    for piece in paragraphs(text):
        digest = known.get(piece)
        if digest is None:
            plain = piece.strip()
            digest = known[piece] = xxhash.xxh64_intdigest(plain.encode("utf-8", "surrogatepass")) if plain else -1
        if digest >= 0:
            found.append(digest)
    if len(set(found)) == len(found):
        return found
    seen: Counter[int] = Counter()
    out = []
    for digest in found:
        copy = seen[digest]
        out.append(digest if not copy else xxhash.xxh64_intdigest(b"%d %d" % (digest, copy)))
        seen[digest] += 1
    return out


def _mixed(keys: np.ndarray, k: int) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(31))) * ODD[k]
    return keys ^ (keys >> np.uint64(29))


def _check(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, 3) >> np.uint64(32)).astype("u4")


class Cells:
    """Rows of cells, as three flat arrays: counts, XOR of digests, XOR of their checks."""

    def __init__(self, rows: int, cells: int) -> None:
        self.cells = cells
        self.count, self.key, self.check = np.zeros(rows * cells, "i4"), np.zeros(rows * cells, "u8"), np.zeros(rows * cells, "u4")

    def add(self, owners: np.ndarray, keys: np.ndarray, signs: np.ndarray) -> None:
        checks, part = _check(keys), self.cells // 3
        for k in range(3):
            at = owners * self.cells + k * part + (_mixed(keys, k) % np.uint64(part)).astype("i8")
            np.add.at(self.count, at, signs)
            np.bitwise_xor.at(self.key, at, keys)
            np.bitwise_xor.at(self.check, at, checks)

    def minus(self, other: Cells) -> Cells:
        out = Cells(0, self.cells)
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def printed(self) -> list[str]:
        table = np.zeros(len(self.count), CELL)
        table["count"], table["key"], table["check"] = self.count, self.key, self.check
        return [base64.b64encode(row.tobytes()).decode("ascii") for row in table.reshape(-1, self.cells)]


class Sets:
    """Digest sets of several texts in one array."""

    def __init__(self, sets: Sequence[list[int]]) -> None:
        self.sizes = np.array([len(x) for x in sets], "i8")
        self.ends = np.cumsum(self.sizes)
        self.keys = np.array([key for x in sets for key in x], "u8")

    def sketches(self, cells: int = CELLS, rows: np.ndarray | None = None) -> Cells:
        """A row of cells for each set, or for each of ``rows``."""
        rows = np.arange(len(self.sizes)) if rows is None else rows
        sizes = self.sizes[rows]
        owners = np.repeat(np.arange(len(rows)), sizes)
        starts = self.ends[rows] - sizes
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out = Cells(len(rows), cells)
        out.add(owners, self.keys[np.repeat(starts, sizes) + within], np.ones(len(owners), "i4"))
        return out


def peel(table: Cells) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Empties rows of subtracted cells: whether each was recovered whole; then row, digest and sign of each recovered digest."""
    rows, keys, signs = [], [], []
    while True:
        pure = np.flatnonzero((table.count == 1) | (table.count == -1))
        pure = pure[_check(table.key[pure]) == table.check[pure]]
        if not len(pure):
            break
        # A digest alone in several of its cells is taken once.
        _, first = np.unique(table.key[pure] + (pure // table.cells).astype("u8") * ODD[0], return_index=True)
        pure = pure[first]
        row, key, sign = pure // table.cells, table.key[pure], table.count[pure]
        table.add(row, key, -sign)
        rows.append(row)
        keys.append(key)
        signs.append(sign)
    full = (table.count != 0) | (table.key != 0) | (table.check != 0)
    done = ~full.reshape(-1, table.cells).any(axis=1)
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return done, join(rows, "i8"), join(keys, "u8"), join(signs, "i4")


def recovered(left: Sets, right: Sets, first: Cells | None = None, cells: int = CELLS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pair, digest and sign of what only one side of each pair has, by peeling larger and larger sketches.

    ``first`` are subtracted sketches of all pairs, if they are there already.
    """
    todo = np.arange(len(left.sizes))
    while len(todo):
        table = first if first is not None else left.sketches(cells, todo).minus(right.sketches(cells, todo))
        first = None
        done, rows, keys, signs = peel(table)
        good = done[rows]
        yield todo[rows[good]], keys[good], signs[good]
        todo = todo[~done]
        cells *= GROWTH


def differences(left: Sequence[list[int]], right: Sequence[list[int]], cells: int = CELLS) -> list[tuple[list[int], list[int]]]:
    """For each pair of digest sets, what only the left and only the right one has."""
    out: list[tuple[list[int], list[int]]] = [([], []) for _ in left]
    for rows, keys, signs in recovered(Sets(left), Sets(right), cells=cells):
        for row, key, sign in zip(rows.tolist(), keys.tolist(), signs.tolist()):
            out[row][sign < 0].append(key)
    return out


def likeness(left: Sets, right: Sets, first: Cells | None = None) -> list[float]:
    """Shared paragraphs over all paragraphs of each pair, from recovered differences; 1 where neither has any."""
    n = len(left.sizes)
    only = np.zeros((n, 2))
    for rows, _, signs in recovered(left, right, first):
        for side, sign in enumerate((1, -1)):
            only[:, side] += np.bincount(rows[signs == sign], minlength=n)
    shared = left.sizes - only[:, 0]
    union = shared + only.sum(axis=1)
    return np.where(union > 0, shared / np.maximum(union, 1), 1.0).tolist()


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many of the next text's first."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
EDGE = pa.schema([*RESULT, ("edge", pa.string()), ("task", pa.int32()), ("edge_id", pa.int64()), ("edge_text", pa.string())])
DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(ids: list, texts: list[str], following: list[str]) -> dict[str, list]:
    """The result columns for documents and the texts that come next."""
    changed = [edited(x, y) for x, y in zip(texts, following)]
    known: dict[str, int] = {}
    own, other = [digests(x, known) for x in texts], [digests(x, known) for x in changed]
    # Mostly the next text is the next row.
    after = [own[i + 1] if i + 1 < len(texts) and texts[i + 1] is y else digests(y, known) for i, y in enumerate(following)]
    left, right, last = Sets(own), Sets(other), Sets(after)
    print_left, print_right, print_last = left.sketches(), right.sketches(), last.sketches()
    return {"doc_id": ids, "n_chars": [len(x) for x in texts], "edited_sha256": [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in changed],
            "fingerprint": print_left.printed(), "edited_fingerprint": print_right.printed(),
            "near_edited": likeness(left, right, print_left.minus(print_right)), "near_next": likeness(left, last, print_left.minus(print_last))}


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results for all rows of a sorted partition but its last; that one and the first come out as edges."""
    task = TaskContext.get().partitionId()
    nothing = [None]

    def edge(kind: str, key, text: str) -> Iterator[pa.RecordBatch]:
        yield from to_batches({**{name: nothing for name in RESULT.names}, "edge": [kind], "task": [task], "edge_id": [key], "edge_text": [text]}, EDGE)

    key = text = None
    for part in blocks(batches):
        ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
        if text is None:
            yield from edge("first", ids[0], texts[0])
        else:
            ids, texts = [key, *ids], [text, *texts]
        key, text = ids[-1], texts[-1]
        if len(ids) > 1:
            columns = compared(ids[:-1], texts[:-1], texts[1:])
            empty = [None] * (len(ids) - 1)
            yield from to_batches({**columns, "edge": empty, "task": empty, "edge_id": empty, "edge_text": empty}, EDGE)
    if text is not None:
        yield from edge("last", key, text)


def _at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in blocks(batches):
        yield from to_batches(compared(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("following").to_pylist()), RESULT)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how alike its fingerprint is to that and to the next document's.

    The next document is the one with the next lower id; after the last comes
    the first, and an only one is its own. Rows of one id are in an order of
    their own; null ids come last. A null text is empty, and an empty text has
    a fingerprint of zeros. Other columns are ignored. An empty table gives an
    empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), F.monotonically_increasing_id().alias("tie"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    done = materialize(ranged.select("doc_id", "text").mapInArrow(_in_order, f"{DDL}, edge string, task int, edge_id long, edge_text string"), "fingerprints")
    # Two rows per task. Which task comes next is found among their numbers; texts are joined to them.
    edges = done.filter("edge is not null").select("edge", "task", F.col("edge_id").alias("doc_id"), F.col("edge_text").alias("text"))
    heads, tails = edges.filter("edge = 'first'"), edges.filter("edge = 'last'")
    tasks, front = Window.orderBy("task"), Window.partitionBy()
    after = heads.select("task", F.coalesce(F.lead("task").over(tasks), F.min("task").over(front)).alias("next_task"))
    first = heads.select(F.col("task").alias("next_task"), F.col("text").alias("following"))
    ended = tails.join(after, "task").join(first, "next_task").select("doc_id", "text", "following").mapInArrow(_at_edges, DDL)
    return done.filter("edge is null").select(RESULT.names).unionByName(ended)
