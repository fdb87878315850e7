"""SentencePiece encoding and decoding by a shared-prefix forward pass.

The distinct words of a block, each with the mark of the blank before it, are
sorted; that order walks their trie depth first. A prefix keeps its forward
state (best last piece and where it starts), so a word begins where it leaves
the word before it. Back pointers then give the pieces.

A unigram model takes the piece that makes the sum of scores greatest. A BPE
model has one encoding per prefix too: piece ``t`` may follow the encoding
that ends with ``s`` just when ``s t`` on its own is encoded as those two, so the
same pass finds it, with allowed or not in place of a sum. Runs of blanks, where
scores tie, are merged directly.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator, Sequence
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, to_batches, tokenizer_path, whole_text

MARK = "▁"
#: A line feed is in no piece, so no piece crosses it.
WORD = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")
UNKNOWN = -1
#: Words that a Python worker remembers from block to block.
REMEMBERED = 400_000
BLOCK = {"rows": 8192, "size": 8 << 20}


class Pieces:
    """A vocabulary with scores, and the forward pass over it.

    ``kind`` is ``bpe`` or ``unigram``. ``bytes_at`` is the id of byte 0 of a
    vocabulary with byte fallback, or None: then an unknown character is
    ``unknown``.
    """

    def __init__(self, pieces: Sequence[tuple[str, float, int]], kind: str, bytes_at: int | None = None, unknown: int = 0, names: Sequence[bytes] = ()) -> None:
        self.ids = {piece: i for piece, _, i in pieces}
        self.scores = {i: score for _, score, i in pieces}
        self.names = {i: piece for piece, _, i in pieces}
        self.kind, self.bytes_at, self.unknown = kind, bytes_at, unknown
        # Lengths of the pieces that end with the given three characters, or are all of fewer, longest first.
        tails: dict[str, set[int]] = {}
        for piece in self.ids:
            tails.setdefault(piece[-3:], set()).add(len(piece))
        self.tails = {tail: sorted(sizes, reverse=True) for tail, sizes in tails.items()}
        self.least = min(self.scores.values(), default=0.0) - 10
        self.pairs: dict[tuple[int, int], bool] = {}
        self.raw = list(names)
        #: Ids of words of this and earlier blocks.
        self.known: dict[str, bytes] = {}

    def merged(self, text: str) -> list[int]:
        """BPE as defined: merge the neighbours of the highest score, leftmost first, until none are left."""
        part = list(text)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(part):
                both = part[i] + part[after[i]]
                if both in self.ids:
                    heapq.heappush(heap, (-self.scores[self.ids[both]], i, both))

        for i in range(len(part) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if not part[i] or after[i] >= len(part) or part[i] + part[after[i]] != both:
                continue
            gone = after[i]
            part[i], part[gone] = both, ""
            after[i] = after[gone]
            if after[i] < len(part):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [self.ids.get(x, UNKNOWN) for x in part if x]

    def allowed(self, left: int, right: int) -> bool:
        if left == UNKNOWN or right == UNKNOWN:
            return True
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs[key] = self.merged(self.names[left] + self.names[right]) == [left, right]
        return known

    def encode_sorted(self, words: Sequence[str]) -> Iterator[list[int]]:
        """The ids of each word; ``words`` are sorted, so a prefix in common is passed once."""
        bpe = self.kind == "bpe"
        forward = self._bpe if bpe else self._unigram
        # The forward state of every prefix of the last word: its last piece, where that starts, the sum of scores.
        last, start, score = [UNKNOWN], [0], [0.0]
        before = ""
        for word in words:
            if bpe and MARK * 2 in word:
                yield self.bytes_of(word, self.merged(word))
                continue
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], start[shared + 1 :], score[shared + 1 :]
            forward(word, shared + 1, last, start, score)
            before = word
            found, end = [], len(word)
            while end:
                found.append(last[end])
                end = start[end]
            found.reverse()
            yield self.bytes_of(word, found) if UNKNOWN in found else found

    def _bpe(self, word: str, first: int, last: list[int], start: list[int], score: list[float]) -> None:
        ids, tails, pairs, allowed = self.ids, self.tails, self.pairs, self.allowed
        for end in range(first, len(word) + 1):
            best, best_at = UNKNOWN, end - 1
            for width in (3, 2, 1) if end > 2 else range(end, 0, -1):
                for size in tails.get(word[end - width : end], ()):
                    at = end - size
                    piece = ids.get(word[at:end]) if at >= 0 else None
                    if piece is None:
                        continue
                    left = last[at]
                    if at:
                        fits = left == UNKNOWN or pairs.get((left, piece))
                        if not fits and (fits is False or not allowed(left, piece)):
                            continue
                    best, best_at = piece, at
                    break
                else:
                    continue
                break
            last.append(best)
            start.append(best_at)

    def _unigram(self, word: str, first: int, last: list[int], start: list[int], score: list[float]) -> None:
        for end in range(first, len(word) + 1):
            best, best_at, best_score = UNKNOWN, end - 1, score[end - 1] + self.least if word[end - 1] not in self.ids else -float("inf")
            for width in (3, 2, 1) if end > 2 else range(end, 0, -1):
                for size in self.tails.get(word[end - width : end], ()):
                    at = end - size
                    piece = self.ids.get(word[at:end]) if at >= 0 else None
                    if piece is not None and score[at] + self.scores[piece] > best_score:
                        best, best_at, best_score = piece, at, score[at] + self.scores[piece]
            last.append(best)
            start.append(best_at)
            score.append(best_score)

    def bytes_of(self, word: str, found: list[int]) -> list[int]:
        """``found`` with the bytes of unknown characters in place of them."""
        if UNKNOWN not in found:
            return found
        out, at = [], 0
        for piece in found:
            if piece == UNKNOWN:
                out += [self.unknown] if self.bytes_at is None else [self.bytes_at + x for x in word[at].encode("utf-8", "surrogatepass")]
                at += 1
            else:
                out.append(piece)
                at += len(self.names[piece])
        return out

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit numbers."""
        words = [WORD.findall(MARK + x.replace(" ", MARK)) if x else [] for x in texts]
        distinct = set().union(*words) if words else set()
        if len(self.known) > REMEMBERED:
            self.known = {word: self.known[word] for word in distinct if word in self.known}
        new = sorted(word for word in distinct if word not in self.known)
        for word, found in zip(new, self.encode_sorted(new)):
            self.known[word] = pack("<%dI" % len(found), *found)
        return [b"".join(map(self.known.__getitem__, own)) for own in words]

    def decode(self, ids: bytes) -> str:
        """The text of ids: marks are blanks, and the one before the first word is dropped."""
        data = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return data.removeprefix(b" ").decode("utf-8", "replace")


@functools.cache
def load(path: str, kind: str = "bpe") -> Pieces:
    """The vocabulary of a model file, once per Python worker."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, names, bytes_at = [], [], None
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            bytes_at = i if bytes_at is None else bytes_at
            names.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            names.append("⁇".encode() if model.is_unknown(i) else b"")
        else:
            names.append(piece.replace(MARK, " ").encode())
            pieces.append((piece, model.get_score(i), i))
    return Pieces(pieces, kind, bytes_at, model.unk_id(), names)


def encode_pieces(docs: DataFrame, text: str | Column = "text", doc_id: str | Column = "doc_id", path: str | None = None, kind: str = "bpe", checks: bool = False) -> DataFrame:
    """``doc_id`` and the ids of each text, as the model's own library gives them without begin and end.

    ``ids array<int>``; with ``checks`` instead ``n_bytes, n_pieces, ids_crc32``
    of them and ``decoded_sha256, round_trip`` of what they decode to. Null and
    empty texts have no ids. A text that itself holds the mark of a blank
    decodes to a blank there. Repeated rows are encoded each, other
    columns are dropped, and a null id stays null.
    """
    path = path or tokenizer_path("piece_bpe_32k.model")
    rows = docs.select((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    more = [("n_bytes", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())] if checks else [("ids", pa.list_(pa.int32()))]
    schema = pa.schema([("doc_id", pa.int64()), *more])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path, kind)
        for part in blocks(batches, **BLOCK):
            texts = part.column("text").to_pylist()
            columns: dict = {"doc_id": part.column("doc_id").to_pylist()}
            found = pieces.encode(texts)
            if checks:
                decoded = [pieces.decode(x) for x in found]
                columns |= {"n_bytes": [len(x.encode()) for x in texts], "n_pieces": [len(x) // 4 for x in found], "ids_crc32": [zlib.crc32(x) for x in found],
                            "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in decoded], "round_trip": [x == y for x, y in zip(texts, decoded)]}
            else:
                columns["ids"] = [np.frombuffer(x, "<i4") for x in found]
            yield from to_batches(columns, schema, 2048)

    return rows.mapInArrow(read, "doc_id long, " + ("n_bytes long, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean" if checks else "ids array<int>"))


def decode_pieces(df: DataFrame, ids: str = "ids", keys: tuple[str, ...] = ("doc_id",), path: str | None = None, kind: str = "bpe") -> DataFrame:
    """``keys`` and the ``text`` of each row's ids; null ids give null, none give an empty text."""
    path = path or tokenizer_path("piece_bpe_32k.model")
    rows = df.select(*keys, F.col(ids).cast("array<int>").alias("ids_to_read"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path, kind)
        for batch in batches:
            own = batch.column(len(keys)).to_pylist()
            texts = [None if x is None else pieces.decode(np.array(x, "<u4").tobytes()) for x in own]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(texts, pa.string())], [*keys, "text"])

    return rows.mapInArrow(read, rows.drop("ids_to_read").withColumn("text", F.lit("")).schema)
