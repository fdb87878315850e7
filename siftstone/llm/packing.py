"""Best-fit packing of token pieces into sequences under several capacities at once.

A sequence has three capacities: tokens, documents and attention cost (the sum
of squared piece lengths). A task packs blocks of a bounded size of the pieces it
has made, longest first, each into the open sequence that fits it best under
every constraint. What blocks leave in sequences that are not full is dealt by
a hash into blocks again, so the waste is a constant share however large the
input, and few ids are shuffled.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.session import materialize, scratch_dir

from .common import block_ids, blocks, release, tokenizer_path, whole_text, word_tokenizer

WORD = re.compile(r"[^ \t\n\r]+")
#: Words whose ids a Python worker remembers; the memory of a worker stays bounded.
REMEMBERED = 250_000
#: Marks at the end of a word of letters are a pre-token of their own; an apostrophe may not be.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


# Of ASCII texts, and of texts of these characters alone, the pre-tokens are known: once in lower case, what PLAIN finds (``plain_words`` finds the same for many texts at once).
SIMPLE = re.compile(r"[\x00-\x7FÀ-ÖØ-öø-ÿ]*+")
PLAIN = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^ \t\n\r\x0B\x0Ca-zß-öø-ÿ0-9]+")
# The same by bytes of UTF-8: all that is not ASCII in such texts is a letter of two bytes, lowered in its second.
BLANK, LETTER, DIGIT, OTHER = range(4)
KIND = np.full(256, OTHER, "u1")
KIND[list(b" \t\n\r\x0B\x0C")], KIND[list(b"0123456789")] = BLANK, DIGIT
KIND[ord("a") : ord("z") + 1] = KIND[128:] = LETTER
LOWER = np.arange(256).astype("u1")
LOWER[ord("A") : ord("Z") + 1] += 32
LOWER[0x80:0x9F] += 32


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence; ``documents`` and ``attention`` as None bind no tighter than ``tokens`` does."""

    tokens: int = 4096
    documents: int | None = None
    attention: int | None = None
    #: Share of each capacity in the score.
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    #: ``norm``: least weighted norm of what stays free; ``dot``: greatest weighted dot product of need and what is free.
    score: str = "norm"

    def capacity(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], "f8")


def best_fit(lengths: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and offset of each piece; ``lengths`` is in placing order.

    Ties go to the sequence opened first. A piece beyond a capacity on its own
    is a ``ValueError``.
    """
    capacity = limits.capacity()
    weights = np.array(limits.weights)
    need = np.stack([lengths, np.ones(len(lengths)), lengths.astype("f8") ** 2], axis=1).astype("f8")
    if (need > capacity).any():
        raise ValueError("a piece does not fit an empty sequence")
    least = lengths[::-1].copy()
    np.minimum.accumulate(least, out=least)
    least = least[::-1]  # the shortest piece still to come
    sequence, offset = np.zeros(len(lengths), "i8"), np.zeros(len(lengths), "i8")
    free = np.empty((256, 3))
    names = np.empty(256, "i8")
    used = opened = 0
    for i, wanted in enumerate(need):
        chosen = -1
        if used:
            rest = free[:used] - wanted
            if limits.score == "norm":
                scores = (((rest / capacity) ** 2) * weights).sum(axis=1)
            else:
                scores = -((free[:used] / capacity) * (wanted / capacity) * weights).sum(axis=1)
            scores[(rest < 0).any(axis=1)] = np.inf
            best = int(np.argmin(scores))
            if scores[best] < np.inf:
                # Closing moves the last row, so ties are settled by name.
                same = np.flatnonzero(scores == scores[best])
                chosen = int(same[np.argmin(names[same])])
        if chosen < 0:
            if used == len(free):
                free, names = np.resize(free, (2 * used, 3)), np.resize(names, 2 * used)
            chosen = used
            free[chosen], names[chosen] = capacity, opened
            used, opened = used + 1, opened + 1
        sequence[i], offset[i] = names[chosen], limits.tokens - free[chosen, 0]
        free[chosen] -= wanted
        after = least[i + 1] if i + 1 < len(least) else np.inf
        if free[chosen, 0] < after or free[chosen, 1] < 1:
            used -= 1
            free[chosen], names[chosen] = free[used], names[used]
    return sequence, offset


def _placed(table: pa.Table, keys: tuple[str, ...], length: str, limits: Limits) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The rows of ``table`` in placing order, longest first, with the sequence and offset of each."""
    table = table.take(pc.sort_indices(table.select([length, *keys]), sort_keys=[(length, "descending"), *((k, "ascending") for k in keys)]))
    return (table, *best_fit(table.column(length).to_numpy().astype("i8"), limits))


def pack(pieces: DataFrame, keys: tuple[str, ...] = ("doc_id", "piece"), length: str = "length", limits: Limits = Limits(), block_rows: int = 8192) -> DataFrame:
    """All columns of ``pieces`` with ``sequence_id`` and ``offset``.

    ``length`` is positive and at most the token capacity. Null keys are allowed, and repeated
    rows are packed each. ``sequence_id`` and ``offset`` of the input, if any,
    are replaced. An empty table gives an empty one.
    """
    pieces = materialize(pieces.drop("sequence_id", "offset"), "pieces")
    n_blocks = max(1, -(-pieces.count() // block_rows))
    # Rows of a written table keep their number when a task runs again; it spreads repeated rows.
    salt = F.xxhash64(*keys, length, F.monotonically_increasing_id())
    schema = pieces.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema

    def place(group: pa.Table) -> pa.Table:
        block = group.column("pack_block")[0].as_py()
        group, sequence, offset = _placed(group.drop_columns("pack_block"), keys, length, limits)
        return group.append_column("sequence_id", pa.array(sequence + (block << 32), pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return pieces.withColumn("pack_block", F.pmod(salt, F.lit(n_blocks))).groupBy("pack_block").applyInArrow(place, schema)


def plain_words(texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
    """What ``PLAIN`` finds in the lower case of SIMPLE texts, one after the other, and where each text's words begin and end."""
    coded = [text.encode() for text in texts]
    # Blanks after a text end its last word; four at the end of all let an apostrophe look ahead.
    data = LOWER[np.frombuffer(b" ".join([*coded, b"   "]), "u1")]
    kind = KIND[data]
    inside = kind != BLANK
    starts = np.empty(len(kind), bool)
    starts[:1] = inside[:1]
    starts[1:] = inside[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
    mark = np.flatnonzero(starts & (data == ord("'")))
    after = data[mark + 1]
    two = mark[np.isin(after, list(b"stmd"))]
    pairs = after.astype("u2") << 8 | data[mark + 2]
    three = mark[np.isin(pairs, [int.from_bytes(x, "big") for x in (b"re", b"ve", b"ll")])]
    starts[two + 1] = starts[three + 1] = False
    starts[two + 2], starts[three + 3] = inside[two + 2], inside[three + 3]
    ends = np.cumsum([len(x) + 1 for x in coded], dtype="i8")
    at = np.flatnonzero(starts)
    cuts = np.searchsorted(at, np.concatenate(([0], ends)))
    data = data[inside]
    offsets = np.append(np.flatnonzero(starts[inside]), len(data)).astype("i4")
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)), cuts


def _piece_ids(path: str):
    """Ids of whole texts as little-endian bytes, pre-token by pre-token (else word by word) with a bounded memory."""
    tokenizer = word_tokenizer(path)
    added = [token.content for token in tokenizer.get_added_tokens_decoder().values()]
    encode = tokenizer.encode_batch_fast
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    ends[[i for piece, i in tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True
    known: dict[str, bytes] = {}

    def one_by_one(words: list[str]) -> None:
        for word, found in zip(words, encode(words, add_special_tokens=False)):
            known[word] = np.array(found.ids, "<u4").tobytes()

    def letters_only(words: list[str]) -> None:
        """Such a word is one pre-token, with one end-of-word piece, so many are encoded as one text."""
        for at in range(0, len(words), 4096):
            own = words[at : at + 4096]
            ids = np.array(encode([" ".join(own)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ends[ids]) + 1
            if len(cuts) == len(own) and cuts[-1] == len(ids):
                data, start = ids.tobytes(), 0
                for word, stop in zip(own, (4 * cuts).tolist()):
                    known[word] = data[start:stop]
                    start = stop
            else:  # a letter whose lower case is not one
                one_by_one(own)

    def learn(new: list[str]) -> None:
        plain = [word for word in new if word.isalpha()]
        letters_only(plain)
        new = [word for word in new if word not in known]
        split = [(word, core, word[len(core) :]) for word in new if (core := word.rstrip(MARKS)) and core.isalpha()]
        rest = [word for word in new if not ((core := word.rstrip(MARKS)) and core.isalpha())]
        letters_only([core for core in dict.fromkeys(core for _, core, _ in split) if core not in known])
        one_by_one([mark for mark in {mark for _, _, mark in split if mark} if mark not in known])
        for word, core, mark in split:
            if mark:
                known[word] = known[core] + known[mark]
        one_by_one(rest)

    def ids(texts: list[str]) -> list[bytes]:
        nonlocal known
        simple = [(text.isascii() or SIMPLE.fullmatch(text) is not None) and not any(map(text.__contains__, added)) for text in texts]
        words, cuts = plain_words([text for text, plain in zip(texts, simple) if plain])
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        others = [WORD.findall(text) for text, plain in zip(texts, simple) if not plain]
        own = set(distinct).union(*others)
        if len(known) > REMEMBERED:
            known = {word: known[word] for word in own if word in known}
        learn(list(own.difference(known)))
        get = known.__getitem__
        # The ids of all plain words one after the other: a text's are a part of them.
        found = pa.array(map(get, distinct), pa.large_binary(), size=len(distinct)).take(coded.indices)
        places = np.frombuffer(found.buffers()[1], "i8")[cuts].tolist() if len(found) else [0] * len(cuts)
        data = memoryview(found.buffers()[2]) if len(found) else b""
        plain_ids = (bytes(data[a:b]) for a, b in zip(places, places[1:]))
        other_ids = (b"".join(map(get, x)) for x in others)
        return [next(plain_ids if plain else other_ids) for plain in simple]

    return ids


PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def _cut_pieces(batches: Iterator[pa.RecordBatch], path: str, end: int, limit: int, keep_ids: bool) -> Iterator[pa.Table]:
    """The pieces of each block of ``doc_id, text``."""
    encode = _piece_ids(path)
    last = np.array([end], "<u4").tobytes()
    for part in blocks(batches, rows=1024, size=2 << 20):
        kept = PIECE if keep_ids else pa.schema(list(PIECE)[:-1])
        columns: dict[str, list] = {name: [] for name in kept.names}
        for key, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist())):
            ids += last
            for piece, at in enumerate(range(0, len(ids), 4 * limit)):
                own = ids[at : at + 4 * limit]
                for name, value in zip(kept.names, (key, piece, at // 4, len(own) // 4, zlib.crc32(own), own)):
                    columns[name].append(value)
        yield pa.Table.from_pydict(columns, schema=kept)


def _texts(docs: DataFrame, text: str | Column, doc_id: str | Column) -> DataFrame:
    return docs.select((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))


def token_pieces(docs: DataFrame, text: str | Column = "text", doc_id: str | Column = "doc_id", path: str | None = None, end: int = 1,
                 limit: int = 4096, keep_ids: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``: documents as ids with ``end`` after them, cut at ``limit``.

    ``ids`` are bytes, an unsigned 32-bit number, little-endian, each. Only a longer document is cut. A null or empty text is the end id alone.
    White space is dropped by this tokenizer, so ids are looked up by pre-token or word.
    """
    path = path or tokenizer_path("word_bpe_49k.json")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _cut_pieces(batches, path, end, limit, keep_ids):
            yield from table.to_batches()

    return _texts(docs, text, doc_id).mapInArrow(cut, PIECE_DDL if keep_ids else PIECE_DDL.removesuffix(", ids binary"))


def packed_documents(docs: DataFrame, limits: Limits = Limits(), text: str | Column = "text", doc_id: str | Column = "doc_id", path: str | None = None, end: int = 1,
                     block_rows: int = 8192, block_ids_limit: int = 2 << 20, slack: float = 1 / 64) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset``: documents cut into pieces and packed; see ``token_pieces``.

    A task packs the pieces it has made, a block of at most ``block_rows`` pieces and about
    ``block_ids_limit`` ids at a time, so ids stay where they are. Only pieces of sequences with more than ``slack`` of
    their tokens free, a few of each block, are shuffled and packed again by ``pack``.
    """
    path = path or tokenizer_path("word_bpe_49k.json")
    schema = pa.schema([*PIECE, ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())])

    def place(tables: list[pa.Table], block: int) -> Iterator[pa.RecordBatch]:
        table, sequence, offset = _placed(pa.concat_tables(tables), ("doc_id", "piece"), "length", limits)
        used = np.bincount(sequence, weights=table.column("length").to_numpy())
        found = table.append_column("sequence_id", pa.array(sequence + (block << 20), pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
        yield from found.append_column("open", pa.array(used[sequence] < limits.tokens * (1 - slack))).cast(schema).to_batches(max_chunksize=1024)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task's blocks are numbered below 2^20 with room for 2^20 sequences each.
        names = ((name >> 32) * (1 << 20) + (name & 0xFFFFF) for name in block_ids())
        held: list[pa.Table] = []
        for table in _cut_pieces(batches, path, end, limits.tokens, True):
            held.append(table)
            if sum(t.num_rows for t in held) >= block_rows or sum(t.column("ids").nbytes for t in held) >= 4 * block_ids_limit:
                yield from place(held, next(names))
                held = []
        if held:
            yield from place(held, next(names))
        held = []
        release()

    ddl = f"{PIECE_DDL}, sequence_id long, offset long"
    # By folder, so that the few pieces to pack again are read without the others.
    where = f"{scratch_dir(docs.sparkSession)}/packed-{uuid.uuid4().hex}"
    _texts(docs, text, doc_id).mapInArrow(run, f"{ddl}, open boolean").write.partitionBy("open").parquet(where)
    packed = docs.sparkSession.read.schema(f"{ddl}, open boolean").parquet(where)
    # Sequences of the second packing have negative ids.
    again = pack(packed.filter("open").drop("open"), limits=limits, block_rows=block_rows).withColumn("sequence_id", -1 - F.col("sequence_id"))
    return packed.filter("not open").drop("open").unionByName(again)


def digests(packed: DataFrame) -> DataFrame:
    """``packed`` with ``ids_crc32`` taken anew from its ``ids``, which go."""
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
