"""Token counts from counts of distinct pre-tokens.

Pieces are counted once per distinct pre-token of the corpus and joined to the
pre-token frequencies of the documents; ids are never built. The frequencies
of a block, up to some ten thousand documents, wait as one packed row; only its
distinct pre-tokens are shuffled. So the most frequent pre-token is one short
row per block.

Words between blanks, tabs and line breaks come first: the tokenizer drops
white space, so a word's pre-tokens do not depend on its neighbours and the
tokenizer splits each distinct word of a block once.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.session import materialize

from .common import block_ids, blocks, to_batches, tokenizer_path, whole_text, word_tokenizer

WORD = re.compile(r"[^ \t\n\r]+")
BLOCK = {"rows": 32_768, "size": 32 << 20}
PACKED = ("block long, doc_ids array<long>, n_bytes array<long>, sizes binary, words_at binary, counts binary, "
          "splits binary, tokens_at binary, tokens array<string>")


def _ints(values, packer=zstandard.ZstdCompressor(level=3).compress) -> bytes:
    return packer(np.asarray(values, "<i4").tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i4").astype("<i8")


def _pre_tokens(word: str, tokenizer, special: tuple[str, ...]) -> list[str]:
    """The tokenizer's own pre-tokens of a word; one with a special string in it stays whole."""
    if any(x in word for x in special):
        return [word]
    plain = tokenizer.normalizer.normalize_str(word) if tokenizer.normalizer else word
    return [plain[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(plain)]


def _frequencies(path: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per block: its distinct pre-tokens and each document's counts of them."""
        tokenizer = word_tokenizer(path)
        special = tuple(x.content for x in tokenizer.get_added_tokens_decoder().values())
        ids = block_ids()
        numbers = pa.list_(pa.int64())
        schema = pa.schema([("block", pa.int64()), ("doc_ids", numbers), ("n_bytes", numbers), *((x, pa.binary()) for x in (
            "sizes", "words_at", "counts", "splits", "tokens_at")), ("tokens", pa.list_(pa.string()))])
        for part in blocks(batches, **BLOCK):
            places: dict[str, int] = {}
            sizes, at, counts = array("i"), array("i"), array("i")
            for text in part.column("text"):
                found = Counter(WORD.findall(text.as_py()))
                own = sorted((places.setdefault(word, len(places)), n) for word, n in found.items())
                sizes.append(len(own))
                at.extend(x for x, _ in own)
                counts.extend(n for _, n in own)
            tokens: dict[str, int] = {}
            splits, tokens_at = array("i"), array("i")
            for word in places:
                own = _pre_tokens(word, tokenizer, special)
                splits.append(len(own))
                tokens_at.extend(tokens.setdefault(x, len(tokens)) for x in own)
            yield from to_batches({
                "block": [next(ids)], "doc_ids": [part.column("doc_id").to_pylist()], "n_bytes": [pc.binary_length(part.column("text")).to_pylist()],
                # Differences between ascending places are small and pack well.
                "sizes": [_ints(sizes)], "words_at": [_ints(np.diff(np.array(at, "<i4"), prepend=np.int32(0)))], "counts": [_ints(counts)],
                "splits": [_ints(splits)], "tokens_at": [_ints(tokens_at)], "tokens": [list(tokens)]}, schema)

    return pack


def _pieces(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The number of pieces for rows sorted by pre-token, each distinct one encoded once."""
        encode = word_tokenizer(path).encode_batch_fast
        last, last_pieces = None, 0
        for batch in batches:
            coded = batch.column("token").dictionary_encode()
            words = coded.dictionary.to_pylist()
            if not words:
                continue
            known = {last: last_pieces} if words[0] == last else {}
            pieces = [*known.values(), *(len(x.ids) for x in encode(words[len(known) :], add_special_tokens=False))]
            last, last_pieces = words[-1], pieces[-1]
            # A row per block, not per pre-token, goes back.
            of_block, places = batch.column("block").to_numpy(), batch.column("place").to_numpy()
            order = np.argsort(of_block, kind="stable")
            owners, starts = np.unique(of_block[order], return_index=True)
            places, found = places[order], np.array(pieces, "<i4")[coded.indices.to_numpy()[order]]
            cut = lambda x: [part.astype("<i4").tobytes() for part in np.split(x, starts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(cut(places), pa.binary()), pa.array(cut(found), pa.binary())], ["of_block", "places", "pieces"])

    return count


def _sums(packed: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of one block with the sum of count times pieces."""
    out: dict[str, list] = {"doc_id": [], "n_bytes": [], "n_tokens": []}
    whole = lambda name: np.frombuffer(b"".join(answers.column(name).to_pylist()), "<i4")
    pieces = np.zeros(len(whole("places")), "<i8")
    pieces[whole("places")] = whole("pieces")
    for row in packed.to_pylist():
        # Sums below 2 ** 53 are exact in the float weights of bincount.
        total = lambda sizes, values: np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=values, minlength=len(sizes)).astype("<i8")
        of_word = total(_unpacked(row["splits"]), pieces[_unpacked(row["tokens_at"])])
        sums = total(_unpacked(row["sizes"]), _unpacked(row["counts"]) * of_word[np.cumsum(_unpacked(row["words_at"]))])
        out["doc_id"] += row["doc_ids"]
        out["n_bytes"] += row["n_bytes"]
        out["n_tokens"] += sums.tolist()
    return pa.table(out, schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())]))


def count_tokens(docs: DataFrame, text: str | Column = "text", doc_id: str | Column = "doc_id", path: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row, as the tokenizer of ``path`` gives them without special tokens.

    A null text counts as empty: 0 bytes, 0 tokens. A null id stays null. A
    repeated row gives a row each time; other columns are not looked at. A
    very long text is a block of its own. Special strings inside a text count
    as the tokenizer's default has it.
    """
    path = path or tokenizer_path("word_bpe_49k.json")
    rows = docs.select((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    packed = materialize(rows.mapInArrow(_frequencies(path), PACKED), "pretokens")
    asked = packed.select("block", F.posexplode("tokens").alias("place", "token"))
    sorted_tokens = asked.repartition("token").sortWithinPartitions("token")
    answers = sorted_tokens.mapInArrow(_pieces(path), "of_block long, places binary, pieces binary")
    return packed.drop("tokens").groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(_sums, "doc_id long, n_bytes long, n_tokens long")
