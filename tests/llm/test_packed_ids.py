"""Packed sequences hold their ids."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from siftstone.llm import packing, queries


def test_pipeline_keeps_ids_and_digests_come_from_them(spark, odd):
    rows = corpus_pipeline.packing(spark, odd, "").collect()
    assert rows and all(len(np.frombuffer(r.ids, "<u4")) == r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    packed = packing.packed_documents(odd)
    # Whatever the operator says of itself, the digest is of the ids that it gave.
    got = packing.digests(packed.withColumn("ids_crc32", F.lit(7).cast("long")).withColumn("ids", F.substring("ids", 1, 4)))
    assert got.columns == [c for c in packed.columns if c != "ids"]
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in got.collect()} == {(r.doc_id, r.piece, zlib.crc32(r.ids[:4])) for r in rows}


def test_query_packs_with_ids(spark, monkeypatch):
    seen = []
    whole = packing.packed_documents
    monkeypatch.setattr(packing, "packed_documents", lambda docs, **more: seen.append(whole(docs, **more)) or seen[-1])
    assert "ids" not in queries.op5_best_fit_packing(spark, "/root/testdata/sf0.001").columns and "ids" in seen[0].columns


def test_words_of_many_texts_at_once_are_those_of_the_pattern():
    draw = random.Random(5)
    signs = "abSTMDrevlLsz'''' \t\n\r\x0b\x0c0129!.-\x00\x1c\x7f\x08ÀÖØÞßàöøÿé"
    for _ in range(500):
        texts = ["".join(draw.choices(signs, k=draw.randrange(30))) for _ in range(draw.randrange(6))]
        words, cuts = packing.plain_words(texts)
        words = words.to_pylist()
        assert [words[a:b] for a, b in zip(cuts, cuts[1:])] == [packing.PLAIN.findall(text.lower()) for text in texts]


def test_ids_of_mixed_texts_are_the_librarys():
    path = packing.tokenizer_path("word_bpe_49k.json")
    texts = ["It's 'round we'LL, they've 'Sure 2024!'s", "", "Ünder Öl ß'd", "日本 x<|endoftext|>y", " \x0b\n", "a×b ÷ İstanbul", "'", "don't" * 40, "x" * 3000]
    library = packing.word_tokenizer(path)
    encode = packing._piece_ids(path)
    for own in (texts, [], [""], texts[3:4], texts[::-1]):
        assert [np.frombuffer(x, "<u4").tolist() for x in encode(own)] == [library.encode(x, add_special_tokens=False).ids for x in own]
