"""Operators that read one text at a time, against the libraries and brute force."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftstone.llm import fingerprints, language_id, media, queries, sentence_pieces, token_counts
from siftstone.llm.common import tokenizer_path

SF = "/root/testdata/sf0.001"


def texts_of(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# --- media


def test_media_query(spark):
    texts = texts_of(spark)
    rows = queries.op1_media_columns(spark, SF).collect()
    assert len(rows) == len(texts)
    for row in rows:
        data = texts[row.doc_id].encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        assert (row.n_bytes, row.payload_bytes, row.payload_sha256, row.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        content = media.stored(payload)
        assert (row.media_bytes, row.media_sha256) == (len(content), hashlib.sha256(content).hexdigest())
        assert row.n_samples == len(payload) // 192 and row.codec == "raw " and row.duration == pytest.approx(row.n_samples * 0.04)


def test_media_odd_rows(spark, odd, odd_rows, empty):
    rows = media.media_tracks(media.store_texts(odd), checks=True).collect()
    assert len(rows) == len(odd_rows) and all(r.error is None for r in rows)
    assert media.media_tracks(media.store_texts(empty)).count() == 0


def test_media_keyframes_and_damage(spark):
    content = media.stored(bytes(range(192)) * 20)
    track = media.tracks_of(content)[0]
    start = content.index(b"mdat") + 4
    assert [(r["sample"], r["start"], r["length"]) for r in track["keyframe_ranges"]] == [(0, start, 192), (8, start + 8 * 192, 192), (16, start + 16 * 192, 192)]
    bad = [None, b"", b"abc", content[:-1], b"\0\0\0\x08free", struct.pack(">I", 4) + b"moov" + content, content.replace(b"stco", b"free")]
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate([*bad, content])], "doc_id long, content binary, codec string")
    rows = {r.doc_id: r for r in media.media_tracks(df, checks=True).collect()}
    assert all(rows[i].error and rows[i].codec is None for i in range(len(bad)))
    assert rows[len(bad)].error is None and rows[len(bad)].n_keyframes == 3
    with pytest.raises(ValueError):
        media.media_tracks(df, keys=("doc_id", "codec"))


def _box(kind, body):
    return struct.pack(">I4s", len(body) + 8, kind) + body


def test_media_fragments():
    """Samples of a movie fragment, with defaults from the movie header and sizes of their own."""
    whole = media.stored(b"")
    moov = whole[whole.index(b"moov") - 4 :]
    trex = _box(b"mvex", _box(b"trex", struct.pack(">6I", 0, 1, 1, 40, 7, 0x10000)))
    moov = struct.pack(">I", len(moov) + len(trex)) + moov[4:] + trex
    tfhd = _box(b"tfhd", struct.pack(">II", 0x20000, 1))
    trun = _box(b"trun", struct.pack(">IIiIIII", 0x205, 3, 0, 0, 5, 6, 7))
    moof = _box(b"moof", _box(b"traf", tfhd + trun))
    trun = _box(b"trun", struct.pack(">IIiIIII", 0x205, 3, len(moof) + 8, 0, 5, 6, 7))
    moof = _box(b"moof", _box(b"traf", tfhd + trun))
    data = moov + moof + _box(b"mdat", b"aaaaabbbbbbccccccc")
    track = media.tracks_of(data)[0]
    assert media.payload_of(data, track["samples"]) == b"aaaaabbbbbbccccccc"
    assert track["n_samples"] == 3 and track["duration"] == 0.12
    assert track["keyframe_ranges"] == [{"sample": 0, "samples": 1, "start": len(moov) + len(moof) + 8, "length": 5}]


# --- SentencePiece


def test_pieces_equal_the_library():
    path = tokenizer_path("piece_bpe_32k.model")
    model, ours = sentencepiece.SentencePieceProcessor(model_file=path), sentence_pieces.load(path)
    draw = random.Random(3)
    letters = [*"abc  \t\n éñßΣ▁中国́\x00.,!🙂the in on er  ", "    ", "the", "ing", " of"]
    texts = ["", " ", "    x", "▁", *("".join(draw.choice(letters) for _ in range(draw.randint(0, 50))) for _ in range(800))]
    for text, found in zip(texts, ours.encode(texts)):
        want = model.encode(text)
        assert np.frombuffer(found, "<u4").tolist() == want, repr(text)
        assert ours.decode(found) == model.decode(want)


def test_pieces_query(spark, odd, odd_rows, empty):
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    texts = texts_of(spark)
    for row in queries.op2_sentence_pieces(spark, SF).collect():
        ids = model.encode(texts[row.doc_id])
        assert (row.n_pieces, row.ids_crc32, row.round_trip) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
    encoded = sentence_pieces.encode_pieces(odd)
    decoded = sentence_pieces.decode_pieces(encoded)
    assert sorted(map(str, (r.text for r in decoded.collect()))) == sorted(r[1] or "" for r in odd_rows)
    assert sentence_pieces.decode_pieces(sentence_pieces.encode_pieces(empty)).count() == 0


def test_unigram_takes_the_greatest_sum():
    draw = random.Random(5)
    words = sorted({"".join(draw.choice("ab▁") for _ in range(draw.randint(1, 4))) for _ in range(20)} | {"a", "▁"})
    pieces = sentence_pieces.Pieces([(w, -draw.uniform(1, 9), i) for i, w in enumerate(words)], "unigram")
    scores = {w: pieces.scores[i] for w, i in pieces.ids.items()}

    def best(text):
        sums = [0.0]
        for end in range(1, len(text) + 1):
            ways = [sums[at] + scores[text[at:end]] for at in range(end) if text[at:end] in scores]
            if text[end - 1] not in scores:
                ways.append(sums[end - 1] + pieces.least)
            sums.append(max(ways))
        return sums[-1]

    texts = sorted({"".join(draw.choice("aab▁c") for _ in range(draw.randint(1, 12))) for _ in range(300)})
    for text, found in zip(texts, pieces.encode_sorted(texts)):
        total = sum(pieces.scores[i] if i in pieces.scores else pieces.least for i in found if not (i == 0 and "c" in text)) if "c" not in text else None
        if total is not None:
            assert total == pytest.approx(best(text)), text


# --- token counts


def test_token_counts(spark, odd, odd_rows, empty):
    model = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    count = lambda text: len(model.encode(text or "", add_special_tokens=False).ids)
    texts = texts_of(spark)
    rows = queries.op9_token_counts(spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.n_bytes, r.over_limit) for r in rows} == {k: (count(x), len(x.encode()), count(x) > 2048) for k, x in texts.items()}
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(odd).collect())
    assert got == sorted((str(r[0]), len((r[1] or "").encode()), count(r[1])) for r in odd_rows)
    assert token_counts.count_tokens(empty).count() == 0


# --- language


def test_language_accuracy_held_out(spark):
    rows = queries.op8_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98 and all(0 <= r.score <= 1 for r in rows)


def test_language_of_copies_and_of_labels_without_letters(spark):
    """Thousands of copies of one sentence are one text to learn from; labels of texts without a letter teach nothing."""
    english = [f"the cat number {chr(97 + i % 26)}{chr(97 + i // 26)} sat on the mat and looked at this" for i in range(300)]
    german = "der Hund läuft über die Straße und bellt sehr laut"
    copies = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit(german).alias("text"), F.lit("de").alias("lang"))
    rows = copies.unionByName(spark.createDataFrame([(10_000 + i, x, "en") for i, x in enumerate(english)], "doc_id long, text string, lang string"))
    model = language_id.fit(rows)
    asked = spark.createDataFrame([(1, german), (2, "die Straße und der Hund"), (3, english[0]), (4, "the mat and the cat")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.predict_languages(asked, model).collect()} == {1: "de", 2: "de", 3: "en", 4: "en"}
    none = language_id.fit(spark.createDataFrame([(1, "123", "en"), (2, "456", "de"), (3, None, "fr")], "doc_id long, text string, lang string"))
    assert {(r.lang_pred, r.score) for r in language_id.predict_languages(asked, none).collect()} == {("und", 0.0)}


def test_language_odd_rows(spark, odd, odd_rows, empty):
    model = language_id.fit(odd)
    rows = language_id.predict_languages(odd.withColumn("score", F.lit("clash")), model).collect()
    assert len(rows) == len(odd_rows)
    letters = {r[0]: any(c.isalpha() for c in r[1] or "") for r in odd_rows if r[0] is not None}
    assert all((r.lang_pred == "und") == (not letters[r.doc_id]) for r in rows if r.doc_id is not None)
    kept = language_id.keep_known_languages(odd, model)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} <= {k for k, x in letters.items() if x} | {None}
    none = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.predict_languages(odd, none).collect()} == {"und"}
    assert language_id.predict_languages(empty, model).count() == 0


def test_kernel_is_a_presence_kernel():
    texts = ["abc", "abd", "abc abc", "xyz"]
    flags = language_id.presence(texts).astype(float)
    grams = [{p[i : i + n] for p in [f" {t} "] for n in (1, 2, 3) for i in range(len(p) - n + 1)} for t in texts]
    assert [int(x) for x in flags.sum(axis=1)] == [len(g) for g in grams]
    assert flags[0] @ flags[1] == len(grams[0] & grams[1]) and flags[0] @ flags[3] == len(grams[0] & grams[3])


# --- fingerprints


def test_peeling_recovers_differences():
    draw = random.Random(7)
    keys = [draw.getrandbits(64) for _ in range(900)]
    left = [keys[:300], keys[:40], [], keys[:5], keys]
    right = [keys[10:320], keys[200:260], [], keys[:5], []]
    for a, b, (only_a, only_b) in zip(left, right, fingerprints.differences(left, right)):
        assert sorted(only_a) == sorted(set(a) - set(b)) and sorted(only_b) == sorted(set(b) - set(a))
    assert fingerprints.likeness(fingerprints.Sets([[1, 2], []]), fingerprints.Sets([[1, 3], []])) == [pytest.approx(1 / 3), 1.0]


def expected_fingerprints(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (key, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        changed = fingerprints.edited(text, following)
        near = []
        for other in (changed, following):
            a, b = set(fingerprints.digests(text)), set(fingerprints.digests(other))
            near.append(len(a & b) / len(a | b) if a | b else 1.0)
        out[key] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), *map(pytest.approx, near))
    return out


def test_fingerprint_query(spark):
    rows = queries.op6_document_fingerprints(spark, SF).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in rows} == expected_fingerprints(texts_of(spark).items())


def test_fingerprint_odd_rows(spark, odd, odd_rows, empty):
    assert len(fingerprints.fingerprint_documents(odd).collect()) == len(odd_rows)
    assert fingerprints.fingerprint_documents(empty).count() == 0
    one = spark.createDataFrame([(4, "only\none. two")], "doc_id long, text string")
    row = fingerprints.fingerprint_documents(one).collect()
    assert len(row) == 1 and row[0].near_next == 1.0
    pairs = spark.createDataFrame([(i, f"line {i}.\nother {i * 7}.") for i in range(50)], "doc_id long, text string").repartition(7)
    rows = fingerprints.fingerprint_documents(pairs).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in rows} == expected_fingerprints([(i, f"line {i}.\nother {i * 7}.") for i in range(50)])
