"""What an index run does with every text: cleaned by bytes, embedded by batch, digested in few reads; all of it against plain Python."""

import hashlib
import math
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from siftstone.functions import documents as D
from siftstone.functions.paths import base_name
from siftstone.operators import index
from siftstone.operators.embed import hashing_embedder
from siftstone.sources.files import is_binary


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_cleaned_without_patterns(spark):
    wanted = {"a\r\nb\r\r\nc\r": "a\nb\n\nc", " 　a\x00b�\x85": "ab", "\x00 a": "a", "": "", "é\r😀 \n": "é\n😀", "\r": ""}
    texts = spark.createDataFrame([(text,) for text in [*wanted, None]], "text string")
    out = texts.select("text", D.normalize_embedding_text(F.col("text")).alias("clean"))
    assert {r.text: r.clean for r in out.collect()} == wanted | {None: None}
    assert "regexp" not in _plan(out)


def test_base_name_without_patterns(spark):
    wanted = {"": ".", "/": "/", "///": "/", "a": "a", "a/": "a", "/a/b.go": "b.go", "a//b//": "b", "a/ ": " ", "é/ü": "ü"}
    out = spark.createDataFrame([(path,) for path in [*wanted, None]], "path string").select("path", base_name(F.col("path")).alias("name"))
    assert {r.path: r.name for r in out.collect()} == wanted | {None: None}
    assert "regexp" not in _plan(out)


def test_binary_files(spark):
    def binary(content: bytes) -> bool:
        probe = content[:8192]
        odd = sum(b < 32 and b not in (9, 10, 12, 13) for b in probe)
        return 0 in probe or odd * 100 // max(len(probe), 1) > 10

    contents = [b"", b"text\n", b"\x00", b"a" * 8192 + b"\x00", b"\x01" + b"a" * 9, b"\x01\x01" + b"a" * 9, b"\xe2\x01\xf0\x80\x02\xc0" + b"\xff" * 5, b"\xe9" * 8 + b"\x02", "é€".encode() * 3 + b"\x03\x04", b"\x0b\x0e\x1f"]
    got = spark.createDataFrame([(c,) for c in contents], "content binary").select("content", is_binary(F.col("content")).alias("b"))
    assert {bytes(r.content): r.b for r in got.collect()} == {c: binary(c) for c in contents}
    assert "decode(" not in _plan(got)


def test_embedder_against_its_definition():
    texts = ["", " \n", "One two two THREE", "É é İ ß", *(" ".join(f"w{i * j % 17}" for i in range(j)) for j in range(60))]
    for dim in (1, 5, 16, 64):
        got = hashing_embedder(dim)(pd.Series(texts))
        assert len(got) == len(texts)
        for text, vector in zip(texts, got):
            counts = [0.0] * dim
            for word in text.lower().split():
                code = zlib.crc32(word.encode())
                counts[code % dim] += 1 if code & 0x10000 else -1
            length = math.sqrt(sum(x * x for x in counts))
            assert vector.dtype == np.float32 and vector.tolist() == np.array([x / length if length else x for x in counts]).astype(np.float32).tolist()
    assert len(hashing_embedder(4)(pd.Series([], dtype=object))) == 0


def test_digest_against_its_definition(spark):
    single = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    vectors = [[0.25, -3.0, 0.0], [single(0.1), single(-1e-9), single(2.0**-41)], [-0.0, 1.0, single(123456.789)], []]
    rows = [("p", "m", f"a/{i}.go", i, f"s{i}", "func", "é", "", "é", "", "d", "b\n", f"h{i}", vector) for i, vector in enumerate(vectors)]
    schema = ", ".join(f"{name} {'int' if name == 'line' else 'string'}" for name in index.DIGEST_FIELDS) + ", embedding array<float>"
    out = index.logical_digest(spark.createDataFrame(rows, schema))

    def exact(x: float) -> str:
        scaled = x * 2.0**40
        rest = (scaled - math.floor(scaled)) * 2.0**55
        return f"{math.floor(scaled)}.{math.floor(rest)}.{math.floor((rest - math.floor(rest)) * 2.0**55)}"

    sums = [0] * 16
    for *fields, vector in rows:
        text = "".join(f"{len(str(field).encode())}:{field}" for field in fields) + ",".join(map(exact, vector))
        digest = hashlib.sha256(text.encode()).hexdigest()
        sums = [total + int(digest[4 * at : 4 * at + 4], 16) for at, total in enumerate(sums)]
    assert [tuple(r) for r in out.collect()] == [(4, hashlib.sha256("|".join(map(str, [4, *sums])).encode()).hexdigest())]
    assert _plan(out).count("conv(") == 6
