"""Small documents with every awkward case, and helpers."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
PROSE = ["the quick brown fox jumps over the lazy dog near the river bank today", "a long line of plain words that goes on for a while, and then stops.",
         "another sentence with other words in it, so that it is not like the first", "short", "It's 7 o'clock; the \"end\" isn't <|endoftext|> here..."]


@pytest.fixture(scope="session")
def odd_rows():
    long = " ".join(f"word{i % 97} thing{i}" for i in range(4000))
    texts = [None, "", " ", "\n\n", *PROSE, "\n".join(PROSE), "\n".join(PROSE), long, "x" * 5000, "naïve café ñandú Straße ΣΟΦΟΣ 中文字 🙂 á",
             "de  zwei   Leerzeichen", "!!! ??? 123 456"]
    rows = [(i, text, (None, "en", "de")[i % 3], f"src{i % 2}", None if text is None else len(text)) for i, text in enumerate(texts)]
    return [*rows, rows[9], rows[9], (None, PROSE[0], "en", None, 3), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(odd_rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
