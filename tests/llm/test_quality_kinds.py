"""What the quality classifier rejects, by kind of bad document."""

from collections import Counter

from siftstone.llm import quality

SF = "/root/testdata/sf0.1"


def kind(text):
    """Words over and over, symbols at words, shouting, tables; the rest is mostly a line or two."""
    words = text.split()
    pairs = list(zip(words, words[1:]))
    if sum(a == b for a, b in pairs) > 0.2 * max(1, len(pairs)):
        return "repetition" if len(words) >= 25 else "short"
    if len(words) < 25:
        return "short"
    if text.count("###") + text.count("$$$") + text.count("%%%") + text.count("&&&") + text.count("***") > 0.1 * len(words):
        return "symbols"
    return "shouting" if text.count("!!") > 0.1 * len(words) else "tables" if text.count("|") > 0.1 * len(words) else "other"


def test_recall_by_kind(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.classify(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    bad, gone = Counter(), Counter()
    for r in rows:
        if r.quality == 0:
            bad[kind(r.text)] += 1
            gone[kind(r.text)] += not r.keep
    print({k: (gone[k], n) for k, n in bad.items()})
    good = [r.keep for r in rows if r.quality == 1]
    print("good", sum(good), len(good))
    assert sum(good) >= 0.999 * len(good)
    for k in ("repetition", "symbols", "shouting", "tables"):
        assert bad[k] >= 50 and gone[k] >= 0.97 * bad[k], k


def test_low_perplexity_goes(spark):
    prose = [(i, " ".join(f"{a}{b}{(i * 7 + k) % 13}" for k, (a, b) in enumerate(zip("abcdefghij" * 4, "klmnopqrstuvw" * 4))) + " " + "a" * 12) for i in range(60)]
    docs = spark.createDataFrame([*prose, (99, "a" * 4000)], "doc_id long, text string").selectExpr("*", "'en' lang")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert all(rows[i].keep and rows[i].low_threshold < rows[i].perplexity for i in range(60)) and rows[99].perplexity < rows[99].low_threshold and not rows[99].keep
    assert quality.repeats("a b a b a b") == (6, 3) and quality.repeats("") == (0, 0) and quality.repeats("x") == (1, 0)


def test_pieces_stay_small_and_their_tables_begin_small(monkeypatch):
    texts = [f"{i} plain words and marks, again and again; " * 40 for i in range(1200)]
    assert sum(map(len, texts)) > 1 << 21
    seen = []
    real = quality.pd.factorize
    monkeypatch.setattr(quality.pd, "factorize", lambda values, **more: seen.append((len(values), more.get("size_hint"))) or real(values, **more))
    names = quality.distinct_grams(texts, 4)
    # A table that is not told its size has room for every position at once; a piece is one text over its bound at most.
    assert seen and all(n <= (1 << 19) + 4000 and hint is not None and hint <= n for n, hint in seen)
    padded = [quality.BEGIN * 3 + text + quality.END for text in texts]
    assert names == {text[i : i + 4] for text in padded for i in range(len(text) - 3)}


def test_a_text_is_cut_where_it_was(monkeypatch):
    long = "ab" * 700_000
    assert [len(padded[0]) for padded, _ in quality.pieces([long], 4)] == [(1 << 20) + 3, len(long) + 4 - (1 << 20)]
    owners = [owners.tolist() for _, owners in quality.pieces(["x" * 300_000] * 4, 4)]
    assert owners == [[0, 1], [2, 3]]
