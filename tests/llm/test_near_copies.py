"""Near copies of the pipeline's stage, against all pairs."""

import random

import corpus_pipeline
from siftstone.llm import near_copies


def shingles(text, size=5):
    words = text.lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def jaccard(a, b, size=5):
    a, b = shingles(a, size), shingles(b, size)
    return len(a & b) / len(a | b) if a | b else 1.0


def least_of_each(rows, similarity=0.8):
    """The least id of each component over all pairs."""
    root = {i: i for i, _ in rows}
    sets = [shingles(x) for _, x in rows]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, _) in enumerate(rows):
        for (j, _), y in zip(rows[:k], sets):
            x = sets[k]
            if min(len(x), len(y)) < similarity * max(len(x), len(y)):
                continue
            shared = len(x & y)
            if shared >= similarity * (len(x) + len(y) - shared):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in root if root[i] == i}


def test_stage_joins_all_pairs_of_eight_tenths(spark):
    draw = random.Random(3)
    word = lambda: f"w{draw.randrange(5000)}"
    common = " ".join(word() for _ in range(30))
    rows = []
    for k in range(30):
        base = [word() for _ in range(draw.randint(5, 200))]
        for edits in (0, 0, 1, 2, 3, 5):
            own = list(base)
            for _ in range(edits):
                own[draw.randrange(len(own))] = word()
            rows.append(" ".join(own) + (f" {common}" if k % 3 == 0 else ""))
    # A chain whose ends are not alike, exactly 0.8, and texts of a word, blanks or nothing.
    base = [word() for _ in range(150)]
    for k in range(0, 60, 6):
        rows.append(" ".join(base[k : k + 80]))
    rows += [" ".join(f"e{i}" for i in range(13)), " ".join(f"e{i}" for i in range(14)), " ".join(f"f{i}" for i in range(12)), " ".join(f"f{i}" for i in range(14)), "one", "One", "", " \n"]
    draw.shuffle(rows)
    rows = list(enumerate(rows))
    want = least_of_each(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == want
    assert any(0.8 <= jaccard(x, y) < 0.9 for i, x in rows for j, y in rows[:i]) and any(0.7 < jaccard(x, y) < 0.8 for i, x in rows for j, y in rows[:i])


def test_odd_rows(spark, odd, odd_rows, empty):
    kept = near_copies.one_of_each(odd)
    assert kept.columns == odd.columns
    texts = {r[0]: r[1] or "" for r in odd_rows if r[0] is not None}
    assert {r.doc_id for r in kept.collect()} == least_of_each(sorted(texts.items()))
    assert near_copies.one_of_each(empty).count() == 0
