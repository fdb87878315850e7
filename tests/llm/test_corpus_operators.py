"""Operators over whole corpora, against SQL, brute force and planted cases."""

import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from siftstone.llm import line_dedup, packing, quality, queries, sharding, simhash
from siftstone.llm.common import tokenizer_path
from tests.llm.test_near_copies import least_of_each

SF = "/root/testdata/sf0.001"


def key(row):
    return tuple((x is not None, x) for x in row)


def same(rows, wanted):
    assert sorted(map(tuple, rows), key=key) == sorted(map(tuple, wanted), key=key)


# --- quality


def kneser_ney(texts, order):
    """The model as its definition has it, over dictionaries."""
    pad = lambda t: quality.BEGIN * (order - 1) + t + quality.END
    counts = {order: Counter(p[i : i + order] for p in map(pad, texts) for i in range(len(p) - order + 1))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    total = {n: Counter() for n in counts}
    left = {n: Counter() for n in counts}
    discount = {}
    for n, table in counts.items():
        t = Counter(table.values())
        y = t[1] / (t[1] + 2 * t[2]) if t[1] else 0.5
        own = [0] + [min(max(k - (k + 1) * y * t[k + 1] / t[k], 0.05), k) if t[k] else 0.5 * k for k in (1, 2, 3)]
        discount[n] = lambda c, own=own: own[min(c, 3)]
        for g, c in table.items():
            total[n][g[:-1]] += c
            left[n][g[:-1]] += discount[n](c)
    symbols = len(counts[1]) + 1

    def p(g):
        n = len(g)
        lower = p(g[1:]) if n > 1 else 1 / symbols
        if not total[n][g[:-1]]:
            return lower
        c = counts[n][g]
        return (max(c - discount[n](c), 0) if c else 0) / total[n][g[:-1]] + left[n][g[:-1]] / total[n][g[:-1]] * lower

    return lambda text: -sum(math.log(p(pad(text)[i : i + order])) for i in range(len(text) + 1)), p, counts


def test_model_is_kneser_ney(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    texts = [r.text[:400] for r in docs.collect()]
    nll, p, counts = kneser_ney(texts[:20], 4)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en"))
    model = quality.KneserNey(quality.count_grams(frame.filter("doc_id < 20"), 4), 4)
    path = frame.repartition(3)
    rows = {r.doc_id: r for r in quality.score_documents(quality.materialize(path, "docs"), model).collect()}
    for i, text in enumerate(texts):
        assert rows[i].n == len(text) + 1 and rows[i].nll == pytest.approx(nll(text), rel=1e-9)
    # Probabilities after a known context sum to one, with what is left for unseen symbols.
    context = next(iter(counts[4]))[:3]
    seen = [g for g in counts[1]]
    assert sum(p(context + c) for c in seen) + p(context + "￿") == pytest.approx(1)


def test_long_text_in_pieces():
    text = "abcde" * 100
    whole = quality.grams([quality.BEGIN * 3 + text + quality.END], 4)
    total, n = Counter(), 0
    for padded, owners in quality.pieces([text, ""], 4, 37):
        names, numbers, _ = quality.grams(padded, 4)
        total.update(names[i] for i in numbers)
        n += len(numbers)
    total[quality.BEGIN * 3 + quality.END] -= 1
    assert n == len(text) + 2 and +total == Counter(whole[0][i] for i in whole[1])


def test_classifier_keeps_good_and_rejects_noise(spark):
    rows = queries.op3_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    good, bad = [r.keep for r in rows if r.quality == 1], [r.keep for r in rows if r.quality == 0]
    assert all(good) and sum(bad) / len(bad) < 0.4


def test_classifier_odd_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (6, 1, 1), (7, None, 0), (None, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(odd.withColumn("perplexity", F.lit("clash")), labels).collect()
    assert len(rows) == len(odd_rows) and all(r.perplexity > 0 and r.keep is not None for r in rows)
    assert quality.keep_good(odd, labels).columns == odd.columns
    assert all(r.keep for r in quality.classify(odd, labels.limit(0)).collect())
    assert quality.classify(empty, labels).count() == 0


# --- lines


def brute_lines(rows, min_chars=32):
    """Whole texts less lines that an earlier line equals or nearly equals, from all single deletions."""
    places = [(i, k, line, line.strip(" \t\r")) for i, text in sorted(rows) for k, line in enumerate(text.split("\n"))]
    firsts = {}
    for i, k, _, plain in places:
        firsts.setdefault(plain, (i, k))
    long = [x for x in firsts if len(x) >= min_chars]
    spots = defaultdict(set)
    for x in long:
        for k in range(len(x)):
            spots[x[:k] + "\0" + x[k + 1 :]].add(x)
    near = set()
    for group in spots.values():
        first = min(group, key=firsts.get)
        near |= {x for x in group if firsts[x] > firsts[first]}
    for x in long:
        for k in range(len(x)):
            y = x[:k] + x[k + 1 :]
            if y in firsts and len(y) >= min_chars:
                near.add(max(x, y, key=firsts.get))
    kept = defaultdict(list)
    for i, k, line, plain in places:
        if not plain or (plain not in near and firsts[plain] == (i, k)):
            kept[i].append(line)
    return [(i, "\n".join(kept[i])) for i, _ in sorted(rows)]


def test_line_dedup_planted(spark):
    draw = random.Random(11)
    base = ["".join(draw.choice("abcdef ") for _ in range(draw.randint(20, 90))).strip() or "x" for _ in range(40)]

    def changed(line):
        at, how = draw.randrange(len(line) + 1), draw.randrange(5)
        return (line[:at] + "Z" + line[at:], line[:at] + line[at + 1 :], line[:at] + "Q" + line[at + 1 :], line, f"  {line}\r")[how]

    rows = [(i, "\n".join(changed(draw.choice(base)) if draw.random() < 0.8 else draw.choice(["", " ", "tiny", "é" * 40]) for _ in range(draw.randint(1, 8)))) for i in range(120)]
    # A template of which one character differs: a group of variants that must not be paired.
    rows += [(1000 + i, "a template line whose number is all that changes: " + chr(0x4E00 + i)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_lines(rows)
    for limit in (1_000_000, 0):
        same([(r.doc_id, r.text) for r in line_dedup.dedup_lines(df, broadcast_rows=limit).collect()], want)
    exact = line_dedup.dedup_lines(df, bound=0).collect()
    assert sum(len(r.text) for r in exact) >= sum(len(x) for _, x in want)
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(df, bound=2)


def test_line_dedup_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    df = queries.op4_line_dedup(spark, SF)
    same(df.select("doc_id", "n_kept", "n_lines", "text").collect(), con.execute(f"SELECT doc_id, n_kept, n_lines, text FROM ({queries.LINES_SQL})").fetchall())


def test_line_dedup_odd_rows(spark, odd, odd_rows, empty):
    df = odd.withColumn("line", F.lit("clash")).withColumn("pos", F.lit(1)).withColumn("h", F.lit(2))
    kept = line_dedup.dedup_lines(df)
    rows = kept.collect()
    assert kept.columns == df.columns and len(rows) == len(odd_rows)
    assert sum(r.text is None for r in rows) == sum(r[1] is None for r in odd_rows)
    assert {r.text for r in rows if r.doc_id == 3} == {"\n\n"}
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_runs_no_python(spark):
    plan = line_dedup.dedup_lines(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- packing


def test_best_fit_by_hand():
    lengths = np.array([9, 6, 5, 4, 3, 2, 1])
    for score in ("norm", "dot"):
        sequence, offset = packing.best_fit(lengths, packing.Limits(tokens=10, score=score))
        used = defaultdict(list)
        for length, s, o in zip(lengths, sequence, offset):
            used[s].append((o, length))
        assert len(used) == (3 if score == "norm" else 4)
        for own in used.values():
            own.sort()
            assert [o for o, _ in own] == [sum(x for _, x in own[:i]) for i in range(len(own))] and sum(x for _, x in own) <= 10
    sequence, _ = packing.best_fit(np.array([2] * 10), packing.Limits(tokens=100, documents=3))
    assert sorted(Counter(sequence.tolist()).values()) == [1, 3, 3, 3]
    sequence, _ = packing.best_fit(np.array([5, 5, 3, 1]), packing.Limits(tokens=100, attention=30))
    assert all(sum(x * x for x, s in zip([5, 5, 3, 1], sequence) if s == k) <= 30 for k in set(sequence.tolist()))
    with pytest.raises(ValueError):
        packing.best_fit(np.array([11]), packing.Limits(tokens=10))


def check_packed(rows, texts):
    model = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = []
    for doc_id, text in texts:
        ids = model.encode(text or "", add_special_tokens=False).ids + [1]
        for at in range(0, len(ids), 4096):
            own = np.array(ids[at : at + 4096], "<u4")
            want.append((doc_id, at // 4096, at, len(own), zlib.crc32(own.tobytes())))
    same([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], want)
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for own in used.values():
        own.sort()
        assert [o for o, _ in own] == [sum(x for _, x in own[:i]) for i in range(len(own))] and sum(x for _, x in own) <= 4096
    return len(used), sum(r.length for r in rows) / 4096


def test_packing_query(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n, least = check_packed(queries.op5_best_fit_packing(spark, SF).collect(), texts)
    assert n <= math.ceil(least) + 1


def test_packing_odd_rows(spark, odd, odd_rows, empty):
    rows = packing.packed_documents(odd.withColumn("offset", F.lit("clash"))).collect()
    check_packed(rows, [(r[0], r[1]) for r in odd_rows])
    assert all(len(r.ids) == 4 * r.length for r in rows)
    assert packing.packed_documents(empty).count() == 0


# --- sharding


def test_sharding_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op7_sharding(spark, sf).collect()
    same([(r.doc_id, r.size, r.text_crc32) for r in rows], [(k, len(x.encode()) + 8, zlib.crc32(x.encode())) for k, x in texts.items()])
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(sizes) == set(range(24)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    mean = sum(sizes.values()) / 24
    assert max(sizes.values()) < mean + max(len(x.encode()) for x in texts.values())


def test_sharding_balance_and_hot_group(spark):
    rows = [(i, "copy of one text " * 5) for i in range(3000)] + [(10_000 + i, f"text {i} " * (1 + i % 40)) for i in range(6000)] + [(20_000 + i % 50, f"pair {i // 2}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")).repartition(8)
    out = sharding.shard_documents(df, shards=7, slot_rows=500)
    got = out.collect()
    sizes, counts, slots = Counter(), Counter(), defaultdict(list)
    for r in got:
        sizes[r.shard] += r.size
        counts[r.shard] += 1
        slots[r.shard].append(r.slot)
    assert len(got) == len(rows) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    for own in (sizes, counts):
        assert max(own.values()) / (sum(own.values()) / 7) < 1.05
    homes = defaultdict(set)
    for r in got:
        homes[r.text_crc32].add(r.shard)
    assert all(len(x) == 1 for k, x in homes.items() if k != zlib.crc32(rows[0][1].encode()))


def test_sharding_odd_rows(spark, odd, odd_rows, empty):
    rows = sharding.shard_documents(odd, shards=3).collect()
    same([(r.doc_id, r.size) for r in rows], [(r[0], len((r[1] or "").encode()) + 8) for r in odd_rows])
    assert sharding.shard_documents(empty).count() == 0


# --- SimHash


def simhash_of(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).translate({c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(prints):
    """The component of each of a list of fingerprints, by comparing all."""
    n = len(prints)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    values = np.array(prints, "u8")
    for i in range(n):
        for j in (np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1 :]) <= 4) + i + 1).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def check_components(rows, texts):
    texts = sorted(texts, key=key)
    prints = [simhash_of(x or "") for _, x in texts]
    roots = components_of(prints)
    least = {}
    for (doc_id, _), root in zip(texts, roots):
        known = least.get(root)
        least[root] = doc_id if known is None or doc_id is not None and doc_id < known else known
    same([(r.doc_id, r.fingerprint, r.component_id) for r in rows], [(d, f"{p:016x}", least[r]) for (d, _), p, r in zip(texts, prints, roots)])


def test_simhash_query(spark):
    check_components(queries.op10_simhash_near_dedup(spark, SF).collect(), [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])


def test_simhash_odd_rows(spark, odd, odd_rows, empty):
    check_components(simhash.near_duplicates(odd.withColumn("print", F.lit("clash"))).collect(), [(r[0], r[1]) for r in odd_rows])
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    ids = {r.component_id for r in simhash.near_duplicates(odd).collect()}
    assert len(rows) == len(ids) and {r.doc_id for r in rows} == ids
    assert simhash.one_of_each(empty).count() == 0


@pytest.mark.parametrize("leaf", [20, 150, 10_000])
def test_tree_loses_no_link(spark, leaf):
    draw = np.random.default_rng(leaf)
    prints = [0, 2**64 - 1] + [int(x) for x in draw.integers(0, 2**63, 200, dtype="u8")]
    for x in prints[:80]:
        for _ in range(4):
            y = x
            for bit in draw.choice(64, int(draw.integers(1, 7)), replace=False):
                y ^= 1 << int(bit)
            prints.append(y)
    # A tight cluster that no distance can split.
    prints += [prints[5] ^ 1 << a ^ 1 << b for a in range(24) for b in range(a)]
    prints = sorted(set(prints))
    signed = [x - 2**64 if x >= 2**63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "print long").repartition(4)
    found = {r["print"]: r.root for r in simhash.print_classes(df, leaf_size=leaf).collect()}
    groups, want = defaultdict(set), defaultdict(set)
    for x, root in zip(signed, components_of(prints)):
        want[root].add(x)
        groups[found[x]].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    assert all(root == min(group) for root, group in groups.items())


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 2000 + i) for i in range(300)] + [(5, 5)], "a long, b long")
    rows = {r.node: r.root for r in simhash.components(edges).collect()}
    assert rows == {i: 0 for i in range(301)} | {1000: 1000} | {2000 + i: 1000 for i in range(300)}


# --- the pipeline


def test_pipeline_by_stages(spark):
    """Each stage does on its own input what its operator says, and the last has every token of what is left."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "language_id", "line_dedup", "near_dedup", "best_fit_packing"]
    states = [docs]
    for name, stage in corpus_pipeline.STAGES:
        states.append(corpus_pipeline.materialize(stage(spark, states[-1], sf), name))
    for state in states[1:-1]:
        assert state.columns == docs.columns and state.dtypes == docs.dtypes
    rows = [{r.doc_id: r for r in s.collect()} for s in states[:-1]]
    rejected = {r.doc_id for r in quality.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).filter("not keep").collect()}
    assert set(rows[0]) - set(rows[1]) == rejected and rejected
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(labels[i].quality == 0 for i in rejected if i in labels)
    assert all(rows[2][i] == rows[1][i] for i in rows[2]) and all(labels[i].quality == 0 for i in set(rows[1]) - set(rows[2]) if i in labels)
    same([(i, r.text) for i, r in rows[3].items()], brute_lines([(i, r.text) for i, r in rows[2].items()]))
    assert all(r.n_chars == len(r.text) for r in rows[3].values())
    assert set(rows[4]) == least_of_each([(i, rows[3][i].text) for i in sorted(rows[3])])
    check_packed(states[-1].collect(), [(i, r.text) for i, r in rows[4].items()])
