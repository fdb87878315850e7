"""Merkle manifest, source divergence and vector graphs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftstone.llm import divergence, merkle, queries, vector_graph

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df, *names):
    key = lambda row: tuple((x is not None, x) for x in row)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=key)


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((x is not None, x) for x in row))


# --- Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows, fanout=16):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = defaultdict(list)
    for doc_id, source, lang, n_chars, text in rows:
        head = "".join(map(field, (doc_id, source, lang, n_chars)))
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        by[source].append((doc_id, sha(head + field(text)), sha(head + field(text and text.translate(LOW))) if hit else None))

    def tree(digests):
        paths, at = [[] for _ in digests], list(range(len(digests)))
        while len(digests) > 1:
            for i, path in enumerate(paths):
                a = at[i] // fanout * fanout
                run, k = digests[a : a + fanout], at[i] - a
                path.append(("".join(run[:k]), "".join(run[k + 1 :])))
                at[i] //= fanout
            digests = [sha("".join(digests[a : a + fanout])) for a in range(0, len(digests), fanout)]
        return digests[0], paths

    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    own = {}
    for s in sources:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        own[s] = tree([x[1] for x in by[s]])
    out = []
    if sources:
        root, above = tree([own[s][0] for s in sources])
        for s, up in zip(sources, above):
            for (doc_id, leaf, changed), path in zip(by[s], own[s][1]):
                node = changed or leaf
                for before, after in path + up:
                    node = sha(before + node + after)
                out.append((doc_id, leaf, own[s][0], root, sha("".join(b + a for b, a in path + up)), node, node == root))
    return out


NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("fanout, below, part_rows", [(16, 65_536, 500_000), (2, 4, 7), (3, 1, 1)])
def test_manifest_is_that_of_the_trees(spark, odd, odd_rows, empty, fanout, below, part_rows):
    draw = random.Random(fanout)
    extra = [(1000 + i, f"Text {i} {draw.random()}", "en", draw.choice(["a", "a", "a", "b", "", "-", ":", "é", None]), i) for i in range(150)] + [(5, "Lone", None, "zz", 1)]
    docs = odd.unionByName(spark.createDataFrame(extra, odd.schema)).withColumns({"leaf": F.lit(1), "tree": F.lit("x"), "pos": F.lit(0), "n": F.lit(2)})
    got = merkle.audited_manifest(docs, fanout, below=below, part_rows=part_rows)
    want = brute_manifest([(r[0], r[3], r[2], r[4], r[1]) for r in [*odd_rows, *extra]], fanout)
    assert got.columns == list(NAMES) and rows_of(got, *NAMES) == ordered(want)
    assert {False, True} == {row[-1] for row in want}
    assert merkle.audited_manifest(empty, fanout).count() == 0
    one = docs.filter("doc_id = 5 AND source = 'zz'")
    assert rows_of(merkle.audited_manifest(one, fanout), *NAMES) == brute_manifest([(5, "zz", None, 1, "Lone")], fanout)


def test_proofs_fold_to_the_root(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    each = merkle.manifest(merkle.leaves(docs))
    assert each.filter(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    assert each.filter(merkle.fold(F.sha2("leaf", 256), F.col("proof")) == F.col("root")).count() == 0


def duck_of(text):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    result = connection.execute(text)
    return [c[0] for c in result.description], result.fetchall()


@pytest.mark.parametrize("name", ["op12_source_divergence", "op13_merkle_manifest"])
def test_query_equals_sql(spark, name):
    names, want = duck_of(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF)
    assert set(got.columns) == set(names) and rows_of(got, *names) == ordered(want) and want


# --- source divergence


def brute_audit(rows, least, ranks=50):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, holders = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        own = Counter(term.findall((text or "").translate(LOW)))
        counts[lang or "", source or ""] += own
        holders[lang or ""].update(own.keys())
    out = []
    for lang in {g[0] for g in counts}:
        kept = {t for t, c in holders[lang].items() if c >= least}
        groups = {s: Counter({t: c for t, c in own.items() if t in kept}) for (x, s), own in counts.items() if x == lang}

        def share(own):
            n = sum(own.values())
            return {t: 1 + 10**9 * (own[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p = {s: share(own) for s, own in groups.items()}
        q = share(sum(groups.values(), Counter()))
        for s in groups:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(found[:most], 1)]
    return out


AUDIT = ("lang", "source", "part", "item", "value", "rank")


@pytest.mark.parametrize("groups, terms", [(32, 1024), (2, 5)])
def test_audit_is_that_of_all_cells(spark, odd, odd_rows, empty, monkeypatch, groups, terms):
    monkeypatch.setattr(divergence, "TILE_GROUPS", groups)
    monkeypatch.setattr(divergence, "TILE_TERMS", terms)
    draw = random.Random(groups)
    words = ["Wort", "été", "naïve", "中文", "ab", "x", "İx", "a_b", "don't"] + [f"w{c}" for c in "abcdefghijklm"]
    extra = [(i, " ".join(draw.choices(words[: 4 + i % 18], k=draw.randrange(40))), draw.choice(["en", "de", None]), f"s{draw.randrange(7)}", 1) for i in range(200)]
    docs = odd.unionByName(spark.createDataFrame(extra, odd.schema)).withColumns({"term": F.lit("t"), "count": F.lit(1), "value": F.lit(9), "p": F.lit(0)})
    every = [(r[1], r[2], r[3]) for r in [*odd_rows, *extra]]
    for least, ranks in ((3, 50), (3, 2), (1000, 50)):
        got = divergence.audit_sources(docs, least, ranks)
        assert rows_of(got, *AUDIT) == ordered(brute_audit(every, least, ranks))
    assert divergence.audit_sources(empty).count() == 0


def test_tile_prices_empty_quadrants():
    draw = np.random.default_rng(5)
    for rows, others, columns, full in ((1, 1, 1, 0.0), (3, 5, 17, 0.1), (8, 8, 64, 0.02), (7, 2, 33, 0.9), (4, 4, 16, 0.0)):
        p, q = (draw.integers(1, 10**9, (n, columns)) * (draw.random((n, columns)) < full) for n in (rows, others))
        a, b = draw.integers(1, 10**6, rows), draw.integers(1, 10**6, others)
        x, y = np.where(p > 0, p, a[:, None]), np.where(q > 0, q, b[:, None])
        assert (divergence.tile_distances(p, a, q, b) == np.abs(x[:, None] - y[None]).sum(axis=2)).all()


# --- vector graphs


def brute_nearest(rows, every=20, k=20):
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    out = {}
    for i, v in rows:
        if i % every == 0:
            scores = [(-float(np.dot(np.array(v, "f8"), np.array(w, "f8"))), j) for j, w in rows if j != i and len(w) == len(v)]
            out.setdefault(i, set()).update(scores)
    return {i: sorted(found)[:k] for i, found in out.items()}


def recall(got, want):
    found = defaultdict(list)
    for r in got:
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(found) == {i for i, rows in want.items() if rows}
    hit = total = 0
    for i, rows in want.items():
        own = sorted(found[i])
        assert [x[0] for x in own] == list(range(1, len(rows) + 1)) and [(-s, j) for _, j, s in own] == sorted((-s, j) for _, j, s in own)
        hit += (Counter(j for _, j, _ in own) & Counter(j for _, j in rows)).total()
        total += len(rows)
    return hit / max(1, total)


def test_recall_of_the_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    got = queries.op11_vector_graph(spark, "/root/testdata/sf0.1").collect()
    assert len(got) == 20 * len({i for i, _ in rows if i % 20 == 0})
    assert recall(got, brute_nearest(rows)) >= 0.95


def test_odd_vectors_are_searched_exactly(spark):
    """Few nodes are all reached, whatever their lengths, copies and shards."""
    draw = np.random.default_rng(3)
    vectors = [list(map(float, v)) for v in draw.normal(size=(120, 5)) * draw.uniform(0.1, 9, (120, 1))]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(200 + i, vectors[7]) for i in range(60)] + [(400, vectors[3]), (400, vectors[4]), (20, vectors[20])]
    rows += [(500, [0.0] * 5), (520, None), (540, [1.0, None, 0.0, 0.0, 0.0]), (560, [float("nan")] * 5), (580, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (None, vectors[1]), (600, []), (620, [1.0, 2.0]), (621, [2.0, 1.0]),
             (700, [-0.0, 1.0, 0.0, 0.0, 0.0]), (701, [0.0, 1.0, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"dim": F.lit("x"), "shard": F.lit(1), "score": F.lit(0.5)})
    want = brute_nearest([(i, v) for i, v in rows])
    for shard_rows in (16_384, 30):
        got = vector_graph.nearest_vectors(table, shard_rows=shard_rows).collect()
        assert recall(got, want) == 1.0
        for i, found in want.items():
            own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == i)
            assert [j for _, j, _ in own] == [j for _, j in found] and [s for _, _, s in own] == pytest.approx([-s for s, _ in found], rel=1e-12)
    assert vector_graph.nearest_vectors(table.filter("false")).count() == 0
    assert vector_graph.nearest_vectors(table.filter("vec_id = 20")).count() == 0


def test_every_node_is_reached():
    draw = np.random.default_rng(9)
    for x in (draw.normal(size=(700, 8)), np.concatenate((draw.normal(size=(300, 8)), draw.normal(size=8) + 1e-3 * draw.normal(size=(400, 8))))):
        x = vector_graph.level_out(x.astype("f4"))
        edges, start = vector_graph.grow(x, vector_graph.Graph(degree=6, build_beam=12))
        seen, fresh = {start}, [start]
        while fresh:
            fresh = [int(j) for i in fresh for j in edges[i] if j >= 0 and int(j) not in seen and not seen.add(int(j))]
        assert len(seen) == len(x)
        assert np.isclose(np.linalg.norm(x, axis=1), np.linalg.norm(x[0]), rtol=1e-5).all()
