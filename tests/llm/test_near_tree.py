"""The near-dedup stage goes through the vantage-point tree; what the tree says is checked."""

import corpus_pipeline
from siftstone.llm import near_copies, simhash
from tests.llm.test_near_copies import least_of_each


def test_stage_uses_the_tree_and_checks_its_links(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    near = [*words[:200], "other", *words[201:]]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[:9])), (4, " ".join(f"v{i}" for i in range(50))), (5, "w1 w2")]
    seen = []
    links = simhash.links

    def watched(prints, **more):
        seen.append(links(prints, **more))
        return seen[-1].unionByName(prints.crossJoin(prints.agg({"print": "min"}).toDF("least")).selectExpr("print AS a", "least AS b"))

    monkeypatch.setattr(simhash, "links", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == least_of_each(rows) == {1, 3, 4, 5}
    assert len(seen) == 1


def test_tree_pairs_hang_equal_prints_on_one_node(spark):
    nodes = spark.createDataFrame([(1, 0), (2, 0), (3, 7), (4, -1)], "node long, print long")
    assert sorted(map(tuple, near_copies.tree_pairs(nodes).collect())) == [(1, 2), (1, 3)]
