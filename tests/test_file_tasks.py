"""Files made of the rows of a small table are worked on by all tasks; verdicts come from the scan alone."""

import pytest

from siftstone.operators import declarations
from siftstone.plans.views import view
from tests.test_scale import SF


@pytest.mark.parametrize("name", ["shape_files_v", "source_files_v"])
def test_files_of_a_small_table_go_to_all_tasks(spark, name):
    files = view(spark, SF, name)
    sizes = files.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert max(sizes) < sum(sizes) / spark.sparkContext.defaultParallelism


def test_verdict_needs_no_declarations(spark, monkeypatch):
    monkeypatch.setattr(declarations, "Declarations", None)
    assert declarations.parsed("a.py", "def a():\n    pass \\\n  ")[0] == ".py"
    assert declarations.parsed("a.py", "  x\n y\n") is None and declarations.parsed("a.go", "func a() {  \r") is None
    assert declarations.parsed("a.ts", "  \t ")[1].kinds == []
