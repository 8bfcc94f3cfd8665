"""What the plans of the corpus queries may and may not contain."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

from bloomtide.llm.queries import QUERIES
from tests.compare import DATA

NATIVE = {"op3_line_frequency", "op13_centroid_clusters"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_of_query(spark, name):
    text = QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", *(["Python", "Arrow"] if name in NATIVE else [])):
        assert node not in text, node
    assert not re.search(r"Window [^\n]*\n[ :+-]*(Sort [^\n]*\n[ :+-]*)?Exchange SinglePartition", text), "window over one partition"


def test_no_call_that_ties_data_to_a_machine():
    folder = Path(__file__).resolve().parents[2] / "bloomtide" / "llm"
    for file in folder.glob("*.py"):
        for call in ("localCheckpoint", ".rdd", "crossJoin", "toPandas", "tempfile"):
            assert call not in file.read_text(), f"{call} in {file}"
