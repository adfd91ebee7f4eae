"""Rows of a few columns are those of all."""

import pytest

from treeloom.plans import catalogue, corpora
from treeloom.sources import shred

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("which", ["orders", "customers"])
def test_own_columns_are_those_of_all_rows(spark, which):
    columns = shred.OWN
    a, b = (sorted(map(repr, x.select("doc_id", *columns).limit(10**6).collect())) for x in (corpora.nodes(spark, SF, which, *columns), corpora.nodes(spark, SF, which)))
    assert a == b and a
    assert corpora.nodes(spark, SF, which, "ns").columns == ["doc_id", "ns"]


def test_replaced_namespaces_need_one_column(spark):
    plan = catalogue.QUERIES["namespace_replace"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    made = next(x for x in plan.splitlines() if "MapInArrow" in x)
    assert "ns#" in made and "path#" not in made and "value#" not in made
