"""The pipeline's stages on a small table: what stays, and that every decision takes effect."""

from collections import Counter

import corpus_pipeline
from test_operators import ROWS, brute_components, lower, table


def test_stages(spark):
    words = "the and with from that this have been about which there their would could".split()
    rows = [(i, t if t is None else t + " " + " ".join(words)) for i, t in ROWS] + [(500, "12 34"), (501, None)]
    docs = table(spark, rows)
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "exact dedup", "near dedup", "source mixing", "packing"]
    first = stages["language ID"](spark, docs, "")
    assert first.columns == columns and not {500, 501} & {r.doc_id for r in first.collect()}
    second = stages["exact dedup"](spark, docs, "")
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    assert {r.doc_id for r in second.collect()} == {max(g) for g in groups.values()} and second.columns == columns
    third = stages["near dedup"](spark, docs, "")
    assert {r.doc_id for r in third.collect()} == {i for i, (_, c) in brute_components(rows).items() if c == i} and third.columns == columns
    mixed = stages["source mixing"](spark, docs, "")
    assert mixed.columns == columns and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 3
    packed = stages["packing"](spark, mixed, "")
    assert packed.filter("piece = 0").count() == mixed.count()


def test_empty_through_all_stages(spark):
    docs = table(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
