"""Paths evaluated as documents are parsed give what the plans over node rows give, and deal no node rows."""

import pytest
from pyspark.sql import functions as F

from tests.test_xpath import DOCS, NS, PATHS, VALUES, strip
from treeloom.operators import nodesets, update
from treeloom.plans import catalogue, corpora, xpath_eval, xslt
from treeloom.plans.xpath_ast import XPathError
from treeloom.plans.xpath_documents import Markup
from treeloom.plans.xpath_plan import Corpus
from treeloom.sources.shred import documents, shred

SF = "/root/testdata/sf0.001"
COLUMNS = {"s": "string(.)", "n": "count(ancestor::*) + 0.5", "b": "not(@i)", "g": "generate-id()", "a": "@i", "l": "name()"}


@pytest.fixture(scope="module")
def both(spark):
    df = spark.createDataFrame([*enumerate(DOCS), (7, "<a><b>"), (8, None)], "id long, x string")
    return Markup(df, "id", "x", NS, {"least": 2}), Corpus(shred(df, "id", "x").persist(), documents(df.filter("id < 7"), "id", "x").persist(), NS, {"least": 2})


def test_paths_equal_plans(both):
    for path in strip(PATHS)[::4]:
        a, b = (sorted(map(tuple, c.found(path, **COLUMNS).select("doc_id", "pre", "last", *COLUMNS).collect())) for c in both)
        assert a == b, path


def test_values_equal_plans(both):
    for expr in [*strip(VALUES)[::3], "count(//b[. > $least])", "$least"]:
        a, b = (sorted(map(repr, c.value(expr).collect())) for c in both)
        assert a == b, expr


def test_wrong_paths_show_on_the_driver(both):
    with pytest.raises(XPathError):
        both[0].found("count(//b)")
    with pytest.raises(XPathError):
        both[0].value("$none")


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("name", ["axis_parent", "axis_following", "arith", "join_anti", "strval_of_mixed", "upd_append", "fn_translate_computed", "dispatcher", "roundtrip", "agg_highest", "sort_multi", "closure", "set_intersection"])
def test_queries_deal_no_node_rows(spark, name):
    """Orders and items are dealt once each; nodes are never kept, and only results are dealt again."""
    df = catalogue.QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" not in plan and "Scan ExistingRDD" not in plan
    for line in plan.splitlines():
        assert not ("Exchange" in line and ("prefix#" in line or "path#" in line))
    made = _exchanges(corpora.markup(spark, SF, "orders"))
    again = {"agg_highest": 1, "dispatcher": 1, "sort_multi": 1, "closure": 6, "set_intersection": 4}.get(name, 0)
    assert _exchanges(df) <= made * (2 if name == "set_intersection" else 4 if name == "closure" else 1) + again


def test_closure_by_document(spark):
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 1), (1, 9, 10), (2, 1, 5), (3, 4, 4), *[(4, k, k + 1) for k in range(1500)]], "doc_id long, pre int, to int")
    start = spark.createDataFrame([(1, 1), (3, 4), (4, 0), (5, 1)], "doc_id long, pre int")
    got = sorted(map(tuple, nodesets.closure(start, edges).collect()))
    assert got == [(1, 1), (1, 2), (1, 3), (3, 4), *[(4, k + 1) for k in range(1500)]]


def test_roundtrip_tells_same_trees(spark, monkeypatch):
    df = spark.createDataFrame([(1, '<a y="1" x="2"><!--c--> <b>t&amp;</b>\n</a>'), (2, "<a>"), (3, "<a><b/></a>")], "id long, x string")
    assert sorted(map(tuple, update.roundtrip(df, "id", "x").collect())) == [(1, True), (3, True)]
    first, other = (update.parse_xml(x) for x in ('<a y="1" x="2"> <b/></a>', '<a x="2" y="1"><b/></a>'))
    assert update.outline(first) == update.outline(other) != update.outline(update.parse_xml('<a x="2" y="1"><c/></a>'))


def test_numbers_given_while_parsing(spark):
    for text in [*DOCS, '<!DOCTYPE a [<!ATTLIST a k ID #IMPLIED>]><!--x--><a k="1" xmlns="u">t<![CDATA[<]]>u<?p q?><b/>\n</a><?z?>']:
        root = update.parse_xml(text)
        given = [(n.pre, n.last, [(a.pre, a.last) for a in n.attrs], n.doc is root) for n in root.walk()]
        root.number()
        assert given == [(n.pre, n.last, [(a.pre, a.last) for a in n.attrs], n.doc is root) for n in root.walk()]
        assert all(c.parent is n for n in root.walk() for c in [*n.children, *n.attrs])


def test_markup_is_the_same_however_dealt(spark):
    got = corpora.markup(spark, SF, "customers")
    assert got.count() == corpora.table(spark, SF, "customer").count() == got.select("doc_id").distinct().count()
    assert got.filter(F.col("xml").isNull()).count() == 0


def test_tasks_grow_with_the_tables(spark, tmp_path):
    spark.range(5_000_000).selectExpr("xxhash64(id) AS k").write.parquet(str(tmp_path / "t.parquet"))
    big = spark.read.parquet(str(tmp_path / "t.parquet"))
    least = corpora.tasks(spark, corpora.table(spark, SF, "region"))
    size = sum(f.stat().st_size for f in (tmp_path / "t.parquet").glob("*.parquet"))
    assert corpora.tasks(spark, *[big] * (least + 1)) >= size * (least + 1) // corpora.TASK_BYTES > least
    assert corpora.dealt(big, "k", least + 3).rdd.getNumPartitions() == least + 3


def test_feeds_are_read_once(spark):
    for name in ("merge_by_date", "outer_merge"):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") <= 1, name


def test_order_asks_documents_once():
    class Asked:
        asked = 0
        kind, local = "element", None

        def __init__(self, pre):
            self.pre = pre

        @property
        def doc(self):
            Asked.asked += 1

    got = xpath_eval.order(map(Asked, range(400, 0, -1)))
    assert [n.pre for n in got] == list(range(1, 401)) and Asked.asked <= 1200


def test_stylesheet_state_is_kept_between_documents(monkeypatch):
    text = '<s:stylesheet version="1.0" xmlns:s="http://www.w3.org/1999/XSL/Transform"><s:output method="text"/><s:key name="k" match="b" use="@v"/><s:variable name="n" select="count(//b)"/><s:template match="key(\'k\', \'1\')">!</s:template><s:template match="b"><s:value-of select="$n"/>{@v}<s:if test="@v = 9"><s:message terminate="yes">x</s:message></s:if></s:template></s:stylesheet>'
    sheet = xslt.Stylesheet.compile(text)
    docs = ['<a><b v="1"/><b v="2"/></a>', '<a><b v="9"/><b v="1"/></a>', '<a><b v="2"/><b v="1"/><b v="1"/></a>']
    asked, key, bound = [], xslt.Run.key, []
    monkeypatch.setattr(xslt.Run, "key", lambda self, *a: asked.append(1) or key(self, *a))
    monkeypatch.setattr(xslt, "by_prefix", lambda ns, f=xslt.by_prefix: bound.append(1) or f(ns))
    run, got = xslt.Run(sheet), []
    for x in docs:
        try:
            got.append(run.begin(xslt.parse_xml(x)).run().text())
        except xslt.Terminated:
            got.append(None)
    assert got == ["!2{@v}", None, "3{@v}!!"]
    assert len(asked) == 3  # once a document, not once a node
    assert len(bound) <= 6  # once an element of the stylesheet, not once a document


def test_attributes_become_nodes_when_asked(spark):
    e = update.parse_xml('<a x="1" p:y="2" xmlns:p="u" xml:id="i"/>').children[0]
    assert (e.get("x"), e.get("y"), e.made) == ("1", None, None)
    assert e.get("y", "u") == "2" and [(a.local, a.pre, a.is_id, a.parent is e) for a in e.attrs] == [("x", 2, False, True), ("y", 3, False, True), ("id", 4, True, True)]
    t = update.parse_xml("<a>t</a>").children[0].children[0]
    t.add(update.parse_xml("<b/>").children[0])
    assert len(t.children) == 1 and xpath_eval.Node("text").children == ()
