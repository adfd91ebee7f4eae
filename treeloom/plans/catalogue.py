"""Registered queries over the driver's tables, with the SQL that gives the same rows.

Markup is made of relational tables, shredded and queried by path; the SQL asks the tables themselves, so it checks
axes, predicates and functions without knowing XML.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions import dates, iri, legacy, numbers, strings
from treeloom.operators import extract, nodesets, update
from treeloom.plans import xslt
from treeloom.plans.corpora import broken_markup, corpus, markup, nodes, pages, table
from treeloom.plans.xpath_plan import to_num
from treeloom.sources.shred import documents, is_xml, shred
from treeloom.sources.store import settle
from treeloom.streaming import patterns
from treeloom.streaming.run import available_now

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

RANKED = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag)"
#: lineitem with the item's place in its order
ITEMS = f"WITH items AS (SELECT l.*, {RANKED} AS rn, count(*) OVER (PARTITION BY l_orderkey) AS n_items FROM lineitem l) "
QTY, PRICE = "CAST(l_quantity AS DOUBLE)", "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE)"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def by_path(key: str, sql: str | None, which: str, path: str, /, **columns: str) -> None:
    """Nodes by path with expressions evaluated at each."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return corpus(spark, sf_dir, which).found(path, **columns).select("doc_id", *columns)

    query(key, sql)(run)


def by_value(name: str, sql: str | None, which: str, expr: str, **variables) -> None:
    """One value per document."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return corpus(spark, sf_dir, which, **variables).value(expr)

    query(name, sql)(run)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by order priority, read from the orders' markup by path."""
    totals = corpus(spark, sf_dir, "orders").value("sum(/order/item/price)", "revenue")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderpriority")
    return totals.join(orders, "doc_id").groupBy("o_orderpriority").agg(F.round(F.sum("revenue"), 2).alias("revenue"), F.count("*").alias("n"))


query("flagship", f"SELECT o_orderpriority, round(sum(coalesce(r, 0)), 2) AS revenue, count(*) AS n FROM orders LEFT JOIN (SELECT l_orderkey, sum({PRICE}) AS r FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY 1")(flagship)

# -- axes ------------------------------------------------------------------------------------------

by_path("axis_child", ITEMS + "SELECT l_orderkey AS doc_id, CAST(l_linenumber AS VARCHAR) AS line FROM items", "orders", "/order/child::item", line="@line")
by_path("axis_attribute", "SELECT o_orderkey AS doc_id, o_orderstatus AS v FROM orders", "orders", "/order/attribute::status", v="string(.)")
by_path("axis_parent", ITEMS + "SELECT DISTINCT l_orderkey AS doc_id, CAST(l_partkey AS VARCHAR) AS part, rn FROM items WHERE l_quantity > 40".replace(", rn", ", CAST(rn AS DOUBLE) AS rn"), "orders", "//qty[. > 40]/parent::item", part="@part", rn="count(preceding-sibling::item) + 1")
by_path("axis_descendant", f"SELECT o_custkey AS doc_id, {QTY} AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey", "customers", "/customer/descendant::qty", q="number(.)")
by_value("axis_descendant_or_self", "SELECT c_custkey AS doc_id, CAST(1 + 1 + 1 + coalesce(n_o, 0) + 2 * coalesce(n_i, 0) AS DOUBLE) AS value FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_o FROM orders GROUP BY 1) o ON c_custkey = o.o_custkey LEFT JOIN (SELECT o_custkey, count(*) AS n_i FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) i ON c_custkey = i.o_custkey", "customers", "count(/customer/descendant-or-self::*)")
by_path("axis_ancestor", "SELECT DISTINCT o_custkey AS doc_id, 'o' || o_orderkey AS id FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 45", "customers", "//qty[. > 45]/ancestor::s:order", id="@xml:id")
by_path("axis_ancestor_or_self", f"SELECT o_custkey AS doc_id, {QTY} AS q, 4.0::DOUBLE AS depth FROM orders JOIN lineitem ON o_orderkey = l_orderkey", "customers", "//qty", q="number(.)", depth="count(ancestor-or-self::*)")
by_path("axis_self", ITEMS + "SELECT l_orderkey AS doc_id, CAST(l_partkey AS VARCHAR) AS part FROM items", "orders", "/order/*/self::item", part="@part")
by_path("axis_following", ITEMS + "SELECT l_orderkey AS doc_id, CAST(l_partkey AS VARCHAR) AS part, CAST(3 * (n_items - rn) AS DOUBLE) AS n FROM items", "orders", "/order/item", part="@part", n="count(following::*)")
by_path("axis_preceding", ITEMS + "SELECT l_orderkey AS doc_id, CAST(l_partkey AS VARCHAR) AS part, CAST(1 + 3 * (rn - 1) AS DOUBLE) AS n FROM items", "orders", "/order/item", part="@part", n="count(preceding::*)")
by_path("axis_following_sibling", ITEMS + "SELECT l_orderkey AS doc_id, CAST(l_partkey AS VARCHAR) AS part, CAST(n_items - rn AS DOUBLE) AS n FROM items", "orders", "/order/item", part="@part", n="count(following-sibling::item)")
by_path("axis_preceding_sibling", ITEMS + "SELECT l_orderkey AS doc_id, CAST(l_partkey AS VARCHAR) AS part, CAST(rn AS DOUBLE) AS n FROM items", "orders", "/order/item", part="@part", n="count(preceding-sibling::*)")
by_path("axis_namespace", "SELECT c_custkey AS doc_id, unnest(['urn:sales', 'http://www.w3.org/XML/1998/namespace']) AS uri FROM customer", "customers", "/customer/namespace::*", uri="string(.)")

# -- node tests, predicates, paths ------------------------------------------------------------------

by_value("test_name", "SELECT o_orderkey AS doc_id, CAST(count(l_orderkey) AS DOUBLE) AS value FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1", "orders", "count(//item)")
by_value("test_ns_wildcard", "SELECT c_custkey AS doc_id, CAST(count(o_orderkey) AS DOUBLE) AS value FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1", "customers", "count(/customer/s:*)")
by_value("test_kind_text", "SELECT o_orderkey AS doc_id, CAST(1 + 2 * count(l_orderkey) AS DOUBLE) AS value FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1", "orders", "count(//text())")
by_value("test_kind_node", "SELECT o_orderkey AS doc_id, CAST(3 + 5 * count(l_orderkey) AS DOUBLE) AS value FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1", "orders", "count(/order/descendant-or-self::node())")
by_path("pred_position", ITEMS + "SELECT l_orderkey AS doc_id, CAST(l_partkey AS VARCHAR) AS part FROM items WHERE rn = 2", "orders", "/order/item[2]", part="@part")
by_path("pred_last", ITEMS + "SELECT l_orderkey AS doc_id, CAST(l_partkey AS VARCHAR) AS part FROM items WHERE rn = n_items", "orders", "/order/item[last()]", part="@part")
by_path("pred_slice", ITEMS + "SELECT l_orderkey AS doc_id, CAST(l_partkey AS VARCHAR) AS part FROM items WHERE rn > 2 AND rn <= 4", "orders", "/order/item[position() > 2 and position() <= 4]", part="@part")
by_path("pred_reverse_axis", ITEMS + "SELECT a.l_orderkey AS doc_id, CAST(b.l_partkey AS VARCHAR) AS part FROM items a JOIN items b ON a.l_orderkey = b.l_orderkey AND b.rn = a.rn - 1", "orders", "/order/item/preceding-sibling::item[1]", part="@part")
by_path("pred_bool", ITEMS + "SELECT l_orderkey AS doc_id, CAST(l_partkey AS VARCHAR) AS part FROM items WHERE l_returnflag = 'R' AND l_quantity >= 25", "orders", "/order/item[@flag='R' and qty >= 25]", part="@part")
by_path("pred_nested", ITEMS + "SELECT o_orderkey AS doc_id, o_orderstatus AS status FROM orders WHERE EXISTS (SELECT 1 FROM items WHERE l_orderkey = o_orderkey AND rn = 1 AND l_quantity > 30)", "orders", "/order[item[1][qty > 30]]", status="@status")
by_path("pred_exists", "SELECT o_orderkey AS doc_id, o_orderstatus AS status FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)", "orders", "/order[not(item)]", status="@status")
by_path("filter_expr", f"SELECT o_custkey AS doc_id, max_by({QTY}, k) AS q FROM (SELECT o_custkey, l_quantity, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag) AS k FROM orders JOIN lineitem ON o_orderkey = l_orderkey) WHERE k = 1 GROUP BY 1", "customers", "(//qty)[1]", q="number(.)")
by_path("union", ITEMS + "SELECT l_orderkey AS doc_id, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS v FROM items WHERE rn = 1 UNION ALL SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) FROM orders", "orders", "/order/item[1]/qty | /order/total | /order/total", v="string(.)")
by_path("path_wildcard", "SELECT o_orderkey AS doc_id, 'total' AS name FROM orders UNION ALL SELECT l_orderkey, 'item' FROM lineitem", "orders", "/order/*", name="name()")
by_value("variable", "SELECT o_orderkey AS doc_id, CAST(count(l_orderkey) FILTER (l_quantity > 20) AS DOUBLE) AS value FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1", "orders", "count(//qty[. > $least])", least=20)

# -- comparisons and arithmetic ---------------------------------------------------------------------

by_value("cmp_ns_eq", "SELECT o_orderkey AS doc_id, coalesce(bool_or(CAST(l_linenumber AS VARCHAR) = CAST(CAST(q AS BIGINT) AS VARCHAR)), FALSE) AS value FROM orders LEFT JOIN (SELECT a.l_orderkey, a.l_linenumber, b.l_quantity AS q FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey) ON o_orderkey = l_orderkey GROUP BY 1", "orders", "//item/@line = //qty")
by_value("cmp_ns_ne", "SELECT o_orderkey AS doc_id, coalesce(count(DISTINCT l_returnflag) > 1, FALSE) AS value FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1", "orders", "//@flag != //@flag")
by_value("cmp_ns_lt", "SELECT o_orderkey AS doc_id, coalesce(min(l_quantity) < max(l_linenumber), FALSE) AS value FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1", "orders", "//qty < //@line")
by_value("cmp_scalar_nan", "SELECT o_orderkey AS doc_id, FALSE AS value FROM orders", "orders", "number(/order/@status) = number(/order/@status)")
by_value("cmp_boolean", "SELECT o_orderkey AS doc_id, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) > 0 AS value FROM orders", "orders", "//item = true()")
by_path("arith", f"SELECT l_orderkey AS doc_id, round({QTY} * {PRICE} - CAST(l_linenumber AS DOUBLE) / 4 + CAST(l_partkey % 7 AS DOUBLE), 4) AS v FROM lineitem", "orders", "/order/item", v="round((qty * price - @line div 4 + @part mod 7) * 10000) div 10000")
ORACLES["arith"] = f"SELECT l_orderkey AS doc_id, floor(({QTY} * {PRICE} - CAST(l_linenumber AS DOUBLE) / 4 + CAST(l_partkey % 7 AS DOUBLE)) * 10000 + 0.5) / 10000 AS v FROM lineitem"
by_value("arith_special", "SELECT o_orderkey AS doc_id, 'Infinity/NaN/-2' AS value FROM orders", "orders", "concat(1 div 0, '/', 0 div 0, '/', -7 mod 5)")

# -- joins ------------------------------------------------------------------------------------------

by_path("join_semi", "SELECT o_orderkey AS doc_id, o_orderstatus AS status FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = o_orderstatus)", "orders", "/order[@status = item/@flag]", status="@status")
by_path("join_anti", "SELECT o_orderkey AS doc_id, o_orderstatus AS status FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A')", "orders", "/order[not(item/@flag = 'A')]", status="@status")
by_path("join_id", "SELECT o_custkey AS doc_id, 'o' || unnest(list_distinct([min(o_orderkey), max(o_orderkey)])) AS id FROM orders GROUP BY o_custkey", "customers", "id(/customer/last/@refs)", id="@xml:id")


@query("join_key", "SELECT o_custkey AS doc_id, status, count(*) AS n FROM (SELECT o_custkey, o_orderstatus AS status FROM orders) GROUP BY ALL")
def _(spark, sf_dir):
    c = corpus(spark, sf_dir, "customers")
    orders = nodes(spark, sf_dir, "customers")
    keys = nodesets.keys(orders, (F.col("kind") == "element") & (F.col("local") == "order"), F.element_at("attrs", "status"), "by-status")
    probes = c.found("//s:order/@status", value="string(.)").select("doc_id", "value")
    found = nodesets.by_key(orders, keys, probes, "value")
    return found.groupBy("doc_id", F.element_at("attrs", "status").alias("status")).agg(F.count("*").alias("n"))


@query("join_document", "SELECT o_orderkey AS doc_id, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, sf_dir):
    """document(): another corpus found by its URI."""
    refs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("customer/"), F.col("o_custkey").cast("string")).alias("uri"))
    names = corpus(spark, sf_dir, "customers").value("string(/customer/name)", "name").select(F.concat(F.lit("customer/"), F.col("doc_id").cast("string")).alias("uri"), "name")
    return refs.join(names, "uri").select("doc_id", "name")


# -- aggregation, grouping, sets, sorting, numbering --------------------------------------------------

by_value("agg_count", "SELECT c_custkey AS doc_id, CAST(count(l_orderkey) AS DOUBLE) AS value FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1", "customers", "count(//item)")
by_value("agg_sum", f"SELECT o_orderkey AS doc_id, coalesce(sum({QTY}), 0.0) AS value FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1", "orders", "sum(/order/item/qty)")


ITEM_VALUES = {"q": "number(qty)", "flag": "@flag", "part": "@part", "price": "number(price)"}


def _items(spark, sf_dir, *names: str):
    """items of orders with the named values of each, by path."""
    return corpus(spark, sf_dir, "orders").found("/order/item", **{x: ITEM_VALUES[x] for x in names})


@query("agg_max_min", f"SELECT l_orderkey AS doc_id, max({QTY}) AS hi, min({QTY}) AS lo FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    return _items(spark, sf_dir, "q").groupBy("doc_id").agg(numbers.maximum(F.col("q")).alias("hi"), numbers.minimum(F.col("q")).alias("lo"))


@query("agg_highest", f"SELECT l_orderkey AS doc_id, CAST(l_partkey AS VARCHAR) AS part FROM (SELECT *, max(l_quantity) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) WHERE l_quantity = m")
def _(spark, sf_dir):
    return nodesets.extreme(_items(spark, sf_dir, "q", "part"), F.col("q")).select("doc_id", "part")


@query("agg_lowest", f"SELECT l_orderkey AS doc_id, CAST(l_partkey AS VARCHAR) AS part FROM (SELECT *, min(l_quantity) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) WHERE l_quantity = m")
def _(spark, sf_dir):
    return nodesets.extreme(_items(spark, sf_dir, "q", "part"), F.col("q"), False).select("doc_id", "part")


@query("dyn_sum", f"SELECT l_orderkey AS doc_id, round(sum({QTY} * {PRICE}), 2) AS value FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    return corpus(spark, sf_dir, "orders").found("/order/item", v="qty * price").groupBy("doc_id").agg(F.round(F.sum("v"), 2).alias("value"))


@query("distinct_value", ITEMS + "SELECT l_orderkey AS doc_id, l_returnflag AS flag, CAST(min(rn) AS BIGINT) AS first FROM items GROUP BY 1, 2")
def _(spark, sf_dir):
    c = corpus(spark, sf_dir, "orders")
    rows = nodesets.distinct(c.found("/order/item", sv="@flag", first="count(preceding-sibling::item) + 1"))
    return rows.select("doc_id", F.col("sv").alias("flag"), F.col("first").cast("long").alias("first"))


@query("group_muenchian", ITEMS + "SELECT l_orderkey AS doc_id, l_returnflag AS flag, count(*) AS n, CAST(7 + 8 * (min(rn) - 1) AS BIGINT) AS first FROM items GROUP BY 1, 2")
def _(spark, sf_dir):
    keys = nodesets.keys(nodes(spark, sf_dir, "orders"), (F.col("kind") == "element") & (F.col("local") == "item"), F.element_at("attrs", "flag"))
    return nodesets.group_by_key(keys).select("doc_id", F.col("key_value").alias("flag"), "n", F.col("first").cast("long").alias("first"))


@query("str_concat_nodes", ITEMS + "SELECT l_orderkey AS doc_id, string_agg(l_returnflag, '' ORDER BY rn) AS flags FROM items GROUP BY 1")
def _(spark, sf_dir):
    return _items(spark, sf_dir, "flag").groupBy("doc_id").agg(strings.concat_ordered(F.col("pre"), F.col("flag")).alias("flags"))


@query("group_by_name", "SELECT o_orderkey AS doc_id, 'total' AS name, 1 AS n FROM orders UNION ALL SELECT l_orderkey, 'item', count(*) FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    kids = nodes(spark, sf_dir, "orders").filter("kind = 'element' AND level = 2")
    return kids.groupBy("doc_id", F.col("local").alias("name")).agg(F.count("*").alias("n"))


@query("generate_id", ITEMS + "SELECT l_orderkey AS doc_id, 'r' || l_orderkey || 'n' || (7 + 8 * (rn - 1)) AS id FROM items")
def _(spark, sf_dir):
    return corpus(spark, sf_dir, "orders").found("/order/item", id="generate-id()").select("doc_id", "id")


def _sorted(name: str, sql_order: str, keys, *by: str) -> None:
    @query(name, f"SELECT l_orderkey AS doc_id, CAST(l_partkey AS VARCHAR) AS part, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {sql_order}, rn) AS INTEGER) AS rank FROM (SELECT *, {RANKED} AS rn FROM lineitem)")
    def _(spark, sf_dir):
        return nodesets.ranked(_items(spark, sf_dir, "part", *by), keys()).select("doc_id", "part", "rank")


_sorted("sort_text", "CAST(l_partkey AS VARCHAR)", lambda: nodesets.sort_keys(F.col("part")))
_sorted("sort_number_desc", "l_quantity DESC", lambda: nodesets.sort_keys(F.col("q"), "number", True), "q")
_sorted("sort_multi", "l_returnflag, l_extendedprice DESC", lambda: [*nodesets.sort_keys(F.col("flag"), case_order="upper-first"), *nodesets.sort_keys(F.col("price"), "number", True)], "flag", "price")


@query("topk", f"SELECT l_orderkey AS doc_id, CAST(l_partkey AS VARCHAR) AS part FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, rn) AS k FROM (SELECT *, {RANKED} AS rn FROM lineitem)) WHERE k <= 2")
def _(spark, sf_dir):
    return nodesets.first_k(_items(spark, sf_dir, "q", "part"), 2, nodesets.sort_keys(F.col("q"), "number", True)).select("doc_id", "part")


def _sets(name: str, where: str, op) -> None:
    @query(name, ITEMS + f"SELECT l_orderkey AS doc_id, CAST(l_partkey AS VARCHAR) AS part FROM items WHERE {where}")
    def _(spark, sf_dir):
        rows = settle(_items(spark, sf_dir, "flag", "q", "part"))
        return op(rows.filter("flag = 'R'"), rows.filter("q > 25")).select("doc_id", "part")


_sets("set_intersection", "l_returnflag = 'R' AND l_quantity > 25", nodesets.intersection)
_sets("set_difference", "l_returnflag = 'R' AND NOT l_quantity > 25", nodesets.difference)
_sets("set_union", "l_returnflag = 'R' OR l_quantity > 25", nodesets.union)
FIRST_BIG = "coalesce((SELECT min(rn) FROM items b WHERE b.l_orderkey = items.l_orderkey AND l_quantity > 25), {0})"


def _cutting(name: str, sql: str, op) -> None:
    @query(name, ITEMS + "SELECT l_orderkey AS doc_id, CAST(l_partkey AS VARCHAR) AS part FROM items WHERE " + sql)
    def _(spark, sf_dir):
        rows = settle(_items(spark, sf_dir, "q", "part"))
        return op(rows, rows.filter("q > 25")).select("doc_id", "part")


_cutting("set_leading", "rn < " + FIRST_BIG.format(1000000), nodesets.leading)
_cutting("set_trailing", "rn > " + FIRST_BIG.format(-1), nodesets.trailing)


@query("set_has_same_node", "SELECT l_orderkey AS doc_id, bool_or(l_returnflag = 'R' AND l_quantity > 25) AS same FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1")
def _(spark, sf_dir):
    rows = settle(_items(spark, sf_dir, "flag", "q"))
    return nodesets.has_same_node(rows.filter("flag = 'R'"), rows.filter("q > 25"))


@query("closure", ITEMS + "SELECT l_orderkey AS doc_id, CAST(l_partkey AS VARCHAR) AS part FROM items WHERE rn > 1")
def _(spark, sf_dir):
    """Everything reachable from the first item by following-sibling steps."""
    rows = settle(_items(spark, sf_dir, "part"))
    nxt = rows.select("doc_id", "pre", F.lead("pre").over(nodesets.Window.partitionBy("doc_id").orderBy("pre")).alias("to")).filter("to IS NOT NULL")
    first = nodesets.first_k(rows, 1)
    return rows.join(nodesets.closure(first, nxt), ["doc_id", "pre"], "left_semi").select("doc_id", "part")


@query("number_simple", ITEMS + "SELECT l_orderkey AS doc_id, CAST(l_partkey AS VARCHAR) AS part, CAST(rn AS INTEGER) AS number FROM items")
def _(spark, sf_dir):
    n = nodesets.number_simple(nodes(spark, sf_dir, "orders"))
    return n.filter("local = 'item'").select("doc_id", F.element_at("attrs", "part").alias("part"), "number")


DEEP = """WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
 i AS (SELECT o_custkey, k, l.*, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag) AS rn,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag) AS total FROM o JOIN lineitem l ON o_orderkey = l_orderkey) """


def _is(*names: str):
    return (F.col("kind") == "element") & F.col("local").isin(*names)


@query("number_single", DEEP + f"SELECT o_custkey AS doc_id, {QTY} AS q, CAST(rn AS INTEGER) AS number FROM i")
def _(spark, sf_dir):
    n = nodes(spark, sf_dir, "customers")
    q = n.filter(_is("qty"))
    return q.join(nodesets.number_single(n, q, _is("item")), ["doc_id", "pre"]).select("doc_id", to_num(F.col("value")).alias("q"), "number")


@query("number_multiple", DEEP + f"SELECT o_custkey AS doc_id, {QTY} AS q, k || '.' || rn AS number FROM i")
def _(spark, sf_dir):
    n = nodes(spark, sf_dir, "customers")
    q = n.filter(_is("qty"))
    got = nodesets.number_multiple(n, q, _is("item", "order"))
    # orders are numbered among elements that count: no other element counts beside them
    return q.join(got, ["doc_id", "pre"]).select("doc_id", to_num(F.col("value")).alias("q"), F.array_join(F.transform("numbers", lambda x: x.cast("string")), ".").alias("number"))


@query("number_any", DEEP + f"SELECT o_custkey AS doc_id, {QTY} AS q, CAST(total AS BIGINT) AS number FROM i")
def _(spark, sf_dir):
    got = nodesets.number_any(nodes(spark, sf_dir, "customers"), _is("qty"))
    return got.filter(_is("qty")).select("doc_id", to_num(F.col("value")).alias("q"), "number")


@query("abspath", DEEP + "SELECT o_custkey AS doc_id, '/customer[1]/s:order[' || k || ']/item[' || rn || ']' AS abspath FROM i")
def _(spark, sf_dir):
    n = nodes(spark, sf_dir, "customers")
    return nodesets.abspath(n, n.filter(_is("item"))).select("doc_id", "abspath")


def _formatted(name: str, sql: str, col) -> None:
    @query(name, f"SELECT p_partkey AS id, {sql} AS v FROM part")
    def _(spark, sf_dir):
        return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), col().alias("v"))


_formatted("number_format_padded", "lpad(CAST(p_size AS VARCHAR), 3, '0')", lambda: numbers.numbered(F.col("p_size"), "001"))
_formatted("number_format_alpha", "CASE WHEN p_size <= 26 THEN chr(64 + CAST(p_size AS INTEGER)) ELSE chr(64 + CAST((p_size - 1) // 26 AS INTEGER)) || chr(65 + CAST((p_size - 1) % 26 AS INTEGER)) END", lambda: numbers.numbered(F.col("p_size"), "A"))
_formatted("number_format_roman", "repeat('x', CAST(p_size // 10 AS INTEGER) % 4) || CASE WHEN p_size // 10 = 4 THEN 'xl' WHEN p_size // 10 = 5 THEN 'l' ELSE '' END || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][CAST(p_size % 10 AS INTEGER) + 1]", lambda: numbers.numbered(F.col("p_size"), "i"))
ORACLES["number_format_roman"] = "SELECT p_partkey AS id, CASE WHEN p_size < 40 THEN repeat('x', CAST(p_size // 10 AS INTEGER)) WHEN p_size < 50 THEN 'xl' ELSE 'l' || repeat('x', CAST(p_size // 10 AS INTEGER) - 5) END || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][CAST(p_size % 10 AS INTEGER) + 1] AS v FROM part"
_formatted("number_format_grouped", "regexp_replace(CAST(p_partkey * 12345 + 7 AS VARCHAR), '(\\d)(?=(\\d{3})+$)', '\\1,', 'g')", lambda: numbers.numbered(F.col("p_partkey") * 12345 + 7, "1", ",", 3))
ORACLES["number_format_grouped"] = "SELECT p_partkey AS id, format('{:,}', p_partkey * 12345 + 7) AS v FROM part"
_formatted("format_number", "format('{:,.2f}', CAST(p_retailprice AS DECIMAL(18,2)))", lambda: numbers.format_number(F.col("p_retailprice"), "#,##0.00"))
ORACLES["format_number"] = "SELECT p_partkey AS id, format('{:,}', CAST(floor(CAST(p_retailprice AS DECIMAL(18,2))) AS BIGINT)) || '.' || lpad(CAST(CAST(round((CAST(p_retailprice AS DECIMAL(18,2)) - floor(CAST(p_retailprice AS DECIMAL(18,2)))) * 100) AS BIGINT) AS VARCHAR), 2, '0') AS v FROM part"

# -- core functions ------------------------------------------------------------------------------------



def _core(name: str, expr: str, sql: str) -> None:
    by_path(name, f"SELECT c_custkey AS doc_id, {sql} AS v FROM customer", "customers", "/customer", v=expr)


_core("fn_concat", "concat(@segment, '-', @id)", "c_mktsegment || '-' || c_custkey")
_core("fn_starts_with", "starts-with(@segment, 'B')", "starts_with(c_mktsegment, 'B')")
_core("fn_contains", "contains(name, '#0000001')", "contains(c_name, '#0000001')")
_core("fn_substring_before", "substring-before(name, '#')", "split_part(c_name, '#', 1)")
_core("fn_substring_after", "substring-after(name, '#')", "split_part(c_name, '#', 2)")
_core("fn_substring", "substring(name, 1.5, 6)", "substr(c_name, 2, 6)")
_core("fn_string_length", "string-length(@segment)", "CAST(length(c_mktsegment) AS DOUBLE)")
_core("fn_normalize_space", "normalize-space(concat('  ', @segment, '   ', @id, ' '))", "c_mktsegment || ' ' || c_custkey")
_core("fn_translate", "translate(@segment, 'AEIOU', 'aei')", "translate(replace(replace(c_mktsegment, 'O', ''), 'U', ''), 'AEI', 'aei')")
_core("fn_boolean", "boolean(s:order)", "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_core("fn_not", "not(s:order)", "NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_core("fn_true_false", "true() != false()", "TRUE")
_core("fn_lang", "lang('en')", "TRUE")
_core("fn_number", "number(@id) + 0.5", "CAST(c_custkey AS DOUBLE) + 0.5")
_core("fn_floor", "floor(@id div 7)", "floor(CAST(c_custkey AS DOUBLE) / 7)")
_core("fn_ceiling", "ceiling(@id div 7)", "ceil(CAST(c_custkey AS DOUBLE) / 7)")
_core("fn_round", "round(-@id div 2)", "floor(-CAST(c_custkey AS DOUBLE) / 2 + 0.5) + 0")
_core("fn_name", "name(s:order)", "CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 's:order' ELSE '' END")
_core("fn_local_name", "local-name(*[2])", "CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'order' ELSE 'last' END")
_core("fn_namespace_uri", "namespace-uri(*[2])", "CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'urn:sales' ELSE '' END")
_core("fn_string", "string(@id)", "CAST(c_custkey AS VARCHAR)")
_core("fn_sum", "sum(s:order/@n)", "(SELECT coalesce(CAST(sum(o_orderkey) AS DOUBLE), 0.0) FROM orders WHERE o_custkey = c_custkey)")
_core("fn_count", "count(s:order)", "(SELECT CAST(count(*) AS DOUBLE) FROM orders WHERE o_custkey = c_custkey)")
by_path("fn_position_last", ITEMS + "SELECT l_orderkey AS doc_id, CAST(l_partkey AS VARCHAR) AS part FROM items WHERE rn * 2 = n_items", "orders", "/order/item[position() * 2 = last()]", part="@part")
by_path("fn_id", "SELECT o_custkey AS doc_id, max_by(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1", "customers", "id(/customer/last/@refs)[last()]", status="@status")
by_path("strval_of_mixed", "SELECT l_orderkey AS doc_id, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS v FROM lineitem", "orders", "/order/item", v="string(.)")


# -- scalar functions on columns -------------------------------------------------------------------------


def _scalar(name: str, source: str, key: str, col, sql: str | None) -> None:
    @query(name, f"SELECT {key} AS id, {sql} AS v FROM {source}" if sql else None)
    def _(spark, sf_dir):
        return table(spark, sf_dir, source).select(F.col(key).alias("id"), col().alias("v"))


def _part(name, col, sql):
    _scalar(name, "part", "p_partkey", col, sql)


_part("str_align", lambda: strings.align(F.col("p_brand"), F.lit("------------"), "right"), "lpad(p_brand, 12, '-')")
_part("str_align_center", lambda: strings.align(F.col("p_brand"), F.lit("------------"), "center"), "repeat('-', CAST((12 - length(p_brand)) // 2 AS INTEGER)) || rpad(p_brand, 12 - CAST((12 - length(p_brand)) // 2 AS INTEGER), '-')")
_part("str_padding", lambda: strings.padding(F.col("p_size") % 9, F.lit("ab")), "substr(repeat('ab', 5), 1, CAST(p_size % 9 AS INTEGER))")
_part("str_encode_uri", lambda: strings.encode_uri(F.concat("p_name", F.lit("&é"))), "replace(p_name, ' ', '%20') || '%26%C3%A9'")
_part("str_decode_uri", lambda: strings.decode_uri(F.concat(F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit("+%C3%A9"))), "p_name || '+é'")
_part("str_replace", lambda: strings.replace_all(F.col("p_name"), [("ring", "R"), ("ri", "x"), ("red", "ri")]), "replace(replace(replace(replace(replace(replace(p_name, 'ring', chr(1)), 'red', chr(2)), 'ri', chr(3)), chr(1), 'R'), chr(2), 'ri'), chr(3), 'x')")
_part("str_split", lambda: F.size(strings.split(F.col("p_name"), " ")).cast("long"), "CAST(len(string_split(p_name, ' ')) AS BIGINT)")
_part("str_tokenize", lambda: F.array_join(strings.tokenize(F.concat("p_name", F.lit(", ,"), "p_type"), ", "), "|"), "replace(p_name, ' ', '|') || '|' || replace(p_type, ' ', '|')")
_part("re_test", lambda: strings.regex_test(F.col("p_name"), "^RED", "i"), "regexp_matches(p_name, '^red')")
_part("re_match", lambda: F.array_join(strings.regex_match(F.col("p_name"), r"^(\w)\w* (\w)"), "|"), r"regexp_extract(p_name, '^(\w)\w* (\w)', 0) || '|' || regexp_extract(p_name, '^(\w)\w* (\w)', 1) || '|' || regexp_extract(p_name, '^(\w)\w* (\w)', 2)")
_part("re_match_all", lambda: F.array_join(strings.regex_match(F.col("p_name"), "[aeiou]", "g"), ""), "array_to_string(regexp_extract_all(p_name, '[aeiou]'), '')")
_part("re_replace", lambda: strings.regex_replace(F.col("p_name"), "([aeiou])", "g", r"<\1>"), r"regexp_replace(p_name, '([aeiou])', '<\1>', 'g')")
_part("re_replace_first", lambda: strings.regex_replace(F.col("p_name"), "[aeiou]", "", "_"), "regexp_replace(p_name, '[aeiou]', '_')")
_part("str_is_ncname", lambda: strings.is_ncname(F.col("p_brand")), "regexp_full_match(p_brand, '[A-Za-z_][A-Za-z_0-9.-]*')")
_part("str_is_name_qname", lambda: strings.is_name(F.concat(F.lit("a:"), "p_type")) & strings.is_qname(F.concat(F.lit("a:"), "p_type")) & strings.is_nmtoken(F.col("p_type")), "regexp_full_match(p_type, '[A-Za-z_][A-Za-z_0-9.-]*')")
_part("str_split_qname", lambda: F.concat_ws("|", strings.split_qname(F.concat(F.lit("p:"), "p_type"))["prefix"], strings.split_qname(F.concat(F.lit("p:"), "p_type"))["local"]), "'p|' || p_type")
_part("str_strip", lambda: F.concat(strings.strip(F.concat(F.lit(" \n"), "p_name", F.lit("\t"))), F.lit("|"), strings.lstrip(F.concat(F.lit(" "), "p_name")), F.lit("|"), strings.rstrip(F.concat("p_name", F.lit(" ")))), "p_name || '|' || p_name || '|' || p_name")
_part("str_is_space", lambda: strings.is_space(F.regexp_replace("p_name", "[a-m]", " ")), "regexp_full_match(regexp_replace(p_name, '[a-m]', ' ', 'g'), '[ \\t\\r\\n]+')")
_part("str_legalize", lambda: strings.legalize(F.concat("p_name", F.lit("\x01x"))), "p_name || '?x'")
_part("str_python_name", lambda: strings.python_name(F.col("p_brand"), ("Brand_1",)), "CASE WHEN regexp_replace(p_brand, '[^0-9A-Za-z_]', '_', 'g') = 'Brand_1' THEN 'Brand_1_' ELSE regexp_replace(p_brand, '[^0-9A-Za-z_]', '_', 'g') END")
_part("str_pseudo_attributes", lambda: F.element_at(strings.pseudo_attributes(F.concat(F.lit('href="'), "p_name", F.lit("\" type='x'"))), "href"), "p_name")
_part("str_is_xml", lambda: is_xml(F.when(F.col("p_size") > 25, F.lit("<a/>")).otherwise(F.col("p_name"))), "p_size > 25")
for _name, _col, _sql in (
    ("abs", lambda: F.abs(F.lit(25) - F.col("p_size")).cast("double"), "CAST(abs(25 - p_size) AS DOUBLE)"),
    ("trig", lambda: F.round(F.sin("p_size") + F.cos("p_size") * F.tan("p_size"), 6), "round(sin(p_size) + cos(p_size) * tan(p_size), 6)"),
    ("inverse", lambda: F.round(F.asin(F.col("p_size") / 100) + F.acos(F.col("p_size") / 100) * F.atan("p_size"), 6), "round(asin(p_size / 100) + acos(p_size / 100) * atan(p_size), 6)"),
    ("atan2", lambda: F.round(numbers.atan2(F.col("p_size").cast("double"), F.col("p_retailprice")), 9), "round(atan2(p_size, p_retailprice), 9)"),
    ("exp_log", lambda: F.round(F.exp(numbers.log(F.col("p_retailprice"))), 4), "round(exp(ln(p_retailprice)), 4)"),
    ("log_zero", lambda: numbers.log(F.col("p_size") * 0.0).cast("string"), "'-Infinity'"),
    ("sqrt", lambda: F.round(numbers.sqrt(F.lit(25.0) - F.col("p_size")), 6), "round(CASE WHEN p_size > 25 THEN 0 ELSE sqrt(25 - p_size) END, 6)"),
    ("power", lambda: F.round(numbers.power(F.col("p_size").cast("double"), F.lit(1.5)), 4), "round(power(p_size, 1.5), 4)"),
    ("constant", lambda: numbers.constant("PI", 4), "CAST(3.1415 AS DOUBLE)"),
    ("random", lambda: (numbers.random(7) < 1.0), "TRUE"),
):
    _part(f"math_{_name}", _col, _sql)


def _order(name, col, sql):
    stamp = lambda: F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    _scalar(f"date_{name}", "orders", "o_orderkey", lambda: col(stamp()), sql)


_order("date_time_parts", lambda s: F.concat_ws("|", dates.date(s), dates.time(s)), "strftime(o_orderdate, '%Y-%m-%dZ|%H:%M:%SZ')")
_order("year", dates.year, "CAST(year(o_orderdate) AS DOUBLE)")
_order("leap_year", dates.leap_year, "(year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0) OR year(o_orderdate) % 400 = 0")
_order("month_in_year", dates.month_in_year, "CAST(month(o_orderdate) AS DOUBLE)")
_order("month_name", dates.month_name, "monthname(o_orderdate)")
_order("month_abbreviation", lambda s: dates.month_name(s, True), "substr(monthname(o_orderdate), 1, 3)")
_order("week_in_year", dates.week_in_year, "CAST(weekofyear(o_orderdate) AS DOUBLE)")
_order("week_in_month", dates.week_in_month, "CAST((day(o_orderdate) - 1 + isodow(date_trunc('month', o_orderdate)) - 1) // 7 + 1 AS DOUBLE)")
_order("day_in_year", dates.day_in_year, "CAST(dayofyear(o_orderdate) AS DOUBLE)")
_order("day_in_month", dates.day_in_month, "CAST(day(o_orderdate) AS DOUBLE)")
_order("day_of_week_in_month", dates.day_of_week_in_month, "CAST((day(o_orderdate) - 1) // 7 + 1 AS DOUBLE)")
_order("day_in_week", dates.day_in_week, "CAST(dayofweek(o_orderdate) + 1 AS DOUBLE)")
_order("day_name", dates.day_name, "dayname(o_orderdate)")
_order("day_abbreviation", lambda s: dates.day_name(s, True), "substr(dayname(o_orderdate), 1, 3)")
_order("hour_minute_second", lambda s: dates.hour_in_day(s) * 3600 + dates.minute_in_hour(s) * 60 + dates.second_in_minute(s), "CAST(hour(o_orderdate) * 3600 + minute(o_orderdate) * 60 + second(o_orderdate) AS DOUBLE)")
_order("format_date", lambda s: dates.format_date(s, "EEE, d MMM yyyy 'at' HH:mm z"), "substr(dayname(o_orderdate), 1, 3) || ', ' || day(o_orderdate) || ' ' || substr(monthname(o_orderdate), 1, 3) || ' ' || year(o_orderdate) || ' at ' || strftime(o_orderdate, '%H:%M') || ' GMT'")
_order("seconds", dates.seconds, "CAST(epoch(o_orderdate) AS DOUBLE)")
_order("difference", lambda s: dates.difference(F.lit("1992-01-01T00:00:00Z"), s), "CASE WHEN datediff('day', DATE '1992-01-01', o_orderdate) = 0 THEN 'PT0S' ELSE 'P' || datediff('day', DATE '1992-01-01', o_orderdate) || 'D' END")
_order("add", lambda s: dates.add(F.substring(s, 1, 10), F.lit("P1M3D")), "strftime(o_orderdate + INTERVAL 1 MONTH + INTERVAL 3 DAY, '%Y-%m-%d')")
_order("add_duration", lambda s: dates.add_duration(F.concat(F.lit("P"), dates.month_in_year(s).cast("int").cast("string"), F.lit("M")), F.lit("P1Y")), "CASE WHEN month(o_orderdate) = 12 THEN 'P2Y' ELSE 'P1Y' || month(o_orderdate) || 'M' END")
_order("duration", lambda s: dates.duration(dates.day_in_month(s) * 3600), "CASE WHEN day(o_orderdate) < 24 THEN 'PT' || day(o_orderdate) || 'H' WHEN day(o_orderdate) = 24 THEN 'P1D' ELSE 'P1DT' || (day(o_orderdate) - 24) || 'H' END")


@query("date_sum", "SELECT o_orderstatus AS status, 'P' || sum(day(o_orderdate)) || 'D' AS v FROM orders GROUP BY 1")
def _(spark, sf_dir):
    d = F.concat(F.lit("P"), F.dayofmonth("o_orderdate").cast("string"), F.lit("D"))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(dates.sum_durations(d).alias("v"))


def _page(name, col, sql):
    _scalar(f"iri_{name}", "pages", "page_id", lambda: col(F.col("url")), sql)


U = r"regexp_extract(url, '^(https?)://([^/?#]*)([^?#]*)(\?([^#]*))?(#(.*))?$', {0})"
_page("split", lambda u: F.concat_ws(" ", *[F.coalesce(iri.split(u)[k], F.lit("-")) for k in ("scheme", "authority", "path", "query", "fragment")]), f"concat_ws(' ', {U.format(1)}, {U.format(2)}, {U.format(3)}, CASE WHEN contains(url, '?') THEN {U.format(5)} ELSE '-' END, CASE WHEN contains(url, '#') THEN {U.format(7)} ELSE '-' END)")
_page("unsplit", lambda u: iri.unsplit(*[iri.split(u)[k] for k in ("scheme", "authority", "path", "query", "fragment")]), "url")
_page("scheme", iri.scheme, U.format(1))
_page("authority", lambda u: iri.authority(u)["host"], f"regexp_replace({U.format(2)}, ':[0-9]*$', '')")
_page("strip_fragment", iri.strip_fragment, "split_part(url, '#', 1)")
_page("fragment", lambda u: F.coalesce(iri.fragment(u), F.lit("")), "split_part(url, '#', 2)")
_page("is_absolute", iri.is_absolute, "regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:')")
_page("absolutize", lambda u: iri.absolutize(F.lit("../x/./y?q"), u), f"{U.format(1)} || '://' || {U.format(2)} || CASE WHEN {U.format(3)} = '' THEN '/' ELSE regexp_replace(regexp_replace({U.format(3)}, '[^/]*$', ''), '[^/]+/$', '') END || 'x/y?q'")
_page("relativize", lambda u: iri.relativize(iri.absolutize(F.lit("/zz/q"), u), u), f"CASE WHEN {U.format(3)} = '' THEN 'zz/q' ELSE repeat('../', CAST(len(string_split({U.format(3)}, '/')) AS INTEGER) - 2) || 'zz/q' END")
_page("remove_dot_segments", lambda u: iri.remove_dot_segments(F.concat(iri.split(u)["path"], F.lit("/../a/./b/.."))), f"CASE WHEN {U.format(3)} = '' THEN '/a/' ELSE regexp_replace({U.format(3)}, '[^/]*$', '') || 'a/' END")
_page("normalize_case", lambda u: iri.normalize_case(F.concat(F.lit("HTTP"), F.regexp_replace(u, "^https?", ""), F.lit("%2f"))), "'http' || regexp_replace(url, '^https?', '') || '%2F'")
_page("normalize_percent", lambda u: iri.normalize_percent(F.concat(u, F.lit("%41%2f"))), "url || 'A%2f'")
_page("percent_encode", lambda u: iri.percent_encode(u), "url_encode(url)")
_page("percent_decode", lambda u: iri.percent_decode(iri.percent_encode(u)), "url")
_page("public_id_urn", lambda u: iri.urn_to_public_id(iri.public_id_to_urn(u)), "url")
_page("path_uri", lambda u: iri.uri_to_path(iri.path_to_uri(iri.split(u)["path"])), U.format(3))
_page("iri_to_uri", lambda u: iri.iri_to_uri(F.concat(u, F.lit("é"))), "url || '%C3%A9'")
_page("base_join", lambda u: iri.base_join(F.lit("a/b/c"), F.concat(F.lit("../"), iri.scheme(u))), f"'a/' || {U.format(1)}")

# -- sources and HTML ----------------------------------------------------------------------------------


@query("parse_errors", "SELECT o_orderkey % 5 AS kind, count(*) AS documents, count(*) FILTER (o_orderkey % 5 IN (1, 2, 3)) AS errors FROM orders GROUP BY 1")
def _(spark, sf_dir):
    d = documents(broken_markup(spark, sf_dir), "doc_id", "xml")
    return d.groupBy(F.pmod("doc_id", F.lit(5)).alias("kind")).agg(F.count("*").alias("documents"), F.count("error").alias("errors"))


@query("parse_skips_errors", "SELECT count(*) AS n FROM orders WHERE o_orderkey % 5 NOT IN (1, 2, 3)")
def _(spark, sf_dir):
    return shred(broken_markup(spark, sf_dir), "doc_id", "xml").filter("kind = 'root'").agg(F.count("*").alias("n"))


@query("sax_element_count", "SELECT o_orderkey AS doc_id, 2 + 3 * count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def _(spark, sf_dir):
    return nodes(spark, sf_dir, "orders").filter("kind = 'element'").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("sax_events", "SELECT o_orderkey AS doc_id, 2 * (2 + 3 * count(l_orderkey)) + 2 + 1 + 2 * count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def _(spark, sf_dir):
    return patterns.events(nodes(spark, sf_dir, "orders")).groupBy("doc_id").agg(F.count("*").alias("n"))


BODY = "regexp_replace(regexp_replace(html, '(?s)<script>.*?</script>', ''), '(?s)<!--.*?-->', '', 'g')"


@query("html_links", f"SELECT page_id AS doc_id, unnest(regexp_extract_all({BODY}, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def _(spark, sf_dir):
    return pages(spark, sf_dir).filter("kind = 'attribute' AND local = 'href'").select("doc_id", F.col("value").alias("href"))


@query("html_lang", "SELECT page_id AS doc_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages")
def _(spark, sf_dir):
    return pages(spark, sf_dir).filter("kind = 'element' AND local = 'html'").select("doc_id", F.element_at("attrs", "lang").alias("lang"))


def _html_count(name: str, local: str) -> None:
    @query(name, f"SELECT page_id AS doc_id, len(regexp_extract_all({BODY}, '<{local}[ >]')) AS n FROM pages")
    def _(spark, sf_dir):
        return pages(spark, sf_dir).filter((F.col("kind") == "element") & (F.col("local") == local)).groupBy("doc_id").agg(F.count("*").alias("n"))


_html_count("html_title", "title")
_html_count("html_h1", "h1")
_html_count("html_paragraphs", "p")
_html_count("html_items", "li")


@query("html_fragment_body", "SELECT page_id AS doc_id, 1 AS n FROM pages")
def _(spark, sf_dir):
    """The body of every page, as a fragment parse returns it."""
    return pages(spark, sf_dir).filter("kind = 'element' AND local = 'body'").groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))


@query("html_script_is_text", "SELECT page_id AS doc_id, regexp_extract(html, '(?s)<script>(.*?)</script>', 1) AS code FROM pages")
def _(spark, sf_dir):
    return pages(spark, sf_dir).filter("kind = 'element' AND local = 'script'").select("doc_id", F.col("value").alias("code"))


@query("separator_reader", "SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS n FROM documents")
def _(spark, sf_dir):
    """Parts of a text between separators."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("n"))


# -- streaming patterns ------------------------------------------------------------------------------------


def _push(name: str, sql: str, which: str, pattern: str) -> None:
    @query(name, sql)
    def _(spark, sf_dir):
        found = patterns.match(nodes(spark, sf_dir, which), {"m": pattern}, {"s": "urn:sales"})
        return found.groupBy("doc_id").agg(F.count("*").alias("n"))


_push("push_relative", "SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem GROUP BY 1", "orders", "item/qty")
_push("push_absolute", "SELECT o_orderkey AS doc_id, CAST(1 AS BIGINT) AS n FROM orders", "orders", "/order/total")
_push("push_descendant", "SELECT o_custkey AS doc_id, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1", "customers", "/customer//qty")
_push("push_union", "SELECT o_orderkey AS doc_id, 1 + count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1", "orders", "total | item/price")
_push("push_namespace", "SELECT o_custkey AS doc_id, count(*) AS n FROM orders GROUP BY 1", "customers", "s:order")
_push("push_wildcard", "SELECT l_orderkey AS doc_id, 2 * count(*) AS n FROM lineitem GROUP BY 1", "orders", "item/*")


@query("push_attr", "SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    """A match on an attribute yields the element that has it."""
    found = patterns.match(nodes(spark, sf_dir, "orders"), {"m": "item/@flag"})
    return found.select("doc_id", "element").distinct().groupBy("doc_id").agg(F.count("*").alias("n"))


@query("push_labels", "SELECT 'a' AS label, count(*) AS n FROM lineitem UNION ALL SELECT 'b', count(*) FROM orders")
def _(spark, sf_dir):
    found = patterns.match(nodes(spark, sf_dir, "orders"), {"a": "//qty", "b": "/order"})
    return found.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


# -- serialisers -----------------------------------------------------------------------------------------


def _written(name: str, method: str, sql: str | None = None, which: str = "orders") -> None:
    @query(name, sql)
    def _(spark, sf_dir):
        return update.reserialize(markup(spark, sf_dir, which), "doc_id", "xml", method)


ORDER_XML = """WITH x AS (SELECT l_orderkey, string_agg('<item line="' || l_linenumber || '" part="' || l_partkey || '" flag="' || l_returnflag || '"><qty>' || CAST(l_quantity AS BIGINT) || '</qty><price>' || CAST(l_extendedprice AS DECIMAL(18,2)) || '</price></item>', '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag) AS xs FROM lineitem GROUP BY 1)
 SELECT o_orderkey AS doc_id, '<order id="' || o_orderkey || '" status="' || o_orderstatus || '" date="' || strftime(o_orderdate, '%Y-%m-%d') || '"><total>' || CAST(o_totalprice AS DECIMAL(18,2)) || '</total>' || coalesce(xs, '') || '</order>' AS result FROM orders LEFT JOIN x ON o_orderkey = l_orderkey"""
_written("ser_xml", "xml", ORDER_XML)
ORDER_C14N = ORDER_XML.replace("""'<item line="' || l_linenumber || '" part="' || l_partkey || '" flag="' || l_returnflag || '">""", """'<item flag="' || l_returnflag || '" line="' || l_linenumber || '" part="' || l_partkey || '">""").replace("""'<order id="' || o_orderkey || '" status="' || o_orderstatus || '" date="' || strftime(o_orderdate, '%Y-%m-%d') || '">""", """'<order date="' || strftime(o_orderdate, '%Y-%m-%d') || '" id="' || o_orderkey || '" status="' || o_orderstatus || '">""")
_written("ser_c14n", "xml-canonical", ORDER_C14N)
_written("ser_xml_indent", "xml-indent")
_written("ser_text", "text", "WITH x AS (SELECT l_orderkey, string_agg(CAST(l_quantity AS BIGINT) || '' || CAST(l_extendedprice AS DECIMAL(18,2)), '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag) AS xs FROM lineitem GROUP BY 1) SELECT o_orderkey AS doc_id, CAST(o_totalprice AS DECIMAL(18,2)) || coalesce(xs, '') AS result FROM orders LEFT JOIN x ON o_orderkey = l_orderkey")


def _written_page(name: str, method: str) -> None:
    @query(name)
    def _(spark, sf_dir):
        return update.reserialize(table(spark, sf_dir, "pages"), "page_id", "html", method, "html")


for _m in ("html", "html-indent", "html-nsstrip", "xhtml", "xhtml-indent"):
    _written_page(f"ser_{_m.replace('-', '_')}", _m)


@query("struct_writer", "SELECT n_nationkey AS doc_id, '<n xmlns:s=\"urn:sales\" key=\"' || n_nationkey || '\"><s:name>' || n_name || '</s:name>&lt;' || n_regionkey || '<e/></n>' AS result FROM nation")
def _(spark, sf_dir):
    """Nested structures with a declaration, attributes, a callable, a generator and raw markup, fed for every row."""
    from treeloom.sources.serialize import NS, RAW_XML, E, feed_rows

    def build(r):
        return E("n", {"key": r["n_nationkey"]}, NS("s", "urn:sales"), E("s:name", lambda: r["n_name"]), (x for x in ("<", r["n_regionkey"])), RAW_XML("<e/>"))

    return feed_rows(table(spark, sf_dir, "nation"), "n_nationkey", build, "n_nationkey", "n_name", "n_regionkey")


def _written_soup(name: str, method: str, text: str) -> None:
    @query(name, f"SELECT n_nationkey AS doc_id, {text} AS result FROM nation")
    def _(spark, sf_dir):
        soup = F.concat(F.lit("<p>"), "n_name", F.lit("<br><img src='"), "n_nationkey", F.lit(".png'>a &amp; b<p><script>a<b</script>"))
        return update.reserialize(table(spark, sf_dir, "nation").select("n_nationkey", soup.alias("html")), "n_nationkey", "html", method, "html")


_written_soup("ser_html_bytes", "html", """'<html><body><p>' || n_name || '<br><img src="' || n_nationkey || '.png">a &amp; b</p><p><script>a<b</script></p></body></html>'""")
_written_soup("ser_html_indent_bytes", "html-indent", """'<html>' || chr(10) || '  <body>' || chr(10) || '    <p>' || n_name || '<br><img src="' || n_nationkey || '.png">a &amp; b</p>' || chr(10) || '    <p><script>a<b</script></p>' || chr(10) || '  </body>' || chr(10) || '</html>'""")
_written_soup("ser_xhtml_bytes", "xhtml", """'<html><body><p>' || n_name || '<br /><img src="' || n_nationkey || '.png" />a &amp; b</p><p><script>a&lt;b</script></p></body></html>'""")
_written("ser_xml_indent_bytes", "xml-indent", """WITH x AS (SELECT l_orderkey, string_agg('  <item line="' || l_linenumber || '" part="' || l_partkey || '" flag="' || l_returnflag || '">' || chr(10) || '    <qty>' || CAST(l_quantity AS BIGINT) || '</qty>' || chr(10) || '    <price>' || CAST(l_extendedprice AS DECIMAL(18,2)) || '</price>' || chr(10) || '  </item>' || chr(10), '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag) AS xs FROM lineitem GROUP BY 1)
 SELECT o_orderkey AS doc_id, '<order id="' || o_orderkey || '" status="' || o_orderstatus || '" date="' || strftime(o_orderdate, '%Y-%m-%d') || '">' || chr(10) || '  <total>' || CAST(o_totalprice AS DECIMAL(18,2)) || '</total>' || chr(10) || coalesce(xs, '') || '</order>' AS result FROM orders LEFT JOIN x ON o_orderkey = l_orderkey""")


@query("roundtrip", "SELECT count(*) AS same, 0 AS differ FROM orders")
def _(spark, sf_dir):
    """Parse, write, parse again: no document's tree changes."""
    same = update.roundtrip(markup(spark, sf_dir, "orders"), "doc_id", "xml")
    return same.agg(F.count_if("same").alias("same"), F.count_if(~F.col("same")).cast("int").alias("differ"))


# -- updates -----------------------------------------------------------------------------------------------

X = 'xmlns:xupdate="http://www.xmldb.org/xupdate"'


def _updated(name: str, commands: str, expr: str, sql: str) -> None:
    @query(name, sql)
    def _(spark, sf_dir):
        todo = f'<xupdate:modifications version="1.0" {X}>{commands}</xupdate:modifications>'
        return update.updated(markup(spark, sf_dir, "orders"), "doc_id", "xml", todo).value(expr)


N_ITEMS = "(SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey)"
_updated("upd_append", '<xupdate:append select="/order"><xupdate:element name="note"><xupdate:attribute name="by">{@id}</xupdate:attribute>new</xupdate:element></xupdate:append>', "concat(name(/order/*[last()]), '/', /order/note)", "SELECT o_orderkey AS doc_id, 'note/new' AS value FROM orders")
_updated("upd_insert_before", '<xupdate:insert-before select="/order/total"><head/></xupdate:insert-before>', "name(/order/*[1])", "SELECT o_orderkey AS doc_id, 'head' AS value FROM orders")
_updated("upd_insert_after", '<xupdate:insert-after select="/order/total"><xupdate:text>x</xupdate:text><mid/></xupdate:insert-after>', "name(/order/*[2])", "SELECT o_orderkey AS doc_id, 'mid' AS value FROM orders")
_updated("upd_update", '<xupdate:update select="/order/total"><xupdate:value-of select="/order/@id"/></xupdate:update><xupdate:update select="/order/@status">Z</xupdate:update>', "concat(/order/total, /order/@status)", "SELECT o_orderkey AS doc_id, o_orderkey || 'Z' AS value FROM orders")
_updated("upd_remove", "<xupdate:remove select=\"//item[@flag='R']\"/>", "count(//item)", "SELECT o_orderkey AS doc_id, CAST(count(l_orderkey) AS DOUBLE) AS value FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag <> 'R' GROUP BY 1")
_updated("upd_rename", '<xupdate:rename select="//item">line</xupdate:rename><xupdate:rename select="/order/@status">state</xupdate:rename>', "concat(count(//line), /order/@state)", f"SELECT o_orderkey AS doc_id, {N_ITEMS} || o_orderstatus AS value FROM orders")
_updated("upd_variable_if", "<xupdate:variable name=\"s\" select=\"string(/order/@status)\"/><xupdate:if test=\"$s = 'F'\"><xupdate:append select=\"/order\"><f/></xupdate:append></xupdate:if>", "count(/order/f)", "SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM orders")

by_value("fn_translate_computed", "SELECT o_orderkey AS doc_id, '<' || o_orderstatus || '>x' AS value FROM orders", "orders", "concat(translate(concat('a', /order/@status, 'b'), concat('a', 'b'), concat('<', '>')), 'x')")
by_path("fn_lang_computed", "SELECT c_custkey AS doc_id, true AS value FROM customer", "customers", "/customer", value="lang(substring('xEN', 2)) and not(lang(concat('f', 'r')))")

# -- templates -----------------------------------------------------------------------------------------------

SHEET = '<xsl:stylesheet version="1.0" xmlns:xsl="http://www.w3.org/1999/XSL/Transform"><xsl:output method="text"/>{0}</xsl:stylesheet>'


def _templated(name: str, body: str, sql: str | None, which: str = "orders") -> None:
    @query(name, sql)
    def _(spark, sf_dir):
        return xslt.transform(markup(spark, sf_dir, which), "doc_id", "xml", SHEET.format(body)).select("doc_id", "result")


_templated("xsl_value_of", '<xsl:template match="/"><xsl:value-of select="/order/@id"/>:<xsl:value-of select="count(//item)"/></xsl:template>', f"SELECT o_orderkey AS doc_id, o_orderkey || ':' || {N_ITEMS} AS result FROM orders")
_templated("xsl_for_each", '<xsl:template match="/"><xsl:for-each select="//item"><xsl:sort select="@part" data-type="number" order="descending"/><xsl:value-of select="@part"/>,</xsl:for-each></xsl:template>', "SELECT o_orderkey AS doc_id, coalesce(string_agg(l_partkey || ',', '' ORDER BY l_partkey DESC), '') AS result FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
_templated("xsl_choose", '<xsl:template match="/"><xsl:choose><xsl:when test="order/@status=\'F\'">final</xsl:when><xsl:when test="order/@status=\'O\'">open</xsl:when><xsl:otherwise>part</xsl:otherwise></xsl:choose></xsl:template>', "SELECT o_orderkey AS doc_id, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'part' END AS result FROM orders")
_templated("xsl_if", '<xsl:template match="/"><xsl:if test="count(//item) &gt; 4">many</xsl:if></xsl:template>', f"SELECT o_orderkey AS doc_id, CASE WHEN {N_ITEMS} > 4 THEN 'many' ELSE '' END AS result FROM orders")
_templated("xsl_apply_templates", '<xsl:template match="total"/><xsl:template match="item[qty &gt; 25]">B</xsl:template><xsl:template match="item">s</xsl:template>', ITEMS + "SELECT o_orderkey AS doc_id, coalesce(string_agg(CASE WHEN l_quantity > 25 THEN 'B' WHEN l_quantity <= 25 THEN 's' END, '' ORDER BY rn), '') AS result FROM orders LEFT JOIN items ON o_orderkey = l_orderkey GROUP BY 1")
_templated("xsl_call_template", '<xsl:template name="r"><xsl:param name="k"/><xsl:if test="$k &gt; 0">*<xsl:call-template name="r"><xsl:with-param name="k" select="$k - 1"/></xsl:call-template></xsl:if></xsl:template><xsl:template match="/"><xsl:call-template name="r"><xsl:with-param name="k" select="count(//item)"/></xsl:call-template></xsl:template>', f"SELECT o_orderkey AS doc_id, repeat('*', {N_ITEMS}) AS result FROM orders")
_templated("xsl_key", '<xsl:key name="f" match="item" use="@flag"/><xsl:template match="/"><xsl:value-of select="count(key(\'f\', \'R\'))"/>/<xsl:value-of select="count(key(\'f\', //@flag))"/></xsl:template>', "SELECT o_orderkey AS doc_id, count(l_orderkey) FILTER (l_returnflag = 'R') || '/' || count(l_orderkey) AS result FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
_templated("xsl_mode_params", '<xsl:template match="/"><xsl:apply-templates select="//item[1]" mode="m"><xsl:with-param name="p" select="\'x\'"/></xsl:apply-templates></xsl:template><xsl:template match="item" mode="m"><xsl:param name="p"/><xsl:value-of select="concat($p, @part)"/></xsl:template>', ITEMS + "SELECT o_orderkey AS doc_id, coalesce('x' || l_partkey, '') AS result FROM orders LEFT JOIN items ON o_orderkey = l_orderkey AND rn = 1")
_templated("xsl_number", '<xsl:template match="/"><xsl:for-each select="//item"><xsl:number format="A"/></xsl:for-each></xsl:template>', f"SELECT o_orderkey AS doc_id, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 1, CAST({N_ITEMS} AS INTEGER)) AS result FROM orders")
_templated("xsl_variable_rtf", '<xsl:template match="/"><xsl:variable name="v"><a><xsl:value-of select="order/@id"/></a><b/></xsl:variable><xsl:value-of select="string-length($v)"/></xsl:template>', "SELECT o_orderkey AS doc_id, CAST(length(CAST(o_orderkey AS VARCHAR)) AS VARCHAR) AS result FROM orders")
_templated("xsl_exslt", '<xsl:template match="/" xmlns:set="http://exslt.org/sets" xmlns:math="http://exslt.org/math"><xsl:value-of select="count(set:distinct(//@flag))"/>/<xsl:value-of select="math:max(//qty)"/></xsl:template>', "SELECT o_orderkey AS doc_id, count(DISTINCT l_returnflag) || '/' || coalesce(CAST(CAST(max(l_quantity) AS BIGINT) AS VARCHAR), 'NaN') AS result FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")


TREE_SHEET = '<xsl:stylesheet version="1.0" xmlns:xsl="http://www.w3.org/1999/XSL/Transform" {0}><xsl:output omit-xml-declaration="yes"/>{1}</xsl:stylesheet>'
EX = "http://exslt.org/"


def _sheet(name: str, sheet: str, sql: str, source=None, **more) -> None:
    """A whole stylesheet over orders, or over the frame of (doc_id, xml) that source makes."""

    @query(name, sql)
    def _(spark, sf_dir):
        return xslt.transform(source(spark, sf_dir) if source else markup(spark, sf_dir, "orders"), "doc_id", "xml", sheet, **more).select("doc_id", "result")


_sheet(
    "xsl_copy_of", TREE_SHEET.format("", "<xsl:template match=\"/\"><r><xsl:copy-of select=\"/order/@id\"/><xsl:copy-of select=\"/order/total\"/><xsl:copy-of select=\"//item[@flag='R']\"/></r></xsl:template>"),
    ITEMS + """SELECT o_orderkey AS doc_id, '<r id="' || o_orderkey || '"><total>' || CAST(o_totalprice AS DECIMAL(18,2)) || '</total>' || coalesce(string_agg('<item line="' || l_linenumber || '" part="' || l_partkey || '" flag="R"><qty>' || CAST(l_quantity AS BIGINT) || '</qty><price>' || CAST(l_extendedprice AS DECIMAL(18,2)) || '</price></item>', '' ORDER BY rn), '') || '</r>' AS result
 FROM orders LEFT JOIN items ON o_orderkey = l_orderkey AND l_returnflag = 'R' GROUP BY o_orderkey, o_totalprice""",
)
_sheet(
    "xsl_strip_space", SHEET.format('<xsl:strip-space elements="*"/><xsl:preserve-space elements="order"/><xsl:template match="/"><xsl:value-of select="count(//text())"/></xsl:template>'),
    f"SELECT o_orderkey AS doc_id, CAST(3 * {N_ITEMS} + 3 AS VARCHAR) AS result FROM orders",
    lambda spark, sf_dir: markup(spark, sf_dir, "orders").select("doc_id", F.replace("xml", F.lit("><"), F.lit(">\n <")).alias("xml")),
)
_sheet(
    "xsl_namespace_alias", TREE_SHEET.format('xmlns:a="urn:a" xmlns:b="urn:b" exclude-result-prefixes="a"', '<xsl:namespace-alias stylesheet-prefix="a" result-prefix="b"/><xsl:template match="/"><xsl:apply-templates select="order"/></xsl:template><xsl:template match="order"><a:e a:n="{@id}"/></xsl:template>'),
    "SELECT o_orderkey AS doc_id, '<b:e xmlns:b=\"urn:b\" b:n=\"' || o_orderkey || '\"/>' AS result FROM orders",
)
_sheet(
    "xsl_include", SHEET.format('<xsl:include href="part"/><xsl:template match="/"><xsl:call-template name="t"/>/<xsl:value-of select="$v"/></xsl:template>'),
    "SELECT o_orderkey AS doc_id, o_orderstatus || '/' || o_orderkey AS result FROM orders",
    modules={"part": SHEET.format('<xsl:variable name="v" select="/order/@id"/><xsl:template name="t"><xsl:value-of select="order/@status"/></xsl:template>')},
)
for _how, _first, _second in (("upper-first", "n_name", "lower(n_name)"), ("lower-first", "lower(n_name)", "n_name")):
    _sheet(
        f"xsl_sort_{_how.replace('-', '_')}", SHEET.format(f'<xsl:template match="/"><xsl:for-each select="//a"><xsl:sort select="." lang="en" case-order="{_how}"/><xsl:value-of select="."/>,</xsl:for-each></xsl:template>'),
        f"SELECT n_nationkey AS doc_id, 'A,' || {_first} || ',' || {_second} || ',zz,' AS result FROM nation WHERE n_name <> 'A'",
        lambda spark, sf_dir: table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.concat(F.lit("<n><a>zz</a><a>"), F.lower("n_name"), F.lit("</a><a>"), "n_name", F.lit("</a><a>A</a></n>")).alias("xml")),
    )
_sheet(
    "xsl_pattern_key", SHEET.format('<xsl:key name="f" match="item" use="@flag"/><xsl:template match="key(\'f\', \'R\')">R</xsl:template><xsl:template match="item|total"/>'),
    "SELECT o_orderkey AS doc_id, repeat('R', CAST(count(l_orderkey) AS INTEGER)) AS result FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'R' GROUP BY 1",
)
_sheet(
    "xsl_pattern_id", SHEET.format('<xsl:template match="id(\'o1\')">!<xsl:value-of select="@n"/></xsl:template><xsl:template match="text()"/>'),
    "SELECT c_custkey AS doc_id, CASE WHEN o_orderkey IS NULL THEN '' ELSE '!1' END AS result FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderkey = 1",
    lambda spark, sf_dir: markup(spark, sf_dir, "customers"),
)
_templated("xsl_current", '<xsl:template match="/"><xsl:for-each select="//item"><xsl:value-of select="count(//item[@flag = current()/@flag])"/>,</xsl:for-each></xsl:template>', ITEMS + ", c AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_returnflag) AS same FROM items) SELECT o_orderkey AS doc_id, coalesce(string_agg(same || ',', '' ORDER BY rn), '') AS result FROM orders LEFT JOIN c ON o_orderkey = l_orderkey GROUP BY 1")
_sheet(
    "xsl_document", SHEET.format('<xsl:template match="/"><xsl:variable name="s" select="order/@status"/><xsl:value-of select="document(\'names.xml\')/names/x[@s = $s]"/>/<xsl:value-of select="count(document(\'none.xml\'))"/></xsl:template>'),
    "SELECT o_orderkey AS doc_id, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE '' END || '/0' AS result FROM orders",
    documents={"names.xml": "<names><x s='F'>final</x><x s='O'>open</x></names>"},
)
_templated("xsl_dynamic", f'<xsl:template match="/" xmlns:d="{EX}dynamic" xmlns:c="{EX}common"><xsl:value-of select="d:evaluate(\'count(//item)\')"/>/<xsl:value-of select="sum(d:map(//qty, \'. * 2\'))"/>/<xsl:value-of select="c:object-type(//item)"/>/<xsl:value-of select="c:object-type(1)"/></xsl:template>', "SELECT o_orderkey AS doc_id, count(l_orderkey) || '/' || CAST(coalesce(sum(l_quantity), 0) * 2 AS BIGINT) || '/node-set/number' AS result FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
DAY_SQL = "CAST(o_orderdate AS DATE)"
_templated(
    "xsl_dates", f'<xsl:template match="/" xmlns:d="{EX}dates-and-times"><xsl:variable name="t" select="string(order/@date)"/>' + " ".join(f'<xsl:value-of select="{e}"/><xsl:text>|</xsl:text>' for e in (
        "d:year($t)", "d:leap-year($t)", "d:month-name($t)", "d:month-abbreviation($t)", "d:week-in-year($t)", "d:day-in-year($t)", "d:day-of-week-in-month($t)", "d:day-in-week($t)", "d:day-name($t)",
        "d:format-date($t, 'dd.MM.yy EEE')", "d:add($t, 'P1M1D')", "d:difference('1992-01-01', $t)", "d:seconds($t)", "d:add-duration('P1Y', 'PT90M')", "d:hour-in-day($t)",
    )) + "</xsl:template>",
    f"""SELECT o_orderkey AS doc_id, year(d) || '|' || CASE WHEN year(d) % 4 = 0 AND (year(d) % 100 <> 0 OR year(d) % 400 = 0) THEN 'true' ELSE 'false' END || '|' || monthname(d) || '|' || left(monthname(d), 3) || '|' || weekofyear(d) || '|' || dayofyear(d) || '|' || ((day(d) - 1) // 7 + 1) || '|' || (dayofweek(d) + 1) || '|' || dayname(d)
 || '|' || strftime(d, '%d.%m.%y %a') || '|' || strftime(d + INTERVAL 1 MONTH + INTERVAL 1 DAY, '%Y-%m-%d') || '|' || CASE WHEN d = DATE '1992-01-01' THEN 'PT0S' ELSE 'P' || (d - DATE '1992-01-01') || 'D' END || '|' || CAST(epoch(d) AS BIGINT) || '|P1YT1H30M|NaN|' AS result FROM (SELECT o_orderkey, {DAY_SQL} AS d FROM orders)""",
)


@query("xsl_construct")
def _(spark, sf_dir):
    """Identity with constructors: element, attribute, copy, comment, PI, literal results."""
    sheet = '<xsl:stylesheet version="1.0" xmlns:xsl="http://www.w3.org/1999/XSL/Transform"><xsl:output omit-xml-declaration="yes"/><xsl:template match="@*|node()"><xsl:copy><xsl:apply-templates select="@*|node()"/></xsl:copy></xsl:template><xsl:template match="item"><xsl:element name="row-{@line}"><xsl:attribute name="p"><xsl:value-of select="@part"/></xsl:attribute><xsl:comment><xsl:value-of select="@flag"/></xsl:comment><lit q="{qty}"/></xsl:element></xsl:template></xsl:stylesheet>'
    return xslt.transform(markup(spark, sf_dir, "orders"), "doc_id", "xml", sheet).select("doc_id", "result")


# -- models ----------------------------------------------------------------------------------------------------

EXAMPLE = f'<order xmlns:eg="{extract.EG}" xmlns:m="{extract.MODEL}" m:resource="concat(\'order/\', @id)"><total m:rel="\'total\'"/><item eg:occurs="*" m:rel="local-name()" m:value="@part"><qty/><price/></item></order>'


@query("triples_examplotron", "SELECT 'order/' || o_orderkey AS resource, 'total' AS rel, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS value FROM orders UNION ALL SELECT 'order/' || l_orderkey, 'item', CAST(l_partkey AS VARCHAR) FROM lineitem")
def _(spark, sf_dir):
    rules, _ = extract.from_example(EXAMPLE)
    return extract.triples(corpus(spark, sf_dir, "orders"), rules).select("resource", "rel", "value")


@query("metadata_dict", ITEMS + "SELECT 'order/' || o_orderkey AS resource, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY rn), '') AS items FROM orders LEFT JOIN items ON o_orderkey = l_orderkey GROUP BY 1")
def _(spark, sf_dir):
    rules, _ = extract.from_example(EXAMPLE)
    found = extract.metadata_dict(extract.triples(corpus(spark, sf_dir, "orders"), rules))
    return found.select("resource", F.coalesce(F.array_join(F.element_at("metadata", "item"), ","), F.lit("")).alias("items"))


@query("validate_constraints", "SELECT o_orderkey AS doc_id, 'item' AS child, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(l_orderkey) <> 1")
def _(spark, sf_dir):
    """An example that allows one item only."""
    _, occurs = extract.from_example(EXAMPLE.replace('eg:occurs="*"', 'eg:occurs="1"'))
    return extract.violations(nodes(spark, sf_dir, "orders"), occurs).select("doc_id", "child", "n")


@query("triples_schematron", f"SELECT o_orderkey AS doc_id, 'no items' AS message FROM orders WHERE {N_ITEMS} = 0 UNION ALL SELECT l_orderkey, 'large quantity' FROM lineitem WHERE l_quantity > 40")
def _(spark, sf_dir):
    return extract.assertions(corpus(spark, sf_dir, "orders"), [("/order", "item", "no items"), ("//item", "qty <= 40", "large quantity")]).select("doc_id", "message")


@query("validate_dtd", f"SELECT o_orderkey AS doc_id, 'order' AS local FROM orders WHERE {N_ITEMS} > 3")
def _(spark, sf_dir):
    """Content models as regular expressions: at most three items."""
    return extract.content_models(nodes(spark, sf_dir, "orders"), {"order": "total (item ){0,3}", "item": "qty price "}).select("doc_id", "local")


@query("dispatcher", "SELECT 'big' AS handler, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'item', count(*) FROM lineitem WHERE l_returnflag <> 'R' UNION ALL SELECT 'other', (SELECT count(*) * 2 FROM orders) + (SELECT count(*) * 2 FROM lineitem)")
def _(spark, sf_dir):
    rules = [("other", F.lit(True), -1.0), ("item", F.col("local") == "item", 0.0), ("big", (F.col("local") == "item") & (F.element_at("attrs", "flag") == "R"), 0.5)]
    return extract.dispatch(nodes(spark, sf_dir, "orders").filter("kind = 'element'"), rules).groupBy("handler").agg(F.count("*").alias("n"))


@query("inspect", f"SELECT l_orderkey AS doc_id, CAST(l_partkey AS VARCHAR) AS shown FROM lineitem WHERE l_quantity > 48")
def _(spark, sf_dir):
    return extract.inspect(corpus(spark, sf_dir, "orders"), "/order/item", "qty > 48", "@part").select("doc_id", "shown")


@query("mixed_content", "SELECT conv_id AS doc_id, CAST(count(*) AS DOUBLE) AS value FROM conversations WHERE role = 'user' GROUP BY 1 UNION ALL SELECT conv_id, 0.0 FROM conversations GROUP BY 1 HAVING count(*) FILTER (role = 'user') = 0")
def _(spark, sf_dir):
    return corpus(spark, sf_dir, "talks").value("count(/conversation/turn[@role='user'])")


@query("trim_word_count", "SELECT conv_id AS doc_id, CAST(least(5, sum(len(regexp_extract_all(coalesce(text, ''), '\\S+')))) AS BIGINT) AS n FROM conversations GROUP BY 1")
def _(spark, sf_dir):
    """The first five words of a document, counted over its text nodes in order."""
    w = nodesets.Window.partitionBy("doc_id").orderBy("pre").rowsBetween(nodesets.Window.unboundedPreceding, -1)
    texts = nodes(spark, sf_dir, "talks").filter("kind = 'text'").withColumn("w", F.regexp_count("value", F.lit(r"\S+")))
    left = F.greatest(F.lit(5) - F.coalesce(F.sum("w").over(w), F.lit(0)), F.lit(0))
    return texts.select("doc_id", F.least("w", left).alias("take")).groupBy("doc_id").agg(F.sum("take").alias("n"))


# -- further operators -----------------------------------------------------------------------------------------

_part("ext_ends_with", lambda: legacy.ends_with(F.col("p_name"), F.lit("ring")), "ends_with(p_name, 'ring')")
_part("ext_escape_xml", lambda: legacy.escape_xml(F.concat(F.lit("<&>"), "p_name")), "'&lt;&amp;&gt;' || p_name")
_part("ext_if", lambda: legacy.choose(F.col("p_size") > 25, F.lit("big")), "CASE WHEN p_size > 25 THEN 'big' ELSE '' END")
_part("ext_range", lambda: F.size(legacy.number_range(F.lit(3).cast("long"), F.col("p_size").cast("long"))).cast("long"), "CAST(greatest(p_size - 3, 0) AS BIGINT)")
_part("ext_sha_hash", lambda: legacy.sha_hash(F.col("p_name")), "sha1(p_name)")
_part("ext_join", lambda: legacy.join(F.split("p_name", " "), "-"), "replace(p_name, ' ', '-')")
_part("ext_indent", lambda: legacy.indent(F.replace("p_name", F.lit(" "), F.lit("\n")), 1), "'  ' || replace(p_name, ' ', chr(10) || '  ')")
_part("ext_normalize_eol", lambda: legacy.normalize_eol(F.replace("p_name", F.lit(" "), F.lit("\r\n"))), "replace(p_name, ' ', chr(10))")
_part("ext_wrap", lambda: legacy.wrap(F.col("p_name"), 3), "replace(p_name, ' ', chr(10)) || chr(10)")
_part("ext_uuid", lambda: F.length(legacy.generate_uuid()).cast("long"), "CAST(36 AS BIGINT)")
_part("ext_radians", lambda: F.round(legacy.radians(F.col("p_size").cast("double")), 9), "round(radians(p_size), 9)")
_part("ext_factorial", lambda: legacy.factorial(F.col("p_size") % 10), "CAST(factorial(CAST(p_size % 10 AS INTEGER)) AS BIGINT)")
_part("inject_markup", lambda: legacy.inject(F.col("p_name"), "[aeiou]", "v"), "regexp_replace(p_name, '([aeiou])', '<v>\\1</v>', 'g')")
_part("string_template", lambda: legacy.template("$$ $name (${size}) $none", name=F.col("p_name"), size=F.col("p_size")), "'$ ' || p_name || ' (' || p_size || ') $none'")
_page("allow_list", lambda u: legacy.allowed(u, ("https://",)), "starts_with(url, 'https://')")
_templated("xsl_attribute_set", '<xsl:attribute-set name="s"><xsl:attribute name="q"><xsl:value-of select="//order/@id"/></xsl:attribute></xsl:attribute-set><xsl:template match="/"><xsl:variable name="t"><e xsl:use-attribute-sets="s"/></xsl:variable><xsl:value-of select="x:node-set($t)/e/@q" xmlns:x="http://exslt.org/common"/></xsl:template>', "SELECT o_orderkey AS doc_id, CAST(o_orderkey AS VARCHAR) AS result FROM orders")
_templated("xsl_function", '<f:function name="m:sq" xmlns:f="http://exslt.org/functions" xmlns:m="my"><xsl:param name="n"/><f:result select="$n * $n"/></f:function><xsl:template match="/" xmlns:m="my"><xsl:value-of select="m:sq(count(//item))"/></xsl:template>', f"SELECT o_orderkey AS doc_id, CAST({N_ITEMS} * {N_ITEMS} AS VARCHAR) AS result FROM orders")
_templated("xsl_decimal_format", '<xsl:decimal-format name="e" decimal-separator="," grouping-separator="."/><xsl:template match="/"><xsl:value-of select="format-number(count(//item) * 1000 + 0.5, \'#.##0,00\', \'e\')"/></xsl:template>', f"SELECT o_orderkey AS doc_id, CASE WHEN {N_ITEMS} = 0 THEN '0,50' ELSE {N_ITEMS} || '.000,50' END AS result FROM orders")
_templated("xsl_fallback", '<xsl:template match="/"><xsl:unknown><xsl:fallback>fb</xsl:fallback></xsl:unknown><xsl:if test="function-available(\'key\') and element-available(\'xsl:sort\')">!</xsl:if></xsl:template>', "SELECT o_orderkey AS doc_id, 'fb!' AS result FROM orders")


@query("xsl_message_terminate", "SELECT count(*) FILTER (o_orderstatus = 'F') AS stopped, count(*) FILTER (o_orderstatus <> 'F') AS done FROM orders")
def _(spark, sf_dir):
    sheet = SHEET.format('<xsl:template match="/"><xsl:if test="order/@status=\'F\'"><xsl:message terminate="yes">final</xsl:message></xsl:if>ok</xsl:template>')
    got = xslt.transform(markup(spark, sf_dir, "orders"), "doc_id", "xml", sheet)
    return got.agg(F.count("error").alias("stopped"), F.count("result").alias("done"))


@query("xsl_import_apply", "SELECT o_orderkey AS doc_id, '[' || o_orderkey || ']' AS result FROM orders")
def _(spark, sf_dir):
    base = SHEET.format('<xsl:template match="order"><xsl:value-of select="@id"/></xsl:template>')
    top = SHEET.replace('<xsl:output method="text"/>', "").format('<xsl:import href="base"/><xsl:template match="order">[<xsl:apply-imports/>]</xsl:template>')
    return xslt.transform(markup(spark, sf_dir, "orders"), "doc_id", "xml", top, modules={"base": base}).select("doc_id", "result")


@query("multi_output", "SELECT l_orderkey AS doc_id, 'part/' || l_partkey AS href, CAST(CAST(max_by(l_quantity, rn) AS BIGINT) AS VARCHAR) AS text FROM (SELECT *, " + RANKED + " AS rn FROM lineitem) GROUP BY 1, 2")
def _(spark, sf_dir):
    sheet = SHEET.format('<xsl:template match="/"><xsl:for-each select="//item"><x:document xmlns:x="http://exslt.org/common" href="part/{@part}" method="text"><xsl:value-of select="qty"/></x:document></xsl:for-each></xsl:template>')
    return xslt.transform_files(markup(spark, sf_dir, "orders"), "doc_id", "xml", sheet).filter("href <> ''").drop("error")


@query("bound_default", "SELECT o_orderkey AS doc_id, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS total, 'none' AS note FROM orders")
def _(spark, sf_dir):
    n = nodes(spark, sf_dir, "orders")
    top = _is("order")
    total, note = extract.bound(n, top, "total"), extract.bound(n, top, "note", "none")
    return total.select("doc_id", F.col("value").alias("total")).join(note.select("doc_id", F.col("value").alias("note")), "doc_id")


@query("common_container", "SELECT l_orderkey AS doc_id, CASE WHEN count(*) > 1 THEN '/order' ELSE '/order/item' END AS path FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    n = nodes(spark, sf_dir, "orders")
    return extract.common_container(n, n.filter(_is("qty"))).select("doc_id", "path")


@query("namespace_strip", "SELECT count(*) AS n FROM orders")
def _(spark, sf_dir):
    n = extract.strip_namespaces(nodes(spark, sf_dir, "customers"))
    return n.filter("kind = 'element' AND ns IS NULL AND local = 'order'").agg(F.count("*").alias("n"))


@query("namespace_replace", "SELECT count(*) AS n FROM orders")
def _(spark, sf_dir):
    n = extract.replace_namespace(nodes(spark, sf_dir, "customers", "ns"), "urn:sales", "urn:other")
    return n.filter("ns = 'urn:other'").agg(F.count("*").alias("n"))


@query("outer_merge", "SELECT coalesce(a, b) AS flag, a IS NOT NULL AS in_a, b IS NOT NULL AS in_b FROM (SELECT DISTINCT l_returnflag AS a FROM lineitem) FULL JOIN (SELECT DISTINCT o_orderstatus AS b FROM orders) ON a = b")
def _(spark, sf_dir):
    found = corpus(spark, sf_dir, "orders").found("/order/@status | //item/@flag", flag="string(.)", of="name()")
    found = settle(found.select("flag", "of").distinct())  # both sides from one pass over the documents
    return extract.outer_merge(found.filter("of = 'flag'"), found.filter("of = 'status'"), ["flag"])


@query("merge_by_date", "SELECT doc_id, date FROM (SELECT o_orderkey AS doc_id, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders) ORDER BY date DESC, doc_id LIMIT 20")
def _(spark, sf_dir):
    """The newest entries of two merged feeds (a top-k report)."""
    feeds = corpus(spark, sf_dir, "orders").found("/order[@status='F'] | /order[@status!='F']", date="@date")  # one pass over the documents
    return feeds.select("doc_id", "date").orderBy(F.desc("date"), "doc_id").limit(20)


@query("html_text_len", f"SELECT page_id AS doc_id, CAST(length(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)) > 0 AS BOOLEAN) AS has FROM pages")
def _(spark, sf_dir):
    n = pages(spark, sf_dir)
    return n.filter(_is("h1")).select("doc_id", (F.length("value") > 0).alias("has"))


@query("push_stream", "SELECT o_orderkey AS doc_id, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS total FROM orders")
def _(spark, sf_dir):
    """Structured Streaming from the table's files to matched elements."""
    from treeloom.plans.corpora import attr, element, money

    source = spark.readStream.schema(table(spark, sf_dir, "orders").schema).parquet(f"{sf_dir}/orders.parque[t]")
    docs = source.select(F.col("o_orderkey").alias("doc_id"), element("order", element("total", money(F.col("o_totalprice"))), attrs=(attr("id", F.col("o_orderkey")),)).alias("xml"))
    return available_now(patterns.pushtree(docs, "doc_id", "xml", "order/total")).select("doc_id", F.col("value").alias("total"))
