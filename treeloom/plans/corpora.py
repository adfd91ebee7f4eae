"""Markup made of the driver's tables, with Column expressions, and its node rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.plans.xpath_documents import Markup
from treeloom.sources.shred import shred

SALES = "urn:sales"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def escaped(c: Column) -> Column:
    c = F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.replace(c, F.lit('"'), F.lit("&quot;"))


def attr(name: str, c: Column, plain: bool = False) -> Column:
    """plain: numbers and dates, which have nothing to escape."""
    return F.concat(F.lit(f' {name}="'), c.cast("string") if plain else escaped(c), F.lit('"'))


def element(name: str, *content: Column, attrs: tuple[Column, ...] = ()) -> Column:
    return F.concat(F.lit(f"<{name}"), *attrs, F.lit(">"), *content, F.lit(f"</{name}>"))


def money(c: Column) -> Column:
    return c.cast("decimal(18,2)").cast("string")


ITEM_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")


#: Bytes of tables in a task. A task's rows are sorted and grouped in memory, where they take several times their files.
TASK_BYTES = 16 << 20


def tasks(spark: SparkSession, *tables: DataFrame) -> int:
    """As many tasks as the session asks for, and more where tables are large: tasks stay of one size, so none spills because the input grew."""
    size = sum(int(str(t._jdf.queryExecution().analyzed().stats().sizeInBytes())) for t in tables)
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


def dealt(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Rows hash-dealt by a key to n tasks: small shuffles are merged to a task, and parsing is the dear part."""
    return rows.repartition(n, key)


def _joined(group: str, rows: DataFrame, order: tuple[str, ...], written, n: int) -> DataFrame:
    """What written makes of each row of a group, in order. Rows are dealt first, as numbers, and written where they are joined, so text is never dealt twice."""
    rows = dealt(rows.select(group, *order), group, n)
    rows = rows.select(group, F.struct(*order, written({x: F.col(x) for x in order}).alias("x")).alias("r"))
    return rows.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list("r"))["x"], "").alias("xs"))


def order_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, xml: order(@id,@status,@date, total, item(@line,@part,@flag, qty, price)*)."""

    def item(r: dict[str, Column]) -> Column:
        return element(
            "item", element("qty", r["l_quantity"].cast("long").cast("string")), element("price", money(r["l_extendedprice"])),
            attrs=(attr("line", r["l_linenumber"], True), attr("part", r["l_partkey"], True), attr("flag", r["l_returnflag"])),
        )

    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    n = tasks(spark, lines, orders)
    items = _joined("l_orderkey", lines, ITEM_ORDER, item, n)
    orders = dealt(orders.select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice"), "o_orderkey", n)
    orders = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    xml = element("order", element("total", money(F.col("o_totalprice"))), F.coalesce("xs", F.lit("")), attrs=(attr("id", F.col("o_orderkey"), True), attr("status", F.col("o_orderstatus")), attr("date", day, True)))
    return orders.select(F.col("o_orderkey").alias("doc_id"), xml.alias("xml"))


def customer_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, xml: customer(@id,@segment, name, s:order(@xml:id,@n,@status, item(@line, qty)*)*, last(@refs))."""

    def item(r: dict[str, Column]) -> Column:
        return element("item", element("qty", r["l_quantity"].cast("long").cast("string")), attrs=(attr("line", r["l_linenumber"], True),))

    lines, orders, customers = (table(spark, sf_dir, x) for x in ("lineitem", "orders", "customer"))
    n = tasks(spark, lines, orders, customers)
    items = _joined("l_orderkey", lines, ITEM_ORDER, item, n)
    orders = dealt(orders.select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey", n)
    orders = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    o = element("s:order", F.coalesce("xs", F.lit("")), attrs=(attr("xml:id", F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))), attr("n", F.col("o_orderkey"), True), attr("status", F.col("o_orderstatus"))))
    orders = dealt(orders.select("o_custkey", "o_orderkey", o.alias("x")), "o_custkey", n)
    listed = F.array_sort(F.collect_list(F.struct("o_orderkey", "x")))
    per = orders.groupBy("o_custkey").agg(
        F.array_join(listed["x"], "").alias("xs"),
        F.concat(F.lit("o"), F.min("o_orderkey").cast("string"), F.lit(" o"), F.max("o_orderkey").cast("string")).alias("refs"),
    )
    c = dealt(customers.select("c_custkey", "c_name", "c_mktsegment"), "c_custkey", n).join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    xml = element(
        "customer", element("name", escaped(F.col("c_name"))), F.coalesce("xs", F.lit("")), element("last", attrs=(attr("refs", F.coalesce("refs", F.lit("none"))),)),
        attrs=(F.lit(f' xmlns:s="{SALES}"'), attr("id", F.col("c_custkey"), True), attr("segment", F.col("c_mktsegment")), F.lit(' xml:lang="en-GB"')),
    )
    return c.select(F.col("c_custkey").alias("doc_id"), xml.alias("xml"))


def talk_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, xml: conversation(turn(@n,@role):text*)."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "[^\\t\\n\\r\\x20-\\x{D7FF}\\x{E000}-\\x{FFFD}\\x{10000}-\\x{10FFFF}]", "")
    t = element("turn", F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), attrs=(attr("n", F.col("turn")), attr("role", F.col("role"))))
    turns = table(spark, sf_dir, "conversations")
    rows = dealt(turns.select("conv_id", "turn", "role", t.alias("x")), "conv_id", tasks(spark, turns))
    per = rows.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("turn", "role", "x")))["x"], "").alias("xs"))
    return per.select(F.col("conv_id").alias("doc_id"), element("conversation", F.col("xs")).alias("xml"))


def broken_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose markup is cut, has an unbound prefix or an attribute twice, by key modulo 5."""
    m = F.pmod("doc_id", F.lit(5))
    bad = (
        F.when(m == 1, F.expr("substring(xml, 1, length(xml) - 3)"))
        .when(m == 2, F.replace(F.replace("xml", F.lit("<total>"), F.lit("<p:total>")), F.lit("</total>"), F.lit("</p:total>")))
        .when(m == 3, F.replace("xml", F.lit("<order id="), F.lit('<order status="x" id=')))
        .otherwise(F.col("xml"))
    )
    return order_markup(spark, sf_dir).select("doc_id", bad.alias("xml"))


MARKUP = {"orders": order_markup, "customers": customer_markup, "talks": talk_markup}


def markup(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A corpus, dealt by document."""
    return MARKUP[name](spark, sf_dir)


def nodes(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Node rows of a corpus, made as they are read: kept or dealt whole they are many times the tables. What a plan drops of them never leaves its task. columns: doc_id and these of shred.OWN only."""
    return shred(markup(spark, sf_dir, name), "doc_id", "xml", columns=columns or None)


def corpus(spark: SparkSession, sf_dir: str, name: str, **variables) -> Markup:
    """A corpus whose paths are evaluated as its documents are parsed."""
    return Markup(markup(spark, sf_dir, name), "doc_id", "xml", {"s": SALES}, variables)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node rows of the pages table, parsed as tag soup."""
    return shred(table(spark, sf_dir, "pages").select("page_id", "html").repartition(spark.sparkContext.defaultParallelism), "page_id", "html", "html")
