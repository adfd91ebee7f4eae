"""Operators on node sets: DataFrames of node rows keyed by (doc_id, pre). Nothing here mixes documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["doc_id", "pre"]


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).dropDuplicates(KEY)


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*KEY), KEY, "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*KEY), KEY, "left_anti")


def has_same_node(a: DataFrame, b: DataFrame) -> DataFrame:
    """doc_id and whether both sets share a node, for documents with nodes in a."""
    shared = a.select(*KEY).join(b.select(*KEY), KEY, "left_semi").select("doc_id").distinct().withColumn("same", F.lit(True))
    return a.select("doc_id").distinct().join(shared, "doc_id", "left").select("doc_id", F.coalesce("same", F.lit(False)).alias("same"))


def distinct(a: DataFrame, value: str = "sv") -> DataFrame:
    """First node in document order of each string value."""
    w = Window.partitionBy("doc_id", value).orderBy("pre")
    return a.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def _cut(a: DataFrame, b: DataFrame, before: bool) -> DataFrame:
    # b's first node; where it isn't in a the result is empty, where b is empty all of a stays
    first = b.groupBy("doc_id").agg(F.min("pre").alias("_first"))
    inside = a.select("doc_id", F.col("pre").alias("_first")).join(first, ["doc_id", "_first"], "left_semi").select("doc_id", F.lit(True).alias("_in"))
    joined = a.join(first, "doc_id", "left").join(inside.distinct(), "doc_id", "left")
    side = F.col("pre") < F.col("_first") if before else F.col("pre") > F.col("_first")
    return joined.filter(F.col("_first").isNull() | (F.col("_in") & side)).drop("_first", "_in")


def leading(a: DataFrame, b: DataFrame) -> DataFrame:
    return _cut(a, b, True)


def trailing(a: DataFrame, b: DataFrame) -> DataFrame:
    return _cut(a, b, False)


def extreme(a: DataFrame, number: Column, highest: bool = True) -> DataFrame:
    """All nodes that attain the largest (smallest) number of their document; none if one is NaN."""
    w = Window.partitionBy("doc_id")
    best = F.max("_n").over(w) if highest else F.min("_n").over(w)
    nan = F.max(F.isnan("_n")).over(w)
    return a.withColumn("_n", number).withColumn("_best", best).withColumn("_nan", nan).filter((F.col("_n") == F.col("_best")) & ~F.col("_nan")).drop("_n", "_best", "_nan")


def keys(nodes: DataFrame, match: Column, use: Column, name: str = "key") -> DataFrame:
    """Key table (doc_id, key_name, key_value, pre): the nodes that match, by the value of ``use`` (string or array)."""
    rows = nodes.filter(match).select("doc_id", F.lit(name).alias("key_name"), use.alias("key_value"), "pre")
    if dict(rows.dtypes)["key_value"].startswith("array"):
        rows = rows.withColumn("key_value", F.explode("key_value"))
    return rows.distinct()


def by_key(nodes: DataFrame, table: DataFrame, probes: DataFrame, value: str) -> DataFrame:
    """Node rows whose key equals a probe's value in the same document."""
    hits = table.join(probes.select("doc_id", F.col(value).alias("key_value")).distinct(), ["doc_id", "key_value"], "left_semi").select(*KEY).distinct()
    return nodes.join(hits, KEY, "left_semi")


def group_by_key(table: DataFrame) -> DataFrame:
    """Muenchian grouping: each key value of a document with its nodes in order."""
    return table.groupBy("doc_id", "key_name", "key_value").agg(F.count("*").alias("n"), F.min("pre").alias("first"), F.sort_array(F.collect_list("pre")).alias("members"))


def sort_keys(value: Column, data_type: str = "text", descending: bool = False, case_order: str | None = None) -> list[Column]:
    """Order-by columns of one sort key: numbers put NaN first; case only decides among equals ignoring case."""
    if data_type == "number":
        none = F.isnan(value)
        plain = F.when(none, F.lit(None)).otherwise(value)
        return [plain.desc_nulls_last() if descending else plain.asc_nulls_first()]
    if case_order is None:
        return [value.desc() if descending else value.asc()]
    upper_first = (case_order == "upper-first") != descending
    second = value.asc() if upper_first else value.desc()
    return [F.lower(value).desc() if descending else F.lower(value).asc(), second]


def ranked(frame: DataFrame, columns: list[Column], name: str = "rank", within: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rank of each node in its document under sort keys, ties in document order."""
    return frame.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*columns, "pre")))


def first_k(frame: DataFrame, k: int, columns: list[Column] | None = None) -> DataFrame:
    return ranked(frame, columns or [F.col("pre").asc()], "_k").filter(F.col("_k") <= k).drop("_k")


def number_simple(nodes: DataFrame) -> DataFrame:
    """Position among siblings of the same kind and name."""
    w = Window.partitionBy("doc_id", "parent", "kind", "ns", "local").orderBy("sib")
    return nodes.filter("kind <> 'attribute'").withColumn("number", F.row_number().over(w))


def _above(nodes: DataFrame, frame: DataFrame, count: Column, start: Column | None) -> DataFrame:
    """Per node of frame its ancestors-or-self that count, below the nearest that matches start, with their number."""
    counted = number_counted(nodes, count).select(F.col("doc_id").alias("_d"), F.col("pre").alias("_p"), F.col("last").alias("_l"), F.col("level").alias("_lv"), "number")
    ctx = frame.select("doc_id", "pre")
    up = ctx.join(counted, (F.col("_d") == F.col("doc_id")) & (F.col("_p") <= F.col("pre")) & (F.col("_l") >= F.col("pre")))
    if start is not None:
        stop = nodes.filter(start).select(F.col("doc_id").alias("_d2"), F.col("pre").alias("_p2"), F.col("last").alias("_l2"))
        near = ctx.join(stop, (F.col("_d2") == F.col("doc_id")) & (F.col("_p2") < F.col("pre")) & (F.col("_l2") >= F.col("pre"))).groupBy("doc_id", "pre").agg(F.max("_p2").alias("_stop"))
        up = up.join(near, ["doc_id", "pre"], "left").filter(F.col("_stop").isNull() | (F.col("_p") > F.col("_stop")))
    return up


def number_counted(nodes: DataFrame, count: Column) -> DataFrame:
    """Nodes that count, numbered among their siblings that count."""
    w = Window.partitionBy("doc_id", "parent").orderBy("sib")
    return nodes.filter((F.col("kind") != "attribute") & count).withColumn("number", F.row_number().over(w))


def number_single(nodes: DataFrame, frame: DataFrame, count: Column, start: Column | None = None) -> DataFrame:
    """doc_id, pre, number of the nearest counting ancestor-or-self."""
    return _above(nodes, frame, count, start).groupBy("doc_id", "pre").agg(F.max_by("number", "_lv").alias("number"))


def number_multiple(nodes: DataFrame, frame: DataFrame, count: Column, start: Column | None = None) -> DataFrame:
    """doc_id, pre, numbers of all counting ancestors-or-self, outermost first."""
    got = _above(nodes, frame, count, start).groupBy("doc_id", "pre").agg(F.array_sort(F.collect_list(F.struct("_lv", "number"))).alias("_n"))
    return got.select("doc_id", "pre", F.transform("_n", lambda x: x["number"]).alias("numbers"))


def number_any(nodes: DataFrame, count: Column, start: Column | None = None) -> DataFrame:
    """Each node with the number of counting nodes up to it in its document, from the last that matches start."""
    w = Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    rows = nodes.filter("kind <> 'attribute'")
    if start is None:
        return rows.withColumn("number", F.sum(count.cast("int")).over(w))
    rows = rows.withColumn("_from", F.sum(start.cast("int")).over(w))
    return rows.withColumn("number", F.sum((count & ~start).cast("int")).over(Window.partitionBy("doc_id", "_from").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0))).drop("_from")


def abspath(nodes: DataFrame, frame: DataFrame) -> DataFrame:
    """doc_id, pre, abspath: the unique path with ordinals among same-named siblings."""
    name = F.when(F.col("prefix").isNotNull(), F.concat("prefix", F.lit(":"), "local")).otherwise(F.col("local"))
    named = {"text": "text()", "comment": "comment()"}
    step = F.when(F.col("kind") == "pi", F.concat(F.lit("processing-instruction('"), "local", F.lit("')")))
    for kind, text in named.items():
        step = step.when(F.col("kind") == kind, F.lit(text))
    own = number_simple(nodes).filter("kind <> 'root'").select(F.col("doc_id").alias("_d"), F.col("pre").alias("_p"), F.col("last").alias("_l"), F.concat(step.otherwise(name), F.lit("["), F.col("number").cast("string"), F.lit("]")).alias("_s"))
    up = frame.select("doc_id", "pre").join(own, (F.col("_d") == F.col("doc_id")) & (F.col("_p") <= F.col("pre")) & (F.col("_l") >= F.col("pre")))
    got = up.groupBy("doc_id", "pre").agg(F.array_sort(F.collect_list(F.struct("_p", "_s"))).alias("_a"))
    return got.select("doc_id", "pre", F.concat(F.lit("/"), F.array_join(F.transform("_a", lambda x: x["_s"]), "/")).alias("abspath"))


def closure(start: DataFrame, edges: DataFrame) -> DataFrame:
    """Kleene closure: keys (doc_id, pre) reachable from start by one or more edges (doc_id, pre, to).

    Edges stay in their document, so all that is reached is found in one pass over a document's edges, dealt once.
    """
    ends = start.select(*KEY, F.lit(None).cast("int").alias("to")).unionByName(edges.select("doc_id", "pre", F.col("to").cast("int").alias("to")))
    grouped = ends.groupBy("doc_id").agg(F.collect_list(F.when(F.col("to").isNull(), F.col("pre"))).alias("starts"), F.collect_list(F.when(F.col("to").isNotNull(), F.struct("pre", "to"))).alias("edges"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for r in batch.to_pylist():
                onward: dict[int, list[int]] = {}
                for e in r["edges"]:
                    onward.setdefault(e["pre"], []).append(e["to"])
                reached, todo = set(), list(r["starts"])
                while todo:
                    for to in onward.pop(todo.pop(), ()):  # followed once, so cycles end
                        if to not in reached:
                            reached.add(to)
                            todo.append(to)
                ids += [r["doc_id"]] * len(reached)
                found += reached
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int32())], names=KEY)

    return grouped.filter((F.size("starts") > 0) & (F.size("edges") > 0)).select(F.col("doc_id").cast("long"), "starts", "edges").mapInArrow(work, "doc_id long, pre int")


def same_trees(a: DataFrame, b: DataFrame, spaces: bool = False) -> DataFrame:
    """doc_ids whose node rows differ, whitespace-only texts aside unless spaces counts."""
    def normal(x: DataFrame) -> DataFrame:
        x = x if spaces else x.filter(~((F.col("kind") == "text") & F.trim("value").eqNullSafe(F.lit(""))))
        own = F.when(F.col("kind") == "element", F.lit(None)).otherwise(F.col("value"))
        order = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.when(F.col("kind") == "attribute", F.col("parent")).otherwise(F.col("pre")), F.col("kind") == "attribute", F.when(F.col("kind") == "attribute", F.concat(F.coalesce("ns", F.lit("")), F.lit("|"), "local"))))
        return x.select("doc_id", order.alias("n"), "level", "kind", "ns", "local", own.alias("value"))

    x, y = normal(a), normal(b)
    return x.exceptAll(y).unionByName(y.exceptAll(x)).select("doc_id").distinct()
