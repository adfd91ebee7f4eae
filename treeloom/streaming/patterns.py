"""Streaming matches: linear patterns as regular expressions over node paths, on batch or streaming frames.

Patterns are relative, absolute or ``//`` paths and unions, over child, descendant and attribute axes, without
predicates. A relative pattern matches at any depth. A match on an attribute yields its element.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.plans.xpath_ast import ANY_NODE, Bin, Path, XPathError, parse
from treeloom.plans.xpath_plan import Corpus
from treeloom.sources.shred import shred


def regex(pattern: str, prefixes: dict[str, str] | None = None) -> tuple[str, bool]:
    """(Java regular expression over ``path``, whether some branch is on attributes)."""
    c = Corpus.__new__(Corpus)
    c.ns = prefixes or {}

    def branch(e) -> tuple[str, bool]:
        if not isinstance(e, Path) or e.start not in (None, "/"):
            raise XPathError(f"not a streaming pattern: {pattern}")
        out, attribute, deep = "", False, e.start is None
        for s in e.steps:
            if s == ANY_NODE:
                deep = True
                continue
            if s.preds or s.axis not in ("child", "descendant", "attribute") or s.test.kind not in ("name", "any"):
                raise XPathError(f"not in a streaming pattern: {s}")
            deep = deep or s.axis == "descendant"
            name = r"[^/@]+" if s.test.kind == "any" else c.label_pattern(s.test)
            attribute = s.axis == "attribute"
            out += ("(?:/[^/]+)*/" if deep else "/") + ("@" if attribute else "") + name
            deep = False
        return f"^{out}$", attribute

    def every(e) -> list[tuple[str, bool]]:
        return [*every(e.left), *every(e.right)] if isinstance(e, Bin) and e.op == "|" else [branch(e)]

    parts = every(parse(pattern))
    return "|".join(p for p, _ in parts), any(a for _, a in parts)


def match(nodes: DataFrame, patterns: dict[str, str], prefixes: dict[str, str] | None = None) -> DataFrame:
    """Node rows with the labels of the patterns that they match; rows without any are left out. No state, no shuffle."""
    tests = [F.when(F.col("path").rlike(regex(p, prefixes)[0]) & F.col("kind").isin("element", "attribute"), F.lit(label)) for label, p in patterns.items()]
    found = nodes.withColumn("labels", F.array_compact(F.array(*tests))).filter(F.size("labels") > 0)
    own = F.when(F.col("kind") == "attribute", F.col("parent")).otherwise(F.col("pre"))
    return found.withColumn("element", own)


def pushtree(source: DataFrame, doc_id: str, markup: str, pattern: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    """Matches in a (streaming) frame of documents: shred, then filter by path."""
    return match(shred(source, doc_id, markup), {"match": pattern}, prefixes)


def send(source: DataFrame, doc_id: str, markup: str, local: str, target):
    """Writer that hands the elements of a name, batch by batch, to target(DataFrame, batch number)."""
    found = shred(source, doc_id, markup).filter((F.col("kind") == "element") & (F.col("local") == local))
    return found.writeStream.foreachBatch(target)


def events(nodes: DataFrame) -> DataFrame:
    """SAX-like rows in order: (doc_id, seq, event, name, value); elements give a start and an end."""
    e = F.struct
    start = F.when(F.col("kind") == "element", F.lit("startElement")).when(F.col("kind") == "root", F.lit("startDocument")).when(F.col("kind") == "text", F.lit("characters")).when(F.col("kind") == "comment", F.lit("comment")).otherwise(F.lit("processingInstruction"))
    rows = nodes.filter("kind <> 'attribute'").select(
        "doc_id", F.col("local").alias("name"), F.when(~F.col("kind").isin("element", "root"), F.col("value")).alias("value"),
        F.explode(F.when(F.col("kind").isin("element", "root"), F.array(e(F.col("pre").alias("at"), F.lit(0).alias("phase"), F.lit(0).alias("back"), start.alias("event")), e(F.col("last").alias("at"), F.lit(1).alias("phase"), (-F.col("pre")).alias("back"), F.when(F.col("kind") == "root", F.lit("endDocument")).otherwise(F.lit("endElement")).alias("event")))).otherwise(F.array(e(F.col("pre").alias("at"), F.lit(0).alias("phase"), F.lit(0).alias("back"), start.alias("event"))))).alias("v"),
    )
    return rows.select("doc_id", F.col("v.at").alias("at"), F.col("v.phase").alias("phase"), F.col("v.back").alias("back"), F.col("v.event").alias("event"), "name", "value")
