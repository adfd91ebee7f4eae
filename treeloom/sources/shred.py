"""Markup columns to node rows, and back.

``nodes`` has one row per node, numbered in document order: ``pre`` and ``last`` (pre of the last descendant)
turn every axis into an equality on doc_id with conditions on numbers. ``value`` is the XPath string value of
attributes, texts, comments and of elements without child elements; string values of other elements are slices
[t0, t1) of the document's text in ``docs``, so no text is copied once per ancestor.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import attrgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tree import Node, ParseError, parse_html, parse_xml

NODES = pa.schema(
    [("doc_id", pa.int64())]
    + [(x, pa.int32()) for x in ("pre", "last", "level", "parent", "sib")]
    + [(x, pa.string()) for x in ("kind", "ns", "local", "prefix", "value", "path")]
    + [("t0", pa.int32()), ("t1", pa.int32()), ("attrs", pa.map_(pa.string(), pa.string())), ("nsdecl", pa.map_(pa.string(), pa.string())), ("id", pa.string())]
)
NODES_DDL = "doc_id long, pre int, last int, level int, parent int, sib int, kind string, ns string, local string, prefix string, value string, path string, t0 int, t1 int, attrs map<string,string>, nsdecl map<string,string>, id string"
DOCS_DDL = "doc_id long, text string, error struct<code:int,line:int,column:int,message:string>"
BATCH = 20_000


def label(n: Node) -> str:
    """Clark name for paths, with the separators of paths escaped in the URI."""
    if not n.ns:
        return n.local or ""
    uri = n.ns.replace("%", "%25").replace("/", "%2F").replace("{", "%7B").replace("}", "%7D")
    return f"{{{uri}}}{n.local}"


def rows(doc_id: int, root: Node, out: list[list]) -> None:
    """Append a value per node to each column of NODES, attributes included, in document order."""
    start = len(out[0])
    ids, pre, last, levels, parents, sibs, kinds, nss, locals_, prefixes, values, paths, t0, t1, maps, decls, own = out
    sums: list[int] = []  # length of all text up to each node
    at = 0
    todo: list[tuple[Node, int, int, int, str]] = [(root, 0, -1, 0, "")]
    while todo:
        n, level, parent, sib, path = todo.pop()
        kind, value, id_, attrs = n.kind, n.value, None, None
        kids = n.children
        if kind == "text":
            at += len(value)
        elif kind == "element":
            path = f"{path}/{label(n) if n.ns else n.local}"
            attrs = [(label(x), x.value) for x in n.attrs]
            id_ = next((x.value for x in n.attrs if x.is_id), None)
            if not any(c.kind == "element" for c in kids):  # values of others are slices of the document's text
                value = n.text()
        sums.append(at)
        pre.append(n.pre)
        last.append(n.last)
        levels.append(level)
        parents.append(parent)
        sibs.append(sib)
        kinds.append(kind)
        nss.append(n.ns)
        locals_.append(n.local)
        prefixes.append(n.prefix)
        values.append(value)
        paths.append(path or "/")
        maps.append(attrs)
        decls.append(list(n.nsdecl.items()) if n.nsdecl else None)
        own.append(id_)
        for k, x in enumerate(n.attrs):
            sums.append(at)
            pre.append(x.pre)
            last.append(x.pre)
            levels.append(level + 1)
            parents.append(n.pre)
            sibs.append(k)
            kinds.append("attribute")
            nss.append(x.ns)
            locals_.append(x.local)
            prefixes.append(x.prefix)
            values.append(x.value)
            paths.append(f"{path}/@{attrs[k][0]}")
            maps.append(None)
            decls.append(None)
            own.append(None)
        if kids:
            todo.extend([(c, level + 1, n.pre, k, path) for k, c in enumerate(kids)][::-1])
    n = len(sums)
    ids.extend([doc_id] * n)
    t0.append(0)
    t0.extend(sums[:-1])
    t1.extend(map(sums.__getitem__, last[start:]))  # nodes are numbered in this order, from 0


def parse_markup(markup: str | None, kind: str = "xml") -> Node:
    if kind == "html":
        return parse_html(markup or "")
    if not markup:
        raise ParseError(3, 1, 0, "no element found")
    return parse_xml(markup)


#: Columns that are a node's own; rows of these alone are made at a fraction of the work.
OWN = ("pre", "last", "kind", "ns", "local", "prefix")


def own_rows(root: Node, held: list[list], columns: tuple[str, ...]) -> None:
    """Append the named columns of OWN, as rows() has them."""
    found: list[Node] = []
    for n in root.walk():
        found.append(n)
        if n.made != ():
            found += n.attrs
    for out, name in zip(held, columns, strict=True):
        out.extend(map(attrgetter(name), found))


def shred(df: DataFrame, doc_id: str, markup: str, kind: str = "xml", on_error: str = "skip", columns: tuple[str, ...] | None = None) -> DataFrame:
    """Node rows of every document; on_error "skip" leaves documents out that don't parse, "raise" stops. columns: doc_id and these of OWN only."""
    skipped = () if on_error == "raise" else (ParseError,)

    def brief(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([NODES.field("doc_id"), *map(NODES.field, columns)])
        held: list[list] = [[] for _ in schema]

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, schema.types, strict=True)], schema=schema)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    own_rows(parse_markup(text, kind), held[1:], columns)
                except skipped:
                    continue
                held[0].extend([i] * (len(held[1]) - len(held[0])))
                if len(held[0]) >= BATCH:
                    whole = batch_of()
                    held = [[] for _ in schema]
                    yield from (whole.slice(at, BATCH) for at in range(0, len(whole), BATCH))
        if held[0]:
            yield batch_of()

    if columns:
        types = dict(x.split(" ") for x in NODES_DDL.split(", "))
        return df.select(F.col(doc_id).cast("long"), F.col(markup)).mapInArrow(brief, ", ".join(f"{x} {types[x]}" for x in ("doc_id", *columns)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return shred_batches(batches, lambda text: parse_markup(text, kind), skipped)

    return df.select(F.col(doc_id).cast("long"), F.col(markup)).mapInArrow(work, NODES_DDL)


def shred_batches(batches: Iterator[pa.RecordBatch], tree, skipped: tuple[type[Exception], ...]) -> Iterator[pa.RecordBatch]:
    """Node rows of the trees that ``tree`` makes of (id, text) batches, in batches of bounded length."""
    held: list[list] = [[] for _ in NODES]
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            try:
                rows(i, tree(text.as_py()), held)
            except skipped:
                continue
            if len(held[0]) >= BATCH:
                yield from _batches(held)
                held = [[] for _ in NODES]
    if held[0]:
        yield from _batches(held)


def _batches(held: list[list]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, NODES.types, strict=True)], schema=NODES)
    for at in range(0, len(whole), BATCH):
        yield whole.slice(at, BATCH)


DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("error", pa.struct([("code", pa.int32()), ("line", pa.int32()), ("column", pa.int32()), ("message", pa.string())]))])


def documents(df: DataFrame, doc_id: str, markup: str, kind: str = "xml") -> DataFrame:
    """doc_id, the document's text, and the error of a document that doesn't parse (else null)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    out.append((i, parse_markup(text.as_py(), kind).text(), None))
                except ParseError as e:
                    out.append((i, None, {"code": e.code, "line": e.line, "column": e.column, "message": e.message}))
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, DOCS.types, strict=True)], schema=DOCS)

    return df.select(F.col(doc_id).cast("long"), F.col(markup)).mapInArrow(work, DOCS_DDL)


def is_xml(text: Column) -> Column:
    """Does text look like markup?"""
    return F.coalesce(text.rlike(r"^(?:﻿)?\s*<(?:[?!A-Za-z_])"), F.lit(False))
