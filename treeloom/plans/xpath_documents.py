"""XPath 1.0 over a markup column, evaluated document by document while it is parsed.

A document's node rows are many times its markup, and a plan over rows (``xpath_plan``) deals and sorts them. Where a
corpus isn't shredded yet and a query is one path or value, each document is parsed once and only the result's rows
leave the task; nothing is kept or dealt. Results are those of ``xpath_plan.Corpus``.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.sources.shred import BATCH, parse_markup
from treeloom.sources.tree import Node, ParseError

from .xpath_ast import Var, XPathError, kind_of, parse
from .xpath_eval import Context, as_string, compiled, to_boolean, to_number, to_string

TYPES = {"number": ("double", pa.float64(), to_number), "boolean": ("boolean", pa.bool_(), to_boolean), "string": ("string", pa.string(), to_string)}


class Markup:
    """Documents as markup (doc_id, markup); tree makes a document's tree, and documents for which it raises one of skipped give nothing."""

    def __init__(self, df: DataFrame, doc_id: str, markup: str, prefixes: dict[str, str] | None = None, variables: dict | None = None, tree: Callable[[str | None], Node] = parse_markup, skipped: tuple[type[Exception], ...] = (ParseError,)) -> None:
        self.df, self.ns = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(markup).alias("markup")), prefixes or {}
        self.vars = {k: v if isinstance(v, bool | str) else float(v) for k, v in (variables or {}).items()}
        self.tree, self.skipped = tree, skipped

    def found(self, path: str, **exprs: str) -> DataFrame:
        """doc_id, pre, last of the nodes that a path gives, each once, with one column per expression, evaluated with each node as the context node."""
        if kind_of(parse(path)) != "nodes":
            raise XPathError(f"not a path: {path}")
        return self._run(path, exprs, ["pre", "last"])

    def value(self, expr: str, name: str = "value") -> DataFrame:
        """doc_id and the value of an expression at each document's root."""
        return self._run(None, {name: expr}, [])

    def _type(self, expr: str) -> tuple:
        e = parse(expr)
        kind = kind_of(e)
        if isinstance(e, Var):
            if e.name not in self.vars:
                raise XPathError(f"undefined variable ${e.name}")
            v = self.vars[e.name]
            kind = "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "number"
        if kind == "unknown" and getattr(e, "name", None) == "generate-id":
            kind = "string"
        if kind == "unknown":
            raise XPathError(f"no type is known for {expr}")
        return TYPES["string" if kind == "nodes" else kind]

    def _run(self, path: str | None, exprs: dict[str, str], place: list[str]) -> DataFrame:
        kinds = [self._type(e) for e in exprs.values()]
        schema = pa.schema([("doc_id", pa.int64()), *[(x, pa.int32()) for x in place], *[(x, k[1]) for x, k in zip(exprs, kinds, strict=True)]])
        ddl = ", ".join(["doc_id long", *[f"{x} int" for x in place], *[f"`{x}` {k[0]}" for x, k in zip(exprs, kinds, strict=True)]])
        texts, casts, ns, variables, tree, skipped = list(exprs.values()), [k[2] for k in kinds], self.ns, self.vars, self.tree, self.skipped

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chosen = compiled(parse(path)) if path is not None else None
            made = [as_string(e) if cast is to_string else (lambda ctx, f=compiled(e), cast=cast: cast(f(ctx))) for e, cast in zip(map(parse, texts), casts, strict=True)]
            gc.freeze()  # what was imported is looked at no more; a tree's nodes go in one round
            held: list[list] = [[] for _ in schema]
            columns = [c.append for c in held]
            now = [0]
            functions = {"generate-id": lambda ctx, *a: "" if a and not a[0] else f"r{now[0]}n{(a[0][0] if a else ctx.node).pre}"}

            def batch_of() -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, schema.types, strict=True)], schema=schema)
                for c in held:
                    c.clear()
                return out

            for batch in batches:
                for now[0], text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    try:
                        root = tree(text)
                    except skipped:
                        continue
                    ctx = Context(root, vars=variables, ns=ns, functions=functions)
                    if not place:
                        columns[0](now[0])
                        for add, f in zip(columns[1:], made, strict=True):
                            add(f(ctx))
                    else:
                        for n in chosen(ctx):
                            ctx.node = n
                            for add, v in zip(columns, (now[0], n.pre, n.last, *[f(ctx) for f in made]), strict=True):
                                add(v)
                    if len(held[0]) >= BATCH:
                        yield batch_of()
            if held[0]:
                yield batch_of()

        return self.df.mapInArrow(work, ddl)
