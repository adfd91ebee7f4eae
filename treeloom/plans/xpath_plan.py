"""XPath 1.0 as DataFrame plans over node rows (see ``sources.shred``).

Axes are joins on doc_id plus conditions on numbers, so a query over a corpus never mixes documents.
Paths from the root without predicates become one regular expression over ``path``. Existence and
comparisons of a path with a constant become left semi joins. Attributes of the context node are read from
its ``attrs`` map without a join. Positions are window functions over (document, context node).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .xpath_ast import REVERSE, Bin, Filter, Fn, Neg, Num, Path, Step, Str, Var, XPathError, parse, positional

NODE = ["doc_id", "pre", "last", "level", "parent", "sib", "kind", "ns", "local", "prefix", "value", "path", "t0", "t1", "attrs", "nsdecl", "id"]
NODESET = "array<struct<pre:int,sv:string,qname:string,local:string,ns:string>>"
NUMBER = r"^\s*-?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)\s*$"
COMPARE = ("=", "!=", "<", "<=", ">", ">=")
FLIP = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


@dataclass
class Typed:
    kind: str  # number, string, boolean, nodes
    col: Column


def to_num(c: Column) -> Column:
    """number() of a string."""
    return F.when(c.rlike(NUMBER), c.cast("double")).otherwise(F.lit(float("nan")))


def from_num(c: Column) -> Column:
    """string() of a number."""
    whole = (c == F.floor(c).cast("double")) & (F.abs(c) < 1e15)
    plain = F.regexp_replace(F.format_string("%.12f", c), r"\.?0+$", "")
    return (
        F.when(F.isnan(c), F.lit("NaN"))
        .when(c == float("inf"), F.lit("Infinity"))
        .when(c == float("-inf"), F.lit("-Infinity"))
        .when(whole, c.cast("long").cast("string"))
        .otherwise(plain)
    )


def qname() -> Column:
    return F.when(F.col("prefix").isNotNull(), F.concat("prefix", F.lit(":"), "local")).otherwise(F.coalesce("local", F.lit("")))


def divide(a: Column, b: Column) -> Column:
    """IEEE division; Spark's own raises or gives null for a zero divisor."""
    none = F.lit(float("nan"))
    return F.when(b == 0, F.when(F.isnan(a) | (a == 0), none).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def modulo(a: Column, b: Column) -> Column:
    bad = (b == 0) | F.isnan(a) | F.isnan(b) | (F.abs(a) == float("inf"))
    return F.when(bad, F.lit(float("nan"))).otherwise(a % F.when(b == 0, F.lit(1.0)).otherwise(b))


def rounded(c: Column, how: str) -> Column:
    f = {"floor": F.floor, "ceiling": F.ceil, "round": lambda x: F.floor(x + 0.5)}[how]
    odd = F.isnan(c) | (F.abs(c) >= 2.0**52)
    return F.when(odd, c).otherwise(f(F.when(odd, F.lit(0.0)).otherwise(c)).cast("double"))


def scalar_compare(op: str, a: Column, b: Column) -> Column:
    """Numbers; NaN is unequal to everything and neither less nor more."""
    nan = F.isnan(a) | F.isnan(b)
    plain = {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    return F.when(nan, F.lit(op == "!=")).otherwise(plain)


def xpath_substring(s: Column, start: Column, length: Column | None = None) -> Column:
    """Positions p with p >= round(start) and p < round(start) + round(length)."""
    a = rounded(start, "round")
    end = F.lit(float("inf")) if length is None else a + rounded(length, "round")
    lo = F.greatest(a, F.lit(1.0))
    hi = F.least(end, F.length(s) + F.lit(1.0))
    empty = F.isnan(a) | F.isnan(end) | (hi <= lo)
    at, n = F.when(empty, F.lit(1)).otherwise(F.least(lo, F.lit(2e9)).cast("int")), F.when(empty, F.lit(0)).otherwise((hi - lo).cast("int"))
    return F.substring(s, at, n)


class Corpus:
    """Node rows of many documents, and their texts for string values of elements with child elements."""

    def __init__(self, nodes: DataFrame, docs: DataFrame | None = None, prefixes: dict[str, str] | None = None, variables: dict | None = None) -> None:
        self.nodes, self.docs, self.ns, self.vars = nodes.select(*NODE), docs, prefixes or {}, variables or {}
        self.functions: dict[str, object] = {}

    # -- paths

    def roots(self) -> DataFrame:
        return self.nodes.filter(F.col("kind") == "root")

    def select(self, expr: str) -> DataFrame:
        """The node rows that a path gives, each once."""
        return self.run(parse(expr), self.roots(), []).select(*NODE)

    def value(self, expr: str, name: str = "value") -> DataFrame:
        """doc_id and the value of an expression at each document's root."""
        frame, v = self.compile(parse(expr), self.roots())
        return frame.select("doc_id", (self.string(v) if v.kind == "nodes" else v.col).alias(name))

    def at(self, frame: DataFrame, **exprs: str) -> DataFrame:
        """frame of node rows with one column per expression, evaluated with each row as the context node."""
        out = []
        for name, e in exprs.items():
            frame, v = self.compile(parse(e), frame)
            out.append((name, self.string(v) if v.kind == "nodes" else v.col))
            frame = frame.withColumn(name, out[-1][1])
        return frame

    def found(self, path: str, **exprs: str) -> DataFrame:
        """The node rows that a path gives, with one column per expression."""
        return self.at(self.select(path), **exprs)

    def run(self, e, frame: DataFrame, carry: list[str]) -> DataFrame:
        """Node rows (with the carried columns of the frame's rows) that path e gives from the frame's nodes."""
        if isinstance(e, Bin) and e.op == "|":
            both = self.run(e.left, frame, carry).unionByName(self.run(e.right, frame, carry))
            return both.dropDuplicates(["doc_id", "pre", *carry])
        if isinstance(e, Filter):
            found = self.run(e.primary, frame, carry)
            for p in e.preds:
                found = self.keep(found, p, ["doc_id", *carry], False)
            return found
        if isinstance(e, Fn) and e.name == "id":
            return self.by_id(e, frame, carry)
        if isinstance(e, Var) and isinstance(self.vars.get(e.name), DataFrame):
            return self.vars[e.name].select(*NODE).join(frame.select("doc_id", *carry), "doc_id")
        if not isinstance(e, Path):
            raise XPathError(f"not a path: {e!r}")
        steps = list(e.steps)
        if e.start == "/":
            lead = self.linear(steps)
            if lead:
                pattern, n = lead
                hit = self.nodes.filter(F.col("path").rlike(pattern) & F.col("kind").isin("element", "attribute"))
                at = hit if not carry else frame.select("doc_id", *carry).join(hit, "doc_id")
                if not carry:
                    at = at.join(frame.select("doc_id"), "doc_id", "left_semi")
                steps = steps[n:]
            else:
                at = frame.select("doc_id", *carry).join(self.roots(), "doc_id")
        elif e.start is None:
            at = frame.select(*NODE, *carry)
        else:
            at = self.run(e.start, frame, carry)
        for s in steps:
            at = self.step(at, s, carry)
        return at.select(*NODE, *carry)

    def linear(self, steps: list[Step]) -> tuple[str, int] | None:
        """Regular expression over ``path`` for the leading steps that are plain names, and how many they are."""
        out, n = "", 0
        for s in steps:
            if s.preds or s.axis not in ("child", "descendant", "attribute") or s.test.kind not in ("name", "any"):
                break
            if s.test.kind == "any":
                name = r"[^/@]+"
            else:
                name = self.label_pattern(s.test)
            out += ("(?:/[^/]+)*/" if s.axis == "descendant" else "/") + ("@" if s.axis == "attribute" else "") + name
            n += 1
            if s.axis == "attribute":
                break
        return (f"^{out}$", n) if n else None

    def uri(self, prefix: str) -> str:
        if prefix not in self.ns and prefix != "xml":
            raise XPathError(f"undeclared prefix {prefix}")
        return self.ns.get(prefix, "http://www.w3.org/XML/1998/namespace")

    def label_pattern(self, test) -> str:
        if test.prefix is None:
            return re.escape(test.local).replace("/", "\\/")
        uri = self.uri(test.prefix).replace("%", "%25").replace("/", "%2F").replace("{", "%7B").replace("}", "%7D")
        return re.escape(f"{{{uri}}}") + (re.escape(test.local) if test.local else r"[^/@]+")

    def passes(self, axis: str, test, alias: str = "") -> Column:
        c = lambda x: F.col(f"{alias}{x}")
        if test.kind == "node":
            return F.lit(True)
        if test.kind in ("text", "comment"):
            return c("kind") == test.kind
        if test.kind == "pi":
            return (c("kind") == "pi") & (c("local") == test.local if test.local is not None else F.lit(True))
        main = c("kind") == ("attribute" if axis == "attribute" else "element")
        if test.kind == "any":
            return main
        ns = c("ns").isNull() if test.prefix is None else c("ns") == self.uri(test.prefix)
        return main & ns & (c("local") == test.local if test.local is not None else F.lit(True))

    def step(self, at: DataFrame, s: Step, carry: list[str], keep_context: bool = False) -> DataFrame:
        if s.axis == "namespace":
            return self.namespaces(at, s, carry)
        if s.axis == "self":
            found = at.filter(self.passes("self", s.test)).withColumn("_c", F.col("pre"))
        else:
            c = at.select("doc_id", F.col("pre").alias("_c"), F.col("last").alias("_last"), F.col("parent").alias("_parent"), F.col("sib").alias("_sib"), F.col("kind").alias("_kind"), *carry)
            n = self.nodes
            on = {
                "child": (F.col("parent") == F.col("_c")) & (F.col("kind") != "attribute"),
                "attribute": (F.col("parent") == F.col("_c")) & (F.col("kind") == "attribute"),
                "parent": F.col("pre") == F.col("_parent"),
                "descendant": (F.col("pre") > F.col("_c")) & (F.col("pre") <= F.col("_last")) & (F.col("kind") != "attribute"),
                "descendant-or-self": ((F.col("pre") > F.col("_c")) & (F.col("pre") <= F.col("_last")) & (F.col("kind") != "attribute")) | (F.col("pre") == F.col("_c")),
                "ancestor": (F.col("pre") < F.col("_c")) & (F.col("last") >= F.col("_c")) & (F.col("kind") != "attribute"),
                "ancestor-or-self": ((F.col("pre") < F.col("_c")) & (F.col("last") >= F.col("_c")) & (F.col("kind") != "attribute")) | (F.col("pre") == F.col("_c")),
                "following": (F.col("pre") > F.col("_last")) & (F.col("kind") != "attribute"),
                "preceding": (F.col("last") < F.col("_c")) & (F.col("kind") != "attribute"),
                "following-sibling": (F.col("parent") == F.col("_parent")) & (F.col("sib") > F.col("_sib")) & (F.col("kind") != "attribute") & (F.col("_kind") != "attribute"),
                "preceding-sibling": (F.col("parent") == F.col("_parent")) & (F.col("sib") < F.col("_sib")) & (F.col("kind") != "attribute") & (F.col("_kind") != "attribute"),
            }[s.axis]
            n = n.filter(self.passes(s.axis, s.test))
            joined = c.withColumnRenamed("doc_id", "_doc").join(n, (F.col("_doc") == F.col("doc_id")) & on)
            found = joined.select(*NODE, "_c", *carry)
        for p in s.preds:
            found = self.keep(found, p, ["doc_id", "_c", *carry], s.axis in REVERSE)
        if keep_context:
            return found
        found = found.drop("_c")
        one_each = s.axis in ("self", "child", "attribute")
        return found if one_each else found.dropDuplicates(["doc_id", "pre", *carry])

    def namespaces(self, at: DataFrame, s: Step, carry: list[str]) -> DataFrame:
        """Namespace nodes: the declarations in scope, nearest first; their pre is the element's."""
        up = at.filter(F.col("kind") == "element").select("doc_id", F.col("pre").alias("_c"), *carry)
        decl = self.nodes.filter(F.col("nsdecl").isNotNull()).select(F.col("doc_id").alias("_d"), F.col("pre").alias("_p"), F.col("last").alias("_l"), F.explode("nsdecl").alias("_prefix", "_uri"))
        near = up.join(decl, (F.col("_d") == F.col("doc_id")) & (F.col("_p") <= F.col("_c")) & (F.col("_l") >= F.col("_c")))
        near = near.groupBy("doc_id", "_c", "_prefix", *carry).agg(F.max_by("_uri", "_p").alias("_uri")).filter(F.col("_uri") != "")
        fixed = up.select("doc_id", "_c", F.lit("xml").alias("_prefix"), *carry, F.lit("http://www.w3.org/XML/1998/namespace").alias("_uri"))
        every = near.unionByName(fixed)
        if s.test.kind == "name":
            every = every.filter(F.col("_prefix") == (s.test.local or ""))
        blank = {c: F.lit(None).cast(t) for c, t in self.nodes.dtypes if c not in ("doc_id",)}
        cols = blank | {"pre": F.col("_c"), "last": F.col("_c"), "parent": F.col("_c"), "kind": F.lit("namespace"), "local": F.col("_prefix"), "value": F.col("_uri")}
        return every.select("doc_id", *[cols[c].alias(c) for c in NODE[1:]], *carry)

    def by_id(self, e: Fn, frame: DataFrame, carry: list[str]) -> DataFrame:
        arg = e.args[0]
        if isinstance(arg, Path):
            words = self.with_sv(self.run(arg, frame, carry)).select("doc_id", F.explode(F.split(F.trim(F.col("sv")), r"\s+")).alias("_id"), *carry)
        else:
            frame, v = self.compile(arg, frame)
            words = frame.select("doc_id", F.explode(F.split(F.trim(self.string(v)), r"\s+")).alias("_id"), *carry)
        return words.distinct().join(self.nodes.filter(F.col("id").isNotNull()), ["doc_id"]).filter(F.col("id") == F.col("_id")).select(*NODE, *carry).dropDuplicates(["doc_id", "pre", *carry])

    # -- predicates

    def keep(self, found: DataFrame, p, context: list[str], reverse: bool) -> DataFrame:
        if isinstance(p, Bin) and p.op == "and" and not positional(p.left) and not positional(p.right):
            return self.keep(self.keep(found, p.left, context, reverse), p.right, context, reverse)
        semi = None if positional(p) else self.exists_plan(p, found)
        if semi is not None:
            return found.join(semi, ["doc_id", "pre"], "left_semi")
        w = Window.partitionBy(*context)
        ordered = w.orderBy(F.col("pre").desc() if reverse else F.col("pre"))
        if isinstance(p, Num):
            return found.withColumn("_pos", F.row_number().over(ordered)).filter(F.col("_pos") == F.lit(p.value)).drop("_pos")
        cols = found.columns
        if positional(p):
            found = found.withColumn("_pos", F.row_number().over(ordered).cast("double")).withColumn("_size", F.count(F.lit(1)).over(w).cast("double"))
        frame, v = self.compile(p, found)
        test = v.col == F.col("_pos") if v.kind == "number" else self.boolean(v)
        return frame.filter(test).select(*cols)

    def exists_plan(self, p, found: DataFrame) -> DataFrame | None:
        """(doc_id, pre) of the nodes for which a path has a node, or one that compares with a constant."""
        op, path, other = None, p, None
        if isinstance(p, Bin) and p.op in COMPARE:
            if isinstance(p.left, Path) and isinstance(p.right, Num | Str):
                op, path, other = p.op, p.left, p.right
            elif isinstance(p.right, Path) and isinstance(p.left, Num | Str):
                op, path, other = FLIP[p.op], p.right, p.left
        if not isinstance(path, Path) or path.start is not None or self.own_attribute(path) or self.itself(path):
            return None
        ctx = found.select(*NODE).dropDuplicates(["doc_id", "pre"]).withColumn("_o", F.col("pre"))
        hits = self.run(path, ctx, ["_o"])
        if op:
            hits = self.with_sv(hits)
            if isinstance(other, Num) or op not in ("=", "!="):
                right = F.lit(other.value) if isinstance(other, Num) else to_num(F.lit(other.value))
                hits = hits.filter(scalar_compare(op, to_num(F.col("sv")), right))
            else:
                hits = hits.filter((F.col("sv") == other.value) if op == "=" else (F.col("sv") != other.value))
        return hits.select("doc_id", F.col("_o").alias("pre")).distinct()

    # -- expressions

    def with_sv(self, frame: DataFrame) -> DataFrame:
        """frame with the string value of each node as sv."""
        if self.docs is None:
            return frame.withColumn("sv", F.coalesce("value", F.lit("")))
        text = self.docs.select(F.col("doc_id").alias("_d"), F.col("text").alias("_text"))
        joined = frame.join(text, (F.col("_d") == F.col("doc_id")) & F.col("value").isNull(), "left")
        return joined.withColumn("sv", F.coalesce("value", F.substring("_text", F.col("t0") + 1, F.col("t1") - F.col("t0")), F.lit(""))).drop("_d", "_text")

    def own_attribute(self, e) -> str | None:
        """Label of the attribute that a path @name of the context node asks for."""
        if isinstance(e, Path) and e.start is None and len(e.steps) == 1:
            s = e.steps[0]
            if s.axis == "attribute" and s.test.kind == "name" and s.test.local and not s.preds:
                if s.test.prefix is None:
                    return s.test.local
                uri = self.uri(s.test.prefix).replace("%", "%25").replace("/", "%2F").replace("{", "%7B").replace("}", "%7D")
                return f"{{{uri}}}{s.test.local}"
        return None

    def itself(self, e) -> bool:
        return isinstance(e, Path) and e.start is None and len(e.steps) == 1 and e.steps[0] == Step("self", e.steps[0].test) and e.steps[0].test.kind == "node"

    def nodeset(self, e, frame: DataFrame) -> tuple[DataFrame, Typed]:
        """The nodes that e gives from each row, as a sorted array; joined once per distinct context node."""
        none = F.array().cast(NODESET)
        label = self.own_attribute(e)
        if label is not None:
            v = F.element_at("attrs", label)
            name = label.rpartition("}")[2]
            one = F.array(F.struct(F.col("pre").alias("pre"), v.alias("sv"), F.lit(name).alias("qname"), F.lit(name).alias("local"), F.lit(None).cast("string").alias("ns"))).cast(NODESET)
            return frame, Typed("nodes", F.when(v.isNotNull(), one).otherwise(none))
        if self.itself(e):
            had = frame.columns
            frame = self.with_sv(frame)
            one = F.array(F.struct("pre", "sv", qname().alias("qname"), F.coalesce("local", F.lit("")).alias("local"), "ns")).cast(NODESET)
            name = self.fresh(frame)
            return frame.withColumn(name, one).select(*had, name), Typed("nodes", F.col(name))
        absolute = isinstance(e, Path) and e.start == "/"
        if absolute:
            ctx, keys = frame.select("doc_id").distinct().join(self.roots(), "doc_id"), ["doc_id"]
            hits = self.with_sv(self.run(e, ctx, []))
        else:
            ctx, keys = frame.select(*NODE).dropDuplicates(["doc_id", "pre"]).withColumn("_o", F.col("pre")), ["doc_id", "_o"]
            hits = self.with_sv(self.run(e, ctx, ["_o"]))
        name = self.fresh(frame)
        grouped = hits.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pre", "sv", qname().alias("qname"), F.coalesce("local", F.lit("")).alias("local"), "ns"))).cast(NODESET).alias(name))
        grouped = grouped.withColumnRenamed("doc_id", "_gd")
        on = F.col("_gd") == F.col("doc_id")
        if not absolute:
            on = on & (F.col("_o") == F.col("pre"))
            grouped = grouped.withColumnRenamed("_o", f"{name}o")
            on = (F.col("_gd") == F.col("doc_id")) & (F.col(f"{name}o") == F.col("pre"))
        out = frame.join(grouped, on, "left").drop("_gd", f"{name}o")
        return out.withColumn(name, F.coalesce(F.col(name), none)), Typed("nodes", F.col(name))

    def fresh(self, frame: DataFrame) -> str:
        k = 0
        while f"_ns{k}" in frame.columns:
            k += 1
        return f"_ns{k}"

    def string(self, v: Typed) -> Column:
        if v.kind == "nodes":
            return F.when(F.size(v.col) > 0, v.col[0]["sv"]).otherwise(F.lit(""))
        if v.kind == "number":
            return from_num(v.col)
        return F.when(v.col, F.lit("true")).otherwise(F.lit("false")) if v.kind == "boolean" else v.col

    def number(self, v: Typed) -> Column:
        if v.kind == "number":
            return v.col
        return v.col.cast("double") if v.kind == "boolean" else to_num(self.string(v))

    def boolean(self, v: Typed) -> Column:
        if v.kind == "boolean":
            return v.col
        if v.kind == "number":
            return (v.col != 0) & ~F.isnan(v.col)
        return F.size(v.col) > 0 if v.kind == "nodes" else v.col != ""

    def compare(self, op: str, a: Typed, b: Typed) -> Column:
        if a.kind != "nodes" and b.kind == "nodes":
            return self.compare(FLIP[op], b, a)
        if a.kind == "nodes" and b.kind == "boolean":
            return self.compare(op, Typed("boolean", self.boolean(a)), b)
        if a.kind == "nodes" and b.kind == "nodes":
            left, right = F.transform(a.col, lambda x: x["sv"]), F.transform(b.col, lambda x: x["sv"])
            both = (F.size(a.col) > 0) & (F.size(b.col) > 0)
            if op == "=":
                return F.arrays_overlap(left, right)
            if op == "!=":
                return both & (F.size(F.array_distinct(F.concat(left, right))) > 1)
            real = lambda c: F.filter(F.transform(c, to_num), lambda x: ~F.isnan(x))
            nl, nr = real(left), real(right)
            low, high = (F.array_min(nl), F.array_max(nr)) if op[0] == "<" else (F.array_max(nl), F.array_min(nr))
            return F.coalesce(scalar_compare(op, low, high), F.lit(False))
        if a.kind == "nodes":
            if b.kind == "number" or op not in ("=", "!="):
                other = self.number(b)
                return F.exists(a.col, lambda x: scalar_compare(op, to_num(x["sv"]), other))
            return F.exists(a.col, lambda x: (x["sv"] == b.col) if op == "=" else (x["sv"] != b.col))
        if op in ("=", "!="):
            if "boolean" in (a.kind, b.kind):
                same = self.boolean(a) == self.boolean(b)
            elif "number" in (a.kind, b.kind):
                return scalar_compare(op, self.number(a), self.number(b))
            else:
                same = a.col == b.col
            return same if op == "=" else ~same
        return scalar_compare(op, self.number(a), self.number(b))

    def compile(self, e, frame: DataFrame) -> tuple[DataFrame, Typed]:
        """(frame with the columns that e needs, e as a typed column over it)."""
        if isinstance(e, Num):
            return frame, Typed("number", F.lit(e.value))
        if isinstance(e, Str):
            return frame, Typed("string", F.lit(e.value))
        if isinstance(e, Var):
            if e.name not in self.vars:
                raise XPathError(f"undefined variable ${e.name}")
            v = self.vars[e.name]
            if isinstance(v, DataFrame):
                return self.nodeset(e, frame)
            return frame, Typed("boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "number", F.lit(v if isinstance(v, bool | str) else float(v)))
        if isinstance(e, Neg):
            frame, v = self.compile(e.operand, frame)
            return frame, Typed("number", -self.number(v))
        if isinstance(e, Path | Filter) or (isinstance(e, Bin) and e.op == "|") or (isinstance(e, Fn) and e.name == "id"):
            return self.nodeset(e, frame)
        if isinstance(e, Bin):
            frame, a = self.compile(e.left, frame)
            frame, b = self.compile(e.right, frame)
            if e.op in ("and", "or"):
                x, y = self.boolean(a), self.boolean(b)
                return frame, Typed("boolean", x & y if e.op == "and" else x | y)
            if e.op in COMPARE:
                return frame, Typed("boolean", self.compare(e.op, a, b))
            x, y = self.number(a), self.number(b)
            col = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "div": lambda: divide(x, y), "mod": lambda: modulo(x, y)}[e.op]()
            return frame, Typed("number", col)
        if isinstance(e, Fn):
            return self.call(e, frame)
        raise XPathError(f"not an expression: {e!r}")

    def call(self, e: Fn, frame: DataFrame) -> tuple[DataFrame, Typed]:
        args: list[Typed] = []
        if e.name in ("position", "last"):
            return frame, Typed("number", F.col("_pos" if e.name == "position" else "_size"))
        if e.name == "lang":
            return self.lang(e, frame)
        names = list(e.args)
        if not names and e.name in ("string", "number", "string-length", "normalize-space", "name", "local-name", "namespace-uri"):
            names = [parse(".")]
        for a in names:
            frame, v = self.compile(a, frame)
            args.append(v)
        s, n = self.string, self.number
        first = lambda f: F.when(F.size(args[0].col) > 0, F.coalesce(args[0].col[0][f], F.lit(""))).otherwise(F.lit(""))
        fold = lambda c, f: F.aggregate(c, F.lit(0.0), f)
        made = {
            "count": lambda: Typed("number", F.size(args[0].col).cast("double")),
            "sum": lambda: Typed("number", fold(args[0].col, lambda acc, x: acc + to_num(x["sv"]))),
            "string": lambda: Typed("string", s(args[0])),
            "number": lambda: Typed("number", n(args[0])),
            "boolean": lambda: Typed("boolean", self.boolean(args[0])),
            "not": lambda: Typed("boolean", ~self.boolean(args[0])),
            "true": lambda: Typed("boolean", F.lit(True)),
            "false": lambda: Typed("boolean", F.lit(False)),
            "concat": lambda: Typed("string", F.concat(*map(s, args))),
            "starts-with": lambda: Typed("boolean", F.startswith(s(args[0]), s(args[1]))),
            "contains": lambda: Typed("boolean", F.contains(s(args[0]), s(args[1]))),
            "substring-before": lambda: Typed("string", before(s(args[0]), s(args[1]))),
            "substring-after": lambda: Typed("string", after(s(args[0]), s(args[1]))),
            "substring": lambda: Typed("string", xpath_substring(s(args[0]), n(args[1]), n(args[2]) if len(args) > 2 else None)),
            "string-length": lambda: Typed("number", F.length(s(args[0])).cast("double")),
            "normalize-space": lambda: Typed("string", F.trim(F.regexp_replace(s(args[0]), r"[ \t\r\n]+", " "))),
            "translate": lambda: Typed("string", translated(s(args[0]), e.args[1], e.args[2]) if isinstance(e.args[1], Str) and isinstance(e.args[2], Str) else F.call_function("translate", *map(s, args))),
            "floor": lambda: Typed("number", rounded(n(args[0]), "floor")),
            "ceiling": lambda: Typed("number", rounded(n(args[0]), "ceiling")),
            "round": lambda: Typed("number", rounded(n(args[0]), "round")),
            "name": lambda: Typed("string", first("qname")),
            "local-name": lambda: Typed("string", first("local")),
            "namespace-uri": lambda: Typed("string", first("ns")),
            "generate-id": lambda: Typed("string", F.concat(F.lit("r"), F.col("doc_id").cast("string"), F.lit("n"), args[0].col[0]["pre"].cast("string") if args else F.col("pre").cast("string"))),
        }
        if e.name in self.functions:
            return frame, self.functions[e.name](self, args)
        if e.name not in made:
            raise XPathError(f"no function is named {e.name}")
        return frame, made[e.name]()

    def lang(self, e: Fn, frame: DataFrame) -> tuple[DataFrame, Typed]:
        """Nearest xml:lang at or above the node, by its subtag boundary."""
        key = "{http:%2F%2Fwww.w3.org%2FXML%2F1998%2Fnamespace}lang"
        has = self.nodes.filter(F.element_at("attrs", key).isNotNull()).select(F.col("doc_id").alias("_d"), F.col("pre").alias("_p"), F.col("last").alias("_l"), F.element_at("attrs", key).alias("_v"))
        frame, v = self.compile(e.args[0], frame)
        want = F.lower(self.string(v))
        name = f"_lang{sum(c.startswith('_lang') for c in frame.columns)}"
        ctx = frame.select("doc_id", "pre").distinct()
        near = ctx.join(has, (F.col("_d") == F.col("doc_id")) & (F.col("_p") <= F.col("pre")) & (F.col("_l") >= F.col("pre"))).groupBy("doc_id", "pre").agg(F.lower(F.max_by("_v", "_p")).alias(name))
        return frame.join(near, ["doc_id", "pre"], "left"), Typed("boolean", F.coalesce((F.col(name) == want) | F.startswith(F.col(name), F.concat(want, F.lit("-"))), F.lit(False)))


def before(s: Column, sep: Column) -> Column:
    at = F.call_function("instr", s, sep)
    return F.when((at > 0) & (sep != ""), F.substring(s, F.lit(1), at - 1)).otherwise(F.lit(""))


def after(s: Column, sep: Column) -> Column:
    at = F.call_function("instr", s, sep)
    return F.when(sep == "", s).when(at > 0, F.substring(s, at + F.length(sep), F.length(s))).otherwise(F.lit(""))


def translated(s: Column, a, b) -> Column:
    if not (isinstance(a, Str) and isinstance(b, Str)):
        raise XPathError("translate() takes constants as its second and third argument")
    return F.translate(s, a.value, b.value)
