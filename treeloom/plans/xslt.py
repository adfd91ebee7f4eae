"""XSLT 1.0 with EXSLT over a corpus: templates run document by document inside ``mapInArrow``.

Template rules recurse over the tree with parameters, modes and result fragments as they go, which has no set-at-a-time form; a
document is the unit of work, so the corpus is transformed in parallel without any shuffle. The stylesheet is
compiled once on the driver, shipped with the plan, and what a task holds is one document and its result.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.functions.exslt_memory import EXSLT, by_prefix
from treeloom.functions.numbers import format_one
from treeloom.sources.serialize import serialize
from treeloom.sources.tree import Node, ParseError, parse_html, parse_xml

from .xpath_ast import ANY_NODE, Bin, Filter, Fn, Path, Str, XPathError, parse
from .xpath_eval import CORE, Context, as_string, attribute_name, compiled, evaluate, on_axis, order, passes, to_boolean, to_number, to_string

XSL = "http://www.w3.org/1999/XSL/Transform"
FUNC = EXSLT + "functions"
COMMON = EXSLT + "common"
DEPTH = 2500


class XsltError(ValueError):
    """A stylesheet that isn't valid, or a transformation that can't go on."""


class Terminated(XsltError):
    """xsl:message with terminate="yes"."""


@dataclass
class Rule:
    pattern: object
    element: Node
    precedence: int
    priority: float
    position: int
    mode: str | None


def alternatives(e) -> list:
    return [*alternatives(e.left), *alternatives(e.right)] if isinstance(e, Bin) and e.op == "|" else [e]


def default_priority(p) -> float:
    if not isinstance(p, Path) or p.start is not None or len(p.steps) != 1 or p.steps[0].preds:
        return 0.5
    t = p.steps[0].test
    if t.kind == "name":
        return 0.0 if t.local else -0.25
    return 0.0 if t.kind == "pi" and t.local else -0.5


def may_match(p, kind: str, local: str | None) -> bool:
    """False if a pattern's last step rules out all nodes of a kind and name."""
    if not isinstance(p, Path):
        return True
    if not p.steps:
        return kind == "root"
    s = p.steps[-1]
    if s == ANY_NODE:
        return True
    if kind == "root" or (kind == "attribute") != (s.axis == "attribute"):
        return False
    test = s.test
    if test.kind in ("name", "any"):
        return kind in ("element", "attribute") and (test.local is None or test.local == local)
    return test.kind == "node" or test.kind == kind


def matches(p, n: Node, ctx: Context, seen: dict | None = None) -> bool:
    """Does a pattern match node n? Steps are checked from the last upwards. ``seen`` keeps what key() and id() find, by pattern and tree."""
    if isinstance(p, Path) and p.start is None and len(p.steps) == 1 and not p.steps[0].preds:
        s = p.steps[0]
        if s.axis in ("child", "attribute"):
            return n.kind != "root" and (n.kind == "attribute") == (s.axis == "attribute") and passes(n, s.axis, s.test, ctx.ns)
    if isinstance(p, Fn) and seen is not None and all(isinstance(a, Str) for a in p.args):
        root = n.root()
        if (id(p), id(root)) not in seen:
            seen[id(p), id(root)] = {id(x): x for x in evaluate(p, ctx)}
        return id(n) in seen[id(p), id(root)]
    if isinstance(p, Fn) or isinstance(p, Filter):
        return any(x is n for x in evaluate(p, ctx.at(n, ctx.pos, ctx.size)))
    if not isinstance(p, Path):
        raise XPathError(f"not a pattern: {p!r}")

    def up(node: Node | None, k: int) -> bool:
        if k < 0:
            if p.start == "/":
                return node is not None and node.kind == "root"
            if p.start is None:
                return True
            return node is not None and any(x is node for x in evaluate(p.start, ctx.at(node, ctx.pos, ctx.size)))
        s = p.steps[k]
        if s == ANY_NODE:
            while node is not None:
                if up(node, k - 1):
                    return True
                node = node.parent
            return False
        if node is None or node.kind == "root":
            return False
        axis = "attribute" if s.axis == "attribute" else "child"
        if (node.kind == "attribute") != (axis == "attribute") or not passes(node, axis, s.test, ctx.ns):
            return False
        if s.preds:
            if node.parent is None:
                return False
            rest = [x for x in on_axis(node.parent, axis) if passes(x, axis, s.test, ctx.ns)]
            for q in s.preds:
                kept = []
                for i, x in enumerate(rest, 1):
                    v = evaluate(q, ctx.at(x, i, len(rest)))
                    if (v == i) if isinstance(v, float) else to_boolean(v):
                        kept.append(x)
                rest = kept
            if not any(x is node for x in rest):
                return False
        if s.axis == "descendant":
            above = node.parent
            while above is not None:
                if up(above, k - 1):
                    return True
                above = above.parent
            return k == 0 and p.start is None
        if k == 0 and p.start is None:
            return True
        return up(node.parent, k - 1)

    if not p.steps:
        return n.kind == "root"
    return up(n, len(p.steps) - 1)


@dataclass
class Stylesheet:
    """A compiled stylesheet; ``modules`` maps the href of imports and includes to text."""

    rules: list[Rule] = field(default_factory=list)
    named: dict[str, Node] = field(default_factory=dict)
    globals: list[Node] = field(default_factory=list)
    keys: dict[str, list[tuple[object, object, Node]]] = field(default_factory=dict)
    sets: dict[str, list[Node]] = field(default_factory=dict)
    formats: dict[str, dict[str, str]] = field(default_factory=dict)
    output: dict[str, str] = field(default_factory=dict)
    cdata: set = field(default_factory=set)
    strip: list[tuple[float, int, str | None, str | None, bool]] = field(default_factory=list)
    aliases: dict[str, tuple[str, str]] = field(default_factory=dict)
    functions: dict[tuple[str, str], Node] = field(default_factory=dict)
    excluded: set = field(default_factory=set)
    top: Node | None = None
    candidates: dict[tuple, list[Rule]] = field(default_factory=dict)
    _n: int = 0

    @staticmethod
    def compile(text: str, modules: dict[str, str] | None = None) -> "Stylesheet":
        sheet = Stylesheet()
        sheet._load(text, modules or {}, [0], ())
        sheet.rules.sort(key=lambda r: (r.precedence, r.priority, r.position), reverse=True)
        return sheet

    def rules_for(self, mode: str | None, n: Node) -> list[Rule]:
        """Rules that may match a node, by mode, kind and name; the best first."""
        at = mode, n.kind, n.local
        found = self.candidates.get(at)
        if found is None:
            if len(self.candidates) > 10_000:  # names that documents bring along
                self.candidates.clear()
            found = self.candidates[at] = [r for r in self.rules if r.mode == mode and may_match(r.pattern, n.kind, n.local)]
        return found

    def _load(self, text: str, modules: dict[str, str], counter: list[int], above: tuple[str, ...]) -> None:
        top = next(c for c in parse_xml(text).children if c.kind == "element")
        self.top = top
        if top.ns != XSL:
            if top.get("version", XSL) is None:
                raise XsltError("neither a stylesheet nor a literal result element with xsl:version")
            rule = Node("element", XSL, "template", "xsl")
            rule.children, rule.parent, rule.nsdecl = [top], None, {}
            self.rules.append(Rule(parse("/"), rule, 0, 0.5, 0, None))
            return
        if top.local not in ("stylesheet", "transform"):
            raise XsltError(f"xsl:{top.local} is no stylesheet")
        tops = [c for c in top.children if c.kind == "element"]
        for c in tops:
            if c.ns == XSL and c.local == "import":
                self._module(c, modules, counter, above)
        counter[0] += 1
        precedence = counter[0]
        self.top = top
        self._declarations(tops, top, modules, counter, above, precedence)

    def _module(self, c: Node, modules, counter, above) -> None:
        href = c.get("href")
        if href in above:
            raise XsltError(f"{href} imports itself")
        if href not in modules:
            raise XsltError(f"no module {href}")
        self._load(modules[href], modules, counter, (*above, href))

    def _declarations(self, tops, top, modules, counter, above, precedence) -> None:
        for p in (top.get("exclude-result-prefixes") or "").split() + (top.get("extension-element-prefixes") or "").split():
            self.excluded.add(top.nsdecl.get("" if p == "#default" else p))
        for c in tops:
            self._n += 1
            if c.ns == FUNC and c.local == "function":
                p, _, local = c.get("name").partition(":")
                self.functions[(c.namespaces().get(p), local)] = c
            if c.ns != XSL:
                continue
            kind = c.local
            if kind == "include":
                href = c.get("href")
                if href not in modules or href in above:
                    raise XsltError(f"no module {href}")
                other = next(x for x in parse_xml(modules[href]).children if x.kind == "element")
                self._declarations([x for x in other.children if x.kind == "element"], other, modules, counter, (*above, href), precedence)
            elif kind == "template":
                if c.get("name"):
                    self.named[c.get("name")] = c
                if c.get("match"):
                    for p in alternatives(parse(c.get("match"))):
                        given = c.get("priority")
                        self.rules.append(Rule(p, c, precedence, float(given) if given else default_priority(p), self._n, c.get("mode")))
                elif not c.get("name"):
                    raise XsltError("xsl:template needs match or name")
            elif kind in ("variable", "param"):
                self.globals = [g for g in self.globals if g.get("name") != c.get("name")] + [c]
            elif kind == "key":
                self.keys.setdefault(c.get("name"), []).append((parse(c.get("match")), parse(c.get("use")), c))
            elif kind == "attribute-set":
                self.sets.setdefault(c.get("name"), []).append(c)
            elif kind == "decimal-format":
                names = {"decimal-separator": "decimal", "grouping-separator": "grouping", "minus-sign": "minus", "NaN": "nan", "zero-digit": "zero", "pattern-separator": "pattern"}
                self.formats[c.get("name") or ""] = {names.get(a.local, a.local): a.value for a in c.attrs if a.local != "name"}
            elif kind == "output":
                for a in c.attrs:
                    if a.local == "cdata-section-elements":
                        for q in a.value.split():
                            p, colon, local = q.rpartition(":")
                            self.cdata.add((c.namespaces().get(p) if colon else None, local))
                    else:
                        self.output[a.local] = a.value
            elif kind in ("strip-space", "preserve-space"):
                for q in (c.get("elements") or "").split():
                    p, colon, local = q.rpartition(":")
                    self.strip.append((precedence, 0.0 if local != "*" else -0.25 if colon else -0.5, c.namespaces().get(p) if colon else None, None if local == "*" else local, kind == "strip-space", bool(colon)))
            elif kind == "namespace-alias":
                scope = c.namespaces()
                pick = lambda p: scope.get("" if p == "#default" else p, "")
                result = c.get("result-prefix")
                self.aliases[pick(c.get("stylesheet-prefix"))] = (pick(result), "" if result == "#default" else result)

    def strips(self, e: Node) -> bool:
        best = None
        for precedence, priority, ns, local, strip, prefixed in self.strip:
            if (local is None or local == e.local) and (ns == (e.ns or None) if prefixed or local is not None else True) and (best is None or (precedence, priority) >= best[0]):
                best = ((precedence, priority), strip)
        return bool(best and best[1])


class Run:
    """Transformations of documents one after another: ``begin`` one, then ``run``. What belongs to the stylesheet is kept between them."""

    def __init__(self, sheet: Stylesheet, source: Node | None = None, params: dict | None = None, documents: dict[str, str] | None = None) -> None:
        self.sheet, self.documents = sheet, documents or {}
        self.params = params or {}
        self.loaded: dict[str, Node] = {}
        self.scopes: dict[int, tuple[dict, dict]] = {}
        self.spaces: dict[int, dict[str, str]] = {}
        self.templates: dict[str, list] = {}
        self.strings: dict[str, object] = {}
        self.values: dict[str, object] = {}
        self.bodies: dict[int, tuple[list[Node], list[Node]]] = {}
        self.global_names = {g.get("name") for g in sheet.globals}
        if source is not None:
            self.begin(source)

    def begin(self, source: Node) -> Run:
        self.source = source
        if self.sheet.strip:
            self.strip(source)
            source.number()
        self.key_tables: dict[tuple[int, str], dict[str, list[Node]]] = {}
        self.pattern_nodes: dict[tuple[int, int], dict[int, Node]] = {}
        self.out: list[Node] = []
        self.files: dict[str, str] = {}
        self.messages: list[str] = []
        self.rule: Rule | None = None
        self.mode: str | None = None
        self.globals: dict = {}
        self.busy: set[str] = set()
        self.depth = 0
        self.doc_numbers: dict[int, tuple[int, Node]] = {id(source): (0, source)}
        return self

    def number_of(self, doc: Node) -> int:
        """Documents are numbered in the order in which ids are asked for, the source first; so runs agree."""
        return self.doc_numbers.setdefault(id(doc), (len(self.doc_numbers), doc))[0]

    def strip(self, n: Node) -> None:
        if n.kind == "element" and self.sheet.strips(n) and n.get("space", "http://www.w3.org/XML/1998/namespace") != "preserve":
            n.children = [c for c in n.children if c.kind != "text" or c.value.strip(" \t\r\n")]
        for c in n.children:
            self.strip(c)

    # -- expressions

    def functions(self) -> dict:
        return {
            "current": lambda c: [c.current],
            "key": lambda c, name, v: self.key(c, to_string(name), v),
            "document": lambda c, v, *base: self.document(v),
            "format-number": lambda c, n, p, f="": format_one(to_number(n), to_string(p), self.sheet.formats.get(to_string(f), {})),
            "generate-id": lambda c, *a: "" if a and not a[0] else (lambda n: f"id{self.number_of(n.doc)}n{n.pre}{n.kind[0]}{n.local if n.kind == 'namespace' else ''}")(a[0][0] if a else c.node),
            "system-property": lambda c, n: {"version": 1.0, "vendor": "treeloom", "vendor-url": ""}.get(to_string(n).partition(":")[2], ""),
            "element-available": lambda c, n: to_string(n).partition(":")[2] in INSTRUCTIONS,
            "function-available": lambda c, n: to_string(n) in c.functions or to_string(n) in CORE,
            "unparsed-entity-uri": lambda c, n: "",
        }

    def scope(self, at: Node) -> tuple[dict, dict]:
        """Prefixes and functions in scope at a stylesheet element."""
        found = self.scopes.get(id(at))
        if found is None:
            ns = {p: u for p, u in at.namespaces().items() if p}
            own = {f"{p}:{n}": self.defined(e) for (u, n), e in self.sheet.functions.items() for p, x in ns.items() if x == u}
            found = self.scopes[id(at)] = ns, {**self.functions(), **by_prefix(ns), **own}
        return found

    def namespaces(self, at: Node) -> dict[str, str]:
        """Prefixes in scope at a stylesheet element, the default namespace too."""
        found = self.spaces.get(id(at))
        if found is None:
            found = self.spaces[id(at)] = at.namespaces()
        return found

    def defined(self, element: Node):
        """A func:function as a Python function."""
        def call(c: Context, *args):
            names = dict(self.globals)
            rest = list(args)
            for x in element.children:
                if x.ns == XSL and x.local == "param":
                    names[x.get("name")] = rest.pop(0) if rest else self.variable(x, c.with_vars(names))
            try:
                self.fragment(element.children, c.with_vars(names), skip_params=True)
            except _Result as r:
                return r.value
            return ""

        return call

    def ctx(self, at: Node, c: Context) -> Context:
        ns, functions = self.scope(at)
        return Context(c.node, c.pos, c.size, c.vars, ns, functions, c.node)

    def eval(self, text: str, at: Node, c: Context):
        f = self.values.get(text)
        if f is None:
            f = self.values[text] = compiled(parse(text))
        return f(self.ctx(at, c))

    def string(self, text: str, at: Node, c: Context) -> str:
        """As eval, for the value's string."""
        f = self.strings.get(text)
        if f is None:
            f = self.strings[text] = as_string(parse(text))
        return f(self.ctx(at, c))

    def avt(self, text: str | None, at: Node, c: Context) -> str | None:
        if text is None or ("{" not in text and "}" not in text):
            return text
        parts = self.templates.get(text)
        if parts is None:
            parts, k = [], 0
            while k < len(text):
                ch = text[k]
                if text[k : k + 2] in ("{{", "}}"):
                    parts.append((False, ch))
                    k += 2
                elif ch == "{":
                    end, quote = k + 1, ""
                    while end < len(text) and (quote or text[end] != "}"):
                        quote = "" if quote == text[end] else quote or (text[end] if text[end] in "'\"" else "")
                        end += 1
                    parts.append((True, text[k + 1 : end]))
                    k = end + 1
                else:
                    parts.append((False, ch))
                    k += 1
            self.templates[text] = parts
        return "".join([self.string(x, at, c) if computed else x for computed, x in parts])

    def key(self, c: Context, name: str, v) -> list[Node]:
        root = c.node.root()
        if (id(root), name) not in self.key_tables:
            table: dict[str, list[Node]] = {}
            for match, use, element in self.sheet.keys.get(name, []):
                patterns, value = alternatives(match), compiled(use)
                of_attributes = any(not isinstance(p, Path) or p.steps and (p.steps[-1].axis == "attribute" or p.steps[-1] == ANY_NODE) for p in patterns)
                for n in root.walk():
                    for x in (n, *n.attrs) if of_attributes else (n,):
                        may = [p for p in patterns if may_match(p, x.kind, x.local)]
                        if not may:
                            continue
                        cc = self.ctx(element, Context(x, vars=self.globals))
                        if any(matches(p, x, cc, self.pattern_nodes) for p in may):
                            got = value(cc)
                            for s in {y.text() for y in got} if isinstance(got, list) else {to_string(got)}:
                                table.setdefault(s, []).append(x)
            self.key_tables[(id(root), name)] = table
        table = self.key_tables[(id(root), name)]
        wanted = {n.text() for n in v} if isinstance(v, list) else {to_string(v)}
        return order([n for s in wanted for n in table.get(s, [])])

    def document(self, v) -> list[Node]:
        out = []
        for uri in [n.text() for n in v] if isinstance(v, list) else [to_string(v)]:
            name, _, fragment = uri.partition("#")
            if name == "":
                out.append(self.sheet.top.root())
            elif name in self.documents:
                if name not in self.loaded:
                    self.loaded[name] = parse_xml(self.documents[name])
                out.append(self.loaded[name])
        return out

    # -- output

    def text(self, s: str) -> None:
        if s:
            here = self.out[-1]
            if here.children and here.children[-1].kind == "text":
                here.children[-1].value += s
            else:
                here.add(Node("text", value=s))

    def fragment(self, body: list[Node], c: Context, skip_params: bool = False) -> Node:
        top = Node("root")
        self.out.append(top)
        try:
            self.body(body, c, skip_params)
        finally:
            self.out.pop()
        return top.number()

    def element(self, ns, local, prefix) -> Node:
        return self.out[-1].add(Node("element", ns or None, local, prefix or None))

    def within(self, e: Node, body: list[Node], c: Context) -> None:
        self.out.append(e)
        self.body(body, c)
        self.out.pop()

    # -- templates

    def run(self) -> Node:
        result = Node("root")
        self.out = [result]
        start = Context(self.source, vars={})
        for g in self.sheet.globals:
            self.global_value(g.get("name"), start)
        self.apply([self.source], None, {}, Context(self.source, vars=_Globals(self, start)))
        return result.number()

    def global_value(self, name: str, c: Context):
        if name not in self.globals:
            element = next((g for g in self.sheet.globals if g.get("name") == name), None)
            if element is None:
                raise XPathError(f"undefined variable ${name}")
            if name in self.busy:
                raise XsltError(f"${name} needs itself")
            self.busy.add(name)
            at = c.with_vars(_Globals(self, c))
            self.globals[name] = self.params[name] if element.local == "param" and name in self.params else self.variable(element, at)
        return self.globals[name]

    def apply(self, nodes: list[Node], mode: str | None, params: dict, c: Context) -> None:
        for i, n in enumerate(nodes, 1):
            cc = c.at(n, i, len(nodes))
            self.one(n, mode, params, cc, None)

    def one(self, n: Node, mode, params, c: Context, below: int | None) -> None:
        for r in self.sheet.rules_for(mode, n):
            if (below is None or r.precedence < below) and matches(r.pattern, n, self.ctx(r.element, c), self.pattern_nodes):
                self.template(r.element, params, c, r, mode)
                return
        if n.kind in ("root", "element"):
            self.apply(n.children, mode, {}, c)
        elif n.kind in ("text", "attribute"):
            self.text(n.value)

    def template(self, element: Node, params: dict, c: Context, rule: Rule | None, mode) -> None:
        self.depth += 1
        if self.depth > DEPTH:
            raise XsltError("templates nest too deep")
        saved = self.rule, self.mode
        self.rule, self.mode = rule, mode
        names = _Globals(self, c)
        self.body(element.children, c.with_vars(names), False, params)
        self.rule, self.mode = saved
        self.depth -= 1

    def variable(self, e: Node, c: Context):
        if e.get("select") is not None:
            return self.eval(e.get("select"), e, c)
        if not any(x.kind == "element" or (x.kind == "text" and x.value.strip()) for x in e.children):
            return ""
        return [self.fragment(e.children, c)]

    def given(self, e: Node, c: Context) -> dict:
        return {x.get("name"): self.variable(x, c) for x in e.children if x.ns == XSL and x.local == "with-param"}

    def sorted(self, nodes: list[Node], e: Node, c: Context) -> list[Node]:
        for s in reversed([x for x in self.counting(e.children) if x.local == "sort" and x.ns == XSL]):
            select, number = parse(s.get("select") or "."), self.avt(s.get("data-type"), s, c) == "number"
            descending, case = self.avt(s.get("order"), s, c) == "descending", self.avt(s.get("case-order"), s, c)
            value = compiled(select) if attribute_name(select) is None else as_string(select)
            values, cc = {}, self.ctx(s, c)
            for i, n in enumerate(nodes, 1):
                cc.node, cc.pos, cc.size, cc.current = n, i, len(nodes), n
                v = value(cc)
                if number:
                    x = to_number(v)
                    values[id(n)] = (0, 0.0) if x != x else (1, x)
                else:
                    t = to_string(v)
                    values[id(n)] = (t.lower(), t if case == "upper-first" else t.swapcase()) if case else (t,)
            nodes = sorted(nodes, key=lambda n: values[id(n)], reverse=descending) if not descending else sorted(nodes[::-1], key=lambda n: values[id(n)])[::-1]
        return nodes

    def counting(self, body: list[Node]) -> list[Node]:
        """The elements and texts of a stylesheet's content that do something."""
        found = self.bodies.get(id(body))
        if found is None:
            found = self.bodies[id(body)] = body, [x for x in body if x.kind == "element" or x.kind == "text" and (x.value.strip(" \t\r\n") or x.parent is not None and x.parent.ns == XSL and x.parent.local == "text")]
        return found[1]

    def body(self, body: list[Node], c: Context, skip_params: bool = False, params: dict | None = None) -> None:
        for x in self.counting(body):
            if x.kind == "text":
                self.text(x.value)
            elif x.ns == XSL and x.local in ("variable", "param"):
                if x.local == "param" and skip_params:
                    continue
                name = x.get("name")
                value = params[name] if x.local == "param" and params and name in params else self.variable(x, c)
                c = c.with_vars(_Globals.plus(c.vars, name, value))
            elif x.ns == XSL:
                do = INSTRUCTIONS.get(x.local)
                if do is None:
                    self.fallback(x, c, f"xsl:{x.local}")
                else:
                    do(self, x, c)
            elif x.ns == FUNC and x.local == "result":
                raise _Result(self.variable(x, c))
            elif x.ns == COMMON and x.local == "document":
                self.files[self.avt(x.get("href"), x, c)] = serialize(self.fragment(x.children, c), x.get("method") or "xml")
            else:
                self.literal(x, c)

    def fallback(self, x: Node, c: Context, name: str) -> None:
        found = [f for f in x.children if f.ns == XSL and f.local == "fallback"]
        if not found:
            raise XsltError(f"{name} isn't known and has no fallback")
        for f in found:
            self.body(f.children, c)

    def literal(self, x: Node, c: Context) -> None:
        alias = lambda ns, prefix: self.sheet.aliases.get(ns or "", (ns, prefix))
        ns, prefix = alias(x.ns, x.prefix)
        e = self.element(ns, x.local, prefix)
        for p, u in x.nsdecl.items() if x.parent is not None and x.parent.ns != XSL else self.namespaces(x).items():
            if u and u != XSL and not u.startswith(EXSLT) and u not in self.sheet.excluded and p != "xml" and u not in self.sheet.aliases:
                e.nsdecl[p] = u
        for name in (x.get("use-attribute-sets", XSL) or "").split():
            self.attribute_set(e, name, c)
        for a in x.attrs:
            if a.ns != XSL:
                a_ns, a_prefix = alias(a.ns, a.prefix) if a.ns else (None, None)
                e.set_attr(a_ns, a.local, a_prefix, self.avt(a.value, x, c))
        self.within(e, x.children, c)

    def attribute_set(self, e: Node, name: str, c: Context, above: tuple = ()) -> None:
        if name in above:
            raise XsltError(f"attribute set {name} uses itself")
        for s in self.sheet.sets.get(name, []):
            for other in (s.get("use-attribute-sets") or "").split():
                self.attribute_set(e, other, c, (*above, name))
            self.within(e, s.children, c.with_vars(_Globals(self, c)))

    def named(self, x: Node, c: Context, for_attribute: bool) -> tuple[str | None, str, str | None]:
        q = self.avt(x.get("name"), x, c)
        if not re.fullmatch(r"(?:[^\W\d][\w.-]*:)?[^\W\d][\w.-]*", q or ""):
            raise XsltError(f"not a name: {q!r}")
        prefix, colon, local = q.rpartition(":")
        given = self.avt(x.get("namespace"), x, c)
        if given is not None:
            return given or None, local, prefix or ("ns0" if for_attribute and given else None)
        scope = self.namespaces(x)
        if colon and prefix not in scope:
            raise XsltError(f"undeclared prefix {prefix}")
        return (scope.get(prefix) if colon or not for_attribute else None), local, prefix or None

    def numbers(self, x: Node, c: Context) -> list[int] | str:
        if x.get("value") is not None:
            v = to_number(self.eval(x.get("value"), x, c))
            return to_string(v) if v != v or abs(v) == float("inf") or v < 0.5 else [int(v + 0.5)]
        n, level, cc = c.node, x.get("level") or "single", self.ctx(x, c)
        count, start = x.get("count"), x.get("from")
        if count:
            counts = lambda m: any(matches(p, m, cc) for p in alternatives(parse(count)))
        else:
            counts = lambda m: (m.kind, m.ns, m.local) == (n.kind, n.ns, n.local)
        begins = (lambda m: any(matches(p, m, cc) for p in alternatives(parse(start)))) if start else (lambda m: False)
        ordinal = lambda m: 1 + sum(map(counts, on_axis(m, "preceding-sibling")))
        if level == "any":
            k = 0
            for m in n.root().walk():
                if m.pre > n.pre:
                    break
                k = 0 if begins(m) else k + counts(m)
            return [k]
        out = []
        m: Node | None = n
        while m is not None and not (begins(m) and m is not n):
            if counts(m):
                out.insert(0, ordinal(m))
                if level == "single":
                    break
            m = m.parent
        return out


class _Result(Exception):
    def __init__(self, value):
        self.value = value


class _Globals(dict):
    """Variables of a template; what isn't there is looked up (and computed) among the globals."""

    def __init__(self, run: Run, c: Context):
        super().__init__()
        self.run, self.at = run, Context(run.source)

    def __contains__(self, name):
        return super().__contains__(name) or name in self.run.global_names

    def __missing__(self, name):
        return self.run.global_value(name, self.at)

    @staticmethod
    def plus(vars_, name, value):
        new = _Globals(vars_.run, vars_.at) if isinstance(vars_, _Globals) else {}
        new.update(vars_)
        new[name] = value
        return new


def alphabet(n: int, base: int) -> str:
    out = ""
    while n > 0:
        n, r = divmod(n - 1, 26)
        out = chr(base + r) + out
    return out


def roman(n: int) -> str:
    if not 0 < n < 4000:
        return str(n)
    out = ""
    for value, sign in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "m cm d cd c xc l xl x ix v iv i".split(), strict=True):
        out += sign * (n // value)
        n %= value
    return out


def formatted(numbers: list[int], pattern: str, separator: str = "", size: int = 0) -> str:
    """A list of numbers by a pattern such as 1.1, (a) or I."""
    parts = re.findall(r"[^\W_]+|[\W_]+", pattern) or ["1"]
    first = "" if parts[0][0].isalnum() else parts.pop(0)
    last = parts.pop() if parts and not parts[-1][0].isalnum() else ""
    tokens, gaps = parts[::2] or ["1"], parts[1::2]
    out = first
    for i, n in enumerate(numbers):
        if i:
            out += gaps[min(i - 1, len(gaps) - 1)] if gaps else "."
        t = tokens[min(i, len(tokens) - 1)]
        if t in ("a", "A"):
            out += alphabet(n, ord(t)) or "0"
        elif t in ("i", "I"):
            out += roman(n) if t == "i" else roman(n).upper()
        else:
            digits = str(n).rjust(len(t), "0")
            if separator and size:
                digits = re.sub(rf"(?<=\d)(?=(?:\d{{{size}}})+$)", separator, digits)
            out += digits
    return out + last


def _apply_templates(r: Run, x: Node, c: Context) -> None:
    nodes = r.eval(x.get("select"), x, c) if x.get("select") else list(c.node.children)
    if not isinstance(nodes, list):
        raise XsltError("xsl:apply-templates needs nodes")
    r.apply(r.sorted(nodes, x, c), x.get("mode"), r.given(x, c), c)


def _call(r: Run, x: Node, c: Context) -> None:
    t = r.sheet.named.get(x.get("name"))
    if t is None:
        raise XsltError(f"no template is named {x.get('name')}")
    r.template(t, r.given(x, c), c, r.rule, r.mode)


def _apply_imports(r: Run, x: Node, c: Context) -> None:
    r.one(c.node, r.mode, {}, c, r.rule.precedence if r.rule else 0)


def _for_each(r: Run, x: Node, c: Context) -> None:
    nodes = r.sorted(list(r.eval(x.get("select"), x, c)), x, c)
    for i, n in enumerate(nodes, 1):
        r.body(x.children, c.at(n, i, len(nodes)))  # xsl:sort does nothing there


def _choose(r: Run, x: Node, c: Context) -> None:
    for y in x.children:
        if y.ns == XSL and (y.local == "otherwise" or (y.local == "when" and to_boolean(r.eval(y.get("test"), y, c)))):
            r.body(y.children, c)
            return


def _if(r: Run, x: Node, c: Context) -> None:
    if to_boolean(r.eval(x.get("test"), x, c)):
        r.body(x.children, c)


def _copy(r: Run, x: Node, c: Context) -> None:
    n = c.node
    if n.kind == "root":
        r.body(x.children, c)
    elif n.kind == "element":
        e = r.element(n.ns, n.local, n.prefix)
        e.nsdecl = {p: u for p, u in n.namespaces().items() if p != "xml"}
        for name in (x.get("use-attribute-sets") or "").split():
            r.attribute_set(e, name, c)
        r.within(e, x.children, c)
    else:
        _copy_node(r, n)


def _copy_node(r: Run, n: Node) -> None:
    if n.kind == "root":
        for k in n.children:
            _copy_node(r, k)
    elif n.kind == "text":
        r.text(n.value)
    elif n.kind == "attribute":
        if r.out[-1].kind == "element":
            r.out[-1].set_attr(n.ns, n.local, n.prefix, n.value)
    elif n.kind == "namespace":
        if r.out[-1].kind == "element" and n.local != "xml":
            r.out[-1].nsdecl[n.local] = n.value
    else:
        new = n.copy()
        if n.kind == "element":
            new.nsdecl = {p: u for p, u in n.namespaces().items() if p != "xml"}
        r.out[-1].add(new)


def _copy_of(r: Run, x: Node, c: Context) -> None:
    v = r.eval(x.get("select"), x, c)
    if isinstance(v, list):
        for n in v:
            _copy_node(r, n)
    else:
        r.text(to_string(v))


def _element(r: Run, x: Node, c: Context) -> None:
    e = r.element(*r.named(x, c, False))
    for name in (x.get("use-attribute-sets") or "").split():
        r.attribute_set(e, name, c)
    r.within(e, x.children, c)


def _attribute(r: Run, x: Node, c: Context) -> None:
    ns, local, prefix = r.named(x, c, True)
    value = r.fragment(x.children, c).text()
    if r.out[-1].kind == "element" and not r.out[-1].children:
        r.out[-1].set_attr(ns, local, prefix, value)


def _message(r: Run, x: Node, c: Context) -> None:
    text = serialize(r.fragment(x.children, c))
    r.messages.append(text)
    if x.get("terminate") == "yes":
        raise Terminated(text)


def _number(r: Run, x: Node, c: Context) -> None:
    got = r.numbers(x, c)
    if isinstance(got, str):
        r.text(got)
    else:
        size = r.avt(x.get("grouping-size"), x, c)
        r.text(formatted(got, r.avt(x.get("format"), x, c) or "1", r.avt(x.get("grouping-separator"), x, c) or "", int(size) if size else 0))


INSTRUCTIONS = {
    "apply-templates": _apply_templates,
    "apply-imports": _apply_imports,
    "call-template": _call,
    "for-each": _for_each,
    "if": _if,
    "choose": _choose,
    "value-of": lambda r, x, c: r.text(r.string(x.get("select"), x, c)),
    "copy": _copy,
    "copy-of": _copy_of,
    "element": _element,
    "attribute": _attribute,
    "text": lambda r, x, c: r.text(x.text()),
    "comment": lambda r, x, c: r.out[-1].add(Node("comment", value=r.fragment(x.children, c).text())),
    "processing-instruction": lambda r, x, c: r.out[-1].add(Node("pi", local=r.avt(x.get("name"), x, c), value=r.fragment(x.children, c).text())),
    "number": _number,
    "message": _message,
    "fallback": lambda r, x, c: None,
    "sort": lambda r, x, c: None,
    "with-param": lambda r, x, c: None,
}


def written(sheet: Stylesheet, result: Node) -> str:
    """Text of a result tree by the stylesheet's xsl:output; html is the default if the first element is html."""
    o = sheet.output
    first = next((n for n in result.children if n.kind == "element"), None)
    method = o.get("method") or ("html" if first is not None and first.local.lower() == "html" and not first.ns else "xml")
    if o.get("indent") == "yes" and method in ("xml", "html", "xhtml"):
        method += "-indent"
    return serialize(
        result, method, declaration=o.get("omit-xml-declaration") != "yes" and method.startswith("xml"), encoding=o.get("encoding", "UTF-8"), standalone=o.get("standalone"),
        doctype_public=o.get("doctype-public"), doctype_system=o.get("doctype-system"), cdata_elements=frozenset(sheet.cdata),
    )


def transform_text(sheet: Stylesheet | str, source: str, params: dict | None = None, documents: dict[str, str] | None = None, modules: dict[str, str] | None = None) -> str:
    """One document in memory."""
    sheet = Stylesheet.compile(sheet, modules) if isinstance(sheet, str) else sheet
    run = Run(sheet, parse_xml(source), {k: float(v) if isinstance(v, int) and not isinstance(v, bool) else v for k, v in (params or {}).items()}, documents)
    return written(sheet, run.run())


def transform(df: DataFrame, doc_id: str, markup: str, stylesheet: str, params: dict | None = None, modules: dict[str, str] | None = None, documents: dict[str, str] | None = None, kind: str = "xml") -> DataFrame:
    """doc_id, result, error (null unless the document doesn't parse or the transformation stops) for every row."""
    Stylesheet.compile(stylesheet, modules)  # errors of the stylesheet show on the driver

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sheet = Stylesheet.compile(stylesheet, modules)
        run = Run(sheet, None, params, documents)
        gc.freeze()  # what was imported is looked at no more; a tree's nodes go in one round
        for batch in batches:
            results, errors = [], []
            for text in batch.column(1).to_pylist():
                try:
                    tree = parse_html(text or "") if kind == "html" else parse_xml(text or "")
                    results.append(written(sheet, run.begin(tree).run()))
                    errors.append(None)
                except (ParseError, XsltError, XPathError) as e:
                    results.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(results, pa.string()), pa.array(errors, pa.string())], names=["doc_id", "result", "error"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(markup)).mapInArrow(work, "doc_id long, result string, error string")


def transform_files(df: DataFrame, doc_id: str, markup: str, stylesheet: str, params: dict | None = None) -> DataFrame:
    """doc_id, href, text, error: what exsl:document elements write; the main result has an empty href.

    A document that can't be transformed has one row with its error and neither href nor text.
    """
    Stylesheet.compile(stylesheet)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sheet = Stylesheet.compile(stylesheet)
        run = Run(sheet, None, params)
        gc.freeze()
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    run.begin(parse_xml(text or ""))
                    rows += [(i, "", written(sheet, run.run()), None), *((i, href, out, None) for href, out in run.files.items())]
                except (ParseError, XsltError, XPathError) as e:
                    rows.append((i, None, None, str(e)))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["doc_id", "href", "text", "error"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(markup)).mapInArrow(work, "doc_id long, href string, text string, error string")
