"""Trees to text: xml, xml-indent, xml-canonical, html, html-indent, xhtml, xhtml-indent, html-nsstrip, text."""

from __future__ import annotations

import re
from urllib.parse import quote

from .tree import VOID, XHTML_NS, XML_NS, Node

# HTML attributes that may be minimised, and those that hold URIs.
BOOLEAN = frozenset("checked compact declare defer disabled ismap multiple nohref noresize noshade nowrap readonly selected".split())
URI_ATTRS = frozenset("action background cite classid codebase data href longdesc profile src usemap".split())
RAW = frozenset(("script", "style"))
#: Elements whose content is never indented.
KEPT = frozenset(("script", "style", "pre", "textarea", "xmp"))
INLINE = frozenset("a abbr b bdo big br cite code dfn em font i img input kbd label map object q s samp script select small span strike strong sub sup textarea tt u var".split())


def _text(s: str, canonical: bool = False) -> str:
    s = s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return s.replace("\r", "&#xD;") if canonical else s.replace("\r", "&#13;")


def _attr(s: str, canonical: bool = False) -> str:
    s = s.replace("&", "&amp;").replace("<", "&lt;")
    if canonical:
        return '"' + s.replace('"', "&quot;").replace("\t", "&#x9;").replace("\n", "&#xA;").replace("\r", "&#xD;") + '"'
    s = s.replace("\t", "&#9;").replace("\n", "&#10;").replace("\r", "&#13;")
    if '"' in s and "'" not in s:
        return f"'{s}'"
    return '"' + s.replace('"', "&quot;") + '"'


def _declarations(n: Node, scope: dict[str, str]) -> dict[str, str]:
    """Prefixes that n has to declare below ``scope``, its own and those that its names need."""
    need = {p: u for p, u in n.nsdecl.items() if scope.get(p, "") != u and p != "xml"}
    own = n.prefix or ""
    if {**scope, **need}.get(own, "") != (n.ns or ""):
        need[own] = n.ns or ""
    for a in n.attrs:
        if a.ns and a.prefix and a.ns != XML_NS and {**scope, **need}.get(a.prefix) != a.ns:
            need[a.prefix] = a.ns
    return need


def _cdata(s: str) -> str:
    return "<![CDATA[" + s.replace("]]>", "]]]]><![CDATA[>") + "]]>"


def serialize(node: Node, method: str = "xml", *, declaration: bool = False, encoding: str = "UTF-8", standalone: str | None = None, doctype_public: str | None = None, doctype_system: str | None = None, cdata_elements: frozenset = frozenset(), omit_meta: bool = True) -> str:
    """Text of a node and what is below it; cdata_elements: (ns, local) whose text goes into CDATA sections."""
    indent = method.endswith("-indent")
    kind = method.removesuffix("-indent")
    if kind == "text":
        return node.text()
    canonical = kind == "xml-canonical"
    strip = kind == "html-nsstrip"
    html = kind in ("html", "html-nsstrip")
    xhtml = kind == "xhtml"
    if kind not in ("xml", "xml-canonical", "html", "html-nsstrip", "xhtml"):
        raise ValueError(f"no serialiser is named {method}")
    out: list[str] = []
    plain = not indent and kind in ("xml", "xml-canonical") and not cdata_elements

    def put_plain(n: Node, scope: dict[str, str]) -> None:
        """As put, of an element whose attributes, if any, have no prefix and are no nodes yet."""
        given, name = n.given or (), n.qname
        decl = _declarations(n, scope) if n.nsdecl or scope.get(n.prefix or "", "") != (n.ns or "") else None
        out.append(f"<{name}")
        if decl:
            for p, u in sorted(decl.items()):
                if p or u or scope.get("", ""):
                    out.append(f" xmlns{':' + p if p else ''}={_attr(u, canonical)}")
            scope = {**scope, **decl}
        for a, v in sorted(zip(given[::2], given[1::2], strict=True)) if canonical else zip(given[::2], given[1::2], strict=True):
            out.append(f" {a}={_attr(v, canonical)}")
        if not n.children and not canonical:
            out.append("/>")
            return
        out.append(">")
        for c in n.children:
            if c.kind == "text":
                out.append(_text(c.value, canonical))
            else:
                put(c, scope, 0, False, False)
        out.append(f"</{name}>")

    if declaration and not html and not canonical:
        out.append(f'<?xml version="1.0" encoding="{encoding}"' + (f' standalone="{standalone}"' if standalone else "") + "?>\n")
    top = next((c for c in node.children if c.kind == "element"), None) if node.kind == "root" else node
    if (doctype_system or doctype_public) and top is not None and not canonical:
        out.append(f"<!DOCTYPE {top.qname}" + (f' PUBLIC "{doctype_public}"' + (f' "{doctype_system}"' if doctype_system else "") if doctype_public else f' SYSTEM "{doctype_system}"') + ">\n")

    def put(n: Node, scope: dict[str, str], depth: int, mixed: bool, raw: bool) -> None:
        if n.kind == "root":
            for i, c in enumerate(n.children):
                if canonical and c.kind in ("pi", "comment"):
                    before = any(x.kind == "element" for x in n.children[:i])
                    out.append("\n" if before else "")
                    put(c, scope, depth, mixed, raw)
                    out.append("" if before else "\n")
                else:
                    if indent and i and c.kind != "text":
                        out.append("\n")
                    put(c, scope, depth, mixed, raw)
            return
        if n.kind == "text":
            cd = n.parent is not None and (n.parent.ns, n.parent.local) in cdata_elements
            out.append(n.value if raw else _cdata(n.value) if cd and not canonical else _text(n.value, canonical))
            return
        if n.kind == "comment":
            out.append(f"<!--{n.value}-->")
            return
        if n.kind == "pi":
            out.append(f"<?{n.local}{' ' + n.value if n.value else ''}{'>' if html else '?>'}")
            return
        if n.kind == "attribute":
            out.append(f"{n.qname}={_attr(n.value, canonical)}")
            return
        if plain and (n.made == [] or n.made is None and not any("\x01" in x for x in n.given[::2])):
            put_plain(n, scope)
            return
        ns = None if strip else n.ns
        as_html = html and ns is None
        name = n.local if strip or (xhtml and n.ns == XHTML_NS) else n.qname
        decl = {} if strip else _declarations(n, scope)
        out.append(f"<{name}")
        for p, u in sorted(decl.items()):
            if p or u or scope.get("", ""):
                out.append(f" xmlns{':' + p if p else ''}={_attr(u, canonical)}")
        attrs = sorted(n.attrs, key=lambda a: (a.ns or "", a.local)) if canonical else n.attrs
        for a in attrs:
            a_name = a.local if strip else a.qname
            if as_html:
                if a_name.lower() in BOOLEAN and a.value.lower() == a_name.lower():
                    out.append(f" {a_name}")
                    continue
                v = quote(a.value, safe="".join(map(chr, range(33, 127))) + " ") if a_name.lower() in URI_ATTRS else a.value
                v = re.sub(r"&(?!\{)", "&amp;", v).replace('"', "&quot;").replace("\xa0", "&nbsp;")
                out.append(f' {a_name}="{v}"')
            else:
                out.append(f" {a_name}={_attr(a.value, canonical)}")
        low = n.local.lower()
        if as_html and low in VOID:
            out.append(">")
            return
        if not n.children and not canonical and not as_html:
            if xhtml and n.ns in (None, XHTML_NS) and low not in VOID:
                out.append(f"></{name}>")
            else:
                out.append(" />" if xhtml else "/>")
            return
        out.append(">")
        below = {**scope, **decl}
        if as_html or xhtml:  # inside flow content only blocks, comments and instructions start lines, also beside text
            kept = mixed or low in KEPT
            block = indent and not kept and not (low in INLINE)
            starts = [c.kind in ("comment", "pi") or (c.kind == "element" and c.local.lower() not in INLINE) for c in n.children]
            ends = block and n.children and (starts[-1] or (n.children[-1].kind == "text" and not n.children[-1].value.strip()))
        else:
            kept = mixed or any(c.kind == "text" for c in n.children)
            block = ends = indent and n.children and not kept
            starts = [True] * len(n.children)
        for c, first in zip(n.children, starts, strict=True):
            if block and first:
                out.append("\n" + "  " * (depth + 1))
            put(c, below, depth + 1, kept, as_html and low in RAW)
        if ends:
            out.append("\n" + "  " * depth)
        out.append(f"</{name}>")

    put(node, {"xml": XML_NS}, 0, False, False)
    return "".join(out)


class E:
    """An element to feed: name, attributes (optional), content."""

    def __init__(self, name, *content):
        self.name = name
        self.attrs = content[0] if content and isinstance(content[0], dict) else {}
        self.content = content[1:] if content and isinstance(content[0], dict) else content


class NS(E):
    """A namespace declaration to feed inside an element: prefix, URI."""

    def __init__(self, prefix, uri):
        self.prefix, self.uri = prefix, uri


class RAW_XML:
    """Markup to feed as it is."""

    def __init__(self, *text):
        self.text = "".join(text)


def feed(*items, indent: bool = False) -> str:
    """Text of nested E, NS, RAW_XML, strings, numbers, iterables and callables (called without arguments)."""
    out: list[str] = []

    def put(x) -> None:
        if isinstance(x, E):
            decls = [c for c in x.content if isinstance(c, NS)]
            out.append(f"<{x.name}")
            out.extend(f" xmlns{':' + d.prefix if d.prefix else ''}={_attr(d.uri)}" for d in decls)
            out.extend(f" {k}={_attr(str(v))}" for k, v in x.attrs.items())
            rest = [c for c in x.content if not isinstance(c, NS)]
            if not rest:
                out.append("/>")
                return
            out.append(">")
            for c in rest:
                put(c)
            out.append(f"</{x.name}>")
        elif isinstance(x, RAW_XML):
            out.append(x.text)
        elif isinstance(x, str | int | float):
            out.append(_text(str(x)))
        elif callable(x):
            put(x())
        elif x is not None:
            for c in x:
                put(c)

    for x in items:
        put(x)
    return "".join(out)


class Cursor(E):
    """An element that is held open: what is sent later becomes its content."""


class Encoder:
    """Text of fed structures, taken by ``read`` as far as it is written.

    ``cofeed`` writes a structure up to its Cursor and gives an object with ``send`` (content at the cursor) and ``close``
    (the rest of the structure). A structure without a cursor is written whole; what is sent then follows it.
    """

    def __init__(self) -> None:
        self.written: list[str] = []

    def feed(self, *items) -> None:
        self.written.append(feed(*items))

    def read(self) -> str:
        text = "".join(self.written)
        self.written.clear()
        return text

    def cofeed(self, *items) -> "Open":
        mark = "\x00"  # never in markup, so that it can only be the cursor's place
        before, _, after = feed(*_marked(items, mark)).partition(mark)
        self.written.append(before)
        return Open(self, after)


class Open:
    def __init__(self, encoder: Encoder, rest: str) -> None:
        self.encoder, self.rest = encoder, rest

    def send(self, *items) -> None:
        if self.rest is None:
            raise ValueError("closed")
        self.encoder.feed(*items)

    def close(self) -> None:
        if self.rest is not None:
            self.encoder.written.append(self.rest)
            self.rest = None


def _marked(x, mark: str):
    """Structures with a mark as the content of cursors."""
    if isinstance(x, NS | RAW_XML | str | int | float) or x is None:
        return x
    if isinstance(x, E):
        return E(x.name, x.attrs, *[_marked(c, mark) for c in x.content], *([RAW_XML(mark)] if isinstance(x, Cursor) else []))
    if callable(x):
        return _marked(x(), mark)
    return [_marked(c, mark) for c in x]


def feed_rows(df, doc_id: str, build, *columns: str):
    """doc_id, result: for every row the text of what ``build`` makes of a dictionary of the named columns."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    def work(batches):
        for batch in batches:
            rows = batch.select(list(columns)).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([feed(build(r)) for r in rows], pa.string())], names=["doc_id", "result"])

    return df.select(F.col(doc_id).cast("long").alias("_doc"), *columns).mapInArrow(work, "doc_id long, result string")
