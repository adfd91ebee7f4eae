"""Documents as trees inside a Python worker: parsing XML and tag-soup HTML, and walking the result.

One document is one task's matter: everything that needs a whole document in hand (parsing, templates, updates,
serialising) uses these nodes, and everything else works on the rows that ``shred`` makes of them.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser
from types import MappingProxyType
from xml.parsers import expat

XML_NS = "http://www.w3.org/XML/1998/namespace"
XHTML_NS = "http://www.w3.org/1999/xhtml"
NOTHING: MappingProxyType = MappingProxyType({})


class Node:
    """kind: root, element, attribute, text, comment, pi or namespace. Attributes of parsed elements become nodes when they are asked for."""

    __slots__ = ("kind", "ns", "local", "prefix", "value", "parent", "children", "made", "given", "nsdecl", "pre", "last", "is_id", "doc")

    def __init__(self, kind, ns=None, local=None, prefix=None, value=None, parent=None, doc=None, pre=-1):
        self.kind, self.ns, self.local, self.prefix, self.value = kind, ns, local, prefix, value
        self.parent, self.doc = parent, doc
        self.pre = self.last = pre
        self.is_id = False
        self.given = None  # names and values in turn, as the parser gives them, until they are made nodes
        if kind == "element" or kind == "root":
            self.children: list[Node] | tuple = []
            self.made: list[Node] | tuple | None = []
            self.nsdecl: dict[str, str] = {}
        else:
            self.children = self.made = ()
            self.nsdecl = NOTHING

    @property
    def attrs(self) -> "list[Node] | tuple":
        if self.made is None:
            self.made = []
            for j, name in enumerate(self.given[::2]):
                ns, local, prefix = _split(name)
                a = Node("attribute", ns, local, prefix or ("xml" if ns == XML_NS else None), self.given[2 * j + 1], self, self.doc, self.pre + 1 + j)
                a.is_id = ns == XML_NS and local == "id"
                self.made.append(a)
            self.given = None
        return self.made

    @attrs.setter
    def attrs(self, nodes: "list[Node]") -> None:
        self.made, self.given = nodes, None

    @property
    def qname(self) -> str:
        return f"{self.prefix}:{self.local}" if self.prefix else (self.local or "")

    def add(self, child: "Node", at: int | None = None) -> "Node":
        child.parent = self
        if self.children == ():
            self.children = []
        if at is None:
            self.children.append(child)
        else:
            self.children.insert(at, child)
        return child

    def set_attr(self, ns, local, prefix, value) -> "Node":
        for a in self.attrs:
            if a.ns == ns and a.local == local:
                a.value = value
                return a
        a = Node("attribute", ns, local, prefix, value)
        a.parent = self
        if self.attrs == ():
            self.made = []
        self.attrs.append(a)
        return a

    def get(self, local, ns=None):
        if self.made is None and ns is None:
            given = self.given
            for j in range(0, len(given), 2):
                if given[j] == local:  # names in a namespace have a separator
                    return given[j + 1]
            return None
        for a in self.attrs:
            if a.local == local and a.ns == ns:
                return a.value
        return None

    def text(self) -> str:
        """XPath string value."""
        if self.kind == "element" or self.kind == "root":
            kids = self.children
            if len(kids) == 1 and kids[0].kind == "text":
                return kids[0].value
            return "".join([n.value for n in self.walk() if n.kind == "text"])
        return self.value or ""

    def walk(self):
        """This node and its descendants in document order, without attributes."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            if n.children:
                stack.extend(reversed(n.children))

    def below(self) -> "list[Node]":
        """Descendants in document order, without attributes."""
        out, stack = [], list(self.children[::-1])
        while stack:
            n = stack.pop()
            out.append(n)
            kids = n.children
            if len(kids) == 1 and not kids[0].children:
                out.append(kids[0])
            elif kids:
                stack += kids[::-1]
        return out

    def root(self) -> "Node":
        n = self
        while n.parent is not None:
            n = n.parent
        return n

    def namespaces(self) -> dict[str, str]:
        """In-scope prefixes; '' is the default namespace."""
        out: dict[str, str] = {}
        n = self if self.kind in ("element", "root") else self.parent
        while n is not None:
            for p, u in n.nsdecl.items():
                out.setdefault(p, u)
            n = n.parent
        out = {p: u for p, u in out.items() if u}
        out.setdefault("xml", XML_NS)
        return out

    def number(self) -> "Node":
        """Give pre and last numbers to the whole tree below this root: attributes follow their element."""
        k = 0
        stack: list[tuple[Node, bool]] = [(self, False)]
        while stack:
            n, done = stack.pop()
            if done:
                n.last = k - 1
                continue
            n.pre = k
            n.doc = self
            k += 1
            if n.made != ():
                for a in n.attrs:
                    a.pre = a.last = k
                    a.doc = self
                    k += 1
            if not n.children:
                n.last = k - 1
                continue
            stack.append((n, True))
            stack += [(c, False) for c in n.children[::-1]]
        return self

    def copy(self) -> "Node":
        new = Node(self.kind, self.ns, self.local, self.prefix, self.value)
        if self.nsdecl:
            new.nsdecl = dict(self.nsdecl)
        for a in self.attrs:
            new.set_attr(a.ns, a.local, a.prefix, a.value).is_id = a.is_id
        for c in self.children:
            new.add(c.copy())
        return new

    def detach(self) -> None:
        p = self.parent
        if p is not None:
            (p.attrs if self.kind == "attribute" else p.children).remove(self)
            self.parent = None


class ParseError(ValueError):
    def __init__(self, code: int, line: int, column: int, message: str):
        super().__init__(message)
        self.code, self.line, self.column, self.message = code, line, column, message


@lru_cache(maxsize=8192)
def _split(name: str) -> tuple[str | None, str, str | None]:
    parts = name.split("\x01")
    if len(parts) == 1:
        return None, parts[0], None
    return parts[0], parts[1], parts[2] if len(parts) > 2 else None


#: What varies among documents of one shape: plain attribute values, and plain text between two tags.
_VARIES = re.compile('("[^"<&\\x00-\\x1f\\ud800-\\udfff\\ufffe\\uffff]*"|>[^<>&\\x00-\\x08\\x0b-\\x1f\\ud800-\\udfff\\ufffe\\uffff]+<)')
#: Shapes kept, the longest document looked at, and how many documents that meet no known shape are borne before shapes are left alone for a while.
SHAPES, LONGEST, PATIENCE, PAUSE = 512, 20_000, 300, 5_000


class _Shapes:
    """Builders of trees by shape, that is a document without its values. A shape is learnt from a parsed document when it comes a second time."""

    def __init__(self) -> None:
        self.known: dict[str, tuple | None] = {}
        self.patience, self.pause = PATIENCE, 0

    def parse(self, text: str) -> Node:
        if self.pause:
            self.pause -= 1
            return _parsed(text)
        parts = _VARIES.split(text)
        values, shape = parts[1::2], "\0".join(parts[::2])
        found = self.known.get(shape, 0)
        if found:
            first, build = found
            if first == "".join([v[0] for v in values]):
                self.patience = PATIENCE
                return build(Node, values)
        root = _parsed(text)
        if found == 0:
            self.patience -= 1
            if self.patience < 0:
                self.patience, self.pause = PATIENCE, PAUSE
            if len(self.known) >= SHAPES:
                self.known.clear()
            self.known[shape] = ()
        elif found == ():
            self.known[shape] = self.learnt(shape, values, root)
        return root

    @staticmethod
    def learnt(shape: str, values: list[str], root: Node) -> tuple | None:
        """What the values begin with, and a function that makes a tree of such values; None if other values could mean another tree."""
        if any(x in shape for x in ("xmlns", "&", "'", "!", "?")):
            return None
        code, met, names, made = [], [], {id(root): "r"}, {}
        for n in root.walk():
            if n is root:
                continue
            name = names[id(n)] = f"n{n.pre}"
            made.setdefault(id(n.parent), []).append(name)
            up = names[id(n.parent)]
            if n.kind == "text":
                code.append(f"{name} = N('text', None, None, None, v[{len(met)}][1:-1], {up}, r, {n.pre})")
                met.append(f">{n.value}<")
                continue
            code.append(f"{name} = N('element', {n.ns!r}, {n.local!r}, {n.prefix!r}, None, {up}, r, {n.pre}); {name}.last = {n.last}")
            if given := n.given or []:
                code.append(f"{name}.made = None; {name}.given = [" + ", ".join(f"{given[j]!r}, v[{len(met) + j // 2}][1:-1]" for j in range(0, len(given), 2)) + "]")
                met += [f'"{x}"' for x in given[1::2]]
        if met != values:
            return None
        code += [f"{names[k]}.children = [{', '.join(x)}]" for k, x in made.items()]
        scope: dict = {}
        exec("def build(N, v):\n r = N('root', pre=0); r.doc = r; r.last = %d\n %s\n return r" % (root.last, "\n ".join(code)), scope)  # noqa: S102
        return "".join([v[0] for v in values]), scope["build"]


_shapes = _Shapes()


def parse_xml(text: str | bytes, validate_ids: bool = True) -> Node:
    """Tree of a document, numbered as by ``number``; external entities are never fetched. Raises ParseError with code and position."""
    return _shapes.parse(text) if isinstance(text, str) and len(text) <= LONGEST else _parsed(text)


def _parsed(text: str | bytes) -> Node:
    root = Node("root")
    root.pre, root.doc = 0, root
    here = root
    held: list[str] = []
    pending: dict[str, str] = {}
    ids: set[tuple[str, str]] = set()
    k = 1  # the next node's number
    p = expat.ParserCreate(namespace_separator="\x01")
    p.namespace_prefixes = True
    p.buffer_text = True
    p.ordered_attributes = True

    def leaf(kind: str, local: str | None, value: str):
        nonlocal k
        here.children.append(Node(kind, None, local, None, value, here, root, k))
        k += 1

    def flush():
        if held:
            leaf("text", None, held[0] if len(held) == 1 else "".join(held))
            held.clear()

    def start(name, attrs):
        nonlocal here, k
        if held:
            flush()
        ns, local, prefix = _split(name)
        e = Node("element", ns, local, prefix, None, here, root, k)
        k += 1
        if pending:
            e.nsdecl = dict(pending)
            pending.clear()
        if attrs:
            k += len(attrs) // 2  # the parser refuses a name that comes twice
            e.given, e.made = attrs, None
            if ids:
                for a in e.attrs:
                    a.is_id = a.is_id or (e.qname, a.qname) in ids
        here.children.append(e)
        here = e

    def end(name):
        nonlocal here
        if held:
            flush()
        here.last = k - 1
        here = here.parent

    def declare(prefix, uri):
        pending[prefix or ""] = uri or ""

    def attlist(element, name, kind, default, required):
        if kind == "ID":
            ids.add((element, name))

    def comment(data):
        flush()
        leaf("comment", None, data)

    def pi(target, data):
        flush()
        leaf("pi", target, data)

    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, held.append
    p.StartNamespaceDeclHandler, p.CommentHandler, p.ProcessingInstructionHandler = declare, comment, pi
    p.AttlistDeclHandler = attlist
    in_dtd = [False]

    def doctype(name, system, public, internal):
        in_dtd[0] = True
        p.CommentHandler = p.ProcessingInstructionHandler = None

    def doctype_end():
        p.CommentHandler, p.ProcessingInstructionHandler = comment, pi

    p.StartDoctypeDeclHandler, p.EndDoctypeDeclHandler = doctype, doctype_end
    try:
        p.Parse(text.encode("utf-8") if isinstance(text, str) else text, True)
    except expat.ExpatError as e:
        raise ParseError(e.code, e.lineno, e.offset, expat.ErrorString(e.code)) from None
    root.last = k - 1
    return root


def parse_fragment(text: str, prefixes: dict[str, str] | None = None) -> list[Node]:
    """The nodes of an external parsed entity, in the scope of the given prefixes."""
    decl = "".join(f' xmlns{":" + p if p else ""}="{u}"' for p, u in (prefixes or {}).items() if p != "xml")
    top = parse_xml(f"<f{decl}>{text}</f>").children[0]
    out = list(top.children)
    for n in out:
        n.parent = None
        if n.kind == "element":
            n.nsdecl = {**top.nsdecl, **n.nsdecl}
    return out


# HTML elements without content, and which open elements a start tag ends.
VOID = frozenset("area base basefont br col embed frame hr img input isindex link meta param source track wbr".split())
P_ENDERS = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
BAD_XML = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")


class _Soup(HTMLParser):
    def __init__(self, ns):
        super().__init__(convert_charrefs=True)
        self.ns = ns
        self.top = Node("root")
        self.open: list[Node] = [self.top]
        self.html = self.head = self.body = None

    def _element(self, tag, attrs=()):
        e = Node("element", self.ns, tag)
        for k, v in attrs:
            name = re.sub(r"[^\w.-]", "_", k)
            e.set_attr(None, name if re.match(r"[^\W\d]|_", name) else f"_{name}", None, BAD_XML.sub("", v if v is not None else k))
        return e

    def _ensure(self, where):
        if self.html is None:
            self.html = self.top.add(self._element("html"))
            self.open = [self.top, self.html]
        if where == "head" and self.head is None and self.body is None:
            self.head = self.html.add(self._element("head"))
            self.open = [self.top, self.html, self.head]
        if where == "body" and self.body is None:
            self.body = self.html.add(self._element("body"))
            self.open = [self.top, self.html, self.body]

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "head", "body"):
            self._ensure("html")
            if tag == "head":
                self._ensure("head")
            if tag == "body":
                self._ensure("body")
            known = {"html": self.html, "head": self.head, "body": self.body}[tag]
            if known is not None:
                for a in self._element(tag, attrs).attrs:
                    if known.get(a.local) is None:
                        known.set_attr(None, a.local, None, a.value)
            return
        self._ensure("head" if tag in HEAD_ONLY and self.body is None else "body")
        if tag in P_ENDERS:
            self._close(("p",), P_ENDERS - {"p"} | {"body", "td", "th", "button"})
        if tag in SIBLINGS:
            for _ in SIBLINGS[tag]:
                if not self._close(SIBLINGS[tag], SCOPE[tag]):
                    break
        e = self.open[-1].add(self._element(tag, attrs))
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and len(self.open) > 1 and self.open[-1].local == tag:
            self.open.pop()

    def _close(self, names, stop):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].local in names:
                del self.open[k:]
                return True
            if self.open[k].local in stop or self.open[k] in (self.html, self.head, self.body):
                return False
        return False

    def handle_endtag(self, tag):
        if tag in ("html", "body") or tag in VOID:
            return
        if tag == "head":
            if self.head is not None and self.head in self.open:
                del self.open[self.open.index(self.head) :]
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k] in (self.html, self.body):
                return
            if self.open[k].local == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        if not data.strip() and (self.body is None and (self.head is None or self.open[-1] is self.head)):
            return
        if self.open[-1].local not in HEAD_ONLY:
            self._ensure("body")
        data = BAD_XML.sub("", data)
        here = self.open[-1]
        if here.children and here.children[-1].kind == "text":
            here.children[-1].value += data
        elif data:
            here.add(Node("text", value=data))

    def handle_comment(self, data):
        self.open[-1].add(Node("comment", value=BAD_XML.sub("", data)))


def parse_html(text: str, use_xhtml_ns: bool = False) -> Node:
    """Tree of a page; never fails. Missing html, head and body are made up, open elements are ended."""
    soup = _Soup(XHTML_NS if use_xhtml_ns else None)
    soup.feed(text)
    soup.close()
    soup._ensure("html")
    soup._ensure("head")
    soup._ensure("body")
    return soup.top.number()


def parse_html_fragment(text: str) -> Node:
    return next(n for n in parse_html(text).walk() if n.kind == "element" and n.local == "body")
