"""Documents of a known shape give the trees that the parser gives."""

import random

from tests.test_xpath import DOCS
from treeloom.sources import tree
from treeloom.sources.serialize import serialize
from treeloom.sources.tree import ParseError

VALUES = ["", "1", "a b", " ", ">", "]]>", "]", "'", '"', "&amp;", "&#10;", "&", "<", "<b/>", "\t", "\n", "\r", "\x00", "\x01", "\x7f", " ", "￾", "\ud800", "é\U0001f600", 'x"y', "' x='", '" x="', "<!--c-->", "<![CDATA[<]]>", "<?p?>", "\\", "{0}", "%s", "</a>", "</b><b>", '"/><b x="', "="]
FORMS = ['<a x="{}"><b y="{}" z="2">{}</b>{}<b/></a>', "<a x='{}'><b y=\"{}\">{}</b>{}</a>", '<p:a xmlns:p="{}" xmlns="u" p:x="{}">{}<p:b/>{}</p:a>', '<a xml:id="{}" y = "{}" >{}\n<b\n/> {}</a>\n', '<!DOCTYPE a [<!ATTLIST a k ID #IMPLIED>]><a k="{}" y="{}">{}{}</a>', '<a x={}><b>{}</b>{}{}</a>', '<a x="{}" x="{}">{}{}</a>', '<a x="{}"y="{}">{}{}</a>', '<a x="1"{}"2"><b {}>{}</a>{}']


def seen(parse, text):
    try:
        root = parse(text)
    except ParseError as e:
        return e.code, e.line, e.column
    except UnicodeEncodeError:
        return "not text"
    own = lambda n: (n.kind, n.ns, n.local, n.prefix, n.value, n.pre, n.last, n.is_id, n.doc is root, dict(n.nsdecl))
    return [(own(n), [(own(a), a.parent is n) for a in n.attrs], n.parent and n.parent.pre, [c.pre for c in n.children]) for n in root.walk()]


def test_shapes_give_the_parsers_trees(monkeypatch):
    rng, built = random.Random(3), []
    monkeypatch.setattr(tree, "_shapes", tree._Shapes())
    monkeypatch.setattr(tree, "PATIENCE", 10**9)
    tree._shapes.patience = 10**9
    parsed = tree._parsed
    monkeypatch.setattr(tree, "_parsed", lambda text: built.append(text) or parsed(text))
    texts = [f.format(*(rng.choice(VALUES) if rng.random() < 0.3 else str(rng.randrange(99)) for _ in range(4))) for f in FORMS for _ in range(1500)]
    for text in [*DOCS * 3, *texts]:
        assert seen(tree.parse_xml, text) == seen(parsed, text), repr(text)
    assert 1000 < len(built) < 13_000  # some were made by shape, and some could not be


def test_orders_are_parsed_by_shape(monkeypatch):
    monkeypatch.setattr(tree, "_shapes", tree._Shapes())
    asked, parsed = [], tree._parsed
    monkeypatch.setattr(tree, "_parsed", lambda text: asked.append(1) or parsed(text))
    for k in range(1000):
        text = f'<order id="{k}"><total>{k}.5</total>' + f'<item line="{k}"><qty>{k % 50}</qty></item>' * (k % 7) + "</order>"
        assert serialize(tree.parse_xml(text)) == text
    assert len(asked) == 14
    tree._shapes.pause = 0
    for k in range(4000):  # shapes that don't come again are soon left alone
        tree.parse_xml("<a>" + "<b/>" * k + "</a>") if k < 2000 else None
    assert len(tree._shapes.known) <= tree.SHAPES and tree._shapes.pause > 0
