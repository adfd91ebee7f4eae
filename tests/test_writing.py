"""XML written straight from what the parser gave is what is written of nodes."""

from treeloom.sources import tree
from treeloom.sources.serialize import serialize
from treeloom.sources.tree import Node


def test_writing_attributes_that_are_no_nodes():
    for text in ['<a y="1" x="&lt;&quot;&#9;"><b/>t&amp;&gt;<!--c--><c z="1">\r</c></a>', '<p:a xmlns:p="u" xmlns="v" p:x="1" b="2"><c xmlns=""/><d b="1" a="2">x</d></p:a>']:
        for method in ("xml", "xml-canonical"):
            asked = tree.parse_xml(text)
            assert all(isinstance(a, Node) for n in asked.walk() for a in n.attrs)
            for n in asked.walk():
                n.made = n.made and list(n.made)
            full = serialize(asked, method, cdata_elements=frozenset({(None, "none")}))
            assert serialize(tree.parse_xml(text), method) == serialize(asked, method) == full


def test_writing_makes_no_attribute_nodes():
    root = tree.parse_xml('<a y="1" x="2"><b z="3"/></a>')
    assert serialize(root, "xml-canonical") == '<a x="2" y="1"><b z="3"></b></a>'
    assert all(n.made is None for n in root.walk() if n.kind == "element")
