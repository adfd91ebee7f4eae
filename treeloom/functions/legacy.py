"""The older built-in extension functions as Column expressions; those that start processes are left out on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ends_with(s: Column, end: Column) -> Column:
    return F.endswith(s, end)


def escape_xml(s: Column) -> Column:
    return F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def choose(test: Column, yes: Column, no: Column | None = None) -> Column:
    return F.when(test, yes).otherwise(F.lit("") if no is None else no)


def number_range(lo: Column, hi: Column) -> Column:
    """lo, lo + 1 ... below hi; empty if hi isn't above lo."""
    return F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<bigint>"))


def sha_hash(s: Column) -> Column:
    return F.sha1(s.cast("binary"))


def join(parts: Column, delimiter: str = " ") -> Column:
    return F.array_join(parts, delimiter)


def indent(s: Column, levels: int, by: str = "  ") -> Column:
    return F.concat(F.lit(by * levels), F.replace(s, F.lit("\n"), F.lit("\n" + by * levels)))


def normalize_eol(s: Column) -> Column:
    return F.regexp_replace(s, "\r\n?", "\n")


def wrap(s: Column, width: int) -> Column:
    """Lines of at most width characters, broken at spaces; longer words stay whole."""
    return F.regexp_replace(s, rf"(.{{1,{width}}})(?:\s+|$)|(\S{{{width},}})\s*", "$1$2\n")


def generate_uuid() -> Column:
    return F.expr("uuid()")


def radians(degrees: Column) -> Column:
    return F.radians(degrees)


def factorial(n: Column) -> Column:
    return F.factorial(n.cast("int"))


def inject(s: Column, pattern: str, element: str) -> Column:
    """Text with every match of a pattern put into an element; the rest is escaped."""
    return F.regexp_replace(escape_xml(s), pattern, f"<{element}>$0</{element}>")


def template(text: str, **values: Column) -> Column:
    """$name and ${name} by values; $$ is a dollar; unknown names stay."""
    import re

    out, at = [], 0
    for m in re.finditer(r"\$(?:(\$)|(\w+)|\{(\w+)\})", text):
        out.append(F.lit(text[at : m.start()]))
        name = m[2] or m[3]
        out.append(F.lit("$") if m[1] else values[name].cast("string") if name in values else F.lit(m[0]))
        at = m.end()
    return F.concat(*out, F.lit(text[at:]))


def allowed(uri: Column, prefixes: tuple[str, ...]) -> Column:
    """Is a URI, without dot segments, below one of the allowed prefixes?"""
    from .iri import normalize_path

    clean, ok = normalize_path(uri), F.lit(False)
    for p in prefixes:
        ok = ok | F.startswith(clean, F.lit(p))
    return ok
