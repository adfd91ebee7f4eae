"""EXSLT string functions and XML name tests as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME_START = r"A-Z_a-zÀ-ÖØ-öø-˿Ͱ-ͽͿ-῿‌-‍⁰-↏Ⰰ-⿯、-퟿"
NAME_CHAR = NAME_START + r"\-.0-9·̀-ͯ‿-⁀"
SPACES = " \t\r\n"


def align(target: Column, padding: Column, how: str = "left") -> Column:
    """target laid over padding at its left, right or centre; cut to padding's length."""
    t, p = F.length(target), F.length(padding)
    room = p - t
    left = F.lit(0) if how == "left" else room if how == "right" else F.floor(room / 2).cast("int")
    laid = F.concat(F.substring(padding, F.lit(1), F.greatest(left, F.lit(0))), target, F.substring(padding, left + t + 1, F.greatest(room - left, F.lit(0))))
    return F.when(t >= p, F.substring(target, F.lit(1), p)).otherwise(laid)


def padding(n: Column, chars: Column | None = None) -> Column:
    """The characters of chars (a space) over and over, n in all."""
    c = F.lit(" ") if chars is None else chars
    n = F.greatest(F.floor(n + 0.5).cast("int"), F.lit(0))
    return F.when(F.length(c) == 0, F.lit("")).otherwise(F.substring(F.repeat(c, F.ceil(n / F.greatest(F.length(c), F.lit(1))).cast("int")), F.lit(1), n))


def encode_uri(s: Column, reserved_too: bool = True) -> Column:
    """Percent-encode; without reserved_too the reserved characters stay."""
    out = F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))
    keep = {"%21": "!", "%27": "'", "%28": "(", "%29": ")", "%2A": "*", "%7E": "~"}
    if not reserved_too:
        keep |= {"%3B": ";", "%2F": "/", "%3F": "?", "%3A": ":", "%40": "@", "%26": "&", "%3D": "=", "%2B": "+", "%24": "$", "%2C": ",", "%5B": "[", "%5D": "]"}
    for code, char in keep.items():
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def decode_uri(s: Column) -> Column:
    """Percent-decode as UTF-8; a plus stays a plus; '' for an invalid code."""
    return F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), F.lit(""))


def replace_all(s: Column, pairs: list[tuple[str, str]]) -> Column:
    """Every search string by its partner in one pass, longest first; replacements aren't searched again."""
    ordered = sorted([(a, b) for a, b in pairs if a], key=lambda x: -len(x[0]))
    if not ordered:
        return s
    marks = {a: chr(0xE000 + i) for i, (a, _) in enumerate(ordered)}
    for a, _ in ordered:
        s = F.replace(s, F.lit(a), F.lit(marks[a]))
    for a, b in ordered:
        s = F.replace(s, F.lit(marks[a]), F.lit(b))
    return s


def split(s: Column, sep: str = " ") -> Column:
    """Parts between occurrences of the literal sep; '' gives the characters."""
    quoted = "\\Q" + sep.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    parts = F.split(s, quoted if sep else "", -1)
    return F.filter(parts, lambda x: x != "")


def tokenize(s: Column, delimiters: str = "\t\r\n ") -> Column:
    """Parts between delimiter characters, empty ones dropped; '' gives the characters."""
    if not delimiters:
        return split(s, "")
    chars = "".join("\\" + c if c in "\\]^-[&" else c for c in delimiters)
    return F.filter(F.split(s, f"[{chars}]", -1), lambda x: x != "")


def concat_ordered(order: Column, value: Column) -> Column:
    """Aggregate: values joined in the order of another column."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]), "")


def lstrip(s: Column) -> Column:
    return F.ltrim(s, F.lit(SPACES))


def rstrip(s: Column) -> Column:
    return F.rtrim(s, F.lit(SPACES))


def strip(s: Column) -> Column:
    return F.btrim(s, F.lit(SPACES))


def is_space(s: Column) -> Column:
    return s.rlike(r"\A[ \t\r\n]+\z")


def is_ncname(s: Column) -> Column:
    return s.rlike(rf"\A[{NAME_START}][{NAME_CHAR}]*\z")


def is_name(s: Column) -> Column:
    return s.rlike(rf"\A[{NAME_START}:][{NAME_CHAR}:]*\z")


def is_nmtoken(s: Column) -> Column:
    return s.rlike(rf"\A[{NAME_CHAR}:]+\z")


def is_qname(s: Column) -> Column:
    return s.rlike(rf"\A(?:[{NAME_START}][{NAME_CHAR}]*:)?[{NAME_START}][{NAME_CHAR}]*\z")


def split_qname(s: Column) -> Column:
    """struct<prefix, local>."""
    has = F.contains(s, F.lit(":"))
    return F.struct(F.when(has, F.substring_index(s, ":", 1)).alias("prefix"), F.when(has, F.substring_index(s, ":", -1)).otherwise(s).alias("local"))


def legalize(s: Column, by: str = "?") -> Column:
    """Characters that XML forbids replaced."""
    return F.regexp_replace(s, "[^\\t\\n\\r\\x20-\\x{D7FF}\\x{E000}-\\x{FFFD}\\x{10000}-\\x{10FFFF}]", by)


def python_name(s: Column, reserved: tuple[str, ...] = ()) -> Column:
    """XML name to an identifier: other characters to _, and _ appended to reserved words."""
    name = F.regexp_replace(s, r"[^0-9A-Za-z_]", "_")
    return F.when(name.isin(*reserved), F.concat(name, F.lit("_"))).otherwise(name) if reserved else name


def pseudo_attributes(s: Column) -> Column:
    """map of a processing instruction's name="value" parts."""
    pattern = r"""([\w.:-]+)\s*=\s*("[^"]*"|'[^']*')"""
    keys, values = F.regexp_extract_all(s, F.lit(pattern), F.lit(1)), F.regexp_extract_all(s, F.lit(pattern), F.lit(2))
    return F.map_from_arrays(keys, F.transform(values, lambda v: F.substring(v, F.lit(2), F.length(v) - 2)))


def regex_test(s: Column, pattern: str, flags: str = "") -> Column:
    return s.rlike(("(?i)" if "i" in flags else "") + pattern)


def regex_match(s: Column, pattern: str, flags: str = "") -> Column:
    """With g all matches; without, the first match and then its groups (empty array if there is none)."""
    import re

    p = ("(?i)" if "i" in flags else "") + pattern
    if "g" in flags:
        return F.regexp_extract_all(s, F.lit(p), F.lit(0))
    groups = re.compile(pattern).groups
    return F.when(s.rlike(p), F.array(*[F.regexp_extract(s, p, k) for k in range(groups + 1)])).otherwise(F.array().cast("array<string>"))


def regex_replace(s: Column, pattern: str, flags: str, by: str) -> Column:
    r"""\1 in ``by`` is a group; without g only the first match is replaced."""
    import re

    p = ("(?i)" if "i" in flags else "") + pattern
    java = re.sub(r"\\(\d)", r"$\1", by.replace("$", "\\$"))
    return F.regexp_replace(s, p, java) if "g" in flags else _first_only(s, p, java)


def _first_only(s: Column, p: str, java: str) -> Column:
    at = F.call_function("regexp_instr", s, F.lit(p))
    hit = F.regexp_extract(s, p, 0)
    head, rest = F.substring(s, F.lit(1), at - 1), F.substring(s, at + F.length(hit), F.length(s))
    return F.when(at == 0, s).otherwise(F.concat(head, F.regexp_replace(hit, p, java), rest))
