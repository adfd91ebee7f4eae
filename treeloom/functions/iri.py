"""URI reference algebra (RFC 3986) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

REFERENCE = r"\A(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?\z"
HAS_SCHEME = r"\A[A-Za-z][A-Za-z0-9+.-]*:"
HAS_AUTHORITY = r"\A(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"


def split(u: Column) -> Column:
    """struct<scheme, authority, path, query, fragment>; parts that aren't there are null, path is ''."""
    g = lambda k: F.regexp_extract(u, REFERENCE, k)
    return F.struct(
        F.when(u.rlike(HAS_SCHEME), g(1)).alias("scheme"),
        F.when(u.rlike(HAS_AUTHORITY), g(2)).alias("authority"),
        g(3).alias("path"),
        F.when(u.rlike(r"\A[^#?]*\?"), g(4)).alias("query"),
        F.when(F.contains(u, F.lit("#")), g(5)).alias("fragment"),
    )


def unsplit(scheme: Column, authority: Column, path: Column, query: Column, fragment: Column) -> Column:
    piece = lambda before, c, after="": F.coalesce(F.concat(F.lit(before), c, F.lit(after)), F.lit(""))
    return F.concat(piece("", scheme, ":"), piece("//", authority), path, piece("?", query), piece("#", fragment))


def scheme(u: Column) -> Column:
    return split(u)["scheme"]


def fragment(u: Column) -> Column:
    return split(u)["fragment"]


def strip_fragment(u: Column) -> Column:
    return F.regexp_replace(u, r"#[\s\S]*\z", "")


def authority(u: Column) -> Column:
    """struct<userinfo, host, port> of the authority."""
    a = split(u)["authority"]
    host_port = F.regexp_replace(a, r"\A[^@]*@", "")
    return F.struct(
        F.when(F.contains(a, F.lit("@")), F.substring_index(a, "@", 1)).alias("userinfo"),
        F.regexp_replace(host_port, r":[0-9]*\z", "").alias("host"),
        F.when(host_port.rlike(r":[0-9]+\z"), F.regexp_extract(host_port, r":([0-9]+)\z", 1)).alias("port"),
    )


def is_absolute(u: Column) -> Column:
    return u.rlike(HAS_SCHEME)


def is_uri_reference(u: Column) -> Column:
    return u.rlike(r"\A(?:[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=]|%[0-9A-Fa-f]{2})*\z") & ~u.rlike(r"#.*#")


def percent_encode(s: Column) -> Column:
    """All but the unreserved characters as UTF-8 octets."""
    out = F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(out, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def percent_decode(s: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)


def remove_dot_segments(path: Column) -> Column:
    """. and .. segments resolved; empty segments stay; a leading .. stays in a relative path."""
    absolute = F.startswith(path, F.lit("/"))
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)
    closing = last.isin(".", "..")

    def put(acc: Column, p: Column) -> Column:
        can_pop = (F.size(acc) > 1) | ((F.size(acc) == 1) & ~absolute)
        pops = can_pop & (F.element_at(F.concat(F.array(F.lit("")), acc), -1) != "..")
        return (
            F.when(p == ".", acc)
            .when((p == "..") & pops, F.slice(acc, 1, F.size(acc) - 1))
            .when((p == "..") & absolute, acc)
            .otherwise(F.concat(acc, F.array(p)))
        )

    def ended(kept: Column) -> Column:
        stuck = (last == "..") & (F.element_at(F.concat(F.array(F.lit("")), kept), -1) == "..")
        return F.array_join(F.when(closing & ~stuck, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")

    out = F.aggregate(parts, F.array().cast("array<string>"), put, ended)
    return F.when(path == "", path).when(absolute & ~F.startswith(out, F.lit("/")), F.concat(F.lit("/"), out)).otherwise(out)


def absolutize(ref: Column, base: Column) -> Column:
    """The reference resolved against an absolute base; null if the base isn't absolute."""

    def resolve(r: Column, b: Column) -> Column:
        merged = F.when(b["authority"].isNotNull() & (b["path"] == ""), F.concat(F.lit("/"), r["path"])).otherwise(F.concat(F.regexp_extract(b["path"], r"\A(.*/)?", 0), r["path"]))
        own = r["scheme"].isNotNull()
        net = own | r["authority"].isNotNull()
        same_path = ~net & (r["path"] == "")
        raw = F.when(net | F.startswith(r["path"], F.lit("/")), r["path"]).otherwise(merged)
        path = F.when(same_path, b["path"]).otherwise(let(raw, remove_dot_segments))
        query = F.when(same_path & r["query"].isNull(), b["query"]).otherwise(r["query"])
        return unsplit(F.when(own, r["scheme"]).otherwise(b["scheme"]), F.when(net, r["authority"]).otherwise(b["authority"]), path, query, r["fragment"])

    resolved = let(F.struct(split(ref).alias("r"), split(base).alias("b")), lambda x: resolve(x["r"], x["b"]))
    return F.when(is_absolute(base), resolved)


def relativize(target: Column, base: Column) -> Column:
    """Shortest relative reference from base to target; null unless scheme and authority are equal."""
    none = F.lit(None).cast("string")

    def steps(x: Column) -> Column:
        tp, bp = x["tp"], x["bp"]
        folders = F.least(F.size(tp), F.size(bp)) - 1
        common = F.aggregate(F.sequence(F.lit(0), F.greatest(folders, F.lit(1)) - 1), F.lit(0), lambda acc, i: F.when((acc == i) & (i < folders) & (F.get(tp, i) == F.get(bp, i)), acc + 1).otherwise(acc))
        return let(common, lambda c: F.concat(F.repeat(F.lit("../"), F.size(bp) - 1 - c), F.array_join(F.slice(tp, c + 1, F.size(tp)), "/")))

    def shown(x: Column) -> Column:
        t, b = x["t"], x["b"]
        same = t["scheme"].eqNullSafe(b["scheme"]) & t["authority"].eqNullSafe(b["authority"])
        here = (t["path"] == b["path"]) & (t["query"].isNotNull() | b["query"].isNull())
        climb = let(F.struct(F.split(t["path"], "/", -1).alias("tp"), F.split(b["path"], "/", -1).alias("bp")), steps)
        path = let(climb, lambda p: F.when(here, F.lit("")).when(p == "", F.lit("./")).when(p.rlike(r"\A[^/]*:"), F.concat(F.lit("./"), p)).otherwise(p))
        return F.when(same, unsplit(none, none, path, t["query"], t["fragment"]))

    return let(F.struct(split(target).alias("t"), split(base).alias("b")), shown)


def normalize_case(u: Column, host: bool = False) -> Column:
    """Scheme lower, percent octets upper, host lower on request."""
    out = let(split(u), lambda s: unsplit(F.lower(s["scheme"]), F.lower(s["authority"]) if host else s["authority"], s["path"], s["query"], s["fragment"]))
    parts = F.split(out, "%", -1)
    return F.array_join(F.transform(parts, lambda p, i: F.when((i > 0) & p.rlike(r"\A[0-9A-Fa-f]{2}"), F.concat(F.upper(F.substring(p, 1, 2)), F.substring(p, F.lit(3), F.length(p)))).otherwise(p)), "%")


def normalize_percent(u: Column) -> Column:
    """Octets of unreserved characters decoded."""
    def one(p: Column, i: Column) -> Column:
        code = F.conv(F.substring(p, 1, 2), 16, 10).cast("int")
        char = F.chr(code)
        plain = (i > 0) & p.rlike(r"\A[0-9A-Fa-f]{2}") & char.rlike(r"\A[A-Za-z0-9\-._~]\z")
        return F.when(plain, F.concat(char, F.substring(p, F.lit(3), F.length(p)))).when(i > 0, F.concat(F.lit("%"), p)).otherwise(p)

    return F.array_join(F.transform(F.split(u, "%", -1), one), "")


def normalize_path(u: Column) -> Column:
    return F.when(is_absolute(u), let(split(u), lambda s: unsplit(s["scheme"], s["authority"], let(s["path"], remove_dot_segments), s["query"], s["fragment"]))).otherwise(u)


def public_id_to_urn(p: Column) -> Column:
    """RFC 3151."""
    out = F.trim(F.regexp_replace(p, r"[ \t\r\n]+", " "))
    for a, b in (("%", "%25"), (";", "%3B"), ("'", "%27"), ("?", "%3F"), ("#", "%23"), ("+", "%2B"), (" ", "+"), ("::", ";"), (":", "%3A"), ("//", ":"), ("/", "%2F")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.concat(F.lit("urn:publicid:"), out)


def urn_to_public_id(u: Column) -> Column:
    out = F.regexp_replace(u, r"(?i)\Aurn:publicid:", "")
    for a, b in (("%2F", "/"), (":", "//"), ("%3A", ":"), (";", "::"), ("+", " "), ("%2B", "+"), ("%23", "#"), ("%3F", "?"), ("%27", "'"), ("%3B", ";"), ("%25", "%")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def path_to_uri(p: Column) -> Column:
    """file URI of an absolute POSIX path, else a relative reference."""
    coded = F.array_join(F.transform(F.split(p, "/", -1), percent_encode), "/")
    return F.when(F.startswith(p, F.lit("/")), F.concat(F.lit("file://"), coded)).otherwise(coded)


def uri_to_path(u: Column) -> Column:
    return percent_decode(F.regexp_replace(u, r"\Afile://(?:localhost)?", ""))


def iri_to_uri(i: Column) -> Column:
    """Characters outside ASCII as percent-encoded UTF-8."""
    return F.array_join(F.transform(F.split(i, ""), lambda c: F.when(c.rlike(r"\A[\x00-\x7F]*\z"), c).otherwise(percent_encode(c))), "")


def base_join(base: Column, ref: Column) -> Column:
    """Like absolutize, for a base that may itself be relative."""
    folder = F.regexp_extract(base, r"\A(.*/)?", 0)
    return F.when(is_absolute(ref), ref).when(is_absolute(base), absolutize(ref, base)).when(F.startswith(ref, F.lit("/")), ref).otherwise(remove_dot_segments(F.concat(folder, ref)))
