"""Secret scan with a battery of randomness tests, DataFrame operations only.

Base spans follow fixed rules (``BASE``). The method adds spans: runs of 20 or more characters of the
base64 alphabets that look like an encoding (hex, base32, base64 by the characters they use, with a
letter) are tested against "every symbol is drawn evenly and independently". ``=`` belongs to a run only
as padding at its end; elsewhere it separates, so name and value of ``NAME=value`` are runs of their own:

* chi-squared of the symbols' shares over eight equal parts of the encoding's alphabet,
* the number of runs above and below the middle of the alphabet,
* the correlation of each symbol's rank with the next one's.

The three deviates give one p-value per run (Wilson-Hilferty on the sum of squares, 9 degrees of freedom
with the chi-squared's 7 and one each of the others): even for secrets, near 0 for words and identifiers. What is reported
is settled by the share of false alarms among it, for each encoding and class of lengths (by octave) apart, since short runs have
little power: half of the secrets have p of 0.5 or more, so twice the runs there estimate the secrets, and what runs with p of t
or more exceed the secrets' even share by are false alarms. The level is the smallest t, ``LEAST_P`` or more, at
which those are at most ``rate`` of what is reported. ``PRIOR`` secrets with even p are added to each class, so that a
class of a few runs has the level ``LEAST_P``. p-values are counted in ``BINS`` bins per class over all distinct runs, a table of fixed size.
Runs at or above their level are secrets, unless they overlap a base span.

Positions are code points, end exclusive: text is split at the matches and lengths of what lies between
are summed by growing steps, n log n of them for n matches in a text; overlaps are found from running maxima. Null text counts as empty. Rows repeat as often as they occur; rows without an id get base spans only. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

# The base rules, kind: (pattern, group whose length counts, least length).
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 16),
    "hex": (r"([0-9a-f]{32,})", 1, 32),
}
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:={1,6}(?![A-Za-z0-9+/_=-]))?"
# Alphabets in the order of their codes.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
KINDS = [*BASE, "random_base32", "random_base64", "random_hex"]
RATE = 0.05
LEAST_P = 0.02
PRIOR = 100
BINS = 1000
PARTS = 8


#: A text has fewer matches than four to this.
LEVELS = 14


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, combine: Callable[[Column, Column], Column], level: int = 0) -> Column:
    """Prefix sums (or maxima) of an array: each element takes in those one, two and three steps before it, with steps of 1, 4, 16 ... until that covers the array."""
    if level == LEVELS:
        return values
    step = 4**level

    def further(xs: Column) -> Column:
        def taken(x: Column, i: Column) -> Column:
            parts = [F.when(i >= k * step, F.get(xs, i - k * step)) for k in (1, 2, 3)]
            return combine(x, *parts)

        return F.when(F.size(xs) <= step, xs).otherwise(let(F.transform(xs, taken), lambda ys: running(ys, combine, level + 1)))

    return further(values) if level else let(values, further)


def total(x: Column, *parts: Column) -> Column:
    for part in parts:
        x = x + F.coalesce(part, F.lit(0))
    return x


def found(text: Column, pattern: str, group: int) -> Column:
    """array<struct<start,end,value>> of the leftmost non-overlapping matches; value is the given group."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def spans_of(hits: Column) -> Column:
        lengths = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(hits)), hits, lambda gap, hit: F.length(gap) + F.length(hit))
        ends = running(lengths, total)
        return F.zip_with(F.zip_with(ends, hits, lambda e, h: F.struct((e - F.length(h)).alias("start"), e.alias("end"))), value, lambda x, v: F.struct(x["start"].alias("start"), x["end"].alias("end"), v.alias("value")))

    return F.when(text.rlike(pattern), let(whole, spans_of)).otherwise(none)


def apart(runs: Column, base: Column) -> Column:
    """The runs that overlap none of the base spans: in order of start, no base span before reaches into one and none begins in it."""
    of_base = F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("code")))
    every = F.array_sort(F.concat(of_base, runs))
    is_base = lambda x: x["value"].isNull()

    def clear(xs: Column) -> Column:
        reached = running(F.transform(xs, lambda x: F.when(is_base(x), x["end"]).otherwise(F.lit(-1))), F.greatest)
        follows = F.reverse(running(F.reverse(F.transform(xs, lambda x: F.when(is_base(x), x["start"]).otherwise(F.lit(2**31 - 1)))), F.least))
        marked = F.zip_with(F.zip_with(reached, follows, lambda r, f: F.struct(r.alias("r"), f.alias("f"))), xs, lambda y, x: F.struct((~is_base(x) & (y["r"] <= x["start"]) & (y["f"] >= x["end"])).alias("clear"), x.alias("run")))
        return F.transform(F.filter(marked, lambda y: y["clear"]), lambda y: y["run"])

    return F.when((F.size(base) == 0) | (F.size(runs) == 0), runs).otherwise(let(every, clear))


def encoding(run: Column) -> Column:
    bare = F.regexp_replace(run, "=+$", "")
    return (
        F.when(~bare.rlike("[A-Za-z]"), F.lit(None))
        .when(bare.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.lit("hex"))
        .when(bare.rlike("^[A-Z2-7]+$"), F.lit("base32"))
        .otherwise(F.lit("base64"))
    )


def tested(runs: DataFrame) -> DataFrame:
    """runs(value, code, ...) with p, how likely draws that are even and independent lie as far off, and class, of encoding and length."""
    bare = F.translate(F.regexp_replace("value", "=+$", ""), "-_", "+/")
    alphabet = F.when(F.col("code") == "hex", F.lit(ALPHABETS["hex"])).when(F.col("code") == "base32", F.lit(ALPHABETS["base32"])).otherwise(F.lit(ALPHABETS["base64"]))
    summed = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    steps = [
        {"bare": F.when(F.col("code") == "hex", F.lower(bare)).otherwise(bare), "alphabet": alphabet},
        {"k": F.length("alphabet"), "ranks": F.transform(F.split("bare", ""), lambda c: (F.call_function("instr", F.col("alphabet"), c) - 1).cast("double")), "n": F.length("bare").cast("double")},
        {
            "part": F.transform("ranks", lambda r: F.floor(r * PARTS / F.col("k"))),
            "high": F.transform("ranks", lambda r: (r >= F.col("k") / 2).cast("double")),
            "mean": summed("ranks") / F.col("n"),
        },
        {
            "chi": summed(F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda b: F.pow(F.size(F.filter("part", lambda x: x == b)) - F.col("n") / PARTS, F.lit(2)) / (F.col("n") / PARTS))),
            "n1": summed("high"),
            "runs": 1 + summed(F.transform("high", lambda x, i: F.when((i > 0) & (F.element_at("high", F.greatest(i, F.lit(1))) != x), F.lit(1.0)).otherwise(F.lit(0.0)))),
            "power": F.greatest(summed(F.transform("ranks", lambda r: (r - F.col("mean")) * (r - F.col("mean")))), F.lit(1e-9)),
            "pairs": summed(F.transform("ranks", lambda r, i: F.when(i > 0, (r - F.col("mean")) * (F.element_at("ranks", F.greatest(i, F.lit(1))) - F.col("mean"))).otherwise(F.lit(0.0)))),
        },
        {"both": 2 * F.col("n1") * (F.col("n") - F.col("n1"))},
        {
            "z_runs": (F.col("runs") - 1 - F.col("both") / F.col("n")) / F.sqrt(F.greatest(F.col("both") * (F.col("both") - F.col("n")) / (F.col("n") * F.col("n") * (F.col("n") - 1)), F.lit(0.25))),
            "z_lag": F.col("pairs") / F.col("power") * F.sqrt("n"),
        },
        {"z": (F.pow((F.col("chi") + F.col("z_runs") * F.col("z_runs") + F.col("z_lag") * F.col("z_lag")) / (PARTS + 1), F.lit(1 / 3)) - (1 - 2 / (9 * (PARTS + 1)))) / (2 / (9 * (PARTS + 1))) ** 0.5},
        {"p": 1 / (1 + F.exp(1.5976 * F.col("z") + 0.070566 * F.col("z") * F.col("z") * F.col("z"))), "class": F.concat_ws(":", "code", F.floor(F.log2("n")).cast("string"))},
    ]
    out = runs
    for step in steps:
        out = out.withColumns(step)
    return out.select(*runs.columns, "p", "class")


def _at_least(n: int):
    return lambda x: F.length(x["value"]) >= n


def _is(kind: str):
    return lambda x: x["kind"] == kind


def _span(no: Column, kind: Column):
    return lambda x: F.struct(x["start"].alias("start"), no.alias("kind_no"), x["end"].alias("end"), kind.alias("kind"))


def report_levels(runs: DataFrame, rate: float = RATE) -> dict[str, float]:
    """Per class (encoding and octave of length), the least p that is reported; from counts in BINS bins per class."""
    values = runs.groupBy("class", "value_hash").agg(F.first("p").alias("p"))  # a value that copies repeat counts once
    binned = values.groupBy("class", F.floor(F.least(F.col("p"), F.lit(1 - 1e-9)) * BINS).cast("int").alias("bin")).agg(F.count("*").alias("k"))
    counts: dict[str, dict[int, int]] = {}
    for r in binned.collect():  # at most BINS rows for each of 3 encodings and at most 32 octaves
        counts.setdefault(r["class"], {})[r["bin"]] = r["k"]
    return {name: level_of(own, rate) for name, own in counts.items()}


def level_of(counts: dict[int, int], rate: float = RATE) -> float:
    """The smallest p at which at most ``rate`` of the runs from there on are more than even draws account for."""
    above = [0.0] * (BINS + 1)
    for b in range(BINS - 1, -1, -1):
        above[b] = above[b + 1] + counts.get(b, 0) + PRIOR / BINS
    secrets = 2 * above[BINS // 2]
    for b in range(round(LEAST_P * BINS), BINS):
        if above[b] - secrets * (1 - b / BINS) <= rate * above[b]:
            return b / BINS
    return 1.0


def spans(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, base and added: array<struct<start,kind_no,end,kind>> sorted by start and kind; rows of docs(doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    kept = []
    for no, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        long_enough = F.filter(found(F.col("text"), pattern, group), _at_least(least))
        kept.append(F.transform(long_enough, _span(F.lit(no), F.lit(kind))))
    runs = F.transform(found(F.col("text"), RUN, 0), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), encoding(x["value"]).alias("code")))
    scanned = rows.select("doc_id", F.array_sort(F.concat(*kept)).alias("base"), F.filter(runs, lambda x: x["code"].isNotNull()).alias("runs"))
    scanned = settle(scanned.withColumn("runs", apart(F.col("runs"), F.col("base"))))
    runs = settle(tested(scanned.select("doc_id", F.explode("runs").alias("r")).select("doc_id", "r.start", "r.end", "r.value", "r.code")).withColumn("value_hash", F.xxhash64("value")).drop("value"))
    levels = F.create_map(*[F.lit(y) for x in {"": 1.0, **report_levels(runs, rate)}.items() for y in x])
    kind = F.concat(F.lit("random_"), F.col("code"))
    numbers = F.create_map(*[F.lit(y) for i, k in enumerate(KINDS) for y in (k, i)])
    stays = runs.filter(F.col("p") >= F.coalesce(F.element_at(levels, F.col("class")), F.lit(1.0)))
    added = stays.select("doc_id", F.struct("start", F.element_at(numbers, kind).alias("kind_no"), "end", kind.alias("kind")).alias("s")).groupBy("doc_id").agg(F.array_sort(F.collect_set("s")).alias("added"))
    none = F.array().cast("array<struct<start:int,kind_no:int,end:int,kind:string>>")
    return scanned.select("doc_id", "base").join(added, "doc_id", "left").withColumn("added", F.coalesce("added", none))


def digest(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; see the query's contract."""
    rows = spans(docs, rate)
    said = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    line = lambda c: F.array_join(F.transform(c, said), ",")
    many = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    every = F.array_sort(F.concat("base", "added"))
    return rows.select("doc_id", *many, F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(every).alias("spans"))
