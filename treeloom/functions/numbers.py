"""EXSLT math and number formatting as Column expressions; format-number as a pandas UDF."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")

# The named constants.
CONSTANTS = {"PI": math.pi, "E": math.e, "SQRRT2": math.sqrt(2), "SQRT2": math.sqrt(2), "LN2": math.log(2), "LN10": math.log(10), "LOG2E": math.log2(math.e), "SQRT1_2": math.sqrt(0.5)}
UNARY = {"abs": F.abs, "acos": F.acos, "asin": F.asin, "atan": F.atan, "cos": F.cos, "exp": F.exp, "sin": F.sin, "tan": F.tan}


def constant(name: str, precision: int) -> Column:
    """A named constant cut to so many decimals; NaN for an unknown name."""
    if name not in CONSTANTS:
        return F.lit(NAN)
    return F.lit(float(Decimal(CONSTANTS[name]).quantize(Decimal(1).scaleb(-precision), rounding="ROUND_DOWN")))


def log(x: Column) -> Column:
    return F.when(x < 0, F.lit(NAN)).when(x == 0, F.lit(float("-inf"))).otherwise(F.ln(F.when(x > 0, x).otherwise(F.lit(1.0))))


def sqrt(x: Column) -> Column:
    """0 for negative numbers."""
    return F.when(x < 0, F.lit(0.0)).otherwise(F.sqrt(x))


def power(x: Column, y: Column) -> Column:
    return F.pow(x, y)


def atan2(y: Column, x: Column) -> Column:
    return F.atan2(y, x)


def random(seed: int | None = None) -> Column:
    return F.rand(seed)


def _strict(x: Column, best) -> Column:
    nan = F.max(F.isnan(x))
    return F.when(F.count(F.lit(1)) == 0, F.lit(NAN)).when(nan, F.lit(NAN)).otherwise(best(x))


def maximum(x: Column) -> Column:
    """Aggregate: NaN if any number is NaN or there is none."""
    return _strict(x, F.max)


def minimum(x: Column) -> Column:
    return _strict(x, F.min)


def total(x: Column) -> Column:
    """Aggregate: 0 for no numbers."""
    return F.coalesce(F.sum(x), F.lit(0.0))


ROMAN = ["m", "cm", "d", "cd", "c", "xc", "l", "xl", "x", "ix", "v", "iv", "i"]
ROMAN_VALUES = [1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1]


def roman(n: Column, upper: bool = True) -> Column:
    """Roman numeral of 1..3999, else decimal digits."""
    rest, out = n.cast("int"), F.lit("")
    for sign, value in zip(ROMAN, ROMAN_VALUES, strict=True):
        out = F.concat(out, F.repeat(F.lit(sign.upper() if upper else sign), F.floor(rest / value).cast("int")))
        rest = rest % value
    return F.when((n > 0) & (n < 4000), out).otherwise(n.cast("long").cast("string"))


def alphabetic(n: Column, upper: bool = True) -> Column:
    """a..z, aa..: base 26 without a zero; up to six letters."""
    rest, out = n.cast("long"), F.lit("")
    base = 65 if upper else 97
    for _ in range(6):
        letter = F.chr((F.pmod(rest - 1, F.lit(26)) + base).cast("int"))
        out = F.when(rest > 0, F.concat(letter, out)).otherwise(out)
        rest = F.when(rest > 0, F.floor((rest - 1) / 26).cast("long")).otherwise(F.lit(0))
    return out


def grouped(n: Column, separator: str = ",", size: int = 3) -> Column:
    return F.regexp_replace(n.cast("long").cast("string"), rf"(?<=[0-9])(?=(?:[0-9]{{{size}}})+$)", separator)


def numbered(n: Column, token: str = "1", separator: str = "", size: int = 0) -> Column:
    """One number in one of the formats 1, 01, a, A, i, I."""
    if token in ("i", "I"):
        return roman(n, token == "I")
    if token in ("a", "A"):
        return alphabetic(n, token == "A")
    plain = grouped(n, separator, size) if separator and size else n.cast("long").cast("string")
    return F.lpad(plain, len(token), "0") if len(token) > 1 and token.strip("0") == "1" else plain


def format_one(value: float, pattern: str, symbols: dict[str, str] | None = None) -> str:
    """A number by a decimal-format pattern: quotes, optional negative pattern, %, per mille, grouping."""
    s = {"decimal": ".", "grouping": ",", "infinity": "Infinity", "minus": "-", "nan": "NaN", "percent": "%", "per-mille": "‰", "zero": "0", "digit": "#", "pattern": ";"} | (symbols or {})
    if value != value:
        return s["nan"]
    quoted, parts, now = False, [[]], []
    for c in pattern:
        if c == "'":
            quoted = not quoted
        elif c == s["pattern"] and not quoted:
            parts.append([])
        else:
            parts[-1].append((c, quoted))
    active = {s["zero"], s["digit"], s["grouping"], s["decimal"]}

    def cut(part):
        at = [i for i, (c, q) in enumerate(part) if not q and c in active]
        if not at:
            return part, [], []
        return part[: at[0]], part[at[0] : at[-1] + 1], part[at[-1] + 1 :]

    prefix, body, suffix = cut(parts[0])
    negative = value < 0 or (value == 0 and math.copysign(1, value) < 0)
    signs = [c for c, q in prefix + suffix if not q]
    factor = 100 if s["percent"] in signs else 1000 if s["per-mille"] in signs else 1
    text = lambda part: "".join(c for c, _ in part)
    minus = s["minus"] if negative else ""
    if negative and len(parts) > 1:
        prefix, _, suffix = cut(parts[1])
        minus = ""
    if math.isinf(value):
        return minus + text(prefix) + s["infinity"] + text(suffix)
    shape = text(body)
    whole, point, fraction = shape.partition(s["decimal"])
    group = len(whole) - whole.rfind(s["grouping"]) - 1 if s["grouping"] in whole else 0
    least_whole, least_fraction = whole.count(s["zero"]), fraction.count(s["zero"])
    most_fraction = least_fraction + fraction.count(s["digit"])
    if not least_whole and not least_fraction:
        if most_fraction and not whole:
            least_fraction = 1
        else:
            least_whole = 1
    number = (Decimal(repr(abs(value))) * factor).quantize(Decimal(1).scaleb(-most_fraction), rounding=ROUND_HALF_UP)
    digits, _, decimals = f"{number:f}".partition(".")
    digits = digits.lstrip("0").rjust(least_whole, "0")
    decimals = decimals.rstrip("0").ljust(least_fraction, "0")
    if not digits and not decimals:
        digits = "0"
    if group:
        digits = s["grouping"].join(filter(None, [digits[: len(digits) % group], *(digits[i : i + group] for i in range(len(digits) % group, len(digits), group))]))
    if s["zero"] != "0":
        digits, decimals = (x.translate({48 + i: chr(ord(s["zero"]) + i) for i in range(10)}) for x in (digits, decimals))
    if not number:
        minus = ""
    return minus + text(prefix) + digits + (s["decimal"] + decimals if decimals else "") + text(suffix)


def format_number(n: Column, pattern: str, symbols: dict[str, str] | None = None) -> Column:
    @F.pandas_udf("string")
    def work(x: pd.Series) -> pd.Series:
        return x.map(lambda v: format_one(float(v), pattern, symbols))

    return work(n)
