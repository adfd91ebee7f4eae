"""EXSLT dates and durations over XSD lexical forms, as Column expressions.

A value in one of the eight forms (dateTime, date, time, gYearMonth, gYear, gMonthDay, gMonth, gDay) is taken
apart by regular expressions; a function whose part isn't in the form gives null (numbers) or '' (strings). Durations
are (sign, months, seconds); the two don't mix.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

ZONE = r"(Z|[+-][0-9]{2}:[0-9]{2})?"
DATE = r"(-?[0-9]{4,})-([0-9]{2})-([0-9]{2})"
TIME = r"([0-9]{2}):([0-9]{2}):([0-9]{2}(?:\.[0-9]+)?)"
FORMS = {
    "dateTime": rf"\A{DATE}T{TIME}{ZONE}\z",
    "date": rf"\A{DATE}{ZONE}\z",
    "time": rf"\A{TIME}{ZONE}\z",
    "gYearMonth": rf"\A(-?[0-9]{{4,}})-([0-9]{{2}}){ZONE}\z",
    "gYear": rf"\A(-?[0-9]{{4,}}){ZONE}\z",
    "gMonthDay": rf"\A--([0-9]{{2}})-([0-9]{{2}}){ZONE}\z",
    "gMonth": rf"\A--([0-9]{{2}})(?:--)?{ZONE}\z",
    "gDay": rf"\A---([0-9]{{2}}){ZONE}\z",
}
PARTS = {
    "year": {"dateTime": 1, "date": 1, "gYearMonth": 1, "gYear": 1},
    "month": {"dateTime": 2, "date": 2, "gYearMonth": 2, "gMonthDay": 1, "gMonth": 1},
    "day": {"dateTime": 3, "date": 3, "gMonthDay": 2, "gDay": 1},
    "hour": {"dateTime": 4, "time": 1},
    "minute": {"dateTime": 5, "time": 2},
    "second": {"dateTime": 6, "time": 3},
}
ZONE_AT = {"dateTime": 7, "date": 4, "time": 4, "gYearMonth": 3, "gYear": 2, "gMonthDay": 3, "gMonth": 2, "gDay": 2}
MONTHS = "January February March April May June July August September October November December".split()
DAYS = "Sunday Monday Tuesday Wednesday Thursday Friday Saturday".split()
DURATION = r"\A(-?)P(?:([0-9]+)Y)?(?:([0-9]+)M)?(?:([0-9]+)D)?(?:T(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+(?:\.[0-9]+)?)S)?)?\z"
DAY = 86400.0


def _pick(s: Column, at: dict[str, int], group_of=None) -> Column:
    out = None
    for form, group in at.items():
        hit = F.regexp_extract(s, FORMS[form], group)
        out = F.when(s.rlike(FORMS[form]), hit) if out is None else out.when(s.rlike(FORMS[form]), hit)
    return out


def part(s: Column, name: str) -> Column:
    """A part of a date as double; null where the form hasn't got it."""
    return _pick(s, PARTS[name]).cast("double")


def form(s: Column) -> Column:
    out = None
    for name, pattern in FORMS.items():
        out = F.when(s.rlike(pattern), F.lit(name)) if out is None else out.when(s.rlike(pattern), F.lit(name))
    return out


def zone(s: Column) -> Column:
    return F.coalesce(_pick(s, ZONE_AT), F.lit(""))


def zone_seconds(s: Column) -> Column:
    """Offset of the zone; 0 for Z, null for none."""
    z = zone(s)
    hours, minutes = F.substring(z, 2, 2).cast("double"), F.substring(z, 5, 2).cast("double")
    offset = (hours * 3600 + minutes * 60) * F.when(F.startswith(z, F.lit("-")), F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.when(z == "", F.lit(None)).when(z == "Z", F.lit(0.0)).otherwise(offset)


def year(s: Column) -> Column:
    return part(s, "year")


def month_in_year(s: Column) -> Column:
    return part(s, "month")


def day_in_month(s: Column) -> Column:
    return part(s, "day")


def hour_in_day(s: Column) -> Column:
    return part(s, "hour")


def minute_in_hour(s: Column) -> Column:
    return part(s, "minute")


def second_in_minute(s: Column) -> Column:
    return part(s, "second")


def leap_year(s: Column) -> Column:
    y = year(s)
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def _date(s: Column) -> Column:
    return F.make_date(part(s, "year").cast("int"), part(s, "month").cast("int"), part(s, "day").cast("int"))


def whole_date(s: Column) -> Column:
    """The date of a dateTime or date, else null."""
    return F.when(s.rlike(FORMS["dateTime"]) | s.rlike(FORMS["date"]), _date(s))


def date(s: Column) -> Column:
    """The date part with its zone, '' if there is none."""
    return F.when(s.rlike(FORMS["dateTime"]), F.concat(F.substring_index(s, "T", 1), zone(s))).when(s.rlike(FORMS["date"]), s).otherwise(F.lit(""))


def time(s: Column) -> Column:
    return F.when(s.rlike(FORMS["dateTime"]), F.substring_index(s, "T", -1)).when(s.rlike(FORMS["time"]), s).otherwise(F.lit(""))


def _named(index: Column, names: list[str], short: bool) -> Column:
    name = F.lit("")
    for k, n in reversed(list(enumerate(names, 1))):  # not element_at: generated code keeps the row before's name where the index is null
        name = F.when(index == k, F.lit(n[:3] if short else n)).otherwise(name)
    return name


def month_name(s: Column, short: bool = False) -> Column:
    return _named(month_in_year(s), MONTHS, short)


def day_in_week(s: Column) -> Column:
    """1 for Sunday."""
    return F.dayofweek(whole_date(s)).cast("double")


def day_name(s: Column, short: bool = False) -> Column:
    return _named(day_in_week(s), DAYS, short)


def week_in_year(s: Column) -> Column:
    """ISO week."""
    return F.weekofyear(whole_date(s)).cast("double")


def day_in_year(s: Column) -> Column:
    return F.dayofyear(whole_date(s)).cast("double")


def day_of_week_in_month(s: Column) -> Column:
    return F.floor((day_in_month(s) - 1) / 7).cast("double") + 1


def week_in_month(s: Column) -> Column:
    """Weeks start on Monday."""
    d = whole_date(s)
    first = F.weekday(F.trunc(d, "month"))
    return F.floor((F.dayofmonth(d) - 1 + first) / 7).cast("double") + 1


def date_time() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def format_date(s: Column, pattern: str) -> Column:
    """JDK pattern: G y M d h H m s S E D F w W a k K z; text in quotes; '' if a letter's part isn't there."""
    y, mo, d = year(s).cast("int"), month_in_year(s).cast("int"), day_in_month(s).cast("int")
    h, mi = F.coalesce(hour_in_day(s), F.lit(0.0)).cast("int"), F.coalesce(minute_in_hour(s), F.lit(0.0)).cast("int")
    sec = F.coalesce(second_in_minute(s), F.lit(0.0))
    pad = lambda c, n: F.when(F.length(c.cast("string")) >= n, c.cast("string")).otherwise(F.lpad(c.cast("string"), n, "0"))

    def letter(c: str, n: int) -> Column:
        if c == "y":
            return F.lpad(F.pmod(y, F.lit(100)).cast("string"), 2, "0") if n == 2 else pad(y, n)
        if c == "M":
            return month_name(s, n == 3) if n >= 3 else pad(mo, n)
        if c == "E":
            return day_name(s, n < 4)
        plain = {
            "d": d, "H": h, "k": F.when(h == 0, F.lit(24)).otherwise(h), "K": h % 12, "h": F.when(h % 12 == 0, F.lit(12)).otherwise(h % 12), "m": mi, "s": F.floor(sec).cast("int"),
            "S": F.round((sec - F.floor(sec)) * 1000).cast("int"), "D": day_in_year(s).cast("int"), "F": day_of_week_in_month(s).cast("int"), "w": week_in_year(s).cast("int"), "W": week_in_month(s).cast("int"),
        }
        if c in plain:
            return pad(plain[c], n)
        if c == "a":
            return F.when(h < 12, F.lit("AM")).otherwise(F.lit("PM"))
        if c == "G":
            return F.when(y > 0, F.lit("AD")).otherwise(F.lit("BC"))
        return F.when(zone(s) == "Z", F.lit("GMT")).when(zone(s) == "", F.lit("")).otherwise(F.concat(F.lit("GMT"), zone(s)))

    out: list[Column] = []
    k = 0
    while k < len(pattern):
        c = pattern[k]
        if c == "'":
            end = pattern.find("'", k + 1)
            end = len(pattern) if end < 0 else end
            out.append(F.lit(pattern[k + 1 : end] or "'"))
            k = end + 1
        elif c in "GyMdhHmsSEDFwWakKz":
            n = len(pattern) - k - len(pattern[k:].lstrip(c))
            out.append(letter(c, n))
            k += n
        else:
            out.append(F.lit(c))
            k += 1
    return F.coalesce(F.concat(*out), F.lit("")) if out else F.lit("")


def duration_parts(d: Column) -> Column:
    """struct<months, seconds>, both with the duration's sign; null if d isn't a duration."""
    g = lambda k: F.coalesce(F.regexp_extract(d, DURATION, k).try_cast("double"), F.lit(0.0))
    sign = F.when(F.regexp_extract(d, DURATION, 1) == "-", F.lit(-1.0)).otherwise(F.lit(1.0))
    ok = d.rlike(DURATION) & ~d.rlike(r"(?:P|T)\z")
    return F.when(ok, F.struct((sign * (g(2) * 12 + g(3))).cast("long").alias("months"), (sign * (g(4) * DAY + g(5) * 3600 + g(6) * 60 + g(7))).alias("seconds")))


def seconds_text(x: Column) -> Column:
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(F.regexp_replace(F.format_string("%.6f", x), r"\.?0+$", ""))


def duration_text(months: Column, seconds: Column) -> Column:
    """ISO text; '' where the signs differ."""
    unit = lambda c, u: F.when(c > 0, F.concat(c.cast("string"), F.lit(u))).otherwise(F.lit(""))

    def clock(rest: Column) -> Column:
        sec = rest % 60
        return F.concat(unit(F.floor(rest / 3600).cast("long"), "H"), unit(F.floor((rest % 3600) / 60).cast("long"), "M"), F.when(sec > 0, F.concat(let(sec, seconds_text), F.lit("S"))).otherwise(F.lit("")))

    def text(x: Column) -> Column:
        m, s = F.abs(x["m"]), F.abs(x["s"])
        timed = let(clock(s % DAY), lambda c: F.when(c != "", F.concat(F.lit("T"), c)).otherwise(F.lit("")))
        body = F.concat(unit(F.floor(m / 12).cast("long"), "Y"), unit((m % 12).cast("long"), "M"), unit(F.floor(s / DAY).cast("long"), "D"), timed)
        sign = F.when((x["m"] < 0) | (x["s"] < 0), F.lit("-P")).otherwise(F.lit("P"))
        mixed = ((x["m"] > 0) & (x["s"] < 0)) | ((x["m"] < 0) & (x["s"] > 0))
        return F.when(mixed, F.lit("")).otherwise(F.concat(sign, let(body, lambda b: F.when(b == "", F.lit("T0S")).otherwise(b))))

    return let(F.struct(months.alias("m"), seconds.alias("s")), text)


def duration(seconds: Column) -> Column:
    return F.when(seconds.isNull() | F.isnan(seconds), F.lit("")).otherwise(duration_text(F.lit(0), seconds))


def add_duration(a: Column, b: Column) -> Column:
    both = F.struct(duration_parts(a).alias("x"), duration_parts(b).alias("y"))
    return F.coalesce(let(both, lambda p: duration_text(p["x"]["months"] + p["y"]["months"], p["x"]["seconds"] + p["y"]["seconds"])), F.lit(""))


def sum_durations(d: Column) -> Column:
    """Aggregate over durations; '' if one isn't a duration."""
    p = duration_parts(d)
    bad = F.max(p.isNull())
    return F.when(F.coalesce(bad, F.lit(True)), F.lit("")).otherwise(duration_text(F.sum(p["months"]), F.sum(p["seconds"])))


def moment(s: Column) -> Column:
    """Seconds since 1970 of a dateTime, date, gYearMonth or gYear, in UTC where it has a zone."""
    day = F.datediff(F.make_date(year(s).cast("int"), F.coalesce(month_in_year(s), F.lit(1.0)).cast("int"), F.coalesce(day_in_month(s), F.lit(1.0)).cast("int")), F.lit("1970-01-01").cast("date"))
    clock = F.coalesce(hour_in_day(s), F.lit(0.0)) * 3600 + F.coalesce(minute_in_hour(s), F.lit(0.0)) * 60 + F.coalesce(second_in_minute(s), F.lit(0.0))
    return day * DAY + clock - F.coalesce(zone_seconds(s), F.lit(0.0))


def seconds(s: Column) -> Column:
    """Seconds of a duration without months, or since 1970 of a date."""
    p = duration_parts(s)
    return F.when(p.isNotNull(), F.when(p["months"] == 0, p["seconds"])).otherwise(moment(s))


def _taken(s: Column) -> Column:
    """struct of what arithmetic needs of a date."""
    return F.struct(form(s).alias("form"), zone(s).alias("zone"), year(s).alias("y"), month_in_year(s).alias("m"), moment(s).alias("at"))


def difference(a: Column, b: Column) -> Column:
    """Duration from a to b, in the precision of the less precise: months for years and months, else seconds."""

    def text(x: Column) -> Column:
        p, q = x["a"], x["b"]
        rough = p["form"].isin("gYear", "gYearMonth") | q["form"].isin("gYear", "gYearMonth")
        years_only = (p["form"] == "gYear") | (q["form"] == "gYear")
        days_only = (p["form"] == "date") | (q["form"] == "date")
        months = (q["y"] - p["y"]) * 12 + F.when(years_only, F.lit(0.0)).otherwise(q["m"] - p["m"])
        secs = F.when(days_only, (F.floor(q["at"] / DAY) - F.floor(p["at"] / DAY)) * DAY).otherwise(q["at"] - p["at"])
        same_kind = (p["zone"] == "") == (q["zone"] == "")
        said = duration_text(F.when(rough, months).otherwise(F.lit(0.0)).cast("long"), F.when(rough, F.lit(0.0)).otherwise(secs).cast("double"))
        return F.when(same_kind, said).otherwise(F.lit(""))

    return F.coalesce(let(F.struct(_taken(a).alias("a"), _taken(b).alias("b")), text), F.lit(""))


def add(s: Column, d: Column) -> Column:
    """A date plus a duration (XSD appendix E): months first, the day clamped to the month, then the rest; in the form of s."""
    p = duration_parts(d)
    base = F.make_date(year(s).cast("int"), F.coalesce(month_in_year(s), F.lit(1.0)).cast("int"), F.coalesce(day_in_month(s), F.lit(1.0)).cast("int"))
    moved = F.add_months(base, p["months"].cast("int"))
    # add_months keeps the day and clamps it to the month's length, as the appendix asks.
    clock = F.coalesce(hour_in_day(s), F.lit(0.0)) * 3600 + F.coalesce(minute_in_hour(s), F.lit(0.0)) * 60 + F.coalesce(second_in_minute(s), F.lit(0.0)) + p["seconds"]
    days = F.floor(clock / DAY)
    day = F.date_add(moved, days.cast("int"))
    rest = clock - days * DAY
    h, mi = F.floor(rest / 3600), F.floor((rest % 3600) / 60)
    sec = rest % 60
    two = lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")
    shown = F.when(sec == F.floor(sec), two(sec)).otherwise(F.lpad(seconds_text(sec), 9, "0"))
    f = form(s)
    ymd = F.date_format(day, "yyyy-MM-dd")
    out = (
        F.when(f == "dateTime", F.concat(ymd, F.lit("T"), two(h), F.lit(":"), two(mi), F.lit(":"), shown))
        .when(f == "date", ymd)
        .when(f == "gYearMonth", F.substring(ymd, 1, 7))
        .when(f == "gYear", F.substring(ymd, 1, 4))
    )
    return F.coalesce(F.concat(out, zone(s)), F.lit(""))
