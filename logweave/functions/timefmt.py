"""Timestamp notations: named presets, strptime patterns and reference-time layouts.

A notation becomes one regular expression with a group per component, used both by the Column
and by the row-wise reader. A value is (microseconds since the epoch, nanoseconds left over).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the rule language: presets, epoch units, strptime directives.
LAYOUTS = {
    "iso8601": "2006-01-02T15:04:05.999999999Z07:00",
    "rfc3339": "2006-01-02T15:04:05.999999999Z07:00",
    "rfc822": "02 Jan 06 15:04 -0700",
    "rfc2822": "Mon, 02 Jan 2006 15:04:05 -0700",
    "clf": "02/Jan/2006:15:04:05 -0700",
    "syslog": "Jan _2 15:04:05",
    "pylog": "2006-01-02 15:04:05,999999999",
}
EPOCHS = {"unix": 10**9, "unix_ms": 10**6, "unix_us": 10**3, "unix_ns": 1}
AUTO = ("iso8601", "rfc2822", "rfc822", "clf", "syslog", "pylog")
DIRECTIVES = {
    "Y": "2006", "y": "06", "m": "01", "d": "02", "H": "15", "I": "03", "M": "04", "S": "05", "f": "999999999",
    "z": "-0700", "Z": "MST", "a": "Mon", "A": "Monday", "b": "Jan", "B": "January", "p": "PM", "%": "%",
}
MONTHS = "January February March April May June July August September October November December".split()
DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()

_any = lambda names: "(?i:" + "|".join(names) + ")"
#: layout token -> (component, pattern)
_TOKENS = {
    "2006": ("Y", "[0-9]{4}"), "06": ("y", "[0-9]{2}"), "January": ("b", _any(MONTHS)), "Jan": ("b", _any(m[:3] for m in MONTHS)),
    "01": ("m", "[0-9]{2}"), "1": ("m", "[0-9]{1,2}"), "Monday": ("", _any(DAYS)), "Mon": ("", _any(d[:3] for d in DAYS)),
    "02": ("d", "[0-9]{2}"), "_2": ("d", " ?[0-9]{1,2}"), "2": ("d", "[0-9]{1,2}"), "15": ("H", "[0-9]{1,2}"), "03": ("I", "[0-9]{2}"),
    "3": ("I", "[0-9]{1,2}"), "04": ("M", "[0-9]{2}"), "4": ("M", "[0-9]{1,2}"), "05": ("S", "[0-9]{2}"), "5": ("S", "[0-9]{1,2}"),
    "PM": ("p", "AM|PM"), "pm": ("p", "am|pm"), "MST": ("Z", "[A-Z]{3,5}"), "Z07:00": ("z", "Z|[+-][0-9]{2}:[0-9]{2}"),
    "Z0700": ("z", "Z|[+-][0-9]{4}"), "-07:00": ("z", "[+-][0-9]{2}:[0-9]{2}"), "-0700": ("z", "[+-][0-9]{4}"), "-07": ("z", "[+-][0-9]{2}"),
}
_SCAN = re.compile(r"[.,](?:0+|9+)(?![0-9])|" + "|".join(map(re.escape, sorted(_TOKENS, key=len, reverse=True))))


class FormatError(ValueError):
    pass


@dataclass(frozen=True)
class Layout:
    pattern: str
    parts: tuple[str, ...]  # component of each group


@dataclass(frozen=True)
class TimeFormat:
    layouts: tuple[Layout, ...] = ()
    epoch: int = 0  # nanoseconds of a unit


def strptime_layout(fmt: str) -> str:
    """A strptime pattern as a reference-time layout."""

    def token(m: re.Match) -> str:
        if m[1] in DIRECTIVES:
            return DIRECTIVES[m[1]]
        what = f"%{m[1]} is no directive here" if m[1] else "it ends in a single %"
        raise FormatError(f"time format {fmt!r}: {what}; usable are {' '.join(DIRECTIVES)}")

    return re.sub(r"%(.?)", token, fmt, flags=re.DOTALL)


def layout(text: str) -> Layout:
    out, parts, at = r"\A", [], 0

    def literal(s: str) -> str:
        return re.sub(r"(?:\\ )+", " +", re.escape(s))

    for m in _SCAN.finditer(text):
        out += literal(text[at : m.start()])
        at = m.end()
        token = m[0]
        if token[0] in ".,":
            out += r"((?:[.,][0-9]+)?)" if token[1] == "9" else rf"([.,][0-9]{{{len(token) - 1}}})"
            parts.append("f")
            continue
        name, pattern = _TOKENS[token]
        out += f"({pattern})"
        parts.append(name)
        # seconds take a fraction even where the layout has none
        if name == "S" and not re.match(r"[.,](?:0+|9+)(?![0-9])", text[at:]):
            out += r"((?:[.,][0-9]+)?)"
            parts.append("f")
    return Layout(out + literal(text[at:]) + r"\z", tuple(parts))


def resolve(fmt: str) -> TimeFormat:
    if fmt == "auto":
        return TimeFormat(tuple(layout(LAYOUTS[n]) for n in AUTO))
    if fmt in EPOCHS:
        return TimeFormat(epoch=EPOCHS[fmt])
    if fmt in LAYOUTS:
        return TimeFormat((layout(LAYOUTS[fmt]),))
    return TimeFormat((layout(strptime_layout(fmt) if fmt.startswith("%") else fmt),))


# ---- as a Column: struct<us, ns>; us is null where the value doesn't parse -----------------


def _parts(text: Column, lay: Layout) -> Column:
    """One pass of the expression splits the text into its components."""
    groups = "\u0001" + "\u0001".join(f"${i}" for i in range(1, len(lay.parts) + 1))
    return F.when(~text.contains("\u0001"), F.split(F.regexp_replace(text, lay.pattern, groups), "\u0001", -1))


def _numbers(parts: Column, lay: Layout) -> Column:
    """Year (null if there is none), month, day, seconds of the day, offset, nanoseconds of the second."""
    group = {p: i for i, p in enumerate(lay.parts, 1) if p}

    def part(p: str) -> Column:
        return F.get(parts, F.lit(group[p]))

    def number(p: str, default: int) -> Column:
        return F.ltrim(part(p)).try_cast("int") if p in group else F.lit(default)

    if "b" in group:
        at = F.call_function("locate", F.lower(F.substring(part("b"), 1, 3)), F.lit("".join(m[:3].lower() for m in MONTHS)))
        month = F.call_function("div", at + 2, F.lit(3)).cast("int")
    else:
        month = number("m", 1)
    minute, second = number("M", 0), number("S", 0)
    if "I" in group:
        h = number("I", 0)
        hour = F.when(h <= 12, h)
        if "p" in group:
            pm = F.upper(part("p")) == "PM"
            hour = F.when(h > 12, None).when(pm & (h < 12), h + 12).when(~pm & (h == 12), 0).otherwise(h)
    else:
        hour = number("H", 0)
    if "z" in group:
        z = F.replace(part("z"), F.lit(":"), F.lit(""))
        hh, mm = F.substring(z, 2, 2).try_cast("int"), F.coalesce(F.substring(z, 4, 2).try_cast("int"), F.lit(0))
        offset = F.when(z == "Z", 0).when((hh <= 24) & (mm < 60), (hh * 3600 + mm * 60) * F.when(z.startswith("-"), -1).otherwise(1))
    else:
        offset = F.lit(0)
    if "Y" in group:
        year = number("Y", 1)
    elif "y" in group:
        year = number("y", 0) + F.when(number("y", 0) >= 69, 1900).otherwise(2000)
    else:
        year = F.lit(None).cast("int")
    fine = (hour < 24) & (minute < 60) & (second < 60)
    frac = F.coalesce(F.rpad(F.substring(part("f"), 2, 9), 9, "0").try_cast("int"), F.lit(0)) if "f" in group else F.lit(0)
    seconds = F.when(fine, hour * 3600 + minute * 60 + second)
    return F.struct(year.alias("y"), month.alias("m"), number("d", 1).alias("d"), seconds.alias("s"), offset.alias("z"), F.when(part("f") != "", frac).otherwise(0).alias("f") if "f" in group else frac.alias("f"))


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since the epoch of a date of the Gregorian calendar; null if there is no such day."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    # years that begin in March, so that the leap day is the last one
    year, month = y + F.when(m <= 2, 399).otherwise(400), F.when(m <= 2, m + 9).otherwise(m - 3)
    days = year * 365 + _div(year, 4) - _div(year, 100) + _div(year, 400) + _div(month * 153 + 2, 5) + d - 1 - 719468 - 146097
    return F.when((m >= 1) & (m <= 12) & (d >= 1) & (d <= last), days)


def _moment(n: Column, lay: Layout, now: datetime, tz: str) -> Column:
    """struct<us, ns> of the numbers."""
    yearless = "Y" not in lay.parts and "y" not in lay.parts
    here = tz if "z" not in lay.parts and "Z" not in lay.parts else "UTC"

    def at(year: Column) -> Column:
        month, day = n["m"], n["d"]
        if yearless:
            # the 29th of February of other years is the 1st of March
            over = (month == 2) & (day == 29) & ~(((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0))
            month, day = F.when(over, 3).otherwise(month), F.when(over, 1).otherwise(day)
        us = (_days(year, month, day).cast("bigint") * 86400 + n["s"] - n["z"]) * 1_000_000
        return us if here == "UTC" else F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(us), F.lit(here)))

    us = at(n["y"])
    if yearless:
        this = now.astimezone(ZoneInfo(tz)).year
        us = F.when(at(F.lit(this)) > int(now.timestamp() * 1_000_000), at(F.lit(this - 1))).otherwise(at(F.lit(this)))
    return F.struct((us + _div(n["f"], 1000)).alias("us"), (n["f"] % 1000).cast("smallint").alias("ns"))


def _epoch_numbers(text: Column, unit: int) -> Column:
    from .exprs import cast_float

    whole = F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("bigint"))
    return F.struct(whole.alias("whole"), F.when(whole.isNull(), cast_float(text) * float(unit)).alias("f"))


def _epoch_moment(n: Column, unit: int) -> Column:
    whole, f = n["whole"], n["f"]
    ns = F.when((f > -9.2233720368547e18) & (f < 9.2233720368547e18), f.cast("bigint"))

    def parts(x: Column) -> tuple[Column, Column]:
        low = F.pmod(x, F.lit(1000))
        # towards minus infinity, without leaving the range of a bigint
        return _div(x, 1000) - F.when((x < 0) & (low != 0), 1).otherwise(0), low

    if unit >= 1000:
        most = (2**63 - 1) // unit
        us, low = F.when(whole.between(-most, most), whole * (unit // 1000)), F.lit(0)
    else:
        us, low = parts(whole)
    near_us, near_low = parts(ns)
    return F.struct(F.when(whole.isNotNull(), us).otherwise(near_us).alias("us"), F.when(whole.isNotNull(), low).otherwise(near_low).cast("smallint").alias("ns"))


def steps(fmt: TimeFormat, now: datetime, tz: str) -> list:
    """Functions from a text to struct<us, ns>, to be applied one after the other, each to a bound
    value: every one uses its argument many times."""
    if fmt.epoch:
        return [lambda t: _epoch_numbers(t, fmt.epoch), lambda n: _epoch_moment(n, fmt.epoch)]

    def chain_of(lay: Layout) -> list:
        return [lambda t: _parts(t, lay), lambda p: _numbers(p, lay), lambda n: _moment(n, lay, now, tz)]

    chains = [chain_of(lay) for lay in fmt.layouts]
    if len(chains) == 1:
        return chains[0]
    # several layouts: the next one is tried only where those before it failed
    return [lambda t: F.coalesce(*[F.when(t.rlike(lay.pattern), _bound(t, chain)) for lay, chain in zip(fmt.layouts, chains)])]


def _bound(value: Column, chain: list) -> Column:
    from .exprs import let

    for f in chain:
        value = let(value, f)
    return _strict(value)


def _strict(v: Column) -> Column:
    from .exprs import let

    return let(v, lambda x: F.when(x["us"].isNotNull(), x))


def parse_column(text: Column, fmt: TimeFormat, now: datetime, tz: str) -> Column:
    """struct<us, ns> of a text as one expression; null where it doesn't parse."""
    return _bound(text, steps(fmt, now, tz))


# ---- row-wise ---------------------------------------------------------------------------


def parse_value(text: str, fmt: TimeFormat, now: datetime, tz: str) -> tuple[int, int] | None:
    if fmt.epoch:
        if re.fullmatch(r"[+-]?[0-9]+", text, re.ASCII) and -(2**63) <= int(text) < 2**63:
            ns = int(text) * fmt.epoch
        else:
            from .values import to_float

            f = to_float(text)
            if f is None or abs(f) * fmt.epoch >= 9.2233720368547e18 or f != f:
                return None
            ns = int(f * fmt.epoch)
        return (ns // 1000, ns % 1000) if -(2**63) <= ns < 2**63 else None
    for lay in fmt.layouts:
        m = re.match(lay.pattern.replace(r"\z", r"\Z"), text)
        if not m:
            continue
        g = {p: m[i] for i, p in enumerate(lay.parts, 1) if p}
        month = [x[:3].lower() for x in MONTHS].index(g["b"][:3].lower()) + 1 if "b" in g else int(g.get("m", 1))
        day, hour = int(g.get("d", "1").strip()), int(g.get("H", 0))
        if "I" in g:
            hour = int(g["I"])
            if hour > 12:
                continue
            if "p" in g:
                hour = hour % 12 + 12 * (g["p"].upper() == "PM")
        offset = 0
        if g.get("z", "Z") != "Z":
            z = g["z"].replace(":", "")
            hh, mm = int(z[1:3]), int(z[3:5] or 0)
            if hh > 24 or mm > 59:
                continue
            offset = (hh * 3600 + mm * 60) * (-1 if z[0] == "-" else 1)
        zone = timezone.utc if "z" in g or "Z" in g else ZoneInfo(tz)
        this = now.astimezone(ZoneInfo(tz)).year
        years = [int(g["Y"])] if "Y" in g else [int(g["y"]) + (1900 if int(g["y"]) >= 69 else 2000)] if "y" in g else [this, this - 1]
        try:
            for k, y in enumerate(years):
                mo, d = (3, 1) if len(years) == 2 and (month, day) == (2, 29) and not (y % 4 == 0 and y % 100 != 0 or y % 400 == 0) else (month, day)
                t = datetime(y, mo, d, hour, int(g.get("M", 0)), int(g.get("S", 0)), tzinfo=zone)
                if k == 0 and len(years) == 2 and t > now:
                    continue
                break
        except ValueError:
            continue
        frac = int((g.get("f") or ".0")[1:10].ljust(9, "0"))
        us = (int(t.timestamp()) - offset) * 1_000_000 + frac // 1000
        return us, frac % 1000
    return None
