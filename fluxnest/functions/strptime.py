"""Parsing of times by format, as Column expressions: a format becomes one pattern with a group for each directive."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import PlanError

_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_MONTH = "(?i:(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?))(?![A-Za-z])"
#: directive -> (part it sets, pattern, pattern without leading zeros)
_DIRECTIVES = {
    "Y": ("year", r"(\d{4})", r"(\d{4})"),
    "y": ("year2", r"(\d{2})", r"(\d{1,2})"),
    "m": ("month", r"(\d{2})", r"(\d{1,2})"),
    "d": ("day", r"(\d{2})", r"(\d{1,2})"),
    "H": ("hour", r"(\d{2})", r"(\d{1,2})"),
    "I": ("hour12", r"(\d{2})", r"(\d{1,2})"),
    "M": ("minute", r"(\d{2})", r"(\d{1,2})"),
    "S": ("second", r"(\d{2})", r"(\d{1,2})"),
    "f": ("fraction", r"(\d{1,6})", r"(\d{1,6})"),
    "j": ("yday", r"(\d{3})", r"(\d{1,3})"),
    "p": ("ampm", r"([AaPp][Mm])", r"([AaPp][Mm])"),
    "z": ("zone", r"(Z|[+-]\d{2}:?\d{2})", r"(Z|[+-]\d{2}:?\d{2})"),
    "Z": ("zone_name", r"([A-Za-z]+)", r"([A-Za-z]+)"),
    "a": ("", r"[A-Za-z]{2,}", r"[A-Za-z]{2,}"),
    "A": ("", r"[A-Za-z]{3,}", r"[A-Za-z]{3,}"),
    "b": ("name", _MONTH, _MONTH),
    "B": ("name", _MONTH, _MONTH),
    "%": ("", "%", "%"),
    "n": ("", r"[ \t\n\r]+", r"[ \t\n\r]+"),
    "t": ("", r"[ \t\n\r]+", r"[ \t\n\r]+"),
}
# The reference-time words of layouts without a percent sign, longest first.
_LAYOUT = [("January", "%B"), ("Monday", "%A"), ("2006", "%Y"), ("Z07:00", "%z"), ("-07:00", "%z"), ("Z0700", "%z"), ("-0700", "%z"), ("Jan", "%b"), ("Mon", "%a"), ("MST", "%Z"), ("01", "%m"), ("02", "%d"), ("_2", "%-d"), ("15", "%H"), ("03", "%I"), ("04", "%M"), ("05", "%S"), ("06", "%y"), ("PM", "%p"), ("pm", "%p"), ("1", "%-m"), ("2", "%-d"), ("3", "%-I"), ("4", "%-M"), ("5", "%-S")]


def from_layout(layout: str) -> str:
    """A layout written with the reference time as percent directives."""
    out, i = "", 0
    while i < len(layout):
        if m := re.match(r"[.,][09]+", layout[i:]):
            out += layout[i] + "%f"
            i += m.end()
            continue
        word = next(((w, d) for w, d in _LAYOUT if layout.startswith(w, i)), None)
        out += word[1] if word else layout[i].replace("%", "%%")
        i += len(word[0]) if word else 1
    return out


def compile_format(fmt: str) -> tuple[str, list[str]]:
    """(pattern, part of each group) of a percent format."""
    if "%" not in fmt:
        fmt = from_layout(fmt)
    pattern, parts, i = "", [], 0
    while i < len(fmt):
        if fmt[i] != "%":
            pattern += re.escape(fmt[i])
            i += 1
            continue
        bare = fmt[i + 1 : i + 2] == "-"
        i += 2 + bare
        name = fmt[i - 1 : i]
        if name not in _DIRECTIVES:
            raise PlanError(f"unsupported directive %{name} in {fmt!r}")
        part, padded, unpadded = _DIRECTIVES[name]
        pattern += unpadded if bare else padded
        if part:
            parts.append(part)
    return f"^{pattern}$", parts


def strptime(text: Column, fmt: str) -> Column:
    """Epoch milliseconds of a text; null where it doesn't match the whole format or is no date."""
    pattern, parts = compile_format(fmt)
    group = {p: F.regexp_extract(text, pattern, i + 1) for i, p in enumerate(parts)}
    number = lambda p, default: F.coalesce(group[p].try_cast("int"), F.lit(default)) if p in group else F.lit(default)
    year = number("year", 0) if "year" in group else number("year2", 0) + 2000 if "year2" in group else F.lit(0)
    if "name" in group:
        month = F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(F.substring(group["name"], 1, 3))).cast("int")
    else:
        month = number("month", 1)
    hour = number("hour", 0)
    if "hour12" in group:
        hour = number("hour12", 0)
        if "ampm" in group:
            pm = F.lower(group["ampm"]) == "pm"
            hour = F.when(pm & (hour != 12), hour + 12).when(~pm & (hour == 12), 0).otherwise(hour)
    micros = F.rpad(group["fraction"], 6, "0").try_cast("int") if "fraction" in group else F.lit(0)
    day, extra = number("day", 1), F.lit(0)
    if "yday" in group and "month" not in group and "name" not in group and "day" not in group:
        extra = number("yday", 1) - 1
    date = F.call_function("try_make_timestamp", year, month, day, F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"), F.lit("UTC"))
    ms = F.unix_millis(date) + extra.cast("bigint") * 86_400_000 + (hour.cast("bigint") * 3600 + number("minute", 0) * 60 + number("second", 0)) * 1000 + F.floor(micros / 1000)
    if "zone" in group:
        z = F.replace(group["zone"], F.lit(":"), F.lit(""))
        minutes = F.coalesce(F.substring(z, 2, 2).try_cast("int"), F.lit(0)) * 60 + F.coalesce(F.substring(z, 4, 2).try_cast("int"), F.lit(0))
        ms = ms - F.when(z.startswith("-"), -minutes).otherwise(minutes).cast("bigint") * 60_000
    sane = (hour < 24) & (number("minute", 0) < 60) & (number("second", 0) < 60)
    return F.when(text.rlike(pattern) & sane, ms)
