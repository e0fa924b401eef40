"""Times: microseconds since 1970 as longs, taken apart in a zone.

Local times are timestamps without zone, so nothing depends on the session's zone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang.types import TypeProblem

ZONE = "PST8PDT"
#: The abbreviations of zones by their hours from UTC.
ABBREVIATIONS = {"PST8PDT": {-8: "PST", -7: "PDT"}, "MST7MDT": {-7: "MST", -6: "MDT"}, "CST6CDT": {-6: "CST", -5: "CDT"}, "EST5EDT": {-5: "EST", -4: "EDT"}, "UTC": {0: "UTC"}, "GMT": {0: "GMT"}}
ABBREVIATIONS |= {"America/Los_Angeles": ABBREVIATIONS["PST8PDT"], "America/Denver": ABBREVIATIONS["MST7MDT"], "America/Chicago": ABBREVIATIONS["CST6CDT"], "America/New_York": ABBREVIATIONS["EST5EDT"]}


def _zone(zone) -> Column:
    return F.lit(ZONE) if zone is None else F.lit(zone) if isinstance(zone, str) else zone


def local(t: Column, zone=None) -> Column:
    """The wall clock of a zone."""
    return F.convert_timezone(F.current_timezone(), _zone(zone), F.timestamp_micros(t).cast("timestamp_ntz"))


def micros(clock: Column, zone=None) -> Column:
    """The time at which a zone's clock shows ``clock``."""
    return F.unix_micros(F.convert_timezone(_zone(zone), F.current_timezone(), clock).cast("timestamp"))


def plus(t: Column, n: Column, unit: str, by: int, zone=None) -> Column:
    """Calendar days or months on a zone's clock; a day that a month lacks becomes its last."""
    step = F.make_dt_interval(n * by) if unit == "DAY" else F.make_ym_interval(F.lit(0), (n * by).cast("int"))
    return micros(local(t, zone) + step, zone)


def truncated(t: Column, unit: str, zone=None) -> Column:
    """The start of the second, minute, hour, day, month or year on a zone's clock."""
    if unit == "SECOND":
        return t - F.pmod(t, F.lit(1_000_000))
    if unit == "MINUTE":
        return t - F.pmod(t, F.lit(60_000_000))
    if unit == "HOUR":
        return t - (F.minute(local(t, zone)).cast("long") * 60_000_000 + F.pmod(t, F.lit(60_000_000)))
    day = local(t, zone).cast("date")
    return micros((day if unit == "DAY" else F.trunc(day, unit)).cast("timestamp_ntz"), zone)


def abbreviation(t: Column, zone=None) -> Column:
    """A zone's abbreviation at a time; GMT with the offset for zones without one."""
    z = _zone(zone)
    minutes = F.floor((micros(local(t, zone), "UTC") - t) / 60_000_000)
    found = F.lit(None).cast("string")
    for name, names in ABBREVIATIONS.items():
        for hours, text in names.items():
            found = F.when((z == name) & (minutes == 60 * hours), text).otherwise(found)
    size = F.abs(minutes)
    other = F.format_string("GMT%s%02d:%02d", F.when(minutes < 0, "-").otherwise("+"), F.floor(size / 60), size % 60)
    return F.coalesce(found, other)


def text(t: Column, zone=None) -> Column:
    """As in ``Sun Feb 2 23:40:08 PST 2003``."""
    clock = local(t, zone)
    return F.concat(F.date_format(clock, "EEE MMM d HH:mm:ss "), abbreviation(t, zone), F.date_format(clock, " yyyy"))


def parse(s: Column, zone=None) -> Column:
    """The reverse of ``text``; a leading day of the week is not looked at, and a text without a zone is in ``zone``."""
    bare = F.regexp_replace(F.trim(s), r"^[A-Za-z]+,?\s+(?=[A-Za-z])", "")
    pattern = r"^([A-Za-z]+) +(\d+) +(\d+:\d+:\d+) +(\S+) +(\d{4})$"
    short = r"^([A-Za-z]+) +(\d+) +(\d+:\d+:\d+) +(\d{4})$"
    zoned = F.try_to_timestamp(F.regexp_replace(bare, pattern, "$1 $2 $5 $3 $4"), F.lit("MMM d yyyy HH:mm:ss z"))
    clock = F.try_to_timestamp(F.regexp_replace(bare, short, "$1 $2 $4 $3"), F.lit("MMM d yyyy HH:mm:ss")).cast("timestamp_ntz")
    return F.when(bare.rlike(pattern), F.unix_micros(zoned)).when(bare.rlike(short), micros(clock, zone))


def formatted(fmt, t: Column, zone=None) -> Column:
    """strftime's a A b B c d H I j m M p S U w W x X y Y Z and %%."""
    if not isinstance(fmt, str):
        raise TypeProblem("formattime takes a constant format")
    clock = local(t, zone)
    weekday = F.dayofweek(clock) - 1  # Sunday is 0
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    week = lambda start: two(F.floor((F.dayofyear(clock) + 6 - F.pmod(weekday - start, F.lit(7))) / 7))
    plain = {"a": "EEE", "A": "EEEE", "b": "MMM", "B": "MMMM", "d": "dd", "H": "HH", "I": "hh", "j": "DDD", "m": "MM", "M": "mm", "p": "a", "S": "ss", "x": "MM/dd/yy", "X": "HH:mm:ss", "y": "yy", "Y": "yyyy", "c": "EEE MMM dd HH:mm:ss yyyy"}
    parts = []
    for verb, literal in re.findall(r"%(.)|([^%]+|%$)", fmt, re.S):
        if literal:
            parts.append(F.lit(literal))
        elif verb == "%":
            parts.append(F.lit("%"))
        elif verb in plain:
            parts.append(F.date_format(clock, plain[verb]))
        elif verb == "Z":
            parts.append(abbreviation(t, zone))
        elif verb == "w":
            parts.append(weekday.cast("string"))
        elif verb in "UW":
            parts.append(week(int(verb == "W")))
        else:
            raise TypeProblem(f"formattime does not know %{verb}")
    return F.when(t.isNotNull(), F.concat(*parts)) if parts else F.lit("")
