"""Times as text, to and from seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _units(seconds: Column, per_second: int) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.rint(seconds * per_second).cast("long"))


def _part(total: Column, by: int, of: int | None = None) -> Column:
    whole = F.floor(total / by).cast("long")
    return whole if of is None else F.pmod(whole, F.lit(of))


def srt(seconds: Column) -> Column:
    """hh:mm:ss,mmm"""
    ms = _units(seconds, 1000)
    return F.format_string("%02d:%02d:%02d,%03d", _part(ms, 3_600_000), _part(ms, 60_000, 60), _part(ms, 1000, 60), F.pmod(ms, F.lit(1000)))


def ass(seconds: Column) -> Column:
    """h:mm:ss.cc"""
    cs = _units(seconds, 100)
    return F.format_string("%d:%02d:%02d.%02d", _part(cs, 360_000), _part(cs, 6_000, 60), _part(cs, 100, 60), F.pmod(cs, F.lit(100)))


def review(seconds: Column) -> Column:
    """mm:ss.mmm, with hours only where there are any"""
    ms = _units(seconds, 1000)
    hours = _part(ms, 3_600_000)
    rest = F.format_string("%02d:%02d.%03d", _part(ms, 60_000, 60), _part(ms, 1000, 60), F.pmod(ms, F.lit(1000)))
    return F.when(hours > 0, F.concat(F.format_string("%02d:", hours), rest)).otherwise(rest)


def parse(text: Column) -> Column:
    """Seconds of [[h:]m:]s with a dot or comma; null if it is no such time."""
    bare = F.replace(F.trim(text), F.lit(","), F.lit("."))
    parts = F.split(bare, ":")
    total = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc * 60 + p.try_cast("double"))
    return F.when(bare.rlike(r"^(?:\d+:){0,2}\d+(?:\.\d+)?$"), total)


def parse_ms(text: Column) -> Column:
    return F.rint(parse(text) * 1000).cast("long")
