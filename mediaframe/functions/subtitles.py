"""Subtitle texts as native expressions: cues and the last end time. Fractions of seconds are whole numbers of milliseconds (centiseconds in ASS), not decimal fractions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode_text(c: Column) -> Column:
    """By byte order mark; UTF-8 without one."""
    head = F.hex(F.substring(c, 1, 3))
    rest = lambda n: F.substring(c, n, 2147483647)
    return F.when(head == "EFBBBF", F.try_validate_utf8(rest(4).cast("string"))).when(head.startswith("FFFE"), F.decode(rest(3), "UTF-16LE")).when(head.startswith("FEFF"), F.decode(rest(3), "UTF-16BE")).otherwise(F.make_valid_utf8(c.cast("string")))


def _time(text: Column, split: str, scale: float, short: bool = False) -> Column:
    parts = F.split(text, ":", -1)
    last = F.split(F.element_at(parts, -1), split, -1)
    seconds = last[0].try_cast("double")
    rest = F.coalesce(F.try_element_at(last, F.lit(2)).try_cast("double"), F.lit(0.0)) * scale
    minutes = F.try_element_at(parts, F.lit(-2)).try_cast("double")
    out = F.when(F.size(parts) == 3, (parts[0].try_cast("double") * 3600 + minutes * 60 + seconds) * 1000 + rest)
    return out.when(F.size(parts) == 2, (minutes * 60 + seconds) * 1000 + rest) if short else out


def srt_time(text: Column) -> Column:
    return _time(text, "[,.]", 1.0)


def vtt_time(text: Column) -> Column:
    return _time(text, "[.]", 1.0, short=True)


def ass_time(text: Column) -> Column:
    return _time(text, "[.]", 10.0)


def _summary(ends: Column, elements: Column) -> Column:
    last = F.array_max(F.filter(ends, lambda e: e.isNotNull()))
    return F.struct(elements.cast("bigint").alias("element_count"), F.when(last > 0, last).alias("duration_ms"))


def _arrows(text: Column) -> Column:
    """The right-hand sides of lines with exactly one arrow."""
    cues = F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.split(F.trim(x), "-->", -1)), lambda p: F.size(p) == 2)
    return F.transform(cues, lambda p: F.trim(p[1]))


def srt(text: Column) -> Column:
    ends = _arrows(text)
    return _summary(F.transform(ends, srt_time), F.size(ends))


def vtt(text: Column) -> Column:
    """Settings may follow the end time."""
    ends = _arrows(text)
    return _summary(F.transform(ends, lambda e: vtt_time(F.split(e, r"\s+")[0])), F.size(ends))


def ass(text: Column) -> Column:
    lines = F.transform(F.split(text, "\r?\n"), F.trim)
    spoken = F.filter(lines, lambda x: x.startswith("Dialogue:"))
    fields = F.transform(spoken, lambda x: F.split(F.substring(x, 10, 2147483647), ",", 10))
    return _summary(F.transform(fields, lambda f: F.when(F.size(f) >= 3, ass_time(F.trim(f[2])))), F.size(spoken))
