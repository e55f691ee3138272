"""Texts of sizes, durations and rates, with exact integer rounding where two decimals are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(n: Column) -> Column:
    """Digits in groups of three, apart by spaces."""
    return F.regexp_replace(n.cast("string"), r"(?<=\d)(?=(?:\d{3})+$)", " ")


def _hundredths(n: Column, unit: int) -> Column:
    """n / unit with two decimals, ties to even, by integers; n below 2^56."""
    scaled = n.cast("decimal(38,0)") * 100
    low = F.floor(scaled / unit).cast("decimal(38,0)")
    rest = (scaled - low * unit) * 2
    up = F.when((rest > unit) | ((rest == unit) & (low % 2 == 1)), low + 1).otherwise(low).cast("bigint")
    return F.concat(F.floor(up / 100).cast("string"), F.lit("."), F.lpad((up % 100).cast("string"), 2, "0"))


def file_size(n: Column) -> Column:
    out = F.concat(n.cast("string"), F.lit(" Bytes"))
    for power, name in ((10, "KiB"), (20, "MiB"), (30, "GiB")):
        out = F.when(n >= 1 << power, F.concat(_hundredths(n, 1 << power), F.lit(f" {name}"))).otherwise(out)
    return out


def duration(ms: Column) -> Column:
    """Hours, minutes, seconds and milliseconds from the first that isn't 0; halves round up."""
    t = F.floor(F.greatest(ms.cast("double"), F.lit(0.0)) + 0.5).cast("bigint")
    parts = [(F.floor(t / 3_600_000), "h"), (F.floor(t % 3_600_000 / 60_000), "min"), (F.floor(t % 60_000 / 1000), "s"), (t % 1000, "ms")]
    text = [F.concat(v.cast("string"), F.lit(f" {u}")) for v, u in parts]
    return F.when(t >= 3_600_000, F.concat_ws(" ", *text)).when(t >= 60_000, F.concat_ws(" ", *text[1:])).when(t >= 1000, F.concat_ws(" ", *text[2:])).otherwise(text[3])


def bit_rate(bps: Column) -> Column:
    return F.when(bps >= 1000, F.concat(number(F.floor(bps / 1000)), F.lit(" kb/s"))).otherwise(F.concat(number(bps), F.lit(" b/s")))


def chapter_time(ms: Column) -> Column:
    """HH:MM:SS.mmm of whole milliseconds."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours = F.floor(ms / 3_600_000)
    return F.concat(F.when(hours < 100, two(hours)).otherwise(hours.cast("string")), F.lit(":"), two(F.floor(ms % 3_600_000 / 60_000)), F.lit(":"), two(F.floor(ms % 60_000 / 1000)), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def aspect_ratio(width: Column, height: Column) -> Column:
    """16:9 and 4:3 within 0.05, else the ratio with three decimals."""
    ratio = width / height
    near = lambda x: F.abs(ratio - x) < 0.05
    return F.when(near(16 / 9), "16:9").when(near(4 / 3), "4:3").otherwise(F.format_string("%.3f", ratio))


def line(key: Column, value: Column) -> Column:
    """A key padded to 40 characters, never cut, and its value."""
    return F.concat(F.rpad(key, F.greatest(F.length(key), F.lit(40)), F.lit(" ")), F.lit(" : "), value)


def escape_xml(text: Column) -> Column:
    for sign, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "apos")):
        text = F.replace(text, F.lit(sign), F.lit(f"&{name};"))
    return text


# As the views of the desktop show them -----------------------------------------------------------------------------------


def _places(n: Column, unit: int, places: int) -> Column:
    """n / unit with some decimals, ties up, by whole numbers of 64 bits; quotients of decimals are themselves rounded."""
    n, div = n.cast("decimal(38,0)").cast("bigint"), lambda a, b: F.call_function("div", a, F.lit(b).cast("bigint"))
    rest = F.pmod(n, F.lit(unit).cast("bigint"))
    whole = div(n - rest, unit) * 10**places + div(rest * (2 * 10**places) + unit, 2 * unit)
    if not places:
        return whole.cast("string")
    return F.concat(F.floor(whole / 10**places).cast("string"), F.lit("."), F.lpad((whole % 10**places).cast("string"), places, "0"))


def batch_size(n: Column) -> Column:
    return F.when(n >= 1 << 30, F.concat(_places(n, 1 << 30, 2), F.lit(" GB"))).when(n >= 1 << 20, F.concat(_places(n, 1 << 20, 2), F.lit(" MB"))).otherwise(F.concat(_places(n, 1 << 10, 1), F.lit(" KB")))


def compared_size(n: Column) -> Column:
    """Two decimals in the largest unit up to TB that gives 1 at least; nothing is 0 B."""
    out = F.concat(_places(n, 1, 2), F.lit(" B"))
    for power, name in ((10, "KB"), (20, "MB"), (30, "GB"), (40, "TB")):
        out = F.when(n >= 1 << power, F.concat(_places(n, 1 << power, 2), F.lit(f" {name}"))).otherwise(out)
    return F.when(F.coalesce(n, F.lit(0)) == 0, "0 B").otherwise(out)


def summary_size(n: Column) -> Column:
    grouped = F.regexp_replace(n.cast("string"), r"(?<=\d)(?=(?:\d{3})+$)", ",")
    return F.when(n >= 1 << 30, F.concat(_places(n, 1 << 30, 2), F.lit(" GiB ("), grouped, F.lit(" bytes)"))).when(n >= 1 << 20, F.concat(_places(n, 1 << 20, 1), F.lit(" MiB"))).otherwise(F.concat(_places(n, 1 << 10, 0), F.lit(" KiB")))


def _clock(ms: Column, minutes: int) -> Column:
    """h:mm:ss.mmm, or without hours, minutes with so many digits."""
    two = lambda c, n: F.lpad(c.cast("string"), n, "0")
    hours, rest = F.floor(ms / 3_600_000), F.floor(ms % 3_600_000 / 60_000)
    tail = F.concat(F.lit(":"), two(F.floor(ms % 60_000 / 1000), 2), F.lit("."), two(ms % 1000, 3))
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit(":"), two(rest, 2), tail)).otherwise(F.concat(two(rest, minutes) if minutes > 1 else rest.cast("string"), tail))


def compared_duration(ms: Column) -> Column:
    """A dash where there is none; fractions of milliseconds are cut off."""
    return F.when(F.isnan(ms.cast("double")) | (F.coalesce(ms.cast("double"), F.lit(0.0)) == 0), "—").otherwise(_clock(F.floor(ms).cast("bigint"), 2))


def summary_duration(ms: Column) -> Column:
    """In words and as a clock; halves of milliseconds round up."""
    t = F.floor(ms.cast("double") + 0.5).cast("bigint")
    parts = [F.concat(v.cast("string"), F.lit(u)) for v, u in ((F.floor(t / 3_600_000), "h"), (F.floor(t % 3_600_000 / 60_000), "m"), (F.floor(t % 60_000 / 1000), "s"), (t % 1000, "ms"))]
    words = F.when(t >= 3_600_000, F.concat_ws(" ", *parts)).when(t >= 60_000, F.concat_ws(" ", *parts[1:])).when(t >= 1000, F.concat_ws(" ", *parts[2:])).otherwise(parts[3])
    return F.when(ms > 0, F.concat(words, F.lit(" ("), _clock(t, 1), F.lit(")"))).otherwise("—")


def compared_rate(bps: Column) -> Column:
    return F.when(F.coalesce(bps, F.lit(0)) == 0, "—").when(bps >= 1_000_000, F.concat(_places(bps, 1_000_000, 2), F.lit(" Mbps"))).otherwise(F.concat(_places(bps, 1000, 0), F.lit(" kbps")))


def summary_rate(bps: Column) -> Column:
    shown = F.when(bps >= 1_000_000, F.concat(_places(bps, 1_000_000, 2), F.lit(" Mb/s"))).when(bps >= 1000, F.concat(_places(bps, 1000, 0), F.lit(" kb/s"))).otherwise(F.concat(bps.cast("string"), F.lit(" b/s")))
    return F.when(bps > 0, shown).otherwise("—")


def hertz(hz: Column) -> Column:
    return F.when(hz >= 1000, F.concat(_places(hz, 1000, 1), F.lit(" kHz"))).otherwise(F.concat(hz.cast("string"), F.lit(" Hz")))
