"""Reports as text columns, for write.text or write.csv."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediaframe.functions.formatting import escape_xml, line


def csv_row(file: Column, container: Column, size: Column, ms: Column, video: Column, width: Column, height: Column, frame_rate: Column, audio: Column, channels: Column, rate: Column) -> Column:
    """A row of the batch table; texts are quoted and, as in the format, not escaped."""
    quoted = lambda c: F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"'))
    plain = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    whole = F.bround(F.coalesce(ms, F.lit(0.0)), 0).cast("bigint").cast("string")
    resolution = F.concat(width.cast("string"), F.lit("x"), height.cast("string"))
    return F.concat_ws(",", quoted(file), quoted(container), plain(size), whole, quoted(video), quoted(resolution), quoted(F.when(frame_rate.isNotNull(), F.format_string("%.3f", frame_rate.cast("double")))), quoted(audio), plain(channels), plain(rate))


def json_report(file: Column, fields: dict[str, Column]) -> Column:
    """An object whose values are all strings; missing ones are left out."""
    track = F.struct(F.lit("General").alias("@type"), *(v.cast("string").alias(k) for k, v in fields.items()))
    return F.to_json(F.struct(F.struct(file.alias("@ref"), F.array(track).alias("track")).alias("media")))


def xml_element(tag: str, value: Column, indent: int) -> Column:
    return F.concat(F.lit(" " * indent + f"<{tag}>"), escape_xml(value), F.lit(f"</{tag}>"))


def text_block(title: str, fields: dict[str, Column]) -> Column:
    """A title and a line for each value that isn't null."""
    return F.concat_ws("\n", F.lit(title), *(line(F.lit(k), v.cast("string")) for k, v in fields.items()))
