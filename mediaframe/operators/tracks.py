"""Aggregations over packets and values derived from track attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def track_sizes(packets: DataFrame, seconds: Column) -> DataFrame:
    """file_id, track_id, stream_size, packets and bit_rate (cut to a whole number) of packets (file_id, track_id, bytes)."""
    sizes = packets.groupBy("file_id", "track_id").agg(F.sum("bytes").cast("bigint").alias("stream_size"), F.count("*").alias("packets"))
    return sizes.withColumn("bit_rate", F.when(seconds > 0, (F.col("stream_size") * 8 / seconds).cast("bigint")))


def frame_rates(frames: DataFrame) -> DataFrame:
    """stream_id, frames, frame_rate = (n - 1) / span in seconds, of frames (stream_id, ms); streams of one frame or no span have none and are left out."""
    found = frames.groupBy("stream_id").agg(F.count("*").alias("frames"), (F.max("ms") - F.min("ms")).alias("span"))
    return found.where("frames > 1 and span > 0").select("stream_id", "frames", ((F.col("frames") - 1) / (F.col("span") / 1000.0)).alias("frame_rate"))


def rate_mode(frames: DataFrame) -> DataFrame:
    """stream_id, deltas (distinct, zero left out) and mode: Constant with one delta, Variable with more."""
    step = F.col("ms") - F.lag("ms").over(Window.partitionBy("stream_id").orderBy("ms"))
    found = frames.withColumn("delta", step).where("delta <> 0").groupBy("stream_id").agg(F.countDistinct("delta").alias("deltas"))
    return found.withColumn("mode", F.when(F.col("deltas") > 1, "Variable").otherwise("Constant"))


def spans(stamps: DataFrame) -> DataFrame:
    """stream_id, first, last and duration_ms (null unless positive) of stamps (stream_id, ms)."""
    found = stamps.groupBy("stream_id").agg(F.min("ms").alias("first"), F.max("ms").alias("last"))
    return found.withColumn("duration_ms", F.when(F.col("last") > F.col("first"), F.col("last") - F.col("first")))


def first_and_last(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value"))


def fill_missing(tracks: DataFrame, found: DataFrame, key: list[str], value: str) -> DataFrame:
    """tracks with nulls of value taken from found by key: a keyed update."""
    return tracks.join(found.select(*key, F.col(value).alias("__found")), key, "left").withColumn(value, F.coalesce(value, "__found")).drop("__found")


def standard(width: Column, height: Column, fps: Column) -> Column:
    """NTSC or PAL by size and rate."""
    ok = width.isin(720, 704, 352)
    near = lambda x: F.abs(fps - x) < 0.1
    return F.when(ok & height.isin(480, 486, 240) & (near(29.97) | near(30.0)), "NTSC").when(ok & height.isin(576, 288) & near(25.0), "PAL")


def dv_bit_rate(height: Column, fps: Column, frame_bytes: Column) -> Column:
    """Of DV video: 12 sequences a frame in 625-line systems, 10 in others, times how many DV25 frames a frame's bytes make."""
    tall = height >= 550
    times = F.when(frame_bytes > 0, F.least(F.lit(8), F.greatest(F.lit(1), F.floor(frame_bytes / F.when(tall, 144000.0).otherwise(120000.0) + 0.5)))).otherwise(1)
    return F.when((fps > 0) & (height > 0), F.floor(10184 * F.when(tall, 12).otherwise(10) * times * 8.0 * fps + 0.5).cast("bigint"))


def derived(**v: Column) -> dict[str, Column]:
    """Values of a video that follow from others, where they are missing: format_version, chroma of DV, colour range and space, aspect ratio, standard, and the bit rate of DV, which
    follows from its structure. v: format, format_version, width, height, pixel_aspect, frame_rate, chroma, color_range, color_space, display_aspect, standard, bit_rate, stream_size and duration_ms."""
    is_dv = F.coalesce(v["format"] == "DV", F.lit(False))
    version = F.coalesce(v["format_version"], F.when(v["format"] == "MPEG-1 Video", "1").when(v["format"] == "MPEG-2 Video", "2"))
    chroma = F.coalesce(v["chroma"], F.when(is_dv & (v["height"] > 0), F.when(v["height"] >= 550, "4:2:0").otherwise("4:1:1")))
    rgb = F.coalesce(chroma == "RGB", F.lit(False))
    frames = F.round(v["duration_ms"] / 1000.0 * v["frame_rate"])
    frame_bytes = F.when(frames > 0, F.floor(v["stream_size"] / frames))
    return {
        "format_version": version, "chroma": chroma, "color_range": F.coalesce(v["color_range"], F.when(~rgb, "Limited")), "color_space": F.coalesce(v["color_space"], F.when(v["format"] != "ProRes", F.when(rgb, "RGB").otherwise("YUV"))),
        "display_aspect": F.coalesce(v["display_aspect"], F.when((v["height"] > 0) & (v["width"] > 0), v["width"] * F.coalesce(v["pixel_aspect"], F.lit(1.0)) / v["height"])), "standard": F.coalesce(v["standard"], standard(v["width"], v["height"], v["frame_rate"])),
        "bit_rate": F.coalesce(F.when(is_dv, dv_bit_rate(v["height"], v["frame_rate"], frame_bytes)), v["bit_rate"]),
    }


def finalize(tracks: DataFrame) -> DataFrame:
    """Video columns derived where missing: format_version, chroma of DV, colour range and space, aspect ratio, standard. tracks: format, format_version, width, height, pixel_aspect, frame_rate, chroma, color_range, color_space."""
    version = F.coalesce("format_version", F.when(F.col("format") == "MPEG-1 Video", "1").when(F.col("format") == "MPEG-2 Video", "2"))
    chroma = F.coalesce("chroma", F.when(F.col("format") == "DV", F.when(F.col("height") >= 550, "4:2:0").otherwise("4:1:1")))
    rgb = F.coalesce(F.col("chroma") == "RGB", F.lit(False))
    out = tracks.withColumn("format_version", version).withColumn("chroma", chroma)
    out = out.withColumn("color_range", F.coalesce("color_range", F.when(~rgb, "Limited")))
    out = out.withColumn("color_space", F.coalesce("color_space", F.when(F.col("format") != "ProRes", F.when(rgb, "RGB").otherwise("YUV"))))
    ratio = F.when(F.col("height") > 0, F.col("width") * F.col("pixel_aspect") / F.col("height"))
    return out.withColumn("display_aspect", ratio).withColumn("standard", standard(F.col("width"), F.col("height"), F.col("frame_rate")))
