"""From files to reports. One scan of the contents gives typed rows of every format (operators/walk.py); they say facts
(operators/facts.py), which are grouped once by field and once by file; the report is built of a file's facts.

What is shuffled are facts, a few dozen short texts a track. Values that the container doesn't state are derived as the last step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaframe.functions import codecs
from mediaframe.functions.lookups import avi_video_codec, container_name, wave_format
from mediaframe.operators import reports, tracks
from mediaframe.operators.containers import bit_rate
from mediaframe.operators.facts import facts_of
from mediaframe.operators.walk import WALKS, rows_of

COMMON = "stream_id int, format string, format_info string, format_profile string, codec_id string, bit_rate bigint, bit_rate_mode string, stream_size bigint, duration_ms double, frame_count bigint, compression_mode string, language string, title string, default_flag boolean, forced_flag boolean"
VIDEO = COMMON + ", format_version string, format_level string, format_tier string, width int, height int, stored_width int, stored_height int, frame_rate double, frame_rate_mode string, bit_depth int, chroma string, scan_type string, scan_order string, color_space string, color_range string, color_primaries string, transfer string, matrix string, hdr_format string, pixel_aspect double, display_aspect double, standard string, encoded_library string"
AUDIO = COMMON + ", channels int, channel_layout string, sampling_rate int, bit_depth int, dialnorm_db int"
TEXT = COMMON
GENERAL = "duration_ms double, format_profile string, format_version string, codec_id string, title string, artist string, album string, genre string, recorded_date string, encoded_application string, encoded_library string, cover_art_present boolean, overall_bitrate bigint"
MENUS = "array<struct<chapters:array<struct<timestamp_ms:double,title:string>>>>"
#: Formats without a bit depth of their own: what a container says of theirs means nothing.
NO_DEPTH = ("AAC", "AC-3", "E-AC-3", "Opus")


def _typed(schema: str, **values: Column) -> Column:
    kinds = dict(x.strip().split(" ") for x in schema.split(","))
    return F.struct(*(values.get(k, F.lit(None)).try_cast(kind).alias(k) for k, kind in kinds.items()))


class Track:
    """Facts of a track by name, as values of a type; `first` takes the first of several that there is."""

    def __init__(self, facts: Column, general: Column, form: Column):
        self.facts, self.general, self.form = facts, general, form

    def text(self, name: str) -> Column:
        return self.facts[name]

    def number(self, name: str) -> Column:
        return self.facts[name].try_cast("double")

    def whole(self, name: str) -> Column:
        return F.nullif(self.facts[name].try_cast("bigint"), F.lit(0).cast("bigint"))

    def first(self, *names: str) -> Column:
        return F.coalesce(*(self.whole(n) for n in names))

    def common(self, place: Column, duration: Column, rate: Column, size: Column) -> dict[str, Column]:
        ordinal = self.form == "MPEGTS"
        return {
            "stream_id": F.when(ordinal, place + 1).otherwise(F.coalesce(self.text("stream_id").try_cast("bigint"), self.text("track").try_cast("bigint"))), "duration_ms": duration, "bit_rate": F.coalesce(rate, bit_rate(size, duration)), "stream_size": size, "title": self.text("track_title"),
            **{k: self.text(k) for k in ("language", "default_flag", "forced_flag", "bit_rate_mode")},
        }


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def _video(t: Track, place: Column) -> Column:
    avi = avi_video_codec(F.coalesce(t.text("avi_code"), F.lit("RGB")))
    code = F.coalesce(t.text("video_format"), t.text("format"), F.when(t.form == "AVI", avi["codec"]))
    meta = lambda k: F.when(t.general["meta_" + k].try_cast("double") > 0, t.general["meta_" + k].try_cast("double"))
    height = F.coalesce(t.first("track_height", "height", "coded_height", "set_height"), meta("height").cast("bigint"))
    height = F.when((t.form == "MXF") & (t.text("scan_type") == "Interlaced"), height * 2).otherwise(height)
    width = F.coalesce(t.first("track_width", "width", "coded_width", "set_width"), meta("width").cast("bigint"))
    paced = F.when(t.number("last_ms") > t.number("first_ms"), (t.number("frame_count") - 1) / ((t.number("last_ms") - t.number("first_ms")) / 1000.0))
    fps = F.coalesce(t.number("frame_rate"), t.number("frame_rate_of"), _ratio(t.number("samples") * t.number("timescale"), t.number("units")), t.number("set_frame_rate"), meta("framerate"), F.when(t.form == "ASF", paced))
    own = F.when(t.form.isin("MPEGTS"), t.number("frame_count") / F.when(fps > 0, fps) * 1000.0)
    duration = F.coalesce(own, t.number("duration_ms"), t.general["duration_ms"].try_cast("double"))
    size = t.whole("stream_size")
    shown = _ratio(t.number("shown_width"), t.number("shown_height"))
    pixel = F.coalesce(t.number("pixel_aspect"), shown / F.when((width > 0) & (height > 0), width / height))
    wide = F.concat_ws("/", t.text("across"), t.text("down"))
    chroma = F.coalesce(t.text("chroma"), F.when(wide == "1/1", "4:4:4").when(wide == "2/1", "4:2:2").when(wide == "2/2", "4:2:0").when(wide.startswith("4/"), "4:1:1"))
    rate = F.coalesce(t.whole("bit_rate"), F.when(t.form == "ASF", t.whole("average_rate")), F.when((t.form == "FLV") & duration.isNull(), (meta("videodatarate") * 1000).cast("bigint")))
    labels = F.nullif(F.concat_ws("-", t.text("container_label"), t.text("picture_label")), F.lit(""))
    typed = F.when(t.text("object_type").isNotNull() & (code == "MPEG-4 Visual"), F.concat_ws("-", t.text("codec_id"), t.text("object_type"))).otherwise(t.text("codec_id"))
    stored = lambda a, b: F.coalesce(t.whole(a), t.whole(b))
    derived = tracks.derived(
        format=code, format_version=F.coalesce(t.text("format_version"), F.when(code == "VC-3", t.text("vc3_version"))), width=width, height=height, pixel_aspect=pixel, frame_rate=fps, chroma=chroma, color_range=t.text("color_range"), color_space=t.text("color_space"),
        display_aspect=F.coalesce(t.number("display_aspect"), shown), standard=t.text("standard"), bit_rate=F.coalesce(rate, bit_rate(size, duration)), stream_size=size, duration_ms=duration,
    )
    own_fields = {k: t.text(k) for k in ("format_level", "format_tier", "scan_type", "scan_order", "color_primaries", "transfer", "matrix", "hdr_format", "frame_rate_mode", "encoded_library", "frame_count")}
    values = t.common(place, duration, rate, size) | own_fields | {
        "format": code, "format_info": F.coalesce(t.text("video_info"), t.text("format_info"), F.when(t.form == "AVI", avi["info"])), "format_profile": F.coalesce(t.text("format_profile"), F.when(code == "MPEG-4 Visual", t.text("visual_profile"))), "codec_id": F.coalesce(labels, typed, t.text("avi_code")),
        "width": width, "height": height, "stored_width": stored("set_width", "coded_width"), "stored_height": stored("set_height", "coded_height"), "frame_rate": fps, "bit_depth": t.text("bit_depth"), "pixel_aspect": pixel,
    } | derived
    return _typed(VIDEO, **values)


def _audio(t: Track, place: Column) -> Column:
    tag = t.text("format_tag").try_cast("bigint")
    avi = F.when(t.form == "AVI", wave_format(tag)["codec"])
    code = F.coalesce(t.text("audio_format"), t.text("format"), avi)
    granule = _ratio(t.number("granule") * 1000.0, F.coalesce(t.number("sampling_rate"), F.lit(48000.0)))
    size = t.whole("stream_size")
    wav = F.when((t.form == "WAV") & (t.whole("bit_rate") > 0), size * 8 / t.whole("bit_rate") * 1000.0)
    duration = F.coalesce(t.number("duration_ms"), wav, F.when(t.form == "Ogg", granule), t.general["duration_ms"].try_cast("double"))
    is_aac = (code == "AAC") & t.text("aac_profile").isNotNull()
    choose = lambda aac, *plain: F.when(is_aac, t.text(aac)).otherwise(F.coalesce(*(t.text(p) for p in plain)))
    depth = F.when(~code.isin(*NO_DEPTH), F.coalesce(t.text("bit_depth"), t.text("bit_depth_of_entry")))
    typed = F.when(is_aac, F.concat_ws("-", t.text("codec_id"), t.text("object_type"), t.text("aac_type"))).otherwise(F.coalesce(t.text("codec_id"), F.hex(tag)))
    count = choose("aac_channels", "channels").try_cast("int")
    values = t.common(place, duration, t.whole("bit_rate"), F.when(t.form != "WAV", size).otherwise(size)) | {
        "format": code, "format_info": F.coalesce(t.text("audio_info"), t.text("format_info"), F.when(t.form == "AVI", wave_format(tag)["info"])), "format_profile": F.coalesce(F.when(is_aac, t.text("aac_profile")), t.text("format_profile"), F.when((code == "PCM") & t.form.isin("MPEG4", "QuickTime"), t.text("pcm_profile"))),
        "codec_id": typed, "channels": count, "channel_layout": F.coalesce(choose("aac_layout", "channel_layout"), codecs.layout_of_count(count)), "sampling_rate": choose("aac_rate", "sampling_rate").try_cast("double"), "bit_depth": depth, "dialnorm_db": t.text("dialnorm_db"),
        "frame_count": t.text("frame_count"), "compression_mode": F.coalesce(t.text("compression_mode"), F.when(t.form.isin("MPEG4", "QuickTime"), F.when(code.isin("PCM", "ALAC", "FLAC"), "Lossless").otherwise("Lossy"))),
    }
    return _typed(AUDIO, **values)


def _text(t: Track, place: Column) -> Column:
    values = t.common(place, t.number("duration_ms"), F.lit(None).cast("bigint"), t.whole("stream_size"))
    return _typed(TEXT, **values | {"format": F.coalesce(t.text("format"), F.trim(t.text("codec_id"))), "format_info": t.text("format_info"), "codec_id": t.text("codec_id")})


def _maps(facts: DataFrame) -> DataFrame:
    """A row for each file: its own facts, and its tracks in order, each with its number, place and facts."""
    grouped = facts.groupBy("path", "format", "length").agg(F.collect_list(F.struct("track", "field", "value")).alias("all"))
    of = lambda t: F.map_from_entries(F.transform(F.filter("all", lambda x: (x["track"] == t) & (x["field"] != "")), lambda x: F.struct(x["field"], x["value"])))
    numbered = lambda field: F.array_sort(F.array_distinct(F.transform(F.filter("all", lambda x: (x["track"] >= 0) & (x["field"] == field)), lambda x: x["track"])))
    chapters = F.transform(numbered("chapter"), of)
    return grouped.select("path", "format", "length", of(F.lit(-1)).alias("g"), F.transform(numbered("kind"), lambda t: F.map_concat(of(t), F.create_map(F.lit("track"), t.cast("string")))).alias("tracks"), chapters.alias("chapters"))


def inspect(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """A report for each file (path, length, content): path, general, videos, audios, texts, menus, error. tasks: how many the facts are
    dealt to, by file, which should grow with the files; none given: the session's shuffle partitions.

    The contents are scanned once, whatever formats they have. An empty file has a report of size 0 without
    tracks. A file of no known format, or with null content, has an error and no tracks; of a
    broken file what could be read is there, with an error; so has a file of a known format in which nothing is found. Paths are unique."""
    found = _maps(facts_of(rows_of(files), tasks))
    g, form = F.col("g"), F.col("format")
    known = lambda name: g[name].try_cast("double")
    ticks = known("ticks") * F.coalesce(known("timecode_scale"), F.lit(1e6)) / 1e6
    edited = _ratio(known("edit_units") * 1000.0, known("edit_rate"))
    flv = F.coalesce(F.when(known("meta_duration") > 0, known("meta_duration") * 1000.0), F.nullif(known("last_ms"), F.lit(0.0)))
    duration = F.coalesce(known("duration_ms"), ticks, edited, flv)
    found = found.withColumn("g", F.map_concat(F.map_filter(g, lambda k, _: k != "duration_ms"), F.map_filter(F.create_map(F.lit("duration_ms"), duration.cast("string")), lambda _, v: v.isNotNull())))

    def of_kind(kind: str, build) -> Column:
        placed = F.transform("tracks", lambda m, k: F.struct(m.alias("m"), k.alias("k")))
        return F.transform(F.filter(placed, lambda x: x["m"]["kind"] == kind), lambda x: build(Track(x["m"], F.col("g"), form), x["k"]))

    found = found.select("path", "format", "length", "g", "chapters", of_kind("Video", _video).alias("videos"), of_kind("Audio", _audio).alias("audios"), of_kind("Text", _text).alias("texts"))
    longest = F.array_max(F.transform(F.concat(F.transform("videos", lambda v: v["duration_ms"]), F.transform("audios", lambda v: v["duration_ms"])), lambda d: d))
    name = F.when(form.isin("Matroska", "WebM"), F.when(g["doc_type"] == "webm", "WebM").otherwise(F.coalesce(container_name(form), F.lit("Unknown")))).otherwise(F.coalesce(container_name(form), F.lit("Unknown")))
    whole = {k: g[k] for k in ("format_profile", "format_version", "codec_id", "title", "artist", "album", "genre", "recorded_date", "encoded_application", "encoded_library", "cover_art_present", "overall_bitrate")}
    whole["duration_ms"] = F.coalesce(g["duration_ms"].try_cast("double"), longest)
    whole["encoded_application"] = F.coalesce(whole["encoded_application"], g["meta_encoder"])
    own = _typed(GENERAL, **whole)
    general = F.struct(name.alias("format"), *(own[x.split()[0]].alias(x.split()[0]) for x in GENERAL.split(", ")))
    titled = F.transform("chapters", lambda c, k: F.struct((F.coalesce(c["chapter_start"].try_cast("double"), F.lit(0.0)) / 1e6).alias("timestamp_ms"), F.coalesce(c["chapter_title"], F.concat(F.lit("Chapter "), (k + 1).cast("string"))).alias("title")))
    menus = F.when(F.size("chapters") > 0, F.array(F.struct(titled.alias("chapters")))).otherwise(F.array().cast(MENUS))
    nothing = form.isin(*WALKS) & (F.size("videos") + F.size("audios") + F.size("texts") == 0) & (F.map_entries("g") == F.array().cast("array<struct<key:string,value:string>>"))
    error = F.when(form.isNull() | ((form == "Unknown") & (F.col("length") > 0)), "no known format").when(g["broken"].isNotNull(), "broken").when(nothing, "nothing found")
    return reports.opened(found.select("path", "length", general.alias("general"), "videos", "audios", "texts", menus.alias("menus"), error.alias("error"))).drop("length")


def compare_files(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """The differences of the reports of two sets of files; pairs: pair_id, path_a, path_b."""
    whole = lambda df, side: inspect(df).select(F.col("path").alias(f"path_{side}"), F.struct("general", "videos", "audios", "texts").alias(side))
    return reports.compare(pairs.join(whole(a, "a"), "path_a").join(whole(b, "b"), "path_b"))
