"""Reports: one row for each file with general (a struct), videos, audios, texts (arrays of structs) and menus (arrays of chapters), and what is derived from and written of them.

Structs may lack any field; what they lack counts as null. All is built of native expressions over the arrays,
so a report is written by the task that holds its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaframe.functions import formatting
from mediaframe.functions.formatting import escape_xml, line
from mediaframe.functions.lookups import specified

TRACKS = ("videos", "audios", "texts")


class Fields:
    """Fields of a report's structs by name; a field that the schema lacks is null."""

    def __init__(self, schema: T.StructType):
        self.names: dict[str, set[str]] = {}
        for f in schema.fields:
            inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
            self.names[f.name] = set(inner.fieldNames()) if isinstance(inner, T.StructType) else set()

    def of(self, part: str, row: Column):
        return lambda name, kind="string": row[name] if name in self.names.get(part, ()) else F.lit(None).cast(kind)

    def array(self, part: str) -> Column:
        return F.coalesce(F.col(part), F.array()) if part in self.names else F.array()


def plain(x: Column) -> Column:
    """A double in the shortest digits, never with an exponent; whole ones without a point."""
    digits = x.cast("string")
    long = F.regexp_replace(x.cast("decimal(38,12)").cast("string"), r"\.?0+$", "")
    return F.when(digits.contains("E"), F.when(x == F.floor(x), F.floor(x).cast("decimal(38,0)").cast("string")).otherwise(long)).otherwise(F.regexp_replace(digits, r"\.0$", ""))


def seconds(ms: Column) -> Column:
    return plain(ms.cast("double") / 1000.0)


def fixed(x: Column, digits: int) -> Column:
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", x.cast("double")))


def yes_no(flag: Column) -> Column:
    return F.when(F.coalesce(flag.cast("boolean"), F.lit(False)), "Yes").otherwise("No")


# Derived values -----------------------------------------------------------------------------------------------------


def primary(part: str) -> Column:
    """The first track of a kind, or null."""
    return F.get(F.col(part), F.lit(0))


def track_count(df: DataFrame) -> Column:
    """The general track and all others, menus too."""
    fields = Fields(df.schema)
    return sum((F.size(fields.array(p)) for p in (*TRACKS, "menus")), F.lit(1))


def is_empty(df: DataFrame) -> Column:
    fields = Fields(df.schema)
    size = fields.of("general", F.col("general"))("file_size", "bigint")
    return (F.size(fields.array("videos")) == 0) & (F.size(fields.array("audios")) == 0) & (F.coalesce(size, F.lit(0)) == 0)


def is_hdr(primaries: Column, transfer: Column, hdr_format: Column) -> Column:
    text = lambda c: F.upper(F.coalesce(c, F.lit("")))
    return text(primaries).contains("2020") | text(transfer).contains("PQ") | text(transfer).contains("ST2084") | text(transfer).contains("HLG") | (text(hdr_format) != "")


def computed_bit_rate(size: Column, ms: Column) -> Column:
    return F.when((size > 0) & (ms > 0), size * 8 / (ms / 1000.0))


def opened(df: DataFrame, path: str = "path", size: str = "length") -> DataFrame:
    """What opening a file adds to its report: its size, path and, where the report has none, name, and the overall bit rate of a positive duration."""
    g = F.col("general")
    fields = Fields(df.schema).of("general", g)
    ms = fields("duration_ms", "double")
    rate = F.when((ms > 0) & (F.col(size) > 0), (F.col(size) * 8 / (ms / 1000.0)).cast("bigint")).otherwise(fields("overall_bitrate", "bigint"))
    name = F.coalesce(fields("file_name"), F.nullif(F.element_at(F.split(F.col(path), "/"), -1), F.lit("")))
    return df.withColumn("general", g.withField("file_size", F.col(size)).withField("file_path", F.col(path)).withField("file_name", name).withField("overall_bitrate", rate))


def without_errors(df: DataFrame) -> DataFrame:
    """Reports of files that could be read; df has a column error."""
    return df.where(F.col("error").isNull())


# Comparison ---------------------------------------------------------------------------------------------------------


def _pairwise(inner: dict[str, Fields], part: str, category: str, of):
    """The rules of a kind of track for the i-th tracks x and y of both reports."""

    def each(z: Column, i: Column) -> Column:
        return F.array(*of((inner["a"].of(part, z["x"]), inner["b"].of(part, z["y"])), F.concat(F.lit(f"{category} #"), (i + 1).cast("string"))))

    return each


def compare(pairs: DataFrame) -> DataFrame:
    """pair_id, seq, category, field, value_a, value_b: a row for each difference of the reports a and b (structs) of a pair, in the order of the rules. Tracks are compared by their place, as far as both have one."""
    inner = {s: Fields(pairs.schema[s].dataType) for s in "ab"}
    text = lambda c: c.cast("string")

    def row(category: Column, field: str, differs: Column, value_a: Column, value_b: Column) -> Column:
        return F.struct(category.alias("category"), F.lit(field).alias("field"), F.coalesce(value_a, F.lit("")).alias("value_a"), F.coalesce(value_b, F.lit("")).alias("value_b"), F.coalesce(differs, F.lit(False)).alias("differs"))

    def rule(category: Column, field: str, pair: tuple, name: str, show, kind: str = "string", differs=lambda x, y: ~x.eqNullSafe(y)) -> Column:
        x, y = pair[0](name, kind), pair[1](name, kind)
        return row(category, field, differs(x, y), show(x), show(y))

    general = tuple(inner[s].of("general", F.col(f"{s}.general")) for s in "ab")
    own = F.lit("General")
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    rules = [
        rule(own, "Container Format", general, "format", text), rule(own, "Duration", general, "duration_ms", lambda c: F.concat(fixed(zero(c) / 1000.0, 2), F.lit("s")), "double", lambda x, y: F.abs(zero(x) - zero(y)) > 500.0),
        rule(own, "File Size", general, "file_size", lambda c: F.concat(text(c), F.lit(" bytes")), "bigint", lambda x, y: (x != y) & (x > 0) & (y > 0)),
    ]
    array = lambda s, part: F.coalesce(F.col(f"{s}.{part}"), F.array()) if part in inner[s].names else F.array()
    sized = lambda c, unit: F.concat(text(c), F.lit(unit))

    def shown_hdr(c: Column) -> Column:
        return F.when(c.isNull(), "None").otherwise(F.concat(F.lit('Some("'), c, F.lit('")')))

    def video(pair: tuple, name: Column) -> list[Column]:
        side = lambda f: F.concat_ws("x", text(f("width", "int")), text(f("height", "int")))
        return [
            rule(name, "Format / Codec", pair, "format", text), row(name, "Resolution", ~pair[0]("width", "int").eqNullSafe(pair[1]("width", "int")) | ~pair[0]("height", "int").eqNullSafe(pair[1]("height", "int")), side(pair[0]), side(pair[1])),
            rule(name, "Frame Rate", pair, "frame_rate", lambda c: F.concat(fixed(zero(c), 3), F.lit(" fps")), "double", lambda x, y: F.abs(zero(x) - zero(y)) > 0.05),
            rule(name, "Bit Depth", pair, "bit_depth", lambda c: sized(c, " bit"), "int"), rule(name, "HDR Format", pair, "hdr_format", shown_hdr),
        ]

    def audio(pair: tuple, name: Column) -> list[Column]:
        return [rule(name, "Format / Codec", pair, "format", text), rule(name, "Channels", pair, "channels", lambda c: sized(c, " ch"), "int"), rule(name, "Sampling Rate", pair, "sampling_rate", lambda c: sized(c, " Hz"), "int")]

    groups = [F.array(*rules)]
    for part, category, of in (("videos", "Video", video), ("audios", "Audio", audio), ("texts", "Subtitles", None)):
        a, b = array("a", part), array("b", part)
        groups.append(F.array(row(F.lit(category), "Track Count", F.size(a) != F.size(b), text(F.size(a)), text(F.size(b)))))
        if of and all(inner[s].names.get(part) for s in "ab"):
            both = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
            both = F.slice(both, F.lit(1), F.least(F.size(a), F.size(b)))
            groups.append(F.flatten(F.transform(both, _pairwise(inner, part, category, of))))
    found = F.filter(F.concat(*groups), lambda r: r["differs"])
    return pairs.select("pair_id", F.posexplode(found).alias("seq", "d")).select("pair_id", "seq", "d.category", "d.field", "d.value_a", "d.value_b")


def identical(pairs: DataFrame, differences: DataFrame) -> DataFrame:
    """pair_id, differences (how many) and is_identical of every pair."""
    counted = differences.groupBy("pair_id").agg(F.count("*").alias("differences"))
    return pairs.select("pair_id").join(counted, "pair_id", "left").select("pair_id", F.coalesce("differences", F.lit(0)).alias("differences"), F.col("differences").isNull().alias("is_identical"))


def expected_fields(reports: DataFrame, other: str) -> DataFrame:
    """path, field, ours, theirs: where the first video's size, the first audio's channels or the container differ from those in the JSON text of column other, as another tool writes it; an absent value of theirs isn't compared."""
    track = "array<struct<`@type`:string,Format:string,Width:string,Height:string,Channels:string>>"
    theirs = F.from_json(F.col(other), f"struct<media:struct<track:{track}>>")["media"]["track"]
    first = lambda kind: F.get(F.filter(theirs, lambda t: t["@type"] == kind), F.lit(0))
    fields = Fields(reports.schema)
    g, v, a = fields.of("general", F.col("general")), fields.of("videos", primary("videos")), fields.of("audios", primary("audios"))
    rows = [("General.Format", g("format"), first("General")["Format"]), ("Video.Width", v("width", "int").cast("string"), first("Video")["Width"]), ("Video.Height", v("height", "int").cast("string"), first("Video")["Height"]), ("Audio.Channels", a("channels", "int").cast("string"), first("Audio")["Channels"])]
    found = F.filter(F.array(*(F.struct(F.lit(n).alias("field"), o.alias("ours"), t.alias("theirs")) for n, o, t in rows)), lambda r: r["theirs"].isNotNull() & r["ours"].isNotNull() & (F.lower(r["ours"]) != F.lower(r["theirs"])))
    return reports.select("path", F.inline(found))


# Texts --------------------------------------------------------------------------------------------------------------


def _numbered(part: str, title: str, count: Column, i: Column) -> Column:
    return F.when(count > 1, F.concat(F.lit(f"{title} #"), (i + 1).cast("string"))).otherwise(title)


def _block(title: Column, lines: list[tuple[str, Column]], more: Column | None = None) -> Column:
    """A title, a line for each value that isn't null, and an empty line."""
    shown = F.filter(F.array(*(line(F.lit(k), v) for k, v in lines)), lambda x: x.isNotNull())
    return F.concat(F.array_join(F.concat(F.array(title), shown if more is None else F.concat(shown, more)), "\n"), F.lit("\n\n"))


def text(df: DataFrame) -> Column:
    """The report in aligned lines: General, Video, Audio, Text and Menu, in this order."""
    fields = Fields(df.schema)
    g = fields.of("general", F.col("general"))
    size, ms, rate = g("file_size", "bigint"), g("duration_ms", "double"), g("overall_bitrate", "bigint")
    out = [_block(F.lit("General"), [
        ("Complete name", g("file_name")), ("Format", g("format")), ("Format profile", g("format_profile")), ("Format version", g("format_version")), ("Codec ID", g("codec_id")), ("File size", F.when(size > 0, formatting.file_size(size))),
        ("Duration", F.when(ms.isNotNull(), formatting.duration(ms))), ("Overall bit rate", formatting.bit_rate(rate)), ("Movie name / Title", g("title")), ("Performer / Artist", g("artist")), ("Album", g("album")), ("Genre", g("genre")),
        ("Recorded date", g("recorded_date")), ("Writing application", g("encoded_application")), ("Writing library", g("encoded_library")), ("Cover art", F.when(g("cover_art_present", "boolean"), "Yes")),
    ])]

    def video(row: Column, i: Column) -> Column:
        v = fields.of("videos", row)
        w, h = v("width", "int"), v("height", "int")
        pixels = lambda n: F.when((w > 0) & (h > 0), F.concat(formatting.number(n), F.lit(" pixels")))
        length, profile = F.coalesce(v("duration_ms", "double"), ms), v("format_profile")
        lines = [
            ("ID", v("stream_id", "int").cast("string")), ("Format", v("format")), ("Format/Info", v("format_info")), ("Format profile", F.when(v("format_level").isNotNull(), F.concat(profile, F.lit("@L"), v("format_level"))).otherwise(profile)), ("Format version", v("format_version")),
            ("HDR format", v("hdr_format")), ("Codec ID", v("codec_id")), ("Duration", F.when(length.isNotNull(), formatting.duration(length))), ("Bit rate", formatting.bit_rate(v("bit_rate", "bigint"))), ("Width", pixels(w)), ("Height", pixels(h)),
            ("Display aspect ratio", F.when((w > 0) & (h > 0), formatting.aspect_ratio(w, h))), ("Frame rate mode", v("frame_rate_mode")), ("Frame rate", F.concat(fixed(v("frame_rate", "double"), 3), F.lit(" FPS"))), ("Scan type", v("scan_type")), ("Scan order", v("scan_order")),
            ("Standard", v("standard")), ("Color space", v("color_space")), ("Color encoding", v("color_encoding")), ("Chroma subsampling", v("chroma")), ("Bit depth", F.concat(F.coalesce(v("bit_depth", "int"), F.lit(8)).cast("string"), F.lit(" bits"))), ("Color range", v("color_range")),
            ("Color primaries", specified(v("color_primaries"))), ("Transfer characteristics", specified(v("transfer"))), ("Matrix coefficients", specified(v("matrix"))), ("Title", v("title")), ("Language", v("language")),
        ]
        extra = v("extra", "map<string,string>")
        own = F.when(v("format") == "ProRes", F.transform(F.array_sort(F.map_entries(extra)), lambda e: line(e["key"], e["value"])))
        flags = F.array(line(F.lit("Default"), yes_no(v("default_flag", "boolean"))), line(F.lit("Forced"), yes_no(v("forced_flag", "boolean"))))
        return _block(_numbered("videos", "Video", F.size(fields.array("videos")), i), lines, F.concat(F.coalesce(own, F.array()), flags))

    def audio(row: Column, i: Column) -> Column:
        a = fields.of("audios", row)
        length = F.coalesce(a("duration_ms", "double"), ms)
        name = F.when(a("dolby_atmos_present", "boolean"), F.concat(a("format"), F.lit(" JOC / Atmos"))).otherwise(a("format"))
        unit = lambda c, u: F.concat(c.cast("string"), F.lit(u))
        return _block(_numbered("audios", "Audio", F.size(fields.array("audios")), i), [
            ("ID", a("stream_id", "int").cast("string")), ("Format", name), ("Format/Info", a("format_info")), ("Format profile", a("format_profile")), ("Codec ID", a("codec_id")), ("Duration", F.when(length.isNotNull(), formatting.duration(length))), ("Bit rate", formatting.bit_rate(a("bit_rate", "bigint"))),
            ("Channel(s)", unit(a("channels", "int"), " channels")), ("Channel layout", a("channel_layout")), ("Sampling rate", F.concat(fixed(a("sampling_rate", "int") / 1000.0, 1), F.lit(" kHz"))), ("Bit depth", unit(a("bit_depth", "int"), " bits")), ("Compression mode", a("compression_mode")),
            ("Dialog Normalization", unit(a("dialnorm_db", "int"), " dB")), ("Title", a("title")), ("Language", a("language")), ("Default", yes_no(a("default_flag", "boolean"))), ("Forced", yes_no(a("forced_flag", "boolean"))),
        ])

    def subtitle(row: Column, i: Column) -> Column:
        t = fields.of("texts", row)
        return _block(_numbered("texts", "Text", F.size(fields.array("texts")), i), [
            ("ID", t("stream_id", "int").cast("string")), ("Format", t("format")), ("Format/Info", t("format_info")), ("Codec ID", t("codec_id")), ("Title", t("title")), ("Language", t("language")), ("Default", yes_no(t("default_flag", "boolean"))), ("Forced", yes_no(t("forced_flag", "boolean"))),
        ])

    for part, one in (("videos", video), ("audios", audio), ("texts", subtitle)):
        if fields.names.get(part):
            out.append(F.array_join(F.transform(fields.array(part), one), ""))
    if "menus" in fields.names:
        chapter = lambda c: line(formatting.chapter_time(F.floor(c["timestamp_ms"])), c["title"])
        out.append(F.array_join(F.transform(fields.array("menus"), lambda m: _block(F.lit("Menu"), [], F.transform(m["chapters"], chapter))), ""))
    return F.concat(*out)


def _object(pairs: list[tuple[str, Column]], extra: Column | None = None) -> Column:
    """An ordered map of strings without nulls; keys of extra replace others and come last."""
    known = F.map_filter(F.create_map(*(x for k, v in pairs for x in (F.lit(k), v.cast("string")))), lambda _, v: v.isNotNull())
    if extra is None:
        return known
    more = F.coalesce(extra, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(known, lambda k, _: ~F.map_contains_key(more, k)), more)


def json(df: DataFrame) -> Column:
    """An object of tracks whose values are all strings; what is missing is left out. Menus have no track here."""
    fields = Fields(df.schema)
    g = fields.of("general", F.col("general"))
    general = _object([
        ("@type", F.lit("General")), ("Format", g("format")), ("FileSize", F.coalesce(g("file_size", "bigint"), F.lit(0))), ("CompleteName", g("file_name")), ("Format_Profile", g("format_profile")), ("Format_Version", g("format_version")), ("Duration", seconds(g("duration_ms", "double"))),
        ("OverallBitRate", g("overall_bitrate", "bigint")), ("Title", g("title")), ("Performer", g("artist")), ("Album", g("album")), ("Encoded_Application", g("encoded_application")), ("Encoded_Library", g("encoded_library")),
    ])

    def video(row: Column) -> Column:
        v = fields.of("videos", row)
        return _object([
            ("@type", F.lit("Video")), ("StreamOrder", v("stream_id", "int")), ("ID", v("stream_id", "int")), ("Format", v("format")), ("Width", F.coalesce(v("width", "int"), F.lit(0))), ("Height", F.coalesce(v("height", "int"), F.lit(0))), ("BitDepth", F.coalesce(v("bit_depth", "int"), F.lit(8))),
            ("Format_Info", v("format_info")), ("Format_Profile", v("format_profile")), ("Format_Version", v("format_version")), ("Format_Level", v("format_level")), ("Format_Tier", v("format_tier")), ("Format_Commercial", v("format_commercial")), ("CodecID", v("codec_id")),
            ("Duration", seconds(v("duration_ms", "double"))), ("BitRate", v("bit_rate", "bigint")), ("BitRate_Mode", v("bit_rate_mode")), ("BitRate_Maximum", v("bit_rate_maximum", "bigint")), ("Stored_Width", v("stored_width", "int")), ("Stored_Height", v("stored_height", "int")),
            ("PixelAspectRatio", fixed(v("pixel_aspect", "double"), 3)), ("DisplayAspectRatio", fixed(v("display_aspect", "double"), 3)), ("FrameRate_Mode", v("frame_rate_mode")), ("FrameRate", fixed(v("frame_rate", "double"), 3)), ("FrameCount", v("frame_count", "bigint")), ("Standard", v("standard")),
            ("ColorSpace", v("color_space")), ("ColorEncoding", v("color_encoding")), ("ChromaSubsampling", v("chroma")), ("ScanType", v("scan_type")), ("ScanOrder", v("scan_order")), ("Compression_Mode", v("compression_mode")), ("StreamSize", v("stream_size", "bigint")), ("Encoded_Library", v("encoded_library")),
            ("colour_range", v("color_range")), ("colour_primaries", specified(v("color_primaries"))), ("transfer_characteristics", specified(v("transfer"))), ("matrix_coefficients", specified(v("matrix"))), ("HDR_Format", v("hdr_format")), ("Delay", seconds(v("delay_ms", "double"))), ("Title", v("title")),
            ("Language", v("language")), ("Default", yes_no(v("default_flag", "boolean"))), ("Forced", yes_no(v("forced_flag", "boolean"))),
        ], v("extra", "map<string,string>"))

    def audio(row: Column) -> Column:
        a = fields.of("audios", row)
        return _object([
            ("@type", F.lit("Audio")), ("StreamOrder", a("stream_id", "int")), ("ID", a("stream_id", "int")), ("Format", a("format")), ("Channels", F.coalesce(a("channels", "int"), F.lit(0))), ("SamplingRate", F.coalesce(a("sampling_rate", "int"), F.lit(0))), ("Format_Info", a("format_info")), ("Format_Profile", a("format_profile")),
            ("Format_Commercial", a("format_commercial")), ("Format_AdditionalFeatures", F.when(a("dolby_atmos_present", "boolean"), "Dolby Atmos")), ("CodecID", a("codec_id")), ("Duration", seconds(a("duration_ms", "double"))), ("BitRate", a("bit_rate", "bigint")), ("BitRate_Mode", a("bit_rate_mode")),
            ("ChannelLayout", a("channel_layout")), ("SamplesPerFrame", a("samples_per_frame", "int")), ("SamplingCount", a("sampling_count", "bigint")), ("FrameRate", fixed(a("frame_rate", "double"), 3)), ("FrameCount", a("frame_count", "bigint")), ("BitDepth", a("bit_depth", "int")),
            ("Compression_Mode", a("compression_mode")), ("StreamSize", a("stream_size", "bigint")), ("Delay", seconds(a("delay_ms", "double"))), ("Dialnorm", a("dialnorm_db", "int")), ("Title", a("title")), ("Language", a("language")), ("Default", yes_no(a("default_flag", "boolean"))), ("Forced", yes_no(a("forced_flag", "boolean"))),
        ], a("extra", "map<string,string>"))

    def subtitle(row: Column) -> Column:
        t = fields.of("texts", row)
        return _object([
            ("@type", F.lit("Text")), ("StreamOrder", t("stream_id", "int")), ("ID", t("stream_id", "int")), ("Format", t("format")), ("CodecID", t("codec_id")), ("Duration", seconds(t("duration_ms", "double"))), ("Title", t("title")), ("Language", t("language")), ("Default", yes_no(t("default_flag", "boolean"))), ("Forced", yes_no(t("forced_flag", "boolean"))),
        ])

    tracks = [F.array(general)] + [F.transform(fields.array(p), one) for p, one in (("videos", video), ("audios", audio), ("texts", subtitle)) if fields.names.get(p)]
    return F.to_json(F.struct(F.struct(F.coalesce(g("file_name"), F.lit("")).alias("@ref"), F.concat(*tracks).alias("track")).alias("media")))


def xml(df: DataFrame) -> Column:
    """General, video and audio tracks with their main fields."""
    fields = Fields(df.schema)
    g = fields.of("general", F.col("general"))
    element = lambda tag, v: F.concat(F.lit(f"      <{tag}>"), escape_xml(v.cast("string")), F.lit(f"</{tag}>"))
    track = lambda kind, values: F.array_join(F.concat(F.array(F.lit(f'    <track type="{kind}">')), F.filter(F.array(*(element(k, v) for k, v in values)), lambda x: x.isNotNull()), F.array(F.lit("    </track>"))), "\n")
    parts = [F.array(track("General", [("Format", g("format")), ("FileSize", F.coalesce(g("file_size", "bigint"), F.lit(0))), ("Duration", seconds(g("duration_ms", "double"))), ("OverallBitRate", g("overall_bitrate", "bigint")), ("Title", g("title"))]))]

    def video(row: Column) -> Column:
        v = fields.of("videos", row)
        return track("Video", [("ID", v("stream_id", "int")), ("Format", v("format")), ("Width", F.coalesce(v("width", "int"), F.lit(0))), ("Height", F.coalesce(v("height", "int"), F.lit(0))), ("BitDepth", F.coalesce(v("bit_depth", "int"), F.lit(8))), ("ColorEncoding", v("color_encoding"))])

    def audio(row: Column) -> Column:
        a = fields.of("audios", row)
        return track("Audio", [("ID", a("stream_id", "int")), ("Format", a("format")), ("Channels", F.coalesce(a("channels", "int"), F.lit(0))), ("SamplingRate", F.coalesce(a("sampling_rate", "int"), F.lit(0)))])

    parts += [F.transform(fields.array(p), one) for p, one in (("videos", video), ("audios", audio)) if fields.names.get(p)]
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<MediaInfo xmlns="https://mediaarea.net/mediainfo" version="2.0">\n  <media ref="'), escape_xml(F.coalesce(g("file_name"), F.lit(""))), F.lit('">\n'))
    return F.concat(head, F.array_join(F.concat(*parts), "\n"), F.lit("\n  </media>\n</MediaInfo>\n"))


#: The columns of a row of the batch table, and of that of the desktop view.
CSV_HEADER = "File,Format,FileSize,Duration_ms,Video_Codec,Resolution,FrameRate,Audio_Codec,Audio_Channels,Audio_SamplingRate"
BATCH_HEADER = "File,Format,FileSize_Bytes,Duration_ms,Video_Codec,Resolution,Audio_Codec,Channels,SamplingRate"


def csv(df: DataFrame) -> Column:
    """A row under CSV_HEADER; texts are quoted and, as in the format, not escaped."""
    fields = Fields(df.schema)
    g, v, a = fields.of("general", F.col("general")), fields.of("videos", F.get(fields.array("videos"), F.lit(0))), fields.of("audios", F.get(fields.array("audios"), F.lit(0)))
    quoted = lambda c: F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"'))
    bare = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    ms = F.bround(F.coalesce(g("duration_ms", "double"), F.lit(0.0)), 0).cast("bigint")
    size = F.concat(v("width", "int").cast("string"), F.lit("x"), v("height", "int").cast("string"))
    return F.concat_ws(",", quoted(g("file_name")), quoted(g("format")), bare(F.coalesce(g("file_size", "bigint"), F.lit(0))), bare(ms), quoted(v("format")), quoted(size), quoted(fixed(v("frame_rate", "double"), 3)), quoted(a("format")), bare(a("channels", "int")), bare(a("sampling_rate", "int")))


def batch_csv(df: DataFrame) -> Column:
    """A row under BATCH_HEADER; only the file's name is quoted."""
    fields = Fields(df.schema)
    g, v, a = fields.of("general", F.col("general")), fields.of("videos", F.get(fields.array("videos"), F.lit(0))), fields.of("audios", F.get(fields.array("audios"), F.lit(0)))
    bare = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    size = F.concat(v("width", "int").cast("string"), F.lit("x"), v("height", "int").cast("string"))
    return F.concat_ws(",", F.concat(F.lit('"'), bare(g("file_name")), F.lit('"')), bare(g("format")), bare(F.coalesce(g("file_size", "bigint"), F.lit(0))), F.coalesce(plain(g("duration_ms", "double")), F.lit("0")), bare(v("format")), bare(size), bare(a("format")), bare(a("channels", "int")), bare(a("sampling_rate", "int")))


_STYLE = "body { max-width: 60em; margin: 1em auto; line-height: 1.4; } .card { margin-bottom: 2em; } table { border-collapse: collapse; } td { border-bottom: thin solid silver; padding: 0.2em 1em 0.2em 0; vertical-align: top; }"


def html(df: DataFrame) -> Column:
    """A page with a card for each track."""
    fields = Fields(df.schema)
    g = fields.of("general", F.col("general"))
    cell = lambda k, v: F.concat(F.lit(f'<tr><td class="label">{k}</td><td class="value">'), v.cast("string"), F.lit("</td></tr>"))

    def card(title: Column, badge: Column, values: list[tuple[str, Column]]) -> Column:
        rows = F.filter(F.array(*(cell(k, v) for k, v in values)), lambda x: x.isNotNull())
        return F.concat(F.lit('<div class="card">\n<h2>'), title, F.lit(' <span class="badge">'), F.coalesce(badge, F.lit("")), F.lit("</span></h2>\n<table>\n"), F.array_join(rows, "\n"), F.lit("\n</table>\n</div>"))

    nth = lambda kind, i: F.concat(F.lit(f"{kind} #"), (i + 1).cast("string"))
    parts = [F.array(card(F.lit("General"), g("format"), [
        ("Complete name", escape_xml(g("file_name"))), ("File size", F.concat(fixed(F.coalesce(g("file_size", "bigint"), F.lit(0)) / 1048576.0, 2), F.lit(" MB"))), ("Duration", F.concat(fixed(g("duration_ms", "double") / 1000.0, 1), F.lit(" s"))), ("Title", escape_xml(g("title"))),
    ]))]

    def video(row: Column, i: Column) -> Column:
        v = fields.of("videos", row)
        w, h = v("width", "int"), v("height", "int")
        size = F.when((w > 0) & (h > 0), F.concat(w.cast("string"), F.lit(" &times; "), h.cast("string")))
        return card(nth("Video", i), v("format"), [("Resolution", size), ("Frame rate", F.concat(fixed(v("frame_rate", "double"), 3), F.lit(" FPS"))), ("Bit depth", F.concat(F.coalesce(v("bit_depth", "int"), F.lit(8)).cast("string"), F.lit(" bits"))), ("Color encoding", v("color_encoding")), ("HDR format", v("hdr_format"))])

    def audio(row: Column, i: Column) -> Column:
        a = fields.of("audios", row)
        return card(nth("Audio", i), a("format"), [("Channels", F.concat(a("channels", "int").cast("string"), F.lit(" channels"))), ("Sampling rate", F.concat(fixed(a("sampling_rate", "int") / 1000.0, 1), F.lit(" kHz"))), ("Title", escape_xml(a("title")))])

    parts += [F.transform(fields.array(p), one) for p, one in (("videos", video), ("audios", audio)) if fields.names.get(p)]
    head = f'<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="UTF-8">\n<title>MediaInfo Report</title>\n<style>{_STYLE}</style>\n</head>\n<body>\n'
    return F.concat(F.lit(head), F.array_join(F.concat(*parts), "\n"), F.lit("\n</body>\n</html>\n"))


FORMATS = {"text": text, "json": json, "xml": xml, "csv": csv, "html": html, "batch_csv": batch_csv}


def formatted(df: DataFrame, kind: str) -> Column:
    """The report in one of FORMATS; an unknown name gives the text."""
    return FORMATS.get(kind.lower(), text)(df)


def write_batch(df: DataFrame, path: str, kind: str, order: str = "input_pos") -> None:
    """Formatted reports as text in the order of a column; tables begin with their header, once."""
    lines = df.select(F.col(order).alias("place"), formatted(df, kind).alias("value"))
    header = {"csv": CSV_HEADER, "batch_csv": BATCH_HEADER}.get(kind.lower())
    if header:
        lines = lines.union(df.sparkSession.range(1).select(F.lit(None).cast(lines.schema["place"].dataType), F.lit(header)))
    lines.orderBy(F.col("place").asc_nulls_first()).select("value").write.text(path)


def compare_csv(matrix: DataFrame, names: list[str]) -> tuple[str, DataFrame]:
    """The header, and a column value with the rows of compare.matrix() under it: all texts quoted, quotes doubled."""
    quote = lambda s: '"' + s.replace('"', '""') + '"'
    slots = [c for c in matrix.columns if c.startswith("slot_")]
    header = ",".join(map(quote, ["Category", "Parameter", *(f"File {k + 1} ({n})" for k, n in enumerate(names)), "Is_Difference"]))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))
    return header, matrix.select(F.concat_ws(",", *(quoted(c) for c in ("category", "field", *slots)), F.when(F.col("is_different"), "Yes").otherwise("No")).alias("value"))


def difference_counts(matrix: DataFrame) -> DataFrame:
    """different and identical: how many rows of compare.matrix()."""
    return matrix.agg(F.count_if("is_different").alias("different"), F.count_if(~F.col("is_different")).alias("identical"))
