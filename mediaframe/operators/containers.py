"""Tracks, durations, sizes, chapters, attachments and tags of tree-shaped containers.

Each operator cuts the nodes it needs (operators/boxes.py), decodes their payloads by native
expressions and groups them by file, or by file and track; where a field occurs twice, the last
one counts. Fields that a file lacks are null, and files of another kind give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaframe.functions.bits import be, bits, float32, float64, le, part, signed, starts, timestamp33, uint, vint, vint_width
from mediaframe.functions import headers
from mediaframe.functions.lookups import named
from mediaframe.operators.boxes import ENTRIES, cut

# Kinds of Matroska tracks, handlers of ISO tracks, item types of MXF essence, ASF object and stream ids.
TRACK_TYPES = {1: "Video", 2: "Audio", 17: "Text"}
HANDLERS = {"vide": "Video", "soun": "Audio", "subt": "Text", "text": "Text", "sbtl": "Text", "clcp": "Text"}
ESSENCE = {"15": "Video", "16": "Audio", "17": "Data", "18": "Compound"}
ASF_FILE, ASF_STREAM, ASF_CONTENT = "A1DCAB8C47A9CF118EE400C00C205365", "9107DCB7B7A9CF118EE600C00C205365", "3326B2758E66CF11A6D900AA0062CE6C"
ASF_KINDS = {"409E69F84D5BCF11A8FD00805F5C442B": "Audio", "C0EF19BC4D5BCF11A8FD00805F5C442B": "Video"}
ILST = {"nam": "title", "ART": "artist", "alb": "album", "day": "year", "gen": "genre", "cmt": "comment", "too": "encoder", "wrt": "composer"}
RIFF_INFO = {"INAM": "title", "IART": "artist", "IPRD": "album", "IALB": "album", "ICRD": "year", "IGNR": "genre", "ISFT": "encoder", "IENG": "encoder"}
ID3_TEXT = {"TIT2": "title", "TT2": "title", "TPE1": "artist", "TP1": "artist", "TALB": "album", "TAL": "album", "TDRC": "year", "TYER": "year", "TYE": "year", "TCON": "genre", "TCO": "genre", "TRCK": "track", "TRK": "track"}


def last(kind: str, value: Column, *more: Column) -> Column:
    """The value at the last node of a kind, of those with a value."""
    here = F.col("kind") == kind
    for condition in more:
        here = here & condition
    return F.max_by(value, F.when(here & value.isNotNull(), F.col("node")))


def text(data: Column, charset: str = "UTF-8") -> Column:
    """Up to the first NUL; invalid UTF-8 is replaced, empty is null."""
    decoded = F.decode(data, charset) if charset != "UTF-8" else F.make_valid_utf8(data.cast("string"))
    return F.nullif(F.split(decoded, "\0", 2)[0], F.lit(""))


def number(data: Column) -> Column:
    """An EBML float of 4 or 8 bytes."""
    return F.when(F.length(data) == 4, float32(data, 0)).when(F.length(data) == 8, float64(data, 0))


def bit_rate(size: Column, ms: Column) -> Column:
    return F.when(ms > 0, (size * 8 / (ms / 1000.0)).cast("bigint"))


# Matroska


def matroska_info(files: DataFrame) -> DataFrame:
    """path, timecode_scale, duration_ms, title."""
    p = F.col("payload")
    found = cut(files, "ebml", {"2AD7B1", "4489", "7BA9"}, owner="1549A966", within=True).groupBy("path").agg(
        F.coalesce(last("2AD7B1", uint(p)), F.lit(1000000).cast("bigint")).alias("timecode_scale"), last("4489", number(p)).alias("units"), last("7BA9", text(p)).alias("title")
    )
    return found.select("path", "timecode_scale", (F.col("units") * F.col("timecode_scale") / 1e6).alias("duration_ms"), "title")


def matroska_tracks(files: DataFrame) -> DataFrame:
    """A row for each track entry: path, number, type, codec_id, language, name, width, height, sampling_rate, channels, bit_depth, frame_rate."""
    p = F.col("payload")
    kinds = {"AE", "D7", "83", "86", "22B59C", "536E", "B0", "BA", "B5", "9F", "6264", "23E383"}
    default = F.col("default_ns")
    return (
        cut(files, "ebml", kinds, owner="AE", within=True).groupBy("path", "owner")
        .agg(
            last("D7", uint(p)).alias("number"), named(last("83", uint(p)).cast("int"), TRACK_TYPES).alias("type"), last("86", text(p)).alias("codec_id"), last("22B59C", text(p)).alias("language"), last("536E", text(p)).alias("name"),
            last("B0", uint(p)).alias("width"), last("BA", uint(p)).alias("height"), last("B5", number(p)).cast("bigint").alias("sampling_rate"), last("9F", uint(p)).alias("channels"), last("6264", uint(p)).alias("bit_depth"), last("23E383", uint(p)).alias("default_ns"),
        )
        .withColumn("frame_rate", F.when(default > 0, 1e9 / default)).drop("owner", "default_ns")
    )


def matroska_block_sizes(files: DataFrame) -> DataFrame:
    """path, number, blocks, stream_size: payloads of blocks without their headers, summed by track."""
    p = F.col("payload")
    blocks = cut(files, "ebml", {"A3", "A1"}, most=12).select("path", vint(p).alias("number"), (F.col("size") - vint_width(p) - 3).alias("n"))
    return blocks.where("number is not null and n > 0").groupBy("path", "number").agg(F.count("*").alias("blocks"), F.sum("n").alias("stream_size"))


def _rows(files: DataFrame) -> DataFrame:
    """Typed rows of files whose table may lack their length."""
    from mediaframe.operators.walk import rows_of

    return rows_of(files if "length" in files.columns else files.withColumn("length", F.length("content").cast("bigint")))


def matroska_streams(files: DataFrame) -> DataFrame:
    """Tracks with the sizes of their blocks and, where the file has a duration, their bit rates; from one pass over the contents."""
    p = F.col("payload")
    kinds = ("D7", "83", "86", "22B59C", "536E", "B0", "BA", "B5", "9F", "6264", "23E383", "2AD7B1", "4489", "sum")
    rows = _rows(files).where(F.col("kind").isin(*(f"mkv.{k}" for k in kinds)))
    of = lambda k, value: last(f"mkv.{k}", value)
    t = rows.groupBy("path", "track").agg(
        of("D7", uint(p)).alias("number"), named(of("83", uint(p)).cast("int"), TRACK_TYPES).alias("type"), of("86", text(p)).alias("codec_id"), of("22B59C", text(p)).alias("language"), of("536E", text(p)).alias("name"), of("B0", uint(p)).alias("width"), of("BA", uint(p)).alias("height"),
        of("B5", number(p)).cast("bigint").alias("sampling_rate"), of("9F", uint(p)).alias("channels"), of("6264", uint(p)).alias("bit_depth"), of("23E383", uint(p)).alias("default_ns"), of("sum", F.col("a")).alias("blocks"), of("sum", F.col("b")).alias("stream_size"), of("2AD7B1", uint(p)).alias("scale"), of("4489", number(p)).alias("ticks"),
    )
    whole = Window.partitionBy("path")  # a file has few tracks
    ms = F.max("ticks").over(whole) * F.coalesce(F.max("scale").over(whole), F.lit(1000000)) / 1e6
    found = t.withColumn("duration_ms", ms).where("track >= 0").withColumn("frame_rate", F.when(F.col("default_ns") > 0, 1e9 / F.col("default_ns")))
    fields = ("path", "number", "type", "codec_id", "language", "name", "width", "height", "sampling_rate", "channels", "bit_depth", "frame_rate", "blocks", "stream_size", "duration_ms")
    return found.select(*fields, bit_rate(F.col("stream_size"), F.col("duration_ms")).alias("bit_rate"))


def matroska_chapters(files: DataFrame) -> DataFrame:
    """path, node, timestamp_ms, title of chapters, in order of node (which grows within a file); a start of other than 4 or 8 bytes is 0; without a title, "Chapter n"."""
    p = F.col("payload")
    atoms = cut(files, "ebml", {"B6", "91", "85"}, owner="B6", within=True)
    start = F.when(F.length(p).isin(4, 8), uint(p))
    found = atoms.groupBy("path", F.col("owner").alias("node")).agg(F.coalesce(last("91", start), F.lit(0)).alias("ns"), last("85", text(p)).alias("title"))
    each = found.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("node", "ns", "title"))).alias("all")).select("path", F.posexplode("all").alias("k", "c"))
    return each.select("path", "c.node", (F.col("c.ns") / 1e6).alias("timestamp_ms"), F.coalesce("c.title", F.concat(F.lit("Chapter "), (F.col("k") + 1).cast("string"))).alias("title"))


def matroska_attachments(files: DataFrame) -> DataFrame:
    """path, name, mime_type, size, is_cover of attached files."""
    p = F.col("payload")
    found = cut(files, "ebml", {"466E", "4660", "465C"}, owner="61A7", most=4096, within=True)
    each = found.groupBy("path", "owner").agg(last("466E", text(p)).alias("name"), last("4660", text(p)).alias("mime_type"), F.coalesce(last("465C", F.col("size")), F.lit(0)).alias("size"))
    return each.select("path", "name", "mime_type", "size", F.coalesce(F.lower("name").startswith("cover"), F.lit(False)).alias("is_cover"))


def matroska_tags(files: DataFrame) -> DataFrame:
    """path, key, value: of each tag its last name and value; of equal keys the last."""
    p = F.col("payload")
    found = cut(files, "ebml", {"45A3", "4487"}, owner="7373", within=True)
    each = found.groupBy("path", "owner").agg(last("45A3", text(p)).alias("key"), last("4487", text(p)).alias("value"))
    return each.where("key is not null").groupBy("path", "key").agg(F.max_by("value", "owner").alias("value"))


# ISO base media


def iso_brand(files: DataFrame) -> DataFrame:
    """path, major_brand, minor_version, compatible_brands."""
    p = F.col("payload")
    found = cut(files, "isobmff", {"ftyp"}, most=4096).where("depth = 0")
    others = F.transform(F.sequence(F.lit(2), F.floor(F.length(p) / 4) - 1), lambda k: F.decode(part(p, k * 4, 4), "ISO-8859-1"))
    return found.select("path", F.decode(part(p, 0, 4), "ISO-8859-1").alias("major_brand"), be(p, 4, 4).alias("minor_version"), F.when(F.length(p) >= 12, F.array_join(others, " ")).alias("compatible_brands"))


def iso_language(packed: Column) -> Column:
    """Three letters of five bits; und is null."""
    letters = F.concat(*(F.chr(F.shiftright(packed, k).bitwiseAND(31) + 96) for k in (10, 5, 0)))
    return F.nullif(letters, F.lit("und"))


def iso_tracks(files: DataFrame) -> DataFrame:
    """A row for each trak box: path, track_id, enabled, type, codec_id, timescale, duration_ms, language, width, height, channels, bit_depth, sampling_rate, stream_size, bit_rate. Tables of sizes of any length are summed as they are walked."""
    p = F.col("payload")
    version = be(p, 0, 1)
    by = lambda zero, one: F.when(version == 1, one).otherwise(zero)
    found = _rows(files).where("track >= 0 and kind like 'iso.%'")
    t = found.groupBy("path", "track").agg(
        last("iso.tkhd", by(be(p, 12, 4), be(p, 20, 4))).alias("track_id"), last("iso.tkhd", bits(p, 31, 1) == 1).alias("enabled"), last("iso.hdlr", F.decode(part(p, 8, 4), "ISO-8859-1")).alias("handler"),
        last("iso.entry", F.col("name")).alias("codec_id"), last("iso.mdhd", by(be(p, 12, 4), be(p, 20, 4))).alias("timescale"), last("iso.mdhd", by(be(p, 16, 4), be(p, 24, 8))).alias("units"),
        last("iso.mdhd", iso_language(by(be(p, 20, 2), be(p, 32, 2)))).alias("language"), last("iso.entry", F.struct(be(p, 32, 2).alias("w"), be(p, 34, 2).alias("h"), be(p, 24, 2).alias("channels"), be(p, 26, 2).alias("depth"), be(p, 32, 2).alias("rate"))).alias("entry"),
        last("iso.stsz", F.col("a")).alias("stream_size"),
    ).withColumn("type", named(F.col("handler"), HANDLERS)).withColumn("duration_ms", F.when(F.col("timescale") > 0, F.col("units") / F.col("timescale") * 1000.0))
    only = lambda kind, field: F.when(F.col("type") == kind, F.col(f"entry.{field}"))
    return t.select("path", "track_id", "enabled", "type", "codec_id", "timescale", "duration_ms", "language", only("Video", "w").alias("width"), only("Video", "h").alias("height"), only("Audio", "channels").alias("channels"), only("Audio", "depth").alias("bit_depth"), only("Audio", "rate").alias("sampling_rate"), "stream_size", bit_rate(F.col("stream_size"), F.col("duration_ms")).alias("bit_rate"))


#: Chunks that lie in one bucket of the range join.
BUCKET = 1024


def table_entries(table: DataFrame, width: int) -> DataFrame:
    """path, owner, nth (from 0) and entry (width bytes) of tables of 32-bit counted entries (path, owner, payload); cut into blocks first, so that no row holds a whole table's entries."""
    p = F.col("payload")
    count = F.least(be(p, 4, 4), F.floor((F.length(p) - 8) / width))
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1))
    block = lambda k: F.struct(k.alias("k"), part(p, 8 + width * ENTRIES * k, width * F.least(count - ENTRIES * k, F.lit(ENTRIES))).alias("data"))
    blocks = table.select("path", "owner", F.explode(F.transform(numbers(F.ceil(count / ENTRIES)), block)).alias("b"))
    one = lambda k: F.struct((F.col("b.k") * ENTRIES + k).alias("nth"), part(F.col("b.data"), width * k, width).alias("entry"))
    return blocks.select("path", "owner", F.explode(F.transform(numbers(F.floor(F.length("b.data") / width)), one)).alias("e")).select("path", "owner", "e.*")


def iso_chunks(files: DataFrame) -> DataFrame:
    """path, track (a number within the file), chunk (from 1), offset, samples and first_sample (from 0) of every chunk of ISO tracks.

    Runs of the sample-to-chunk table hold from their first chunk to the next run's; chunks are joined to their run by range, in
    buckets of 1,024 chunks. A run that no chunk follows, or chunks before the first run, give no rows."""
    found = cut(files, "isobmff", {"stsc", "stco", "co64"}, owner="trak").where("owner is not null")
    of = lambda kind: found.where(F.col("kind") == kind)
    offset = lambda kind, width: table_entries(of(kind), width).select("path", "owner", (F.col("nth") + 1).alias("chunk"), be(F.col("entry"), 0, width).alias("offset"))
    chunks = offset("stco", 4).union(offset("co64", 8))
    e, own = F.col("entry"), Window.partitionBy("path", "owner").orderBy("first", "nth")
    runs = table_entries(of("stsc"), 12).select("path", "owner", "nth", be(e, 0, 4).alias("first"), be(e, 4, 4).alias("samples"))
    runs = runs.withColumn("next", F.lead("first").over(own)).where("next is null or next > first")
    before = F.coalesce(F.sum((F.col("next") - F.col("first")) * F.col("samples")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    most = chunks.groupBy("path", "owner").agg(F.max("chunk").alias("most"))
    runs = runs.withColumn("before", before).join(most, ["path", "owner"]).withColumn("last", F.coalesce(F.col("next") - 1, F.col("most"))).where("first > 0 and last >= first")
    runs = runs.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("first") / BUCKET), F.floor(F.least("last", "most") / BUCKET))))
    met = chunks.withColumn("bucket", F.floor(F.col("chunk") / BUCKET)).join(runs, ["path", "owner", "bucket"]).where("chunk between first and last")
    return met.select("path", F.col("owner").alias("track"), "chunk", "offset", "samples", (F.col("before") + (F.col("chunk") - F.col("first")) * F.col("samples")).alias("first_sample"))


def iso_tags(files: DataFrame) -> DataFrame:
    """path, key, value of the text items of the ilst box; of equal keys the last."""
    p = F.col("payload")
    found = cut(files, "isobmff", {"data"}).where(be(p, 0, 4).isin(0, 1)).select("path", "node", named(F.substring("holder", 2, 3), ILST).alias("key"), text(F.substring(p, F.lit(9), F.length(p))).alias("value"))
    return found.where("key is not null and value is not null").groupBy("path", "key").agg(F.max_by("value", "node").alias("value"))


# Streams of packets


def ts_streams(files: DataFrame) -> DataFrame:
    """path, pid, stream_type from the program maps."""
    each = F.split("kind", ":")
    return cut(files, "pmt", most=0).select("path", each[0].cast("int").alias("pid"), each[1].cast("int").alias("stream_type")).distinct()


def ts_span(files: DataFrame) -> DataFrame:
    """path, duration_ms from the first to the last program clock, by value; null unless it grows."""
    p = F.col("payload")
    clock = F.when((bits(p, 26, 2) >= 2) & (be(p, 4, 1) >= 7) & (bits(p, 43, 1) == 1), be(p, 6, 4) * 2 + bits(p, 80, 1))
    clocks = cut(files, "ts", most=12).select("path", clock.alias("pcr")).groupBy("path").agg(F.min("pcr").alias("a"), F.max("pcr").alias("b"))
    return clocks.select("path", F.when(F.col("b") > F.col("a"), (F.col("b") - F.col("a")) / 90.0).alias("duration_ms"))


def _packets(files: DataFrame) -> DataFrame:
    """PES packets and packs of program streams: path, key (256 and the substream for private ones), bytes, pts, scr."""
    p = F.col("payload")
    b = lambda k: be(p, k, 1)
    second = b(0).bitwiseAND(0xC0) == 0x80
    stuffing = F.floor(F.length(F.regexp_extract(F.hex(part(p, 0, 16)), "^((?:FF)*)", 1)) / 2)
    at = F.when(b(stuffing).bitwiseAND(0xC0) == 0x40, stuffing + 2).otherwise(stuffing)
    mark = F.shiftright(b(at), 4)
    head = F.when(second, 3 + b(2)).otherwise(at + F.when(mark == 2, 5).when(mark == 3, 10).otherwise(1))
    pts = F.when(second, F.when(b(1) >= 128, timestamp33(p, 3))).when(mark.isin(2, 3), timestamp33(p, at))
    mpeg2 = F.shiftleft(F.shiftright(b(0), 3).bitwiseAND(7), 30) + F.shiftleft(b(0).bitwiseAND(3), 28) + F.shiftleft(b(1), 20) + F.shiftleft(F.shiftright(b(2), 3), 15) + F.shiftleft(b(2).bitwiseAND(3), 13) + F.shiftleft(b(3), 5) + F.shiftright(b(4), 3)
    scr = F.when(b(0).bitwiseAND(0xC0) == 0x40, mpeg2).otherwise(timestamp33(p, 0))
    pack, private, sub = F.col("kind") == "BA", F.col("kind") == "BD", b(head)
    skip = F.when(private, F.when(sub.between(0x80, 0x8F), 4).when(sub.between(0xA0, 0xAF), 7).otherwise(1)).otherwise(0)
    return cut(files, "ps", most=300).select(
        "path", F.when(~pack, F.when(private, 256 + sub).otherwise(F.conv("kind", 16, 10).cast("bigint"))).alias("key"), F.when(~pack, F.greatest(F.col("size") - head - skip, F.lit(0))).alias("bytes"), F.when(~pack, pts).alias("pts"), F.when(pack, scr).alias("scr"),
    )


def ps_streams(files: DataFrame) -> DataFrame:
    """path, key, packets, bytes of the elementary streams of program streams."""
    return _packets(files).where("bytes > 0").groupBy("path", "key").agg(F.count("*").alias("packets"), F.sum("bytes").alias("bytes"))


def ps_span(files: DataFrame) -> DataFrame:
    """path, duration_ms: the span of presentation times or, where there is none, of the packs' clocks."""
    span = lambda c: F.when(F.max(c) > F.min(c), (F.max(c) - F.min(c)) / 90.0)
    return _packets(files).groupBy("path").agg(F.coalesce(span("pts"), span("scr")).alias("duration_ms"))


def flv_summary(files: DataFrame) -> DataFrame:
    """path, duration_ms (the last time stamp), video_bytes and audio_bytes without framing; configuration tags count as nothing."""
    p = F.col("payload")
    each = F.split("kind", ":")
    video, audio = be(p, 0, 1).bitwiseAND(15).isin(7, 12), F.shiftright(be(p, 0, 1), 4) == 10
    frame = lambda packed, long: F.when(F.col("size") == 0, 0).when(packed & (be(p, 1, 1) == 0), 0).otherwise(F.greatest(F.col("size") - F.when(packed, long).otherwise(1), F.lit(0)))
    tags = cut(files, "flv", most=2).select("path", each[0].alias("tag"), each[1].cast("bigint").alias("stamp"), frame(video, 5).alias("v"), frame(audio, 2).alias("a"))
    return tags.groupBy("path").agg(F.nullif(F.max("stamp"), F.lit(0)).cast("double").alias("duration_ms"), F.coalesce(F.sum(F.when(F.col("tag") == "9", F.col("v"))), F.lit(0)).alias("video_bytes"), F.coalesce(F.sum(F.when(F.col("tag") == "8", F.col("a"))), F.lit(0)).alias("audio_bytes"))


def ogg_summary(files: DataFrame) -> DataFrame:
    """path, codec, channels, sampling_rate, duration_ms for Opus and Vorbis: the last granule over the rate."""
    p = F.col("payload")
    opus, vorbis = starts(p, b"OpusHead"), starts(p, b"\x01vorbis")
    head = F.when(opus, F.struct(F.lit("Opus").alias("codec"), be(p, 9, 1).alias("channels"), F.lit(48000).cast("bigint").alias("rate"))).when(vorbis, F.struct(F.lit("Vorbis").alias("codec"), be(p, 11, 1).alias("channels"), le(p, 12, 4).alias("rate")))
    granule = F.col("kind").cast("bigint")
    found = cut(files, "ogg", most=64).groupBy("path").agg(F.min_by(head, F.when(head.isNotNull(), F.col("node"))).alias("h"), F.max_by(granule, F.when(granule > 0, F.col("node"))).alias("granule"))
    rate = F.when(F.col("h.rate") > 0, F.col("h.rate")).otherwise(48000)
    return found.select("path", "h.codec", "h.channels", F.col("h.rate").alias("sampling_rate"), (F.col("granule") / rate * 1000.0).alias("duration_ms"))


def asf_summary(files: DataFrame) -> DataFrame:
    """path, duration_ms without the preroll, overall_bitrate (the largest allowed), title, artist."""
    p = F.col("payload")
    played, preroll = le(p, 40, 8) / 10000.0, le(p, 56, 8)
    ms = F.when(le(p, 40, 8) > 0, F.when(played > preroll, played - preroll).otherwise(played))
    wide = lambda at, n: text(part(p, at, n), "UTF-16LE")
    return cut(files, "asf", {ASF_FILE, ASF_CONTENT}).groupBy("path").agg(
        last(ASF_FILE, ms).alias("duration_ms"), last(ASF_FILE, F.nullif(le(p, 76, 4), F.lit(0))).alias("overall_bitrate"), last(ASF_CONTENT, wide(10, le(p, 0, 2))).alias("title"), last(ASF_CONTENT, wide(10 + le(p, 0, 2), le(p, 2, 2))).alias("artist")
    )


def asf_streams(files: DataFrame) -> DataFrame:
    """path, stream_id, type, format_tag, channels, sampling_rate, bit_rate, bit_depth, width, height of audio and video streams."""
    p = F.col("payload")
    kind = named(F.hex(part(p, 0, 16)), ASF_KINDS)
    only = lambda name, value: F.when(kind == name, value)
    return cut(files, "asf", {ASF_STREAM}).where(kind.isNotNull()).select(
        "path", le(p, 48, 2).bitwiseAND(127).alias("stream_id"), kind.alias("type"), only("Audio", le(p, 54, 2)).alias("format_tag"), only("Audio", le(p, 56, 2)).alias("channels"), only("Audio", le(p, 58, 4)).alias("sampling_rate"),
        only("Audio", le(p, 62, 4) * 8).alias("bit_rate"), only("Audio", le(p, 68, 2)).alias("bit_depth"), only("Video", le(p, 54, 4)).alias("width"), only("Video", le(p, 58, 4)).alias("height"),
    )


def mxf_essence(files: DataFrame) -> DataFrame:
    """path, type, elements, bytes of essence by its item type."""
    each = cut(files, "klv", most=0).where("kind like '060E2B34010201__0D010301%'").select("path", named(F.substring("kind", 25, 2), ESSENCE).alias("type"), "size")
    return each.where("type is not null").groupBy("path", "type").agg(F.count("*").alias("elements"), F.sum("size").alias("bytes"))


def amr_summary(files: DataFrame) -> DataFrame:
    """path, frames, duration_ms (20 ms a frame)."""
    found = cut(files, "amr", most=0).groupBy("path").agg(F.count("*").alias("frames"))
    return found.withColumn("duration_ms", F.col("frames") * 20.0)


def sup_summary(files: DataFrame) -> DataFrame:
    """path, segments, duration_ms, width, height of graphic subtitles; 1920 x 1080 without a composition."""
    p = F.col("payload")
    each = F.split("kind", ":")
    ms = F.max(each[1].cast("bigint")) / 90.0
    page = F.max_by(F.struct(be(p, 0, 2).alias("w"), be(p, 2, 2).alias("h")), F.when((each[0] == "22") & (F.length(p) >= 4), F.col("node")))
    found = cut(files, "sup", most=4).groupBy("path").agg(F.count("*").alias("segments"), F.when(ms > 0, ms).alias("duration_ms"), page.alias("p"))
    return found.select("path", "segments", "duration_ms", F.coalesce("p.w", F.lit(1920)).alias("width"), F.coalesce("p.h", F.lit(1080)).alias("height"))


# Tags


def vorbis_comments(files: DataFrame) -> DataFrame:
    """path, key (upper case), value; content starts at the vendor string. Of equal keys the last."""
    p = F.col("payload")
    return cut(files, "vorbis").groupBy("path", F.col("kind").alias("key")).agg(F.max_by(F.make_valid_utf8(p.cast("string")), "node").alias("value"))


def ape_tags(files: DataFrame) -> DataFrame:
    """path, key (lower case), value of text items; of equal keys the last."""
    p = F.col("payload")
    return cut(files, "ape").groupBy("path", F.col("kind").alias("key")).agg(F.max_by(F.make_valid_utf8(p.cast("string")), "node").alias("value"))


def id3_text(code: Column, body: Column) -> Column:
    """Bytes in one of the four charsets of tags; of UTF-16 with or without a mark."""
    bom = be(body, 0, 2)
    rest = F.substring(body, F.lit(3), F.length(body))
    wide = F.when(bom == 0xFFFE, F.decode(rest, "UTF-16LE")).when(bom == 0xFEFF, F.decode(rest, "UTF-16BE")).otherwise(F.decode(body, "UTF-16LE"))
    return F.when(code == 0, F.decode(body, "ISO-8859-1")).when(code == 1, wide).when(code == 2, F.decode(body, "UTF-16BE")).otherwise(F.make_valid_utf8(body.cast("string")))


def trimmed(value: Column) -> Column:
    return F.nullif(F.regexp_replace(value, r"^[\x00\x20]+|[\x00\x20]+$", ""), F.lit(""))


def id3v2_tags(files: DataFrame) -> DataFrame:
    """path, key, value of text frames, under names common to versions 2 to 4, or the frame's id; trimmed, empty ones left out."""
    p = F.col("payload")
    value = trimmed(id3_text(be(p, 0, 1), F.substring(p, F.lit(2), F.length(p))))
    found = cut(files, "id3v2", lambda kind: kind.startswith("T")).where("kind like 'T%' and kind not in ('TXXX', 'TXX')").select("path", "node", F.coalesce(named(F.col("kind"), ID3_TEXT), F.col("kind")).alias("key"), value.alias("value"))
    return found.where("value is not null").groupBy("path", "key").agg(F.max_by("value", "node").alias("value"))


def _until_nul(code: Column, body: Column) -> Column:
    """Bytes of body before its first terminator, of one byte or, in UTF-16, of two at an even place; all of them without one."""
    digits = F.hex(body)
    before = F.when(code.isin(1, 2), F.regexp_extract(digits, "^((?:....)*?)(?:0000|$)", 1)).otherwise(F.regexp_extract(digits, "^((?:..)*?)(?:00|$)", 1))
    return F.floor(F.length(before) / 2).cast("int")


def id3v2_frames(files: DataFrame) -> DataFrame:
    """path, node, id, description, language, mime_type, value, size and sha256 of the frames with more than one part: user-defined texts (TXXX), comments (COMM) and
    pictures (APIC), of files with path, length and content. Ids are those of later versions; unsynchronisation is undone. value is the text, or null
    for pictures, whose bytes give size and sha256."""
    from mediaframe.operators.walk import rows_of

    p, code = F.col("payload"), F.col("code")
    from_ = lambda c, at: F.substring(c, at + 1, F.length(c))
    wide = F.when(code.isin(1, 2), 2).otherwise(1)
    old_picture = (F.col("id") == "APIC") & (F.col("version") == 2)
    rows = rows_of(files).where("kind = 'id3' and name in ('TXXX', 'COMM', 'APIC') and length(payload) > 1").select("path", "node", F.col("name").alias("id"), F.col("b").alias("version"), "payload", be(p, 0, 1).alias("code"))
    mime = F.when(old_picture, F.lit(3)).otherwise(_until_nul(F.lit(0), from_(p, F.lit(1))) + 1)
    start = F.when(F.col("id") == "TXXX", F.lit(1)).when(F.col("id") == "COMM", F.lit(4)).otherwise(1 + mime + 1)
    rows = rows.withColumn("start", start.cast("int")).withColumn("rest", from_(p, F.col("start"))).withColumn("n", _until_nul(code, F.col("rest")))
    body, picture = from_(F.col("rest"), F.col("n") + wide), F.col("id") == "APIC"
    language = F.when(F.col("id") == "COMM", F.decode(part(p, 1, 3), "ISO-8859-1"))
    kind = F.when(old_picture, F.decode(part(p, 1, 3), "ISO-8859-1")).when(picture, F.decode(part(p, F.lit(1), F.col("start") - 3), "ISO-8859-1"))
    return rows.select(
        "path", "node", "id", trimmed(id3_text(code, F.substring(F.col("rest"), F.lit(1), F.col("n")))).alias("description"), language.alias("language"), F.when(picture, kind).alias("mime_type"), F.when(~picture, trimmed(id3_text(code, body))).alias("value"),
        F.length(body).alias("size"), F.sha2(body, 256).alias("sha256"),
    )


# RIFF


def avi_streams(files: DataFrame) -> DataFrame:
    """A row for each stream list of AVI files: path, stream (from 0), type, handler, format_tag, codec_id, width, height, channels, sampling_rate, frame_rate, stream_size; from one pass over the contents.

    Sizes are those of the movie's chunks whose names begin with the stream's two digits."""
    p = F.col("payload")
    scale, rate, height = le(p, 20, 4), le(p, 24, 4), le(p, 8, 4)
    name = lambda at: F.nullif(F.trim(F.replace(F.decode(part(p, at, 4), "ISO-8859-1"), F.lit("\0"), F.lit(""))), F.lit(""))
    shape = F.struct(le(p, 0, 2).alias("tag"), le(p, 2, 2).alias("channels"), le(p, 4, 4).alias("a"), F.when(height >= 1 << 31, (1 << 32) - height).otherwise(height).alias("h"), name(16).alias("fourcc"))
    rows = _rows(files).where("kind in ('riff.strh', 'riff.strf', 'riff.sum')")
    each = rows.groupBy("path", F.col("track").cast("int").alias("stream")).agg(
        last("riff.strh", F.decode(part(p, 0, 4), "ISO-8859-1")).alias("type"), last("riff.strh", name(4)).alias("handler"), last("riff.strh", F.when((scale > 0) & (rate > 0), rate / scale)).alias("rate"), last("riff.strf", shape).alias("f"), last("riff.sum", F.col("a")).alias("stream_size"), F.bool_or(F.col("kind") != "riff.sum").alias("listed")
    )
    video, audio = F.col("type") == "vids", F.col("type") == "auds"
    return each.where("listed").select(
        "path", "stream", F.when(video, "Video").when(audio, "Audio").alias("type"), "handler", F.when(audio, F.col("f.tag")).alias("format_tag"), F.when(video, F.coalesce("f.fourcc", F.lit("RGB"))).alias("codec_id"), F.when(video, F.col("f.a")).alias("width"), F.when(video, F.col("f.h")).alias("height"),
        F.when(audio, F.col("f.channels")).alias("channels"), F.when(audio, F.col("f.a")).alias("sampling_rate"), F.when(video, F.col("rate")).alias("frame_rate"), "stream_size",
    )


def bwf(files: DataFrame) -> DataFrame:
    """path, description, originator, reference, recorded_date, time_reference, loudness (LUFS), loudness_range, true_peak from bext chunks; loudness of 0 is null."""
    p = F.col("payload")
    latin = lambda at, n: F.nullif(F.trim(F.split(F.decode(part(p, at, n), "ISO-8859-1"), "\0", 2)[0]), F.lit(""))
    level = lambda at: F.when(F.length(p) >= 422, F.nullif(signed(le(p, at, 2), 2) / 100.0, F.lit(0.0)))
    found = cut(files, "riff", {"bext"}, most=602)
    return found.select("path", latin(0, 256).alias("description"), latin(256, 32).alias("originator"), latin(288, 32).alias("reference"), F.nullif(F.concat_ws(" ", latin(320, 10), latin(330, 8)), F.lit("")).alias("recorded_date"), le(p, 338, 8).alias("time_reference"), level(412).alias("loudness"), level(414).alias("loudness_range"), level(416).alias("true_peak"))


def ixml(files: DataFrame) -> DataFrame:
    """path, project, scene, take, tape, notes of iXML chunks."""
    return cut(files, "riff", {"iXML"}).select("path", headers.ixml(F.col("payload")).alias("x")).select("path", "x.*")


def riff_info(files: DataFrame) -> DataFrame:
    """path, key, value of the INFO list; of equal keys the last."""
    p = F.col("payload")
    found = cut(files, "riff", set(RIFF_INFO)).where("holder = 'LIST:INFO'").select("path", "node", named(F.col("kind"), RIFF_INFO).alias("key"), F.trim(text(p)).alias("value"))
    return found.where("key is not null and value <> ''").groupBy("path", "key").agg(F.max_by("value", "node").alias("value"))
