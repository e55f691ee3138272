"""Registered queries over whole files of all families in one table, with their SQL; files are made from the tables' columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaframe.functions import headers, synth
from mediaframe.operators import containers, inspect, reports
from mediaframe.plans import container_queries as made
from mediaframe.plans.catalog import _box, dealt, query, tasks

_full = lambda kind, *parts: _box(kind, synth.be(0, 4), *parts)


def _avc(width: Column, height: Column) -> Column:
    """A set of High profile; width and height in units of 16."""
    w, u, d = synth.packed, synth.ue, synth.digits
    return w(d(0x67, 8), d(100, 8), d(0, 8), d(31, 8), u(0), u(1), u(0), u(0), F.lit("00"), u(0), u(0), u(0), u(4), F.lit("0"), u(width - 1), u(height - 1), F.lit("1"), F.lit("1"), F.lit("0"), F.lit("0"), F.lit("1"))


def _avcc(unit: Column) -> Column:
    return F.concat(F.lit(b"\1\x64\0\x1f\xff\xe1"), synth.be(F.length(unit), 2), unit)


def _staged(df: DataFrame, *stages: dict[str, Column]) -> DataFrame:
    """Columns made one after the other: a box holds its own length, so nesting expressions would double them with every level."""
    for stage in stages:
        df = df.withColumns(stage)
    return df


def _iso(df: DataFrame, p: Column, s: Column) -> DataFrame:
    """iso: a video whose set, colours and pixels stand in boxes of its entry, and AAC whose configuration lies in a QuickTime entry of version 1."""
    c = F.col
    tagged = lambda tag, body: F.concat(synth.be(tag, 1), synth.be(F.length(body), 1), body)
    table_of = lambda k, *more: _box(b"stbl", c(f"stsd{k}"), *more)
    sizes = _full(b"stsz", synth.be(0, 4), synth.be(2, 4), synth.be(p, 4), synth.be(s, 4))
    media = lambda k, handler: _box(b"mdia", _full(b"mdhd", made._zeros(8), synth.be(1000, 4), synth.be(p + 1, 4), made._zeros(4)), _full(b"hdlr", made._zeros(4), F.lit(handler), made._zeros(13)), c(f"minf{k}"))
    trak = lambda k: _box(b"trak", _box(b"tkhd", synth.be(1, 4), made._zeros(8), synth.be(k, 4), made._zeros(68)), c(f"mdia{k}"))
    colours = _box(b"colr", F.lit(b"nclx"), synth.be(9, 2), synth.be(F.when(p % 2 == 0, 16).otherwise(18), 2), synth.be(9, 2), synth.be(F.when(p % 3 == 0, 128).otherwise(0), 1))
    return _staged(
        df, {"parts": F.concat(_box(b"avcC", c("avcc")), colours, _box(b"pasp", synth.be(s, 4), synth.be(7, 4))), "config": tagged(4, F.concat(F.lit(b"\x40\x15\0\0\0"), synth.be(0, 4), synth.be(s * 1000, 4), F.lit(b"\5\2\x12\x10")))},
        {"entry1": _box(b"avc1", made._zeros(24), synth.be(16, 2), synth.be(16, 2), made._zeros(50), c("parts")), "esds": _full(b"esds", tagged(3, F.concat(F.lit(b"\0\1\0"), c("config"))))},
        {"entry2": _box(b"mp4a", made._zeros(8), synth.be(1, 2), made._zeros(6), synth.be(1, 2), synth.be(16, 2), made._zeros(4), synth.be(F.lit(22050 << 16), 4), made._zeros(16), _box(b"wave", c("esds")))},
        {f"stsd{k}": _full(b"stsd", synth.be(1, 4), c(f"entry{k}")) for k in (1, 2)},
        {"stbl1": table_of(1, sizes, _full(b"stts", synth.be(1, 4), synth.be(2, 4), synth.be(40, 4))), "stbl2": table_of(2, _full(b"stsz", synth.be(9, 4), synth.be(3, 4)))},
        {f"minf{k}": _box(b"minf", c(f"stbl{k}")) for k in (1, 2)}, {"mdia1": media(1, b"vide"), "mdia2": media(2, b"soun")}, {f"trak{k}": trak(k) for k in (1, 2)}, {"iso": F.concat(_box(b"ftyp", F.lit(b"isom\0\0\2\0")), _box(b"moov", c("trak1"), c("trak2")))},
    )


def _matroska(df: DataFrame, p: Column, s: Column) -> DataFrame:
    """mkv: a video with private data and colours; AAC whose block looks like AC-3; AC-3 told by its first block."""
    c, e = F.col, made._element
    one = lambda ident, value, n=1: e(ident, synth.be(value, n))
    block = lambda track, data: e("A3", synth.be(0x80 + track, 1), F.lit(b"\0\0\x80"), data)
    return _staged(
        df, {"colour": e("55B0", one("55B9", F.when(p % 2 == 0, 1).otherwise(2)), one("55BB", F.when(p % 3 == 0, 9).otherwise(1))), "frame": synth.ac3(F.lit(0), s % 38, F.lit(2), F.lit(0), F.lit(5))},
        {"picture": e("E0", one("B0", s * 16, 2), one("BA", s * 16 + 16, 2), c("colour"))},
        {"track1": e("AE", one("D7", 1), one("83", 1), e("86", F.lit(b"V_MPEG4/ISO/AVC")), e("63A2", c("avcc")), c("picture")), "track2": e("AE", one("D7", 2), one("83", 2), e("86", F.lit(b"A_AAC")), e("63A2", F.lit(b"\x11\x88"))), "track3": e("AE", one("D7", 3), one("83", 2), e("86", F.lit(b"A_AC3")))},
        {"mtracks": e("1654AE6B", c("track1"), c("track2"), c("track3")), "cluster": e("1F43B675", block(1, made._zeros(s)), block(2, F.lit(b"\x0b\x77" + bytes(20))), block(3, F.concat(c("frame"), made._zeros(20)))), "minfo": e("1549A966", e("4489", synth.float64(p + 1)))},
        {"mkv": F.concat(e("1A45DFA3", e("4282", F.when(p % 5 < 3, F.lit(b"webm")).otherwise(F.lit(b"matroska")))), e("18538067", c("minfo"), c("mtracks"), c("cluster")))},
    )


def _ts(p: Column, s: Column) -> Column:
    """A program map over two packets, and a video whose set lies across the border of two."""
    packet = lambda head, body, size: F.concat(F.lit(head), F.substring(F.concat(body, F.lit(b"\xff" * 184)), 1, size))
    pat = packet(b"\x47\x40\0\x10", F.concat(F.lit(b"\0\0\xb0\x0d\0\1\xc1\0\0\0\1\xe1\0"), made._zeros(4)), 184)
    info = b"\5\xb4" + b"x" * 180
    pmt = F.concat(F.lit(b"\2\xb0" + bytes([9 + len(info) + 5 + 4]) + b"\0\1\xc1\0\0\xe1\1\xf0" + bytes([len(info)]) + info + b"\x1b\xe1\1\xf0\0"), made._zeros(4))
    first, rest = F.substring(pmt, 1, 183), F.substring(pmt, 184, 200)
    maps = F.concat(packet(b"\x47\x41\0\x10\0", first, 183), packet(b"\x47\1\0\x11", rest, 184))
    video = F.concat(F.lit(b"\0\0\1\xe0\0\0\x80\0\0"), F.lit(b"\0\0\1\6" + b"\5" * 155 + b"\0\0\1"), F.col("unit"), F.lit(b"\0\0\1\x68" + b"\1" * 184))
    return F.concat(pat, maps, packet(b"\x47\x41\1\x10", F.substring(video, 1, 184), 184), packet(b"\x47\1\1\x11", F.substring(video, 185, 184), 184))


def _flv(p: Column, s: Column) -> Column:
    """onMetaData with a nested object before what counts."""
    name = lambda x: F.lit(len(x).to_bytes(2, "big") + x)
    number = lambda x: F.concat(F.lit(b"\0"), synth.float64(x))
    end = F.lit(b"\0\0\x09")
    meta = F.concat(F.lit(b"\2"), name(b"onMetaData"), F.lit(b"\x08\0\0\0\3"), name(b"more"), F.lit(b"\3"), name(b"width"), number(s), end, name(b"duration"), number(s), name(b"framerate"), number(F.lit(25)), end)
    tag = lambda kind, body: F.concat(F.lit(kind), synth.be(F.length(body), 3), F.lit(bytes(7)), body, synth.be(F.length(body) + 11, 4))
    return F.concat(F.lit(b"FLV\1\5\0\0\0\x09\0\0\0\0"), tag(b"\x12", meta), tag(b"\x09", F.concat(F.lit(b"\x17\0\0\0\0"), F.col("avcc"))), tag(b"\x09", F.concat(F.lit(b"\x27\1\0\0\0"), made._zeros(s))), tag(b"\x08", F.concat(F.lit(b"\xaf\0\x12\x10"))), tag(b"\x08", F.concat(F.lit(b"\xaf\1"), made._zeros(s + 1))))


def _wav(p: Column, s: Column) -> Column:
    """An extensible form after the samples, in RF64 for every other file."""
    fmt = F.concat(F.lit(b"fmt "), synth.le(40, 4), synth.le(0xFFFE, 2), synth.le(6, 2), synth.le(48000, 4), synth.le(864000, 4), synth.le(18, 2), synth.le(24, 2), synth.le(22, 2), synth.le(s % 20 + 1, 2), synth.le(0x60F, 4), synth.le(1, 2), made._zeros(14))
    size = s * 18
    data = F.concat(F.lit(b"data"), synth.le(F.when(p % 2 == 0, F.lit(0xFFFFFFFF)).otherwise(size), 4), F.substring(F.lit(bytes(1000)), F.lit(1), size.cast("int")))
    wide = F.when(p % 2 == 0, F.concat(F.lit(b"ds64"), synth.le(28, 4), synth.le(0, 8), synth.le(size, 8), made._zeros(12))).otherwise(F.lit(b""))
    head = F.when(p % 2 == 0, F.lit(b"RF64\xff\xff\xff\xff")).otherwise(F.concat(F.lit(b"RIFF"), synth.le(F.lit(60) + size, 4)))
    return F.concat(head, F.lit(b"WAVE"), wide, data, fmt)


def _mixed(spark, sf) -> DataFrame:
    p, s = F.col("p_partkey"), F.col("p_size")
    family = p % 8
    opus = F.concat(F.lit(b"OggS\0\2"), made._zeros(8), synth.le(3, 4), made._zeros(8), F.lit(b"\1\x13OpusHead\1"), synth.be(s % 2 + 1, 1), made._zeros(9), F.lit(b"OggS\0\4"), synth.le(s * 480, 8), synth.le(3, 4), made._zeros(8), F.lit(b"\1\0"))
    rows = _staged(dealt(spark, sf, "part").select("p_partkey", "p_size"), {"unit": _avc(s, s + 1)}, {"avcc": _avcc(F.col("unit"))})
    rows = _matroska(_iso(rows, p, s), p, s).withColumns({"ts": _ts(p, s), "flv": _flv(p, s)})
    content = F.when(family == 0, F.col("iso")).when(family == 1, F.col("mkv")).when(family == 2, F.col("ts")).when(family == 3, F.col("flv")).when(family == 4, _wav(p, s)).when(family == 5, opus)
    content = content.when(family == 6, F.concat(F.lit(b"FLV"), synth.be(p, 1))).otherwise(F.when(p % 3 == 0, F.lit(b"????")).otherwise(F.lit(b"#!AMR\n" + (b"\x3c" + bytes(31)) * 5)))
    return rows.select(F.concat(F.lit("lib/"), p.cast("string")).alias("path"), content.alias("content")).withColumn("length", F.length("content").cast("bigint"))


_V = "CASE f WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} WHEN 3 THEN {3} END"
_AC3 = "CAST(list_extract([32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 448, 512, 576, 640], CAST(s % 38 // 2 + 1 AS INTEGER)) * 1000 AS BIGINT)"


@query(f"""WITH t AS (SELECT 'lib/' || p_partkey AS path, p_partkey AS p, CAST(p_size AS BIGINT) AS s, p_partkey % 8 AS f FROM part)
SELECT path, CASE f WHEN 0 THEN 'MPEG-4' WHEN 1 THEN CASE WHEN p % 5 < 3 THEN 'WebM' ELSE 'Matroska' END WHEN 2 THEN 'MPEG-TS' WHEN 3 THEN 'Flash Video' WHEN 4 THEN 'Wave' WHEN 5 THEN 'Ogg' WHEN 6 THEN 'Flash Video' ELSE CASE WHEN p % 3 = 0 THEN 'Unknown' ELSE 'AMR' END END AS format,
CASE WHEN f < 4 THEN 'AVC' END AS video, CASE WHEN f < 4 THEN 'High' END AS profile, CASE WHEN f < 4 THEN '3.1' END AS level, {_V.format("16", "s * 16", "s * 16", "s * 16")} AS width, CASE WHEN f < 4 THEN s * 16 END AS stored_width, CASE WHEN f < 4 THEN s * 16 + 16 END AS stored_height,
CASE WHEN f IN (0, 3) THEN 25.0 END AS frame_rate, {_V.format("CASE WHEN p % 3 = 0 THEN 'Full' ELSE 'Limited' END", "CASE p % 2 WHEN 0 THEN 'Limited' ELSE 'Full' END", "'Limited'", "'Limited'")} AS color_range, {_V.format("'BT.2020'", "CASE p % 3 WHEN 0 THEN 'BT.2020' ELSE 'BT.709' END", "NULL", "NULL")} AS color_primaries,
CASE WHEN f = 0 THEN CASE p % 2 WHEN 0 THEN 'PQ' ELSE 'HLG' END END AS transfer, CASE WHEN f = 0 THEN s / 7.0::DOUBLE END AS pixel_aspect, {_V.format("p + s", "s", "NULL", "s")} AS video_bytes,
CASE f WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 1 WHEN 7 THEN CASE WHEN p % 3 = 0 THEN 0 ELSE 1 END ELSE 0 END AS audios,
CASE f WHEN 0 THEN 'AAC' WHEN 1 THEN 'AAC' WHEN 3 THEN 'AAC' WHEN 4 THEN 'PCM' WHEN 5 THEN 'Opus' WHEN 7 THEN CASE WHEN p % 3 > 0 THEN 'AMR-NB' END END AS audio, CASE f WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 6 WHEN 5 THEN s % 2 + 1 WHEN 7 THEN CASE WHEN p % 3 > 0 THEN 1 END END AS channels,
CASE f WHEN 0 THEN 44100 WHEN 1 THEN 48000 WHEN 3 THEN 44100 WHEN 4 THEN 48000 WHEN 5 THEN 48000 WHEN 7 THEN CASE WHEN p % 3 > 0 THEN 8000 END END AS sampling_rate, CASE f WHEN 4 THEN s % 20 + 1 END AS audio_depth,
CASE f WHEN 0 THEN s * 1000 WHEN 4 THEN 6912000 END AS audio_rate, CASE WHEN f = 1 THEN 'AC-3' END AS second, CASE WHEN f = 1 THEN {_AC3} END AS second_rate,
CASE f WHEN 1 THEN p + 1.0 WHEN 3 THEN s * 1000.0 WHEN 4 THEN s * 18 * 8 / 6912000.0 * 1000 WHEN 5 THEN s * 480 / 48000.0 * 1000 WHEN 7 THEN CASE WHEN p % 3 > 0 THEN 100.0 END ELSE CASE WHEN f = 0 THEN p + 1.0 END END::DOUBLE AS duration_ms,
CASE WHEN f = 6 THEN 'broken' WHEN f = 7 AND p % 3 = 0 THEN 'no known format' END AS error FROM t""")
def i03_inspect_library(spark, sf):
    found = inspect.inspect(_mixed(spark, sf), tasks(spark, sf, "part"))
    v, a, b = reports.primary("videos"), reports.primary("audios"), F.get("audios", F.lit(1))
    rate = F.when(F.col("general.format").isin("MPEG-4", "Wave"), a["bit_rate"])
    return found.select(
        "path", "general.format", v["format"].alias("video"), v["format_profile"].alias("profile"), v["format_level"].alias("level"), v["width"].alias("width"), v["stored_width"].alias("stored_width"), v["stored_height"].alias("stored_height"), v["frame_rate"].alias("frame_rate"), v["color_range"].alias("color_range"),
        v["color_primaries"].alias("color_primaries"), v["transfer"].alias("transfer"), v["pixel_aspect"].alias("pixel_aspect"), F.when(F.col("general.format") != "MPEG-TS", v["stream_size"]).alias("video_bytes"), F.size("audios").alias("audios"), a["format"].alias("audio"), a["channels"].alias("channels"), a["sampling_rate"].alias("sampling_rate"),
        F.when(F.col("general.format") == "Wave", a["bit_depth"]).alias("audio_depth"), rate.alias("audio_rate"), b["format"].alias("second"), b["bit_rate"].alias("second_rate"), "general.duration_ms", "error",
    )


@query("""WITH t AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, o_orderkey AS k, o_custkey % 7 + 1 AS a, o_custkey % 5 + 1 AS b FROM orders)
SELECT path, chunk, k + chunk * 100 AS offset, CASE WHEN chunk < 3 THEN a WHEN chunk < 4 THEN b ELSE 2 END AS samples, CASE WHEN chunk < 3 THEN (chunk - 1) * a WHEN chunk < 4 THEN 2 * a ELSE 2 * a + b + (chunk - 4) * 2 END AS first_sample FROM t, (VALUES (1), (2), (3), (4), (5), (6)) AS v(chunk)""")
def c13_iso_chunks(spark, sf):
    """Six chunks in runs that begin at the first, third and fourth, with offsets of four or eight bytes."""
    k, a, b = F.col("o_orderkey"), F.col("o_custkey") % 7 + 1, F.col("o_custkey") % 5 + 1
    run = lambda first, n: F.concat(synth.be(first, 4), synth.be(n, 4), synth.be(1, 4))
    offsets = lambda kind, n: _full(kind, synth.be(6, 4), *(synth.be(k + 100 * i, n) for i in range(1, 7)))
    rows = _staged(
        dealt(spark, sf, "orders").select("o_orderkey", "o_custkey"), {"stbl": _box(b"stbl", _full(b"stsc", synth.be(3, 4), run(1, a), run(3, b), run(4, 2)), F.when(k % 2 == 0, offsets(b"stco", 4)).otherwise(offsets(b"co64", 8)))},
        {"minf": _box(b"minf", F.col("stbl"))}, {"mdia": _box(b"mdia", F.col("minf"))}, {"trak": _box(b"trak", F.col("mdia"))}, {"content": _box(b"moov", F.col("trak"))},
    )
    return containers.iso_chunks(rows.select(k.cast("string").alias("path"), "content")).drop("track")


@query("""WITH t AS (SELECT CAST(c_custkey AS VARCHAR) AS path, c_name, c_mktsegment, c_custkey % 30 AS n FROM customer)
SELECT path, 'TXXX' AS id, 'NAME' AS description, NULL AS language, NULL AS mime_type, c_name AS value, len(c_name) AS size, sha256(c_name) AS sha256 FROM t
UNION ALL SELECT path, 'COMM', 'seg', 'eng', NULL, c_mktsegment, len(c_mktsegment), sha256(c_mktsegment) FROM t UNION ALL SELECT path, 'APIC', 'cover', NULL, 'image/png', NULL, n + 1, sha256(repeat('A', n + 1)) FROM t""")
def g08_id3_frames(spark, sf):
    """User-defined texts in two charsets, comments and pictures of tags of versions 3 and 4."""
    n, four = F.col("c_custkey") % 30, F.col("c_custkey") % 2 == 0
    size = lambda c: F.when(four, synth.be(F.shiftleft(F.shiftright(F.length(c), 7), 8) + F.length(c) % 128, 4)).otherwise(synth.be(F.length(c), 4))
    frame = lambda ident, c: F.concat(F.lit(ident), size(c), F.lit(b"\0\0"), c)
    latin = lambda c: F.encode(c, "ISO-8859-1")
    rows = _staged(
        dealt(spark, sf, "customer"), {"user": F.concat(F.lit(b"\0NAME\0"), latin(F.col("c_name"))), "comment": F.concat(F.lit(b"\3engseg\0"), latin(F.col("c_mktsegment"))), "cover": F.concat(F.lit(b"\0image/png\0\3cover\0"), latin(F.repeat(F.lit("A"), (n + 1).cast("int"))))},
        {"body": F.concat(frame(b"TXXX", F.col("user")), frame(b"COMM", F.col("comment")), frame(b"APIC", F.col("cover")))},
        {"content": F.concat(F.lit(b"ID3"), F.when(four, F.lit(b"\4\0\0")).otherwise(F.lit(b"\3\0\0")), synth.be(F.shiftleft(F.shiftright(F.length("body"), 7), 8) + F.length("body") % 128, 4), F.col("body"))},
    )
    files = rows.select(F.col("c_custkey").cast("string").alias("path"), F.length("content").cast("bigint").alias("length"), "content")
    return containers.id3v2_frames(files).drop("node")


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, p_name AS project, p_brand AS scene, CAST(p_size AS VARCHAR) AS take, NULL AS tape, p_type AS notes FROM part")
def g09_ixml(spark, sf):
    body = F.encode(F.concat(F.lit("<BWFXML><PROJECT> "), "p_name", F.lit("</PROJECT><SCENE>"), "p_brand", F.lit("</SCENE><TAKE>"), F.col("p_size").cast("string"), F.lit("</TAKE><TAPE> </TAPE><NOTE>"), "p_type", F.lit("\n</NOTE></BWFXML>")), "UTF-8")
    content = F.concat(F.lit(b"RIFF"), synth.le(F.length("body") + 12, 4), F.lit(b"WAVEiXML"), synth.le(F.length("body"), 4), F.col("body"))
    return containers.ixml(dealt(spark, sf, "part").withColumn("body", body).select(F.col("p_partkey").cast("string").alias("path"), content.alias("content")))


@query("""SELECT c_custkey, 3970 AS version, 1000 + c_nationkey * 1000 AS level, 'Level ' || 1000 + c_nationkey * 1000 AS profile, c_custkey % 2 + 1 AS channels, 44100 AS sampling_rate, 16 AS bit_depth,
CASE WHEN c_custkey % 50 > 0 THEN ((c_custkey % 50 - 1) * 36864 + c_custkey) / 44100.0::DOUBLE * 1000.0 END AS duration_ms FROM customer""")
def p16_ape_legacy(spark, sf):
    k = F.col("c_custkey")
    made = F.concat(F.lit(b"MAC "), synth.le(3970, 2), synth.le(1000 + F.col("c_nationkey") * 1000, 2), synth.le(0, 2), synth.le(k % 2 + 1, 2), synth.le(44100, 4), F.lit(bytes(8)), synth.le(k % 50, 4), synth.le(k, 4))
    return dealt(spark, sf, "customer").select("c_custkey", headers.ape_legacy(made).alias("h")).select("c_custkey", "h.*")
