"""Registered queries over the container, tag and parameter-set operators, with their SQL; files are made from the tables' columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaframe.functions import headers, sps, synth
from mediaframe.operators import boxes, containers
from mediaframe.plans.catalog import _box, dealt, query


def _made(df: DataFrame, key: str, content: Column) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("path"), content.alias("content"))


def _element(ident: str, *parts: Column) -> Column:
    """An EBML element with a size of four bytes."""
    body = F.concat(*parts)
    return F.concat(F.lit(bytes.fromhex(ident)), synth.be(F.length(body) + 0x10000000, 4), body)


def _words(name: str) -> Column:
    return F.encode(F.col(name), "UTF-8")


def _zeros(n: Column | int, most: int = 256) -> Column:
    return F.substring(F.lit(bytes(most)), 1, n) if isinstance(n, int) else F.substring(F.lit(bytes(most)), F.lit(1), n.cast("int"))


def _matroska(spark, sf) -> DataFrame:
    """A file for each part: a title, a video and an audio track, three blocks, chapters, a tag and an attachment."""
    size = F.col("p_size")
    block = lambda track, n: F.concat(synth.be(0x80 + track, 1), F.lit(b"\0\0\x80"), _zeros(n))
    info = _element("1549A966", _element("2AD7B1", synth.be(500000, 3)), _element("4489", synth.float64((F.col("p_partkey") + 1) * 10)), _element("7BA9", _words("p_name")))
    video = _element("AE", _element("D7", synth.be(1, 1)), _element("83", synth.be(1, 1)), _element("86", F.lit(b"V_VP8")), _element("23E383", synth.be(40000000, 4)), _element("E0", _element("B0", synth.be(size * 16, 2)), _element("BA", synth.be(size * 9, 2))))
    audio = _element("AE", _element("D7", synth.be(2, 1)), _element("83", synth.be(2, 1)), _element("86", F.lit(b"A_OPUS")), _element("22B59C", F.lit(b"deu")), _element("E1", _element("B5", synth.float64(F.lit(48000))), _element("9F", synth.be(size % 8 + 1, 1))))
    cluster = _element("1F43B675", _element("A3", block(1, size)), _element("A3", block(2, size + 3)), _element("A0", _element("A1", block(1, size + 7))))
    atom = lambda start, *more: _element("B6", _element("91", synth.be(start, 8)), *more)
    chapters = _element("1043A770", _element("45B9", atom(F.lit(0)), atom(F.col("p_partkey") * 1000000000, _element("80", _element("85", _words("p_brand"))))))
    simple = lambda key, value: _element("67C8", _element("45A3", F.lit(key)), _element("4487", value))
    tags = _element("1254C367", _element("7373", simple(b"LOST", F.lit(b"x")), simple(b"BRAND", _words("p_brand"))))
    attached = _element("1941A469", _element("61A7", _element("466E", F.lit(b"Cover.jpg")), _element("4660", F.lit(b"image/jpeg")), _element("465C", _zeros(size + 1))))
    made = F.concat(_element("1A45DFA3", _element("4282", F.lit(b"matroska"))), _element("18538067", info, _element("1654AE6B", video, audio), cluster, chapters, attached, tags))
    return _made(dealt(spark, sf, "part"), "p_partkey", made)


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, 500000 AS timecode_scale, (p_partkey + 1) * 10 * 500000 / 1e6::DOUBLE AS duration_ms, p_name AS title FROM part")
def c02_matroska_info(spark, sf):
    return containers.matroska_info(_matroska(spark, sf))


@query("""WITH t AS (SELECT CAST(p_partkey AS VARCHAR) AS path, p_size, (p_partkey + 1) * 5.0::DOUBLE AS duration_ms FROM part), u AS (
SELECT path, 1 AS number, 'Video' AS type, 'V_VP8' AS codec_id, NULL AS language, p_size * 16 AS width, p_size * 9 AS height, NULL AS sampling_rate, NULL AS channels, 25.0 AS frame_rate, 2 AS blocks, 2 * p_size + 7 AS stream_size, duration_ms FROM t
UNION ALL SELECT path, 2, 'Audio', 'A_OPUS', 'deu', NULL, NULL, 48000, p_size % 8 + 1, NULL, 1, p_size + 3, duration_ms FROM t)
SELECT *, CAST(trunc(stream_size * 8 / (duration_ms / 1000.0)) AS BIGINT) AS bit_rate FROM u""")
def c02_matroska_streams(spark, sf):
    return containers.matroska_streams(_matroska(spark, sf)).drop("name", "bit_depth")


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, k * p_partkey * 1000.0::DOUBLE AS timestamp_ms, CASE k WHEN 0 THEN 'Chapter 1' ELSE p_brand END AS title FROM part, (VALUES (0), (1)) AS v(k)")
def c02_matroska_chapters(spark, sf):
    return containers.matroska_chapters(_matroska(spark, sf)).drop("node")


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, 'Cover.jpg' AS name, 'image/jpeg' AS mime_type, p_size + 1 AS size, true AS is_cover FROM part")
def c02_matroska_attachments(spark, sf):
    return containers.matroska_attachments(_matroska(spark, sf))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, 'BRAND' AS key, p_brand AS value FROM part")
def g01_matroska_tags(spark, sf):
    return containers.matroska_tags(_matroska(spark, sf))


def _iso(spark, sf) -> DataFrame:
    """A file for each order, with a video track of a table of sizes, an audio track of equal sizes, and tags."""
    n = F.col("o_custkey") % 100 + 1
    full = lambda kind, *parts: _box(kind, synth.be(0, 4), *parts)
    head = lambda ident, units, lang, handler: (
        _box(b"tkhd", synth.be(1, 4), _zeros(8), synth.be(ident, 4), _zeros(68)),
        full(b"mdhd", _zeros(8), synth.be(1000, 4), synth.be(units, 4), synth.be(lang, 2), _zeros(2)),
        full(b"hdlr", _zeros(4), F.lit(handler), _zeros(13)),
    )
    def trak(ident, handler, lang, entry, sizes):
        tkhd, mdhd, hdlr = head(ident, F.col("o_orderkey"), lang, handler)
        return _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, _box(b"minf", _box(b"stbl", full(b"stsd", synth.be(1, 4), entry), sizes))))

    video = _box(b"avc1", _zeros(24), synth.be(n * 16, 2), synth.be(n * 9, 2), _zeros(50))
    audio = _box(b"mp4a", _zeros(16), synth.be(2, 2), synth.be(16, 2), _zeros(4), synth.be(F.lit(44100 << 16), 4))
    und, deu = (sum((ord(c) - 96) << 5 * (2 - k) for k, c in enumerate(word)) for word in ("und", "deu"))
    listed = full(b"stsz", synth.be(0, 4), synth.be(3, 4), synth.be(n, 4), synth.be(n * 2, 4), synth.be(7, 4))
    tag = _box(b"udta", full(b"meta", _box(b"ilst", _box(b"\xa9nam", _box(b"data", synth.be(1, 4), synth.be(0, 4), _words("o_orderpriority"))))))
    moov = _box(b"moov", trak(1, b"vide", und, video, listed), trak(2, b"soun", deu, audio, full(b"stsz", synth.be(n, 4), synth.be(F.col("o_orderkey"), 4))), tag)
    return _made(dealt(spark, sf, "orders"), "o_orderkey", F.concat(_box(b"ftyp", F.lit(b"isom\0\0\x02\0isommp41")), moov))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS path, 'isom' AS major_brand, 512 AS minor_version, 'isom mp41' AS compatible_brands FROM orders")
def c01_iso_brand(spark, sf):
    return containers.iso_brand(_iso(spark, sf))


@query("""WITH t AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, o_orderkey, o_custkey % 100 + 1 AS n FROM orders), u AS (
SELECT path, 1 AS track_id, true AS enabled, 'Video' AS type, 'avc1' AS codec_id, 1000 AS timescale, o_orderkey::DOUBLE AS duration_ms, NULL AS language, n * 16 AS width, n * 9 AS height, NULL AS channels, NULL AS bit_depth, NULL AS sampling_rate, 3 * n + 7 AS stream_size FROM t
UNION ALL SELECT path, 2, true, 'Audio', 'mp4a', 1000, o_orderkey, 'deu', NULL, NULL, 2, 16, 44100, n * o_orderkey FROM t)
SELECT *, CASE WHEN duration_ms > 0 THEN CAST(trunc(stream_size * 8 / (duration_ms / 1000.0)) AS BIGINT) END AS bit_rate FROM u""")
def c01_iso_tracks(spark, sf):
    return containers.iso_tracks(_iso(spark, sf))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS path, 'title' AS key, o_orderpriority AS value FROM orders")
def g02_itunes_tags(spark, sf):
    return containers.iso_tags(_iso(spark, sf))


def _ts(spark, sf, before: bytes = b"") -> DataFrame:
    """A file for each part: an association, a map of two streams, and two packets with clocks; before stands before each packet."""
    fill = lambda data: F.concat(F.lit(before), F.substring(F.concat(data, F.lit(b"\xff" * 188)), 1, 188))
    pid = 256 + F.col("p_size")
    pat = fill(F.concat(F.lit(b"\x47\x40\x00\x10\x00\x00\xb0\x0d\x00\x01\xc1\x00\x00\x00\x01\xf0\x10"), _zeros(4)))
    entry = lambda kind, at: F.concat(F.lit(kind), synth.be(at + 0xE000, 2), F.lit(b"\xf0\x00"))
    pmt = fill(F.concat(F.lit(b"\x47\x50\x10\x10\x00\x02\xb0\x17\x00\x01\xc1\x00\x00"), synth.be(pid + 0xE000, 2), F.lit(b"\xf0\x00"), entry(b"\x1b", pid), entry(b"\x0f", pid + 1), _zeros(4)))
    clock = lambda base: fill(F.concat(F.lit(b"\x47"), synth.be(pid, 2), F.lit(b"\x30\x07\x10"), synth.be(F.shiftright(base, 1), 4), synth.be(base % 2 * 32768, 2)))
    return _made(dealt(spark, sf, "part"), "p_partkey", F.concat(pat, pmt, clock(F.lit(90001).cast("bigint")), clock(90001 + F.col("p_partkey") * 91)))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, 256 + p_size + k AS pid, CASE k WHEN 0 THEN 27 ELSE 15 END AS stream_type FROM part, (VALUES (0), (1)) AS v(k)")
def c06_ts_streams(spark, sf):
    return containers.ts_streams(_ts(spark, sf))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_partkey > 0 THEN p_partkey * 91 / 90.0::DOUBLE END AS duration_ms FROM part")
def c06_ts_span(spark, sf):
    return containers.ts_span(_ts(spark, sf))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS path, 256 + p_size + k AS pid, CASE k WHEN 0 THEN 27 ELSE 15 END AS stream_type, 4 AS packets, 752 AS bytes, CASE WHEN p_partkey > 0 THEN p_partkey * 91 / 90.0::DOUBLE END AS duration_ms
FROM part, (VALUES (0), (1)) AS v(k)""")
def c06_m2ts(spark, sf):
    files = _ts(spark, sf, b"\x12\x34\x47\x78")
    sizes = boxes.kind_sizes(files, "ts").groupBy("path").agg(F.sum("n").alias("packets"), F.sum("bytes").alias("bytes"))
    return containers.ts_streams(files).join(sizes, "path").join(containers.ts_span(files), "path")


def _ps(spark, sf) -> DataFrame:
    """A file for each part: a pack, two packets of video with time stamps, one of AC-3 in the private stream, one of MPEG-1 audio with stuffing."""
    stamp = lambda v: F.concat(synth.be(F.shiftright(v, 30) * 2 + 33, 1), synth.be(F.shiftright(v, 15).bitwiseAND(32767) * 2 + 1, 2), synth.be(v.bitwiseAND(32767) * 2 + 1, 2))
    packet = lambda code, body: F.concat(F.lit(b"\0\0\1" + code), synth.be(F.length(body), 2), body)
    size, first = F.col("p_size"), F.lit(1 << 31).cast("bigint")
    video = lambda v, n: packet(b"\xe0", F.concat(F.lit(b"\x80\x80\x05"), stamp(v), F.substring(F.lit(b"\xaa" * 256), F.lit(1), n)))
    private = packet(b"\xbd", F.concat(F.lit(b"\x80\x00\x00\x80\x01\x00\x01"), F.substring(F.lit(b"\xaa" * 256), F.lit(1), size)))
    audio = packet(b"\xc0", F.concat(F.lit(b"\xff\xff\x40\x20\x0f"), F.lit(b"\xaa" * 9)))
    return _made(dealt(spark, sf, "part"), "p_partkey", F.concat(F.lit(b"\0\0\1\xba\x44" + bytes(9)), video(first, size), video(first + F.col("p_partkey") * 45, size + 2), private, audio))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, 224 AS key, 2 AS packets, 2 * p_size + 2 AS bytes FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 384, 1, p_size FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 192, 1, 9 FROM part")
def c05_ps_streams(spark, sf):
    return containers.ps_streams(_ps(spark, sf))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_partkey > 0 THEN p_partkey / 2.0::DOUBLE END AS duration_ms FROM part")
def c05_ps_span(spark, sf):
    return containers.ps_span(_ps(spark, sf))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_partkey > 0 THEN p_partkey::DOUBLE END AS duration_ms, p_size AS video_bytes, p_size + 1 AS audio_bytes FROM part")
def c07_flv(spark, sf):
    tag = lambda kind, at, head, n: (lambda body: F.concat(F.lit(kind), synth.be(F.length(body), 3), synth.be(at % 16777216, 3), synth.be(F.shiftright(at, 24), 1), _zeros(3), body, synth.be(F.length(body) + 11, 4)))(F.concat(F.lit(head), _zeros(n)))
    size, at = F.col("p_size"), F.col("p_partkey")
    made = F.concat(F.lit(b"FLV\x01\x05\0\0\0\x09\0\0\0\0"), tag(b"\x09", at * 0, b"\x17\0", size), tag(b"\x09", at, b"\x27\1", size + 3), tag(b"\x08", at * 0, b"\xaf\1", size + 1))
    return containers.flv_summary(_made(dealt(spark, sf, "part"), "p_partkey", made))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE o_orderkey % 2 WHEN 0 THEN 'Opus' ELSE 'Vorbis' END AS codec, 2 AS channels, CASE o_orderkey % 2 WHEN 0 THEN 48000 ELSE 44100 END AS sampling_rate, CASE WHEN o_custkey > 0 THEN o_custkey * 100 / CASE o_orderkey % 2 WHEN 0 THEN 48000 ELSE 44100 END::DOUBLE * 1000.0 END AS duration_ms FROM orders")
def c08_ogg(spark, sf):
    page = lambda granule, body: F.concat(F.lit(b"OggS\0\0"), synth.le(granule, 8), _zeros(12), synth.le(1, 1), synth.le(F.length(body), 1), body)
    opus = F.concat(F.lit(b"OpusHead\1\2\0\0"), synth.le(44100, 4), _zeros(3))
    vorbis = F.concat(F.lit(b"\1vorbis\0\0\0\0\2"), synth.le(44100, 4), _zeros(14))
    made = F.concat(page(F.lit(0), F.when(F.col("o_orderkey") % 2 == 0, opus).otherwise(vorbis)), page(F.col("o_custkey") * 100, _zeros(50)), page(F.lit(-1), _zeros(5)))
    return containers.ogg_summary(_made(dealt(spark, sf, "orders"), "o_orderkey", made))


def _asf(spark, sf) -> DataFrame:
    obj = lambda guid, *parts: (lambda body: F.concat(F.lit(bytes.fromhex(guid)), synth.le(F.length(body) + 24, 8), body))(F.concat(*parts))
    wide = lambda c: F.encode(F.concat(c, F.lit("\0")), "UTF-16LE")
    audio, video = containers.ASF_KINDS
    name, brand = wide(F.col("p_name")), wide(F.col("p_brand"))
    props = obj(containers.ASF_FILE, _zeros(40), synth.le(F.col("p_partkey") * 10000000, 8), _zeros(8), synth.le(500, 8), _zeros(12), synth.le(128000, 4))
    sound = obj(containers.ASF_STREAM, F.lit(bytes.fromhex(audio)), _zeros(32), synth.le(1, 2), _zeros(4), synth.le(0x161, 2), synth.le(2, 2), synth.le(44100, 4), synth.le(16000, 4), synth.le(4, 2), synth.le(16, 2))
    picture = obj(containers.ASF_STREAM, F.lit(bytes.fromhex(video)), _zeros(32), synth.le(2, 2), _zeros(4), synth.le(F.col("p_size") * 16, 4), synth.le(F.col("p_size") * 9, 4))
    said = obj(containers.ASF_CONTENT, synth.le(F.length(name), 2), synth.le(F.length(brand), 2), _zeros(6), name, brand)
    made = obj("3026B2758E66CF11A6D900AA0062CE6C", synth.le(4, 4), synth.le(0x0201, 2), props, sound, picture, said)
    return _made(dealt(spark, sf, "part"), "p_partkey", made)


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_partkey > 0 THEN p_partkey * 1000.0::DOUBLE - 500 END AS duration_ms, 128000 AS overall_bitrate, p_name AS title, p_brand AS artist FROM part")
def c09_asf(spark, sf):
    return containers.asf_summary(_asf(spark, sf))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS path, 1 AS stream_id, 'Audio' AS type, 353 AS format_tag, 2 AS channels, 44100 AS sampling_rate, 128000 AS bit_rate, 16 AS bit_depth, NULL AS width, NULL AS height FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 2, 'Video', NULL, NULL, NULL, NULL, NULL, p_size * 16, p_size * 9 FROM part""")
def c09_asf_streams(spark, sf):
    return containers.asf_streams(_asf(spark, sf))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, 'Video' AS type, 2 AS elements, 2 * p_size + 150 AS bytes FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'Audio', 1, p_size FROM part")
def c11_mxf_essence(spark, sf):
    klv = lambda tail, n: F.concat(F.lit(bytes.fromhex("060E2B34010201010D010301" + tail)), F.when(n < 128, synth.be(n, 1)).otherwise(F.concat(F.lit(b"\x82"), synth.be(n, 2))), _zeros(n))
    size = F.col("p_size")
    made = F.concat(klv("15010500", size), klv("16010300", size), klv("15010500", size + 150), F.lit(bytes.fromhex("060E2B34020501010D01020101020400") + b"\3abc"))
    return containers.mxf_essence(_made(dealt(spark, sf, "part"), "p_partkey", made))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, p_size + 1 AS frames, (p_size + 1) * 20.0::DOUBLE AS duration_ms FROM part")
def c12_amr(spark, sf):
    made = F.concat(F.lit(b"#!AMR\n"), F.unhex(F.repeat(F.lit("3C" + "00" * 31), F.col("p_size"))), F.lit(b"\x04" + bytes(12)))
    return containers.amr_summary(_made(dealt(spark, sf, "part"), "p_partkey", made))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, 2 AS segments, greatest(1, p_partkey * 10)::DOUBLE AS duration_ms, p_size * 16 AS width, p_size * 9 AS height FROM part")
def t04_sup(spark, sf):
    segment = lambda at, kind, *body: F.concat(F.lit(b"PG"), synth.be(at, 4), _zeros(4), F.lit(kind), synth.be(F.length(F.concat(*body)), 2), *body)
    made = F.concat(segment(F.lit(90), b"\x16", synth.be(F.col("p_size") * 16, 2), synth.be(F.col("p_size") * 9, 2), _zeros(7)), segment(F.col("p_partkey") * 900, b"\x80", _zeros(0)))
    return containers.sup_summary(_made(dealt(spark, sf, "part"), "p_partkey", made))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, k AS key, CASE k WHEN 'TITLE' THEN p_name ELSE p_brand END AS value FROM part, (VALUES ('TITLE'), ('ARTIST')) AS v(k)")
def g03_vorbis_comments(spark, sf):
    comment = lambda key, value: F.concat(synth.le(F.length(value) + len(key) + 1, 4), F.lit(key + b"="), value)
    made = F.concat(synth.le(4, 4), F.lit(b"made"), synth.le(3, 4), comment(b"title", F.lit(b"first")), comment(b"Artist", _words("p_brand")), comment(b"TITLE", _words("p_name")))
    return containers.vorbis_comments(_made(dealt(spark, sf, "part"), "p_partkey", made))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, k AS key, CASE k WHEN 'title' THEN p_name ELSE p_size || '/50' END AS value FROM part, (VALUES ('title'), ('track')) AS v(k)")
def g04_ape_tags(spark, sf):
    item = lambda key, value, flags=0: F.concat(synth.le(F.length(value), 4), synth.le(flags, 4), F.lit(key + b"\0"), value)
    items = F.concat(item(b"Title", _words("p_name")), item(b"Track", F.encode(F.concat(F.col("p_size").cast("string"), F.lit("/50")), "UTF-8")), item(b"Cover Art", F.lit(b"x\0\xff\xd8\xff"), 2))
    made = F.concat(F.lit(b"samples"), items, F.lit(b"APETAGEX"), synth.le(2000, 4), synth.le(F.length(items) + 32, 4), synth.le(3, 4), _zeros(12))
    return containers.ape_tags(_made(dealt(spark, sf, "part"), "p_partkey", made))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, k AS key, CASE k WHEN 'title' THEN p_name WHEN 'artist' THEN p_brand ELSE p_type END AS value FROM part, (VALUES ('title'), ('artist'), ('TIT1')) AS v(k)")
def g05_id3v2_tags(spark, sf):
    safe = lambda n: synth.be(F.shiftright(n, 7) * 256 + n % 128, 4)
    frame = lambda key, body: F.concat(F.lit(key), safe(F.length(body)), F.lit(b"\0\0"), body)
    frames = F.concat(frame(b"TIT2", F.concat(F.lit(b"\3"), _words("p_name"), F.lit(b"\0"))), frame(b"TPE1", F.concat(F.lit(b"\1\xff\xfe"), F.encode("p_brand", "UTF-16LE"))), frame(b"TIT1", F.concat(F.lit(b"\0"), F.encode("p_type", "ISO-8859-1"))), frame(b"TXXX", F.lit(b"\0a\0b")))
    made = F.concat(F.lit(b"ID3\4\0\0"), safe(F.length(frames)), frames, F.lit(b"\xff\xfb\0\0"))
    return containers.id3v2_tags(_made(dealt(spark, sf, "part"), "p_partkey", made))


@query("""SELECT p_partkey, 'High' AS profile, '4.0' AS level, '4:2:0' AS chroma, 8 AS bit_depth, p_size * 16 AS width, p_size * 32 * CASE p_partkey % 2 WHEN 1 THEN 1 ELSE 2 END - 8 * CASE p_partkey % 2 WHEN 1 THEN 1 ELSE 2 END AS height,
CASE p_partkey % 2 WHEN 1 THEN 'Progressive' ELSE 'Interlaced' END AS scan_type, 25.0 AS frame_rate FROM part""")
def v01_avc_sps(spark, sf):
    def ue(value) -> Column:
        digits = F.conv((value + 1).cast("string"), 10, 2)
        return F.concat(F.repeat(F.lit("0"), F.length(digits) - 1), digits)

    fixed = lambda value, n: F.lpad(F.conv(F.lit(value).cast("string"), 10, 2), n, "0")
    frames, size = F.col("p_partkey") % 2, F.col("p_size")
    crop = F.concat(F.lit("1"), *(ue(F.lit(k)) for k in (0, 0, 0, 4)))
    timing = F.concat(F.lit("1" + "0000" + "1"), fixed(1, 32), fixed(50, 32), F.lit("1"))
    text = F.concat(
        fixed(103, 8), fixed(100, 8), fixed(0, 8), fixed(40, 8), ue(F.lit(0)), ue(F.lit(1)), ue(F.lit(0)), ue(F.lit(0)), F.lit("00"), ue(F.lit(0)), ue(F.lit(0)), ue(F.lit(0)), ue(F.lit(4)), F.lit("0"),
        ue(size - 1), ue(size * 2 - 1), frames.cast("string"), F.when(frames == 0, "0").otherwise(""), F.lit("1"), crop, timing, F.lit("1"),
    )
    data = synth.packed(F.rpad(text, F.lit(320), F.lit("0")))
    escaped = F.unhex(F.replace(F.regexp_replace(F.regexp_replace(F.hex(data), "(..)", "$1 "), "00 00 (?=0[0-3])", "00 00 03 "), F.lit(" "), F.lit("")))
    found = sps.avc_sps(dealt(spark, sf, "part").select("p_partkey", escaped.alias("content")), "content")
    return found.select("p_partkey", *(f"sps.{c}" for c in ("profile", "level", "chroma", "bit_depth", "width", "height", "scan_type", "frame_rate")))


def _chunk(name: bytes, *parts: Column) -> Column:
    body = F.concat(*parts)
    return F.concat(F.lit(name), synth.le(F.length(body), 4), body, _zeros(F.length(body) % 2))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS path, 0 AS stream, 'Video' AS type, 'xvid' AS handler, NULL AS format_tag, 'XVID' AS codec_id, p_size * 16 AS width, p_size * 9 AS height, NULL AS channels, NULL AS sampling_rate, 25.0 AS frame_rate, 2 * p_size + 7 AS stream_size FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 1, 'Audio', NULL, 85, NULL, NULL, NULL, 2, 44100, NULL, p_size FROM part""")
def c03_avi_streams(spark, sf):
    size = F.col("p_size")
    head = lambda kind, handler: _chunk(b"strh", F.lit(kind), F.lit(handler), _zeros(12), synth.le(1000, 4), synth.le(25000, 4), _zeros(28))
    picture = _chunk(b"strf", synth.le(40, 4), synth.le(size * 16, 4), synth.le((1 << 32) - size * 9, 4), synth.le(1, 2), synth.le(24, 2), F.lit(b"XVID"), _zeros(20))
    sound = _chunk(b"strf", synth.le(85, 2), synth.le(2, 2), synth.le(44100, 4), _zeros(8))
    rows = dealt(spark, sf, "part")  # in steps: a chunk names its content three times
    for step in (
        {"head1": head(b"vids", b"xvid"), "head2": head(b"auds", bytes(4)), "form1": picture, "form2": sound, "data1": _chunk(b"00dc", _zeros(size)), "data2": _chunk(b"01wb", _zeros(size)), "data3": _chunk(b"00dc", _zeros(size + 7))},
        {"list1": _chunk(b"LIST", F.lit(b"strl"), F.col("head1"), F.col("form1")), "list2": _chunk(b"LIST", F.lit(b"strl"), F.col("head2"), F.col("form2"))},
        {"streams": _chunk(b"LIST", F.lit(b"hdrl"), F.col("list1"), F.col("list2")), "movie": _chunk(b"LIST", F.lit(b"movi"), F.col("data1"), F.col("data2"), F.col("data3"))},
    ):
        rows = rows.withColumns(step)
    return containers.avi_streams(_made(rows, "p_partkey", _chunk(b"RIFF", F.lit(b"AVI "), F.col("streams"), F.col("movie"))))


def _wave(spark, sf) -> DataFrame:
    bext = _chunk(b"bext", synth.text(F.col("p_name"), 256), synth.text(F.col("p_brand"), 32), _zeros(32), F.lit(b"2024-01-02"), F.lit(b"03:04:05"), synth.le(F.col("p_partkey") * 48000, 8), _zeros(66), synth.le(65536 - F.col("p_size") * 10, 2), synth.le(F.col("p_size"), 2), synth.le(0, 2), _zeros(184))
    info = _chunk(b"LIST", F.lit(b"INFO"), _chunk(b"INAM", _words("p_name"), F.lit(b"\0")), _chunk(b"IART", _words("p_brand")), _chunk(b"JUNK", F.lit(b"x")))
    return _made(dealt(spark, sf, "part"), "p_partkey", _chunk(b"RIFF", F.lit(b"WAVE"), bext, info))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, p_name AS description, p_brand AS originator, NULL AS reference, '2024-01-02 03:04:05' AS recorded_date, p_partkey * 48000 AS time_reference, p_size / -10.0::DOUBLE AS loudness, p_size / 100.0::DOUBLE AS loudness_range, NULL AS true_peak FROM part")
def c03_bwf(spark, sf):
    return containers.bwf(_wave(spark, sf))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, k AS key, CASE k WHEN 'title' THEN p_name ELSE p_brand END AS value FROM part, (VALUES ('title'), ('artist')) AS v(k)")
def g06_riff_info(spark, sf):
    return containers.riff_info(_wave(spark, sf))


@query("""SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN 48000 WHEN 1 THEN 44100 ELSE 32000 END AS sampling_rate, (o_orderkey % 2048 + 1) * 2 AS frame_size,
CAST(floor((o_orderkey % 2048 + 1) * 16 * CASE o_custkey % 3 WHEN 0 THEN 48000 WHEN 1 THEN 44100 ELSE 32000 END / (1536 / CASE o_orderkey % 4 WHEN 0 THEN 6 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END)) AS BIGINT) AS bit_rate,
5 + o_custkey % 2 AS channels, o_custkey % 2 = 1 AS lfe, o_custkey % 32 - 31 AS dialnorm_db FROM orders""")
def p14_eac3(spark, sf):
    order, cust = F.col("o_orderkey"), F.col("o_custkey")
    packed = (order % 2048) * (1 << 24) + (cust % 3) * (1 << 22) + (order % 4) * (1 << 20) + F.lit(7 << 17) + (cust % 2) * (1 << 16) + F.lit(16 << 11) + (cust % 32) * (1 << 6)
    made = F.concat(F.lit(b"\x0b\x77"), synth.be(packed, 5))
    return dealt(spark, sf, "orders").select("o_orderkey", headers.eac3(made).alias("h")).select("o_orderkey", "h.*")


@query("SELECT o_orderkey, o_custkey AS frames, CASE o_orderkey % 4 WHEN 0 THEN 44100 WHEN 1 THEN 48000 WHEN 2 THEN 37800 ELSE 32000 END AS sampling_rate, o_custkey * 1152 / CASE o_orderkey % 4 WHEN 0 THEN 44100 WHEN 1 THEN 48000 WHEN 2 THEN 37800 ELSE 32000 END::DOUBLE * 1000.0 AS duration_ms FROM orders")
def p15_musepack(spark, sf):
    made = F.concat(F.lit(b"MP+\7"), synth.le(F.col("o_custkey"), 4), synth.be(F.col("o_orderkey") % 4, 1), _zeros(19))
    return dealt(spark, sf, "orders").select("o_orderkey", headers.musepack(made).alias("h")).select("o_orderkey", "h.*")


@query("SELECT p_partkey, p_size * 16 AS width, p_size * 9 AS height, 25.0 AS frame_rate, 4 / 3::DOUBLE AS pixel_aspect, p_partkey + 1 AS bit_rate, CASE p_partkey % 3 WHEN 0 THEN '4:2:0' WHEN 1 THEN '4:2:2' ELSE '4:4:4' END AS chroma FROM part")
def p16_theora(spark, sf):
    size, code = F.col("p_size"), F.when(F.col("p_partkey") % 3 == 0, 0).otherwise(F.col("p_partkey") % 3 + 1)
    made = F.concat(F.lit(b"\x80theora\3\2\1"), synth.be(size, 2), synth.be(size, 2), synth.be(size * 16, 3), synth.be(size * 9, 3), _zeros(2), synth.be(25000, 4), synth.be(1000, 4), synth.be(4, 3), synth.be(3, 3), _zeros(1), synth.be(F.col("p_partkey") + 1, 3), _zeros(1), synth.be(code * 8, 1))
    return dealt(spark, sf, "part").select("p_partkey", headers.theora(made).alias("h")).select("p_partkey", "h.*")


@query("SELECT p_partkey, p_brand AS make, NULL AS model, p_type AS lens, '2024-01-02' AS create_date, NULL AS creator, p_name AS title, NULL AS description, CAST(p_size AS VARCHAR) AS rating FROM part")
def g07_xmp(spark, sf):
    made = F.encode(F.format_string('<x:xmpmeta xmp:Rating="%d"><tiff:Make> %s </tiff:Make><aux:Lens>%s</aux:Lens><xmp:CreateDate>2024-01-02</xmp:CreateDate><dc:title>%s</dc:title><dc:creator><rdf:Seq/></dc:creator></x:xmpmeta>', "p_size", "p_brand", "p_type", "p_name"), "UTF-8")
    return dealt(spark, sf, "part").select("p_partkey", headers.xmp(made).alias("h")).select("p_partkey", "h.*")
