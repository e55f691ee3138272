"""Registered queries over reports: assembled from files, compared and written, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaframe.functions import synth
from mediaframe.operators import compare, inspect, reports
from mediaframe.plans import container_queries
from mediaframe.plans.catalog import query, table, tasks

def _report(p: Column, s: Column) -> list[Column]:
    """A report of zero to two videos and audios, made of two numbers."""
    video = lambda k: F.struct(
        F.lit(k).cast("int").alias("stream_id"), F.when(p % 2 == 0, "AVC").otherwise("HEVC").alias("format"), (s * 16).cast("int").alias("width"), (s * 9).cast("int").alias("height"), (F.lit(24.0) + p % 3).alias("frame_rate"),
        F.when(p % 4 == 0, 10).otherwise(8).cast("int").alias("bit_depth"), F.when(p % 5 == 0, "HDR10").alias("hdr_format"), F.when(p % 3 == 0, "Unspecified").when(p % 3 == 1, "BT.2020").otherwise("BT.709").alias("color_primaries"), F.lit(True).alias("default_flag"),
    )
    audio = lambda k: F.struct(F.lit(k).cast("int").alias("stream_id"), F.lit("AAC").alias("format"), (s % 6 + 1).cast("int").alias("channels"), F.when(p % 2 == 0, 48000).otherwise(44100).cast("int").alias("sampling_rate"))
    general = F.struct(F.concat(F.lit("f"), p.cast("string"), F.lit(".mkv")).alias("file_name"), F.when(p % 7 == 0, "MPEG-4").otherwise("Matroska").alias("format"), (p * 100.0).alias("duration_ms"), (p * 1000).cast("bigint").alias("file_size"))
    videos = F.slice(F.array(video(1), video(2)), F.lit(1), (s % 3).cast("int"))
    audios = F.slice(F.array(audio(3), audio(4)), F.lit(1), (p % 3).cast("int"))
    texts = F.array_repeat(F.struct(F.lit(5).alias("stream_id"), F.lit("SubRip").alias("format")), (s % 2).cast("int"))
    return [general.alias("general"), videos.alias("videos"), audios.alias("audios"), texts.alias("texts")]


def _reports(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", *_report(F.col("p_partkey"), F.col("p_size")))


@query("""SELECT p_partkey, 1 + p_size % 3 + p_partkey % 3 + p_size % 2 AS track_count, p_size % 3 = 0 AND p_partkey % 3 = 0 AND p_partkey = 0 AS is_empty, CASE WHEN p_size % 3 > 0 THEN p_size * 16 END AS primary_width, CASE WHEN p_partkey % 3 > 0 THEN p_size % 6 + 1 END AS primary_channels,
CASE WHEN p_size % 3 > 0 THEN p_partkey % 3 = 1 OR p_partkey % 5 = 0 ELSE false END AS is_hdr, CASE WHEN p_partkey > 0 THEN p_partkey * 1000 * 8 / (p_partkey * 100.0 / 1000.0) END AS computed_bit_rate FROM part""")
def r05_derived(spark, sf):
    df = _reports(spark, sf)
    v = reports.primary("videos")
    return df.select(
        "p_partkey", reports.track_count(df).alias("track_count"), reports.is_empty(df).alias("is_empty"), v["width"].alias("primary_width"), reports.primary("audios")["channels"].alias("primary_channels"),
        reports.is_hdr(v["color_primaries"], F.lit(None).cast("string"), v["hdr_format"]).alias("is_hdr"), reports.computed_bit_rate(F.col("general.file_size"), F.col("general.duration_ms")).alias("computed_bit_rate"),
    )


def _pairs(spark, sf) -> DataFrame:
    p, s = F.col("p_partkey"), F.col("p_size")
    a, b = F.struct(*_report(p, s)).alias("a"), F.struct(*_report(p + 1 + p % 11, s + p % 2)).alias("b")
    return table(spark, sf, "part").select(p.alias("pair_id"), a, b)


def _side_rules() -> str:
    """The rules of the comparison as rows of SQL, in their order."""
    fps = lambda p: f"(24.0 + {p} % 3)"
    video = [
        ("Format / Codec", "p % 2 <> q % 2", "CASE p % 2 WHEN 0 THEN 'AVC' ELSE 'HEVC' END", "CASE q % 2 WHEN 0 THEN 'AVC' ELSE 'HEVC' END"),
        ("Resolution", "s <> z", "CAST(s * 16 AS VARCHAR) || 'x' || CAST(s * 9 AS VARCHAR)", "CAST(z * 16 AS VARCHAR) || 'x' || CAST(z * 9 AS VARCHAR)"),
        ("Frame Rate", f"abs({fps('p')} - {fps('q')}) > 0.05", f"printf('%.3f fps', CAST({fps('p')} AS DOUBLE))", f"printf('%.3f fps', CAST({fps('q')} AS DOUBLE))"),
        ("Bit Depth", "(p % 4 = 0) <> (q % 4 = 0)", "CASE WHEN p % 4 = 0 THEN '10 bit' ELSE '8 bit' END", "CASE WHEN q % 4 = 0 THEN '10 bit' ELSE '8 bit' END"),
        ("HDR Format", "(p % 5 = 0) <> (q % 5 = 0)", "CASE WHEN p % 5 = 0 THEN 'Some(\"HDR10\")' ELSE 'None' END", "CASE WHEN q % 5 = 0 THEN 'Some(\"HDR10\")' ELSE 'None' END"),
    ]
    audio = [
        ("Channels", "s % 6 <> z % 6", "CAST(s % 6 + 1 AS VARCHAR) || ' ch'", "CAST(z % 6 + 1 AS VARCHAR) || ' ch'"),
        ("Sampling Rate", "p % 2 <> q % 2", "CASE p % 2 WHEN 0 THEN '48000 Hz' ELSE '44100 Hz' END", "CASE q % 2 WHEN 0 THEN '48000 Hz' ELSE '44100 Hz' END"),
    ]
    rules = [
        ("General", "Container Format", "(p % 7 = 0) <> (q % 7 = 0)", "CASE WHEN p % 7 = 0 THEN 'MPEG-4' ELSE 'Matroska' END", "CASE WHEN q % 7 = 0 THEN 'MPEG-4' ELSE 'Matroska' END"), ("General", "Duration", "abs(p - q) * 100.0 > 500", "printf('%.2fs', p * 100.0 / 1000)", "printf('%.2fs', q * 100.0 / 1000)"),
        ("General", "File Size", "p <> q AND p > 0", "CAST(p * 1000 AS VARCHAR) || ' bytes'", "CAST(q * 1000 AS VARCHAR) || ' bytes'"), ("Video", "Track Count", "s % 3 <> z % 3", "CAST(s % 3 AS VARCHAR)", "CAST(z % 3 AS VARCHAR)"),
    ]
    rules += [(f"Video #{i}", f, f"least(s % 3, z % 3) >= {i} AND ({d})", a, b) for i in (1, 2) for f, d, a, b in video]
    rules.append(("Audio", "Track Count", "p % 3 <> q % 3", "CAST(p % 3 AS VARCHAR)", "CAST(q % 3 AS VARCHAR)"))
    rules += [(f"Audio #{i}", f, f"least(p % 3, q % 3) >= {i} AND ({d})", a, b) for i in (1, 2) for f, d, a, b in audio]
    rules.append(("Subtitles", "Track Count", "s % 2 <> z % 2", "CAST(s % 2 AS VARCHAR)", "CAST(z % 2 AS VARCHAR)"))
    return " UNION ALL ".join(f"SELECT pair_id, {k} AS k, '{c}' AS category, '{f}' AS field, {a} AS value_a, {b} AS value_b FROM t WHERE {d}" for k, (c, f, d, a, b) in enumerate(rules))


_T = "WITH t AS (SELECT p_partkey AS pair_id, p_partkey AS p, p_partkey + 1 + p_partkey % 11 AS q, p_size AS s, p_size + p_partkey % 2 AS z FROM part)"


@query(f"{_T} SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY k) - 1 AS seq, category, field, value_a, value_b FROM ({_side_rules()})")
def x05_compare_reports(spark, sf):
    return reports.compare(_pairs(spark, sf))


@query(f"{_T} SELECT t.pair_id, count(d.k) AS differences, count(d.k) = 0 AS is_identical FROM t LEFT JOIN ({_side_rules()}) d ON t.pair_id = d.pair_id GROUP BY t.pair_id")
def x06_identical(spark, sf):
    pairs = _pairs(spark, sf)
    return reports.identical(pairs, reports.compare(pairs))


@query("""WITH t AS (SELECT p_partkey % 40 AS field, p_partkey // 40 % 2 AS slot, max(p_brand) AS value FROM part GROUP BY ALL), w AS (SELECT field, max(CASE WHEN slot = 0 THEN value END) AS a, max(CASE WHEN slot = 1 THEN value END) AS b FROM t GROUP BY field)
SELECT '"Part","' || field || '","' || coalesce(a, '—') || '","' || coalesce(b, '—') || '",' || CASE WHEN coalesce(a, '—') <> coalesce(b, '—') THEN 'Yes' ELSE 'No' END AS value FROM w""")
def x07_compare_csv(spark, sf):
    p = F.col("p_partkey")
    values = table(spark, sf, "part").groupBy((p % 40).alias("field"), (F.floor(p / 40) % 2).cast("int").alias("slot")).agg(F.max("p_brand").alias("value"))
    return reports.compare_csv(compare.matrix(values.select(F.lit("Part").alias("category"), F.col("field").cast("string").alias("field"), "slot", "value"), [0, 1]), ["a", "b"])[1]


@query("""SELECT p_partkey, '"f' || p_partkey || '.mkv","' || CASE WHEN p_partkey % 7 = 0 THEN 'MPEG-4' ELSE 'Matroska' END || '",' || p_partkey * 1000 || ',' || p_partkey * 100 || ',"' || CASE WHEN p_size % 3 > 0 THEN CASE p_partkey % 2 WHEN 0 THEN 'AVC' ELSE 'HEVC' END ELSE '' END || '","' ||
CASE WHEN p_size % 3 > 0 THEN p_size * 16 || 'x' || p_size * 9 ELSE '' END || '","' || CASE WHEN p_size % 3 > 0 THEN printf('%.3f', CAST(24 + p_partkey % 3 AS DOUBLE)) ELSE '' END || '","' || CASE WHEN p_partkey % 3 > 0 THEN 'AAC' ELSE '' END || '",' ||
CASE WHEN p_partkey % 3 > 0 THEN CAST(p_size % 6 + 1 AS VARCHAR) ELSE '' END || ',' || CASE WHEN p_partkey % 3 > 0 THEN CASE p_partkey % 2 WHEN 0 THEN '48000' ELSE '44100' END ELSE '' END AS csv,
'"f' || p_partkey || '.mkv",' || CASE WHEN p_partkey % 7 = 0 THEN 'MPEG-4' ELSE 'Matroska' END || ',' || p_partkey * 1000 || ',' || p_partkey * 100 || ',' || CASE WHEN p_size % 3 > 0 THEN CASE p_partkey % 2 WHEN 0 THEN 'AVC' ELSE 'HEVC' END ELSE '' END || ',' ||
CASE WHEN p_size % 3 > 0 THEN p_size * 16 || 'x' || p_size * 9 ELSE '' END || ',' || CASE WHEN p_partkey % 3 > 0 THEN 'AAC' ELSE '' END || ',' || CASE WHEN p_partkey % 3 > 0 THEN CAST(p_size % 6 + 1 AS VARCHAR) ELSE '' END || ',' ||
CASE WHEN p_partkey % 3 > 0 THEN CASE p_partkey % 2 WHEN 0 THEN '48000' ELSE '44100' END ELSE '' END AS batch FROM part""")
def s05_csv_tables(spark, sf):
    df = _reports(spark, sf)
    return df.select("p_partkey", reports.csv(df).alias("csv"), reports.batch_csv(df).alias("batch"))


@query("""WITH t AS (SELECT *, CASE p_partkey % 2 WHEN 0 THEN 'AVC' ELSE 'HEVC' END AS codec, CASE p_partkey % 7 WHEN 0 THEN 'MPEG-4' ELSE 'Matroska' END AS container, CASE WHEN p_partkey % 4 = 0 THEN 10 ELSE 8 END AS depth, CASE p_partkey % 2 WHEN 0 THEN 48000 ELSE 44100 END AS rate FROM part),
v AS (SELECT *, '    <track type="Video">
      <ID>#</ID>
      <Format>' || codec || '</Format>
      <Width>' || p_size * 16 || '</Width>
      <Height>' || p_size * 9 || '</Height>
      <BitDepth>' || depth || '</BitDepth>
    </track>
' AS video, '    <track type="Audio">
      <ID>#</ID>
      <Format>AAC</Format>
      <Channels>' || p_size % 6 + 1 || '</Channels>
      <SamplingRate>' || rate || '</SamplingRate>
    </track>
' AS audio FROM t)
SELECT p_partkey, '<?xml version="1.0" encoding="UTF-8"?>
<MediaInfo xmlns="https://mediaarea.net/mediainfo" version="2.0">
  <media ref="f' || p_partkey || '.mkv">
    <track type="General">
      <Format>' || container || '</Format>
      <FileSize>' || p_partkey * 1000 || '</FileSize>
      <Duration>' || CASE WHEN p_partkey % 10 = 0 THEN CAST(p_partkey // 10 AS VARCHAR) ELSE p_partkey // 10 || '.' || p_partkey % 10 END || '</Duration>
    </track>
' || CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN replace(video, '#', '1') ELSE replace(video, '#', '1') || replace(video, '#', '2') END || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN replace(audio, '#', '3') ELSE replace(audio, '#', '3') || replace(audio, '#', '4') END || '  </media>
</MediaInfo>
' AS xml FROM v""")
def s06_xml(spark, sf):
    df = _reports(spark, sf)
    return df.select("p_partkey", reports.xml(df).alias("xml"))


@query("""WITH t AS (SELECT *, CASE p_partkey % 2 WHEN 0 THEN 'AVC' ELSE 'HEVC' END AS codec, CASE p_partkey % 7 WHEN 0 THEN 'MPEG-4' ELSE 'Matroska' END AS container FROM part)
SELECT p_partkey, 1 + p_size % 3 + p_partkey % 3 + p_size % 2 AS tracks, 'f' || p_partkey || '.mkv' AS ref, container AS format, CASE WHEN p_partkey % 10 = 0 THEN CAST(p_partkey // 10 AS VARCHAR) ELSE p_partkey // 10 || '.' || p_partkey % 10 END AS duration,
CASE WHEN p_size % 3 > 0 THEN CAST(p_size * 16 AS VARCHAR) END AS width, CASE WHEN p_size % 3 > 0 THEN printf('%.3f', CAST(24 + p_partkey % 3 AS DOUBLE)) END AS frame_rate, CASE WHEN p_size % 3 > 0 THEN CASE p_partkey % 3 WHEN 1 THEN 'BT.2020' WHEN 2 THEN 'BT.709' END END AS primaries,
CASE WHEN p_size % 3 > 0 THEN 'Yes' END AS main FROM t""")
def s07_json(spark, sf):
    df = _reports(spark, sf)
    at = lambda path: F.get_json_object("j", path)
    found = df.select("p_partkey", reports.json(df).alias("j"), (F.size("videos") > 0).alias("has"))
    own = lambda path: F.when(F.col("has"), at(path))
    count = F.size(F.from_json(at("$.media.track"), "array<map<string,string>>"))
    return found.select("p_partkey", count.alias("tracks"), at("$.media.@ref").alias("ref"), at("$.media.track[0].Format").alias("format"), at("$.media.track[0].Duration").alias("duration"), own("$.media.track[1].Width").alias("width"), own("$.media.track[1].FrameRate").alias("frame_rate"), own("$.media.track[1].colour_primaries").alias("primaries"), own("$.media.track[1].Default").alias("main"))


@query("""WITH t AS (SELECT *, CASE p_partkey % 7 WHEN 0 THEN 'MPEG-4' ELSE 'Matroska' END AS container FROM part)
SELECT p_partkey, rpad('Complete name', 40, ' ') || ' : f' || p_partkey || '.mkv' AS line_1, rpad('Format', 40, ' ') || ' : ' || container AS line_2, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN 'Video' ELSE 'Video #1' END AS video_title,
1 + p_size % 3 + p_partkey % 3 + p_size % 2 AS blocks, CASE WHEN p_partkey % 3 > 0 THEN rpad('Sampling rate', 40, ' ') || ' : ' || CASE p_partkey % 2 WHEN 0 THEN '48.0 kHz' ELSE '44.1 kHz' END END AS rate,
p_size % 3 AS page_videos, p_partkey % 3 AS page_audios FROM t""")
def s08_text_and_html(spark, sf):
    df = _reports(spark, sf)
    found = df.select("p_partkey", reports.text(df).alias("t"), reports.html(df).alias("h"))
    lines = F.split("t", "\n")
    part = lambda pattern: F.nullif(F.regexp_extract("t", pattern, 1), F.lit(""))
    times = lambda c, what: F.size(F.split(c, what)) - 1
    return found.select("p_partkey", lines[1].alias("line_1"), lines[2].alias("line_2"), part("\n\n(Video[^\n]*)\n").alias("video_title"), times("t", "\n\n").alias("blocks"), part("\n(Sampling rate[^\n]*)").alias("rate"), times("h", "<h2>Video").alias("page_videos"), times("h", "<h2>Audio").alias("page_audios"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Wave' WHEN 1 THEN 'TTA' WHEN 2 THEN 'IVF' WHEN 3 THEN 'SubRip' ELSE 'Unknown' END AS format, CASE WHEN o_orderkey % 5 = 2 THEN 1 ELSE 0 END AS videos, CASE WHEN o_orderkey % 5 < 2 THEN 1 ELSE 0 END AS audios, CASE WHEN o_orderkey % 5 = 3 THEN 1 ELSE 0 END AS texts,
CASE o_orderkey % 5 WHEN 0 THEN o_custkey % 2 + 1 WHEN 1 THEN o_custkey % 2 + 1 END AS channels, CASE o_orderkey % 5 WHEN 3 THEN 2500.0 WHEN 2 THEN CASE WHEN o_custkey > 0 THEN o_custkey / 25.0 * 1000 END END AS duration_ms, 'f' || o_orderkey AS file_name, CASE WHEN o_orderkey % 5 = 4 AND o_orderkey % 2 = 1 THEN 'no known format' END AS error FROM orders""")
def i01_inspect_mixed(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    channels = c % 2 + 1
    made = F.when(k % 5 == 0, synth.wav(channels, F.lit(44100), F.lit(16), F.lit(0))).when(k % 5 == 1, synth.tta(channels, F.lit(16), F.lit(44100), F.lit(0))).when(k % 5 == 2, synth.ivf(F.lit("VP90"), F.lit(16), F.lit(9), F.lit(25), F.lit(1), c))
    made = made.when(k % 5 == 3, F.lit(b"1\n00:00:01,000 --> 00:00:02,500\nx\n")).otherwise(F.when(k % 2 == 1, F.lit(b"????")).otherwise(F.lit(b"")))
    files = table(spark, sf, "orders").select(F.concat(F.lit("d/f"), k.cast("string")).alias("path"), made.alias("content")).withColumn("length", F.length("content").cast("bigint"))
    found = inspect.inspect(files, tasks(spark, sf, "orders"))
    a = reports.primary("audios")
    ms = F.when(F.col("general.format").isin("IVF", "SubRip"), F.col("general.duration_ms"))
    return found.select(F.substring("path", 4, 20).cast("bigint").alias("o_orderkey"), "general.format", F.size("videos").alias("videos"), F.size("audios").alias("audios"), F.size("texts").alias("texts"), a["channels"].alias("channels"), ms.alias("duration_ms"), "general.file_name", "error")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS path, 'Matroska' AS format, (p_partkey + 1) * 5.0::DOUBLE AS duration_ms, 1 AS videos, 1 AS audios, 2 AS chapters, 'VP8' AS video, p_size * 16 AS width, 25.0 AS frame_rate, 2 * p_size + 7 AS video_bytes, 'Opus' AS audio, p_size % 8 + 1 AS channels, 'deu' AS language FROM part""")
def i02_inspect_matroska(spark, sf):
    files = container_queries._matroska(spark, sf).withColumn("length", F.length("content").cast("bigint"))
    found = inspect.inspect(files, tasks(spark, sf, "part"))
    v, a = reports.primary("videos"), reports.primary("audios")
    return found.select("path", "general.format", "general.duration_ms", F.size("videos").alias("videos"), F.size("audios").alias("audios"), F.size(F.col("menus")[0]["chapters"]).alias("chapters"), v["format"].alias("video"), v["width"].alias("width"), v["frame_rate"].alias("frame_rate"), v["stream_size"].alias("video_bytes"), a["format"].alias("audio"), a["channels"].alias("channels"), a["language"].alias("language"))
