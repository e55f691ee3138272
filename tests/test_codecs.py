"""Codec headers and reports against bytes written out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaframe.functions import bits, bitstreams, codecs, sps
from mediaframe.functions.bitbatch import BitBatch
from mediaframe.operators import reports

# Bytes and what they must give.
#: The configuration of an 8-bit 4:2:0 stream of version 3.4.
FFV1 = bytes.fromhex("562B84D19C052F413C6026E95C376F5D1B76979D3AC9C420431E8B9F5520512F4EF8A1683B9B17137C03")


def table(spark, *contents):
    return spark.createDataFrame([(k, None if c is None else bytearray(c)) for k, c in enumerate(contents)], "id int, content binary")


def values(spark, parse, *contents):
    found = table(spark, *contents).select("id", parse(F.col("content")).alias("h")).orderBy("id").collect()
    return [r["h"].asDict() if r["h"] is not None else None for r in found]


def prores(chroma=2, interlace=0, aspect=0, rate=3, alpha=0, version=0):
    head = (40).to_bytes(4, "big") + b"icpf" + (28).to_bytes(2, "big") + bytes([0, version]) + b"apl0" + (1920).to_bytes(2, "big") + (1080).to_bytes(2, "big")
    return head + bytes([chroma << 6 | interlace << 2, aspect << 4 | rate, 1, 1, 1, alpha]) + bytes(14)


def test_prores_frames(spark):
    good = values(spark, codecs.prores_frame, prores(), prores(3, 1, 2, 11, 2, 1), prores(interlace=2, rate=12))
    assert (good[0]["width"], good[0]["height"], good[0]["encoder"], good[0]["scan_type"], good[0]["frame_rate"]) == (1920, 1080, "apl0", "Progressive", 25.0)
    assert (good[1]["chroma"], good[1]["scan_order"], good[1]["display_aspect"], good[1]["frame_rate"], good[1]["alpha_bit_depth"]) == ("4:4:4", "TFF", 4 / 3, 120.0, 16)
    assert (good[2]["scan_order"], good[2]["frame_rate"]) == ("BFF", None)
    junk, short, newer = bytearray(prores()), bytearray(prores()), bytearray(prores())
    junk[4:8], short[8:10], newer[10:12] = b"junk", b"\0\4", b"\0\2"
    assert values(spark, codecs.prores_frame, junk, short, newer, prores(chroma=1), prores(alpha=3), bytes(8), None) == [None] * 7


def test_prores_picture(spark):
    frame = bytearray(prores()[:28])
    frame[8:10], frame[16:18], frame[18:20] = b"\0\x14", b"\0\x10", b"\0\x10"
    good = bytes(frame) + bytes([8 << 3, 0, 0, 0, 16, 0, 1, 0, 0, 6, 0, 0, 0, 0, 0, 0])
    bad = bytearray(good)
    bad[36:38] = b"\0\5"
    found = values(spark, codecs.prores_picture, good, bad)
    assert found == [{"header_size": 8, "picture_size": 16, "declared_slices": 1, "slices": 1, "slice_bytes": 6}, None]


def test_ffv1_configuration(spark):
    rows = bitstreams.ffv1_config(table(spark, FFV1, b"\1\2", None), "content").orderBy("id").collect()
    assert rows[0]["config"].asDict() == {"format_version": "3.4", "bit_depth": 8, "chroma": "4:2:0", "coder": 0, "has_alpha": False}
    assert rows[1]["config"] is None and rows[2]["config"] is None


def test_audio_headers(spark):
    assert values(spark, codecs.aac_config, b"\x12\x10", b"\x12", None)[0] == {"profile": "LC", "object_type": 2, "sampling_rate": 44100, "channels": 2, "channel_layout": "Stereo (2.0)"}
    thd = values(spark, codecs.truehd, b"\xf8\x72\x6f\xba\x01" + bytes([6 << 3]) + bytes(10), bytes(16))
    assert (thd[0]["profile"], thd[0]["sampling_rate"], thd[0]["channels"]) == ("Dolby TrueHD", 48000, 6) and thd[1] is None
    assert values(spark, codecs.dts, b"\x7f\xfe\x80\x01" + bytes(8), None) == [None, None]


def test_broken_bitstreams_are_null(spark):
    for read, out in ((bitstreams.hevc_sps, "sps"), (bitstreams.vvc_sps, "sps"), (bitstreams.av1_sequence, "sequence"), (bitstreams.dolby_vision_rpu, "rpu"), (bitstreams.eac3_objects, "objects")):
        assert [r[out] for r in read(table(spark, b"\x42\x01\xff", b"", None), "content").collect()] == [None] * 3


def test_bits():
    b = BitBatch([b"\xac\xf0", b"\xac", None, b""])
    first = np.array([True, True, False, False])
    assert b.u(1, first).tolist() == [1, 1, 0, 0] and b.u(1, first).tolist() == [0, 0, 0, 0] and b.u(4, first).tolist() == [0b1011, 0b1011, 0, 0]
    assert b.u(2, first).tolist() == [0, 0, 0, 0] and b.u(8).tolist() == [0xF0, 0, 0, 0] and b.ok.tolist() == [True, False, False, False]
    signed = BitBatch([bytes([k]) for k in (0x80, 0x40, 0x60, 0x38)])
    assert signed.ue().tolist() == [0, 1, 2, 6] and BitBatch([b"\x40", b"\x60", b"\x20"]).se().tolist() == [1, -1, 2]
    long = BitBatch([b"\0\0\0\1\xff\xff\xff\xfe", bytes(9)])
    assert long.ue().tolist() == [2**32 - 2, 0] and long.ok.tolist() == [True, False]


class Written:
    """A parameter set as a writer by the standard would put it."""

    def __init__(self):
        self.bits = ""

    def u(self, n, *values):
        self.bits += "".join(format(v, f"0{n}b") for v in values)
        return self

    def ue(self, *values):
        for v in values:
            self.bits += "0" * ((v + 1).bit_length() - 1) + format(v + 1, "b")
        return self

    def data(self):
        whole = self.bits + "1"
        whole += "0" * (-len(whole) % 8)
        return int(whole, 2).to_bytes(len(whole) // 8, "big").replace(b"\0\0\0", b"\0\0\3\0").replace(b"\0\0\1", b"\0\0\3\1")


def hevc(long_term=True, predicted=3, vui=True, layers=0, scaling=False):
    """1920 x 1080 in 1088 lines; a listed set with two pictures before and one after, then sets predicted from it one after the other."""
    w = Written().u(8, 0x42, 1).u(4, 0).u(3, layers).u(1, 1).u(2, 0).u(1, 0).u(5, 2).u(32, 0x60000000).u(48, 0).u(8, 120)
    if layers:
        w.u(1, *([1, 1] * layers)).u(2, *[0] * (8 - layers))
        w.bits += "0" * 96 * layers
    w.ue(0, 1, 1920, 1088).u(1, 1).ue(0, 0, 0, 4, 2, 2, 4).u(1, 1)
    for _ in range(layers + 1):
        w.ue(4, 2, 0)
    w.ue(0, 3, 0, 3, 1, 1)
    w.u(1, int(scaling))
    if scaling:
        w.u(1, 1)
        for size, n in enumerate((6, 6, 6, 2)):
            for k in range(n):
                w.u(1, k % 2)
                w.ue(*([0] if k % 2 == 0 else [2] * (min(64, 1 << (4 + 2 * size)) + (size > 1))))
    w.u(2, 3).u(1, 0).ue(1 + predicted).ue(2, 1, 0).u(1, 1).ue(1).u(1, 1).ue(0).u(1, 0)
    pictures = [-1, -3, 1]
    for _ in range(predicted):
        w.u(1, 1).u(1, 1).ue(0)  # all one picture earlier, with the set's own; one that comes to lie at 0 goes
        w.bits += "1" * (len(pictures) + 1)
        pictures = [p - 1 for p in [*pictures, 0] if p != 1]
    w.u(1, int(long_term))
    if long_term:
        w.ue(2).u(8, 5).u(1, 1).u(8, 6).u(1, 0)
    w.u(2, 3).u(1, int(vui))
    if vui:
        w.u(1, 1).u(8, 255).u(16, 4, 3).u(1, 0).u(1, 1).u(3, 5).u(1, 1).u(1, 1).u(8, 9, 16, 9).u(1, 1).ue(0, 0).u(3, 0).u(1, 1).ue(0, 0, 0, 1).u(1, 1).u(32, 1001, 60000)
    return w.data()


@pytest.mark.parametrize("kind", [{}, {"predicted": 1}, {"predicted": 0}, {"long_term": False}, {"layers": 2}, {"scaling": True}])
def test_hevc_sets_by_the_standard(spark, kind):
    row = bitstreams.hevc_sps(table(spark, hevc(**kind)), "content").first()["sps"]
    assert (row["profile"], row["level"], row["bit_depth"], row["width"], row["height"]) == ("Main 10", "4.0", 10, 1920, 1080)
    assert (row["transfer"], row["color_range"], row["hdr_format"]) == ("PQ", "Full", "HDR10") and abs(row["frame_rate"] - 60000 / 1001) < 1e-9


def test_hevc_sets_that_end_early(spark):
    whole = hevc()
    rows = bitstreams.hevc_sps(table(spark, *(whole[:n] for n in range(len(whole)))), "content").orderBy("id").collect()
    found = [r["sps"] for r in rows]
    first = next(k for k, x in enumerate(found) if x is not None)
    assert all(x is None for x in found[:first]) and all(x is not None and x["width"] == 1920 for x in found[first:]) and found[first]["frame_rate"] is None and found[first]["color_range"] is None


def test_avc_set(spark):
    # High, level 4.0, 1920 x 1080
    w = Written().u(8, 0x67, 100, 0, 40).ue(0, 1, 0, 0).u(2, 0).ue(4, 0, 4, 4).u(1, 0).ue(119, 67).u(1, 1).u(1, 1).u(1, 1).ue(0, 0, 0, 4).u(1, 0)
    row = sps.avc_sps(table(spark, w.data(), w.data()[:6], None), "content").orderBy("id").collect()
    assert (row[0]["sps"]["profile"], row[0]["sps"]["level"], row[0]["sps"]["width"], row[0]["sps"]["height"], row[0]["sps"]["chroma"]) == ("High", "4.0", 1920, 1080, "4:2:0")
    assert row[1]["sps"] is None and row[2]["sps"] is None


def test_numbers_of_seven_bits(spark):
    found = values(spark, bits.leb128, b"\xe5\x8e\x26", b"\x05", b"\xff", None)
    assert [f["length"] for f in found] == [624485, 5, None, None]
    assert [f["length"] for f in values(spark, bits.mpeg4_length, b"\x80\x80\x81\x05", b"\x22", b"")] == [133, 34, None]


REPORT = """general struct<file_name:string,format:string,file_size:bigint,duration_ms:double>,
videos array<struct<stream_id:int,format:string,width:int,height:int,bit_depth:int,frame_rate:double>>, audios array<struct<stream_id:int,format:string,channels:int,sampling_rate:int>>, texts array<struct<stream_id:int,format:string>>"""


def test_report_texts(spark):
    row = (("movie.mkv", "Matroska", 52428800, 125000.0), [(1, "HEVC", 3840, 2160, 10, 23.976)], [(2, "E-AC-3", 6, 48000)], [])
    df = spark.createDataFrame([row, (("a<b>.mkv", "Matroska", 0, None), [], [], [])], REPORT)
    texts = df.select(*(reports.formatted(df, k).alias(k) for k in ("text", "json", "xml", "csv", "html", "other"))).collect()
    first, second = texts
    assert "3 840 pixels" in first["text"] and "23.976 FPS" in first["text"] and "48.0 kHz" in first["text"] and "6 channels" in first["text"] and first["other"] == first["text"]
    assert '"Width":"3840"' in first["json"] and '"Duration":"125"' in first["json"] and '"SamplingRate":"48000"' in first["json"]
    assert "<Width>3840</Width>" in first["xml"] and 'ref="a&lt;b&gt;.mkv"' in second["xml"]
    assert first["csv"] == '"movie.mkv","Matroska",52428800,125000,"HEVC","3840x2160","23.976","E-AC-3",6,48000'
    assert second["csv"] == '"a<b>.mkv","Matroska",0,0,"","","","",,'
    assert "3840 &times; 2160" in first["html"] and "a&lt;b&gt;.mkv" in second["html"]


def test_batch_files(spark, tmp_path):
    df = spark.createDataFrame([(k, ((f"f{k}", "Wave", k, None), [], [], [])) for k in (2, 1, 3)], f"input_pos int, r struct<{', '.join(x.strip().replace(' ', ':', 1) for x in REPORT.replace(chr(10), ' ').split(', '))}>").select("input_pos", "r.*")
    reports.write_batch(df.coalesce(1), str(tmp_path / "out"), "csv")
    lines = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == [reports.CSV_HEADER, *(f'"f{k}","Wave",{k},0,"","","","",,' for k in (1, 2, 3))]
