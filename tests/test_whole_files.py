"""Container operators on whole files that the tables of the catalogue don't show, in bytes made here."""

import bisect
import random

import duckdb
import pytest

from mediaframe.operators import boxes, containers
from mediaframe.plans import catalog


def files(spark, *contents):
    return spark.createDataFrame([(str(k), bytearray(c)) for k, c in enumerate(contents)], "path string, content binary")


def element(ident, body, unknown=False):
    return bytes.fromhex(ident) + (b"\x01" + (b"\xff" * 7 if unknown else len(body).to_bytes(7, "big"))) + body


@pytest.mark.parametrize("unknown", [False, True])
def test_clusters_of_unknown_size(spark, unknown):
    tracks = element("1654AE6B", element("AE", element("D7", b"\x01") + element("83", b"\x01")))
    block = lambda n: element("A3", b"\x81\0\0\0" + bytes(n))
    group = element("A0", element("A1", b"\x81\0\0\0" + bytes(5)))
    clusters = b"".join(element("1F43B675", element("E7", bytes([k])) + block(10 + k) + group, unknown) for k in range(20))
    rest = element("1C53BB6B", b"") + element("1254C367", element("7373", element("67C8", element("45A3", b"TITLE") + element("4487", b"late"))))
    head = element("1A45DFA3", b"")
    one = head + element("18538067", element("1549A966", element("4489", bytes.fromhex("447A0000"))) + tracks + clusters + rest, unknown)
    media = files(spark, one, one + head)
    want = {(p, 1, 40, sum(range(10, 30)) + 20 * 5) for p in "01"}
    assert {tuple(r) for r in containers.matroska_block_sizes(media).collect()} == want
    assert {(r["path"], r["blocks"], r["bit_rate"]) for r in containers.matroska_streams(media).collect()} == {(p, 40, 490 * 8) for p in "01"}
    assert {tuple(r) for r in containers.matroska_tags(media).collect()} == {(p, "TITLE", "late") for p in "01"}
    depths = {r["depth"] for r in boxes.nodes(media, "ebml").where("kind = '1F43B675'").collect()}
    assert depths == {1} and boxes.nodes(media, "ebml").where("depth = 0").count() == 5


def box(kind, body):
    return (len(body) + 8).to_bytes(4, "big") + kind + body


def number(n, size=4, order="big"):
    return n.to_bytes(size, order)


@pytest.mark.parametrize("n", [8191, 8192, 20000])
def test_long_tables_of_sample_times(spark, n):
    stts = box(b"stts", number(0) + number(n) + b"".join(number(1 + k % 3) + number(1000 + k) for k in range(n)))
    short = box(b"stts", number(0) + number(n) + number(2) + number(5) + b"\0\0\0")
    empty = box(b"stts", number(0) + number(n))
    got = {r["path"]: tuple(r)[1:] for r in boxes.sample_rates(files(spark, *(box(b"moov", box(b"trak", b)) for b in (stts, short, empty)))).collect()}
    assert got["0"] == (sum(1 + k % 3 for k in range(n)), sum((1 + k % 3) * (1000 + k) for k in range(n)), n, "Variable")
    assert got["1"] == (2, 10, 1, "Constant") and got["2"] == (None, None, 0, "Constant")


def test_long_texts_of_tags(spark):
    long = "é" * 50000 + "end"
    raw, size = long.encode(), lambda n: bytes(n >> s & 127 for s in (21, 14, 7, 0))
    vorbis = number(0, 4, "little") + number(1, 4, "little") + number(len(raw) + 2, 4, "little") + b"A=" + raw
    item = number(len(raw), 4, "little") + number(0) + b"lyrics\0" + raw
    ape = item + b"APETAGEX" + number(2000, 4, "little") + number(len(item) + 32, 4, "little") + number(1, 4, "little") + bytes(12)
    frame = lambda code, data: b"TIT2" + size(len(data) + 1) + b"\0\0" + bytes([code]) + data
    id3 = lambda code, data: b"ID3\4\0\0" + size(len(frame(code, data))) + frame(code, data)
    info = b"INFOINAM" + number(len(raw), 4, "little") + raw + b"\0" * (len(raw) & 1)
    riff = b"RIFF" + number(len(info) + 12, 4, "little") + b"WAVELIST" + number(len(info), 4, "little") + info
    ilst = box(b"moov", box(b"udta", box(b"meta", number(0) + box(b"ilst", box(b"\xa9nam", box(b"data", number(1) + number(0) + raw))))))
    tags = element("18538067", element("1254C367", element("7373", element("67C8", element("45A3", b"K") + element("4487", raw)))))
    for operator, content in [
        (containers.vorbis_comments, vorbis), (containers.ape_tags, ape), (containers.id3v2_tags, id3(3, raw)), (containers.id3v2_tags, id3(1, long.encode("utf-16"))),
        (containers.id3v2_tags, id3(2, long.encode("utf-16-be"))), (containers.riff_info, riff), (containers.iso_tags, ilst), (containers.matroska_tags, tags),
    ]:
        assert [r["value"] for r in operator(files(spark, content)).collect()] == [long], operator


def test_chunks_meet_their_runs(spark):
    rng, count = random.Random(3), 5000
    firsts = sorted({1, *rng.sample(range(2, count + 1), 700)})
    runs = [(f, rng.randrange(1, 9)) for f in firsts]
    stsc = box(b"stsc", number(0) + number(len(runs) + 2) + b"".join(number(f) + number(k) + number(1) for f, k in [*runs, (count + 1, 3), (count + 5, 4)]))
    stco = box(b"stco", number(0) + number(count) + b"".join(number(7 * k) for k in range(count)))
    co64 = box(b"co64", number(0) + number(9) + number(1 << 33, 8) + b"\0\0")  # cut short
    one = box(b"stsc", number(0) + number(1) + number(1) + number(6) + number(1))
    moov = box(b"moov", box(b"trak", stsc + stco) + box(b"trak", one + co64) + box(b"trak", one) + box(b"trak", stco))
    got = {(r["chunk"], r["offset"]): (r["samples"], r["first_sample"]) for r in containers.iso_chunks(files(spark, moov, moov[:400], b"")).where("path = '0'").collect()}
    want, total = {(1, 1 << 33): (6, 0)}, 0
    for k in range(1, count + 1):
        per = runs[bisect.bisect_right(firsts, k) - 1][1]
        want[(k, 7 * (k - 1))] = (per, total)
        total += per
    assert got == want


def test_whole_texts_are_detected(spark, tmp_path):
    marks = lambda at, n: "".join("G" if k in at else "a" for k in range(n))
    texts = ["", "a", "a" * 562, "a" * 563, marks({187, 375}, 600), marks({187}, 600), marks({3, 195, 387}, 600), marks({1, 193, 385}, 600), "a" * 150 + "-->", "a" * 249 + "-->", "a" * 251 + "-->", "a" * 253 + "-->", "é" * 126 + "-->", "é" * 124 + "-->", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = {tuple(r) for r in catalog.QUERIES["d02_detect_text"](spark, str(tmp_path)).collect()}
    assert got == set(con.execute(catalog.SQL["d02_detect_text"]).fetchall()) and len(got) == 4 * len(texts)
    of = {(k, v): f for k, v, f in got}
    assert [of[k, 1] for k in range(8)] == ["Unknown", "Unknown", "MPEGTS", "Unknown", "MPEGTS", "Unknown", "MPEGTS", "Unknown"] and of[8, 0] == of[9, 0] == "SRT" and of[10, 0] == "Unknown"
